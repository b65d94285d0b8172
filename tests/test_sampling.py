import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentia.operators import balance, split
from retentia.plans.preprocess import preprocess_data


@pytest.fixture(scope="module")
def classes(spark):
    """60 of a, 30 of b, 10 without label."""
    label = F.when(F.col("k") < 60, "a").when(F.col("k") < 90, "b")
    return spark.range(100).withColumnRenamed("id", "k").withColumn("y", label).cache()


def keys(df):
    return sorted(row.k for row in df.collect())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(0, 1), st.integers(0, 9))
def test_split_is_a_partition(classes, ratio, seed):
    train, test = split.stratified_train_test_split(classes, "y", ratio, seed, "k")
    assert sorted(keys(train) + keys(test)) == list(range(100))
    assert train.columns == classes.columns


def test_split_is_stable_under_repartition(classes):
    train, _ = split.random_split(classes, 0.5, 3, "k")
    again, _ = split.random_split(classes.repartition(7).orderBy(F.desc("k")), 0.5, 3, "k")
    other, _ = split.random_split(classes, 0.5, 4, "k")
    assert keys(train) == keys(again) != keys(other)


def test_split_without_key_keeps_copies_together(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("k"))
    train, test = split.random_split(df, 0.5, 1)
    assert not set(keys(train)) & set(keys(test)) and train.count() + test.count() == 200


def test_weights(classes):
    weighted = balance.compute_class_weights_column(classes, "y")
    assert {row.y: row.class_weights for row in weighted.collect()} == {
        "a": pytest.approx(100 / 180), "b": pytest.approx(100 / 90), None: pytest.approx(100 / 30)
    }
    assert weighted.agg(F.sum("class_weights")).first()[0] == pytest.approx(100)


def test_awkward_columns(spark):
    """A label named like an internal column, a map, and a dotted name, without key."""
    df = spark.range(60).select(
        (F.col("id") % 3 == 0).alias("count"), F.create_map(F.lit("a"), "id").alias("m"), F.col("id").alias("a.b")
    )
    train, test = split.random_split(df, 0.5, 1)
    assert train.count() + test.count() == 60
    weights = {row["count"]: row.class_weights for row in balance.compute_class_weights_column(df, "count").collect()}
    assert weights == {True: 1.5, False: 0.75}
    assert balance.undersample_random(df, "count", seed=1).columns == ["count", "m", "a.b"]


def test_undersample(classes):
    kept = balance.undersample_random(classes, "y", "k", 5)
    counts = {row.y: row["count"] for row in kept.groupBy("y").count().collect()}
    assert counts[None] == 10 and 3 <= counts["a"] <= 20 and 3 <= counts["b"] <= 20
    assert set(keys(kept)) <= set(range(100)) and kept.columns == classes.columns
    one = classes.filter("y = 'a'")
    assert keys(balance.undersample_random(one, "y", "k")) == keys(one)


@pytest.mark.parametrize("mode", ["poisson", "replicate"])
def test_oversample(classes, mode, monkeypatch):
    grown = balance.oversample_random(classes, "y", "k", 5, mode)
    counts = {row.y: row["count"] for row in grown.groupBy("y").count().collect()}
    assert counts["a"] == 60 and 35 <= counts["b"] <= 85 and 35 <= counts[None] <= 85
    assert keys(grown.filter("y = 'a'")) == list(range(60))
    if mode == "replicate":  # rates are whole numbers
        assert counts == {"a": 60, "b": 60, None: 60}
    plain = keys(grown)
    monkeypatch.setattr(balance, "COPIES_PER_CHUNK", 4)  # the form for very many copies
    assert keys(balance.oversample_random(classes, "y", "k", 5, mode)) == plain
    with pytest.raises(ValueError):
        balance.oversample_random(classes, "y", mode="twice")


def test_poisson_terms():
    assert balance.UNIT_POISSON_CDF[0] == pytest.approx(math.exp(-1))
    assert 1 - balance.UNIT_POISSON_CDF[-1] < 2**-32


@pytest.fixture(scope="module")
def customers(spark):
    rows = [
        (n, "churn" if n % 4 == 0 else "stay", "abc"[n % 3], float(n % 50), 7.0, n % 2 == 0, None if n % 9 == 0 else n % 5)
        for n in range(200)
    ]
    df = spark.createDataFrame(rows, "id long, y string, c string, x double, same double, flag boolean, gap int")
    return df.unionByName(df.limit(20))


OPTIONS = {"row_threshold": 0.5, "column_threshold": 0.5, "default_values": {"gap": "median"}}


def test_preprocess_text_label(customers):
    train, test = preprocess_data(customers, "y", OPTIONS, "encoding", "normalize", True, 0.75, seed=2, key="id")
    assert train.columns == test.columns == ["features", "y_index"]
    assert train.count() + test.count() == 200  # copies are gone, no row is lost
    # two slots of c, x, gap and flag; the constant column and the key are no features
    assert len(train.first().features) == 5
    assert {row.y_index for row in test.collect()} == {0.0, 1.0}


def test_preprocess_without_key(customers):
    train, test = preprocess_data(customers.drop("id"), "y", OPTIONS, "index", seed=2)
    distinct = customers.drop("id").na.fill({"gap": 2}).distinct().count()
    assert train.count() + test.count() == distinct


@pytest.mark.parametrize("technique", ["undersample_random", "oversample_random", "nearmiss_v2", "class_weights"])
def test_preprocess_rebalances_training_rows_only(customers, technique):
    options = {"k": 3} if technique == "nearmiss_v2" else None
    common = dict(transformation_categorical="index", stratified_split=True, train_split_ratio=0.6, seed=2, key="id")
    plain, untouched = preprocess_data(customers, "y", OPTIONS, **common)
    train, test = preprocess_data(
        customers, "y", OPTIONS, rebalancing_technique=technique, resampling_options=options, **common
    )
    assert test.count() == untouched.count()
    counts = {row.y_index: row["count"] for row in train.groupBy("y_index").count().collect()}
    before = {row.y_index: row["count"] for row in plain.groupBy("y_index").count().collect()}
    if technique == "nearmiss_v2":
        assert counts[0.0] == counts[1.0] == before[1.0]
    elif technique == "class_weights":
        assert train.columns == ["features", "y_index", "class_weights"] and counts == before
        assert train.agg(F.sum("class_weights")).first()[0] == pytest.approx(plain.count())
    else:
        assert counts != before


def test_preprocess_fit_on_train(customers):
    rare = customers.withColumn("c", F.when(F.col("id") == 1, "rare").otherwise(F.col("c")))
    train, test = preprocess_data(rare, "y", OPTIONS, "index", "normalize", seed=2, key="id", fit_on="train")
    assert train.count() + test.count() in (199, 200)


@pytest.mark.parametrize("bad", [{"transformation_categorical": "hash"}, {"transformation_numerical": "log"}, {"rebalancing_technique": "smote"}, {"fit_on": "test"}])
def test_preprocess_rejects_unknown_words(customers, bad):
    with pytest.raises(ValueError):
        preprocess_data(customers, "y", OPTIONS, **bad)


def test_preprocess_rejects_untransformed_text(customers):
    with pytest.raises(ValueError, match="c"):
        preprocess_data(customers, "y", OPTIONS, key="id")
