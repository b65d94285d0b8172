import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.functions import keytable
from retentia.operators import encode
from retentia.plans.features import get_indexed_and_encode_vectors


@pytest.fixture
def ties(spark):
    return spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "c")], "k long, s string")


@pytest.mark.parametrize("driver_labels", [10, 0])
def test_ties_go_alphabetically(ties, driver_labels):
    indexed, model = encode.string_index_columns(ties, [("s", "ix")], driver_labels=driver_labels)
    assert {row.s: row.ix for row in indexed.collect()} == {"c": 0.0, "a": 1.0, "b": 2.0}
    assert model.sizes() == {"ix": 3}
    reverted = encode.revert_string_index(indexed, [("ix", "back")], model)
    assert all(row.s == row.back for row in reverted.collect())


@pytest.mark.parametrize("driver_labels", [10, 0])
def test_invalid_values(spark, ties, driver_labels):
    other = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "k long, s string")

    def apply(how):
        return encode.fit_string_index(ties, [("s", "ix")], how, driver_labels).transform(other)

    assert {row.k: row.ix for row in apply("keep").collect()} == {1: 1.0, 2: 3.0, 3: 3.0}
    assert [row.k for row in apply("skip").collect()] == [1]
    with pytest.raises(Exception, match="(?i)unseen|null"):
        apply("error").collect()
    with pytest.raises(ValueError):
        apply("drop")


def test_several_columns_and_mixed_sizes(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 3).cast("string").alias("few"), (F.col("id") % 90).cast("string").alias("many"), (F.col("id") % 7).alias("number")
    )
    pairs = [("few", "few_ix"), ("many", "many_ix"), ("number", "number_ix")]
    ours, model = encode.string_index_columns(df, pairs, driver_labels=20)
    assert set(model.natives) == {"few_ix", "number_ix"} and [t.output_col for t in model.tables] == ["many_ix"]
    theirs = StringIndexer(inputCols=[a for a, _ in pairs], outputCols=[b for _, b in pairs]).fit(df).transform(df)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_table_index_encodes(spark, ties):
    """Metadata of the table form suffices for one-hot encoding."""
    indexed, _ = encode.string_index_columns(ties, [("s", "ix")], driver_labels=0)
    encoded, _ = encode.encoded_index_columns(indexed, [("ix", "hot")])
    rows = {row.s: row.hot for row in encoded.select("s", vector_to_array("hot").alias("hot")).collect()}
    assert rows == {"c": [1.0, 0.0], "a": [0.0, 1.0], "b": [0.0, 0.0]}


def test_skewed_lookup(spark, monkeypatch):
    """Hot, cold, null and absent keys, joined without a broadcast of the whole table."""
    monkeypatch.setattr(keytable, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(keytable, "HOT_KEYS", 4)
    df = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("key")
    )
    table = keytable.KeyTable.of(df, "key")
    assert not table.small
    out = table.with_values(twice=F.col("count") * 2).attach(df, F.col("key"), ["twice"])
    assert out.columns == ["id", "key", "twice"]
    counts = {}
    for row in df.collect():
        counts[row.key] = counts.get(row.key, 0) + 1
    rows = out.collect()
    assert len(rows) == 600 and all(row.twice == 2 * counts[row.key] for row in rows)
    fresh = spark.createDataFrame([(1, "hot"), (2, "nowhere")], "id long, key string")
    found = {row.key: row.twice for row in table.with_values(twice=F.col("count") * 2).attach(fresh, F.col("key"), ["twice"]).collect()}
    assert found == {"hot": 400, "nowhere": None}


def test_hot_rows_spread_over_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(keytable, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(keytable, "HOT_KEYS", 10)
    df = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    table = keytable.KeyTable.of(df, "key")
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = table.with_values(n=F.col("count") + 0).attach(df, F.col("key"), ["n"])
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 8000 and max(sizes) < 2000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcNé ", max_size=3), min_size=1, max_size=20))
def test_index_then_revert_is_identity(spark, words):
    df = spark.createDataFrame([(word,) for word in words], "s string")
    indexed, model = encode.string_index_columns(df, [("s", "ix")])
    back = encode.revert_string_index(indexed, [("ix", "back")], model)
    assert all(row.s == row.back for row in back.collect())


def test_boolean_index(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [row.ix for row in encode.boolean_index_columns(df, [("b", "ix")]).collect()] == [1, 0, 0]
    with pytest.raises(ValueError):
        encode.boolean_index_columns(spark.range(1), [("id", "ix")])


def test_min_max(spark):
    df = spark.createDataFrame([(1, 5.0, math.nan), (2, 5.0, 1.0), (3, 5.0, 3.0)], "k long, c double, n double")
    scaled = encode.normalize_min_max_values(["k", "c", "n"], df).orderBy("k").collect()
    assert [row.k_normalized for row in scaled] == [0.0, 0.5, 1.0]
    assert [row.c_normalized for row in scaled] == [None, None, None]
    assert math.isnan(scaled[0].n_normalized) and [row.n_normalized for row in scaled[1:]] == [0.0, 1.0]
    empty = encode.normalize_min_max_values(["c"], df.filter("k > 9"))
    assert empty.count() == 0


def test_vector_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (math.nan, 1.0)], "a double, b double")
    assert encode.vector_feature_column(df, ["a", "b"], "v").count() == 1


def test_vector_index_puts_zero_first(spark):
    df = spark.createDataFrame([(x,) for x in (-2.0, 0.0, 3.0, 5.0)], "x double")
    vector = encode.vector_feature_column(df, ["x"], "v")
    indexed, _ = encode.vector_index_column(vector, "v", "out", 1)  # at least 2 is enforced
    assert [row[0][0] for row in indexed.select(vector_to_array("out")).collect()] == [-2.0, 0.0, 3.0, 5.0]
    indexed, _ = encode.vector_index_column(vector, "v", "out", 4)
    assert [row[0][0] for row in indexed.select(vector_to_array("out")).collect()] == [1.0, 0.0, 2.0, 3.0]


def test_labels(spark):
    df = spark.sql("SELECT * FROM VALUES (true, 'x', 3, array(1)), (NULL, 'y', 4, array(2)), (false, 'y', 4, NULL) AS t(b, s, n, a)")
    assert [row.b_booleantointeger for row in encode.churn(df, "b")[0].collect()] == [1, 1, 0]
    assert [row.b_booleantointeger for row in encode.churn(df, "b", null_boolean_as=0)[0].collect()] == [1, 0, 0]
    text, model = encode.churn(df, "s")
    assert [row.indexed_s for row in text.collect()] == [1.0, 0.0, 0.0] and model.labels("indexed_s") == ["y", "x"]
    number, model = encode.churn(df, "n")
    assert [row.indexed_n for row in number.collect()] == [1.0, 0.0, 0.0] and model is not None
    assert encode.churn(df, "nothing") == (df, None)
    with pytest.raises(ValueError):
        encode.churn(df, "a")
    inverted = encode.churn_inverter(spark.createDataFrame([(0,), (1,), (None,)], "y int"), "y")
    assert [row.y_inverted for row in inverted.collect()] == [1, 0, 0] and inverted.columns == ["y_inverted"]


def test_feature_vectors_with_booleans(spark):
    df = spark.createDataFrame(
        [(n, "ab"[n % 2], n % 3 == 0, "same", float(n), "yn"[n % 2]) for n in range(12)],
        "k long, c string, flag boolean, one string, x double, y string",
    )
    vectors = get_indexed_and_encode_vectors(df, ["c", "flag", "one", "x"], "y")
    assert vectors.label_col == "Churn_Index" and vectors.not_encoded == ["oneIndex"]
    row = vectors.df.filter("k = 3").select(
        vector_to_array("IndexedFeatures").alias("i"), vector_to_array("IndexedEncodedFeatures").alias("e"), "class_weights"
    ).first()
    assert row.i == [1.0, 0.0, 1.0, 3.0] and row.e == [0.0, 0.0, 3.0] and row.class_weights == 1.0
    boolean_label = get_indexed_and_encode_vectors(df, ["x"], "flag")
    assert boolean_label.label_col == "Churn_Index"
    with pytest.raises(ValueError):
        get_indexed_and_encode_vectors(df.withColumn("a", F.array("k")), ["x"], "a")
