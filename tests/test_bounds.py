"""Results and errors are alike above and below every size at which a plan changes, and rows are never confused."""

import math
import os
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from retentia.functions import scratch
from retentia.functions.uniform import row_digest
from retentia.operators import balance, correlate, encode, evaluate, models, recommend
from retentia.operators.nearmiss import Sizes, farthest, undersample_nearmiss_v2
from retentia.plans.preprocess import preprocess_data
from retentia.sources.tables import convert_table


@pytest.mark.parametrize("seed", range(4))
def test_equal_rows_draw_apart(spark, seed):
    df = spark.range(1100).select(F.when(F.col("id") < 1000, "a").otherwise("b").alias("y"), F.lit(1).alias("x"))
    sizes = {r.y: r["count"] for r in balance.undersample_random(df, "y", seed=seed).groupBy("y").count().collect()}
    assert sizes["b"] == 100 and abs(sizes["a"] - 100) <= 5 * math.sqrt(90)
    grown = balance.oversample_random(df, "y", seed=seed)
    sizes = {r.y: r["count"] for r in grown.groupBy("y").count().collect()}
    assert sizes["a"] == 1000 and abs(sizes["b"] - 1000) <= 5 * math.sqrt(1000)
    assert grown.columns == df.columns


def test_row_digest_tells_nulls_apart(spark):
    rows = [(None, n) for n in range(50)] + [(n, None) for n in range(50)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert df.select(row_digest(df)).distinct().count() == 100


def test_composite_keys_are_told_apart(spark):
    """Keys that read alike when joined by a bar do not always fall on the same side."""
    rows = [(f"a|b{n}", "c", n % 2, float(n)) for n in range(100)] + [("a", f"b{n}|c", n % 2, float(n)) for n in range(100)]
    df = spark.createDataFrame(rows, "k string, l string, y int, x double")
    train, test = preprocess_data(df, "y", {"row_threshold": 1.0, "column_threshold": 1.0}, key=["k", "l"], seed=1, train_split_ratio=0.5)
    assert train.count() + test.count() == 200
    sides = train.groupBy("features").count().collect()
    assert {r["count"] for r in sides} == {1, 2}


def nearmiss_rows(spark, null_keys, repeats):
    generator = np.random.default_rng(3)
    rows = [(None if null_keys and n % 3 == 0 else n // repeats, [float(x) for x in generator.standard_normal(3)], int(n < 40)) for n in range(400)]
    return spark.createDataFrame(rows, "k long, f array<double>, y int")


@pytest.mark.parametrize("null_keys, repeats", [(True, 1), (False, 2), (True, 3)])
def test_nearmiss_does_not_trust_keys(spark, null_keys, repeats):
    df = nearmiss_rows(spark, null_keys, repeats)
    forms = [Sizes(), Sizes(broadcast_bytes=0, pivots=8, tile_rows=16, one_task_rows=8), Sizes(one_task_rows=8)]
    found = [sorted(map(str, undersample_nearmiss_v2(df, "f", "y", 3, key="k", sizes=sizes).collect())) for sizes in forms]
    assert len(found[0]) == 80 and found[0] == found[1] == found[2]


def test_farthest_memory_follows_the_slice():
    generator = np.random.default_rng(0)
    left, right = generator.standard_normal((1_500, 5_000)), generator.standard_normal((40, 5_000))
    tracemalloc.start()
    distances, _ = farthest(left, right, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert np.allclose(distances[:3], [sorted(np.linalg.norm(right - x, axis=1), reverse=True)[:10] for x in left[:3]])


def indexers(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",)], "s string")
    return df, [encode.fit_string_index(df, [("s", "i")], driver_labels=bound) for bound in (50_000, 0)]


def test_indexers_agree(spark):
    df, models_ = indexers(spark)
    outputs = [sorted(map(tuple, m.transform(df).collect())) for m in models_]
    assert outputs[0] == outputs[1]
    assert [sorted(map(tuple, m.catalogue(spark, "i").collect())) for m in models_] == [[(0, "a"), (1, "b"), (2, "c")]] * 2
    for model in models_:
        back = encode.revert_string_index(model.transform(df), [("i", "t")], model)
        assert all(r.s == r.t for r in back.collect())
        unknown = spark.createDataFrame([(7.0,)], "i double")
        with pytest.raises(Exception):
            encode.revert_string_index(unknown, [("i", "t")], model).collect()
    with pytest.raises(ValueError):
        models_[1].labels("i")


def test_slot_names_agree(spark):
    df, models_ = indexers(spark)
    names = []
    for model in models_:
        encoded, _ = encode.encoded_index_columns(model.transform(df), [("i", "e")])
        names.append(encode.slot_names(encoded, "e") if hasattr(encode, "slot_names") else encoded.schema["e"].metadata["ml_attr"]["attrs"])
    assert names[0] == names[1]


@pytest.mark.parametrize("rows_at_once", [50_000, 0])
def test_recommendation_items_agree(spark, rows_at_once):
    schema = "u int, recommendations array<struct<index:int,score:float>>"
    rows = [(1, [(2, 0.5), (0, 0.25)]), (2, []), (3, None)]
    catalogue = recommend.catalogue_of(["a", "b", "c"], spark.range(1))
    named = recommend.revert_item_index_in_recommendations(spark.createDataFrame(rows, schema), catalogue, rows_at_once=rows_at_once)
    assert {r.u: r.recommendations and [tuple(x) for x in r.recommendations] for r in named.collect()} == {1: [("c", 0.5), ("a", 0.25)], 2: [], 3: None}
    assert named.schema["recommendations"].dataType.elementType.fieldNames() == ["asin", "score"]
    for wrong in (3, -1, None):
        bad = spark.createDataFrame([(1, [(wrong, 0.5)])], schema)
        with pytest.raises(Exception):
            recommend.revert_item_index_in_recommendations(bad, catalogue, rows_at_once=rows_at_once).collect()


@pytest.mark.parametrize("columns", [3, 25])
@pytest.mark.parametrize("method", correlate.METHODS)
def test_correlation_of_no_rows(spark, columns, method):
    names = [f"c{at}" for at in range(columns)]
    empty = spark.createDataFrame([], ", ".join(f"{name} double" for name in names))
    found = correlate.correlation_matrix(empty, names, method).collect()
    assert len(found) == columns**2
    assert all(r.correlation == 1.0 if r.row_name == r.col_name else math.isnan(r.correlation) for r in found)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_rank_shuffles_do_not_grow_with_columns(spark):
    wide = spark.range(50).select(*[((F.col("id") * at) % 7).cast("double").alias(f"c{at}") for at in range(1, 13)])
    few = correlate.average_ranks(wide, ["c1", "c2"])
    many = correlate.average_ranks(wide, wide.columns)
    assert exchanges(few) == exchanges(many)


def test_usable_grid(spark):
    df = spark.range(80).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 40).cast("double").alias("c"), F.rand(1).alias("x"))
    vector = VectorAssembler(inputCols=["c", "x"], outputCol="v").transform(df)
    indexed, _ = encode.vector_index_column(vector, "v", "f", 50)
    grid, left_out = models.usable_grid(indexed, "f", "RandomForestClassifier")
    assert grid["maxBins"] == [64, 128] and left_out == [32]
    with pytest.raises(ValueError):
        models.check_bins(indexed, "f", "RandomForestClassifier", {})
    with pytest.raises(ValueError):
        models.usable_grid(indexed, "f", "RandomForestClassifier", {"maxBins": [8]})


def test_folds_do_not_depend_on_order(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    folds = [{r.k: r.f for r in models.with_folds(x, 5, 1, "k", "f").collect()} for x in (df, df.orderBy(F.desc("k")).repartition(3))]
    assert folds[0] == folds[1] and set(folds[0].values()) == set(range(5))


def test_unscored_rows_are_counted(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, None), (None, 1.0), (0.0, 0.0)], "y double, prediction double")
    row = evaluate.performance_evaluation(df, "y").first()
    assert (row.accuracy, row["rows"], row.unscored) == (1.0, 4, 2)
    none = evaluate.performance_evaluation(df.limit(0), "y").first()
    assert (none.accuracy, none["rows"], none.unscored) == (None, 0, 0)


def test_left_out_features_are_named(spark):
    df = spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), F.lit("one").alias("s"), F.lit(3.0).alias("c"), F.col("id").cast("double").alias("x"))
    parts = preprocess_data(
        df, "y", {"row_threshold": 1.0, "column_threshold": 1.0}, transformation_categorical="encode", transformation_numerical="normalize", seed=1
    )
    train, test = parts
    assert parts.left_out == ["s", "c"] and train.count() + test.count() == 60


def test_conversion_keeps_texts(spark):
    rows = [(1, 'a\r\n"b"'), (2, ""), (3, None), (4, " \\ ,"), (5, "é\n")]
    df = spark.createDataFrame(rows, "k int, s string")
    source, target = scratch.scratch_path(spark, "t") + ".parquet", scratch.scratch_path(spark, "t") + ".csv"
    df.write.parquet(source)
    assert sorted(map(tuple, convert_table(source, target, spark, schema=df.schema).collect())) == rows
    taken = scratch.scratch_path(spark, "t") + ".parquet"
    spark.createDataFrame([(1, "\\N")], "k int, s string").write.parquet(taken)
    with pytest.raises(Exception):
        convert_table(taken, scratch.scratch_path(spark, "t") + ".csv", spark, schema=df.schema)


def test_scope_deletes_what_was_written(spark):
    with scratch.scope(spark):
        df = scratch.materialize(spark.range(5), "five")
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and df.count() == 5
    assert not os.path.exists(path)


class Elsewhere:
    """As much of a session on a cluster as the choice of the scratch folder asks for."""

    def __init__(self, master, **conf):
        self.sparkContext, self._conf = self, conf
        self.master, self.conf = master, self

    def get(self, name, default=None):
        return self._conf.get(name.replace(".", "_"), default)

    def getCheckpointDir(self):
        return None


def test_scratch_is_never_local_on_a_cluster():
    local = {"spark_sql_warehouse_dir": "file:/home/x/spark-warehouse"}
    assert scratch.scratch_root(Elsewhere("local[8]", **local)) == "file:/home/x/spark-warehouse"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            scratch.scratch_root(Elsewhere(master, **local))
        assert scratch.scratch_root(Elsewhere(master, spark_checkpoint_dir="s3a://b/c/", **local)) == "s3a://b/c"
        assert scratch.scratch_root(Elsewhere(master, spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w"
