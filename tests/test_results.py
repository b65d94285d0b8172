"""Evaluation, correlation, recommendations, models and storage."""

import math
import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions import keytable, scratch
from retentia.operators import correlate, encode, evaluate, models, recommend
from retentia.sources import tables


def test_metrics_equal_the_built_in_ones(spark):
    draw = random.Random(4)
    rows = [(float(draw.randint(0, 3)), float(draw.choice([0, 0, 1, 2, 5]))) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, prediction double")
    ours = evaluate.performance_evaluation(df, "y").first()
    for name, metric in [("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"), ("f1", "f1")]:
        theirs = MulticlassClassificationEvaluator(labelCol="y", metricName=metric).evaluate(df)
        assert ours[name] == pytest.approx(theirs, abs=1e-12)
    assert ours.test_error == pytest.approx(1 - ours.accuracy)


def test_metrics_without_labels(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 1.0)], "y double, prediction double")
    assert evaluate.confusion_matrix(df, "y", "prediction").count() == 2
    assert evaluate.performance_evaluation(df, "y").first().accuracy == 1.0
    assert evaluate.performance_evaluation(df.filter("y > 5"), "y").first().accuracy is None


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("many", [False, True])
def test_correlation(spark, method, many, monkeypatch):
    if many:
        monkeypatch.setattr(correlate, "MOMENT_COLUMNS", 1)
        monkeypatch.setattr(keytable, "BROADCAST_ROWS", 5)
        monkeypatch.setattr(keytable, "HOT_KEYS", 5)
    draw = random.Random(6)
    rows = [(draw.gauss(0, 1), float(draw.choice([1, 1, 1, 2, 3])), float(n)) for n in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    ours = {(r.row_name, r.col_name): r.correlation for r in correlate.correlation_matrix(df, ["a", "b", "c"], method).collect()}
    vector = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    theirs = Correlation.corr(vector, "v", method).head()[0].toArray()
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            assert ours[a, b] == pytest.approx(theirs[i, j], abs=1e-9)


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "a double, c double")
    rows = {(r.row_name, r.col_name): r.correlation for r in correlate.correlation_matrix(df, ["a", "c"]).collect()}
    assert rows["a", "a"] == 1.0 and math.isnan(rows["a", "c"])
    with pytest.raises(ValueError):
        correlate.correlation_matrix(df, ["a"], "kendall")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(
        [
            ("u", [("b", 2.0), ("a", 2.0), ("c", 3.0)]),
            ("v", [("x", 1.0)]),
            ("v", [("y", 5.0), ("x", 1.0)]),
            ("w", None),
            ("e", []),
        ],
        "user string, recommendations array<struct<item:string,score:double>>",
    )


def test_top_by_row(users):
    rows = [(row.user, row.top_recommendations) for row in recommend.get_top_recommendations(users, 2).collect()]
    assert rows == [("u", ["c", "b"]), ("v", ["x"]), ("v", ["y", "x"]), ("w", []), ("e", [])]


def test_top_by_user(users):
    table = {row.user: row.top_recommendations for row in recommend.top_recommendations_by_user(users, "user", 2).collect()}
    assert table == {"u": ["c", "b"], "v": ["y", "x"], "w": [], "e": []}
    one = recommend.get_user_top_recommendations(users, "v", "user", 3)
    assert [tuple(row) for row in one.collect()] == [("v", ["y", "x", "x"])]
    assert recommend.get_user_top_recommendations(users, "nobody", "user", 3).count() == 0


def test_wide_top(users, monkeypatch):
    narrow = sorted(map(tuple, recommend.top_recommendations_by_user(users, "user", 2).collect()))
    monkeypatch.setattr(recommend, "GROUP_LIMIT", 1)
    assert sorted(map(tuple, recommend.top_recommendations_by_user(users, "user", 2).collect())) == narrow


def test_groups_are_cut_before_the_shuffle(spark):
    rows = spark.range(10).select((F.col("id") % 3).alias("id"), F.array(F.struct(F.lit("a").alias("item"), F.lit(1.0).alias("score"))).alias("recommendations"))
    plan = recommend.top_recommendations_by_user(rows, "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_items_by_index(spark):
    df = spark.createDataFrame(
        [("u", [(1, 0.5), (0, 0.25), (1, 0.5)]), ("u", [(1, 0.5), (0, 0.25), (1, 0.5)]), ("v", []), ("w", None)],
        "user string, recommendations array<struct<index:int,score:float>>",
    )
    catalogue = recommend.catalogue_of(["p", "q"], df)
    named = recommend.revert_item_index_in_recommendations(df, catalogue)
    assert named.schema["recommendations"].dataType.simpleString() == "array<struct<asin:string,score:float>>"
    rows = sorted((row.user, row.recommendations and [tuple(rec) for rec in row.recommendations]) for row in named.filter("user <> 'w'").collect())
    assert rows == [("u", [("q", 0.5), ("p", 0.25), ("q", 0.5)])] * 2 + [("v", [])]
    assert named.filter("user = 'w'").first().recommendations is None
    with pytest.raises(Exception, match="no item for index 1"):
        recommend.revert_item_index_in_recommendations(df, catalogue.filter("item_index = 0")).collect()


def test_grids():
    forest = models.build_classifier("RandomForestClassifier", "y", "f", "w")
    boosting = models.build_classifier("GBTClassifier", "y", "f", "w")
    assert len(models.parameter_grid(forest)) == 81 and len(models.parameter_grid(boosting)) == 18
    assert forest.getWeightCol() == boosting.getWeightCol() == "w" and forest.getSeed() == 42
    with pytest.raises(ValueError):
        models.build_classifier("SVM", "y", "f")
    validator = models.build_classification_model("y", "f", None, "RandomForestClassifier")
    assert validator.getNumFolds() == 5 and validator.getEvaluator().getMetricName() == "weightedRecall"


def test_model_round_trip_and_importances(spark):
    rows = [(n, float(n % 2), float(n % 2) + (n % 7) / 100, float(n % 3)) for n in range(80)]
    df = spark.createDataFrame(rows, "k long, y double, a double, b double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df)
    model = models.build_classifier("RandomForestClassifier", "y", "f", numTrees=3).fit(df)
    path = scratch.scratch_path(spark, "model")
    tables.save_model(model, path)
    loaded = tables.load_model(path, spark)
    assert models.score(loaded, df, "y", ["k"]).filter("y <> prediction").count() == 0
    table = evaluate.feature_importances(loaded, df, "f")
    assert [row.feature for row in table.collect()] == ["a", "b"]
    assert evaluate.importance_total(table).first()[0] == pytest.approx(1.0)
    assert [row.feature for row in evaluate.select_importances(table, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        evaluate.feature_importances(loaded, df, "f", {"a": 1})
    assert models.best_parameters(loaded, ["maxDepth"], spark).first().value == "5"


def test_bins_must_hold_the_categories(spark):
    rows = [(float(n % 2), float(n % 40), float(n)) for n in range(400)]
    df = spark.createDataFrame(rows, "y double, c double, x double")
    vector = VectorAssembler(inputCols=["c", "x"], outputCol="v").transform(df)
    indexed, _ = encode.vector_index_column(vector, "v", "f", 50)
    assert models.category_counts(indexed, "f") == {"c": 40}
    options = {"grid": {"maxBins": [32, 64], "maxDepth": [2]}}
    with pytest.raises(ValueError, match="40 categories"):
        models.check_bins(indexed, "f", "RandomForestClassifier", options)
    grid, left_out = models.usable_grid(indexed, "f", "RandomForestClassifier", options["grid"])
    assert grid == {"maxBins": [64], "maxDepth": [2]} and left_out == [32]
    with pytest.raises(ValueError, match="40 categories"):
        models.train_classification_model(indexed, "y", "f", None, "RandomForestClassifier", grid={"maxDepth": [2]})


def test_local_tables_and_release(spark):
    empty = scratch.local_table(spark, [], "a int, b string")
    assert empty.dtypes == [("a", "int"), ("b", "string")] and empty.count() == 0
    stored = scratch.materialize(spark.range(3))
    assert stored.count() == 3
    mine = list(scratch._written)
    scratch._written[:] = mine[-1:]
    scratch.release(spark)
    scratch._written[:] = mine[:-1]
    with pytest.raises(Exception):
        spark.read.parquet(mine[-1]).count()


SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


@pytest.mark.parametrize("suffix", [".csv", ".json", ".json.gz", ".parquet"])
def test_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "x"), (2, "y;z")], SCHEMA)
    path = f"{tmp_path}/table{suffix}"
    tables.save_data(df, path)
    back = tables.load_data(path, spark, schema=SCHEMA)
    assert sorted(map(tuple, back.collect())) == [(1, "x"), (2, "y;z")]
    with pytest.raises(Exception, match="exists"):
        tables.save_data(df, path)


def test_csv_options(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;x\n")
    path = f"{tmp_path}/t.csv"
    assert tables.load_data(path, spark, delimiter=";").dtypes == [("a", "int"), ("b", "string")]
    assert tables.load_data(path, spark, delimiter=";", infer=False).dtypes == [("a", "string"), ("b", "string")]
    assert tables.load_data(path, spark, partitions=3).rdd.getNumPartitions() == 3
    converted = tables.convert_table(path, f"{tmp_path}/t.parquet", spark, schema=SCHEMA, delimiter=";")
    assert [tuple(row) for row in converted.collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        tables.load_data("table.xlsx", spark)
