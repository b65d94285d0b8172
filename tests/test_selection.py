"""Order statistics, ranks, vector indexes and grids: few passes, bounded buffers, exact results."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.functions import keytable, ordering, scratch
from retentia.functions.ordering import discrete_rank, exact_quantiles
from retentia.operators import correlate, encode, missing, models, profile


class Reads:
    """How many of the executed plans scan a table written at ``path``."""

    def __init__(self, monkeypatch, path):
        self.count, self.plans = 0, []
        first, write = type(path).first, scratch.materialize

        def seen(df):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            self.plans.append(df._jdf.queryExecution().executedPlan().toString())
            self.count += any(file in str(df.inputFiles()) for file in path.inputFiles()) and "Relation" in plan

        monkeypatch.setattr(type(path), "first", lambda df: (seen(df), first(df))[1])
        monkeypatch.setattr(ordering, "materialize", lambda df, name="table", partition_by=(): (seen(df), write(df, name, partition_by))[1])


@pytest.mark.parametrize("small", [0, 50_000])
def test_quantiles_read_the_table_twice(spark, monkeypatch, small):
    df = scratch.materialize(spark.range(40_000).select((F.rand(1) * 1e6).alias("x"), (F.col("id") % 3).alias("y"), F.when(F.col("id") % 2 == 0, F.rand(2)).alias("z")), "source")
    values = {name: sorted(r[0] for r in df.select(name).collect() if r[0] is not None) for name in df.columns}
    shares = {name: [0.1, 0.25, 0.5, 0.75, 0.9] for name in df.columns}
    reads = Reads(monkeypatch, df)
    found, _ = exact_quantiles(df, shares, small=small)
    assert reads.count == 2
    assert all(found[name, share] == [values[name][discrete_rank(share, len(values[name]))[0]]] for name in df.columns for share in shares[name])


def test_a_missed_rank_is_found_in_another_pass(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("x"), F.lit(math.nan).alias("n"))
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda c, ends, accuracy: F.array(*[F.any_value(F.lit(at % 2)) for at in range(len(ends))]))
    found, _ = exact_quantiles(df.select("x"), {"x": [0.0, 0.5, 1.0]})
    assert found == {("x", 0.0): [0], ("x", 0.5): [499], ("x", 1.0): [999]}


def test_intervals_are_merged():
    nan = math.nan
    assert ordering._merged([(3, 4), (1, 2), (2, 2), (4, 9)]) == [(1, 2), (3, 9)]
    assert ordering._merged([(5, None), (None, 1), (0, 0), (7, 8)]) == [(None, 1), (5, None)]
    assert str(ordering._merged([(1.0, nan), (nan, nan), (0.0, 0.5)])) == str([(0.0, 0.5), (1.0, nan)])


def test_median_by_name_spills(spark, monkeypatch):
    """All values distinct: no aggregate keeps them in one buffer."""
    df = scratch.materialize(spark.range(30_001).select((F.xxhash64("id") % 1_000_000_007).alias("x"), (F.col("id") * 0.5).alias("d"), F.col("id").cast("decimal(12,2)").alias("m")), "source")
    reads = Reads(monkeypatch, df)
    found = profile.aggregate_by_name(df, {"x": "median", "d": "sum", "m": "median"})
    plans = " ".join(reads.plans).replace("percentile_approx", "").lower()
    assert reads.count == 2 and plans and "median" not in plans and "percentile(" not in plans
    assert found.dtypes == [("median_x", "double"), ("sum_d", "double"), ("median_m", "double")]
    values = sorted(r[0] for r in df.select("x").collect())
    assert tuple(found.first()) == (float(values[15_000]), 15_000 * 30_001 * 0.5, 15_000.0)
    assert profile.aggregate_by_name(df.limit(0), {"x": "median", "m": "count"}).first()[:] == (None, 0)


def test_median_fills(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "k int, x double")
    assert sorted(map(tuple, missing.clean_nulls(df, 1.0, 1.0, {"x": "median"}).collect())) == [(1, 1.0), (2, 2.5), (3, 4.0)]


def spearman(rows):
    """Matrix by ranks with ties sharing their mean."""
    ranks = []
    for column in np.array(rows).T:
        ordered = np.sort(column)
        ranks.append((np.searchsorted(ordered, column) + np.searchsorted(ordered, column, side="right") + 1) / 2)
    return np.corrcoef(ranks)


@pytest.mark.parametrize("room", [0, 60, 50_000])
def test_spearman_of_few_and_many_values(spark, room):
    draw = random.Random(room)
    rows = [(7.0 if draw.random() < 0.4 else draw.random(), float(draw.randint(0, 3)), draw.gauss(0, 1), -0.0 if draw.random() < 0.3 else draw.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    ranked = correlate.average_ranks(df, df.columns, broadcast_values=room)
    found = np.array(correlate._moments(ranked, df.columns))
    assert np.allclose(found, spearman(rows))


def test_spearman_of_200_columns(spark):
    draw = np.random.default_rng(5)
    rows = (draw.standard_normal((60, 200)).cumsum(axis=1) * 3).round().tolist()
    names = [f"c{at}" for at in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in names))
    found = {(r.row_name, r.col_name): r.correlation for r in correlate.correlation_matrix(df, names, "spearman").collect()}
    want = spearman(rows)
    assert all(found[a, b] == pytest.approx(want[i][j]) for i, a in enumerate(names) for j, b in enumerate(names))


def test_vector_index_equals_sparks(spark):
    rows = [(float(n % 3), float(n % 9), float(n) if n % 4 else 0.0, float(n % 2), -1.0 if n % 5 == 0 else 2.5) for n in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    hot = OneHotEncoder(inputCols=["a", "d"], outputCols=["ah", "dh"]).fit(df).transform(df)
    both = VectorAssembler(inputCols=["a", "b", "c", "d", "e"], outputCol="v").transform(hot)
    both = VectorAssembler(inputCols=["ah", "c", "dh", "b"], outputCol="w").transform(both)
    ours, _ = encode.vector_index_columns(both, [("v", "vi"), ("w", "wi")], 5)
    for name, out in (("v", "vi"), ("w", "wi")):
        theirs = VectorIndexer(inputCol=name, outputCol=out, maxCategories=5).fit(both).transform(both)
        as_rows = lambda x: sorted(map(tuple, x.select(*[vector_to_array(out)[at] for at in range(5)]).collect()))  # noqa: B023, E731
        assert as_rows(ours) == as_rows(theirs)
        assert ours.schema[out].metadata == theirs.schema[out].metadata


def test_one_hot_slots_are_not_looked_at(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 250 + F.when(F.col("id") == 7, 50_000).otherwise(0)).cast("double").alias("k"), (F.col("id") % 3).cast("double").alias("x"))
    hot = OneHotEncoder(inputCol="k", outputCol="h").fit(df).transform(df)
    df = VectorAssembler(inputCols=["h", "x"], outputCol="v").transform(hot)
    widths = []
    fit = VectorIndexer.fit
    monkeypatch.setattr(VectorIndexer, "fit", lambda self, some: (widths.append(some.first()[0].size), fit(self, some))[1])
    out, model = encode.vector_index_column(df, "v", "i", 5)
    assert widths == [1] and model.numFeatures == 50_008
    assert [(r.i.size, r.i[50_007]) for r in out.select("i").limit(2).collect()] == [(50_008, 0.0), (50_008, 1.0)]


def labelled(spark, n=240):
    rows = [(k, float(k % 2), float(k % 2) + (k % 7) / 100, float(k % 3), float((k * 37) % 11)) for k in range(n)]
    df = spark.createDataFrame(rows, "k long, y double, a double, b double, c double")
    noisy = F.when(F.col("k") % 9 == 0, 1 - F.col("y")).otherwise(F.col("y"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df.withColumn("y", noisy))


def test_grid_points_share_fits(spark, monkeypatch):
    df, fits = labelled(spark), []
    build = models.build_classifier
    monkeypatch.setattr(models, "build_classifier", lambda *args, **params: (fits.append(params), build(*args, **params))[1])
    grid = {"numTrees": [1, 3, 5], "maxDepth": [1, 3], "featureSubsetStrategy": ["auto", "sqrt", "all"]}
    found = models.search_grid(df, "y", "f", None, "RandomForestClassifier", key="k", grid=grid, folds=2)
    # One fit for sqrt and one for all (of several trees; one tree's "auto" is "all"), per depth and fold, and the last one on all rows.
    assert len(fits) == 2 * 2 * 2 + 1
    assert all(params["numTrees"] == 5 for params in fits[:-1])
    scores = found.scores.collect()
    assert found.scores.columns == ["numTrees", "maxDepth", "featureSubsetStrategy", "fold", "rows", "weightedRecall"] and len(scores) == 18 * 2
    assert sum(r["rows"] for r in scores) == 18 * 240
    means = {}
    for r in scores:
        means.setdefault(tuple(r)[:3], []).append(r["weightedRecall"])
    best = max(means, key=lambda point: sum(means[point]))
    chosen = {r["parameter"]: r["value"] for r in models.best_point(found.scores).collect()}
    assert chosen == {name: str(value) for name, value in found.best.items()}
    assert sum(means[best]) == pytest.approx(sum(means[tuple(found.best.values())]))
    assert found.model.getNumTrees == found.best["numTrees"]


@pytest.mark.parametrize("model, stages", [("RandomForestClassifier", "numTrees"), ("GBTClassifier", "maxIter")])
def test_depths_that_are_not_reached_share_a_fit(spark, monkeypatch, model, stages):
    df = labelled(spark).withColumn("y", (F.col("a") >= 0.5).cast("double"))
    grid = {"maxDepth": [3, 4, 9], "maxBins": [8, 32]}
    fits, build = [], models.build_classifier
    monkeypatch.setattr(models, "build_classifier", lambda *args, **params: (fits.append(params), build(*args, **params))[1])
    found = models.search_grid(df, "y", "f", None, model, key="k", grid=grid, folds=2, **{stages: 3})
    assert len(fits) == 2 * 2 + 1 and {params["maxDepth"] for params in fits[:-1]} == {9}
    folds = models.with_folds(df, 2, models.SEED, "k").filter("__fold <> 0")
    shown = {depth: [t.toDebugString for t in build(model, "y", "f", maxDepth=depth, maxBins=8, **{stages: 3}).fit(folds).trees] for depth in (3, 9)}
    plain = lambda trees: [text.split("\n", 1)[1] for text in trees]
    assert plain(shown[3]) == plain(shown[9]) and found.scores.count() == 12


def test_features_per_node(spark):
    df = labelled(spark)
    for strategy in ("auto", "sqrt", "log2", "onethird", "all"):
        for trees in (1, 4):
            expected = {"auto": 3 if trees == 1 else 2, "sqrt": 2, "log2": 2, "onethird": 1, "all": 3}[strategy]
            assert models.features_per_node(strategy, 3, trees) == expected
    one, two = (models.build_classifier("RandomForestClassifier", "y", "f", numTrees=4, featureSubsetStrategy=s).fit(df) for s in ("sqrt", "log2"))
    assert [t.toDebugString.split("\n", 1)[1] for t in one.trees] == [t.toDebugString.split("\n", 1)[1] for t in two.trees]
    assert models.features_per_node("0.5", 3, 4) == "0.5"


def test_prefix_of_boosting_is_a_fit_of_its_own(spark):
    df = labelled(spark)
    large, small = (models.build_classifier("GBTClassifier", "y", "f", maxIter=n, maxDepth=2).fit(df) for n in (6, 2))
    prefix = models._prefix(large, 2)
    assert prefix.getNumTrees == 2 and prefix.treeWeights == small.treeWeights
    scored = [m.transform(df).orderBy("k").select("k", "rawPrediction", "prediction").collect() for m in (prefix, small)]
    assert scored[0] == scored[1]
    forest = models.build_classifier("RandomForestClassifier", "y", "f", numTrees=7, maxDepth=3).fit(df)
    part = models._prefix(forest, 3)
    assert part.getNumTrees == 3 and part.transform(df).count() == 240
    assert [tree.toDebugString for tree in part.trees] == [tree.toDebugString for tree in forest.trees[:3]]


def test_search_agrees_with_separate_fits(spark):
    """On a grid without prefixes, the scores are those of cross-validation."""
    df = labelled(spark)
    grid = {"maxDepth": [1, 2], "maxIter": [1, 2]}
    found = models.search_grid(df, "y", "f", None, "GBTClassifier", key="k", grid=grid, folds=2, metric="f1")
    folds = models.with_folds(df, 2, models.SEED, "k")
    evaluator = MulticlassClassificationEvaluator(labelCol="y", metricName="f1")
    for row in found.scores.collect():
        fitted = models.build_classifier("GBTClassifier", "y", "f", maxDepth=row["maxDepth"], maxIter=row["maxIter"]).fit(folds.filter(F.col("__fold") != row["fold"]))
        held = folds.filter(F.col("__fold") == row["fold"])
        assert row["rows"] == held.count() and row["f1"] == pytest.approx(evaluator.evaluate(fitted.transform(held)))


@pytest.mark.parametrize("metric", list(models.METRICS))
def test_metrics_are_sparks(spark, metric):
    draw = random.Random(3)
    rows = [(float(draw.randint(0, 3)), float(draw.randint(0, 4))) for _ in range(300)]
    counts = {pair: rows.count(pair) for pair in set(rows)}
    df = spark.createDataFrame(rows, "label double, prediction double")
    assert models.METRICS[metric](counts) == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_boosting_stops_early(spark):
    df = labelled(spark)
    found = models.search_grid(df, "y", "f", None, "GBTClassifier", key="k", grid={"maxDepth": [2]}, folds=2, validation_share=0.3)
    assert 1 <= found.model.getNumTrees < 20
    with pytest.raises(ValueError):
        models.search_grid(df, "y", "f", None, "GBTClassifier", grid={"maxIter": [2]}, validation_share=0.3)
    with pytest.raises(ValueError):
        models.search_grid(df, "y", "f", None, "RandomForestClassifier", grid={"maxDepth": [2]}, metric="area")


def largest_share(df):
    """The share of the rows that the fullest partition of a shuffled result has."""
    counts = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("wide", [True, False], ids=["wide entry", "just under the hot share"])
def test_heavy_keys_are_dealt_over_copies(spark, monkeypatch, wide):
    """A third of the rows with one key that is not broadcast: eight partitions share them."""
    monkeypatch.setattr(keytable, "BROADCAST_ROWS", 4)
    if not wide:
        monkeypatch.setattr(keytable, "HOT_KEYS", 2)
    value = F.concat(F.lit("v"), F.col("k").cast("string"), F.lit("x" * (2_000 if wide else 1)))
    rows = spark.range(6_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"))
    rows = rows.unionByName(spark.range(6_000, 6_010).select("id", F.lit(None).cast("long").alias("k")))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = keytable.KeyTable(rows.groupBy("k").agg(F.count(F.lit(1)).alias("count")).filter("k is null or k % 7 <> 0").withColumn("value", value), "k")
        found = table.attach(rows, F.col("k"), ["value"])
        assert largest_share(found) < 0.3
        got = {r["id"]: r["value"] for r in found.select("id", F.substring("value", 1, 4).alias("value")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {at: -1 if at % 3 == 0 else at % 500 for at in range(6_000)}
    assert got == {at: f"v{k}{'x' * (2_000 if wide else 1)}"[:4] if k % 7 else None for at, k in want.items()} | {at: None for at in range(6_000, 6_010)}
