import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia.functions import keytable
from retentia.operators import nearmiss
from retentia.operators.nearmiss import HASH_TABLES, Sizes, farthest, undersample_nearmiss_v2

TINY = Sizes(broadcast_bytes=0, pivots=4, tile_rows=8, one_task_rows=4)


def points(spark, majority, minority, width=2, seed=1, ties=False):
    draw = random.Random(seed)

    def coordinate(shift):
        return float(draw.randint(0, 3)) + shift if ties else draw.gauss(shift, 1)

    rows = [(n, [coordinate(0) for _ in range(width)], 0 if n % 3 else 2) for n in range(majority)]
    rows += [(1000 + n, [coordinate(1) for _ in range(width)], 1) for n in range(minority)]
    return rows, spark.createDataFrame(rows, "k long, f array<double>, y int").repartition(3)


def brute(rows, k, minority):
    others = np.array([f for _, f, y in rows if y == minority])
    scored = []
    for key, f, y in rows:
        if y != minority:
            distances = np.sort(np.sqrt(((others - np.array(f)) ** 2).sum(axis=1)))[::-1][:k]
            scored.append((round(distances.mean(), 9), key))
    chosen = {key for _, key in sorted(scored)[: len(others)]}
    return chosen | {key for key, _, y in rows if y == minority}


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(one_task_rows=4), TINY], ids=["one pass", "many kept", "tiled"])
@pytest.mark.parametrize("k, width", [(1, 2), (5, 8)])
def test_exact(spark, sizes, k, width):
    rows, df = points(spark, 90, 25, width)
    kept = undersample_nearmiss_v2(df, "f", "y", k, key="k", sizes=sizes)
    assert kept.columns == ["k", "f", "y"]
    assert {row.k for row in kept.collect()} == brute(rows, k, 1) and kept.count() == 50


def test_ties_and_k_beyond_the_minority(spark):
    rows, df = points(spark, 60, 9, ties=True)
    for sizes in (Sizes(), TINY):
        kept = undersample_nearmiss_v2(df, "f", "y", 20, key="k", sizes=sizes)
        assert {row.k for row in kept.collect()} == brute(rows, 20, 1)


def test_one_point_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(keytable, "BROADCAST_ROWS", 4)
    rows, _ = points(spark, 90, 12, 3)
    rows = [(key, [0.5, 0.5, 0.5] if y != 1 and key % 3 == 0 else f, y) for key, f, y in rows]
    df = spark.createDataFrame(rows, "k long, f array<double>, y int")
    kept = undersample_nearmiss_v2(df, "f", "y", 4, key="k", sizes=TINY)
    assert {row.k for row in kept.collect()} == brute(rows, 4, 1)


def test_vectors_without_key(spark):
    rows, df = points(spark, 40, 8)
    vectors = df.select(array_to_vector("f").alias("features"), "y")
    kept = undersample_nearmiss_v2(vectors, "features", "y", 3)
    assert kept.columns == ["features", "y"] and kept.count() == 16
    wanted = sorted(f for k, f, _ in rows if k in brute(rows, 3, 1))
    assert sorted(row[0] for row in kept.select(vector_to_array("features")).collect()) == wanted


def test_single_class_and_bad_k(spark):
    _, df = points(spark, 0, 5)
    assert undersample_nearmiss_v2(df, "f", "y", 3, key="k").count() == 5
    with pytest.raises(ValueError):
        undersample_nearmiss_v2(df, "f", "y", 0, key="k")


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(tile_rows=2, one_task_rows=4)])
def test_approximate_equals_bucket_join(spark, sizes):
    rows, df = points(spark, 60, 12)
    kept = {row.k for row in undersample_nearmiss_v2(df, "f", "y", 2, key="k", approx=True, seed=3, sizes=sizes).collect()}
    vectors = df.withColumn("v", array_to_vector("f"))
    majority, minority = vectors.filter("y <> 1"), vectors.filter("y = 1")
    model = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=60 ** (-1 / 2), numHashTables=HASH_TABLES, seed=3
    ).fit(majority)
    pairs = model.approxSimilarityJoin(majority, minority, float("inf"), "d").select(F.col("datasetA.k").alias("k"), "d")
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("d")))).filter("r <= 2")
    wanted = ranked.groupBy("k").agg(F.avg("d").alias("d")).orderBy("d", "k").limit(12)
    assert kept == {row.k for row in wanted.collect()} | {row.k for row in minority.collect()}


def test_farthest_far_from_the_origin():
    draw = np.random.default_rng(2)
    left, right = draw.normal(size=(40, 6)) + 1e6, draw.normal(size=(70, 6)) + 1e6
    distances, positions = farthest(left - 1e6, right - 1e6, 4)
    exact = np.sqrt(((left[:, None, :] - right[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(distances, -np.sort(-exact, axis=1)[:, :4])
    assert np.allclose(np.take_along_axis(exact, positions, axis=1), distances)


def test_kernels_travel_without_the_package(tmp_path):
    code = "import pickle, sys, numpy as np; f = pickle.load(open(sys.argv[1], 'rb')); print(f(np.zeros((1, 2)), np.ones((3, 2)), 2)[0].shape)"
    (tmp_path / "kernel").write_bytes(cloudpickle.dumps(farthest))
    done = subprocess.run([sys.executable, "-c", code, "kernel"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": ""})
    assert done.stdout.strip() == "(1, 2)", done.stderr


def clusters(spark, width, seed=3):
    """A minority of eight far clusters, and a majority around one of them."""
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(8, width)) * 40
    rows = [(n, (middles[0] + draw.normal(size=width)).tolist(), 0) for n in range(400)]
    rows += [(1000 + n, (middles[n % 8] + draw.normal(size=width)).tolist(), 1) for n in range(320)]
    return rows, spark.createDataFrame(rows, "k long, f array<double>, y int").repartition(4)


def test_pivots_rule_out_most_tiles(spark, monkeypatch):
    rows, df = clusters(spark, 16)
    bounds, made = [], nearmiss._minority_blocks
    monkeypatch.setattr(nearmiss, "_minority_blocks", lambda *args: (bounds.append(made(*args)), bounds[-1])[1])
    sizes = Sizes(broadcast_bytes=0, pivots=32, tile_rows=20, one_task_rows=8)
    kept = undersample_nearmiss_v2(df, "f", "y", 3, key="k", sizes=sizes)
    assert {row.k for row in kept.collect()} == brute(rows, 3, 1)
    held = bounds[0][1]
    points = np.array([f for _, f, y in rows if y == 0])
    others = np.array([f for _, f, y in rows if y == 1])
    distances = np.sqrt(((points[:, None, :] - others[None, :, :]) ** 2).sum(axis=2))
    floors = np.sort(distances, axis=1)[:, -3]
    _, reached = nearmiss.reachable(points, floors, held.pivots, held.far)
    _, by_centre = nearmiss.reachable(points, floors, held.pivots[:1], held.far[:, :1])
    assert held.count == 16 and reached.mean() < min(0.5, by_centre.mean())
    # No tile that holds one of the k farthest is ruled out, even at the exact floor.
    by_block = {row[0]: row[1] for row in bounds[0][0].groupBy("block").agg(F.collect_list("__point")).collect()}
    for block, members in by_block.items():
        gap = np.sqrt(((points[:, None, :] - np.array(members)[None, :, :]) ** 2).sum(axis=2)).max(axis=1)
        assert reached[:, block // held.step][gap >= floors].all()


def test_spread_points():
    sample = np.array([[0.0, 0.0], [0.0, 0.0], [10.0, 0.0], [0.0, 7.0]])
    assert nearmiss.spread_points(sample, np.array([0.0, 0.0]), 9).tolist() == [[0, 0], [10, 0], [0, 7]]
    assert len(nearmiss.spread_points(sample, np.array([1.0, 1.0]), 2)) == 2


def test_small_blocks_travel_in_few_tiles(spark, monkeypatch):
    rows, df = clusters(spark, 16)
    made, tiles = [], nearmiss._tiles
    monkeypatch.setattr(nearmiss, "_tiles", lambda left, right, *args: (made.append((left, right)), tiles(left, right, *args))[1])
    # Blocks of 4 rows; a stretch holds 24.
    sizes = Sizes(broadcast_bytes=0, pivots=32, tile_rows=4, tile_bytes=24 * 8 * 16, one_task_rows=8)
    kept = undersample_nearmiss_v2(df, "f", "y", 3, key="k", sizes=sizes)
    assert {row.k for row in kept.collect()} == brute(rows, 3, 1)
    left, right = made[0]
    # A row is copied once per stretch at most, not once per each of the 80 blocks.
    assert right.agg(F.countDistinct("block"), F.countDistinct("cell")).first()[:] == (80, 14)
    assert max(row["count"] for row in left.groupBy("__id").count().collect()) <= 14


def test_kernel_holds_few_products_at_a_time():
    draw = np.random.default_rng(4)
    left, right = draw.normal(size=(600, 8)), draw.normal(size=(16_384, 8))
    tracemalloc.start()
    try:
        farthest(left, right, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
