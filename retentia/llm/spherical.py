"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors that are equal count as one point. Points are compared within the cell of their
nearest centre. For pairs that a cell border separates, a point also visits cells of
higher number that may hold one of its neighbours: if x has centre a, y has centre b and their
cosine is at least t, then |x - y| <= sqrt(2 - 2t), and since y is nearer to b than to a,
x (a - b) <= |x - y| |a - b|. So every link is found, whatever the cells are; the
sample they are fitted on decides only the cost.

Cells of any size are cut into tiles of bounded blocks. A tile multiplies its blocks,
counts each point's links, and returns per point its count and one point of the same
component: pairs never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize
from retentia.llm.components import Links, components
from retentia.llm.vectors import DIGEST, GROUP, KEY, VECTOR, byte_type, prepare, sample_vectors, spherical_kmeans, stack

CELL_POINTS = 1 << 12
BLOCK_POINTS = 1 << 12
STEP = 1 << 10
SLACK = 1e-9
GAP_SLACK = 1e-6


def centre_gaps(centres: np.ndarray) -> np.ndarray:
    """Distances between all centres, by their products; at least the true ones, as a visit too many does no harm."""
    squares = (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(0.0, squares[:, None] + squares - 2 * (centres @ centres.T))) + GAP_SLACK


def _place(points: DataFrame, centres: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """Points in the cells where they are at home or visit."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    gaps = centre_gaps(centres) if len(centres) <= 1 << 11 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                some = batch.slice(start, STEP)
                units = stack(some.column(VECTOR), kind)
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                cosines = units @ centres.T
                home = cosines.argmax(axis=1)
                between = gaps[home] if gaps is not None else np.stack([np.linalg.norm(centres - centres[h], axis=1) for h in home])
                lead = cosines[np.arange(len(home)), home][:, None] - cosines
                visits = (lead <= reach * between + SLACK) & (np.arange(len(centres)) > home[:, None])
                row, cell = np.nonzero(visits)
                rows = np.concatenate([np.arange(len(home)), row])
                taken = some.take(pa.array(rows))
                columns = [*taken.columns, pa.array(np.concatenate([home, cell])), pa.array(np.arange(len(rows)) < len(home))]
                yield pa.record_batch(columns, [*taken.schema.names, "cell", "home"])

    schema = f"`{DIGEST}` string, `{GROUP}` string, `{VECTOR}` binary, point long, copies long, cell long, home boolean"
    return points.select(DIGEST, GROUP, VECTOR, "point", "copies").mapInArrow(run, schema)


def _tiles(placed: DataFrame, block: int) -> DataFrame:
    """Rows copied to the tiles (left block, right block) of their cell that they belong to."""
    cell = F.struct(F.col(GROUP), F.col("cell"))
    sizes = placed.groupBy(cell.alias("at")).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"), F.count(F.lit(1)).alias("count"))
    wide = KeyTable(sizes, "at").attach(placed, cell, ["homes", "guests"])
    blocks = lambda n: F.ceil(F.col(n) / block).cast("long")
    mine = F.pmod(F.xxhash64("point"), F.greatest(F.when(F.col("home"), blocks("homes")).otherwise(blocks("guests")), F.lit(1).cast("long")))
    tile = lambda left, right, inner: F.struct(left.alias("left"), right.alias("right"), F.lit(inner).alias("inner"))
    numbers = lambda n: F.when(blocks(n) > 0, F.sequence(F.lit(0).cast("long"), blocks(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    inner = F.transform(numbers("homes"), lambda j: tile(F.least(F.col("mine"), j), F.greatest(F.col("mine"), j), True))
    outer = F.transform(numbers("guests"), lambda j: tile(F.col("mine"), j, False))
    visits = F.transform(numbers("homes"), lambda i: tile(i, F.col("mine"), False))
    tiles = F.when(F.col("home"), F.concat(inner, outer)).otherwise(visits)
    dealt = wide.withColumn("mine", mine).withColumn("tile", F.explode(tiles))
    return dealt.select(GROUP, "cell", "tile", "mine", "home", "point", "copies", VECTOR)


def tile_links(tiles: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Per tile and point with links there: ``point``, ``links`` (rows linked) and ``root``, a point of the same component."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile = key[2].as_py()
        units = stack(table.column(VECTOR), kind)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        points, copies = table.column("point").to_numpy(), table.column("copies").to_numpy()
        home, mine = np.asarray(table.column("home")), table.column("mine").to_numpy()
        same = tile["inner"] and tile["left"] == tile["right"]
        left = np.flatnonzero(home & (mine == tile["left"]))
        right = left if same else np.flatnonzero((mine == tile["right"]) & (home == tile["inner"]))
        counts, links = np.zeros(len(points), np.int64), Links(len(points))
        for i in range(0, len(left), STEP):
            for j in range(i if same else 0, len(right), STEP):
                rows, columns = left[i : i + STEP], right[j : j + STEP]
                near = units[rows] @ units[columns].T >= threshold
                if same and i == j:
                    np.fill_diagonal(near, False)
                if near.any():
                    counts[rows] += near @ copies[columns]
                    if not (same and i == j):
                        counts[columns] += copies[rows] @ near
                    a, b = np.nonzero(near)
                    links.add(rows[a], columns[b])
        label, found = links.settle(), np.flatnonzero(counts)
        return pa.table({"point": points[found], "links": counts[found], "root": points[label[found]]})

    return tiles.groupBy(GROUP, "cell", "tile").applyInArrow(run, "point long, links long, root long")


def near_duplicates(
    df: DataFrame, key: str, vector: str, group: str, threshold: float = 0.98, cell_points: int = CELL_POINTS, block: int = BLOCK_POINTS
) -> DataFrame:
    """Links among vectors of one group with a cosine of at least ``threshold`` (above 0), in double precision.

    Returns one row per input row: the key under its name, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest key that links reach, its own included) and ``kept``
    (whether that is its own key). Rows whose vector or group is null, or whose vector is zero or
    holds null or non-finite components, link with nothing. Repeated rows are linked like
    any others and all bear the same key. Other columns are not carried.
    """
    rows, width = prepare(df, key, vector, group)
    kind = byte_type(df, vector)
    merged = rows.filter(F.col(DIGEST).isNotNull()).groupBy(DIGEST).agg(
        F.first(GROUP).alias(GROUP), F.first(VECTOR).alias(VECTOR), F.min(KEY).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    points = materialize(merged.withColumn("point", F.monotonically_increasing_id()), "points")
    n = points.count()
    centres = spherical_kmeans(sample_vectors(points, kind, width), math.ceil(n / cell_points)) if n else np.zeros((1, max(1, width)))
    placed = materialize(_place(points, centres, threshold, kind), "placed")
    found = materialize(tile_links(_tiles(placed, block), threshold, kind), "tile-links")
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    linked = materialize(components(found.select(F.col("point").alias("a"), F.col("root").alias("b"))), "components")
    names = linked.join(points.select("point", "first"), linked["node"] == F.col("point")).groupBy("component").agg(F.min("first").alias("name"))
    named = linked.join(names, "component").select("node", "name")
    joined = points.select("point", DIGEST, "first", "copies").join(counts, "point", "left").join(named, F.col("point") == named["node"], "left")
    wanted = joined.filter("copies > 1 or links > 0").select(
        F.col(DIGEST), F.col("copies").alias("count"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "first").alias("name")
    )
    table = KeyTable(materialize(wanted, "named"), DIGEST, stored=True)
    result = table.attach(rows.select(KEY, DIGEST), F.col(DIGEST), ["n_links", "name"])
    component = F.coalesce("name", KEY)
    return result.select(
        F.col(KEY).alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(KEY)).alias("kept")
    )
