"""NearMiss-2 under-sampling: keep the majority rows closest to their farthest minority rows.

A majority row's score is the mean distance to its k farthest minority rows; the
rows with the smallest scores stay, as many as the minority has. The exact answer
is found without forming pairs as rows:

* A small minority is broadcast, its size checked, and scored against in one pass.
* Otherwise a bounded set of outlying minority rows gives every majority row a
  lower bound on its score in one pass. The rows with the lowest bounds are scored
  exactly, the worst of those scores limits the rest, and only rows whose bound is
  within the limit are scored as well.
* Exact scoring compares rows with blocks of at most ``tile_rows`` minority rows. Minority
  rows are put into blocks by the nearest of a few pivots, and a row visits only the blocks that can
  hold one of its k farthest: by the triangle over each pivot, no row of a block is farther than the
  least of the sums of both distances from a pivot. Rows and blocks travel in tiles, stretches of at most ``tile_bytes``
  of each side, so that a point is copied once per stretch of the other side however small the blocks are.
  A tile returns at most k distances per row.

Distances inside a tile are one matrix product; the k kept are recomputed by
differences.
"""

from __future__ import annotations

import math
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import as_double_array, column, hashable_columns
from retentia.functions.keytable import KeyTable
from retentia.functions.ordering import ONE_TASK_ROWS, running_total, smallest_rows
from retentia.functions.scratch import materialize

# Workers get the kernels with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the approximate mode.
HASH_TABLES = 3

ROW, ID, POINT, SCORE, FLOOR, COPY = "__row", "__id", "__point", "__score", "__floor", "__copy"
SLACK = 1e-9
MARGIN = 8
BOUNDS = 1_024
PIVOTS = 32
PIVOT_SAMPLE = 2_048
MERGE_SLICES = 64
# Stretches of rows and of blocks that even a small job is cut into.
ROW_STRETCHES, BLOCK_STRETCHES = 16, 8
SLICE = 1_024
KERNEL_VALUES = 1 << 20
FEW_TILES = 50_000


@dataclass(frozen=True)
class Bounds:
    """Pivots, and for each group of ``step`` of the ``count`` minority blocks its greatest distance from each pivot."""

    pivots: np.ndarray
    far: np.ndarray
    step: int
    count: int


@dataclass(frozen=True)
class Sizes:
    """Bounds on what one task or the driver holds."""

    one_pass_rows: int = 4_096
    broadcast_bytes: int = 32 << 20
    pivots: int = 512
    tile_rows: int = 16_384
    tile_bytes: int = 16 << 20
    one_task_rows: int = ONE_TASK_ROWS

    def tile(self, width: int) -> int:
        return max(1, min(self.tile_rows, self.tile_bytes // (8 * width)))

    def stretch(self, width: int) -> int:
        return max(1, self.tile_bytes // (8 * width))


def undersample_nearmiss_v2(
    df: DataFrame,
    features_column: str,
    labels_column: str,
    k: int,
    key: str | None = None,
    approx: bool = False,
    seed: int = 0,
    sizes: Sizes = Sizes(),
    probes: int = 0,
) -> DataFrame:
    """The smallest class and equally many of the other rows, chosen by NearMiss-2.

    ``key`` names a column that breaks ties, smallest first and null before all; equal
    keys go by a hash of the row. Rows are told apart by numbers given in that order and
    written out first, so the key need not be unique. ``approx`` compares only rows that
    share a hash bucket and may return fewer rows, as some find no partner. With ``probes`` a row also meets the rows in that many
    buckets on either side of its own, in every table: more comparisons, and a choice nearer to the exact one; see ``choice_recall``.
    """
    if k < 1 or probes < 0:
        raise ValueError("k must be at least 1, probes at least 0")
    names = df.columns
    if key is not None:
        order = [column(key).asc_nulls_first(), F.xxhash64(*hashable_columns(df))]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    classes = KeyTable.of(df.filter(column(labels_column).isNotNull()), labels_column)
    if classes.rows < 2:
        return df.select(*map(column, names))
    smallest = classes.frame.orderBy(classes.count_col, column(labels_column)).first()
    is_minority = column(labels_column) == F.lit(smallest[0])
    points = df.withColumns({ID: F.col(ROW), POINT: as_double_array(df, features_column)})
    minority = points.filter(is_minority)
    majority = points.filter(~F.coalesce(is_minority, F.lit(False)))
    size = smallest[classes.count_col]
    if approx:
        scored = _shared_bucket_scores(majority, minority, classes.total - size, k, seed, sizes, probes)
        chosen = _keys_of(smallest_rows(scored, [SCORE, ID], size, sizes.one_task_rows))
        picked = _rows_of(majority, chosen, size, sizes)
    else:
        picked = _closest(majority, minority, size, classes.total - size, k, sizes)
    columns = [column(name) for name in names]
    return minority.select(*columns).unionByName(picked.select(*columns))


def choice_recall(approximate: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """The rows of an exact choice with ``chosen``: whether the approximate one has them, too; ``key`` must be unique and not null."""
    found = approximate.select(column(key)).withColumn("chosen", F.lit(True))
    return exact.join(found, key, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def _closest(majority: DataFrame, minority: DataFrame, size: int, others: int, k: int, sizes: Sizes) -> DataFrame:
    center = _center(minority)
    width = len(center)
    if size <= sizes.one_pass_rows and size * width * 8 <= sizes.broadcast_bytes:
        scores = _pivot_scores(minority, center, k)(F.col(POINT))
        if size <= sizes.one_task_rows:
            scored = majority.withColumn(SCORE, scores["mean"])
            return scored.orderBy(SCORE, ID).limit(size)
        narrow = materialize(majority.select(ID, scores["mean"].alias(SCORE)), "scores")
        worst_score, chosen = _cut(narrow, size, sizes)
        near = majority.withColumn(SCORE, scores["mean"]).filter(F.col(SCORE) <= worst_score * (1 + SLACK))
        return _rows_of(near, chosen, size, sizes)

    blocks, bounds = _minority_blocks(minority, center, sizes.tile(width), sizes)
    pivots = blocks.orderBy(F.desc("reach"), ID).limit(max(k, min(sizes.pivots, sizes.tile(width))))
    bound = _pivot_scores(pivots, center, k)(F.col(POINT))
    bounded = majority.withColumn("__bound", bound).select(
        *[column(name) for name in majority.columns],
        F.col("__bound")["mean"].alias(SCORE),
        F.col("__bound")["least"].alias(FLOOR),
    )
    likely_share = min(1.0, size / others + 2e-4)
    limit = bounded.agg(F.percentile_approx(SCORE, likely_share, 10_000)).first()[0]
    likely = materialize(bounded.filter(F.col(SCORE) <= limit * (1 + SLACK)), "likely")
    likely_scores = materialize(_tiled_scores(likely, blocks, bounds, k, width, sizes), "scores")
    # With fewer scores than wanted (the sketch promises otherwise) nothing limits the rest.
    worst = _cut(likely_scores, size, sizes)[0] if likely_scores.count() >= size else math.inf
    # Bounds may differ in the last bit between passes, so the two sets overlap a little.
    rest = materialize(
        bounded.filter((F.col(SCORE) > limit * (1 - SLACK)) & (F.col(SCORE) <= worst * (1 + SLACK))), "rest"
    )
    if rest.isEmpty():
        return _rows_of(likely, _cut(likely_scores, size, sizes)[1], size, sizes)
    rest_scores = _tiled_scores(rest, blocks, bounds, k, width, sizes)
    all_scores = likely_scores.unionByName(rest_scores).groupBy(ID).agg(F.min(SCORE).alias(SCORE))
    chosen = _cut(materialize(all_scores, "scores"), size, sizes)[1]
    candidates = likely.unionByName(rest).dropDuplicates([ID])
    return _rows_of(candidates, chosen, size, sizes)


def _cut(scores: DataFrame, size: int, sizes: Sizes) -> tuple[float, DataFrame]:
    """The largest of the ``size`` smallest scores, and the ids that have them."""
    first = smallest_rows(scores, [SCORE, ID], size, sizes.one_task_rows)
    return first.agg(F.max(SCORE)).first()[0], _keys_of(first)


def _keys_of(scored: DataFrame) -> DataFrame:
    return scored.select(ID)


def _rows_of(rows: DataFrame, chosen: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    if size <= sizes.one_task_rows:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, ID, "left_semi")


def _center(points: DataFrame) -> np.ndarray:
    """Mean point: one mean per coordinate."""
    means = (
        points.select(F.posexplode(POINT).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean")).orderBy("at").collect()
    )
    if not means:
        raise ValueError("the minority has no feature values")
    return np.array([row["mean"] for row in means])


def _matrix(values: pa.Array) -> np.ndarray:
    """Equal-length float lists as a two-dimensional array, without copying rows one by one."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        raise ValueError("a row has no feature vector")
    rows = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def farthest(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances to, and positions of, the k farthest rows of ``right``, farthest first."""
    k = min(k, len(right))
    wide = min(len(right), k + MARGIN)
    distances = np.empty((len(left), k))
    positions = np.empty((len(left), k), dtype=np.int64)
    right_squares = (right * right).sum(axis=1)
    step = max(1, KERNEL_VALUES // len(right))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        closeness = 2 * part @ right.T - right_squares
        if wide < len(right):
            near = np.argpartition(closeness, wide - 1, axis=1)[:, :wide]
        else:
            near = np.broadcast_to(np.arange(wide), (len(part), wide))
        exact = _exact_distances(part, right, near)
        order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        distances[start : start + step] = np.take_along_axis(exact, order, axis=1)
        positions[start : start + step] = np.take_along_axis(near, order, axis=1)
    return distances, positions


def _pivot_scores(pivots: DataFrame, center: np.ndarray, k: int):
    """Function of a point column giving, over a bounded set of minority rows, the mean
    and least of the k largest distances."""
    session = pivots.sparkSession
    rows = _matrix(pivots.select(POINT).toArrow()[POINT])
    shared = session.sparkContext.broadcast(rows - center)

    @F.arrow_udf("struct<mean double, least double>")
    def scores(values: pa.Array) -> pa.Array:
        distances, _ = farthest(_matrix(values) - center, shared.value, k)
        return pa.StructArray.from_arrays([pa.array(distances.mean(axis=1)), pa.array(distances[:, -1])], ["mean", "least"])

    # Costly and only equal to the last bit between runs: evaluate where written, once.
    return scores.asNondeterministic()


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - pivot) ** 2).sum(axis=1)) for pivot in pivots], axis=1)


def reachable(points: np.ndarray, floors: np.ndarray, pivots: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each point, and whether a group of blocks may hold rows at least ``floors`` away; ``far`` is as in ``Bounds``."""
    away = pivot_distances(points, pivots)
    bound = np.full((len(points), len(far)), np.inf)
    for at in range(len(pivots)):
        np.minimum(bound, away[:, at : at + 1] + far[:, at], out=bound)
    return away.argmin(axis=1), bound * (1 + SLACK) >= floors[:, None]


def spread_points(sample: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``first``, then points of the sample, each as far as can be from those before it; fewer if the sample has no others."""
    chosen = [first]
    nearest = np.sqrt(((sample - first) ** 2).sum(axis=1))
    while len(chosen) < count and len(sample) and nearest.max() > 0:
        chosen.append(sample[nearest.argmax()])
        nearest = np.minimum(nearest, np.sqrt(((sample - chosen[-1]) ** 2).sum(axis=1)))
    return np.array(chosen)


def _minority_blocks(minority: DataFrame, center: np.ndarray, tile_rows: int, sizes: Sizes) -> tuple[DataFrame, Bounds]:
    """Minority rows in blocks of ``tile_rows`` that lie near one pivot, and the greatest distances of at
    most ``BOUNDS`` groups of blocks from the centre and the other pivots."""
    few = max(1, min(PIVOT_SAMPLE, sizes.tile_bytes // (8 * len(center))))
    sample = _matrix(minority.orderBy(F.xxhash64(ID), ID).limit(few).select(POINT).toArrow()[POINT])
    pivots = spread_points(sample, center, PIVOTS)
    shared = minority.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell int, away array<double>>")
    def place(values: pa.Array) -> pa.Array:
        away = pivot_distances(_matrix(values), shared.value)
        lists = pa.ListArray.from_arrays(np.arange(0, away.size + 1, away.shape[1], dtype=np.int32), away.ravel())
        return pa.StructArray.from_arrays([pa.array(away.argmin(axis=1).astype(np.int32)), lists], ["cell", "away"])

    found = minority.select(ID, POINT, place.asNondeterministic()(F.col(POINT)).alias("place"))
    near = materialize(found.select(ID, POINT, "place.*").withColumn("reach", F.col("away")[0]), "reach")
    order = [F.col("cell").asc(), F.col("reach").desc(), F.col(ID).asc()]
    placed = running_total(near, [], order, F.lit(1).cast("long"), "position")
    block = F.floor(F.col("position") / tile_rows).cast("int")
    blocks = materialize(placed.select(ID, POINT, "reach", "away", block.alias("block")), "minority")
    count = blocks.agg(F.max("block")).first()[0] + 1
    step = math.ceil(count / BOUNDS)
    groups = blocks.groupBy(F.floor(F.col("block") / step).alias("group")).agg(*[F.max(F.col("away")[at]) for at in range(len(pivots))])
    far = np.array([row[1:] for row in groups.orderBy("group").collect()], float)
    return blocks.drop("away"), Bounds(pivots, far, step, count)


def _tiled_scores(
    rows: DataFrame, blocks: DataFrame, bounds: Bounds, k: int, width: int, sizes: Sizes
) -> DataFrame:
    """Exact scores ``(id, score)`` of bounded rows against all minority blocks.

    Copies of a point are scored once, so a point that fills a third of the rows costs
    no more than any other.
    """
    tile, most = sizes.tile(width), sizes.stretch(width)
    together = max(1, min(most // tile, math.ceil(bounds.count / BLOCK_STRETCHES)))
    stretches = math.ceil(bounds.count / together)
    ends = [(group * bounds.step // together, (min((group + 1) * bounds.step, bounds.count) - 1) // together) for group in range(len(bounds.far))]
    shared = rows.sparkSession.sparkContext.broadcast((bounds.pivots, bounds.far))

    @F.arrow_udf("struct<near int, cells array<int>>")
    def visits(values: pa.Array, floors: pa.Array) -> pa.Array:
        points, least = _matrix(values), floors.to_numpy() * (1 - SLACK)
        near, reached = np.empty(len(points), np.int32), np.zeros((len(points), stretches), bool)
        for at in range(0, len(points), SLICE):
            some = slice(at, at + SLICE)
            near[some], groups = reachable(points[some], least[some], *shared.value)
            for group, (first, last) in enumerate(ends):
                reached[some, first : last + 1] |= groups[:, group : group + 1]
        offsets = np.concatenate([[0], np.cumsum(reached.sum(axis=1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.nonzero(reached)[1].astype(np.int32)))
        return pa.StructArray.from_arrays([pa.array(near), lists], ["near", "cells"])

    marked = rows.withColumn(COPY, F.unhex(F.sha2(F.col(POINT).cast("string"), 256)))
    copies = marked.groupBy(COPY).agg(F.any_value(POINT).alias(POINT), F.min(FLOOR).alias(FLOOR), F.count(F.lit(1)).alias("count"))
    visiting = copies.withColumn("visits", visits.asNondeterministic()(F.col(POINT), F.col(FLOOR)))
    distinct = materialize(visiting.select(COPY, POINT, FLOOR, "count", "visits.*"), "points")
    # Rows near one pivot visit much the same blocks; they share a stretch, so that a block meets few stretches.
    order = [F.col("near").asc(), F.size("cells").asc(), F.col(COPY).asc()]
    placed = running_total(distinct, [], order, F.lit(1).cast("long"), "at")
    per_stretch = max(1, min(most, math.ceil(distinct.count() / ROW_STRETCHES)))
    left = placed.select(
        F.floor(F.col("at") / per_stretch).cast("int").alias("row_chunk"),
        F.explode("cells").alias("cell"),
        F.col(COPY).alias(ID),
        POINT,
        (F.col(FLOOR) * (1 - SLACK)).alias(FLOOR),
    )
    right = blocks.select(F.floor(F.col("block") / together).cast("int").alias("cell"), "block", F.col(ID).alias("__other"), POINT)

    def reached_rows(points: np.ndarray, floors: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Which rows of a stretch of blocks the points may have among their farthest."""
        pivots, far = shared.value
        groups, place = np.unique(block // bounds.step, return_inverse=True)
        return reachable(points, floors, pivots, far[groups])[1].any(axis=0)[place]

    scored = _scores(_tiles(left, right, F.lit(1), k, reached_rows), k).withColumnRenamed(ID, COPY)
    table = KeyTable(scored.join(distinct.select(COPY, "count"), COPY), COPY)
    return table.attach(marked.select(ID, COPY), F.col(COPY), [SCORE]).select(ID, SCORE)


def _tiles(left: DataFrame, right: DataFrame, right_chunks: Column, k: int, reached_rows=None) -> DataFrame:
    """Per left row and tile, its k farthest right rows of the same cell, as ``(id, far)``.

    A cell is cut into the left rows' ``row_chunk`` by ``right_chunks`` tiles, so a cell of any size
    becomes tasks of bounded size. Right rows go only to chunks that have rows in their cell. ``reached_rows`` tells from
    points, floors and the right rows' ``block`` which of these may matter; without it all do.
    """
    reached = left.select(F.col("cell").alias("reached_cell"), F.col("row_chunk").alias("reached_chunk")).distinct()
    if reached_rows is not None:
        # Cells are few and large here: their rows must not be shuffled by cell.
        reached = materialize(reached, "reached")
        reached = F.broadcast(reached) if reached.count() <= FEW_TILES else reached
    left_side = left.select(
        "cell",
        "row_chunk",
        F.explode(F.sequence(F.lit(0), right_chunks - 1)).alias("col_chunk"),
        ID,
        POINT,
        FLOOR,
    )
    right_side = right.join(reached, F.col("cell") == F.col("reached_cell")).select(
        F.col("reached_cell").alias("cell"),
        F.col("reached_chunk").alias("row_chunk"),
        F.pmod(F.xxhash64("__other"), right_chunks).cast("int").alias("col_chunk"),
        "__other",
        F.col(POINT).alias("__other_point"),
        *([] if reached_rows is None else ["block"]),
    )
    tile = ["cell", "row_chunk", "col_chunk"]
    id_type = left.schema[ID].dataType.simpleString()
    other_type = right.schema["__other"].dataType.simpleString()

    def multiply(key: tuple, rows: pa.Table, others: pa.Table) -> pa.Table:
        ids, other_ids = rows[ID].combine_chunks(), others["__other"].combine_chunks()
        if len(ids) and len(other_ids):
            points, other_points = _matrix(rows[POINT]), _matrix(others["__other_point"])
            floors, middle = rows[FLOOR].to_numpy(), other_points.mean(axis=0)
            centred = other_points - middle
            distances, positions = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
            block = None if reached_rows is None else others["block"].to_numpy()
            for at in range(0, len(ids), SLICE):
                some = slice(at, at + SLICE)
                part, held = points[some], None
                if block is not None:
                    held = np.flatnonzero(reached_rows(part, floors[some], block))
                    held = None if len(held) == len(block) else held
                against = centred if held is None else centred[held]
                if not len(against):
                    continue
                found = farthest(part - middle, against, k)[1]
                found = found if held is None else held[found]
                positions[some, : found.shape[1]] = found
                distances[some, : found.shape[1]] = _exact_distances(part, other_points, found)
            kept = distances >= floors[:, None]
        else:
            distances, positions = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)
            kept = np.zeros((len(ids), 0), dtype=bool)
        lengths = kept.sum(axis=1)
        some = lengths > 0
        starts = np.concatenate([[0], np.cumsum(lengths[some])]).astype(np.int32)
        far = pa.StructArray.from_arrays(
            [pa.array(distances[kept]), other_ids.take(pa.array(positions[kept]))], ["distance", "other"]
        )
        part = np.full(int(some.sum()), zlib.crc32(str(key[0].as_py()).encode()) % MERGE_SLICES)
        return pa.table(
            {
                ID: ids.filter(pa.array(some)),
                "slice": pa.array(part, pa.int32()),
                "far": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), far),
            }
        )

    schema = f"`{ID}` {id_type}, slice int, far array<struct<distance:double,other:{other_type}>>"
    return left_side.groupBy(*tile).cogroup(right_side.groupBy(*tile)).applyInArrow(multiply, schema)


def _exact_distances(points: np.ndarray, others: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Distances to chosen rows from the given coordinates, in slices of bounded memory."""
    distances = np.empty(positions.shape)
    step = max(1, KERNEL_VALUES // max(1, positions.shape[1] * points.shape[1]))
    for start in range(0, len(points), step):
        gap = others[positions[start : start + step]] - points[start : start + step, None, :]
        distances[start : start + step] = np.sqrt((gap * gap).sum(axis=2))
    return distances


def _scores(tiles: DataFrame, k: int) -> DataFrame:
    """Mean of the k largest distances of each row to different rows; a tile gives at most k.

    Tiles are merged slice by slice first, so no group holds the distances of all tiles.
    """

    def largest(rows: DataFrame, *groups: str) -> DataFrame:
        merged = rows.groupBy(*groups).agg(F.flatten(F.collect_list("far")).alias("far"))
        return merged.select(*groups, F.slice(F.sort_array(F.array_distinct("far"), asc=False), 1, k).alias("far"))

    merged, top = largest(largest(tiles, ID, "slice"), ID), F.col("far")
    total = F.aggregate(top, F.lit(0.0), lambda sum_, pair: sum_ + pair["distance"])
    return merged.select(ID, (total / F.size(top)).alias(SCORE))


def _shared_bucket_scores(
    majority: DataFrame, minority: DataFrame, others: int, k: int, seed: int, sizes: Sizes, probes: int = 0
) -> DataFrame:
    """Scores over the minority rows in the same bucket as a row, or in one of ``probes`` on either side, in any table."""
    width = len(_center(minority))
    hasher = BucketedRandomProjectionLSH(
        inputCol="__vector",
        outputCol="__hashes",
        bucketLength=math.pow(others, -1 / width),
        numHashTables=HASH_TABLES,
        seed=seed,
    ).fit(majority.limit(1).select(array_to_vector(POINT).alias("__vector")))

    def bucketed(rows: DataFrame, reach: int) -> DataFrame:
        hashed = hasher.transform(rows.select(ID, POINT, array_to_vector(POINT).alias("__vector")))
        table = hashed.select(ID, POINT, F.posexplode("__hashes").alias("table", "hash"))
        own = vector_to_array(F.col("hash"))[0].cast("long")
        near = table.withColumn("bucket", F.explode(F.sequence(own - reach, own + reach)))
        return near.select(ID, POINT, F.concat_ws(":", F.col("table").cast("string"), F.col("bucket").cast("string")).alias("cell"))

    left, right = bucketed(majority, probes), bucketed(minority, 0)
    per_tile = sizes.tile(width)
    both = (
        left.select("cell", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select("cell", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("cell")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .filter("l > 0 and r > 0")
    )
    cells = KeyTable(
        both.select(
            "cell",
            F.greatest(F.lit(1), F.ceil(F.col("l") / per_tile)).cast("int").alias("left_chunks"),
            F.greatest(F.lit(1), F.ceil(F.col("r") / per_tile)).cast("int").alias("right_chunks"),
            (F.col("l") + F.col("r")).alias("count"),
        ),
        "cell",
    )
    chunks = ["left_chunks", "right_chunks"]

    def shared(rows: DataFrame) -> DataFrame:
        return cells.attach(rows, F.col("cell"), chunks).filter(F.col("left_chunks").isNotNull())

    tiles = _tiles(
        shared(left).withColumns(
            {FLOOR: F.lit(0.0), "row_chunk": F.pmod(F.xxhash64(ID), F.col("left_chunks")).cast("int")}
        ),
        shared(right).withColumnRenamed(ID, "__other"),
        F.col("right_chunks"),
        k,
    )
    return materialize(_scores(tiles, k), "scores")
