"""Approximate nearest neighbours by inner product: inverted lists scanned dimension by dimension.

A vector x with length |x| gets one more component, sqrt(M^2 - |x|^2), where M is the largest
length; queries get a zero there. Then the largest inner product is the smallest Euclidean
distance. A random rotation spreads what tells two vectors apart evenly over the
dimensions, so the distance over the first d of D of them, times D / d, estimates the whole.
A scan takes the dimensions in blocks of columns and after each block drops the
candidates whose estimate is beyond the k-th best distance so far by more than a factor
1 + epsilon / sqrt(d): the hypothesis that they belong to the nearest is rejected. What is left
at the end has its inner product computed from the original vectors.

All vectors are indexed. Centres are fitted on a bounded sample; a query probes the lists of
the nearest centres. Lists and the queries that probe them are cut into blocks, so a
task holds a bounded tile however many vectors share a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize
from retentia.llm.vectors import DIGEST, KEY, ROW, VECTOR, byte_type, prepare, sample_vectors, spherical_kmeans, stack

SEED = 20
COLUMNS = 16
BLOCK_POINTS = 1 << 13
BLOCK_QUERIES = 1 << 10
STEP = 1 << 12
TOGETHER = 64
DENSE = 0.1
SLACK = 1e-9


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def lift(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """Vectors with the component that makes all as long as ``longest``; zero for queries (None)."""
    if longest is None:
        extra = np.zeros(len(vectors))
    else:
        extra = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
    return np.column_stack([vectors, extra])


def scan(points: np.ndarray, queries: np.ndarray, k: int, epsilon: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) that a dimension scan leaves, among them very likely each query's ``k`` nearest.

    ``points`` and ``queries`` are lifted and rotated. ``skip`` has the point that does not count for each query, or -1. While
    many pairs are alive a block of columns is one matrix product; later only the pairs left are looked up.
    """
    width, asked = points.shape[1], np.arange(len(queries))
    skipped = skip >= 0
    if len(points) <= 4 * k:
        rows, columns = np.repeat(asked, len(points)), np.tile(np.arange(len(points)), len(queries))
        keep = columns != skip[rows]
        return rows[keep], columns[keep]
    partial = _block_distances(points, queries, 0)
    partial[asked[skipped], skip[skipped]] = np.inf
    # The points that look nearest over the first block set each query's first bound by their whole distance.
    first = np.argpartition(partial, 4 * k - 1, axis=1)[:, : 4 * k]
    whole = ((points[first] - queries[:, None]) ** 2).sum(axis=2)
    whole[first == skip[:, None]] = np.inf
    bound = np.partition(whole, k - 1, axis=1)[:, k - 1]
    rows = columns = values = None
    for at in range(COLUMNS, width + COLUMNS, COLUMNS):
        done = min(at, width)
        limit = bound * ((1 + epsilon / math.sqrt(done)) ** 2 * done / width if done < width else 1 + SLACK)
        if rows is None:
            near = partial <= limit[:, None] + SLACK
            if done < width and near.mean() > DENSE:
                # Pairs that are out keep their place here, with a distance that cannot come back.
                partial = np.where(near, partial, np.inf) + _block_distances(points, queries, at)
                continue
            rows, columns = np.nonzero(near)
            values = partial[rows, columns]
        else:
            keep = values <= limit[rows] + SLACK
            rows, columns, values = rows[keep], columns[keep], values[keep]
        if done < width:
            values = values + ((points[columns, at : at + COLUMNS] - queries[rows, at : at + COLUMNS]) ** 2).sum(axis=1)
    return rows, columns


def _block_distances(points: np.ndarray, queries: np.ndarray, at: int) -> np.ndarray:
    """Squared distances over one block of columns."""
    p, q = points[:, at : at + COLUMNS], queries[:, at : at + COLUMNS]
    return np.maximum(0.0, (q**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * q @ p.T)


def _probe(rows: DataFrame, centres: np.ndarray, longest: float, probes: int, kind: str, is_query: bool) -> DataFrame:
    """Rows with the list they belong to, or with each list they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                some = batch.slice(start, STEP)
                lifted = lift(stack(some.column(VECTOR), kind), None if is_query else longest)
                closeness = lifted @ centres.T * 2 - (centres**2).sum(axis=1)
                n = probes if is_query else 1
                lists = np.argpartition(-closeness, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (some.num_rows, 1))
                taken = some.take(pa.array(np.repeat(np.arange(some.num_rows), lists.shape[1])))
                yield pa.record_batch([*taken.columns, pa.array(lists.ravel())], [*taken.schema.names, "list"])

    key_type = rows.schema[KEY].dataType.simpleString()
    return rows.select(ROW, KEY, VECTOR).mapInArrow(run, f"`{ROW}` long, `{KEY}` {key_type}, `{VECTOR}` binary, list long")


def _deal(rows: DataFrame, sizes: KeyTable, block: str, blocks: str) -> DataFrame:
    """Rows in a block of their list, copied to every block of the other side."""
    wide = sizes.attach(rows, F.col("list"), ["point_blocks", "query_blocks"])
    mine = F.pmod(F.xxhash64(ROW), F.col(f"{block}_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{blocks}_blocks") - 1))
    return wide.withColumns({f"{block}_block": mine}).withColumn(f"{blocks}_block", other).drop("point_blocks", "query_blocks")


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    queries: Column,
    k: int = 20,
    lists: int | None = None,
    probe_share: float = 0.8,
    epsilon: float = 2.1,
) -> DataFrame:
    """The ``k`` rows with the largest inner product found for each row that ``queries`` selects.

    ``queries`` is a condition on the key, which is the column ``key`` there. Every other row is a
    candidate, also one with the same key. Returns ``query_id``, ``rank`` (from 1), the
    candidate's key as ``neighbour_id`` and ``score``, the inner product in double precision;
    ties go to the smaller key, fewer rows come if there are fewer candidates.

    Vectors that are null, zero or hold null or non-finite components neither ask nor answer.
    Repeated query rows give repeated results. There are ``lists`` lists, or a sixteenth of the root
    of the rows, as far as the sample allows, and a query probes ``probe_share`` of them.
    """
    rows, width = prepare(df, key, vector)
    kind, spark = byte_type(df, vector), df.sparkSession
    valid = rows.filter(F.col(DIGEST).isNotNull())
    key_type = df.schema[key].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                longest = np.linalg.norm(stack(batch.column(0), kind), axis=1).max()
                yield pa.record_batch([pa.array([float(longest)]), pa.array([batch.num_rows])], ["longest", "n"])

    measured = valid.select(VECTOR).mapInArrow(lengths, "longest double, n long").agg(F.max("longest"), F.sum("n")).first()
    longest, n = measured[0] or 0.0, measured[1] or 0
    sample = lift(sample_vectors(valid, kind, width), longest) if n else np.zeros((1, width + 1))
    centres = spherical_kmeans(sample, lists or math.ceil(math.sqrt(n) / 16)) * longest if n else sample
    probes = math.ceil(probe_share * len(centres))
    turn = rotation(width + 1)

    points = materialize(_probe(valid, centres, longest, 1, kind, False), "lists")
    asked = materialize(_probe(valid.filter(queries), centres, longest, probes, kind, True), "probes")
    counted = points.groupBy("list").agg(F.count(F.lit(1)).alias("p")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("q")), "list")
    blocks = lambda name, size: F.ceil(F.col(name) / size).cast("long")
    sizes = KeyTable(
        counted.select("list", blocks("p", BLOCK_POINTS).alias("point_blocks"), blocks("q", BLOCK_QUERIES).alias("query_blocks"), (F.col("p") + F.col("q")).alias("count")), "list"
    )
    one = _deal(points, sizes, "point", "query").filter("point_block is not null").withColumn("asks", F.lit(False))
    two = _deal(asked, sizes, "query", "point").filter("query_block is not null").withColumn("asks", F.lit(True))

    def search(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        there, here = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        parts: list[tuple] = []
        if there.num_rows and here.num_rows:
            plain, wanted = stack(there.column(VECTOR), kind), stack(here.column(VECTOR), kind)
            turned, turned_queries = lift(plain, longest) @ turn, lift(wanted, None) @ turn
            rows_there, rows_here = there.column(ROW).to_numpy(), here.column(ROW).to_numpy()
            at = {row: place for place, row in enumerate(rows_there.tolist())}
            keys, asking = there.column(KEY).combine_chunks(), here.column(KEY).combine_chunks()
            rank_of_key = np.empty(len(plain), np.int64)
            rank_of_key[np.asarray(pc.sort_indices(keys))] = np.arange(len(plain))
            own = np.array([at.get(row, -1) for row in rows_here.tolist()])
            for start in range(0, len(wanted), TOGETHER):
                rows, columns = scan(turned, turned_queries[start : start + TOGETHER], k, epsilon, own[start : start + TOGETHER])
                rows = rows + start
                scores = (plain[columns] * wanted[rows]).sum(axis=1)
                order = np.lexsort((rank_of_key[columns], -scores, rows))
                rows, columns, scores = rows[order], columns[order], scores[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                best = place < k
                parts.append((rows_here[rows[best]], asking.take(pa.array(rows[best])), keys.take(pa.array(columns[best])), scores[best]))
        return pa.table(
            [
                pa.array(np.concatenate([p[0] for p in parts]) if parts else [], pa.int64()),
                pa.chunked_array([p[1] for p in parts], table.schema.field(KEY).type).combine_chunks(),
                pa.chunked_array([p[2] for p in parts], table.schema.field(KEY).type).combine_chunks(),
                pa.array(np.concatenate([p[3] for p in parts]) if parts else [], pa.float64()),
            ],
            names=["query_row", "query_id", "neighbour_id", "score"],
        )

    schema = f"query_row long, query_id {key_type}, neighbour_id {key_type}, score double"
    if not n:
        return spark.createDataFrame([], f"query_id {key_type}, rank int, neighbour_id {key_type}, score double")
    found = one.unionByName(two).groupBy("list", "point_block", "query_block").applyInArrow(search, schema)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("neighbour_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "score")
