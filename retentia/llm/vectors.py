"""Vectors in tables: which take part, their form between stages, and k-means cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column
from retentia.functions.scratch import materialize

SAMPLE = 1 << 15
SAMPLE_BYTES = 64 << 20
PER_CELL = 16
ROUNDS = 8

# Names of the columns of ``prepare``.
ROW, KEY, GROUP, DIGEST, VECTOR = "row", "key", "group", "digest", "vector"


def to_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows as doubles, shorter ones filled up with zeros; NaN throughout where a row is null."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    values = np.asarray(vectors.flatten().cast(pa.float64()), float)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix = np.zeros((len(lengths), width))
    matrix[rows, places] = values
    matrix[np.asarray(pc.is_null(vectors))] = np.nan
    return matrix


def prepare(df: DataFrame, key: str, vector: str, group: str | None = None) -> tuple[DataFrame, int]:
    """Number the rows and turn vectors into bytes; also returns the width, that of the longest vector.

    Columns: ``row`` (unique), ``key``, ``group`` (text of the group column), ``vector`` (bytes, of float32
    if the input is float, else of doubles) and ``digest``, which equals another row's only if
    group and vector do. Both are null if the vector is null, zero, or holds null or
    non-finite components, or if there is a group column and it is null. Shorter vectors
    count as filled up with zeros; -0.0 is 0.0. Written once, so that the row numbers stay.
    """
    spark = df.sparkSession
    width = df.agg(F.max(F.size(column(vector)))).first()[0] or 0
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, groups, vectors = batch.columns
            matrix = to_matrix(vectors, width) + 0.0
            with np.errstate(invalid="ignore"):
                right = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1) & ~np.asarray(pc.is_null(groups))
            matrix = matrix.astype(kind)
            blobs = [one.tobytes() if good else None for one, good in zip(matrix, right)]
            marks = [None if b is None else hashlib.md5(g.as_py().encode() + b"|" + b).hexdigest() for g, b in zip(groups, blobs)]
            yield pa.record_batch([rows, keys, groups, pa.array(marks, pa.string()), pa.array(blobs, pa.binary())], [ROW, KEY, GROUP, DIGEST, VECTOR])

    named = F.lit("") if group is None else column(group).cast("string")
    chosen = df.select(F.monotonically_increasing_id(), column(key).alias(KEY), named.alias(GROUP), column(vector).alias(VECTOR))
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{ROW}` long, `{KEY}` {key_type}, `{GROUP}` string, `{DIGEST}` string, `{VECTOR}` binary"
    prepared = chosen.mapInArrow(run, schema) if width else spark.createDataFrame([], schema)
    if not width:
        prepared = chosen.select(F.col(chosen.columns[0]).alias(ROW), KEY, GROUP, F.lit(None).cast("string").alias(DIGEST), F.lit(None).cast("binary").alias(VECTOR))
    return materialize(prepared, "vectors"), width


def stack(blobs: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Vectors from their bytes, one row each, as doubles."""
    found = blobs.to_pylist()
    return np.frombuffer(b"".join(found), kind).reshape(len(found), -1).astype(float)


def byte_type(df: DataFrame, vector: str) -> str:
    """NumPy type of the bytes that ``prepare`` makes of a column."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def sample_vectors(points: DataFrame, kind: str, width: int, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors, and ``SAMPLE_BYTES`` of doubles, chosen by a hash of their digest, for fitting cells."""
    most = max(PER_CELL, min(most, SAMPLE_BYTES // (8 * max(1, width))))
    rows = points.select(DIGEST, VECTOR).orderBy(F.xxhash64(DIGEST), DIGEST).limit(most).collect()
    return np.frombuffer(b"".join(row[VECTOR] for row in rows), kind).reshape(len(rows), -1).astype(float) if rows else np.zeros((0, 1))


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``cells`` cells, or of as many as ``PER_CELL`` sample vectors for each allow.

    A vector belongs to the centre with which its cosine is largest. A centre left without
    vectors moves to the vector that fits its own centre worst.
    """
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    cells = max(1, min(cells, len(units) // PER_CELL))
    centres = units[np.linspace(0, len(units) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        cosines = units @ centres.T
        home = cosines.argmax(axis=1)
        fit = cosines[np.arange(len(units)), home]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        empty = np.flatnonzero(np.bincount(home, minlength=cells) == 0)
        sums[empty] = units[np.argsort(fit, kind="stable")[: len(empty)]]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres
