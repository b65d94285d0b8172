"""Correlation matrices in long form."""

from __future__ import annotations

import math
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column, slot_names
from retentia.functions.keytable import BROADCAST_ROWS, KeyTable
from retentia.functions.ordering import running_total
from retentia.functions.scratch import local_table, materialize

# Workers get the function with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("pearson", "spearman")
VECTOR, RANK, RANKS = "__vector", "__rank", "__ranks"
JOINS = 4
MOMENT_COLUMNS = 20


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """``(row_name, col_name, correlation)`` for every pair of numeric columns.

    A constant column has NaN with every other.

    Rows with a missing value in one of the columns are left out.
    """
    _check(method)
    numbers = df.select(*[column(name).cast("double").alias(name) for name in columns]).na.drop()
    if method == "spearman":
        numbers = average_ranks(numbers, columns)
    return _pearson(numbers, columns)


def vector_correlation(df: DataFrame, vector_col: str, method: str = "pearson") -> DataFrame:
    """The same for the slots of an assembled vector, named by its attributes."""
    _check(method)
    names = slot_names(df, vector_col)
    slots = df.select(vector_to_array(column(vector_col)).alias("slots"))
    return correlation_matrix(slots.select(*[F.col("slots")[at].alias(name) for at, name in enumerate(names)]), names, method)


def average_ranks(df: DataFrame, columns: list[str], broadcast_values: int = BROADCAST_ROWS) -> DataFrame:
    """Replace values by ranks from 1, ties sharing their mean rank.

    Ranks come from the counts of distinct values, so a value held by most rows is one row of the
    rank table. Columns with few values, together at most about ``broadcast_values``, are counted in one job and ranked
    in place, as step functions that every task gets. Each of the others is ranked by range partitions of its
    distinct values and looked up, with hot values spread. Rows keep their columns together throughout.
    """
    numbers = materialize(df.select(*map(column, columns)), "numbers")
    sizes = numbers.agg(*[F.approx_count_distinct(column(name)) for name in columns]).first()
    few, room = [], broadcast_values
    for size, name in sorted(zip(sizes, columns)):
        if size <= room:
            few.append(name)
            room -= size
    ranked = numbers
    for turn, name in enumerate(name for name in columns if name not in few):
        ranked = _looked_up(ranked, numbers, name)
        if turn % JOINS == JOINS - 1:
            ranked = materialize(ranked, "ranked")
    return _stepped(ranked, numbers, few).select(*map(column, columns)) if few else ranked


def _looked_up(rows: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """``rows`` with the ranks of one column of many values in its place."""
    counts = numbers.groupBy(column(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    before = running_total(counts, [], [F.col("value").asc()], F.col("count"), "before")
    ranks = before.select("value", "count", (F.col("before") + (F.col("count") + 1) / 2).alias(RANK))
    found = KeyTable(materialize(ranks, "ranks"), "value", stored=True).attach(rows, column(name), [RANK])
    return found.withColumn(name, F.col(RANK)).drop(RANK)


def _stepped(rows: DataFrame, numbers: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the ranks of columns of few values in their place, from one table of their counts."""
    counts = numbers.select(*map(column, names)).unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    held = counts.toPandas().sort_values("value")
    steps = []
    for name in names:
        part = held[held["column"] == name]
        upto = part["count"].to_numpy().cumsum()
        steps.append((part["value"].to_numpy(), upto - (part["count"].to_numpy() - 1) / 2))
    shared = rows.sparkSession.sparkContext.broadcast(steps)

    @F.arrow_udf("array<double>")
    def ranks(values: pa.Array) -> pa.Array:
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        found = np.stack([rank[np.searchsorted(value, matrix[:, at])] for at, (value, rank) in enumerate(shared.value)], axis=1)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), found.ravel())

    # Marked, so that the ranks of a row are computed once and not once for each column.
    stepped = rows.withColumn(RANKS, ranks.asNondeterministic()(F.array(*map(column, names))))
    return stepped.withColumns({name: F.col(RANKS)[at] for at, name in enumerate(names)}).drop(RANKS)


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")


def _pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    matrix = _moments(df, columns) if len(columns) <= MOMENT_COLUMNS else _blocks(df, columns)
    rows = [(a, b, float(matrix[i][j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return local_table(df.sparkSession, rows, "row_name string, col_name string, correlation double")


def _moments(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """One aggregation with a covariance for each pair."""
    pairs = list(combinations(range(len(columns)), 2))
    row = df.agg(
        *[F.var_pop(column(name)) for name in columns],
        *[F.covar_pop(column(columns[i]), column(columns[j])) for i, j in pairs],
    ).first()
    matrix = [[1.0] * len(columns) for _ in columns]
    for (i, j), covariance in zip(pairs, row[len(columns) :]):
        scale = math.sqrt(row[i] * row[j]) if covariance is not None else 0.0
        matrix[i][j] = matrix[j][i] = covariance / scale if scale else math.nan
    return matrix


def _blocks(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """The built-in matrix, for more columns than one aggregation should have pairs of."""
    if df.isEmpty():
        return [[1.0 if a == b else math.nan for b in columns] for a in columns]
    assembled = VectorAssembler(inputCols=columns, outputCol=VECTOR).transform(df).select(VECTOR)
    return Correlation.corr(assembled, VECTOR, "pearson").head()[0].toArray().tolist()
