"""Positions, running totals and exact order statistics without a single-task sort."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.scratch import local_table, materialize

PART = "__part"
ONE_TASK_ROWS = 20_000
EDGE_VALUES = 50_000
SKETCH_ACCURACY = 10_000
SKETCH_ERRORS = 1.5

Target = tuple[str, int]
Interval = tuple[object, object]


def running_total(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group, exclusive.

    ``order`` must not leave ties, and ``groups`` must be few (column names).
    Rows are range-partitioned, so a group of any size spreads over many tasks;
    only one sum per partition and group is joined back.
    """
    keys = [column(name) for name in groups]
    placed = materialize(
        df.withColumn("__value", value)
        .repartitionByRange(*[key.asc() for key in keys], *order)
        .withColumn(PART, F.spark_partition_id()),
        "ranged",
    )
    inside = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(PART, *keys)
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
        .drop("__sum")
    )
    return (
        placed.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), [PART, *groups])
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .select(*[column(name) for name in df.columns], out)
    )


def smallest_rows(df: DataFrame, order: Sequence[str], n: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The ``n`` first rows by ``order`` (ascending, unique, no nulls).

    A small ``n`` is a plain top-n. A large one would pass every selected row
    through one task, so the rows are range-partitioned, whole partitions are
    taken, and only the partition holding the n-th row is sorted to find the edge.
    """
    names = [column(name) for name in order]
    if n <= one_task_rows:
        return df.orderBy(*names).limit(n)
    placed = materialize(df.repartitionByRange(*names).withColumn(PART, F.spark_partition_id()), "ranged")
    sizes = sorted((row[PART], row["count"]) for row in placed.groupBy(PART).count().collect())
    taken = 0
    for part, size in sizes:
        if taken + size >= n:
            break
        taken += size
    else:
        return placed.drop(PART)
    last = F.col(PART) == part
    edge = placed.filter(last).select(*names).orderBy(*names).offset(n - taken - 1).limit(1).first()
    within, tied = F.lit(False), F.lit(True)
    for name, value in zip(order, edge):
        within = within | (tied & (column(name) < F.lit(value)))
        tied = tied & (column(name) == F.lit(value))
    return placed.filter((F.col(PART) < part) | (last & (within | tied))).drop(PART)


def discrete_rank(share: float, size: int) -> list[int]:
    """0-based rank of the first value whose cumulative share reaches ``share``."""
    return [max(0, math.ceil(share * size) - 1)]


def exact_quantiles(
    df: DataFrame,
    shares: dict[str, Sequence[float]],
    rank_rule: Callable[[float, int], list[int]] = discrete_rank,
    extra: Sequence[Column] = (),
    small: int = EDGE_VALUES,
    accuracy: int = SKETCH_ACCURACY,
) -> tuple[dict[tuple[str, float], list], Row]:
    """Exact values at shares of the non-null values of numeric columns, and ``extra`` aggregates.

    Two passes over ``df``. The first takes the extra aggregates, the sizes and a sketch of each column, which
    proposes two values around every wanted rank. The second counts the values outside of these intervals
    and writes those inside, each once with its number of rows: a few ten-thousandths of the
    rows, and one entry for a value that any share of the rows holds. The wanted ranks are then looked up in that
    table of candidates, on the driver if it has at most ``small`` rows, else by range partitions.
    Had the sketch missed a rank, the second pass is repeated for the side on which it lies.

    A column without values gives empty lists. ``rank_rule`` turns a share and a size
    into the 0-based ranks to return.
    """
    names, margin = list(shares), SKETCH_ERRORS / accuracy
    ends = {name: [end for share in shares[name] for end in _around(share, margin)] for name in names}
    first = df.agg(
        *extra,
        *[F.count(column(name)) for name in names],
        *[F.percentile_approx(column(name), ends[name], accuracy) for name in names],
    ).first()
    sizes = dict(zip(names, first[len(extra) :]))
    sketched = dict(zip(names, first[len(extra) + len(names) :]))
    ranks = {(name, share): rank_rule(share, sizes[name]) for name in names for share in shares[name] if sizes[name]}
    wanted: dict[Target, Interval] = {}
    for (name, share), some in ranks.items():
        at = 2 * list(shares[name]).index(share)
        wanted |= {(name, rank): (sketched[name][at], sketched[name][at + 1]) for rank in some}
    found: dict[Target, object] = {}
    while wanted:
        wanted = _select(df, wanted, found, small)
    values = {
        (name, share): [found[name, rank] for rank in ranks.get((name, share), [])] for name in names for share in shares[name]
    }
    return values, first[: len(extra)]


def _around(share: float, margin: float) -> list[float]:
    return [max(0.0, share - margin), min(1.0, share + margin)]


def _sortable(value: object) -> tuple:
    """Spark's order of numbers: NaN after all others."""
    return value != value, value


def _merged(intervals: Sequence[Interval]) -> list[Interval]:
    """Disjoint intervals that cover the given ones; None is an open end."""
    low_of = lambda interval: (interval[0] is not None, *(_sortable(interval[0]) if interval[0] is not None else ()))
    merged: list[Interval] = []
    for low, high in sorted(set(intervals), key=low_of):
        if merged and (merged[-1][1] is None or low is None or _sortable(low) <= _sortable(merged[-1][1])):
            last = merged[-1]
            merged[-1] = (last[0], None if last[1] is None or high is None else max(last[1], high, key=_sortable))
        else:
            merged.append((low, high))
    return merged


def _select(df: DataFrame, wanted: dict[Target, Interval], found: dict[Target, object], small: int) -> dict[Target, Interval]:
    """One pass: adds the values of ranks that lie in their intervals to ``found``, and returns where the others must be."""
    names = list(dict.fromkeys(name for name, _ in wanted))
    intervals = {name: _merged([interval for (of, _), interval in wanted.items() if of == name]) for name in names}
    candidates = materialize(_candidates(df, intervals), "candidates")
    counts = candidates.groupBy("at", "segment").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("values")).collect()
    rows = {(row["at"], row["segment"]): row["rows"] for row in counts}
    # A column's segments in order: below its first interval, inside, between, inside, ..., above.
    places: list[tuple] = []
    missed: dict[Target, Interval] = {}
    for (name, rank) in wanted:
        at, before = names.index(name), 0
        for segment in range(2 * len(intervals[name]) + 1):
            inside = rows.get((at, segment), 0)
            if rank < before + inside:
                break
            before += inside
        if segment % 2:
            places.append((at, segment, rank, rank - before))
        else:
            lows, highs = zip(*intervals[name])
            missed[name, rank] = ((None, *highs)[segment // 2], (*lows, None)[segment // 2])
    for at, rank, value in _ranked(candidates.filter("segment % 2 = 1"), places, sum(row["values"] for row in counts), small):
        found[names[at], rank] = value
    return missed


def _candidates(df: DataFrame, intervals: dict[str, list[Interval]]) -> DataFrame:
    """Rows per column and segment; those in an interval are counted by their value."""
    kinds = list(dict.fromkeys(df.schema[name].dataType.simpleString() for name in intervals))
    entries = []
    for at, (name, ranges) in enumerate(intervals.items()):
        value, kind = column(name), df.schema[name].dataType.simpleString()
        segment = F.when(value.isNull(), F.lit(None))
        for turn, (low, high) in enumerate(ranges):
            if low is not None:
                segment = segment.when(value < F.lit(low), F.lit(2 * turn))
            segment = segment.when(F.lit(True) if high is None else value <= F.lit(high), F.lit(2 * turn + 1))
        segment = segment.otherwise(F.lit(2 * len(ranges))).cast("int")
        values = [F.when(segment % 2 == 1, value if kind == of else F.lit(None)).cast(of).alias(f"v{n}") for n, of in enumerate(kinds)]
        entries.append(F.struct(F.lit(at).alias("at"), segment.alias("segment"), *values))
    cells = df.select(F.inline(F.array(*entries))).filter(F.col("segment").isNotNull())
    return cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("count"))


def _ranked(candidates: DataFrame, places: list[tuple], values: int, small: int) -> list[tuple]:
    """``(column, rank, value)`` for places ``(column, segment, rank, rank inside the segment)`` among counted values."""
    kinds = [name for name in candidates.columns if name.startswith("v")]
    value_of = lambda row: next((row[kind] for kind in kinds if row[kind] is not None), None)
    if not places:
        return []
    if values <= small:
        held: dict[tuple, list] = {}
        for row in candidates.collect():
            held.setdefault((row["at"], row["segment"]), []).append((value_of(row), row["count"]))
        totals = {}
        for place, pairs in held.items():
            pairs.sort(key=lambda pair: _sortable(pair[0]))
            totals[place] = [pair[0] for pair in pairs], list(accumulate(pair[1] for pair in pairs))
        return [(at, rank, totals[at, segment][0][bisect_right(totals[at, segment][1], inside)]) for at, segment, rank, inside in places]
    table = local_table(candidates.sparkSession, places, "at int, segment int, rank bigint, inside bigint")
    placed = running_total(candidates, ["at", "segment"], [F.col(kind).asc() for kind in kinds], F.col("count"), "before")
    reached = (F.col("before") <= F.col("inside")) & (F.col("inside") < F.col("before") + F.col("count"))
    return [(row["at"], row["rank"], value_of(row)) for row in placed.join(F.broadcast(table), ["at", "segment"]).filter(reached).collect()]


def median_ranks(share: float, size: int) -> list[int]:
    """The one or two middle ranks."""
    return sorted({(size - 1) // 2, size // 2})


def median_of(middle: Sequence) -> float | None:
    """The mean of the one or two middle values; None of none."""
    return float(sum(middle)) / len(middle) if middle else None
