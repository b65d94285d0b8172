"""Shards along a Hilbert curve through several metadata columns.

Each column is quantised to cells of about equally many rows, with approximate quantiles, or texts of
the column itself, as borders, and a row's cells become its place on a Hilbert curve. Rows in the order of the curve
are cut into runs of equal length. A run covers a compact region, so the minima and
maxima of all the columns tell a reader which files to leave out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column, hashable_columns
from retentia.functions.ordering import running_total
from retentia.functions.scratch import materialize

BITS = 8
ACCURACY = 10_000
BORDER_CHARS = 1_024
# Fixed value: bits of monotonically_increasing_id that count rows within a partition.
PART_SHIFT = 33


def curve_table(dims: int) -> list[int]:
    """Steps of a Hilbert curve in ``dims`` dimensions: place ``state * 2**dims + cell`` holds digit + 2**dims * next state.

    A state is where a sub-cube is entered and the axis along which it is left. The cells of a
    cube follow a Gray code, turned and mirrored by the state.
    """
    cells = 1 << dims
    turn = lambda x, by: ((x << by % dims) | (x >> (dims - by % dims))) & (cells - 1)
    gray = lambda x: x ^ (x >> 1)
    digit_of = {gray(digit): digit for digit in range(cells)}
    low_ones = lambda x: (~x & (x + 1)).bit_length() - 1
    table = []
    for axis in range(dims):
        for entry in range(cells):
            for cell in range(cells):
                digit = digit_of[turn(cell ^ entry, dims - (axis + 1) % dims)]
                first = gray(2 * ((digit - 1) // 2)) if digit else 0
                step = low_ones(digit if digit % 2 else digit - 1) % dims if digit else 0
                state = (axis + step + 1) % dims * cells + (entry ^ turn(first, axis + 1))
                table.append(digit + cells * state)
    return table


def in_order(df: DataFrame, name: str) -> Column:
    """Text as it is, anything else as a number in the order of the column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return column(name)
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return column(name).cast("timestamp").cast("double")
    return column(name).cast("double")


def text_borders(df: DataFrame, name: str, bits: int) -> list[str]:
    """Texts that cut a column into cells of about equally many rows; values more frequent than that are borders themselves.

    Each distinct text is counted, and the counts are added up in the order of the texts, by range partitions. Borders are
    cut after ``BORDER_CHARS`` characters.
    """
    counts = df.filter(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    running = materialize(running_total(counts, [], [F.col("value").asc()], F.col("count"), "before"), "borders")
    total = running.agg(F.sum("count")).first()[0] or 0
    cell = F.floor((F.col("before") + F.col("count")) * (1 << bits) / F.lit(total or 1))
    ends = running.groupBy(cell.alias("cell")).agg(F.max("value").alias("last")).select(F.substring("last", 1, BORDER_CHARS).alias("last"))
    found = sorted(row["last"] for row in ends.collect())
    return found[: (1 << bits) - 1]


def curve_index(df: DataFrame, dimensions: Sequence[str], bits: int, row: Column, out: str) -> DataFrame:
    """``df``'s columns as a struct ``row``, and the place ``out`` of each row on the curve.

    One aggregation finds the cell borders of all dimensions but texts, whose borders come from their own order. Null is in the first cell.
    """
    values = [in_order(df, name) for name in dimensions]
    texts = [isinstance(df.schema[name].dataType, T.StringType) for name in dimensions]
    shares = [(at + 1) / (1 << bits) for at in range((1 << bits) - 1)]
    numbers = [value for value, text in zip(values, texts) if not text]
    quantiles = iter(df.agg(*[F.percentile_approx(number, shares, ACCURACY) for number in numbers]).first() if numbers else ())
    cells = {}
    for at, (name, value, text) in enumerate(zip(dimensions, values, texts)):
        border = text_borders(df, name, bits) if text else [float(x) for x in next(quantiles) or ()]
        cells[f"c{at}"] = _cell(value, border, bits)
    placed = df.select(row.alias("row"), *[cell.alias(name) for name, cell in cells.items()])
    bit = " + ".join(f"shiftleft(shiftright(c{at}, level) & 1, {at})" for at in range(len(values)))
    size, table = 1 << len(values), curve_table(len(values))
    # The state carries the last step, whose digit joins the place one level later.
    found = F.expr(
        f"""aggregate(
            sequence({bits - 1}, 0, -1),
            named_struct('place', 0L, 'step', 0L),
            (acc, level) -> named_struct(
                'place', acc.place * {size} + acc.step % {size},
                'step', element_at(steps, cast(acc.step div {size} * {size} + ({bit}) + 1 as int))),
            acc -> acc.place * {size} + acc.step % {size})"""
    )
    placed = placed.withColumn("steps", F.lit(table).cast("array<bigint>"))
    return placed.select("row", found.alias(out))


def _cell(value: Column, borders: list, bits: int) -> Column:
    """Number of borders below the value, by bisection."""
    if not borders:
        return F.lit(0)
    size, borders = len(borders), F.lit(borders)
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(bits))])
    above = lambda at: (at <= size) & (value > F.try_element_at(borders, at))
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(above(at + step), step).otherwise(F.lit(0)))
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def shard_rows(df: DataFrame, key: str, dimensions: Sequence[str], shards: int, bits: int = BITS) -> DataFrame:
    """All columns of ``df`` and ``shard``, ``slot`` and ``curve``: runs of the Hilbert curve with counts at most one apart.

    ``slot`` counts from 0 within a shard, in the order of the curve, then the key, then a hash of
    the row. Repeated rows are rows of their own, side by side. A null key comes before all others, a null dimension is in the first
    cell, and texts of any length count whole but for borders, which are cut after ``BORDER_CHARS`` characters. A column of ``df`` that has the
    name of a new one is replaced. An empty table stays empty. Rows are shuffled once, by range.
    """
    row = F.struct(*[column(name) for name in df.columns], F.xxhash64(*hashable_columns(df)).alias("__tie"))
    placed = curve_index(df, dimensions, bits, row, "curve")
    order = [F.col("curve"), F.col("row").getField(key), F.col("row").getField("__tie")]
    # Within a range partition, sorted rows are numbered as they stand: no second shuffle brings them together again.
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    written = materialize(ranged, "curve").withColumn("part", F.shiftright("at", PART_SHIFT))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = parts.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    numbered = written.join(F.broadcast(offsets), "part")
    position = F.col("before") + F.col("at") - F.shiftleft("part", PART_SHIFT)
    shard = F.floor(position * shards / F.col("total")).cast("int")
    first = F.ceil(shard.cast("long") * F.col("total") / shards)
    kept = [name for name in df.columns if name not in ("shard", "slot", "curve")]
    return numbered.select(*[F.col("row").getField(name).alias(name) for name in kept], shard.alias("shard"), (position - first).cast("long").alias("slot"), "curve")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the result of ``shard_rows`` as Parquet, a folder for each shard, rows in the order of the curve."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
