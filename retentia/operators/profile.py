"""Profiles of a table: schema, counts, summaries and class distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column, column_group, columns_types
from retentia.functions.keytable import KeyTable
from retentia.functions.ordering import SKETCH_ACCURACY, exact_quantiles, median_of, median_ranks
from retentia.functions.scratch import local_table

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
# The statistics after the count, in report order.
SUMMARY = ("mean", "stddev", "min", *QUARTILES, "max")
# By one aggregation; the median is selected by rank instead, as Spark's keeps all distinct values in one buffer.
AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
MEDIAN = "median"


def long_form(wide: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn one wide row of aggregates into one row per dict of named columns."""
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return wide.select(F.inline(F.array(*structs)))


def show_summary_general(df: DataFrame, n_rows: int = 5, order_by: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The schema as a table, and the first rows, by ``order_by`` or as they come."""
    return schema_table(df), (df.orderBy(*order_by) if order_by else df).limit(n_rows)


def schema_table(df: DataFrame, wide_numeric: bool = False) -> DataFrame:
    rows = [
        (at, field.name, field.dataType.simpleString(), field.nullable, column_group(field.dataType, wide_numeric))
        for at, field in enumerate(df.schema.fields)
    ]
    return local_table(df.sparkSession, 
        rows, "position int, column string, type string, nullable boolean, column_group string"
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type group, row count, non-null count and distinct count of every column."""
    fields = df.schema.fields
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(column(field.name)).alias(f"v{at}") for at, field in enumerate(fields)],
        *[_distinct(field.name, approximate).alias(f"d{at}") for at, field in enumerate(fields)],
    )
    return long_form(
        wide,
        [
            {
                "column": F.lit(field.name),
                "column_group": F.lit(column_group(field.dataType)),
                "rows": F.col("rows"),
                "non_null": F.col(f"v{at}"),
                "distinct_values": F.col(f"d{at}"),
            }
            for at, field in enumerate(fields)
        ],
    )


def _distinct(name: str, approximate: bool, relative_error: float = 0.05) -> Column:
    return F.approx_count_distinct(column(name), relative_error) if approximate else F.count_distinct(column(name))


def distinct_counts(
    df: DataFrame, columns: list[str] | None = None, approximate: bool = False, relative_error: float = 0.05
) -> DataFrame:
    """Distinct non-null values per column, all columns in one job."""
    names = columns or df.columns
    wide = df.agg(*[_distinct(name, approximate, relative_error).alias(f"d{at}") for at, name in enumerate(names)])
    return long_form(
        wide, [{"column": F.lit(name), "distinct_values": F.col(f"d{at}")} for at, name in enumerate(names)]
    )


def show_summary_categoricals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Value counts of every string column as ``(column, value, count)``, one job for all."""
    names = columns if columns is not None else columns_types(df)["categorical_cols"]
    if not names:
        return local_table(df.sparkSession, [], "column string, value string, count bigint")
    texts = df.select(*[column(name).cast("string").alias(name) for name in names])
    return (
        texts.unpivot([], names, "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def show_summary_numerical(df: DataFrame, columns: list[str] | None = None, quantiles: str = "approx") -> DataFrame:
    """Count, mean, stddev, min, quartiles and max of every numeric column, one row each.

    ``quantiles="approx"`` takes one pass, ``"exact"`` at least two more that count.
    """
    if quantiles not in ("exact", "approx"):
        raise ValueError("quantiles must be 'exact' or 'approx'")
    names = columns if columns is not None else columns_types(df)["numeric_cols"]
    schema = ", ".join(["column string", "count bigint", *[f"{name} double" for name in SUMMARY]])
    if not names:
        return local_table(df.sparkSession, [], schema)
    moments = []
    for name in names:
        c = column(name)
        moments += [F.count(c), F.avg(c), F.stddev_samp(c.cast("double")), F.min(c), F.max(c)]
    if quantiles == "exact":
        values, row = exact_quantiles(df, {name: list(QUARTILES.values()) for name in names}, extra=moments)
        quartiles = {name: [next(iter(values[name, share]), None) for share in QUARTILES.values()] for name in names}
    else:
        sketches = [F.percentile_approx(column(name), list(QUARTILES.values()), SKETCH_ACCURACY) for name in names]
        row = df.agg(*moments, *sketches).first()
        quartiles = {name: row[len(moments) + at] or [None] * len(QUARTILES) for at, name in enumerate(names)}
    rows = []
    for at, name in enumerate(names):
        count, mean, deviation, low, high = row[5 * at : 5 * at + 5]
        rows.append((name, count, *[_number(value) for value in (mean, deviation, low, *quartiles[name], high)]))
    return local_table(df.sparkSession, rows, schema)


def _number(value: object) -> float | None:
    return None if value is None else float(value)


def show_summary_labels(df: DataFrame, labels_col: str) -> DataFrame:
    """Rows of every class and their share of all rows."""
    classes = KeyTable.of(df, labels_col)
    return classes.frame.withColumn("share", F.col(classes.count_col) / F.lit(classes.total))


def aggregate_by_name(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row with the named aggregate of each column, as ``<aggregate>_<column>``.

    Medians are exact doubles, the mean of the two middle values for an even number of them, found in two passes that count.
    """
    unknown = set(wanted.values()) - {*AGGREGATES, MEDIAN}
    if unknown:
        raise ValueError(f"unsupported aggregates: {sorted(unknown)}")
    plain = {name: AGGREGATES[how](column(name)).alias(f"{how}_{name}") for name, how in wanted.items() if how != MEDIAN}
    medians = [name for name, how in wanted.items() if how == MEDIAN]
    if not medians:
        return df.agg(*plain.values())
    middle, row = exact_quantiles(df, dict.fromkeys(medians, [0.5]), median_ranks, list(plain.values()))
    found = dict(zip(plain, row)) | {name: median_of(middle[name, 0.5]) for name in medians}
    kinds = df.agg(*plain.values()).schema.fields if plain else []
    kinds = {name: field.dataType.simpleString() for name, field in zip(plain, kinds)} | dict.fromkeys(medians, "double")
    schema = ", ".join(f"`{how}_{name}` {kinds[name]}".replace("``", "`") for name, how in wanted.items())
    return local_table(df.sparkSession, [tuple(found[name] for name in wanted)], schema)


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Smallest and largest value of every column, NaN left out, in one job."""
    measures = []
    for name in columns:
        c = column(name)
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast("double"))
        measures += [F.min(c), F.max(c)]
    row = df.agg(*measures).first()
    return {name: (row[2 * at], row[2 * at + 1]) for at, name in enumerate(columns)}


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct whole rows; copies combine before the shuffle."""
    return df.dropDuplicates()

