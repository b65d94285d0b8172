"""Missing values: counting every kind of them, and cleaning a table of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column
from retentia.functions.ordering import exact_quantiles, median_of, median_ranks
from retentia.operators.profile import AGGREGATES, MEDIAN, long_form

# The two ways to treat nulls that no rule fills. The names of kinds and report columns below are fixed, too.
BEHAVIORS = ("drop_rows", "drop_cols")


def missing_kinds(field: T.StructField) -> list[tuple[str, Column]]:
    """The tests for missing values that apply to a column's type, by report name.

    Text markers only make sense on strings, and under ANSI rules comparing other
    types with text fails; NaN exists in floating-point columns and as text.
    """
    c = column(field.name)
    is_null = ("Null", c.isNull())
    if isinstance(field.dataType, T.StringType):
        return [
            ("None", c.contains("None")),
            ("NULL_string", c.contains("NULL")),
            ("Empty_string", c == ""),
            is_null,
            ("NaN", F.isnan(c.try_cast("double"))),
        ]
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return [is_null, ("NaN", F.isnan(c))]
    return [is_null]


def get_missing_values_count(df: DataFrame, denominator: str = "rows") -> DataFrame:
    """``(Column, Type, Count, Percentage)`` of every kind of missing value that occurs.

    Percentages are of all rows, or with ``denominator="non_null"`` of the non-null
    ones (null where there are none). One aggregation for the whole table.
    """
    if denominator not in ("rows", "non_null"):
        raise ValueError("denominator must be 'rows' or 'non_null'")
    measures, rows = [F.count(F.lit(1)).alias("total")], []
    for at, field in enumerate(df.schema.fields):
        base = "total"
        if denominator == "non_null":
            base = f"non_null{at}"
            measures.append(F.count(column(field.name)).alias(base))
        for kind, condition in missing_kinds(field):
            name = f"{kind}{at}"
            measures.append(F.count_if(condition).alias(name))
            rows.append(
                {
                    "Column": F.lit(field.name),
                    "Type": F.lit(kind),
                    "Count": F.col(name),
                    "Percentage": F.try_divide(F.col(name) * 100.0, F.col(base).cast("double")),
                }
            )
    return long_form(df.agg(*measures), rows).filter(F.col("Count") > 0)


def show_summary_nulls(df: DataFrame) -> DataFrame:
    """The missing-value report."""
    return get_missing_values_count(df)


def missing_any(df: DataFrame) -> DataFrame:
    """One row: for every column, the rows with any kind of missing value in it."""

    def any_kind(field: T.StructField) -> Column:
        tests = [F.coalesce(test, F.lit(False)) for _, test in missing_kinds(field)]
        return reduce(lambda left, right: left | right, tests)

    return df.agg(*[F.count_if(any_kind(field)).alias(field.name) for field in df.schema.fields])


def get_null_counts(df: DataFrame, with_percentages: bool = False) -> DataFrame:
    """One row: ``<c>_nulls`` per column and, if asked, ``<c>_nulls%`` as a fraction of the rows."""
    counts = [F.count_if(column(name).isNull()).alias(f"{name}_nulls") for name in df.columns]
    if not with_percentages:
        return df.agg(*counts)
    shares = [
        F.try_divide(F.count_if(column(name).isNull()), F.count(F.lit(1))).alias(f"{name}_nulls%") for name in df.columns
    ]
    return df.agg(*counts, *shares)


def drop_null_values(df: DataFrame) -> DataFrame:
    """Rows without a null or NaN."""
    return df.na.drop()


def clean_nulls(
    df: DataFrame,
    row_threshold: float,
    column_threshold: float,
    default_values: dict | None = None,
    unaccounted_nulls_behavior: str = "drop_rows",
) -> DataFrame:
    """Remove nulls: drop sparse columns, then sparse rows, fill by rule, drop what is left.

    A column goes if its null share exceeds ``column_threshold``. A row stays with at
    least ``int(columns * (1 - row_threshold))`` values that are neither null nor NaN;
    the product is truncated, so ten columns at 0.9 keep every row. Columns that still
    hold nulls are filled from ``default_values``: a constant, or one of sum, count,
    avg, min, max, median computed on the rows left. If nulls remain, their rows or
    their columns are dropped. Two aggregation jobs decide all of it; exact medians
    add one pass that counts.
    """
    if unaccounted_nulls_behavior not in BEHAVIORS:
        raise AssertionError(f"unaccounted_nulls_behavior must be one of {BEHAVIORS}")
    defaults = dict(default_values or {})
    first = df.agg(F.count(F.lit(1)), *[F.count_if(column(name).isNull()) for name in df.columns]).first()
    total, nulls = first[0], dict(zip(df.columns, first[1:]))
    if total == 0:
        return df
    df = df.drop(*[name for name in df.columns if nulls[name] / total > column_threshold])
    df = df.dropna(thresh=int(len(df.columns) * (1 - row_threshold)))

    # Rows only get fewer, so a column without nulls stays without.
    suspects = [name for name in df.columns if nulls[name] > 0]
    if not suspects:
        return df
    by_aggregate = {name: defaults[name] for name in suspects if _is_aggregate(defaults.get(name))}
    medians = [name for name, how in by_aggregate.items() if how == MEDIAN]
    others = [name for name in by_aggregate if name not in medians]
    measures = [F.count_if(column(name).isNull()) for name in suspects]
    measures += [AGGREGATES[by_aggregate[name]](column(name)) for name in others]
    if medians:
        middle, second = exact_quantiles(df, dict.fromkeys(medians, [0.5]), median_ranks, measures)
    else:
        middle, second = {}, df.agg(*measures).first()
    open_nulls = {name for name, count in zip(suspects, second) if count > 0}
    computed = dict(zip(others, second[len(suspects) :]))
    computed |= {name: median_of(values) for (name, _), values in middle.items()}

    fills = {}
    for name in suspects:
        if name in open_nulls and name in defaults:
            value = computed[name] if name in by_aggregate else defaults[name]
            if value is not None:  # the aggregate of an empty column fills nothing
                fills[name] = value
    plain = {name: value for name, value in fills.items() if isinstance(value, (bool, int, float, str))}
    if plain:
        df = df.fillna(plain)
    for name in fills.keys() - plain.keys():  # decimals and times, which fillna does not take
        df = df.withColumn(name, F.coalesce(column(name), F.lit(fills[name]).cast(df.schema[name].dataType)))
    left = [name for name in df.columns if name in open_nulls and name not in fills]
    if not left:
        return df
    return df.dropna(how="any") if unaccounted_nulls_behavior == "drop_rows" else df.drop(*left)


def _is_aggregate(value: object) -> bool:
    return isinstance(value, str) and value in (*AGGREGATES, MEDIAN)
