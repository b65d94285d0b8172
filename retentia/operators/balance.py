"""Class weights and random over- and under-sampling.

Each takes one counting job and one pass over the rows; class counts are looked up
per row, never looped over.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.keytable import KeyTable
from retentia.functions.scratch import materialize
from retentia.functions.uniform import key_columns, keyed_uniform, resolve_seed

Key = str | Sequence[str] | None

ROW = "__row_number"

COPIES_PER_CHUNK = 65_536
MODES = ("poisson", "replicate")
# Draws have 52 bits; Poisson(1) exceeds 18 with a probability far below that.
POISSON_TERMS = 19


def class_weights(df: DataFrame, labels_column: str) -> KeyTable:
    """Per class: its rows and the weight total / (classes * rows)."""
    classes = KeyTable.of(df, labels_column)
    return classes.with_values(class_weights=F.lit(float(classes.total)) / (F.lit(classes.rows) * F.col(classes.count_col)))


def compute_class_weights_column(df: DataFrame, labels_column: str) -> DataFrame:
    """Add ``class_weights``; a null label is a class of its own."""
    return class_weights(df, labels_column).attach(df.drop("class_weights"), column(labels_column), ["class_weights"])


def undersample_random(df: DataFrame, labels_column: str, key: Key = None, seed: int | None = None) -> DataFrame:
    """Keep each row with probability smallest class / own class.

    Without ``key`` every row draws for itself, also one that equals another.
    """
    names = df.columns
    df, key = _with_key(df, key)
    classes = KeyTable.of(df, labels_column)
    if classes.rows < 2:
        return df.select(*map(column, names))
    classes = classes.with_values(__share=F.lit(float(classes.smallest)) / F.col(classes.count_col))
    draw = keyed_uniform(resolve_seed(seed), column(labels_column), *key_columns(df, key))
    drawn = df.withColumn("__draw", draw)
    # As a coalesce the test adds no null check, which would compute the draw twice.
    kept = F.coalesce(F.col("__draw") < F.col("__share"), F.lit(False))
    return classes.attach(drawn, column(labels_column), ["__share"]).filter(kept).select(*map(column, names))


def oversample_random(
    df: DataFrame, labels_column: str, key: Key = None, seed: int | None = None, mode: str = "poisson"
) -> DataFrame:
    """Repeat rows so that each class reaches about the size of the largest, which stays as it is.

    With rate = largest / own class a row is repeated Poisson(rate) times (sampling
    with replacement), or with ``mode="replicate"`` floor(rate) times and once more
    with the remaining probability. Without ``key`` every row draws for itself.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    names = df.columns
    df, key = _with_key(df, key)
    classes = KeyTable.of(df, labels_column)
    if classes.rows < 2:
        return df.select(*map(column, names))
    rate = F.lit(float(classes.largest)) / F.col(classes.count_col)
    whole = F.floor(rate).cast("long")
    classes = classes.with_values(
        __whole=whole,
        __rest=rate - whole,
        __cdf=_poisson_cdf(rate - whole),
        __largest=F.col(classes.count_col) == classes.largest,
    )
    keyed = df.withColumn("__id", F.array(*[c.cast("string") for c in key_columns(df, key)]))
    marked = classes.attach(keyed, column(labels_column), ["__whole", "__rest", "__cdf", "__largest"])
    chunk = F.lit(0).cast("long")
    if classes.largest / classes.smallest >= COPIES_PER_CHUNK:
        # One row may become more copies than one task should write: spread its chunks.
        chunks = F.sequence(F.lit(0).cast("long"), F.floor(F.col("__whole") / COPIES_PER_CHUNK).cast("long"))
        marked = marked.withColumn("__chunk", F.explode(chunks)).repartition("__id", "__chunk")
        chunk = F.col("__chunk")
    copies = _copies(mode, resolve_seed(seed), column(labels_column), len(key_columns(df, key)), chunk)
    return (
        marked.withColumn("__copies", F.when(F.col("__largest"), F.lit(1).cast("long")).otherwise(copies))
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("__copies").cast("int"))))
        .select(*map(column, names))
    )


def _with_key(df: DataFrame, key: Key) -> tuple[DataFrame, Key]:
    """Without a key, number the rows; written, so that a row keeps its number."""
    if key is not None:
        return df, key
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered"), ROW


def _copies(mode: str, seed: int, label: Column, key_parts: int, chunk: Column) -> Column:
    """Copies a row's chunk yields: units 0 to whole-1 of rate one, then one of rate rest."""
    ids = [F.col("__id")[at] for at in range(key_parts)]
    whole, rest = F.col("__whole"), F.col("__rest")
    first = chunk * COPIES_PER_CHUNK
    last = F.least(first + (COPIES_PER_CHUNK - 1), whole)
    if mode == "replicate":
        partial = (last == whole) & (keyed_uniform(seed, label, *ids) < rest)
        return F.least(last + 1, whole) - first + F.when(partial, 1).otherwise(0)
    unit_cdf = F.array(*[F.lit(value) for value in UNIT_POISSON_CDF])

    def drawn(unit: Column) -> Column:
        draw = keyed_uniform(seed, label, *ids, unit)
        cdf = F.when(unit < whole, unit_cdf).otherwise(F.col("__cdf"))
        return F.size(F.filter(cdf, lambda bound: draw >= bound)).cast("long")

    return F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda total, unit: total + drawn(unit))


def _poisson_cdf(mean: Column) -> Column:
    terms = [F.pow(mean, F.lit(n)) / math.factorial(n) for n in range(POISSON_TERMS)]
    return F.array(*[F.exp(-mean) * sum(terms[1:upto], terms[0]) for upto in range(1, POISSON_TERMS + 1)])


UNIT_POISSON_CDF = [
    math.exp(-1) * sum(1 / math.factorial(n) for n in range(upto)) for upto in range(1, POISSON_TERMS + 1)
]
