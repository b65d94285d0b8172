"""Random numbers as a function of a seed and a row key.

A row always draws the same number, whatever partition it is in and however
often its task runs, so splits and samples stay consistent when an executor is
lost and can be restated in plain SQL.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column, hashable_columns

NULL_TEXT = "\\N"
HEX_DIGITS = 13
TWO_POW_52 = 4503599627370496.0


def resolve_seed(seed: int | None) -> int:
    """``seed``, or a fresh one when the caller does not care."""
    return random.SystemRandom().getrandbits(31) if seed is None else seed


def key_columns(df: DataFrame, key: str | Sequence[str] | None) -> list[Column]:
    """Columns identifying a row; without a key, a digest of the whole row."""
    if key is None:
        return [row_digest(df)]
    names = [key] if isinstance(key, str) else list(key)
    return [column(name) for name in names]


def row_digest(df: DataFrame) -> Column:
    """Text identifying a row by its content; identical rows share it.

    Spark's hashes skip nulls, so where the nulls are is hashed as well.
    """
    columns = hashable_columns(df)
    columns += [F.struct(*[c.isNull() for c in columns])] if columns else []
    return F.concat_ws("-", F.xxhash64(*columns).cast("string"), F.hash(*columns).cast("string"))


def keyed_uniform(seed: int, *columns: Column) -> Column:
    """Uniform number in [0, 1) with 52 bits, all of which a double holds, from the md5 of seed and columns."""
    parts = [F.lit(str(seed))]
    parts += [F.coalesce(column.cast("string"), F.lit(NULL_TEXT)) for column in columns]
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(TWO_POW_52)
