"""Train and test splits that a row's key decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column
from retentia.functions.uniform import key_columns, keyed_uniform, resolve_seed

Key = str | Sequence[str] | None


def with_split(
    df: DataFrame,
    train_ratio: float = 0.8,
    seed: int | None = None,
    key: Key = None,
    labels_col: str | None = None,
    out: str = "split",
) -> DataFrame:
    """Add ``train`` or ``test`` to every row, in one pass over the table.

    With ``labels_col`` the draw is made anew inside each class, null included.
    Without ``key`` identical rows go the same way.
    """
    strata = [column(labels_col)] if labels_col else []
    draw = keyed_uniform(resolve_seed(seed), *strata, *key_columns(df, key))
    return df.withColumn(out, F.when(draw < train_ratio, "train").otherwise("test"))


def random_split(
    df: DataFrame, train_ratio: float = 0.8, seed: int | None = None, key: Key = None
) -> tuple[DataFrame, DataFrame]:
    return _parts(with_split(df, train_ratio, resolve_seed(seed), key, out="__split"))


def stratified_train_test_split(
    df: DataFrame, labels_col: str, train_ratio: float = 0.8, seed: int | None = None, key: Key = None
) -> tuple[DataFrame, DataFrame]:
    """Independent draws inside each class; no pass per class and no union."""
    return _parts(with_split(df, train_ratio, resolve_seed(seed), key, labels_col, "__split"))


def _parts(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(marked.filter(F.col("__split") == part).drop("__split") for part in ("train", "test"))
