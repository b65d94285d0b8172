"""From a raw labelled table to balanced training data and a test set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import column, columns_types
from retentia.functions.scratch import materialize
from retentia.functions.uniform import key_columns, resolve_seed
from retentia.operators.balance import compute_class_weights_column, oversample_random, undersample_random
from retentia.operators.encode import encoded_index_columns, fit_string_index, min_max_expressions, vector_feature_column
from retentia.operators.missing import clean_nulls
from retentia.operators.nearmiss import undersample_nearmiss_v2
from retentia.operators.profile import column_ranges, drop_duplicate_rows
from retentia.operators.split import with_split

# The accepted words of the three options.
CATEGORICAL = {None: None, "index": "index", "indexing": "index", "encode": "encode", "encoding": "encode"}
NUMERICAL = (None, "normalize")
REBALANCING = (None, "undersample_random", "oversample_random", "nearmiss_v2", "class_weights")
FIT_ON = ("all", "train")
ROW_KEY, SPLIT = "__row_key", "__split"


class Prepared(tuple):
    """``(train, test)``, with the names of the columns ``left_out`` of the features."""

    left_out: list[str]

    def __new__(cls, parts: tuple[DataFrame, DataFrame], left_out: list[str]) -> Prepared:
        prepared = super().__new__(cls, parts)
        prepared.left_out = left_out
        return prepared


def preprocess_data(
    df: DataFrame,
    labels_col: str,
    clean_nulls_options: dict,
    transformation_categorical: str | None = None,
    transformation_numerical: str | None = None,
    stratified_split: bool = False,
    train_split_ratio: float = 0.8,
    rebalancing_technique: str | None = None,
    resampling_options: dict | None = None,
    seed: int | None = None,
    key: str | Sequence[str] | None = None,
    fit_on: str = "all",
) -> Prepared:
    """Clean, de-duplicate, encode, scale, assemble, split and rebalance.

    Returns the training and the test part. The slots of ``features`` are the categorical
    columns, then the numeric ones (decimal, short and byte among them), the boolean ones, and vectors,
    each group in the order of the table. ``left_out`` of the result names the columns that could
    not become features: one-hot encoded ones with a single value and scaled ones that are constant.
    Both results have ``features`` and the label (``<label>_index`` for text labels).
    Rebalancing applies to the training part only. ``key`` columns identify rows and
    are no features; without them a row is identified by its content, which is unique
    after de-duplication. ``fit_on="train"`` learns indexes and ranges from the
    training rows alone; test rows with unseen categories are then left out.
    """
    for value, allowed in (
        (transformation_categorical, CATEGORICAL),
        (transformation_numerical, NUMERICAL),
        (rebalancing_technique, REBALANCING),
        (fit_on, FIT_ON),
    ):
        if value not in allowed:
            raise ValueError(f"unknown option {value!r}; expected one of {[word for word in allowed if word]}")
    how = CATEGORICAL[transformation_categorical]
    seed = resolve_seed(seed)

    cleaned = drop_duplicate_rows(clean_nulls(df, **clean_nulls_options))
    keys = [key] if isinstance(key, str) else list(key or [])
    parts = key_columns(cleaned, keys or None)
    # JSON keeps the parts of a composite key apart, nulls too.
    row_key = parts[0] if len(parts) == 1 else F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    marked = cleaned.withColumn(ROW_KEY, row_key)
    marked = with_split(marked, train_split_ratio, seed, ROW_KEY, labels_col if stratified_split else None, SPLIT)
    # Read by every fit below and by both results.
    rows = materialize(marked, "cleaned")
    sample = rows.filter(F.col(SPLIT) == "train") if fit_on == "train" else rows

    groups = columns_types(rows.drop(ROW_KEY, SPLIT, *keys), wide_numeric=True)
    vectors = [f.name for f in rows.schema.fields if isinstance(f.dataType, VectorUDT) and f.name not in (labels_col, *keys)]
    categorical = [name for name in groups["categorical_cols"] if name != labels_col]
    numerical = [name for name in groups["numeric_cols"] if name != labels_col]
    others = [name for name in rows.columns if name not in (ROW_KEY, SPLIT, labels_col, *keys, *categorical, *numerical)]
    unusable = [name for name in others if name not in groups["boolean_cols"] + vectors] + (categorical if how is None else [])
    if unusable:
        raise ValueError(f"columns cannot become features as they are: {unusable}; drop or transform them first")

    label = labels_col
    pairs = [(name, f"{name}_index") for name in categorical] if how else []
    if labels_col in groups["categorical_cols"]:
        label = f"{labels_col}_index"
        pairs = [*pairs, (labels_col, label)]
    features: list[str] = []
    left_out: list[str] = []
    if pairs:
        indexer = fit_string_index(sample, pairs, handle_invalid="skip" if fit_on == "train" else "error")
        sample, rows = indexer.transform(sample), indexer.transform(rows)
    if how == "index":
        features += [f"{name}_index" for name in categorical]
    elif how == "encode":
        encodable = [name for name in categorical if indexer.sizes()[f"{name}_index"] > 1]
        if encodable:
            _, encoder = encoded_index_columns(sample, [(f"{name}_index", f"{name}_encoded") for name in encodable])
            rows = encoder.transform(rows)
        features += [f"{name}_encoded" for name in encodable]
        left_out += [name for name in categorical if name not in encodable]
    if transformation_numerical == "normalize" and numerical:
        ranges = column_ranges(sample, numerical)
        # A constant column scales to null, and a null feature would cost its row.
        scaled = min_max_expressions({name: (low, high) for name, (low, high) in ranges.items() if low != high})
        rows = rows.withColumns(scaled)
        features += list(scaled)
        left_out += [name for name, (low, high) in ranges.items() if low == high]
    else:
        features += numerical
    features += [name for name in groups["boolean_cols"] if name != labels_col] + vectors

    assembled = vector_feature_column(rows, features, "features").select(
        "features", column(label), ROW_KEY, SPLIT
    )
    train = assembled.filter(F.col(SPLIT) == "train").drop(SPLIT)
    test = assembled.filter(F.col(SPLIT) == "test").drop(SPLIT, ROW_KEY)
    options = dict(resampling_options or {})
    if rebalancing_technique == "undersample_random":
        train = undersample_random(train, label, ROW_KEY, seed, **options)
    elif rebalancing_technique == "oversample_random":
        train = oversample_random(train, label, ROW_KEY, seed, **options)
    elif rebalancing_technique == "nearmiss_v2":
        train = undersample_nearmiss_v2(train, "features", label, key=ROW_KEY, **options)
    elif rebalancing_technique == "class_weights":
        train = compute_class_weights_column(train, label)
    return Prepared((train.drop(ROW_KEY), test), left_out)
