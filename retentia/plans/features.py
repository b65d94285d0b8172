"""Feature vectors for tree models, with class weights."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retentia.functions.columns import columns_types
from retentia.functions.scratch import materialize
from retentia.operators.balance import compute_class_weights_column
from retentia.operators.correlate import vector_correlation
from retentia.operators.encode import (
    IndexerModel,
    Pairs,
    boolean_index_columns,
    encoded_index_columns,
    fit_string_index,
    string_index_columns,
    vector_feature_column,
    vector_index_columns,
)
from retentia.operators.profile import distinct_counts

# The names of the produced columns and the default category limit.
LABEL_INDEX = "Churn_Index"
INDEXED = "IndexedFeatures"
ENCODED = "IndexedEncodedFeatures"
VECTOR_INDEXED = "VectorIndexedFeatures"
VECTOR_ENCODED = "VectorIndexedEncodedFeatures"
WEIGHTS = "class_weights"
MAX_CATEGORIES = 5


class FeatureVectors(NamedTuple):
    df: DataFrame
    indexed_col: str
    encoded_col: str
    label_col: str
    weight_col: str
    indexer: IndexerModel
    not_encoded: list[str]


def get_indexed_and_encode_vectors(df: DataFrame, feature_cols: Sequence[str], label_col: str) -> FeatureVectors:
    """Index, one-hot encode, weigh and assemble the features.

    Categorical features come first in the vectors, then boolean, then numeric ones.
    Features with a single value cannot be one-hot encoded; they are left out of the
    encoded vector and named in ``not_encoded``. The table is written first, as several fits read it.
    """
    df = materialize(df, "features")
    groups = columns_types(df)
    numeric, categorical, boolean = (
        [name for name in groups[group] if name in feature_cols]
        for group in ("numeric_cols", "categorical_cols", "boolean_cols")
    )
    label_type = df.schema[label_col].dataType
    label_is_text, label_is_boolean = isinstance(label_type, T.StringType), isinstance(label_type, T.BooleanType)
    if not (label_is_text or label_is_boolean or label_col in groups["numeric_cols"]):
        raise ValueError(f"label {label_col} of type {label_type.simpleString()} is not supported")

    text_pairs = [(name, f"{name}Index") for name in categorical]
    indexer = fit_string_index(df, text_pairs + ([(label_col, LABEL_INDEX)] if label_is_text else []))
    boolean_pairs = [(name, f"{name}Index") for name in boolean]
    boolean_counts = (
        {row["column"]: row["distinct_values"] for row in distinct_counts(df, boolean).collect()} if boolean else {}
    )
    max_categories = MAX_CATEGORIES
    if categorical or boolean:
        sizes = indexer.sizes()
        max_categories = max(2, *[sizes[out] for _, out in text_pairs], *boolean_counts.values())

    out = indexer.transform(df)
    out = boolean_index_columns(out, boolean_pairs + ([(label_col, LABEL_INDEX)] if label_is_boolean else []))
    new_label = LABEL_INDEX if label_is_text or label_is_boolean else label_col
    single = [index for _, index in text_pairs if indexer.sizes()[index] < 2]
    single += [index for name, index in boolean_pairs if boolean_counts[name] < 2]
    to_encode = [(index, f"{index}Encoded") for _, index in text_pairs + boolean_pairs if index not in single]
    if to_encode:
        out, _ = encoded_index_columns(out, to_encode)
    out = compute_class_weights_column(out, new_label)
    out = vector_feature_column(out, [index for _, index in text_pairs + boolean_pairs] + numeric, INDEXED)
    out = vector_feature_column(out, [encoded for _, encoded in to_encode] + numeric, ENCODED)
    out, _ = vector_index_columns(out, [(INDEXED, VECTOR_INDEXED), (ENCODED, VECTOR_ENCODED)], max_categories)
    return FeatureVectors(out, VECTOR_INDEXED, VECTOR_ENCODED, new_label, WEIGHTS, indexer, single)


def process_data_to_model(
    df: DataFrame,
    columns_to_string_index: Pairs,
    columns_to_encode: Pairs,
    feature_cols: Sequence[str],
    label_col: str,
    drop: Sequence[str] = (),
    output_col: str = "features",
) -> tuple[DataFrame, IndexerModel]:
    """Drop columns, index the label and the given columns, encode, weigh and assemble."""
    df = df.drop(*drop)
    df, model = string_index_columns(df, [*columns_to_string_index, (label_col, LABEL_INDEX)])
    df = df.drop(label_col)
    df, _ = encoded_index_columns(df, columns_to_encode)
    df = compute_class_weights_column(df, LABEL_INDEX)
    return vector_feature_column(df, feature_cols, output_col), model


def show_correlation_matrix(df: DataFrame, label_col: str, correlation_method: str) -> DataFrame:
    """Correlations between all features after indexing, as ``(row_name, col_name, correlation)``."""
    vectors = get_indexed_and_encode_vectors(df, df.columns, label_col)
    return vector_correlation(vectors.df, vectors.indexed_col, correlation_method)
