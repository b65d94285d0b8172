"""Column groups and ML attribute metadata; reads schemas only, runs no job."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.IntegerType, T.FloatType, T.DoubleType, T.LongType)
WIDE_NUMERIC = NUMERIC + (T.ByteType, T.ShortType, T.DecimalType)

# The six group names of the public report.
GROUPS = ("numeric_cols", "categorical_cols", "boolean_cols", "array_cols", "struct_cols", "unknown_cols")


def column_group(data_type: T.DataType, wide_numeric: bool = False) -> str:
    if isinstance(data_type, WIDE_NUMERIC if wide_numeric else NUMERIC):
        return "numeric_cols"
    if isinstance(data_type, T.StringType):
        return "categorical_cols"
    if isinstance(data_type, T.BooleanType):
        return "boolean_cols"
    if isinstance(data_type, T.ArrayType):
        return "array_cols"
    if isinstance(data_type, T.StructType):
        return "struct_cols"
    return "unknown_cols"


def columns_types(df: DataFrame, wide_numeric: bool = False) -> dict[str, list[str]]:
    """Column names by group; ``wide_numeric`` also counts byte, short and decimal as numeric."""
    groups: dict[str, list[str]] = {name: [] for name in GROUPS}
    for field in df.schema.fields:
        groups[column_group(field.dataType, wide_numeric)].append(field.name)
    return groups


def column(name: str) -> Column:
    """Reference to a top-level column, dots in its name included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable_columns(df: DataFrame) -> list[Column]:
    """The columns Spark can hash: all but maps."""
    return [column(field.name) for field in df.schema.fields if "map<" not in field.dataType.simpleString()]


def as_double_array(df: DataFrame, name: str) -> Column:
    """A vector or numeric array column as ``array<double>``."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return vector_to_array(column(name))
    return column(name).cast("array<double>")


def slot_names(df: DataFrame, vector_col: str) -> list[str]:
    """Names of the slots of an assembled vector, from its ML attributes."""
    attributes = df.schema[vector_col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted(
        (slot for group in attributes.values() for slot in group), key=lambda slot: slot["idx"]
    )
    return [slot.get("name", f"{vector_col}_{slot['idx']}") for slot in slots]
