"""Indexing, one-hot encoding, scaling and vector assembly."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexerModel, VectorAssembler, VectorIndexer, VectorIndexerModel, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column
from retentia.functions.keytable import BROADCAST_BYTES, BROADCAST_ROWS, KeyTable
from retentia.functions.ordering import running_total
from retentia.functions.scratch import local_table, materialize
from retentia.operators.profile import column_ranges

INVALID = ("error", "skip", "keep")
INDEX, VALUE, SHORT = "__index", "__value", "__short"
Pairs = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class TableIndexer:
    """Index of a vocabulary too large for the driver: a table of values, counts and indexes."""

    input_col: str
    output_col: str
    table: KeyTable
    size: int
    handle_invalid: str = "error"

    def transform(self, df: DataFrame) -> DataFrame:
        text = column(self.input_col).cast("string")
        indexed = self.table.attach(df, text, [INDEX])
        keep = self.handle_invalid == "keep"
        if self.handle_invalid == "skip":
            indexed = indexed.filter(F.col(INDEX).isNotNull())
        fallback = {
            "error": F.raise_error(F.lit(f"null or unseen value in column {self.input_col}")).cast("double"),
            "keep": F.lit(float(self.size)),
            "skip": F.lit(None).cast("double"),
        }[self.handle_invalid]
        index = F.when(F.col(INDEX).isNull(), fallback).otherwise(F.col(INDEX))
        attribute = {"ml_attr": {"type": "nominal", "name": self.output_col, "num_vals": self.size + keep}}
        return indexed.withColumn(self.output_col, index.alias(self.output_col, metadata=attribute)).select(
            *[column(name) for name in df.columns], column(self.output_col)
        )

    def revert(self, df: DataFrame, index_col: str, out: str) -> DataFrame:
        values = self.table.frame.select(INDEX, F.col("value").alias(VALUE), "count")
        by_index = KeyTable(values, INDEX, stored=True)
        found = by_index.attach(df, column(index_col), [VALUE])
        unknown = F.raise_error(F.concat(F.lit("no value for index "), column(index_col).cast("string"))).cast("string")
        known = F.when(column(index_col).isNotNull() & F.col(VALUE).isNull(), unknown).otherwise(F.col(VALUE))
        return found.withColumn(out, known).select(*[column(name) for name in (*df.columns, out)])


@dataclass(frozen=True)
class IndexerModel:
    """Fitted indexes by output column: driver-side labels, or a table for large vocabularies."""

    outputs: tuple[str, ...]
    natives: dict[str, StringIndexerModel]
    tables: tuple[TableIndexer, ...] = ()

    def labels(self, output_col: str) -> list[str]:
        """Values in order of their index, where they are few enough for the driver; ``catalogue`` always works."""
        if output_col not in self.natives:
            raise ValueError(f"no labels on the driver for {output_col}; use catalogue")
        return list(self.natives[output_col].labels)

    def catalogue(self, spark: SparkSession, output_col: str) -> DataFrame:
        """``(item_index, item)`` of an index column, however many values it has."""
        table = self.table(output_col)
        if table is None:
            return local_table(spark, list(enumerate(self.labels(output_col))), "item_index bigint, item string")
        return table.table.frame.select(F.col(INDEX).cast("long").alias("item_index"), F.col("value").alias("item"))

    def table(self, output_col: str) -> TableIndexer | None:
        return next((table for table in self.tables if table.output_col == output_col), None)

    def sizes(self) -> dict[str, int]:
        return {out: len(model.labels) for out, model in self.natives.items()} | {
            table.output_col: table.size for table in self.tables
        }

    def transform(self, df: DataFrame) -> DataFrame:
        before = df.columns
        for model in (*self.natives.values(), *self.tables):
            df = model.transform(df)
        # Slots of one-hot vectors are named by these attributes: alike for vocabularies of any size.
        for out, model in self.natives.items():
            size = len(model.labels) + (model.getHandleInvalid() == "keep")
            attribute = {"ml_attr": {"type": "nominal", "name": out, "num_vals": size}}
            df = df.withColumn(out, column(out).alias(out, metadata=attribute))
        return df.select(*[column(name) for name in (*before, *self.outputs)])


def fit_string_index(
    df: DataFrame, columns_to_string_index: Pairs, handle_invalid: str = "error", driver_labels: int = BROADCAST_ROWS
) -> IndexerModel:
    """Indexes by descending frequency, ties by value, for all columns in one counting job.

    Vocabularies of up to ``driver_labels`` values together become ordinary
    ``StringIndexerModel`` objects. Larger ones are ranked by a range-partitioned sort and
    applied by join, so their labels never meet on the driver.
    """
    if handle_invalid not in INVALID:
        raise ValueError(f"handle_invalid must be one of {INVALID}")
    pairs = list(columns_to_string_index)
    outputs = tuple(out for _, out in pairs)
    names = list(dict.fromkeys(name for name, _ in pairs))
    if not names:
        return IndexerModel(outputs, {})
    texts = df.select(*[column(name).cast("string").alias(name) for name in names])
    counts = (
        texts.unpivot([], names, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    ).persist()
    measured = counts.groupBy("column").agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).collect()
    sizes = {name: size for name, size, _ in measured}
    few, room, bytes_room = [], driver_labels, BROADCAST_BYTES
    for name, size, width in sorted([(name, 0, 0) for name in names if name not in sizes] + measured, key=lambda m: m[1]):
        if size <= room and width <= bytes_room:
            few.append(name)
            room, bytes_room = room - size, bytes_room - width
    large = [name for name in names if name not in few]
    labels: dict[str, list[tuple[int, str]]] = {name: [] for name in few}
    if few:
        for row in counts.filter(F.col("column").isin(few)).collect():
            labels[row["column"]].append((-row["count"], row["value"]))
    natives = {
        out: StringIndexerModel.from_labels([value for _, value in sorted(labels[name])], name, out, handle_invalid)
        for name, out in pairs
        if name in few
    }
    tables = []
    if large:
        positions = running_total(
            counts.filter(F.col("column").isin(large)),
            ["column"],
            [F.col("count").desc(), F.col("value").asc()],
            F.lit(1).cast("long"),
            "position",
        )
        index = F.col("position").cast("double").alias(INDEX)
        ranked = materialize(positions.select("column", "value", "count", index), "index", ["column"])
        by_column = {
            name: KeyTable(ranked.filter(F.col("column") == name).drop("column"), "value", stored=True) for name in large
        }
        tables = [
            TableIndexer(name, out, by_column[name], sizes[name], handle_invalid) for name, out in pairs if name in large
        ]
    counts.unpersist()
    return IndexerModel(outputs, natives, tuple(tables))


def string_index_columns(
    df: DataFrame, columns_to_string_index: Pairs, handle_invalid: str = "error", driver_labels: int = BROADCAST_ROWS
) -> tuple[DataFrame, IndexerModel]:
    """Add an index column per ``(input, output)`` pair; numeric inputs are indexed as text."""
    model = fit_string_index(df, columns_to_string_index, handle_invalid, driver_labels)
    return model.transform(df), model


def revert_string_index(df: DataFrame, columns_to_revert: Pairs, model: IndexerModel) -> DataFrame:
    """Add the original strings of index columns, by the model that made them."""
    for index_col, out in columns_to_revert:
        table = model.table(index_col)
        if table is not None:
            df = table.revert(df, index_col, out)
        else:
            df = IndexToString(inputCol=index_col, outputCol=out, labels=model.labels(index_col)).transform(df)
    return df


def encoded_index_columns(df: DataFrame, columns_to_encode: Pairs) -> tuple[DataFrame, Transformer]:
    """One-hot vectors of index columns, last category dropped, one fit for all."""
    pairs = list(columns_to_encode)
    model = OneHotEncoder(inputCols=[name for name, _ in pairs], outputCols=[out for _, out in pairs]).fit(df)
    return model.transform(df), model


def boolean_index_columns(df: DataFrame, columns_to_boolean_index: Pairs) -> DataFrame:
    """1 for true, 0 for false or null."""
    added = {}
    for name, out in columns_to_boolean_index:
        data_type = df.schema[name].dataType
        if not isinstance(data_type, T.BooleanType):
            raise ValueError(f"column {name} is {data_type.simpleString()}, not boolean")
        added[out] = F.when(column(name), 1).otherwise(0)
    return df.withColumns(added)


def vector_feature_column(df: DataFrame, feature_cols: Sequence[str], output_col: str) -> DataFrame:
    """Assemble a feature vector; rows with a null or NaN feature are skipped."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=output_col, handleInvalid="skip").transform(df)


def vector_index_column(
    df: DataFrame, vector_col: str, output_col: str, max_categories: int = 5
) -> tuple[DataFrame, Transformer]:
    """Re-index vector slots with few distinct values as categories."""
    df, (model,) = vector_index_columns(df, [(vector_col, output_col)], max_categories)
    return df, model


def vector_index_columns(df: DataFrame, columns_to_index: Pairs, max_categories: int = 5) -> tuple[DataFrame, list[Transformer]]:
    """The same for several vector columns in one pass, ``(input, output)`` pairs.

    Slots that the attributes call binary, such as those of one-hot vectors, have the categories 0 and 1 and are not looked at.
    The other slots of all vectors are cut out into one short vector, and each task holds at most
    ``max_categories`` values of a slot and gives it up beyond.
    """
    limit = max(2, max_categories)
    cut, parts, places = df, [], []
    for at, (name, _) in enumerate(columns_to_index):
        size, binary = _slots(df, name)
        looked_at = [slot for slot in range(size) if slot not in binary]
        places.append((size, binary, looked_at))
        if looked_at:
            parts.append(f"__slots{at}")
            whole = len(looked_at) == size
            cut = cut.withColumn(parts[-1], column(name)) if whole else VectorSlicer(inputCol=name, outputCol=parts[-1], indices=looked_at).transform(cut)
    found: dict = {}
    if parts:
        short = VectorAssembler(inputCols=parts, outputCol=SHORT).transform(cut.select(*parts)).select(SHORT)
        found = VectorIndexer(inputCol=SHORT, outputCol="__out", maxCategories=limit).fit(short).categoryMaps
    models, start = [], 0
    for (name, out), (size, binary, looked_at) in zip(columns_to_index, places):
        maps = {slot: found[start + turn] for turn, slot in enumerate(looked_at) if start + turn in found}
        maps |= {slot: {0.0: 0, 1.0: 1} for slot in binary}
        start += len(looked_at)
        models.append(_index_model(df.sparkSession, name, out, size, maps))
        df = models[-1].transform(df)
    return df, models


def _slots(df: DataFrame, name: str) -> tuple[int, set[int]]:
    """Size of a vector column, and its slots that are known to be 0 or 1."""
    attributes = df.schema[name].metadata.get("ml_attr", {})
    size = attributes.get("num_attrs")
    if size is None:
        first = df.select(column(name)).filter(column(name).isNotNull()).first()
        size = first[0].size if first else 0
    return size, {slot["idx"] for slot in attributes.get("attrs", {}).get("binary", [])}


def _index_model(spark: SparkSession, name: str, out: str, size: int, maps: dict[int, dict[float, int]]) -> VectorIndexerModel:
    """Spark's model from its category maps."""
    jvm = spark.sparkContext._jvm
    held = jvm.java.util.HashMap()
    # Equal maps, as those of binary slots, are made once.
    made: dict[tuple, object] = {}
    for slot, values in maps.items():
        key = tuple(values.items())
        if key not in made:
            inner = jvm.java.util.HashMap()
            for value, index in key:
                inner.put(float(value), index)
            made[key] = jvm.PythonUtils.toScalaMap(inner)
        held.put(slot, made[key])
    uid = f"VectorIndexer_{uuid.uuid4().hex[:12]}"
    java = jvm.org.apache.spark.ml.feature.VectorIndexerModel(uid, size, jvm.PythonUtils.toScalaMap(held))
    return VectorIndexerModel(java).setInputCol(name).setOutputCol(out)


def min_max_expressions(ranges: dict[str, tuple[float | None, float | None]]) -> dict[str, Column]:
    scaled = {}
    for name, (low, high) in ranges.items():
        low_value = F.lit(None if low is None else float(low)).cast("double")
        width = F.lit(None if low is None else float(high) - float(low)).cast("double")
        scaled[f"{name}_normalized"] = F.try_divide(column(name).cast("double") - low_value, width)
    return scaled


def normalize_min_max_values(features_to_normalize: Sequence[str], df: DataFrame) -> DataFrame:
    """Add ``<c>_normalized`` in [0, 1] per column; null where the column is constant."""
    return df.withColumns(min_max_expressions(column_ranges(df, list(features_to_normalize))))


def churn(df: DataFrame, label: str, null_boolean_as: int = 1) -> tuple[DataFrame, IndexerModel | None]:
    """Prepare a label by its type: ``indexed_<c>``, or ``<c>_booleantointeger``.

    A label that is not a column leaves the table unchanged; one of any other type
    is an error.
    """
    if label not in df.columns:
        return df, None
    data_type = df.schema[label].dataType
    if isinstance(data_type, T.BooleanType):
        number = F.when(column(label), 1).when(~column(label), 0).otherwise(null_boolean_as)
        return df.withColumn(f"{label}_booleantointeger", number), None
    if isinstance(data_type, (T.StringType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
        return string_index_columns(df, [(label, f"indexed_{label}")])
    raise ValueError(f"label {label} of type {data_type.simpleString()} cannot be prepared")


def churn_inverter(df: DataFrame, label: str) -> DataFrame:
    """Replace a label by ``<c>_inverted``: 1 where it is 0, otherwise 0."""
    return df.withColumn(f"{label}_inverted", F.when(column(label) == 0, 1).otherwise(0)).drop(label)
