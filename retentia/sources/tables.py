"""Tables and fitted models by path; local folders and object-store URIs alike."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import column

# The accepted suffixes and the reader each one selects.
READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".json.gz": "json"}
# Text formats write times to the millisecond unless told otherwise.
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
# CSV that keeps line breaks, quotes, blanks at either end, and the difference between null and empty text.
NULL_TEXT = "\\N"
LOSSLESS_CSV = {
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": NULL_TEXT,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def format_of(path: str) -> str:
    for suffix, reader in READERS.items():
        if path.rstrip("/").endswith(suffix):
            return reader
    raise ValueError(f"unsupported file format: {path!r}; expected one of {', '.join(READERS)}")


def load_data(
    path: str,
    spark: SparkSession,
    *,
    schema: T.StructType | str | None = None,
    infer: bool = True,
    delimiter: str | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """Read a CSV (with header), JSON or Parquet table, chosen by the suffix of ``path``.

    A declared ``schema`` saves the extra pass over the data that inference needs;
    with ``infer=False`` and no schema, CSV columns are strings.
    """
    source = format_of(path)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if source == "csv":
        reader = reader.option("header", True).option("inferSchema", infer and schema is None)
        if delimiter is not None:
            reader = reader.option("delimiter", delimiter)
    df = reader.format(source).load(path)
    return df.repartition(partitions) if partitions else df


def save_data(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """Write a table in the format its suffix names; ``.json.gz`` and CSV headers included."""
    target = format_of(path)
    writer = df.write.mode(mode).options(**({} if target == "parquet" else MICROSECONDS) | options)
    if target == "csv":
        writer = writer.option("header", True)
    if path.rstrip("/").endswith(".gz"):
        writer = writer.option("compression", "gzip")
    writer.format(target).save(path)


def convert_table(
    source: str,
    target: str,
    spark: SparkSession,
    *,
    schema: T.StructType | str,
    mode: str = "errorifexists",
    **options: str,
) -> DataFrame:
    """Rewrite a table in another format under a declared schema and read it back.

    ``options`` are for reading ``source``. CSV is written and read back with ``LOSSLESS_CSV``; a text
    that is exactly ``NULL_TEXT``, which stands for null there, is an error.
    """
    rows = load_data(source, spark, schema=schema, **options)
    if format_of(target) != "csv":
        save_data(rows, target, mode)
        return load_data(target, spark, schema=schema)
    texts = [field.name for field in rows.schema.fields if isinstance(field.dataType, T.StringType)]
    taken = F.raise_error(F.lit(f"a text is {NULL_TEXT}, which stands for null in CSV")).cast("string")
    # Quotes around every empty text tell it from null, which is written bare.
    checked = rows.withColumns({name: F.when(column(name) == NULL_TEXT, taken).otherwise(column(name)) for name in texts})
    save_data(checked, target, mode, **LOSSLESS_CSV | {"emptyValue": '""'})
    return load_data(target, spark, schema=schema, **LOSSLESS_CSV)


def save_model(model, path: str) -> None:
    """Write a fitted model, replacing what ``path`` holds."""
    model.write().overwrite().save(path)


def load_model(path: str, spark: SparkSession):
    """Read back a fitted model of whatever class was saved."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
