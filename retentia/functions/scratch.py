"""Intermediate tables in the shared folder the session names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, the session's warehouse folder.

    On a cluster, executors do not share a local warehouse folder; then a setting is asked for.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match("file:|/", root):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch root; ``release`` deletes what was written there."""
    path = f"{scratch_root(spark)}/retentia/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds inside only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives lost executors, and fixes values that would
    otherwise be recomputed (row ids, partition numbers, floating-point scores). The shuffle
    files of the job that writes are deleted with its end instead of with the driver's garbage.
    """
    path = scratch_path(df.sparkSession, name)
    with _set(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete all but the first ``keep`` paths this process took; results that read them end with them."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > keep:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(configuration).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, whatever was written inside; write or collect results before that."""
    before = len(_written)
    try:
        yield
    finally:
        release(spark, before)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as a table that plans as a literal, without Python workers."""
    fields = T.StructType.fromDDL(schema).fields
    columns = {
        field.name: pa.array([row[at] for row in rows], to_arrow_type(field.dataType)) for at, field in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns))
