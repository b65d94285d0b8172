"""Binary files in the shared folder, written and read inside tasks.

A task gives every file a name of its own and reports it in the rows it returns. The rows of
a task that is lost are lost with it, so a file that a retry left behind is never read.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrow_uri(uri: str) -> str:
    """A path as Spark writes it, under the name that Arrow knows its store by."""
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri))


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(uri))


def new_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def open_to_write(uri: str) -> pa.NativeFile:
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_to_read(uri: str) -> pa.NativeFile:
    system, path = _at(uri)
    return system.open_input_file(path)


def spread(files: DataFrame, key: str = "file") -> DataFrame:
    """One partition per file, or about: rows that name files are small, but each is much work.

    A number of partitions that is asked for is kept; otherwise small rows would share one task.
    """
    return files.repartition(max(1, files.select(key).distinct().count()), F.col(key))
