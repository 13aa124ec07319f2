"""Plain binary files in the shared folder, written and read by tasks through pyarrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from .common import as_pattern


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(uri, safe=":/@?&=+,"))  # Spark's paths are plain text, so a blank or % in them is meant


def write_whole(uri: str, chunks) -> int:
    """Writes a file under another name and then moves it: a repeated attempt replaces it whole. Returns its bytes."""
    system, path = _open_fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    system.move(part, path)
    return n


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = _open_fs(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, start)


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path and length of the files; their content is not read. A folder that no task has made has no files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(as_pattern(folder)).select("path", "length")
