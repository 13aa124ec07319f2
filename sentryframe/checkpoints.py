"""Cutting lineage in the shared folder named in spark.checkpoint.dir, and small tables from the driver."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    jsc = spark.sparkContext._jsc.sc()
    path = spark.conf.get("spark.checkpoint.dir", None) or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if not path:
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sentryframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there. Only where no folder is set (tests, a laptop) a temporary one is made."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of configuration as a table of known size: Spark broadcasts it below its own threshold, and no job counts it."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema), schema=StructType.fromDDL(ddl))
