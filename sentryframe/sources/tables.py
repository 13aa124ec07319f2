"""Reading and writing: corpora with fallbacks, consolidated CSV, policies, audit logs, results and caches."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import local_table
from ..operators.corpus import name_sources
from ..schemas import AUDIT, CORPUS, POLICY

POLICY_DIR = Path(__file__).resolve().parent.parent / "data" / "policies"
CSV = "text string, label string, attack_type string, source_dataset string, split string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_first(spark: SparkSession, paths: list[str], schema: str = CORPUS, fmt: str = "parquet") -> DataFrame:
    """The first path that exists, with the schema; an empty table of that schema if none does. A path that can't be read is an error."""
    found = next((p for p in paths if exists(spark, p)), None)
    return spark.createDataFrame([], schema) if found is None else spark.read.format(fmt).schema(schema).load(found)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated CSV: named columns only; rows without text or label go; category defaults to unknown."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select("text", F.col("label").try_cast("int").alias("label"), F.coalesce("attack_type", F.lit("unknown")).alias("category"), F.col("source_dataset").alias("raw_source"))
    return name_sources(rows.na.drop(subset=["text", "label"]))


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at path; built and written first if it is not there, or not whole (a write that ended leaves _SUCCESS)."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per role. Two files for one role are an error."""
    df = spark.read.schema(POLICY).option("multiLine", True).json(path)
    twice = df.groupBy("role").count().filter("count > 1").select("role").take(5)
    if twice:
        raise ValueError(f"more than one policy for {', '.join(r.role for r in twice)}")
    return df


def default_policies(spark: SparkSession) -> DataFrame:
    """The six policies that come with the library, from its own files (a few kB of configuration on the driver)."""
    rows = [json.dumps(json.loads(p.read_text())) for p in sorted(POLICY_DIR.glob("*.json"))]
    return local_table(spark, [(r,) for r in rows], "value string").select(F.from_json("value", POLICY).alias("p")).select("p.*")


def write_audit(entries: DataFrame, path: str) -> None:
    """Appends entries as JSON lines, prev_hash and hash first."""
    entries.select("prev_hash", "hash", *[c for c in entries.columns if c not in ("prev_hash", "hash")]).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
