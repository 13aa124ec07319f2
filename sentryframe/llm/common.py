"""What the operators of this subpackage share: the folder all executors see, tables that cut lineage, sized joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_path


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def as_pattern(path: str) -> str:
    """The path as a pattern that matches it alone: Spark reads some characters of a path as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path.rstrip("/"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    bounded_memory(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_BYTES = 8 << 20


def bounded_memory(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, which tasks and Python workers hold several of, unless the session has a lower bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m"))
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_memory(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcasts df if its counted rows are within the bound; beyond it Spark shuffles (and splits skewed partitions)."""
    return F.broadcast(df) if rows <= max_rows else df


MOST_BITS = 1 << 28


def filter_bits(n_keys: int) -> int:
    """Bits of a bitmap in which so many keys fill a sixteenth at most."""
    return max(1 << 20, 1 << (16 * n_keys - 1).bit_length())


def mark_maybe(rows: DataFrame, keys: DataFrame, key: str, n_keys: int, most_bits: int | None = None) -> DataFrame:
    """Adds maybe: false where the row's key is surely not among keys, of which there are n_keys.

    A broadcast bitmap of filter_bits tells it while that has most_bits (32 MB) or fewer. For more keys the keys themselves are
    joined, which tells it exactly and costs a shuffle of the rows: no bitmap ever fills up."""
    bits = filter_bits(n_keys)
    if bits > (most_bits or MOST_BITS):
        known = keys.select(F.col(key).alias("known_key")).distinct()
        return rows.join(known, F.col(key) == F.col("known_key"), "left").withColumn("maybe", F.col("known_key").isNotNull()).drop("known_key")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # noqa: E731  bitmap functions count from 1
    maps = keys.select(slot(F.col(key)).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("map"))
    marked = rows.withColumn("slot", slot(F.col(key))).withColumn("bucket", F.bitmap_bucket_number("slot")).withColumn("bit", F.bitmap_bit_position("slot"))
    byte = F.conv(F.hex(F.substring(F.col("map"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = marked.join(F.broadcast(maps), "bucket", "left")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("slot", "bucket", "bit", "map")


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows whose key may be among keys: most other rows never reach a shuffle."""
    return mark_maybe(rows, keys, key, n_keys).filter("maybe").drop("maybe")


def in_training(id_col: str = "doc_id"):
    """True for rows whose crc32(id as text) mod 5 is not 0, and for a null id; the others are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(True))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deals rows that each stand for much work (a block to read) over the cores: a stated number of partitions is not coalesced."""
    n = rows.count()
    return rows.repartition(max(1, min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism, 10_000)), *keys)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not among ids (one column, distinct). Rows with a null id stay. Columns keep their names."""
    gone = free_name(docs, "gone")
    ids = ids.toDF(gone)
    return docs.join(ids, docs[id_col].cast("long") == ids[gone], "left_anti")
