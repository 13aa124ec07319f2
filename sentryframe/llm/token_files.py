"""Token-ID output: Parquet files of token lists with chosen encodings, row groups and page indexes.

Files are range-partitioned and sorted by id, so a row's place in the whole token stream is the sum of the files before
it plus its place in its own file. Ids are list columns with dictionary pages (a tokenizer has few distinct ids); keys and
lengths are delta-encoded; row groups and pages are small enough for selective reads, and each page has an index entry.

Cases: null text encodes as empty (only the end id); null ids sort first; rows with equal ids are kept and ordered by
text; an empty table gives an empty file set; columns other than id and text are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import encoder, small_batches

SCHEMA = "part int, doc_id long, n_tokens int, local_start long, tokens array<int>"


def encode_rows(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """One row per document with its ids, and its place within its partition, in the order of the partition's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in small_batches(batch, "text", 500_000):
                ids, at = enc.encode(b.column("text"), end_id)
                n = len(b)
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), b.column("doc_id"), pa.array(np.diff(at).astype(np.int32)), pa.array(at[:-1] + done), tokens],
                    ["part", "doc_id", "n_tokens", "local_start", "tokens"],
                )
                done += int(at[-1])

    return docs.mapInArrow(work, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, page_rows: int = 2_000) -> None:
    """Encodes every whole text and writes the files in ascending order of id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        encode_rows(ordered, tokenizer_path, end_id)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of each document; only the key columns of the files are read."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("part", "doc_id", "n_tokens", "local_start")
    return _with_start(rows, rows).drop("part", "local_start")


def _with_start(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds start. There is one total per file, so their running sum is small and is broadcast."""
    totals = keys.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, n_tokens, local_start, tokens, start: every document of the files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return _with_start(rows, rows.select("part", "n_tokens"))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from the ids themselves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            at = tokens.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
            crc = [zlib.crc32(raw[i * 4 : j * 4]) for i, j in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "tokens").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
