"""Separator scan: token counts per document of flat token files that have no index.

A flat file is nothing but ids, each document closed by an end-of-document id. Files are cut into blocks of equal size
wherever documents end; each task reads its block's range and finds all end ids with one vector comparison. A document may
begin blocks earlier: a prefix scan over the blocks of its file, in two levels and over one narrow row a block, gives the
last end before each block (a running maximum) and the documents before it (a running sum).

Cases: null text is empty (one end id); a file without a closing end id gives a last row with closed = false; documents
with equal ids stay apart; empty files and tables give no rows; a null doc_id is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, table
from .encoding import encoder, small_batches
from .files import list_files, read_range, write_whole


def write_flat(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One flat file per partition. Returns the writer's list of what went where: doc_id, shard, doc_no (from 0 in the shard).

    Special tokens' strings in a text are encoded as ordinary text, so the end id closes documents and nothing else."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, listed = encoder(tokenizer_path, True), TaskContext.get().partitionId(), []

        def chunks():
            done = 0
            for batch in batches:
                for b in small_batches(batch, "text", 500_000):
                    ids, _ = enc.encode(b.column("text"), end_id)
                    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                        raise ValueError(f"ids don't fit {dtype}")
                    listed.append(pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(b), shard, np.int32)), pa.array(done + np.arange(len(b)))], ["doc_id", "shard", "doc_no"]))
                    done += len(b)
                    yield ids.astype(dtype).tobytes()

        write_whole(f"{folder}/shard-{shard:06d}.bin", chunks())
        yield from listed

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return table(rows.mapInArrow(work, "doc_id long, shard int, doc_no long"), "flat-list")


def scan_blocks(blocks: DataFrame, end_id: int, dtype: str) -> DataFrame:
    """Per block: its number of ids and the places of the end ids in it."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids = np.frombuffer(read_range(r.path, r.at, r.size), dtype)
                yield pd.DataFrame({"path": [r.path], "block": [r.block], "first": [r.at // ids.itemsize], "n_ids": [len(ids)], "ends": [np.flatnonzero(ids == end_id).astype(np.int32)]})

    return blocks.mapInPandas(work, "path string, block long, first long, n_ids long, ends array<int>")


def count_tokens(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_bytes: int = 4 << 20, glob: str = "*.bin", run_blocks: int = 4_096) -> DataFrame:
    """Per document: path, doc_no (from 0 in its file), start, n_tokens (with the end id), closed."""
    width = np.dtype(dtype).itemsize
    step = block_bytes // width * width
    files = list_files(spark, folder, glob).filter("length > 0")
    blocks = files.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * step).alias("at"), F.least(F.lit(step), F.col("length") - F.col("block") * step).cast("long").alias("size"))
    found = table(scan_blocks(spread(blocks, "path", "block"), end_id, dtype), "blocks")
    last_end = F.col("first") + F.element_at("ends", -1) + 1
    sums = found.select("path", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, last_end).alias("last_end"))
    carried = table(_carry(sums, run_blocks), "carried")
    stitched = found.join(carried, ["path", "block"])
    ended = stitched.select("path", "first", "open_from", "docs_before", "ends", F.posexplode("ends").alias("k", "place")).select(
        "path",
        (F.col("docs_before") + F.col("k")).alias("doc_no"),
        F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("first") + F.expr("ends[greatest(k - 1, 0)]") + 1).alias("start"),
        (F.col("first") + F.col("place") + 1).alias("stop"),
        F.lit(True).alias("closed"),
    )
    stop = F.col("first") + F.col("n_ids")
    open_from = F.when(F.size("ends") > 0, last_end).otherwise(F.col("open_from"))
    rest = stitched.filter("final").select("path", (F.col("docs_before") + F.size("ends")).alias("doc_no"), open_from.alias("start"), stop.alias("stop"), F.lit(False).alias("closed")).filter("stop > start")
    return ended.unionByName(rest).select("path", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def _carry(sums: DataFrame, group: int) -> DataFrame:
    """What each block gets from those before it in its file: open_from, docs_before; and whether it is the final one.

    A prefix scan in two levels over one narrow row a block: runs of `group` blocks apart, then the totals of the runs, so
    that a single huge file is not one task."""
    rows = sums.withColumn("run", F.expr(f"block div {group}"))
    inner = Window.partitionBy("path", "run").orderBy("block")
    outer = Window.partitionBy("path").orderBy("run")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("path", "run").agg(F.sum("n").alias("n"), F.max("last_end").alias("last_end"))
    runs = runs.select("path", "run", F.sum("n").over(upto(outer)).alias("n_run"), F.max("last_end").over(upto(outer)).alias("end_run"), F.lead("run").over(outer).isNull().alias("last_run"))
    own = rows.select("path", "run", "block", F.sum("n").over(upto(inner)).alias("n_own"), F.max("last_end").over(upto(inner)).alias("end_own"), F.lead("block").over(inner).isNull().alias("last_own"))
    return own.join(runs, ["path", "run"]).select(
        "path", "block",
        F.coalesce("end_own", "end_run", F.lit(0)).alias("open_from"),
        (F.coalesce("n_own", F.lit(0)) + F.coalesce("n_run", F.lit(0))).alias("docs_before"),
        (F.col("last_own") & F.col("last_run")).alias("final"),
    )


def shard_of(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"shard-(\d+)\.bin$", 1).cast("int")
