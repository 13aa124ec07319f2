"""Hash-chained audit logs: heads, full chains and verification. One chain per log_id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.decisions import GENESIS


def payload(df: DataFrame, *columns: str):
    """The columns as one JSON text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def chain_heads(entries: DataFrame) -> DataFrame:
    """The last hash and length of each chain. entries: log_id, seq, payload. Like append, a task keeps one hash, however long a log is."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, h, n = None, GENESIS, 0
        for f in frames:
            done = []
            for x, p in zip(f["log_id"], f["payload"]):
                if x != log:
                    if n:
                        done.append((log, h, n))
                    log, h, n = x, GENESIS, 0
                h, n = hashlib.sha256((h + p).encode()).hexdigest(), n + 1
            yield pd.DataFrame(done, columns=["log_id", "head", "n_entries"])
        if n:
            yield pd.DataFrame([(log, h, n)], columns=["log_id", "head", "n_entries"])

    return _by_log(entries).mapInPandas(work, "log_id string, head string, n_entries long")


def _by_log(entries: DataFrame) -> DataFrame:
    return entries.select("log_id", "seq", "payload").repartition("log_id").sortWithinPartitions("log_id", "seq")


def append(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Adds prev_hash and hash to every entry. heads (log_id, head) continues stored chains; other logs begin anew.

    A chain is serial by nature, but not held in memory: a task reads its logs sorted by seq and keeps one hash."""
    rows = entries.select("log_id", "seq", "payload")
    if heads is None:
        rows = rows.withColumn("head", F.lit(GENESIS))
    else:
        rows = rows.join(heads.select("log_id", "head"), "log_id", "left").withColumn("head", F.coalesce("head", F.lit(GENESIS)))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, h = None, GENESIS
        for f in frames:
            before, after = [], []
            for x, p, begin in zip(f["log_id"], f["payload"], f["head"]):
                if x != log:
                    log, h = x, begin
                before.append(h)
                h = hashlib.sha256((h + p).encode()).hexdigest()
                after.append(h)
            yield f.drop(columns="head").assign(prev_hash=before, hash=after)

    ordered = rows.repartition("log_id").sortWithinPartitions("log_id", "seq")
    return ordered.mapInPandas(work, "log_id string, seq long, payload string, prev_hash string, hash string")


HEADS = "log_id string, head string, last_seq long, n_entries long"
ENTRIES = "log_id string, seq long, payload string, prev_hash string, hash string"


class ChainStore:
    """Audit chains in a folder, continued batch by batch.

    Batch n writes its entries to entries/batch=n and then the heads of all logs to heads/batch=n. A batch counts once its
    heads are complete, so readers see it whole or not at all, and a writer that fails in between leaves nothing behind that
    counts. A batch that counts already is not written again: a repeated one changes nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers of the batches that count, from the folders' names."""
        where, fs = self._fs()
        if not fs.exists(where):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folders = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in folders if fs.exists(path(p, "_SUCCESS")))

    def heads(self) -> DataFrame:
        """log_id, head, last_seq, n_entries after the last batch that counts."""
        done = self.batches()
        return self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/batch={done[-1]}") if done else self.spark.createDataFrame([], HEADS)

    def entries(self) -> DataFrame:
        done = self.batches()
        return self.spark.read.schema(ENTRIES).parquet(*[f"{self.path}/entries/batch={n}" for n in done]) if done else self.spark.createDataFrame([], ENTRIES)

    def append(self, entries: DataFrame, batch: int) -> bool:
        """Continues the chains by a batch; False if that batch counts already. Batches come in order of their numbers, entries of
        a log in order of seq over all batches; an entry that is not after its log's last one is an error."""
        done = self.batches()
        if done and batch <= done[-1]:
            return False
        before = self.heads()
        known = before.select("log_id", F.col("last_seq").alias("known_seq"))
        late = F.raise_error(F.concat(F.lit("not after the last entry of log "), F.col("log_id"))).cast("long")
        checked = entries.select("log_id", "seq", "payload").join(known, "log_id", "left").withColumn("seq", F.when(F.col("known_seq").isNull() | (F.col("seq") > F.col("known_seq")), F.col("seq")).otherwise(late)).drop("known_seq")
        here = f"{self.path}/entries/batch={batch}"
        append(checked, before).write.mode("overwrite").parquet(here)
        new = self.spark.read.schema(ENTRIES).parquet(here).groupBy("log_id").agg(F.max_by("hash", "seq").alias("head"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_entries"))
        old = before.select("log_id", F.col("head").alias("h"), F.col("last_seq").alias("s"), F.col("n_entries").alias("n"))
        both = old.join(new, "log_id", "full").select("log_id", F.coalesce("head", "h").alias("head"), F.coalesce("last_seq", "s").alias("last_seq"), (F.coalesce("n", F.lit(0)) + F.coalesce("n_entries", F.lit(0))).alias("n_entries"))
        both.write.mode("overwrite").parquet(f"{self.path}/heads/batch={batch}")
        return True

    def sink(self):
        """For writeStream.foreachBatch: each micro-batch continues the chains, a repeated one changes nothing."""
        return lambda df, n: self.append(df, n)


def verify(chained: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per log: n_entries, intact, first_bad (the first seq whose hash doesn't follow from the stored one before it or whose
    prev_hash differs). counts (log_id, expected) also finds cut-off ends."""
    before = F.lag("hash", 1, GENESIS).over(Window.partitionBy("log_id").orderBy("seq"))
    checked = chained.withColumn("before", before)
    bad = (F.sha2(F.concat("before", "payload").cast("binary"), 256) != F.col("hash")) | (F.col("prev_hash") != F.col("before"))
    out = checked.groupBy("log_id").agg(F.count(F.lit(1)).alias("n_entries"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"))
    if counts is not None:
        out = out.join(counts, "log_id", "full").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
        return out.withColumn("intact", F.col("first_bad").isNull() & (F.col("n_entries") == F.col("expected")))
    return out.withColumn("intact", F.col("first_bad").isNull())
