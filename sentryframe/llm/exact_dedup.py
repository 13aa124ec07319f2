"""Stateful streaming exact deduplication, with DataFrame functions only.

A stream over the files keeps one state row per digest, in RocksDB on the executors' disks with checkpoints in the shared
folder, and without expiry: the digest, the smallest id seen, the place of that row's content (file and row number) and
the number of rows. The files are read in at least `batches` micro-batches of at most `batch_bytes`; where they are too few or
too large for that, they are first copied into more of them, without a shuffle. So copies of texts from earlier batches meet
them in the state alone, whatever the size. Each micro-batch writes the rows of the digests it touched. When
the stream has caught up, every hit (a row that shares a digest with another) is compared with the whole text its digest
points to; digests with unequal texts are grouped by digest and text instead. Rows that share no digest are done in place:
neither they nor their texts are shuffled.

Cases: null text counts as empty; a null id never stays where the group has an id (else the smallest place stays); rows
with equal ids and texts are copies of each other and one of them stays; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_pattern, free_name, fresh_path, mark_maybe, maybe_in, sized_broadcast, table

SPACE = r"[\x20\x09-\x0D]+"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP = "struct<no_id:boolean,id:long,place:struct<file:string,row:long>>"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(source: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """id, place, digest and normal text of the rows of a file scan."""
    normal = normal_text(F.col(text_col))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return source.select(F.col(id_col).cast("long").alias("id"), place.alias("place"), digest(normal).alias("digest"), normal.alias("normal"))


def micro_batches(spark: SparkSession, path: str, batches: int, batch_bytes: int) -> tuple[str, int]:
    """A folder with the rows of the Parquet files at path, and the bytes for a micro-batch: at least `batches`, each of at most batch_bytes.

    It is the path itself if its files can be dealt so; else a copy, in files of equal numbers of rows, written without a shuffle."""
    sizes = spark.read.format("binaryFile").load(as_pattern(path)).select("path", "length")
    r = sizes.agg(F.sum("length").alias("total"), F.max("length").alias("most"), F.count(F.lit(1)).alias("n"), F.max("path").alias("one")).first()
    total, most = r.total or 0, r.most or 0
    n = max(batches, -(-total // batch_bytes))
    if r.n >= n and most <= batch_bytes:
        return path, max(1, -(-total // n))
    rows = spark.read.parquet(as_pattern(path))
    copy = fresh_path(spark, "dedup-input")
    rows.write.option("maxRecordsPerFile", max(1, -(-rows.count() // n))).parquet(copy)
    total = spark.read.format("binaryFile").load(copy).agg(F.sum("length")).first()[0] or 0
    return copy, max(1, -(-total // n))


def run_stream(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, batches: int = 3, max_files: int | None = None, batch_bytes: int = 64 << 30) -> DataFrame:
    """Runs the stream until it has caught up with the files under path; gives what each micro-batch wrote: batch, digest, keep, group_size."""
    path, per_batch = micro_batches(spark, path, batches, batch_bytes)
    schema = spark.read.parquet(as_pattern(path)).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", per_batch)
    rows = _rows(reader.parquet(as_pattern(path)), id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    out = fresh_path(spark, "dedup-state")
    # without fallocate a store takes the disk it fills, not some MB in advance for its logs
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{out}-checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))  # a repeated batch replaces its folder
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ddl = f"batch long, digest string, keep {KEEP}, group_size long"
    return spark.read.schema(ddl).parquet(out) if query.lastProgress else spark.createDataFrame([], ddl)


def repeated(written: DataFrame) -> DataFrame:
    """digest, keep, group_size of the digests of several rows, as the state had them last."""
    more = written.filter("group_size > 1")  # a digest's count only grows, so its last row is among these
    latest = more.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("last"))
    return latest.select("digest", "last.keep", "last.group_size")


def _scan(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.parquet(as_pattern(path)).select(F.col(id_col).cast("long").alias("id"), place.alias("place"), F.col(text_col).alias("text"))


def hit_texts(scan: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits with their whole normal texts. Their places select the texts, so other texts are read but not moved."""
    texts = maybe_in(scan.select("place", "text"), hits, "place", hits.count())
    return table(texts.join(hits.select("id", "place", "digest", F.col("keep.place").alias("keep_place")), "place").withColumn("normal", normal_text(F.col("text"))).drop("text"), "hit-texts")


def unequal_digests(texts: DataFrame) -> DataFrame:
    """The digests of which some hit's text differs from the text the state points to."""
    kept = texts.filter("place = keep_place").select(F.col("digest").alias("d"), F.col("normal").alias("kept_text"))
    # written before it is made distinct: so Spark may split a hot digest's partition of the join
    return table(texts.filter("place != keep_place").join(kept, F.col("digest") == F.col("d")).filter("normal != kept_text").select("digest"), "unequal").distinct()


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, batches: int = 3, max_files: int | None = None, batch_bytes: int = 64 << 30) -> DataFrame:
    """One row per row of the files: id, place, keep_id, group_size, kept, digest."""
    path, _ = micro_batches(spark, path, batches, batch_bytes)  # here already, as places must be those of the rows that are read below
    groups = table(repeated(run_stream(spark, path, id_col, text_col, digest, batches, max_files, batch_bytes)), "repeated")
    scan = _scan(spark, path, id_col, text_col)
    rows = mark_maybe(scan.select("id", "place", digest(normal_text(F.col("text"))).alias("digest")), groups, "digest", groups.count())
    rows = table(rows, "digests")
    looked = table(rows.filter("maybe").drop("maybe").join(groups, "digest", "left"), "looked")
    single = rows.filter("not maybe").drop("maybe").unionByName(looked.filter("keep is null").drop("keep", "group_size"))
    alone = single.select("id", "place", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    hits = looked.filter("keep is not null")
    columns = ["id", "place", F.col("keep.id").alias("keep_id"), "group_size", (F.col("place") == F.col("keep.place")).alias("kept"), "digest"]
    texts = hit_texts(scan, hits)
    bad = table(unequal_digests(texts), "unequal")
    n_bad = bad.count()
    if not n_bad:
        return alone.unionByName(hits.select(columns))
    bad = sized_broadcast(bad, n_bad, 100_000)
    apart = texts.join(bad, "digest")
    regrouped = apart.groupBy("digest", "normal").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = apart.join(regrouped, ["digest", "normal"]).select(columns)
    return alone.unionByName(hits.select(columns).join(bad, "digest", "left_anti")).unionByName(again)


def scanned_folder(docs: DataFrame) -> str | None:
    """The folder of Parquet files of which docs is a plain scan, whole and unchanged; None if docs is anything else."""
    files = sorted(docs.inputFiles())
    folders = {f.rpartition("/")[0] for f in files}
    if len(folders) != 1:
        return None
    folder = unquote(folders.pop())
    same = docs.sparkSession.read.schema(docs.schema).parquet(as_pattern(folder))
    return folder if sorted(same.inputFiles()) == files and docs.sameSemantics(same) else None


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, batch_bytes: int = 64 << 30) -> DataFrame:
    """The rows of a DataFrame that stay, with its columns. A stream needs files that can be read again: docs is written unless it is a plain scan."""
    spark = docs.sparkSession
    path = scanned_folder(docs)
    if path is None:
        path = fresh_path(spark, "dedup-input")
        docs.write.parquet(path)
    path, _ = micro_batches(spark, path, batches, batch_bytes)
    gone = free_name(docs, "gone")
    dropped = table(exact_dedup(spark, path, id_col, text_col, batches=batches, batch_bytes=batch_bytes).filter("not kept").select(F.col("place").alias(gone)), "dropped")
    landed = spark.read.schema(docs.schema).parquet(as_pattern(path))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return landed.withColumn(gone, place).join(dropped, gone, "left_anti").select(docs.columns)
