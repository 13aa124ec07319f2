"""Corpus building: column choice, labels, deduplication, caps and splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut
from ..config import SOURCE_NAMES, TEST_SOURCES
from ..functions.decisions import label_value
from .policy import unused


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among the columns."""
    return next((c for c in candidates if c in columns), None)


def normalize(df: DataFrame, source: str, text: Sequence[str] = ("text", "prompt", "instruction", "input"), label: Sequence[str] = ("label", "is_injection", "is_malicious", "target"), category: Sequence[str] = ("category", "attack_type", "type"), custom: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """text, label, category, source from a table with other names. Rows without text or a known label go."""
    if custom is not None:
        df = df.transform(custom)
    t, y, c = (pick_column(df.columns, x) for x in (text, label, category))
    if t is None or y is None:
        raise ValueError(f"{source}: no {'text' if t is None else 'label'} column among {df.columns}")
    kind = "string" if dict(df.dtypes)[y] == "string" else "number"
    out = df.select(F.col(t).cast("string").alias("text"), label_value(F.col(y), kind).alias("label"), (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c else F.lit("unknown")).alias("category"), F.lit(source).alias("source"))
    return drop_unlabelled(out)


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull() & F.col("text").isNotNull())


def unlabelled_report(df: DataFrame) -> DataFrame:
    """Rows, rows with an unrecognised label, and labels other than 0 and 1, per source; one pass with partial sums."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label").isNull()).alias("n_dropped"), F.count_if(~F.col("label").isin(0, 1)).alias("n_odd"))


def unpivot_pairs(df: DataFrame, name: str = "attack_name") -> DataFrame:
    """Pairs of an original and an altered attack become two rows with label 1. A missing side gives none."""
    sides = {"original_sample": "original", "modified_sample": "evaded"}
    have = [c for c in sides if c in df.columns]
    if name not in df.columns:
        df = df.withColumn(name, F.lit(None).cast("string"))
    long = df.unpivot([name], have, "side_column", "text")
    side = F.when(F.col("side_column") == "original_sample", "original").otherwise("evaded")
    return long.filter("text is not null").select("text", F.lit(1).alias("label"), F.concat_ws("::", F.coalesce(name, side), side).alias("category"))


def name_sources(df: DataFrame, raw: str = "raw_source") -> DataFrame:
    """Adds source (mapped, unknown codes as they are) and split_role."""
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    return df.withColumn("source", F.coalesce(names[F.col(raw)], F.col(raw))).withColumn("split_role", F.when(F.col(raw).isin(*TEST_SOURCES), "test").otherwise("train"))


def shuffled(seed: int, *keys: str):
    """A reproducible random order: SHA-256 of the seed and the keys."""
    return F.sha2(F.concat(F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"), 256)


def ranked(df: DataFrame, keys: list[str], h: str, order: str = "ord", digits: int = 3, rank: str = "rank") -> DataFrame:
    """Adds rank (or another column name): 1, 2, ... per keys in order of the hash column h.

    The hash's leading digits cut each group into 16^digits slots. Slots are ranked apart and shifted by the rows of the slots
    before (a small table of counts), so a group of any size is spread over many tasks."""
    slot, at, before = unused(df, "slot", "at", "before")
    cut = df.withColumn(slot, F.substring(h, 1, digits))
    counts = cut.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("in_slot"))
    upto = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, slot, F.coalesce(F.sum("in_slot").over(upto), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(*keys, slot).orderBy(h, order))
    return cut.withColumn(at, place).join(shift, [*keys, slot]).withColumn(rank, F.col(at) + F.col(before)).drop(slot, at, before)


def cap_sources(df: DataFrame, max_rows: int, seed: int = 42) -> DataFrame:
    """Of a source with more than max_rows rows each label keeps its share, rounded half to even."""
    counts = df.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_label"))
    share = counts.join(counts.groupBy("source").agg(F.sum("n_label").alias("n_source")), "source")
    keep = F.when(F.col("n_source") > max_rows, F.bround(max_rows / F.col("n_source") * F.col("n_label"))).otherwise(F.col("n_label"))
    h, rank, most = unused(df, "h", "rank", "keep")
    bounds = share.select("source", "label", keep.cast("long").alias(most))  # a row for each source and label
    rows = ranked(df.withColumn(h, shuffled(seed, "text")), ["source", "label"], h, rank=rank)
    return rows.join(bounds, ["source", "label"]).filter(F.col(rank) <= F.col(most)).select(df.columns)


def dedup(df: DataFrame, pool: str = "split_role", order: str = "ord") -> DataFrame:
    """Per pool, the first row (by order) of those with equal text. min_by combines before the shuffle, so copies meet early."""
    rest = [c for c in df.columns if c != pool]
    firsts = df.groupBy(pool, F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("row"))
    return firsts.select(pool, *[F.col(f"row.{c}").alias(c) for c in rest]).select(df.columns)


def split(df: DataFrame, val_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: test for role test; of the rest each label's first max(1, n*f) rows (none of one row) are val."""
    pool = cut(df.filter("split_role = 'train'").select("ord", "label", shuffled(seed, "text", "ord").alias("h")))  # narrow, used twice
    counts = pool.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    n_val = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.floor(F.col("n") * val_fraction))).otherwise(0)
    rows = ranked(pool, ["label"], "h")
    val = rows.join(F.broadcast(counts.select("label", n_val.alias("n_val"))), "label").filter("rank <= n_val").select("ord", F.lit(True).alias("in_val"))
    marked = df.join(val, "ord", "left")
    return marked.withColumn("split", F.when(F.col("split_role") == "test", "test").when(F.coalesce("in_val", F.lit(False)), "val").otherwise("train")).drop("in_val")


def split_report(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("positive_rate"))


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows whose text is also in the test pool."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return train.withColumn("digest", digest).join(test.select(digest.alias("digest")).distinct(), "digest", "left_semi").drop("digest")


def subsample(df: DataFrame, n: int, seed: int = 42, key: str = "ord") -> DataFrame:
    """n rows in a reproducible random order; tasks keep their own first n before they meet."""
    return df.orderBy(shuffled(seed, key), key).limit(n)
