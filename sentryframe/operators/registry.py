"""Evasion buffer, promotion gate and retraining set."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SOURCE_NAMES, TEST_SOURCES
from . import corpus, detector


def trigger_points(evasions: DataFrame, least: int = 50) -> DataFrame:
    """Per key, the seq at which the buffer reaches each multiple of `least` (it is emptied when it fires), and the batch number.

    evasions: key, seq."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return evasions.withColumn("n", n).filter(F.col("n") % least == 0).select("key", "seq", (F.col("n") / least).cast("long").alias("batch"))


def should_trigger(evasions: DataFrame, least: int = 50) -> DataFrame:
    return evasions.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= least).alias("fires"))


def next_version(registry: DataFrame, key: str = "model") -> DataFrame:
    """v(max + 1) of the promoted versions named v and a number; a rejected number is used again."""
    number = F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int")
    return registry.filter("status = 'promoted'").groupBy(key).agg(F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_version"))


def gate(candidates: DataFrame, registry: DataFrame, metric: str = "f1", tolerance: float = 0.02, key: str = "model") -> DataFrame:
    """candidates (model, metrics map) against each model's current version: promoted unless new < baseline - tolerance.

    The current version is the promoted one with the largest number; a missing baseline is 0."""
    number = F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int")
    current = registry.filter("status = 'promoted'").groupBy(key).agg(F.max_by("metrics", number).alias("base"), F.max_by("version", number).alias("current_version"))
    out = candidates.join(current, key, "left").join(next_version(registry, key), key, "left")
    new, base = F.col("metrics")[metric], F.coalesce(F.col("base")[metric], F.lit(0.0))
    rejected = new < base - tolerance
    return out.select(key, F.coalesce("next_version", F.lit("v1")).alias("version"), F.round(new, 6).alias("new_metric"), F.round(base, 6).alias("baseline"), F.when(rejected, "rejected").otherwise("promoted").alias("status"), F.when(rejected, F.col("current_version")).otherwise(F.coalesce("next_version", F.lit("v1"))).alias("current_version"))


def retraining_set(train: DataFrame, evasions: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows and evasions (label 1) in role train, the untouched test rows in role test; equal texts once per role."""
    new = evasions.select(F.col("text"), F.lit(1).alias("label"), F.lit("red_team_evasion").alias("category"), F.lit("online_retrain").alias("source"), F.lit("train").alias("split_role"), F.col("ord"))
    return corpus.dedup(train.withColumn("split_role", F.lit("train")).unionByName(new).unionByName(test.withColumn("split_role", F.lit("test"))))


def raw_sources(df: DataFrame, default: str = "online_retrain") -> DataFrame:
    """Adds raw_source, the code of a source's name; test rows get the test code, unknown names the default."""
    codes = F.create_map(*[F.lit(x) for code, name in SOURCE_NAMES.items() for x in (name, code)])
    return df.withColumn("raw_source", F.when(F.col("split_role") == "test", TEST_SOURCES[0]).otherwise(F.coalesce(codes[F.col("source")], F.lit(default))))


def retrain_cycle(
    rows: DataFrame,
    evasions: DataFrame,
    registry: DataFrame,
    fit: Callable[[DataFrame, DataFrame], Any] = lambda train, val: detector.fit_best(train, val)[0],
    evaluate: Callable[[Any, DataFrame], DataFrame] = detector.evaluate,
    write: Callable[[DataFrame], DataFrame] | None = None,
    model: str = "detector",
    metric: str = "f1",
    tolerance: float = 0.02,
) -> DataFrame:
    """One retraining: the gate's row for the new version, and n_evasions.

    rows is a split corpus (ord, text, label, category, source, split). Its training rows and the evasions (text, ord) become
    the training pool, its test rows stay the test pool, earlier validation rows are dropped and new ones are drawn. write
    stores the set (with raw_source) and gives back what is read from there; fit trains on training and validation rows;
    evaluate gives one row of metrics on the test rows."""
    names = ["ord", "text", "label", "category", "source"]
    combined = raw_sources(retraining_set(rows.filter("split = 'train'").select(names), evasions, rows.filter("split = 'test'").select(names)))
    parts = corpus.split(combined if write is None else write(combined))
    fitted = fit(parts.filter("split = 'train'"), parts.filter("split = 'val'"))
    row = evaluate(fitted, parts.filter("split = 'test'"))
    numbers = F.create_map(*[x for c, t in row.dtypes if t in ("double", "float") for x in (F.lit(c), F.col(c).cast("double"))])
    candidate = row.select(F.lit(model).alias("model"), numbers.alias("metrics"))
    return gate(candidate, registry, metric, tolerance).join(evasions.agg(F.count(F.lit(1)).alias("n_evasions")).withColumn("model", F.lit(model)), "model")
