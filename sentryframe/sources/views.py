"""Agent tables derived from the supplied ones: tool calls, corpus, credentials, confirmations, attack memory."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_path
from ..config import COMPANY_ADDRESS, ROLES
from ..functions.decisions import normalized, pseudo_score


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. As a pattern, the path may also be one file; pattern characters in it are meant as such."""
    path = re.sub(r"([\\{}\[\]*?])", r"\\\1", f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def replayed(rows: DataFrame, batches: int = 12, jitter_seconds: int = 21_600) -> DataFrame:
    """A table with ts and call_id as a stream of `batches` micro-batches whose rows come out of order: each is shifted by up to
    jitter_seconds, by a hash. A last file has one row of a far later time and nulls, as a sign that no more rows will come."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "replay")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    held = cut(rows.withColumn("arrives", at + F.pmod(F.xxhash64("call_id"), F.lit(jitter_seconds))))
    first, last, newest = held.agg(F.min("arrives"), F.max("arrives"), F.max("ts")).first()
    step = (last - first) // batches + 1 if first is not None else 1
    for k in range(batches if first is not None else 0):
        held.filter((F.col("arrives") >= first + k * step) & (F.col("arrives") < first + (k + 1) * step)).select(rows.columns).coalesce(1).write.mode("append").parquet(path)
    end = F.lit(newest or datetime(2000, 1, 1)).cast(rows.schema["ts"].dataType) + F.expr("interval 400 days")
    sign = spark.range(1).select(*[(end if f.name == "ts" else F.lit("") if f.dataType.simpleString() == "string" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    sign.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def tool_calls(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """One agent call per event; see the module plans.views_sql for the same view in SQL."""
    e = (read_stream if stream else read)(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    by = lambda **kw: F.coalesce(*[F.when(kind == n, c) for n, c in kw.items()])
    lit = F.lit
    natural = by(purchase=lit("support_agent"), view=lit("research_agent"), error=lit("code_exec_agent"), click=lit("email_agent"), signup=lit("calendar_agent"))
    role = F.when(k % 4 == 0, F.element_at(F.array(*map(lit, ROLES)), (F.col("user_id") % 6 + 1).cast("int"))).otherwise(natural)
    tool = by(purchase=lit("issue_refund"), view=lit("fetch_url"), error=lit("run_code"), click=lit("send_email"), signup=lit("create_event"))
    ks = k.cast("string")
    resource = by(
        purchase=F.concat(lit("order_"), (k % 5).cast("string")),
        view=F.when(k % 9 == 0, "file:///d").otherwise(F.concat(lit("https://d"), (k % 12).cast("string"), lit(".example.com/p"))),
        error=F.when(k % 10 == 0, "/etc/s").otherwise(F.concat(lit("/sandbox/s"), ks, lit(".py"))),
        click=F.when(k % 3 == 0, "attacker@evil.com").otherwise(COMPANY_ADDRESS),
    )
    field = by(purchase=lit("amount_usd"), error=lit("timeout_seconds"), click=lit("recipient_count"), signup=lit("attendee_count"))
    amount = by(purchase=value, error=value, click=(k % 10).cast("double"), signup=(k % 20).cast("double"))
    params = F.when(field.isNotNull(), F.create_map(field, amount.cast("string"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("string")
    return e.select(
        F.col("event_id").alias("call_id"), "ts", "user_id", F.concat(F.col("user_id").cast("string"), lit("-"), week).alias("session_id"),
        F.concat(lit("tok"), F.col("user_id").cast("string")).alias("token_id"), role.alias("role"), tool.alias("tool_name"), resource.alias("resource"), params.alias("params"), "value", "k",
        pseudo_score(F.col("event_id").cast("string")).alias("injection"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as corpus rows; raw_source goes round the five source codes."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    raw = F.element_at(F.array(*map(F.lit, ("hf_csv", "hf_csv2", "hf_csv3", "hf_csv4", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs.filter("text is not null").join(labels, "doc_id")
    return rows.select(F.col("doc_id").alias("ord"), "text", F.col("toxic").cast("int").alias("label"), F.coalesce("lang", F.lit("unknown")).alias("category"), raw.alias("raw_source"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a pseudo-score of their text."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.filter("text is not null").join(labels, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("label"), pseudo_score(F.col("text")).alias("score"))


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per user; its parent is that of user_id div 3."""
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    token = lambda c: F.concat(F.lit("tok"), c.cast("string"))
    parent = F.when(F.col("user_id") > 0, token(F.floor(F.col("user_id") / 3)))
    return users.select(token(F.col("user_id")).alias("token_id"), "user_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("issued_at"), ((F.col("user_id") % 40 + 1) * 86400).alias("ttl_seconds"), parent.alias("derived_from"))


def confirmations(calls: DataFrame) -> DataFrame:
    """Every fifth call is a confirmed outcome: 1 (good) when its value is under 50."""
    return calls.filter("call_id % 5 = 0").withColumn("outcome", F.when(F.col("value") < 50, 1).otherwise(0))


def attack_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").filter("label = 0")
    return e.select(F.col("vec_id").alias("idx"), F.concat(F.lit("attack "), F.col("vec_id").cast("string")).alias("text"), normalized(F.col("embedding")).alias("embedding"))
