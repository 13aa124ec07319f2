"""Provenance tags, adaptive trust per content source, trust as of a call, and the memory-write gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut
from ..config import BASE_TRUST, ROLE_SOURCE_TYPE, UNKNOWN_TRUST, MemoryThresholds
from ..functions.decisions import memory_outcome
from .policy import unused

DECAY = 0.8
#: Rows of a source that are summed together. 0.8 to this power is under 1e-24, so of all earlier rows only those of the run before count.
RUN = 256


def _mapped(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def tagged(calls: DataFrame) -> DataFrame:
    """Adds source_type (by role, else user_input) and source_id (the resource; the role where it is null or empty)."""
    kind = F.coalesce(_mapped(ROLE_SOURCE_TYPE, F.col("role")), F.lit("user_input"))
    return calls.withColumn("source_type", kind).withColumn("source_id", F.coalesce(F.nullif("resource", F.lit("")), "role"))


def base_trust(source_type: Column) -> Column:
    return F.coalesce(_mapped(BASE_TRUST, source_type), F.lit(UNKNOWN_TRUST))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of the one right row of the same keys (nulls are equal), null where there is none."""
    theirs = unused(left, *[f"r_{k}" for k in keys])
    right = right.withColumnsRenamed(dict(zip(keys, theirs)))
    on = [left[k].eqNullSafe(right[t]) for k, t in zip(keys, theirs)]
    return left.join(right, on, "left").drop(*theirs)


def _bucket(ts: str, size: str) -> Column:
    return F.date_trunc(size, F.col(ts).cast("timestamp"))


def history(confirmed: DataFrame, bucket: str = "day") -> DataFrame:
    """Trust after each confirmation: t = 0.8 t + 0.2 outcome, from the type's base trust.

    confirmed: source_type, source_id, ts, call_id, outcome. The fold is linear, so it is a running sum of outcomes, each
    scaled by the decay's power at its place. Sums begin anew with every run of RUN rows, which keeps the powers within a
    double's range; the sum of the run before is added, faded. Rows are numbered within buckets of time, which are shifted by
    the rows before them. So a source of any size is many small windows, never one."""
    day, at, before, run, place, earlier = unused(confirmed, "day", "at", "before", "run", "place", "earlier")
    source = ["source_type", "source_id"]
    d = lambda e: F.pow(F.lit(DECAY), e.cast("double"))
    rows = confirmed.withColumn(day, _bucket("ts", bucket))
    past = Window.partitionBy(*source).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(*source, day).agg(F.count(F.lit(1)).alias(before)).withColumn(before, F.coalesce(F.sum(before).over(past), F.lit(0)))
    numbered = rows.withColumn(at, F.row_number().over(Window.partitionBy(*source, day).orderBy("ts", "call_id")))
    numbered = _meet(numbered, shift, [*source, day]).withColumn("n", F.col(at) + F.col(before)).drop(day, at, before)
    numbered = numbered.withColumn(run, F.floor((F.col("n") - 1) / RUN)).withColumn(place, F.pmod(F.col("n") - 1, F.lit(RUN)))
    scaled = F.col("outcome").cast("double") * (1 - DECAY) / d(F.col(place))
    ends = numbered.groupBy(*source, F.col(run)).agg((F.sum(scaled) * d(F.lit(RUN - 1))).alias(earlier)).withColumn(run, F.col(run) + 1)
    own = F.sum(scaled).over(Window.partitionBy(*source, run).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) * d(F.col(place))
    base = base_trust(F.col("source_type"))
    start = F.when(F.col(run) == 0, base).otherwise(F.col(earlier) + F.when(F.col(run) == 1, base * d(F.lit(RUN))).otherwise(0.0))
    return _meet(numbered.withColumn("trust", own), ends, [*source, run]).withColumn("trust", start * d(F.col(place) + 1) + F.col("trust")).drop(run, place, earlier)


def current(confirmed: DataFrame) -> DataFrame:
    """Latest trust and number of updates per source."""
    return history(confirmed).groupBy("source_type", "source_id").agg(F.max_by("trust", "n").alias("trust"), F.max("n").alias("n_updates"))


def as_of(lookups: DataFrame, confirmed: DataFrame, bucket: str = "day") -> DataFrame:
    """The lookups with trust as of each one's ts: the last confirmation before it, else the base trust. One at the same ts counts as after.

    lookups: source_type, source_id, ts and any other columns, which come along. Looked up within buckets of time; a
    bucket's earliest lookups take the last trust of the buckets before. The history is written once, as both need it."""
    source = ["source_type", "source_id"]
    h = cut(history(confirmed, bucket).select(*source, "ts", F.lit(1).alias("kind"), "n", "trust", _bucket("ts", bucket).alias("day")))
    q = lookups.select(*source, "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("trust"), _bucket("ts", bucket).alias("day"), F.struct(*lookups.columns).alias("row"))
    rows = q.unionByName(h, allowMissingColumns=True)
    w = Window.partitionBy(*source, "day").orderBy("ts", "kind", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("seen", F.last("trust", ignorenulls=True).over(w)).filter("kind = 0").select(*source, "day", "row", "seen")
    ends = h.groupBy(*source, "day").agg(F.max_by("trust", "n").alias("carried"))
    after = Window.partitionBy(*source).orderBy("day")
    spans = ends.select(*source, "carried", F.col("day").alias("from_day"), F.lead("day").over(after).alias("to_day"))
    asked = q.select(*source, "day").distinct()
    same = lambda c: asked[c].eqNullSafe(spans[c])
    lasts = asked.join(spans, same("source_type") & same("source_id") & (asked["day"] > F.col("from_day")) & (F.col("to_day").isNull() | (asked["day"] <= F.col("to_day"))))
    met = _meet(seen, lasts.select(*[asked[c] for c in (*source, "day")], "carried"), [*source, "day"])
    return met.select("row.*", F.coalesce("seen", "carried", base_trust(F.col("source_type"))).alias("trust"))


def gated(df: DataFrame, thresholds: MemoryThresholds = MemoryThresholds()) -> DataFrame:
    """Adds memory_outcome from tool_name, risk and trust."""
    return df.withColumn("memory_outcome", memory_outcome(F.col("tool_name"), F.col("risk"), F.col("trust"), thresholds))
