"""Security metrics, threshold frontier, tallies, latency and evasion summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.decisions import decide
from .detector import score_with
from .ranges import with_slots


def metrics(df: DataFrame, by: tuple[str, ...] = ("method",), threshold: float = 0.5) -> DataFrame:
    """asr, c_asr, fpr, fnr, utility and counts from label, risk, out_of_scope and action. Empty denominators give null."""
    attack, runs = F.col("label") == 1, F.col("action") != "block"
    eligible = attack & (F.col("risk") < threshold) & F.col("out_of_scope")
    c = df.groupBy(*by).agg(
        F.count_if(attack).alias("n_attacks"),
        F.count_if(~attack).alias("n_benign"),
        F.count_if(eligible).alias("n_chained_eligible"),
        F.count_if(attack & runs).alias("ran"),
        F.count_if(eligible & runs).alias("chained"),
        F.count_if(~attack & (F.col("risk") >= threshold)).alias("false_alarms"),
        F.count_if(attack & (F.col("risk") < threshold)).alias("missed"),
        F.count_if(~attack & runs).alias("useful"),
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select(*by, share(F.col("ran"), F.col("n_attacks")).alias("asr"), share(F.col("chained"), F.col("n_chained_eligible")).alias("c_asr"), share(F.col("false_alarms"), F.col("n_benign")).alias("fpr"), share(F.col("missed"), F.col("n_attacks")).alias("fnr"), share(F.col("useful"), F.col("n_benign")).alias("utility"), "n_attacks", "n_benign", "n_chained_eligible")


def frontier(df: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """asr and utility per block threshold t with combination threshold max(0.1, t - 0.3); rows are expanded in place."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    combo = F.greatest(F.lit(0.1), F.round(F.col("threshold") - 0.3, 6))
    decided = rows.withColumn("action", decide(F.col("risk"), F.col("out_of_scope"), block=F.col("threshold"), block_combo=combo))
    return metrics(decided, ("threshold",)).select("threshold", "asr", "utility")


def memory_tally(df: DataFrame) -> DataFrame:
    """Numbers of committed, quarantined and rejected writes, zero where there are none."""
    return df.agg(*[F.count_if(F.col("memory_outcome") == o).alias(o) for o in ("committed", "quarantined", "rejected")])


def latency(df: DataFrame, by: str = "label", value: str = "ms", percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """n, mean, min, max and nearest-rank percentiles: the value at index min(n-1, round_half_even(p/100*(n-1)))."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    # distinct values, then running counts in two levels: within ranges of about equal numbers and over the ranges' totals
    values = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("m"))
    values = with_slots(values, (by,), value)
    inside = values.withColumn("inside", F.sum("m").over(Window.partitionBy(by, "slot").orderBy(value)))
    slots = values.groupBy(by, "slot").agg(F.sum("m").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = inside.join(slots.select(by, "slot", before.alias("before")), [by, "slot"]).withColumn("upto", F.col("before") + F.col("inside")).join(counts, by)
    index = lambda p: F.least(F.col("n") - 1, F.bround(F.lit(p / 100) * (F.col("n") - 1)))
    here = lambda p: (index(p) < F.col("upto")) & (index(p) >= F.col("upto") - F.col("m"))
    picks = [F.max(F.when(here(p), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(by, "n", "mean", "min", "max").agg(*picks)


def overhead(df: DataFrame, defended: str = "defended", undefended: str = "undefended") -> DataFrame:
    """Adds overhead_pct; infinite where the base is not positive."""
    d, u = F.col(defended), F.col(undefended)
    return df.withColumn("overhead_pct", F.when(u <= 0, F.lit(float("inf"))).otherwise((d - u) / F.when(u > 0, u) * 100))


def evasion_by_round(rounds: DataFrame, max_rounds: int) -> DataFrame:
    """Mean evasion rate per round index; rounds without data are null."""
    means = rounds.groupBy("round_index").agg(F.round(F.avg("evasion_rate"), 6).alias("evasion_rate"))
    return rounds.sparkSession.range(max_rounds).select(F.col("id").cast("int").alias("round_index")).join(means, "round_index", "left")


def evasion_by_version(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("version").agg(F.round(F.avg("evasion_rate"), 6).alias("evasion_rate"))


def recheck_with(evasions: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], threshold: float = 0.5) -> DataFrame:
    """The stored evasions scored by each version's scorer (a DataFrame function that adds score): caught of total per version."""
    scored = [score_with(evasions, f).select(F.lit(version).alias("version"), "score") for version, f in scorers.items()]
    return recheck(reduce(DataFrame.unionByName, scored), threshold)


def recheck(evasions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of stored evasions scored by each version: caught of total."""
    return evasions.groupBy("version").agg(F.count_if(F.col("score") >= threshold).alias("caught"), F.count(F.lit(1)).alias("total"))
