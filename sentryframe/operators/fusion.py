"""Risk fusion: baseline deciders, configuration matrix, and the whole row pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FusionConfig, RiskWeights, SandboxCaps
from ..functions.decisions import blend, decide, decision_reason
from . import policy, sequence, trust


def fuse(df: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Adds action and executes from risk and out_of_scope."""
    action = decide(F.col("risk"), F.col("out_of_scope"), config=config)
    return df.withColumn("action", action).withColumn("executes", F.col("action") != "block")


def fuse_signals(df: DataFrame, config: FusionConfig = FusionConfig(), weights: RiskWeights = RiskWeights(), combiner=blend) -> DataFrame:
    """Adds blended, action and executes. Columns: injection, behavior, trust, out_of_scope, session_risk, twin_unsafe. The
    combination rule looks at the raw injection score."""
    signals = {"injection": F.col("injection"), "behavior": F.col("behavior"), "trust": F.col("trust"), "session": F.col("session_risk"), "privilege": F.col("out_of_scope"), "twin": F.col("twin_unsafe")}
    out = df.withColumn("blended", combiner(signals, weights))
    action = decide(F.col("blended"), F.col("out_of_scope"), F.col("injection"), F.col("twin_unsafe"), config)
    return out.withColumn("action", action).withColumn("executes", F.col("action") != "block")


def explained(df: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Adds decision_reason and message to decided rows (blended, injection, out_of_scope, action): why a call was stopped or flagged."""
    reason = decision_reason(F.col("blended"), F.col("out_of_scope"), F.col("injection"), config)
    message = F.when(F.col("action") == "block", F.concat(F.lit("Blocked before reaching the agent: "), "decision_reason")).when(F.col("action") == "flag", F.concat(F.lit("Allowed, but flagged for review: "), "decision_reason"))
    return df.withColumn("decision_reason", reason).withColumn("message", message.otherwise("No conflict: proceeding to the agent."))


def methods(df: DataFrame, config: FusionConfig = FusionConfig(), threshold: float = 0.5) -> DataFrame:
    """Each row once per decider: framework, detection_only (risk >= threshold), privilege_only (out of scope)."""
    wide = df.withColumn("framework", decide(F.col("risk"), F.col("out_of_scope"), config=config))
    wide = wide.withColumn("detection_only", F.when(F.col("risk") >= threshold, "block").otherwise("allow"))
    wide = wide.withColumn("privilege_only", F.when(F.col("out_of_scope"), "block").otherwise("allow"))
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("action")) for m in ("framework", "detection_only", "privilege_only")])
    return wide.select(*df.columns, F.inline(each))  # compiles as one stage, which unpivot does not


def matrix(df: DataFrame, config: FusionConfig = FusionConfig(), weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Every row under the eight on/off settings of behavior, twin and provenance. Rows are expanded in place from a fixed
    array of settings, so the table is read once and nothing is joined."""
    settings = F.array(*[F.struct(F.lit(f"behavior={b} twin={t} provenance={p}").alias("setting"), F.lit(bool(b)).alias("b"), F.lit(bool(t)).alias("t"), F.lit(bool(p)).alias("p")) for b in (0, 1) for t in (0, 1) for p in (0, 1)])
    rows = df.withColumn("s", F.explode(settings))
    rows = rows.withColumn("behavior", F.when(F.col("s.b"), F.col("behavior")).otherwise(0.0)).withColumn("twin_unsafe", F.col("s.t") & F.col("twin_unsafe")).withColumn("trust", F.when(F.col("s.p"), F.col("trust")).otherwise(1.0))
    any_on = F.col("s.b") | F.col("s.t") | F.col("s.p")
    out = fuse_signals(rows, config, weights)
    plain = decide(F.col("injection"), F.col("out_of_scope"), config=config)
    return out.withColumn("action", F.when(any_on, F.col("action")).otherwise(plain)).withColumn("setting", F.col("s.setting")).drop("s")


def run_pipeline(calls: DataFrame, policies: DataFrame, confirmed: DataFrame, caps: SandboxCaps = SandboxCaps(), config: FusionConfig = FusionConfig(), flag_at: float | None = None, flag_seconds: int = 86_400) -> DataFrame:
    """Authorize, check sequences, look trust up, blend, decide, gate memory writes. calls also has injection (the detector's score).

    The session's risk is 0, or with flag_at the share of its calls with a greater injection in the flag_seconds before."""
    scoped = policy.authorize(calls, policies).withColumn("out_of_scope", ~F.col("allowed"))
    checked = sequence.sandbox(scoped, caps).withColumn("twin_unsafe", ~F.col("safe"))
    usual = sequence.deviation(checked.withColumn("tools", F.array("tool_name"))).withColumn("behavior", F.col("deviation")).drop("tools", "novel_tools", "deviation", "anomalous")
    if flag_at is None:
        usual = usual.withColumn("session_risk", F.lit(0.0))
    else:
        flagged = usual.withColumn("flagged", (F.col("injection") > flag_at).cast("int"))
        usual = sequence.flag_rate(flagged, flag_seconds).withColumnRenamed("session_history_risk", "session_risk").drop("flagged")
    signals = trust.as_of(trust.tagged(usual), confirmed)  # carries the calls along
    decided = explained(fuse_signals(signals, config), config)
    return trust.gated(decided.withColumn("risk", F.col("injection")))
