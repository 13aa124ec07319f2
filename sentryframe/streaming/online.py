"""The decision path and keyed state as Structured Streaming, sharing column logic with the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..checkpoints import shared_path
from ..config import BASE_TRUST, UNKNOWN_TRUST, Calibration, FusionConfig
from ..operators import fusion, policy, sequence
from ..operators.sequence import flag_rate  # noqa: F401  the batch form of windowed_flag_rate


def score_stream(calls: DataFrame, policies: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Stateless scoring of a stream (or table) of calls: authorize against static policies, deviation, blend, decide."""
    scoped = policy.authorize(calls, policies).withColumn("out_of_scope", ~F.col("allowed"))
    usual = sequence.deviation(scoped.withColumn("tools", F.array("tool_name"))).withColumn("behavior", F.col("deviation"))
    ready = usual.withColumn("trust", F.lit(1.0)).withColumn("session_risk", F.lit(0.0)).withColumn("twin_unsafe", F.lit(False))
    return fusion.fuse_signals(ready, config).drop("tools", "novel_tools", "deviation", "anomalous")


def windowed_flag_rate(flags: DataFrame, late: str = "1 hour", size: str = "1 day", key: str = "session_id") -> DataFrame:
    """The streaming form: flag rate per key and tumbling window; rows later than the watermark are dropped."""
    kept = flags.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", size), key).agg(F.avg(F.col("flagged").cast("double")).alias("flag_rate"), F.count(F.lit(1)).alias("n"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, keys: tuple[str, ...] = (), order: str | None = None, mode: str = "update") -> DataFrame:
    """Runs a stream until it has caught up with its files; the rows it wrote, or with keys the last (by order) of each key.

    Each micro-batch replaces a folder of its own, so a repeated one changes nothing. State is in RocksDB."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/micro_batch={n}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("micro_batch", LongType())])).parquet(out)
    if not keys:
        return rows.drop("micro_batch")
    rest = [c for c in rows.columns if c not in (*keys, "micro_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order or "micro_batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


class TrustProcessor(StatefulProcessor):
    """Adaptive trust per source: state is the trust and the number of updates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trust", "trust double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, source = key
        trust, n = self.state.get() if self.state.exists() else (BASE_TRUST.get(kind, UNKNOWN_TRUST), 0)
        for x in pd.concat(list(rows)).sort_values(["ts", "call_id"])["outcome"]:
            trust, n = 0.8 * trust + 0.2 * x, n + 1
        self.state.update((trust, n))
        yield pd.DataFrame({"source_type": [kind], "source_id": [source], "trust": [trust], "n_updates": [n]})

    def close(self) -> None:
        pass


class ThresholdProcessor(StatefulProcessor):
    """The calibrated threshold per key."""

    config = Calibration()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("threshold", "threshold double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self.config
        t, n = self.state.get() if self.state.exists() else (c.start, 0)
        for x in pd.concat(list(rows)).sort_values("seq").itertuples():
            pulled = min(x.score, t) if x.malicious else max(x.score, t)
            t, n = max(c.low, min(c.high, t * c.decay + (1 - c.decay) * pulled)), n + 1
        self.state.update((t, n))
        yield pd.DataFrame({"key": [key[0]], "threshold": [t], "n_outcomes": [n]})

    def close(self) -> None:
        pass


class CapProcessor(StatefulProcessor):
    """Running sum per key with a verdict per call."""

    cap = 100.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", "total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = self.state.get()[0] if self.state.exists() else 0.0
        df = pd.concat(list(rows)).sort_values(["ts", "call_id"])
        sums = total + df["amount"].cumsum()
        self.state.update((float(sums.iloc[-1]),))
        yield pd.DataFrame({"key": [key[0]] * len(df), "call_id": df["call_id"].to_numpy(), "running": sums.to_numpy(), "over": (sums > self.cap).to_numpy()})

    def close(self) -> None:
        pass


class RevocationProcessor(StatefulProcessor):
    """When a token was revoked: the first time that its risk reached the limit. Calls from then on are revoked."""

    revoke_at = 0.8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("revoked", "revoked_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        at = df["ts_us"][df["risk"] >= self.revoke_at].min()
        times = [self.state.get()[0]] if self.state.exists() else []
        times += [] if pd.isna(at) else [int(at)]
        if times:
            self.state.update((min(times),))
        revoked = df["ts_us"] >= min(times) if times else pd.Series(False, index=df.index)
        yield pd.DataFrame({"token_id": key[0], "call_id": df["call_id"].to_numpy(), "revoked": revoked.to_numpy()})

    def close(self) -> None:
        pass


class DomainProcessor(StatefulProcessor):
    """The distinct domains of a key so far, each an entry of a map, and a verdict per call."""

    cap = 5

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "domain string", "nth int")
        self.n = handle.getValueState("n", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, out = self.n.get()[0] if self.n.exists() else 0, []
        for x in pd.concat(list(rows)).sort_values(["ts", "call_id"]).itertuples():
            if not self.seen.containsKey((x.domain,)):
                n += 1
                self.seen.updateValue((x.domain,), (n,))
            out.append((key[0], x.call_id, n, n > self.cap))
        self.n.update((n,))
        yield pd.DataFrame(out, columns=["key", "call_id", "n_domains", "over"])

    def close(self) -> None:
        pass


def trust_stream(confirmed: DataFrame) -> DataFrame:
    """Latest trust per source as confirmations (source_type, source_id, ts, call_id, outcome) arrive. Needs the RocksDB state store."""
    return confirmed.groupBy("source_type", "source_id").transformWithStateInPandas(TrustProcessor(), "source_type string, source_id string, trust double, n_updates long", "Update", "None")


def threshold_stream(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("key").transformWithStateInPandas(ThresholdProcessor(), "key string, threshold double, n_outcomes long", "Update", "None")


def cap_stream(amounts: DataFrame, cap: float) -> DataFrame:
    """amounts: key, ts, call_id, amount."""
    p = CapProcessor()
    p.cap = cap
    return amounts.groupBy("key").transformWithStateInPandas(p, "key string, call_id long, running double, over boolean", "Update", "None")


def revocation_stream(calls: DataFrame, revoke_at: float = 0.8) -> DataFrame:
    """Whether each call's token is revoked by its own risk so far. calls: token_id, ts, call_id, risk."""
    p = RevocationProcessor()
    p.revoke_at = revoke_at
    rows = calls.select("token_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "call_id", "risk")
    return rows.groupBy("token_id").transformWithStateInPandas(p, "token_id string, call_id long, revoked boolean", "Update", "None")


def domain_stream(fetches: DataFrame, cap: int = 5) -> DataFrame:
    """fetches: key, ts, call_id, domain."""
    p = DomainProcessor()
    p.cap = cap
    return fetches.groupBy("key").transformWithStateInPandas(p, "key string, call_id long, n_domains int, over boolean", "Update", "None")
