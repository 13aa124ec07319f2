"""Sources and sinks, and the parity of streams with their batch forms."""

import pytest
from pyspark.sql import functions as F

from sentryframe.operators import audit, memory, sequence, trust
from sentryframe.sources import tables, views
from sentryframe.streaming import online

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_csv_and_fallbacks(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('text,label,attack_type,original_attack_type,original_text,source_dataset,split\n"a, ""b""\nc",1,x,,,hf_csv,train\nd,0,,,,hf_csv2,test\n,1,,,,hf_csv3,train\ne,?,,,,other,train\n')
    rows = sorted(tuple(r) for r in tables.read_csv(spark, str(p)).select("text", "label", "category", "source", "split_role").collect())
    assert rows == [('a, "b"\nc', 1, "x", "neuralchemy", "train"), ("d", 0, "unknown", "qualifire_holdout", "test")]
    assert tables.read_first(spark, [str(tmp_path / "no"), str(tmp_path / "none")]).count() == 0
    built = tables.cached(spark, str(tmp_path / "cache"), lambda: spark.range(3))
    assert built.count() == 3 and tables.cached(spark, str(tmp_path / "cache"), lambda: 1 / 0).count() == 3
    (tmp_path / "cache" / "_SUCCESS").unlink()  # as a write that broke off leaves it
    assert tables.cached(spark, str(tmp_path / "cache"), lambda: spark.range(5)).count() == 5
    (tmp_path / "bad").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        tables.read_first(spark, [str(tmp_path / "bad"), str(p)]).collect()


def test_policies_from_files(spark, tmp_path):
    for p in tables.POLICY_DIR.glob("*.json"):
        (tmp_path / p.name).write_text(p.read_text())
    assert tables.read_policies(spark, str(tmp_path)).count() == 6 == tables.default_policies(spark).count()
    (tmp_path / "again.json").write_text((tmp_path / "file_agent.json").read_text())
    with pytest.raises(ValueError, match="file_agent"):
        tables.read_policies(spark, str(tmp_path))


def test_audit_round_trip(spark, tmp_path):
    chained = audit.append(spark.createDataFrame([("a", i, f"p{i}") for i in range(3)], "log_id string, seq long, payload string"))
    tables.write_audit(chained, str(tmp_path / "log"))
    assert audit.verify(tables.read_audit(spark, str(tmp_path / "log"))).first().intact
    tables.write_results(chained, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def _replay(spark, df, out, tmp_path, name, order, batches=3):
    """Writes df in order as several files and runs the stream over them one by one; the last row per key is returned."""
    path = str(tmp_path / name)
    n = df.count()
    numbered = df.orderBy(*order).coalesce(1).withColumn("no", F.monotonically_increasing_id()).cache()
    for i in range(batches):
        numbered.filter((F.col("no") >= i * n // batches) & (F.col("no") < (i + 1) * n // batches)).drop("no").coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    got = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = out(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).foreachBatch(lambda b, k: got.extend((k, r) for r in b.collect())).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return got


def test_trust_stream_equals_batch(spark, sf_dir, tmp_path):
    confirmed = views.confirmations(trust.tagged(views.tool_calls(spark, sf_dir))).select("source_type", "source_id", "ts", "call_id", "outcome")
    got = {(r.source_type, r.source_id): (round(r.trust, 9), r.n_updates) for _, r in _replay(spark, confirmed, online.trust_stream, tmp_path, "trust", ("ts", "call_id"))}
    want = {(r.source_type, r.source_id): (round(r.trust, 9), r.n_updates) for r in trust.current(confirmed).collect()}
    assert got == want


def test_threshold_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = views.tool_calls(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("call_id").alias("seq"), F.col("injection").alias("score"), (F.col("value") < 50).alias("malicious"))
    got = {r.key: round(r.threshold, 9) for _, r in _replay(spark, rows, online.threshold_stream, tmp_path, "thr", ("seq",))}
    want = {r.key: round(r.threshold, 9) for r in memory.calibrate(rows).collect()}
    assert got == want


def test_cap_stream_equals_batch(spark, sf_dir, tmp_path):
    calls = views.tool_calls(spark, sf_dir)
    rows = calls.filter("tool_name = 'run_code'").select(F.col("session_id").alias("key"), "ts", "call_id", sequence.param("timeout_seconds").alias("amount"))
    got = {r.call_id: r.over for _, r in _replay(spark, rows, lambda s: online.cap_stream(s, 60.0), tmp_path, "cap", ("ts", "call_id"))}
    want = {r.call_id: r.over for r in sequence.running(calls, "run_code", "timeout_seconds", ("session_id",), "s").select("call_id", (F.col("s") > 60).alias("over")).collect()}
    assert got == want


def test_revocation_stream_equals_batch(spark, sf_dir, tmp_path):
    calls = views.tool_calls(spark, sf_dir).select("token_id", "ts", "call_id", F.col("injection").alias("risk"))
    got = {r.call_id: r.revoked for _, r in _replay(spark, calls, lambda s: online.revocation_stream(s, 0.98), tmp_path, "revoked", ("ts", "call_id"))}
    firsts = calls.filter("risk >= 0.98").groupBy("token_id").agg(F.min("ts").alias("at"))
    want = {r.call_id: r.revoked for r in calls.join(firsts, "token_id", "left").select("call_id", F.coalesce(F.col("at") <= F.col("ts"), F.lit(False)).alias("revoked")).collect()}
    assert got == want and any(want.values())


def test_domain_stream_equals_batch(spark, sf_dir, tmp_path):
    calls = views.tool_calls(spark, sf_dir)
    batch = sequence.running_domains(calls, "user_id")
    rows = batch.select(F.col("user_id").cast("string").alias("key"), "ts", "call_id", "domain")
    got = {r.call_id: (r.n_domains, r.over) for _, r in _replay(spark, rows, lambda s: online.domain_stream(s, 2), tmp_path, "domains", ("ts", "call_id"))}
    assert got == {r.call_id: (r.n_domains, r.n_domains > 2) for r in batch.collect()}


def test_scoring_stream_equals_batch(spark, sf_dir, tmp_path):
    calls = views.tool_calls(spark, sf_dir)
    policies = tables.default_policies(spark)
    got = {r.call_id: r.action for _, r in _replay(spark, calls, lambda s: online.score_stream(s, policies).select("call_id", "action"), tmp_path, "score", ("call_id",), 2)}
    assert got == {r.call_id: r.action for r in online.score_stream(calls, policies).collect()}


def test_windowed_flag_rate_drops_late_rows(spark, tmp_path):
    import datetime as dt

    t = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [("s", t(1), 1), ("s", t(2), 0), ("s", t(60), 1), ("s", t(61), 1), ("s", t(3), 1), ("s", t(120), 0)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, flagged int")
    path = str(tmp_path / "late")
    for i in range(len(rows)):
        spark.createDataFrame(rows[i : i + 1], df.schema).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)
    got = []
    stream = online.windowed_flag_rate(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "late-ck")).trigger(availableNow=True).foreachBatch(lambda b, k: got.extend(b.collect())).start()
    q.awaitTermination()
    assert {(r.flag_rate, r.n) for r in got} == {(0.5, 2), (1.0, 2)}
