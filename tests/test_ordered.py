"""Event-time streams against their batch forms, restarts and expiry; cascades and chains over many steps."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sentryframe.checkpoints import shared_path
from sentryframe.config import SandboxCaps
from sentryframe.operators import audit, fusion, policy, registry
from sentryframe.sources import tables, views
from sentryframe.streaming import online, ordered

T0 = dt.datetime(2026, 1, 1)
AT = lambda s: T0 + dt.timedelta(seconds=s)


CALLS = "call_id long, ts timestamp, session_id string, role string, tool_name string, resource string, params map<string,string>, injection double, outcome int"


def test_live_decisions_equal_the_pipeline(spark):
    """All rules of a session, equal times, null resources and unknown sources, out of order over many batches."""
    tools = [("send_email", "a@x", {}), ("write_file", "/workspace/f", {}), ("delete_file", "/workspace/f", {}), ("run_code", "/sandbox/a.py", {"timeout_seconds": "25"}), ("issue_refund", "o1", {"amount_usd": "45"}),
             ("fetch_url", "https://a.example/x", {}), ("create_event", None, {"attendee_count": "12"}), ("save_note", "/workspace/notes/n", {}), ("fetch_url", "ftp://b.example", {}), ("delete_file", None, {}), ("cancel_event", "e", {}), ("issue_refund", None, {"amount_usd": "x"})]
    roles = ["email_agent", "file_agent", "code_exec_agent", "nobody"]
    rows = []
    for i in range(240):
        tool, resource, params = tools[(i * 7) % len(tools)]
        rows.append((i, AT((i // 2) * 977), f"s{i % 5}", roles[i // 12 % 4], tool, resource, params, (i * 37 % 100) / 100, [None, 1, 0][i % 3]))
    calls, caps, policies = spark.createDataFrame(rows, CALLS), SandboxCaps(contacts=("a@x",), domains=1), tables.default_policies(spark)
    columns = ["call_id", "violation", "twin_unsafe", "session_risk", "trust", "blended", "action", "message", "memory_outcome"]
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect())
    confirmed = ordered.trust.tagged(calls.filter("outcome is not null"))
    want = plain(fusion.run_pipeline(calls, policies, confirmed, caps, flag_at=0.7))
    live = ordered.live_decisions(views.replayed(calls, batches=6, jitter_seconds=3_600), policies, caps, late="2 hours")
    got = plain(online.run_to_table(live.select(columns), mode="append").filter("call_id is not null"))
    assert got == want and {r[2] for r in got} == {True, False} and len({r[6] for r in got}) == 3


def test_idle_sessions_lose_their_state(spark):
    """A session that goes on after a long silence begins anew, and a call that is later than the watermark is dropped."""
    at = [0, 10, 400_000, 800_000, 5]
    rows = [(i, AT(s), "s", "code_exec_agent", "run_code", "/sandbox/a.py", {"timeout_seconds": "40"}, 0.1, None) for i, s in enumerate(at)]
    df, path = spark.createDataFrame(rows, CALLS), shared_path(spark, "idle")
    for r in [*rows, (99, AT(9_000_000), "other", *rows[0][3:])]:
        spark.createDataFrame([r], CALLS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = ordered.live_decisions(stream, tables.default_policies(spark), late="1 hour", idle=100_000)
    got = {r.call_id: r.twin_unsafe for r in online.run_to_table(live.select("call_id", "twin_unsafe"), mode="append").collect()}
    assert got == {0: False, 1: True, 2: False, 3: False}  # 40, 80 over the cap of 60, then 40 twice anew; call 4 came too late


def test_state_does_not_grow_with_age(spark):
    """Sessions come and go over a long time; the state of those that are silent goes, so its size stays."""
    path, schema = shared_path(spark, "long"), spark.createDataFrame([], CALLS).schema
    for k in range(8):
        rows = [(k * 20 + i, AT(k * 50_000 + i * 100), f"s{k}-{i % 10}", "email_agent", "send_email", "a@x", {}, 0.1, 1) for i in range(20)]
        spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(path)
    calls = ordered.trust.tagged(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    ready = ordered._signals(ordered.with_event_time(calls, "1 minute"), tables.default_policies(spark), SandboxCaps())
    stream = ordered.in_order(ready, ("session_id",), ordered.SessionProcessor(SandboxCaps(), 0.7, flag_seconds=600, idle=20_000))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    q = stream.writeStream.format("noop").option("checkpointLocation", shared_path(spark, "long-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes[len(sizes) // 2 :]) <= max(sizes[: len(sizes) // 2]) and sizes[-1] < 3 * max(sizes) / 2


def test_many_rows_of_one_key_wake_it_once(spark):
    """5,000 rows of one source at 5,000 times are few entries of the state and few timers, and their trust is that of a plain fold."""
    ddl = "source_type string, source_id string, ts timestamp, call_id long, outcome int"
    rows = [("tool_code", None if i % 2 else "s", T0 + dt.timedelta(milliseconds=700 * i), i, i // 7 % 2 if i % 3 else None) for i in range(5_000)]
    path = shared_path(spark, "one-key")
    for part in (rows, [("user_input", "end", AT(9_000_000), -1, None)]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    out = shared_path(spark, "one-key-out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)
    q = ordered.trust_as_of_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 50
    want, now = {}, {None: 0.4, "s": 0.4}
    for _, source, _, i, outcome in rows:
        want[i] = round(now[source], 9)
        now[source] = now[source] if outcome is None else 0.8 * now[source] + 0.2 * outcome
    assert {r.call_id: round(r.trust, 9) for r in spark.read.parquet(out).collect()} == want


def test_trigger_buffer_over_a_restart(spark):
    """Any split into batches and a stopped query give the triggers of the batch form, each once."""
    rows = [(i % 3, i) for i in range(200)]
    df, path, out = spark.createDataFrame(rows, "key long, seq long"), shared_path(spark, "evasions"), shared_path(spark, "triggers")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKS)

    def go():
        stream = ordered.trigger_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), 20)
        sink = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/micro_batch={n}")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
        q.awaitTermination()

    for first, last in ((0, 7), (7, 95), (95, 96)):
        df.filter((F.col("seq") >= first) & (F.col("seq") < last)).coalesce(1).write.mode("append").parquet(path)
    go()
    df.filter("seq >= 96").coalesce(1).write.mode("append").parquet(path)
    go()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.key, r.seq, r.batch, r.entries) for r in spark.read.parquet(out).collect())
    want = sorted((r.key, r.seq, r.batch) for r in registry.trigger_points(df, 20).collect())
    assert [g[:3] for g in got] == want and all(len(g[3]) == 20 and g[3][-1] == g[1] for g in got)


# ---- cascades ----
def brute_cascade(parent, issued, starts, was, strict=False):
    """The earliest time that reaches each token, by walking down from every start."""
    children = {}
    for t, p in parent.items():
        children.setdefault(p, []).append(t)
    out = {}
    for s, at in starts:
        ok = lambda t: t in issued and issued[t] <= at and (strict or t not in was or was[t] > at)
        todo, seen = [s] if ok(s) else [], set()
        while todo:
            t = todo.pop()
            if t not in seen:
                seen.add(t)
                out[t] = min(at, out.get(t, at))
                todo += [c for c in children.get(t, []) if ok(c)]
    return out


def test_cascades_equal_brute_force(spark):
    """Tokens issued long after their parents, revoked before at any time, started at any time, in trees and a cycle."""
    import random

    rng = random.Random(4)
    parent = {f"t{i}": f"t{rng.randrange(max(0, i - 6), i)}" if i else None for i in range(120)} | {"a": "c", "b": "a", "c": "b"}
    issued = {t: rng.randrange(60) for t in parent}
    starts = [(t, rng.randrange(80)) for t in parent if rng.random() < 0.3]
    was = {t: rng.randrange(80) for t in parent if rng.random() < 0.2}
    creds = spark.createDataFrame([(t, p, AT(issued[t])) for t, p in parent.items()], "token_id string, derived_from string, issued_at timestamp")
    times = lambda rows: spark.createDataFrame([(t, AT(s)) for t, s in rows], "token_id string, revoked_at timestamp")
    for strict in (False, True):
        got = {r.token_id: r.revoked_at for r in policy.revoke_cascade(creds, times(starts), times(was.items()), strict).collect()}
        assert got == {t: AT(s) for t, s in brute_cascade(parent, issued, starts, was, strict).items()}


def test_a_chain_of_ten_thousand_tokens_takes_few_steps(spark):
    n = 10_000
    creds = spark.range(n).select(F.concat(F.lit("t"), "id").alias("token_id"), F.when(F.col("id") > 0, F.concat(F.lit("t"), F.col("id") - 1)).alias("derived_from"), F.lit(T0).alias("issued_at"))
    assert len(policy._jumps(policy._tokens(creds))) <= 15
    got = policy.revoke_cascade(creds, spark.createDataFrame([("t5", AT(9)), ("t9000", AT(3))], "token_id string, revoked_at timestamp"))
    assert {(r.revoked_at, r["count"]) for r in got.groupBy("revoked_at").count().collect()} == {(AT(9), 8_995), (AT(3), 1_000)}


def test_lineage_grows_by_new_tokens(spark):
    ddl = "token_id string, derived_from string, issued_at timestamp"
    old = [("a", None, AT(1)), ("b", "a", AT(5)), ("c", "b", AT(3))]
    new = [("d", "c", AT(2)), ("e", "d", AT(9)), ("f", None, AT(1))]
    whole = policy.lineage(spark.createDataFrame(old + new, ddl))
    grown = policy.extend_lineage(policy.lineage(spark.createDataFrame(old, ddl)), spark.createDataFrame(new, ddl))
    rows = lambda df: sorted((r.ancestor, r.token_id, r.issued) for r in df.collect())
    assert rows(grown) == rows(whole) and ("a", "d", AT(5)) in rows(whole) and len(rows(whole)) == 16


# ---- continued chains ----
def test_chains_are_continued(spark):
    ddl = "log_id string, seq long, payload string"
    store = audit.ChainStore(spark, shared_path(spark, "chain"))
    assert store.heads().count() == store.entries().count() == 0
    one, two = [("a", 0, "p0"), ("a", 1, "p1"), ("b", 0, "q0")], [("a", 2, "p2"), ("c", 0, "r0")]
    assert store.append(spark.createDataFrame(one, ddl), 0) and store.append(spark.createDataFrame(two, ddl), 1)
    before = sorted(map(tuple, store.heads().collect()))
    assert not store.append(spark.createDataFrame(two, ddl), 1) and sorted(map(tuple, store.heads().collect())) == before
    h = "0" * 64
    for p in ("p0", "p1", "p2"):
        h = hashlib.sha256((h + p).encode()).hexdigest()
    assert ("a", h, 2, 3) in before and len(before) == 3
    assert all(r.intact for r in audit.verify(store.entries(), store.heads().select("log_id", F.col("n_entries").alias("expected"))).collect())
    with pytest.raises(Exception, match="not after the last entry of log a"):
        store.append(spark.createDataFrame([("a", 2, "again")], ddl), 2)
    assert store.batches() == [0, 1] and store.entries().count() == 5  # what failed doesn't count
    assert store.append(spark.createDataFrame([("a", 3, "p3")], ddl), 2) and store.entries().count() == 6
