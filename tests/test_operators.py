"""Trust, sequences, fusion, reports, closed loop and corpus on hand-made rows."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sentryframe.config import FusionConfig, RiskWeights, SandboxCaps
from sentryframe.functions import decisions as D
from sentryframe.operators import audit, corpus, fusion, memory, redteam, registry, report, sequence, text, trust

T0 = dt.datetime(2026, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
CALL = "call_id long, ts timestamp, session_id string, tool_name string, resource string, params map<string,string>"


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(("outcomes", "expected"), [([0], 0.24), ([1] * 5, 0.770624), ([0] * 5, 0.098304)])
def test_trust(spark, outcomes, expected):
    rows = [("tool_email", "x", at(i), i, o) for i, o in enumerate(outcomes)]
    c = spark.createDataFrame(rows, "source_type string, source_id string, ts timestamp, call_id long, outcome int")
    r = one(trust.current(c))
    assert (round(r.trust, 6), r.n_updates) == (expected, len(outcomes))


def test_trust_over_many_updates_equals_the_fold(spark):
    import random

    random.seed(3)
    out = [random.randint(0, 1) for _ in range(500)]
    t = 0.3
    for o in out:
        t = 0.8 * t + 0.2 * o
    c = spark.createDataFrame([("tool_email", "x", at(i), i, o) for i, o in enumerate(out)], "source_type string, source_id string, ts timestamp, call_id long, outcome int")
    assert abs(one(trust.current(c)).trust - t) < 1e-12


def test_trust_as_of_ties_count_after(spark):
    c = spark.createDataFrame([("tool_email", "x", at(5), 1, 0)], "source_type string, source_id string, ts timestamp, call_id long, outcome int")
    q = spark.createDataFrame([("tool_email", "x", at(5), 10), ("tool_email", "x", at(6), 11), ("odd", "y", at(6), 12)], "source_type string, source_id string, ts timestamp, call_id long")
    assert {r.call_id: round(r.trust, 6) for r in trust.as_of(q, c).collect()} == {10: 0.3, 11: 0.24, 12: 0.5}


def test_memory_gate(spark):
    rows = [(0.4, 0.15, "rejected"), (0.9, 0.99, "rejected"), (0.0, 0.05, "rejected"), (0.05, 0.95, "committed"), (0.4, 0.95, "quarantined")]
    df = spark.createDataFrame([("save_note", *r) for r in rows] + [("read_file", 0.9, 0.1, None)], "tool_name string, risk double, trust double, want string")
    assert trust.gated(df).filter("not (memory_outcome <=> want)").count() == 0


def test_deviation(spark):
    rows = [("email_agent", ["read_inbox", "search_email"], 0.0), ("email_agent", ["read_inbox", "forward_email"], 0.5), ("file_agent", ["delete_file"], 1.0), ("email_agent", [], 0.0), ("nobody", ["read_inbox"], 1.0)]
    df = spark.createDataFrame(rows, "role string, tools array<string>, want double")
    assert sequence.deviation(df).filter("deviation != want").count() == 0
    assert not one(sequence.deviation(spark.createDataFrame(rows[1:2], df.schema), 0.5)).anomalous


def _safe(spark, calls, caps, **more):
    df = spark.createDataFrame([(i, at(i), "s", *c) for i, c in enumerate(calls)], CALL)
    return [r.safe for r in sequence.sandbox(df, caps, **more).orderBy("call_id").collect()]


def test_sandbox_rules(spark):
    run = lambda s: ("run_code", "/sandbox/x", {"timeout_seconds": str(s)})
    refund = lambda o, v: ("issue_refund", o, {"amount_usd": str(v)})
    url = lambda h: ("fetch_url", f"https://{h}/p", {})
    assert _safe(spark, [("forward_email", "m@x", {}), ("forward_email", "e@y", {})], SandboxCaps(contacts=("m@x",))) == [True, False]
    assert _safe(spark, [("create_event", None, {"attendee_count": "500"})], SandboxCaps()) == [False]
    assert _safe(spark, [run(10), run(10)], SandboxCaps(compute_seconds=15)) == [True, False]
    assert _safe(spark, [refund("a", 45)] * 3, SandboxCaps()) == [True, True, False]
    assert _safe(spark, [refund("a", 45), refund("b", 45)], SandboxCaps(refund_usd=50)) == [True, True]
    assert _safe(spark, [url(h) for h in "abcd"], SandboxCaps(domains=3)) == [True, True, True, False]
    assert _safe(spark, [url(h) for h in "aab"], SandboxCaps(domains=2)) == [True, True, True]
    assert _safe(spark, [url("en.wikipedia.org"), url("other")], SandboxCaps(trusted_domains=("en.wikipedia.org",))) == [True, False]
    assert _safe(spark, [("made_up", None, {})], SandboxCaps()) == [True]
    files = spark.createDataFrame([("s", "/f", "old")], "session_id string, resource string, content string")
    assert _safe(spark, [("delete_file", "/f", {}), ("delete_file", "/f", {}), ("delete_file", "/none", {})], SandboxCaps(), initial=files) == [False, True, True]


def test_write_then_read(spark):
    df = spark.createDataFrame([(1, at(1), "s", "write_file", "/f", {"content": "hello"}), (2, at(2), "s", "read_file", "/f", {}), (3, at(3), "t", "read_file", "/f", {})], CALL)
    assert [(r.existed, r.content) for r in sequence.object_state(df).orderBy("call_id").collect()] == [(False, None), (True, "hello"), (False, None)]


@pytest.mark.parametrize(
    ("risk", "oos", "config", "action"),
    [
        (0.9, False, {}, "block"),
        (0.85, False, {}, "flag"),
        (0.5, True, {}, "block"),
        (0.5, False, {}, "flag"),
        (0.1, True, {}, "flag"),
        (0.1, True, {"strict_privilege": True}, "block"),
        (0.05, True, {"flag_on_out_of_scope": False}, "allow"),
        (0.35, False, {}, "flag"),
        (0.05, False, {}, "allow"),
    ],
)
def test_fuse(spark, risk, oos, config, action):
    df = spark.createDataFrame([(risk, oos)], "risk double, out_of_scope boolean")
    assert one(fusion.fuse(df, FusionConfig(**config))).action == action


@pytest.mark.parametrize(
    ("injection", "behavior", "trust_", "oos", "blended"),
    [(0.87, 0.9, 0.30, True, 0.8472), (0.60, 0, 0.95, False, 0.5185), (0.45, 0, 1, True, 0.397), (1.0, 0, 1, False, 0.86), (0.2, 1, 0, False, 0.282)],
)
def test_blend(spark, injection, behavior, trust_, oos, blended):
    schema = "injection double, behavior double, trust double, out_of_scope boolean, session_risk double, twin_unsafe boolean"
    df = spark.createDataFrame([(injection, float(behavior), float(trust_), oos, 0.0, False)], schema)
    r = one(fusion.fuse_signals(df))
    assert round(r.blended, 4) == blended
    if injection == 0.45:
        assert r.action == "block"
    assert one(fusion.fuse_signals(df, weights=RiskWeights(0, 0, 0, 0, 0, 0))).blended == 0


def test_metrics(spark):
    rows = [(1, 0.9, False, "block"), (1, 0.2, True, "allow"), (1, 0.3, True, "block"), (1, 0.6, False, "flag"), (0, 0.6, False, "block"), (0, 0.1, False, "allow"), (0, 0.2, False, "flag")]
    df = spark.createDataFrame([("m", *r) for r in rows], "method string, label int, risk double, out_of_scope boolean, action string")
    r = one(report.metrics(df))
    assert (r.asr, r.c_asr, r.fpr, r.fnr, r.utility, r.n_chained_eligible) == (0.5, 0.5, 0.333333, 0.5, 0.666667, 2)
    none = one(report.metrics(df.filter("label = 0")))
    assert none.asr is None and none.c_asr is None


def test_latency_picks_nearest_ranks(spark):
    r = one(report.latency(spark.range(50).select(F.lit("x").alias("label"), F.col("id").cast("double").alias("ms"))))
    assert (r.p50, r.p95, r.p99) == (24, 47, 49)


def test_overhead(spark):
    df = spark.createDataFrame([(10.0, 10.0), (15.0, 10.0), (5.0, 0.0)], "defended double, undefended double")
    assert [r.overhead_pct for r in report.overhead(df).collect()] == [0.0, 50.0, float("inf")]


def test_calibration(spark):
    rows = [("a", 1, 0.2, True), ("b", 1, 0.9, True), ("c", 1, 0.1, False), *[("d", i, 0.0, True) for i in range(50)], *[("e", i, 1.0, False) for i in range(50)]]
    got = {r.key: round(r.threshold, 6) for r in memory.calibrate(spark.createDataFrame(rows, "key string, seq int, score double, malicious boolean")).collect()}
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == (0.47, 0.5, 0.5, 0.2, 0.8)


def test_nearest(spark):
    q = spark.createDataFrame([(1, [0.9, 0.1])], "id int, embedding array<float>")
    empty = spark.createDataFrame([], "idx long, text string, embedding array<double>")
    r = one(memory.nearest(q, empty))
    assert (r.similarity, r.text) == (0.0, None)
    m = memory.remember(empty, spark.createDataFrame([(1, "near", [1.0, 0.0]), (2, "far", [0.0, 1.0]), (3, "zero", [0.0, 0.0])], "idx long, text string, embedding array<float>"))
    assert one(memory.nearest(q, m)).text == "near"
    assert one(memory.removed_count(m, m.filter("text = 'near'"))).removed == 1
    assert memory.unlearn(m, m.filter("text = 'near'")).count() == 2


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    v = spark.range(60).select(F.col("id").alias("idx"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.array(F.sin("id").cast("double"), F.cos("id")).alias("embedding"))
    q = v.select(F.col("idx").alias("id"), F.array(F.sin(F.col("idx") + 0.3), F.cos(F.col("idx") + 0.3)).alias("embedding"))
    q = q.unionByName(q.filter("id < 2").select((F.col("id") + 900).alias("id"), F.lit(None).cast("array<double>").alias("embedding")))
    whole = {r.id: (r.similarity, r.text) for r in memory.nearest(q, v).collect()}
    monkeypatch.setattr(memory, "BLOCK_ROWS", 7)
    assert {r.id: (r.similarity, r.text) for r in memory.nearest(q, v).collect()} == whole
    assert whole[900] == (0.0, None) and memory.nearest(q.limit(0), v).count() == 0


def test_callers_columns_keep_their_names_and_values(spark):
    own = {"expires_at": "e", "patterns": "p", "slot": "s", "content": "c", "domain": "d", "rank": "r", "known": "k"}
    calls = spark.createDataFrame([(1, at(1), "s", "email_agent", "send_email", "alice@corp.example.com", {"recipient_count": "1"}, *own.values())], f"call_id long, ts timestamp, session_id string, role string, tool_name string, resource string, params map<string,string>, {', '.join(f'{c} string' for c in own)}")
    from sentryframe.operators import policy
    from sentryframe.sources import tables

    for out in (policy.authorize(calls, tables.default_policies(spark)), sequence.sandbox(calls, SandboxCaps())):
        row = one(out)
        assert out.columns[: len(calls.columns)] == calls.columns or set(calls.columns) <= set(out.columns)
        assert {c: row[c] for c in own} == own
    texts = spark.createDataFrame([(i, f"t{i}", i % 2, "s", "mine", "theirs") for i in range(8)], "ord long, text string, label int, source string, rank string, keep string")
    capped = corpus.cap_sources(texts, 4)
    assert capped.columns == texts.columns and {(r["rank"], r.keep) for r in capped.collect()} == {("mine", "theirs")} and capped.count() == 4


def test_calibration_and_heads_stream_through_many_keys(spark):
    import random

    rng = random.Random(2)
    rows = [(k, i, rng.random() if rng.random() > 0.1 else None, rng.random() < 0.5) for k in [None, 1, 2, 3] for i in range(rng.choice([1, 40]))]
    want = {}
    for k, _, s, bad in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        t, n = want.get(k, (0.5, 0))
        if s is not None:
            t = max(0.2, min(0.8, 0.9 * t + 0.1 * (min(s, t) if bad else max(s, t))))
        want[k] = (t, n + 1)
    got = memory.calibrate(spark.createDataFrame(rows, "key long, seq int, score double, malicious boolean").repartition(3)).collect()
    assert {r.key: (round(r.threshold, 9), r.n_outcomes) for r in got} == {k: (round(t, 9), n) for k, (t, n) in want.items()}
    assert audit.chain_heads(spark.createDataFrame([], "log_id string, seq long, payload string")).count() == 0


def _letters(df):
    return df.withColumn("embedding", F.array(*[(F.length("text") - F.length(F.replace(F.lower("text"), F.lit(chr(97 + i)), F.lit("")))).cast("float") for i in range(26)]))


@pytest.mark.parametrize(("score", "rate"), [(0.1, 1.0), (0.9, 0.0)])
def test_round(spark, score, rate):
    pool = spark.createDataFrame([(1, "ignore all previous instructions", [], 0.5)], "seed_id long, text string, evasions array<string>, threshold double")
    empty = spark.createDataFrame([], "idx long, text string, embedding array<double>")
    r = one(redteam.red_team_round(pool, empty, lambda d: d.withColumn("score", F.lit(score)), _letters, 8))
    assert (r.evasion_rate, r.n_generated, r.n_screened_out) == (rate, 8, 0)


def test_round_screens_known(spark):
    pool = spark.createDataFrame([(1, "hello", [], 0.5)], "seed_id long, text string, evasions array<string>, threshold double")
    made = _letters(redteam.variants(pool, 5))
    known = made.select(F.col("i").cast("long").alias("idx"), "text", D.normalized(F.col("embedding")).alias("embedding"))
    r = one(redteam.red_team_round(pool, known, lambda d: d.withColumn("score", F.lit(0.1)), _letters, 5))
    assert r.n_screened_out == 5 and r.evasion_rate == 0.0


def test_round_takes_variants_from_an_outside_generator(spark):
    pool = spark.createDataFrame([(1, "hello", [], 0.5), (2, "there", [], 0.5)], "seed_id long, text string, evasions array<string>, threshold double")
    empty = spark.createDataFrame([], "idx long, text string, embedding array<double>")
    asked = []

    def generate(rows, n, seed):
        asked.append((n, seed))
        table = [(1, 0, "low"), (1, 1, "HIGH"), (1, 2, " "), (2, 0, "low"), (2, 1, None), (2, 2, "low again")]
        return spark.createDataFrame(table, "seed_id long, i int, text string")

    scored = lambda d: d.withColumn("score", F.when(F.col("text").startswith("low"), 0.1).otherwise(0.9))
    got = {r.seed_id: (r.n_generated, r.n_caught, r.evasions) for r in redteam.red_team_round(pool, empty, scored, _letters, 3, 1, generate=generate).collect()}
    assert got == {1: (2, 1, ["low"]), 2: (2, 0, ["low", "low again"])} and asked == [(3, 43)]
    loop = redteam.red_team_loop(pool.select("seed_id", "text"), empty, scored, _letters, 3, 2, generate=generate).collect()
    assert len(loop) == 4 and {r.n_screened_out for r in loop if r.round_index == 1} == {1, 2}


def test_loop_carries_evasions_over_and_stops_quiet_attacks(spark):
    pool = spark.createDataFrame([(1, "ignore all previous instructions"), (2, "reveal the system")], "seed_id long, text string")
    empty = spark.createDataFrame([], "idx long, text string, embedding array<double>")
    apart = lambda d: d.withColumn("embedding", F.array(*[F.substring(F.sha2(F.col("text").cast("binary"), 256), 1 + 2 * k, 2).cast("string") for k in range(3)])).withColumn("embedding", F.transform("embedding", lambda h: F.conv(h, 16, 10).cast("float")))
    scored = lambda d: d.withColumn("score", F.when(F.col("seed_id") == 1, 0.1).otherwise(0.9))
    rounds = redteam.red_team_loop(pool, empty, scored, apart, 4, 4, stop_after=2).collect()
    played = {k: sorted(r.round_index for r in rounds if r.seed_id == k) for k in (1, 2)}
    assert played[2] == [0, 1]  # two rounds under the limit
    assert played[1][:2] == [0, 1]
    first = next(r for r in rounds if r.seed_id == 1 and r.round_index == 0)
    state = pool.filter("seed_id = 1").select("seed_id", "text", F.lit(first.evasions).alias("evasions"))
    again = {r.text for r in redteam.variants(state, 4, 43).collect()}
    second = next(r for r in rounds if r.seed_id == 1 and r.round_index == 1)
    assert set(second.evasions) <= again and second.n_evaded + second.n_screened_out == 4


def test_retrain_cycle_refits_and_gates(spark):
    rows = [(i, f"{'attack steal' if i % 2 else 'nice day'} word{i}", i % 2, "c", "necent" if i % 3 else "mystery", ("train", "train", "train", "val", "test")[i % 5]) for i in range(100)]
    split = spark.createDataFrame(rows, "ord long, text string, label int, category string, source string, split string")
    new = spark.createDataFrame([(1000 + i, f"steal softly {i}") for i in range(10)] + [(2000, "steal softly 1")], "ord long, text string")
    reg = spark.createDataFrame([("detector", "v1", {"f1": 0.9}, "promoted")], "model string, version string, metrics map<string,double>, status string")
    kept = []

    def write(df):
        kept.extend(df.collect())
        return df

    r = one(registry.retrain_cycle(split, new, reg, write=write))
    assert (r.version, r.status, r.n_evasions) == ("v2", "promoted", 11) and r.new_metric >= 0.9
    assert {x.raw_source for x in kept if x.split_role == "test"} == {"hf_csv2"}
    assert {(x.source, x.raw_source) for x in kept if x.split_role == "train"} == {("necent", "hf_csv3"), ("mystery", "online_retrain"), ("online_retrain", "online_retrain")}
    texts = {t for _, t, _, _, _, s in rows if s == "val"}
    assert not texts & {x.text for x in kept} and sum(x.source == "online_retrain" for x in kept) == 10
    worse = one(registry.retrain_cycle(split, new, reg, fit=lambda train, val: None, evaluate=lambda m, test: test.limit(1).select(F.lit(0.5).alias("f1"))))
    assert (worse.status, worse.current_version) == ("rejected", "v1")


def test_stopping(spark):
    def stop(rates, mode="plateau", elapsed=0.0, **kw):
        rows = [("r", i, x, elapsed) for i, x in enumerate(rates)]
        return one(redteam.stops(spark.createDataFrame(rows, "run_id string, round_index int, evasion_rate double, elapsed double"), mode, **kw)).stop_after

    assert stop([0.05, 0.20], k=2) is None
    assert stop([0.20, 0.05, 0.02], k=2) == 2
    assert stop([0.01, 0.01], k=3) is None
    assert stop([0.5], "budget", 61.0, budget_seconds=60) == 0
    assert stop([0.5] * 5, "plateau", cap=5) == 4
    with pytest.raises(ValueError):
        stop([0.5], "other")


@pytest.mark.parametrize(("new", "status", "version", "now"), [(0.93, "promoted", "v2", "v2"), (0.80, "rejected", "v2", "v1"), (0.885, "promoted", "v2", "v2")])
def test_gate(spark, new, status, version, now):
    reg = spark.createDataFrame([("m", "v1", {"f1": 0.90}, "promoted")], "model string, version string, metrics map<string,double>, status string")
    cand = spark.createDataFrame([("m", {"f1": new})], "model string, metrics map<string,double>")
    r = one(registry.gate(cand, reg))
    assert (r.status, r.version, r.current_version) == (status, version, now)


def test_audit_chain_and_tampering(spark):
    rows = [("a", i, f"p{i}") for i in range(4)] + [("b", 0, "x")]
    chained = audit.append(spark.createDataFrame(rows, "log_id string, seq long, payload string"))
    h = "0" * 64
    for i in range(4):
        h = hashlib.sha256(f"{h}p{i}".encode()).hexdigest()
    heads = {r.log_id: r.head for r in audit.chain_heads(chained).collect()}
    assert heads["a"] == h == chained.filter("log_id = 'a' and seq = 3").first().hash
    assert audit.verify(chained).filter("not intact").count() == 0
    bad = audit.verify(chained.withColumn("payload", F.when(F.expr("log_id = 'a' and seq = 1"), "changed").otherwise(F.col("payload"))))
    assert {r.log_id: (r.intact, r.first_bad) for r in bad.collect()} == {"a": (False, 1), "b": (True, None)}
    cut = audit.verify(chained.filter("not (log_id = 'a' and seq = 3)"), spark.createDataFrame([("a", 4), ("b", 1), ("c", 2)], "log_id string, expected long"))
    assert {r.log_id for r in cut.filter("not intact").collect()} == {"a", "c"}


@pytest.mark.parametrize(("raw", "label"), [("1", 1), ("0", 0), ("jailbreak", 1), (" Injection ", 1), ("benign", 0), ("Safe", 0), ("unrecognized", None), ("1.0", None), (None, None)])
def test_labels(spark, raw, label):
    assert one(spark.createDataFrame([(raw,)], "x string").select(D.label_value(F.col("x")).alias("y"))).y == label


def test_numeric_labels(spark):
    df = spark.createDataFrame([(1.9,), (float("nan"),), (2.0,)], "x double")
    assert [r.y for r in df.select(D.label_value(F.col("x"), "double").alias("y")).collect()] == [1, None, 2]


def test_normalize_and_pairs(spark):
    df = spark.createDataFrame([("t", "attack", "x"), (None, "benign", "y"), ("u", "?", "z")], "prompt string, is_injection string, attack_type string")
    assert [tuple(r) for r in corpus.normalize(df, "s").collect()] == [("t", 1, "x", "s")]
    with pytest.raises(ValueError):
        corpus.normalize(df.drop("is_injection"), "s")
    pairs = spark.createDataFrame([("Diacritics", "a", "b"), ("D", None, "c")], "attack_name string, original_sample string, modified_sample string")
    assert sorted(r.category for r in corpus.unpivot_pairs(pairs).collect()) == ["D::evaded", "Diacritics::evaded", "Diacritics::original"]
    assert corpus.pick_column(["prompt", "is_dangerous", "prompt_adversarial"], ("prompt_adversarial", "is_dangerous")) == "prompt_adversarial"


def test_dedup_and_split(spark):
    rows = [(i, t, y, "c", "s", role) for i, (t, y, role) in enumerate([("a", 1, "train"), ("b", 0, "train"), ("a", 1, "train"), ("a", 0, "test")])]
    df = spark.createDataFrame(rows, "ord long, text string, label int, category string, source string, split_role string")
    assert sorted(r.ord for r in corpus.dedup(df).collect()) == [0, 1, 3]
    many = spark.range(103).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("text"), (F.col("id") < 21).cast("int").alias("label"), F.lit("c").alias("category"), F.lit("s").alias("source"), F.lit("train").alias("split_role"))
    counts = {(r.split, r.label): r["count"] for r in corpus.split(many).groupBy("split", "label").count().collect()}
    assert counts == {("val", 0): 8, ("val", 1): 2, ("train", 0): 74, ("train", 1): 19}
    assert corpus.split(many.filter("ord < 0")).count() == 0


@pytest.mark.parametrize(
    ("prompt", "role", "matched"),
    [
        ("Please check my inbox for new mail", "email_agent", True),
        ("Delete this file from the workspace", "file_agent", True),
        ("Search the web for climate data", "research_agent", True),
        ("Schedule a meeting for tomorrow", "calendar_agent", True),
        ("Run this python script for me", "code_exec_agent", True),
        ("REFUND MY ORDER NOW", "support_agent", True),
        ("What is the weather like", "email_agent", False),
        ("blackmail a description of denote", "email_agent", False),
        ("my mailbox", "email_agent", True),
        ("infiltrating", "code_exec_agent", True),
    ],
)
def test_roles(spark, prompt, role, matched):
    r = one(text.with_role(spark.createDataFrame([(prompt,)], "text string")))
    assert (r.role, r.matched) == (role, matched)


def test_detector_metrics(spark):
    df = spark.createDataFrame([(0, 0.01), (0, 0.02), (1, 0.98), (1, 0.99)], "label int, score double")
    r = one(text.binary_metrics(df))
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 1)
    assert one(text.roc_auc(df)).auc == 1
    tied = spark.createDataFrame([(1, 0.8), (0, 0.5), (1, 0.5), (0, 0.1)], "label int, score double")
    assert one(text.roc_auc(tied)).auc == 0.875
    assert one(text.roc_auc(df.filter("label = 1"))).auc is None


def test_restore_takes_the_last_row_before_a_start_without_pairs(spark):
    history = spark.createDataFrame([(1, 1, 0.1), (1, 3, 0.3), (1, 5, None), (2, 1, 0.9), (None, 1, 0.7)], "key long, seq long, threshold double")
    starts = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (1, 4), (1, 9), (3, 5), (None, 5)], "key long, start_seq long")
    out = memory.restore(history, starts)
    got = {(r.key, r.start_seq): r.threshold for r in out.collect()}
    assert got == {(1, 1): 0.5, (1, 3): 0.1, (1, 4): 0.3, (1, 9): 0.5, (3, 5): 0.5, (None, 5): 0.5} and out.count() == 6
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_doubles_are_rounded_as_in_sql(spark):
    """Scaling makes halves of doubles whose shortest form has none, and the other way round; zeros keep their sign."""
    import duckdb

    from sentryframe.functions.decisions import rounded

    values = [1566333755.4444445, -0.0000004, 0.0, -0.0, float("inf"), None, 1e305] + [v * scale for scale in (1e-7, 1e4, 1e9) for v in [(i * 37.7 - 900) / 7 for i in range(3_000)]]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 6).alias("v")).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    assert list(map(str, got)) == list(map(str, want))


def test_screen_by_rounded_similarity(spark):
    """A similarity of 0.499997 is 0.5 to five digits."""
    from sentryframe.operators import memory

    s = 0.499997
    known = spark.createDataFrame([(1, "a", [1.0, 0.0])], "idx long, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, [s, (1 - s * s) ** 0.5]), (2, [0.49999, (1 - 0.49999**2) ** 0.5])], "id long, embedding array<double>")
    assert {r.id: r.known for r in memory.screen(asked, known, 0.5, digits=5).collect()} == {1: True, 2: False}
    assert not any(r.known for r in memory.screen(asked, known, 0.5).collect())
