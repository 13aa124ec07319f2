"""Access control on hand-made rows with known outcomes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentryframe.config import COMPANY_ADDRESS
from sentryframe.operators import policy
from sentryframe.schemas import POLICY
from sentryframe.sources import tables

T0 = dt.datetime(2026, 1, 1)
CALL = "id int, ts timestamp, token_id string, role string, tool_name string, resource string, params map<string,string>"

CASES = [
    ("email_agent", "send_email", COMPANY_ADDRESS, {"recipient_count": "1"}, "none"),
    ("email_agent", "send_email", "attacker@evil.com", {"recipient_count": "1"}, "resource_denied"),
    ("email_agent", "send_email", COMPANY_ADDRESS, {"recipient_count": "200"}, "condition_denied"),
    ("email_agent", "send_email", COMPANY_ADDRESS, {}, "condition_denied"),
    ("email_agent", "send_email", COMPANY_ADDRESS, {"recipient_count": "NaN"}, "condition_denied"),
    ("email_agent", "send_email", COMPANY_ADDRESS, {"recipient_count": "many"}, "condition_denied"),
    ("email_agent", "delete_file", "/workspace/report.docx", {}, "tool_not_permitted"),
    ("file_agent", "write_file", "/workspace/notes/draft.md", {}, "none"),
    ("file_agent", "write_file", "/etc/passwd", {}, "resource_denied"),
    ("file_agent", "write_file", "/workspace/../etc/passwd", {}, "none"),
    ("file_agent", "write_file", "/workspace/a\n", {}, "none"),
    ("research_agent", "fetch_url", "https://example.com/article", {}, "none"),
    ("research_agent", "fetch_url", "file:///etc/passwd", {}, "resource_denied"),
    ("calendar_agent", "create_event", None, {"attendee_count": "3"}, "none"),
    ("calendar_agent", "create_event", None, {"attendee_count": "500"}, "condition_denied"),
    ("calendar_agent", "cancel_event", "self-created:evt_123", {}, "none"),
    ("calendar_agent", "cancel_event", "someone-elses:evt_999", {}, "resource_denied"),
    ("code_exec_agent", "run_code", "/sandbox/script.py", {"timeout_seconds": "5"}, "none"),
    ("code_exec_agent", "run_code", "/sandbox/script.py", {"timeout_seconds": "999999"}, "condition_denied"),
    ("code_exec_agent", "fetch_url", "https://attacker.com/exfil", {}, "tool_not_permitted"),
    ("support_agent", "issue_refund", "order_42", {"amount_usd": "25"}, "none"),
    ("support_agent", "issue_refund", "order_42", {"amount_usd": "5000"}, "condition_denied"),
    ("nobody", "send_email", COMPANY_ADDRESS, {"recipient_count": "1"}, "unknown_role"),
    ("email_agent", "read_inbox", None, None, "none"),
]


def test_authorize(spark):
    calls = spark.createDataFrame([(i, T0, "t", r, t, res, p) for i, (r, t, res, p, _) in enumerate(CASES)], CALL)
    got = {r.id: r.violation for r in policy.authorize(calls, tables.default_policies(spark)).collect()}
    assert got == {i: c[-1] for i, c in enumerate(CASES)}


@pytest.mark.parametrize(
    ("op", "num", "text", "values", "given", "holds"),
    [
        ("eq", 5.0, None, None, "5", True),
        ("eq", None, "a", None, "a", True),
        ("ne", 5.0, None, None, "6", True),
        ("ne", None, "a", None, "a", False),
        ("in", None, None, ["a", "b"], "b", True),
        ("in", None, None, ["a", "b"], "c", False),
        ("not_in", None, None, ["a"], "c", True),
        ("lt", 5.0, None, None, "5", False),
        ("lte", 5.0, None, None, "5", True),
        ("gt", 5.0, None, None, "5", False),
        ("gte", 5.0, None, None, "5", True),
        ("gte", 5.0, None, None, "NaN", False),
    ],
)
def test_conditions(spark, op, num, text, values, given, holds):
    p = spark.createDataFrame([("r", "d", [("t", ["*"], [("f", op, num, text, values)])])], POLICY)
    calls = spark.createDataFrame([(1, T0, "t", "r", "t", "x", {"f": given}), (2, T0, "t", "r", "t", "x", {})], CALL)
    got = {r.id: r.allowed for r in policy.authorize(calls, p).collect()}
    assert got == {1: holds, 2: False}


def test_expiry_and_revocation(spark):
    creds = policy.issue(spark.createDataFrame([("t", "email_agent", T0, 60)], "token_id string, role string, issued_at timestamp, ttl_seconds int"))
    at = [T0 + dt.timedelta(seconds=s) for s in (59, 60, 61)]
    calls = spark.createDataFrame([(i, t, "t", "email_agent", "read_inbox", None, {}) for i, t in enumerate(at)], CALL)
    revoked = spark.createDataFrame([("t", T0 + dt.timedelta(seconds=59))], "token_id string, revoked_at timestamp")
    policies = tables.default_policies(spark)
    assert [r.violation for r in policy.authorize(calls, policies, creds).orderBy("id").collect()] == ["none", "credential_expired", "credential_expired"]
    assert policy.authorize(calls, policies, creds, revoked).orderBy("id").first().violation == "credential_revoked"


def test_cascade_skips_revoked_and_late_children(spark):
    days = lambda n: T0 + dt.timedelta(days=n)
    creds = spark.createDataFrame([("a", None, days(0)), ("b", "a", days(1)), ("c", "b", days(1)), ("d", "a", days(1)), ("e", "d", days(9)), ("f", "d", days(1))], "token_id string, derived_from string, issued_at timestamp")
    starts = spark.createDataFrame([("a", days(5))], "token_id string, revoked_at timestamp")
    already = spark.createDataFrame([("b", days(2))], "token_id string, revoked_at timestamp")
    ids = lambda df: {r.token_id for r in df.collect()}
    assert ids(policy.revoke_cascade(creds, starts, already)) == {"a", "d", "f"}
    assert ids(policy.revoke_cascade(creds, starts, already, strict=True)) == {"a", "b", "c", "d", "f"}


def test_govern(spark):
    creds = policy.issue(spark.createDataFrame([("p", None, T0, 10**6), ("k", "p", T0, 10**6)], "token_id string, derived_from string, issued_at timestamp, ttl_seconds int"))
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [
        (1, s(1), "k", "email_agent", "send_email", COMPANY_ADDRESS, {"recipient_count": "1"}, 0.1, "none"),
        (2, s(2), "k", "email_agent", "send_email", COMPANY_ADDRESS, {"recipient_count": "1"}, 0.6, "tightened"),
        (3, s(3), "k", "email_agent", "read_inbox", None, {}, 0.6, "none"),
        (4, s(4), "k", "email_agent", "delete_file", None, {}, 0.0, "tool_not_permitted"),
        (5, s(5), "p", "email_agent", "read_inbox", None, {}, 0.9, "credential_revoked"),
        (6, s(6), "k", "email_agent", "read_inbox", None, {}, 0.0, "credential_revoked"),
    ]
    calls = spark.createDataFrame([r[:-1] for r in rows], CALL + ", risk double")
    got = {r.id: r.governed for r in policy.govern(calls, tables.default_policies(spark), creds).collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_round_robin_reaches_all_scenarios_when_mixed(spark):
    rows = spark.range(600).select(F.col("id").alias("idx"), F.lit(True).alias("is_attack"))
    n = lambda mixed: policy.round_robin(rows, mixed).select("role", "slot").distinct().count()
    assert (n(False), n(True)) == (10, 22)


def test_numbered_follows_the_order(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 3)], "x int")
    assert [(r.x, r.idx) for r in policy.numbered(df, "x").orderBy("x").collect()] == [(1, 0), (3, 1), (5, 2), (9, 3)]


def test_cascade_of_any_depth_and_a_cycle(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f"t{i}", f"t{i - 1}" if i else "t69", t0) for i in range(70)]
    creds = spark.createDataFrame(rows, "token_id string, derived_from string, issued_at timestamp").coalesce(1)
    got = policy.revoke_cascade(creds, spark.createDataFrame([("t0", t0)], "token_id string, revoked_at timestamp").coalesce(1)).collect()
    assert {r.token_id for r in got} == {f"t{i}" for i in range(70)} and len(got) == 70


def test_policies_of_known_size_are_broadcast(spark, sf_dir):
    """The library's policies are joined by broadcast because Spark knows their size; the calls are not shuffled for them."""
    from sentryframe.sources import views

    calls = views.tool_calls(spark, sf_dir)
    plan = lambda p: policy.authorize(calls, p)._jdf.queryExecution().executedPlan().toString()
    assert plan(tables.default_policies(spark)).count("BroadcastHashJoin") == 2
    unknown = spark.createDataFrame(tables.default_policies(spark).rdd, tables.default_policies(spark).schema)
    assert "BroadcastHashJoin" not in plan(unknown)
