"""Checks across the calls of one session, as windows. session_id is required: state never crosses sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import local_table
from ..config import BASELINE_TOOLS, SANDBOX_TOOLS, SandboxCaps
from .policy import unused

DOMAIN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def deviation(sequences: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds novel_tools, deviation (share of calls off the role's baseline, repeats counted) and anomalous. Column tools is an array."""
    baseline = F.create_map(*[x for r, tools in BASELINE_TOOLS.items() for x in (F.lit(r), F.array(*map(F.lit, tools)))])
    usual = F.coalesce(baseline[F.col("role")], F.expr("array()").cast("array<string>"))
    novel = F.filter("tools", lambda t: ~F.array_contains(usual, t))
    score = F.when(F.size("tools") > 0, F.size(novel) / F.size("tools")).otherwise(0.0)
    return sequences.withColumn("novel_tools", novel).withColumn("deviation", score).withColumn("anomalous", score > threshold)


def session_deviation(calls: DataFrame) -> DataFrame:
    """Deviation per session and role, from the calls themselves: a join with the baseline and one partial aggregate."""
    rows = [(r, t) for r, tools in BASELINE_TOOLS.items() for t in tools]
    baseline = local_table(calls.sparkSession, rows, "role string, tool_name string").withColumn("usual", F.lit(True))
    marked = calls.join(F.broadcast(baseline), ["role", "tool_name"], "left")
    return marked.groupBy("session_id", "role").agg(F.avg(F.when(F.col("usual").isNull(), 1.0).otherwise(0.0)).alias("deviation"), F.count(F.lit(1)).alias("n_calls"))


def param(name: str) -> Column:
    return F.coalesce(F.col("params")[name].try_cast("double"), F.lit(0.0))


def _in_order(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "call_id")


def recipient_known(calls: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds recipient_known for mail calls (null for others). Without contacts every recipient is unknown."""
    known = contacts.select(F.col("address").alias("resource")).distinct().withColumn("known", F.lit(True))
    mail = F.col("tool_name").isin("send_email", "forward_email")
    return calls.join(known, "resource", "left").withColumn("recipient_known", F.when(mail, F.col("known").isNotNull())).drop("known")


def object_state(calls: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Adds existed (was the object there before this call) and content (what a read returns).

    Writes create, deletes and cancels remove. initial: session_id, resource, content of objects that exist at the start."""
    ops = F.when(F.col("tool_name").isin("write_file", "save_note"), "put").when(F.col("tool_name").isin("delete_file", "cancel_event"), "drop")
    rows = calls.withColumn("op", ops).withColumn("content_in", F.coalesce(F.col("params")["content"], F.lit("")))
    if initial is None:
        rows = rows.withColumn("initial_content", F.lit(None).cast("string"))
    else:
        rows = rows.join(initial.select("session_id", "resource", F.col("content").alias("initial_content")), ["session_id", "resource"], "left")
    w = _in_order("session_id", "resource").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isNotNull(), F.struct("op", "content_in")), ignorenulls=True).over(w)
    rows = rows.withColumn("last", last)
    existed = F.when(F.col("last").isNotNull(), F.col("last.op") == "put").otherwise(F.col("initial_content").isNotNull())
    content = F.when(F.col("last").isNotNull(), F.when(F.col("last.op") == "put", F.col("last.content_in"))).otherwise(F.col("initial_content"))
    return rows.withColumn("existed", existed & F.col("resource").isNotNull()).withColumn("content", content).drop("op", "content_in", "initial_content", "last")


def event_numbers(calls: DataFrame) -> DataFrame:
    """Adds event_no (evt_n in its session) to create_event calls, and the attendee count."""
    made = calls.filter("tool_name = 'create_event'")
    return made.withColumn("event_no", F.concat(F.lit("evt_"), F.row_number().over(_in_order("session_id")).cast("string"))).withColumn("attendees", param("attendee_count"))


def running(calls: DataFrame, tool: str, amount: str, keys: tuple[str, ...], out: str) -> DataFrame:
    """The calls of one tool with the running sum of an amount per keys."""
    w = _in_order(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.filter(F.col("tool_name") == tool).withColumn(out, F.sum(param(amount)).over(w))


def running_domains(calls: DataFrame, key: str = "session_id") -> DataFrame:
    """fetch_url calls with their domain and the number of distinct domains so far: a first-seen flag, then a running sum."""
    rows = calls.filter("tool_name = 'fetch_url'").withColumn("domain", F.regexp_extract(F.coalesce("resource", F.lit("")), DOMAIN, 1))
    first = (F.row_number().over(_in_order(key, "domain")) == 1).cast("int")
    w = _in_order(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("first", first).withColumn("n_domains", F.sum("first").over(w)).drop("first")


def flag_rate(flags: DataFrame, seconds: int = 86_400, key: str = "session_id") -> DataFrame:
    """Adds session_history_risk: the share of flagged calls of the key in the window before each call (0 if none)."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return flags.withColumn("session_history_risk", F.coalesce(F.avg(F.col("flagged").cast("double")).over(w), F.lit(0.0)))


def sandbox(calls: DataFrame, caps: SandboxCaps = SandboxCaps(), initial: DataFrame | None = None, contacts: DataFrame | None = None) -> DataFrame:
    """Adds safe and notes. Calls are dealt by session once; the windows per session, per order, per object and per domain are
    all finer than that, so they need sorts but no further shuffle."""
    spark = calls.sparkSession
    mine = ("op", "content_in", "initial_content", "last", "domain", "new_domain", "refunded", "computed", "n_domains", "recipient_known", "existed", "content", "known")
    theirs = {c: free for c, free in zip(calls.columns, unused(calls, *calls.columns)) if c.lower() in mine}  # set aside under other names
    calls = calls.withColumnsRenamed(theirs).repartition("session_id")
    if contacts is None:
        contacts = local_table(spark, [(c,) for c in caps.contacts], "address string")
    rows = object_state(recipient_known(calls, contacts), initial)
    tool = F.col("tool_name")
    upto = lambda *k: _in_order(*k).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = lambda t, p: F.when(tool == t, param(p)).otherwise(0.0)
    domain = F.when(tool == "fetch_url", F.regexp_extract(F.coalesce("resource", F.lit("")), DOMAIN, 1))
    rows = rows.withColumn("domain", domain)
    rows = rows.withColumn("new_domain", F.when(F.col("domain").isNotNull(), (F.row_number().over(_in_order("session_id", "domain")) == 1).cast("int")).otherwise(0))
    rows = rows.withColumn("refunded", F.sum(amount("issue_refund", "amount_usd")).over(upto("session_id", "resource")))
    rows = rows.withColumn("computed", F.sum(amount("run_code", "timeout_seconds")).over(upto("session_id"))).withColumn("n_domains", F.sum("new_domain").over(upto("session_id")))
    trusted = F.col("domain").isin(*caps.trusted_domains) if caps.trusted_domains else F.lit(True)
    notes = {
        "unknown recipient": F.col("recipient_known") == F.lit(False),
        "overwrites a file": (tool == "write_file") & F.col("existed"),
        "deletes a file": (tool == "delete_file") & F.col("existed"),
        "too many attendees": (tool == "create_event") & (param("attendee_count") > caps.attendees),
        "compute time over cap": (tool == "run_code") & (F.col("computed") > caps.compute_seconds),
        "refunds over cap": (tool == "issue_refund") & (F.col("refunded") > caps.refund_usd),
        "domain not trusted": (tool == "fetch_url") & ~trusted,
        "too many domains": (tool == "fetch_url") & (F.col("n_domains") > caps.domains),
        "no rule for this tool": ~tool.isin(*SANDBOX_TOOLS),
    }
    harmless = ("overwrites a file", "no rule for this tool")
    unsafe = None
    for name, c in notes.items():
        if name not in harmless:
            unsafe = F.coalesce(c, F.lit(False)) if unsafe is None else unsafe | F.coalesce(c, F.lit(False))
    all_notes = F.array_compact(F.array(*[F.when(c, name) for name, c in notes.items()]))
    return rows.withColumn("safe", ~unsafe).withColumn("notes", all_notes).drop("domain", "new_domain", "refunded", "computed", "n_domains", "recipient_known", "existed", "content").withColumnsRenamed({free: c for c, free in theirs.items()})
