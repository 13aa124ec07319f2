"""Access control over tool calls: policies, credentials, revocation, authorization and risk-reactive governance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut, local_table
from ..config import ATTACK_CALLS, BENIGN_CALLS, ROLES, TIGHTENED_TOOLS
from ..functions.decisions import conditions_hold, glob_regex, resource_matches


def permissions(policies: DataFrame) -> DataFrame:
    """One row per role and tool: the first entry with that name, its patterns as regular expressions and its conditions."""
    flat = policies.select("role", F.posexplode("tools").alias("pos", "tool"))
    first = flat.groupBy("role", F.col("tool.name").alias("tool_name")).agg(F.min_by("tool", "pos").alias("tool"))
    return first.select("role", "tool_name", F.transform("tool.resource_patterns", glob_regex).alias("patterns"), F.coalesce("tool.conditions", F.array()).alias("conditions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def issue(df: DataFrame) -> DataFrame:
    """Adds expires_at = issued_at + ttl_seconds."""
    return df.withColumn("expires_at", F.col("issued_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_seconds").cast("decimal(18,6)")))


def expired_at(ts, expires_at):
    return ts >= expires_at


def authorize(calls: DataFrame, policies: DataFrame, credentials: DataFrame | None = None, revocations: DataFrame | None = None, revoked_at: str | None = None) -> DataFrame:
    """Adds violation, allowed and reason. The first rule that fails names the violation: credential expired, revoked, role
    unknown, tool not permitted, resource, condition.

    credentials (token_id, expires_at) and revocations (token_id, revoked_at) need a column token_id in calls; or revoked_at
    names a column of calls that has the time already. A call is revoked if its token was revoked at or before the call's ts.
    Other columns of calls stay, whatever their names. Spark broadcasts policies of known small size and shuffles others."""
    out = calls
    expires, revoked, role_known, tool_known, patterns, conditions = own = unused(calls, "expires_at", "revoked_at", "role_known", "tool_known", "patterns", "conditions")
    if credentials is not None:
        out = out.join(credentials.select("token_id", F.col("expires_at").alias(expires)), "token_id", "left")
    else:
        out = out.withColumn(expires, F.lit(None).cast("timestamp"))
    if revocations is not None:
        firsts = revocations.groupBy("token_id").agg(F.min("revoked_at").alias(revoked))
        out = out.join(firsts, "token_id", "left")
    else:
        out = out.withColumn(revoked, F.col(revoked_at) if revoked_at else F.lit(None).cast("timestamp"))
    known = policies.select("role").distinct().withColumn(role_known, F.lit(True))
    allowed_tools = permissions(policies).select("role", "tool_name", F.col("patterns").alias(patterns), F.col("conditions").alias(conditions), F.lit(True).alias(tool_known))
    out = out.join(known, "role", "left").join(allowed_tools, ["role", "tool_name"], "left")
    violation = (
        F.when(F.coalesce(expired_at(F.col("ts"), F.col(expires)), F.lit(False)), "credential_expired")
        .when(F.coalesce(F.col(revoked) <= F.col("ts"), F.lit(False)), "credential_revoked")
        .when(F.col(role_known).isNull(), "unknown_role")
        .when(F.col(tool_known).isNull(), "tool_not_permitted")
        .when(~resource_matches(F.col("resource"), F.col(patterns)), "resource_denied")
        .when(~conditions_hold(F.col("params"), F.col(conditions)), "condition_denied")
        .otherwise("none")
    )
    out = out.withColumn("violation", violation).withColumn("allowed", F.col("violation") == "none")
    reason = F.when(F.col("allowed"), "within policy").otherwise(F.format_string("%s: %s calling %s", "violation", "role", "tool_name"))
    return out.withColumn("reason", reason).drop(*own)


def authorize_steps(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds role_known, tool_known, resource_ok, conditions_ok: the checks one by one."""
    known = policies.select("role").distinct().withColumn("rk", F.lit(True))
    out = calls.join(known, "role", "left").join(permissions(policies).withColumn("tk", F.lit(True)), ["role", "tool_name"], "left")
    has = F.col("tk").isNotNull()
    return (
        out.withColumn("role_known", F.col("rk").isNotNull())
        .withColumn("tool_known", has)
        .withColumn("resource_ok", has & resource_matches(F.col("resource"), F.col("patterns")))
        .withColumn("conditions_ok", has & conditions_hold(F.col("params"), F.col("conditions")))
        .drop("rk", "tk", "patterns", "conditions")
    )


def resource_index(policies: DataFrame) -> DataFrame:
    """role, tool_name, prefix, regex: every pattern of the first entry of each tool, by what stands before its first wildcard."""
    flat = policies.select("role", F.posexplode("tools").alias("pos", "tool"))
    first = flat.groupBy("role", F.col("tool.name").alias("tool_name")).agg(F.min_by("tool", "pos").alias("tool"))
    patterns = first.select("role", "tool_name", F.explode("tool.resource_patterns").alias("pattern")).distinct()
    return patterns.select("role", "tool_name", F.regexp_extract("pattern", r"^[^*?]*", 0).alias("prefix"), glob_regex(F.col("pattern")).alias("regex"))


def match_resources(calls: DataFrame, index: DataFrame) -> DataFrame:
    """role, tool_name, resource: the distinct ones of calls that some pattern of their tool matches.

    A resource meets patterns by equal joins on the prefixes that have the lengths its tool's patterns begin with; only
    these candidates are matched. So a tool may have any number of patterns, of which those that begin with a wildcard meet
    every resource."""
    lengths = index.groupBy("role", "tool_name").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = calls.filter("resource is not null").select("role", "tool_name", "resource").distinct().join(lengths, ["role", "tool_name"])
    fits = F.filter("lengths", lambda n: n <= F.length("resource"))
    keyed = asked.select("role", "tool_name", "resource", F.explode(fits).alias("n")).withColumn("prefix", F.expr("substring(resource, 1, n)"))
    met = keyed.join(index, ["role", "tool_name", "prefix"]).filter(F.rlike("resource", F.col("regex")))
    return met.select("role", "tool_name", "resource").distinct()


def resources_ok(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds resource_ok as authorize_steps does, through the index of patterns."""
    role_tool = ["role", "tool_name"]
    has, ok = unused(calls, "has_tool", "matched")
    tools = policies.select("role", F.explode("tools.name").alias("tool_name")).distinct().withColumn(has, F.lit(True))
    matched = match_resources(calls, resource_index(policies)).withColumn(ok, F.lit(True))
    out = calls.join(tools, role_tool, "left").join(matched, [*role_tool, "resource"], "left")
    return out.withColumn("resource_ok", F.col(has).isNotNull() & (F.col("resource").isNull() | F.col(ok).isNotNull())).select(*calls.columns, "resource_ok")


def _tokens(credentials: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """token, parent, issued and was (when it was revoked before, or null) of every token with a time of issue."""
    rows = credentials.filter("issued_at is not null").select(F.col("token_id").alias("token"), F.col("derived_from").alias("parent"), F.col("issued_at").alias("issued"))
    if already is None:
        return rows.withColumn("was", F.lit(None).cast("timestamp"))
    before = already.groupBy(F.col("token_id").alias("token")).agg(F.min("revoked_at").alias("was"))
    return rows.join(before, "token", "left")


def _jumps(tokens: DataFrame) -> list[DataFrame]:
    """Per step k: token, its ancestor `up` 2^k generations above, and what the path below it asks of a time: the latest issue, the earliest `was`.

    Each step joins the last one with itself, so the number of steps is the logarithm of the depth. A path that no time can
    pass is left out. Paths of more steps than there are tokens go round a cycle, so they are never needed."""
    at = tokens.filter("parent is not null").select("token", F.col("parent").alias("up"), "issued", "was").filter("was is null or issued < was")
    steps, reach, n = [], 1, tokens.count()
    at = cut(at.distinct())
    while reach <= n and not at.isEmpty():
        steps.append(at)
        above = at.select(F.col("token").alias("up"), F.col("up").alias("top"), F.col("issued").alias("i2"), F.col("was").alias("w2"))
        nxt = at.join(above, "up").select("token", F.col("top").alias("up"), F.greatest("issued", "i2").alias("issued"), F.least("was", "w2").alias("was"))
        at, reach = cut(nxt.filter("was is null or issued < was").distinct()), 2 * reach
    return steps


def revoke_cascade(credentials: DataFrame, starts: DataFrame, already: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Tokens revoked by revoking others: token_id, revoked_at (the earliest).

    credentials: token_id, derived_from, issued_at. starts: token_id, revoked_at. A start's time reaches a token if every token
    from the start down to it was issued by then and, unless strict, not in already (token_id, revoked_at) by then.

    Paths are doubled, so a chain of any depth takes as many steps as its logarithm. First each token learns the latest issue
    below it: of the times that reach a token, only those before that issue and the first one after it can matter further
    down, so a token holds few. Then times go down: at step k a token takes those of its ancestor 2^k above that pass the path."""
    tokens = cut(_tokens(credentials, None if strict else already))
    steps = _jumps(tokens)
    newest = tokens.groupBy("token").agg(F.max("issued").alias("newest"))
    for s in steps:
        below = s.join(newest.select("token", F.col("newest").alias("n2")), "token").groupBy(F.col("up").alias("token")).agg(F.max("n2").alias("n2"))
        newest = cut(newest.join(below, "token", "left").select("token", F.greatest("newest", "n2").alias("newest")))
    passes = lambda issued, was, at: (F.col(issued) <= F.col(at)) & (F.col(was).isNull() | (F.col(was) > F.col(at)))

    def needed(times: DataFrame) -> DataFrame:
        rows = times.join(newest, "token")
        late = rows.filter("at >= newest").groupBy("token").agg(F.min("at").alias("at"))
        return rows.filter("at < newest").select("token", "at").unionByName(late).distinct()

    own = starts.select(F.col("token_id").alias("token"), F.col("revoked_at").alias("at")).join(tokens, "token")
    times = cut(needed(own.filter(passes("issued", "was", "at")).select("token", "at")))
    for s in steps:
        down = s.join(times.select(F.col("token").alias("up"), "at"), "up").filter(passes("issued", "was", "at")).select("token", "at")
        times = cut(needed(times.unionByName(down)))
    return times.groupBy(F.col("token").alias("token_id")).agg(F.min("at").alias("revoked_at"))


def lineage(credentials: DataFrame) -> DataFrame:
    """Every token with each of its ancestors and itself: ancestor, token_id, issued (the latest issue from the ancestor down to the token)."""
    tokens = cut(_tokens(credentials))
    known = tokens.select("token", F.col("token").alias("up"), "issued").distinct()
    for s in _jumps(tokens):
        far = s.select("token", F.col("up").alias("middle"), F.col("issued").alias("i1"))
        more = far.join(known.select(F.col("token").alias("middle"), "up", F.col("issued").alias("i2")), "middle")
        known = cut(known.unionByName(more.select("token", "up", F.greatest("i1", "i2").alias("issued"))).groupBy("token", "up").agg(F.min("issued").alias("issued")))
    return known.select(F.col("up").alias("ancestor"), F.col("token").alias("token_id"), "issued")


def extend_lineage(known: DataFrame, credentials: DataFrame) -> DataFrame:
    """The lineage after new tokens, which derive from known ones or from each other: only their rows are computed."""
    fresh = lineage(credentials)
    roots = credentials.join(credentials.select(F.col("token_id").alias("other")), F.col("derived_from") == F.col("other"), "left_anti").select(F.col("token_id").alias("root"), "derived_from")
    above = known.select(F.col("ancestor").alias("top"), F.col("token_id").alias("derived_from"), F.col("issued").alias("i2"))
    far = fresh.join(roots.join(above, "derived_from"), fresh["ancestor"] == F.col("root"))
    return known.unionByName(fresh).unionByName(far.select(F.col("top").alias("ancestor"), "token_id", F.greatest("issued", "i2").alias("issued")))


def govern(calls: DataFrame, policies: DataFrame, credentials: DataFrame, revoke_at: float = 0.8, tighten_at: float = 0.5, descend: bool = True) -> DataFrame:
    """Authorization that reacts to risk: the first call with risk >= revoke_at revokes its token (and what is derived from
    it) from that call on; an allowed call with risk >= tighten_at needs a tool of the role's tightened list.

    A call that triggers the revocation is denied itself."""
    triggers = calls.filter(F.col("risk") >= revoke_at).groupBy("token_id").agg(F.min("ts").alias("revoked_at"))
    revoked = revoke_cascade(credentials, triggers) if descend else triggers
    out = authorize(calls, policies, credentials, revoked)
    return tightened(out, tighten_at)


def tightened(authorized: DataFrame, tighten_at: float = 0.5) -> DataFrame:
    """Adds governed and permitted: an allowed call with risk >= tighten_at needs a tool of the role's tightened list."""
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("tool")) for r, tools in TIGHTENED_TOOLS.items() for t in tools])
    kept = F.coalesce(F.array_contains(pairs, F.struct(F.col("role").alias("role"), F.col("tool_name").alias("tool"))), F.lit(False))
    governed = F.when(F.col("allowed") & (F.col("risk") >= tighten_at) & ~kept, "tightened").otherwise(F.col("violation"))
    return authorized.withColumn("governed", governed).withColumn("permitted", F.col("governed") == "none")


def round_robin(df: DataFrame, mixed: bool = False) -> DataFrame:
    """Adds role and a scenario call. df: idx (0, 1, ...), is_attack. Role idx mod 6; scenario idx mod its list's length, or,
    with mixed, (idx div 6) mod that length, which reaches every scenario."""
    rows = [(r, kind, i, len(calls), *c) for kind, table in ((False, BENIGN_CALLS), (True, ATTACK_CALLS)) for r, calls in table.items() for i, c in enumerate(calls)]
    scenarios = local_table(df.sparkSession, rows, "role string, is_attack boolean, slot int, n int, tool_name string, resource string, params map<string,string>")
    sizes = scenarios.groupBy("role", "is_attack").agg(F.max("n").alias("n"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod("idx", F.lit(len(ROLES))) + 1).cast("int"))
    out = df.withColumn("role", role).join(F.broadcast(sizes), ["role", "is_attack"])
    turn = F.floor(F.col("idx") / len(ROLES)) if mixed else F.col("idx")
    return out.withColumn("slot", F.pmod(turn, F.col("n")).cast("int")).drop("n").join(F.broadcast(scenarios.drop("n")), ["role", "is_attack", "slot"])


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds idx = 0, 1, ... in order of key. Ranges of the key are numbered apart; the ranges' sizes, one row each, are summed."""
    ranged = df.repartitionByRange(F.col(key)).withColumn("range_no", F.spark_partition_id())
    held = cut(ranged)
    sizes = held.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("range_no").orderBy(key)) - 1
    return held.join(F.broadcast(before), "range_no").withColumn("idx", F.col("before") + at).drop("range_no", "before")
