"""Column-to-column logic shared by batch and streaming operators."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_ROLE, MEMORY_WRITE_TOOLS, NEGATIVE_LABELS, POSITIVE_LABELS, ROLE_KEYWORDS, FusionConfig, MemoryThresholds, RiskWeights

GENESIS = "0" * 64


def label_value(c: Column, kind: str = "string") -> Column:
    """1 or 0 for the known label words; numbers and booleans as truncated integers; null for anything else."""
    if kind != "string":
        return c.try_cast("int")
    word = F.lower(F.trim(c))
    return F.when(word.isin(*POSITIVE_LABELS), 1).when(word.isin(*NEGATIVE_LABELS), 0)


def glob_regex(pattern: Column) -> Column:
    """A regular expression for a shell pattern: * (also **) any run, ? one character, the rest literally."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def resource_matches(resource: Column, regexes: Column) -> Column:
    """No resource passes; else some pattern must match."""
    return resource.isNull() | F.coalesce(F.exists(regexes, lambda p: F.rlike(resource, p)), F.lit(False))


def condition_holds(params: Column, c: Column) -> Column:
    """One attribute condition. An absent field, a value of another type and NaN are false."""
    text = params[c["field"]]
    num = text.try_cast("double")
    bound = c["value_num"]
    numeric = bound.isNotNull() & num.isNotNull() & ~F.isnan(num)
    same = F.when(bound.isNotNull(), numeric & (num == bound)).otherwise(text == c["value_str"])
    listed = F.array_contains(c["value_list"], text)
    held = (
        F.when(c["op"] == "eq", same)
        .when(c["op"] == "ne", ~F.coalesce(same, F.lit(False)))
        .when(c["op"] == "in", listed)
        .when(c["op"] == "not_in", ~listed)
        .when(c["op"] == "lt", numeric & (num < bound))
        .when(c["op"] == "lte", numeric & (num <= bound))
        .when(c["op"] == "gt", numeric & (num > bound))
        .when(c["op"] == "gte", numeric & (num >= bound))
    )
    return F.coalesce(F.map_contains_key(params, c["field"]) & text.isNotNull() & held, F.lit(False))


def conditions_hold(params: Column, conditions: Column) -> Column:
    """All conditions; a tool without conditions passes."""
    given = F.coalesce(params, F.expr("map()").cast("map<string,string>"))
    return F.coalesce(F.forall(conditions, lambda c: condition_holds(given, c)), F.lit(True))


def role_of(text: Column) -> tuple[Column, Column]:
    """Role of a prompt by the first role with a keyword that begins a word, and whether any matched."""
    low, role = F.lower(text), None
    for name, words in ROLE_KEYWORDS.items():
        hit = low.rlike(role_pattern(words))
        role = F.when(hit, name) if role is None else role.when(hit, name)
    return F.coalesce(role, F.lit(DEFAULT_ROLE)), role.isNotNull()


def role_pattern(words: tuple[str, ...]) -> str:
    """A keyword with no letter, digit or underscore before it; anything may follow."""
    return r"(^|[^\p{L}\p{N}_])(?:" + "|".join(map(re.escape, words)) + ")"


def blend(signals: Mapping[str, Column], weights: RiskWeights = RiskWeights()) -> Column:
    """Weighted risk in [0, 1]. signals: injection, behavior, trust, session (numbers), privilege, twin (booleans)."""
    w = weights.normalized()
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    terms = {"injection": signals["injection"], "behavior": signals["behavior"], "trust": 1.0 - signals["trust"], "privilege": flag(signals["privilege"]), "session": signals["session"], "twin": flag(signals["twin"])}
    total = None
    for k, c in terms.items():
        total = c * w[k] if total is None else total + c * w[k]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def decide(risk: Column, out_of_scope: Column, combo: Column | None = None, unsafe: Column | None = None, config: FusionConfig = FusionConfig(), block: Column | None = None, block_combo: Column | None = None) -> Column:
    """block, flag or allow; the first rule that applies. block and block_combo may be columns, for sweeps."""
    combo = risk if combo is None else combo
    block = F.lit(config.block) if block is None else block
    block_combo = F.lit(config.block_combo) if block_combo is None else block_combo
    rule = F.when(F.lit(config.strict_privilege) & out_of_scope, "block")
    if unsafe is not None:
        rule = rule.when(F.lit(config.strict_twin) & unsafe, "block")
    return (
        rule.when(risk > block, "block")
        .when(out_of_scope & (combo > block_combo), "block")
        .when(risk > config.flag, "flag")
        .when(out_of_scope & F.lit(config.flag_on_out_of_scope), "flag")
        .otherwise("allow")
    )


def decision_reason(risk: Column, out_of_scope: Column, combo: Column, config: FusionConfig = FusionConfig()) -> Column:
    return (
        F.when(F.lit(config.strict_privilege) & out_of_scope, "strict: out of scope")
        .when(risk > config.block, F.format_string("risk %.3f over %.2f", risk, F.lit(config.block)))
        .when(out_of_scope & (combo > config.block_combo), F.format_string("risk %.3f over %.2f and out of scope", combo, F.lit(config.block_combo)))
        .when(risk > config.flag, F.format_string("risk %.3f over %.2f", risk, F.lit(config.flag)))
        .when(out_of_scope & F.lit(config.flag_on_out_of_scope), "out of scope at low risk")
        .otherwise("low risk, in scope")
    )


def memory_outcome(tool: Column, risk: Column, trust: Column, t: MemoryThresholds = MemoryThresholds()) -> Column:
    """rejected, quarantined or committed for writes to memory; null for other tools."""
    gate = (
        F.when((risk >= t.reject_risk) | (trust <= t.reject_trust), "rejected")
        .when((risk >= t.quarantine_risk) | (trust <= t.quarantine_trust), "quarantined")
        .otherwise("committed")
    )
    return F.when(tool.isin(*MEMORY_WRITE_TOOLS), gate)


def normalized(v: Column) -> Column:
    """A vector over its length; a zero vector over 1e-9."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / norm)


def rounded(c: Column, digits: int) -> Column:
    """A double to so many places as SQL engines have it: the scaled double to the nearest whole number, halves away from zero, and back.

    F.round goes by the shortest decimal form instead, which differs where scaling makes a half or unmakes one."""
    scale = F.lit(10.0**digits)
    whole = F.round(c * scale, 0)
    return F.when(whole == 0, c * 0.0).when(F.abs(whole) < float("inf"), whole / scale).otherwise(c)  # zeros keep their sign


def pseudo_score(text: Column) -> Column:
    """A reproducible stand-in for a detector's score, from the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def pick(options: list[str] | tuple[str, ...], *keys: Column) -> Column:
    """One of the options by a hash of the keys."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, options)), (h % len(options) + 1).cast("int"))
