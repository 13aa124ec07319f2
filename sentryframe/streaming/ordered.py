"""Streams whose keyed state goes by event time: trust, session rules, revocation and their live combination.

Rows may come in any order within the watermark's delay. A processor keeps a key's rows in its buffer until the watermark has
passed them and then takes them by (ts, call_id), which gives what the batch windows give; rows later than the watermark
are dropped, as no order could take them any more. A key that has been silent for `idle` seconds begins anew, and a timer
removes its state, so state does not grow with the age of a stream. What leaves a processor keeps its event time, so processors
follow each other in one query. All need the RocksDB state store and output mode append.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import BASE_TRUST, UNKNOWN_TRUST, FusionConfig, SandboxCaps
from ..operators import fusion, policy, sequence, trust

DAY = 86_400
HELD = 1_000  # rows an entry of a buffer
MAKERS = {"long": int, "double": float, "boolean": bool, "string": str}


class InOrder(StatefulProcessor):
    """Takes each key's rows by their first two columns (ts_us and a number) once the watermark has passed them.

    Subclasses have `columns` (of the buffered rows), `out` (of the results) and run(key, state, rows), which changes the
    state (a dict of plain values) and gives a result tuple for each row that has one. A result begins with ts_us.

    One buffer and its timers serve a bucket of keys (in_order deals them out by a hash), as calls into the state store cost
    more than rows; each key has a state of its own. A micro-batch adds few entries to a buffer and one timer, at the earliest
    of its rows; so does what stays behind when the timer has come. So the work is in proportion to the rows, however many times they have."""

    columns, out = "ts_us long, call_id long", "ts timestamp"
    keys: dict[str, str] = {}  # names and types of the key columns, set by in_order

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [c.split() for c in self.columns.split(", ")]
        self.names = [n for n, _ in fields]
        self.makers = [(n, MAKERS[kind]) for n, kind in (*fields, *self.keys.items())]
        self.buffer = handle.getListState("buffer", "rows string")
        self.state = handle.getMapState("state", "key string", "data string, last_us long")
        self.ends = handle.getMapState("ends", "at_ms long", "keys string")  # the keys that may have been silent for idle seconds by then

    def _hold(self, rows: list[tuple]) -> list[tuple[str]]:
        """Entries of the buffer with the rows; registers the timer at which the first of them may be due."""
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))
        return [(json.dumps(rows[i : i + HELD]),) for i in range(0, len(rows), HELD)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            columns = [[None if none else make(v) for v, none in zip(f[n].tolist(), f[n].isna().tolist())] for n, make in self.makers]
            self.buffer.appendList(self._hold(list(zip(*columns))))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for e in self.buffer.get() for r in json.loads(e[0])]
        rest, due, n = [r for r in held if r[0] > upto], {}, len(self.names)
        for r in held:
            if r[0] <= upto:
                due.setdefault(tuple(r[n:]), []).append(tuple(r[:n]))
        if due:
            self.buffer.put(self._hold(rest)) if rest else self.buffer.clear()
            last = {k: self._advance(k, rows) for k, rows in due.items()}
            yield self._frame([(k, r) for k, (made, _) in last.items() for r in made])
            self._expect({k: at for k, (_, at) in last.items()})
        if self.idle is not None:
            self._forget(expiredTimerInfo.getExpiryTimeInMs(), upto)

    def _advance(self, key: tuple, due: list[tuple]) -> tuple[list[tuple], int]:
        """The results of a key's due rows, and the time of the last; its state goes on from them."""
        due.sort(key=itemgetter(0, 1))
        data, last = self.state.getValue((json.dumps(key),)) or (None, None)
        state, made, begin = json.loads(data) if data is not None else {}, [], 0
        for i, r in enumerate(due):
            if self.idle is not None and last is not None and r[0] - last >= self.idle * 1_000_000:
                made += self.run(key, state, due[begin:i]) if i > begin else []
                state, begin = {}, i
            last = r[0]
        made += self.run(key, state, due[begin:])
        self.state.updateValue((json.dumps(key),), (json.dumps(state), last))
        return made, last

    def _expect(self, last: dict[tuple, int]) -> None:
        """Notes when these keys will have been silent for idle seconds, up to a quarter of that later, so that few timers do."""
        if self.idle is None:
            return
        step, found = max(1, self.idle * 1000 // 4), {}
        for k, t in last.items():
            found.setdefault(-(-(t // 1000 + self.idle * 1000 + 1) // step) * step, set()).add(json.dumps(k))
        for at, names in found.items():
            before = self.ends.getValue((at,))
            self.ends.updateValue((at,), (json.dumps(sorted(names.union(json.loads(before[0]) if before else ()))),))
            if before is None:
                self.handle.registerTimer(at)

    def _forget(self, at: int, upto: int) -> None:
        """Removes the states of keys noted for this time that have been silent since."""
        if (names := self.ends.getValue((at,))) is None:
            return
        for name in json.loads(names[0]):
            kept = self.state.getValue((name,))
            if kept is not None and upto >= kept[1] + self.idle * 1_000_000:
                self.state.removeKey((name,))
        self.ends.removeKey((at,))

    def _frame(self, made: list[tuple]) -> pd.DataFrame:
        """Results with the key's columns, if `out` has them, in front."""
        fields = [c.split() for c in self.out.split(", ")]
        own = len(fields) - len(made[0][1]) if made else 0
        frame = pd.DataFrame([(*k[:own], *r) for k, r in made], columns=[n for n, _ in fields], dtype=object)
        for name, kind in fields:
            if kind == "timestamp":
                frame[name] = pd.to_datetime(frame[name].astype("int64"), unit="us")
            elif kind != "string":
                frame[name] = frame[name].astype({"long": "Int64", "double": "float64", "boolean": "boolean"}[kind])
        return frame

    def run(self, key, state: dict, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _same_time(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows in runs of equal ts."""
    run: list[tuple] = []
    for r in rows:
        if run and r[0] != run[0][0]:
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def in_order(rows: DataFrame, keys: tuple[str, ...], processor: InOrder, buckets: int = 512) -> DataFrame:
    """The processor over rows, which have a watermark on ts, and ts_us. The number of buckets is part of a query's state."""
    processor.keys = {k: {"bigint": "long"}.get(kind := rows.schema[k].dataType.simpleString(), kind) for k in keys}
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, processor.out, "Append", "EventTime", eventTimeColumnName="ts")


def with_event_time(rows: DataFrame, late: str) -> DataFrame:
    """Adds ts_us and the watermark. Rows later than `late` behind the newest one are dropped."""
    at = F.col("ts").cast("timestamp")
    return rows.withColumn("ts", at).withColumn("ts_us", F.unix_micros(at)).withWatermark("ts", late)


CARRIED = "source_type string, source_id string, outcome long, tool string, injection double, behavior double, out_of_scope boolean, violation string"


class SessionProcessor(InOrder):
    """The rules of one session's calls in order, as sequence.sandbox and sequence.flag_rate have them: twin_unsafe and session_risk.

    State: objects that exist, running sums, domains, and the flags of the last flag_seconds."""

    columns = f"ts_us long, call_id long, {CARRIED}, resource string, known boolean, amount double, domain string"
    out = f"session_id string, ts timestamp, call_id long, {CARRIED}, twin_unsafe boolean, session_risk double"

    def __init__(self, caps: SandboxCaps, flag_at: float, flag_seconds: int = DAY, idle: int | None = 8 * DAY):
        super().__init__(idle)
        self.caps, self.flag_at, self.flag_us = caps, flag_at, flag_seconds * 1_000_000

    def _unsafe(self, state: dict, r: dict) -> bool:
        c, tool, resource = self.caps, r["tool"], r["resource"]
        there = state.setdefault("there", {})
        name = "" if resource is None else "=" + resource
        bad = False
        if tool in ("send_email", "forward_email"):
            bad = not r["known"]
        elif tool == "create_event":
            bad = r["amount"] > c.attendees
        elif tool == "run_code":
            state["compute"] = state.get("compute", 0.0) + r["amount"]
            bad = state["compute"] > c.compute_seconds
        elif tool == "issue_refund":
            sums = state.setdefault("refunds", {})
            sums[name] = sums.get(name, 0.0) + r["amount"]
            bad = sums[name] > c.refund_usd
        elif tool == "fetch_url":
            seen = state.setdefault("domains", [])
            if r["domain"] not in seen:
                seen.append(r["domain"])
            bad = len(seen) > c.domains or bool(c.trusted_domains) and r["domain"] not in c.trusted_domains
        elif tool == "delete_file":
            bad = resource is not None and there.get(name, False)
        if tool in ("write_file", "save_note"):
            there[name] = True
        elif tool in ("delete_file", "cancel_event"):
            there[name] = False
        return bad

    def run(self, key, state: dict, rows: list[tuple]) -> list[tuple]:
        made, flags = [], state.setdefault("flags", [])
        for run in _same_time(rows):
            t = run[0][0]
            while flags and flags[0][0] < t - self.flag_us:
                flags.pop(0)
            n = sum(f[1] for f in flags)
            risk = sum(f[2] for f in flags) / n if n else 0.0
            for r in run:
                unsafe = self._unsafe(state, dict(zip(self.names, r)))
                made.append((*r[: 2 + CARRIED.count(",") + 1], unsafe, risk))
            flags.append([t, len(run), sum(r[self.names.index("injection")] > self.flag_at for r in run)])
        return made


class TrustAsOf(InOrder):
    """Calls of one source with its trust before them; those with an outcome then move it. Calls at one ts see the same trust."""

    columns = "ts_us long, call_id long, outcome long, tool string, injection double, behavior double, out_of_scope boolean, violation string, twin_unsafe boolean, session_risk double"
    out = "ts timestamp, call_id long, tool string, injection double, behavior double, out_of_scope boolean, violation string, twin_unsafe boolean, session_risk double, trust double"

    def run(self, key, state: dict, rows: list[tuple]) -> list[tuple]:
        made, now = [], state.get("trust", BASE_TRUST.get(key[0], UNKNOWN_TRUST))
        for run in _same_time(rows):
            made += [(r[0], r[1], *r[3:], now) for r in run]
            for r in run:
                if r[2] is not None:
                    now = trust.DECAY * now + (1 - trust.DECAY) * r[2]
        state["trust"] = now
        return made


def _signals(calls: DataFrame, policies: DataFrame, caps: SandboxCaps) -> DataFrame:
    """The stateless part of each call, with the columns the processors read."""
    scoped = policy.authorize(trust.tagged(calls), policies).withColumn("out_of_scope", ~F.col("allowed"))
    usual = sequence.deviation(scoped.withColumn("tools", F.array("tool_name")))
    tool, mail = F.col("tool_name"), F.col("tool_name").isin("send_email", "forward_email")
    amounts = {"create_event": "attendee_count", "run_code": "timeout_seconds", "issue_refund": "amount_usd"}
    amount = F.coalesce(*[F.when(tool == t, sequence.param(p)) for t, p in amounts.items()], F.lit(0.0))
    known = F.when(mail, F.coalesce(F.col("resource").isin(*caps.contacts), F.lit(False)) if caps.contacts else F.lit(False))
    domain = F.when(tool == "fetch_url", F.regexp_extract(F.coalesce("resource", F.lit("")), sequence.DOMAIN, 1))
    return usual.select(
        "session_id", "ts", "ts_us", "call_id", "source_type", "source_id", F.col("outcome").cast("long").alias("outcome"), tool.alias("tool"), "injection", F.col("deviation").alias("behavior"),
        "out_of_scope", "violation", "resource", known.alias("known"), amount.alias("amount"), domain.alias("domain"),
    )


def live_decisions(calls: DataFrame, policies: DataFrame, caps: SandboxCaps = SandboxCaps(), config: FusionConfig = FusionConfig(), flag_at: float = 0.7, flag_seconds: int = DAY, late: str = "1 day", idle: int = 8 * DAY) -> DataFrame:
    """The decision on every call of a stream, with all its signals as they were at the call's time, and the message.

    Calls (with outcome: 1, 0, or null where nothing was confirmed) are authorized, pass their session's rules, then their
    source's trust, and are fused: two stateful steps in one query. It gives what fusion.run_pipeline with flag_at gives for
    calls that are not late, if no session is silent for idle seconds and then goes on."""
    ready = _signals(with_event_time(calls, late), policies, caps)
    checked = in_order(ready, ("session_id",), SessionProcessor(caps, flag_at, flag_seconds, idle))
    trusted = in_order(checked.withColumn("ts_us", F.unix_micros("ts")), ("source_type", "source_id"), TrustAsOf())
    fused = fusion.fuse_signals(trusted.withColumnRenamed("tool", "tool_name"), config)
    return trust.gated(fusion.explained(fused, config).withColumn("risk", F.col("injection"))).drop("risk")


class _TrustOnly(TrustAsOf):
    columns = "ts_us long, call_id long, outcome long"
    out = "source_type string, source_id string, ts timestamp, call_id long, trust double"


def trust_as_of_stream(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Each call's trust as of its time: source_type, source_id, ts, call_id, trust. calls: those columns and outcome (null: not confirmed).

    Confirmations and lookups of a source meet in one keyed step, in order of event time."""
    rows = with_event_time(calls, late).withColumn("outcome", F.col("outcome").cast("long"))
    return in_order(rows, ("source_type", "source_id"), _TrustOnly())


class FirstTrigger(InOrder):
    """Calls of one token in order; first is true for the first one whose risk reaches the limit."""

    columns = "ts_us long, call_id long, data string, risk double"
    out = "token_id string, ts timestamp, call_id long, data string, risk double, first boolean"

    def __init__(self, revoke_at: float, idle: int | None = None):
        super().__init__(idle)
        self.revoke_at = revoke_at

    def run(self, key, state: dict, rows: list[tuple]) -> list[tuple]:
        made = []
        for r in rows:
            first = r[3] is not None and r[3] >= self.revoke_at and not state.get("done")
            if first:
                state["done"] = True
            made.append((*r, first))
        return made


class RevokedAt(InOrder):
    """Calls (kind 1) of one token with the time at which it was revoked by then; kind 0 revokes it. At one ts revocations come first."""

    columns = "ts_us long, kind long, call_id long, data string"
    out = "token_id string, ts timestamp, call_id long, data string, revoked_us long"

    def run(self, key, state: dict, rows: list[tuple]) -> list[tuple]:
        made = []
        for t, kind, call, data in rows:
            if kind == 0:
                state.setdefault("at", t)
            else:
                made.append((t, call, data, state.get("at")))
        return made


def governed_stream(calls: DataFrame, policies: DataFrame, credentials: DataFrame, lineage: DataFrame, revoke_at: float = 0.8, tighten_at: float = 0.5, late: str = "1 day") -> DataFrame:
    """policy.govern over a stream: a token's first call of high risk revokes it and, through the lineage (an index of all pairs of
    ancestor and token), every token derived from it that was issued by then, whatever key it is held under.

    Two keyed steps: the first finds each token's first trigger, the lineage turns it into events of all tokens below, and
    the second meets these with the calls of each token in order of event time."""
    fields = ["role", "tool_name", "resource", "params"]
    rows = with_event_time(calls, late).withColumn("data", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    seen = in_order(rows.select("token_id", "ts", "ts_us", "call_id", "data", "risk"), ("token_id",), FirstTrigger(revoke_at))
    below = lineage.groupBy(F.col("ancestor").alias("token_id")).agg(F.collect_list(F.struct(F.col("token_id").alias("token"), "issued")).alias("below"))
    met = seen.join(below, "token_id", "left")
    event = lambda token, kind: F.struct(token.alias("token_id"), F.lit(kind).cast("long").alias("kind"))
    reached = F.filter(F.coalesce("below", F.array()), lambda b: F.col("first") & (b["issued"] <= F.col("ts")))
    events = F.concat(F.array(event(F.col("token_id"), 1)), F.transform(reached, lambda b: event(b["token"], 0)))
    spread = met.select("ts", F.unix_micros("ts").alias("ts_us"), "call_id", F.to_json(F.struct("data", "risk")).alias("data"), F.explode(events).alias("e"))
    done = in_order(spread.select("e.token_id", "ts", "ts_us", "e.kind", "call_id", "data"), ("token_id",), RevokedAt())
    call = F.from_json("data", "data string, risk double")
    back = done.withColumn("c", call).withColumn("d", F.from_json("c.data", "role string, tool_name string, resource string, params map<string,string>"))
    flat = back.select("token_id", "ts", "call_id", *[F.col(f"d.{c}").alias(c) for c in fields], F.col("c.risk").alias("risk"), F.timestamp_micros("revoked_us").alias("revoked"))
    return policy.tightened(policy.authorize(flat, policies, credentials, revoked_at="revoked"), tighten_at).drop("revoked")


class BufferProcessor(StatefulProcessor):
    """A key's buffer, which is emptied when it holds `least` entries: it fires then, with a number and the entries."""

    least = 50

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "seq long")
        self.fired = handle.getValueState("fired", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.buffer.get()] if self.buffer.exists() else []
        n, made = self.fired.get()[0] if self.fired.exists() else 0, []
        for f in rows:
            held += f["seq"].tolist()
        held.sort()
        for k in range(self.least, len(held) + 1, self.least):
            n += 1
            made.append((key[0], held[k - 1], n, held[k - self.least : k]))
        self.buffer.put([(x,) for x in rest]) if (rest := held[len(made) * self.least :]) else self.buffer.clear()
        self.fired.update((n,))
        yield pd.DataFrame(made, columns=["key", "seq", "batch", "entries"])

    def close(self) -> None:
        pass


def trigger_stream(evasions: DataFrame, least: int = 50) -> DataFrame:
    """Retraining triggers of a stream of evasions (key, seq, in order per key over the batches): key, seq, batch, entries."""
    p = BufferProcessor()
    p.least = least
    return evasions.groupBy("key").transformWithStateInPandas(p, "key long, seq long, batch long, entries array<long>", "Append", "None")
