"""Personal data by anchors: an Aho-Corasick automaton finds signs and cues, local parsers expand and validate around them.

Anchors are at-signs, plus signs, scheme separators, digits and words such as IBAN or account. From an anchor a parser
reads only its neighbourhood: an email's two sides, a run of digits, a number after a cue. Each parser goes from left to
right and starts no earlier than its kind's last match ended, which gives the leftmost, non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+){3}, parts at most 255
    card   [0-9]([ -]?[0-9])+, 12 to 19 digits with a right Luhn sum
    phone  \\+[0-9][ ().0-9-]+[0-9], 9 to 15 digits

and besides them url, iban (with its check digits), ssn and account spans, which only cues can find. Time is linear in the
text, so very long texts are read whole.

Cases: null text is empty and has no spans; matches that fail a check are dropped without another try; repeated rows each
give their own row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import small_batches

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9\[][^\s<>\"'`]*")
_IBAN = re.compile(r"[\s:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\s:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?[\s:#]{0,3}([A-Z]{0,4}[0-9](?:-?[0-9]){5,17})(?![A-Za-z0-9])", re.I)
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_FINDER = None


def _finder():
    global _FINDER
    if _FINDER is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for sign in "@+":
            a.add_word(sign, (sign, 1))
        a.add_word("://", (":", 3))
        for d in "0123456789":
            a.add_word(d, ("0", 1))
        for cue, kind in _CUES.items():
            a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _FINDER = a
    return _FINDER


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, sorted; offsets in code points."""
    found, done = [], [0] * len(KINDS)
    low = text.lower()  # cues count in any case
    if len(low) != len(text):  # a letter whose lower case is two would move what follows
        low = text.translate(_LOWER)
    for last, (sign, width) in _finder().iter(low):
        at = last - width + 1
        if sign == "0":
            if at >= done[2] and (m := _CARD.match(text, at)):
                done[2] = m.end()
                if 12 <= sum(c in _DIGITS for c in m[0]) <= 19 and luhn("".join(c for c in m[0] if c in _DIGITS)):
                    found.append((at, 2, m.end()))
            if at >= done[1] and (at == 0 or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                done[1] = m.end()
                if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")):
                    found.append((at, 1, m.end()))
        elif sign == "@":
            s = at
            while s > done[0] and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                done[0] = m.end()
                found.append((s, 0, m.end()))
        elif sign == "+":
            if at >= done[3] and (m := _PHONE.match(text, at)):
                done[3] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif sign == ":":
            s = at
            while s > done[4] and text[s - 1] in _SCHEME:
                s -= 1
            while s < at and not ("a" <= text[s].lower() <= "z"):
                s += 1
            if s < at and s >= done[4] and (m := _URL_REST.match(text, at + 3)):
                end = m.start() + len(m[0].rstrip(".,;:!?)]}"))
                if end > m.start():
                    done[4] = end
                    found.append((s, 4, end))
        else:
            k = KINDS.index(sign)
            m = (_IBAN, _SSN, _ACCOUNT)[k - 5].match(text, last + 1)
            if m and m.start(1) >= done[k] and (k != 5 or _iban_ok(m[1])):
                done[k] = m.end(1)
                found.append((m.start(1), k, m.end(1)))
    return sorted(found)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans: array of struct(kind, start, end), sorted by start."""
    kind = "array<struct<kind:string,start:int,end:int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in (s for batch in batches for s in small_batches(batch, "text")):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, type_)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id long, spans {kind}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts with each span replaced by its kind in angle brackets; where spans overlap, the first and longest is named."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in small_batches(batch, "text")):
            out = []
            for t in b.column("text").to_pylist():
                parts, at = [], 0
                for s, k, e in sorted(find_spans(t or ""), key=lambda x: (x[0], -x[2])):
                    if s >= at:
                        parts += (t[at:s], f"<{KINDS[k]}>")
                        at = e
                    elif e > at:
                        at = e
                out.append(None if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, text string")


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute_force(text: str) -> list[tuple[int, int, int]]:
    """The base kinds by their plain expressions, for tests."""
    out = []
    for k, (p, ok) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub(r"[^0-9]", "", s)) <= 19 and luhn(d)),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
        ]
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out)


def spans_sha256(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
