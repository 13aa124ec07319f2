"""Language by cross-parsing: which language's sample text can be pasted together into this text with the fewest phrases.

For each language a suffix automaton of a labelled sample is built. It walks along a text as long as what it has read since
the phrase began occurs in the sample; where it gets stuck, a phrase ends and the next begins. Few, long phrases mean that
text and sample share their language. Phrases are normalised by the number of characters parsed.

Every letter of the samples has its own code. The automata are dense tables for the `alphabet` most frequent letters and
sorted (state, code) keys for all others, so a batch of texts is walked in lockstep: texts are dealt into lanes of `lane` characters
(a new lane begins a new phrase, for all languages alike) and every step moves all lanes in all languages at once. Whole
texts are parsed.

The sample is bounded: per language at most `docs_per_lang` documents of at most `max_chars` characters each and
`chars_per_lang` together. They are whole texts, taken by a hash of their row; a language of longer texts only gets its
shortest, if that has at most `longest` characters. The `max_langs` languages with most labelled rows are learned. `dense_bytes`
bounds the dense tables: with many languages fewer letters are dense, which changes nothing but speed. Cases: null text, or one without a letter, is `und` with score 0; ties go to the first language in order; with
no labelled text every prediction is `und`; null labels are not learned; repeated rows give repeated results; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoding import small_batches

OTHER, DIGIT, SPACE = 1, 2, 3


def suffix_automaton(codes: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The automaton of all substrings: its dense transition table (states x width) for codes under width, and (state, code,
    next) of the others; 0, the root, stands for no transition."""
    n = 2 * len(codes) + 2
    move = np.zeros((n, width), np.int32)
    link, length = [-1] * n, [0] * n
    other: dict[int, dict[int, int]] = {}

    def get(p: int, c: int) -> int:
        return int(move[p, c]) if c < width else other.get(p, {}).get(c, 0)

    def put(p: int, c: int, q: int) -> None:
        if c < width:
            move[p, c] = q
        else:
            other.setdefault(p, {})[c] = q

    last, size = 0, 1
    for c in codes.tolist():
        cur, size = size, size + 1
        length[cur] = length[last] + 1
        p = last
        while p != -1 and not get(p, c):
            put(p, c, cur)
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = get(p, c)
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, size = size, size + 1
                length[clone], link[clone] = length[p] + 1, link[q]
                move[clone] = move[q]
                if q in other:
                    other[clone] = dict(other[q])
                while p != -1 and get(p, c) == q:
                    put(p, c, clone)
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return move[:size], [(p, c, q) for p, to in other.items() for c, q in to.items()]


class CrossParser:
    """Languages, the map from characters to codes, and one table of all automata one after another."""

    def __init__(self, samples: dict[str, str], alphabet: int = 60, lane: int = 256, dense_bytes: int = 96 << 20):
        self.langs, self.lane = sorted(samples), lane
        points = [self._points(samples[g].lower()) for g in self.langs]
        alphabet = max(0, min(alphabet, dense_bytes // (8 * max(1, sum(map(len, points)))) - 4))
        seen, counts = np.unique(np.concatenate(points), return_counts=True) if points else (np.zeros(0, np.uint32), np.zeros(0))
        self.code_of = np.full(0x110000, OTHER, np.int32)
        self.width = code = 4 + alphabet
        for x, _ in sorted(zip(seen.tolist(), counts.tolist()), key=lambda t: (-t[1], t[0])):
            if chr(x).isalpha():
                self.code_of[x], code = code - alphabet, code + 1
        for x in range(0x3100):
            if chr(x).isspace():
                self.code_of[x] = SPACE
            elif chr(x).isdigit():
                self.code_of[x] = DIGIT
        self.n_codes = max(code - alphabet, self.width)
        tables, keys, nexts, self.roots, base = [], [], [], [], 0
        for p in points:
            t, other = suffix_automaton(self.code_of[p], self.width)
            other = np.array(other, np.int64).reshape(-1, 3)
            keys.append((other[:, 0] + base) * self.n_codes + other[:, 1])
            nexts.append(other[:, 2] + base)
            t[t > 0] += base
            tables.append(t)
            self.roots.append(base)
            base += len(t)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int64)
        keys, nexts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nexts))
        by = np.argsort(keys)
        self.keys, self.nexts = keys[by], nexts[by].astype(np.int32)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States (languages x lanes) after the codes c; 0 where there is no transition."""
        wide = c >= self.width
        if not wide.any():
            return self.table[state * np.int32(self.width) + c]
        out = self.table[state * np.int32(self.width) + np.where(wide, 0, c)]
        out[:, wide] = 0
        if len(self.keys):
            key = state[:, wide].astype(np.int64) * self.n_codes + c[wide]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[:, wide] = np.where(self.keys[at] == key, self.nexts[at], 0)
        return out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (languages x texts) and characters of the texts."""
        points = [self._points(t.lower()) for t in texts]
        size = np.fromiter(map(len, points), np.int64, len(points))
        codes = self.code_of[np.concatenate(points)] if points else np.zeros(0, np.int32)
        n = -(-size // self.lane)
        text = np.repeat(np.arange(len(texts)), n)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * self.lane
        length = np.minimum(self.lane, size[text] - at)
        begin = (np.cumsum(size) - size)[text] + at
        order = np.argsort(-length, kind="stable")
        length, begin, text = length[order], begin[order], text[order]
        k, lanes = len(self.langs), len(order)
        state = np.repeat(self.roots[:, None], lanes, 1).astype(np.int32)
        count = np.zeros((k, lanes), np.int32)
        roots = self.roots[:, None].astype(np.int32)
        root_row = self._next(np.repeat(roots, self.n_codes, 1), np.arange(self.n_codes))
        live = np.searchsorted(-length, -np.arange(self.lane), "left")  # lanes that are longer than t
        for t in range(self.lane):
            m = int(live[t])
            if not m:
                break
            c = codes[begin[:m] + t]
            step = self._next(state[:, :m], c)
            stuck = step == 0
            count[:, :m] += stuck
            again = root_row[:, c]
            # a character the sample lacks is a phrase of its own
            np.copyto(step, np.where(again == 0, roots, again), where=stuck)
            state[:, :m] = step
        out = np.zeros((k, len(texts)), np.int64)
        for g in range(k):
            out[g] = np.bincount(text, count[g], len(texts))
        return out, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        if known and self.langs:
            n, size = self.phrases([texts[i] for i in known])
            rate = (n + 1) / size
            best = np.argmin(rate, 0)
            others = np.where(np.arange(len(self.langs))[:, None] == best, np.inf, rate).min(0) if len(self.langs) > 1 else np.full(len(known), np.inf)
            for j, i in enumerate(known):
                langs[i] = self.langs[best[j]]
            score[known] = 1 - rate[best, np.arange(len(known))] / others
        return langs, score


def sample(labelled: DataFrame, docs_per_lang: int = 300, chars_per_lang: int = 30_000, max_chars: int = 3_000, max_langs: int = 64, longest: int = 1_000_000) -> dict[str, str]:
    """Sample text per language. labelled has doc_id, text and lang of training rows only. Rows are chosen first, as narrow ones."""
    known = labelled.filter(f"lang is not null and length(text) > 0 and length(text) <= {longest}")
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_langs).select("lang")
    rows = known.join(F.broadcast(langs), "lang", "left_semi").select("doc_id", "lang", "text", F.length("text").alias("chars"), F.xxhash64("doc_id", "text").alias("k"))
    fits = F.col("chars") <= max_chars
    order = (F.when(fits, F.col("k")).asc_nulls_last(), "chars", "k", "doc_id")
    first = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= docs_per_lang)
    # in two steps, so that a language's task gets a bounded number of rows, whatever the number of input partitions
    some = first(rows.select("lang", "doc_id", "k", "chars", F.pmod("k", F.lit(64)).alias("slot")), "lang", "slot")
    ranked = first(some, "lang")
    chosen = ranked.withColumn("upto", F.sum("chars").over(Window.partitionBy("lang").orderBy("r"))).filter((F.col("r") == 1) | (F.col("upto") <= chars_per_lang))
    texts = rows.select("doc_id", "lang", "k", "text").join(F.broadcast(chosen.select("doc_id", "lang", "k", "r").distinct()), ["doc_id", "lang", "k"])
    got: dict[str, dict[int, str]] = {}
    for r in texts.select("lang", "r", "text").distinct().collect():  # within the bounds above
        got.setdefault(r.lang, {})[r.r] = r.text
    return {g: "\n".join(t for _, t in sorted(of.items())) for g, of in got.items()}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser.value
        for batch in batches:
            for b in small_batches(batch, "text", 2_000_000):
                langs, score = p.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")
