"""Benchmark decontamination: rare n-gram seeds join passages of documents to test items, Smith-Waterman scores them.

Test items are cut into segments (long ones into overlapping segments of `segment` words). A first pass over the documents
counts in how many each n-gram of the items occurs. Every n-gram is a seed: those in at most `rare_share` of the documents
without condition; where a segment meets a text in frequent ones only, it is left out if so few of its words are in the
window that no alignment can reach `min_score` (each word matches once at most, so this drops no leak). So edited and
partial copies of a passage that half the corpus repeats have seeds, too; only a copy without one whole n-gram has none.
A second pass finds the seeds in each whole text, lines up segment and text at each seed, and aligns them by Smith-Waterman
over words (match 2, mismatch -1, gap -1); many alignments are computed at once, one row of all matrices per step. The score
is the alignment's share of the segment's best possible one; pairs of at least `min_score` are leaks.

The items are a stated query set. They are sent to the tasks in blocks of about `block_words` words, with both passes made
and the leaks written per block, so the driver and the tasks hold one block at a time. Texts are never shuffled.

Cases: null and empty texts and items give no pair; items shorter than n words are one seed; punctuation and case are
ignored; equal items each give their pairs; rows with equal ids each give theirs; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, without_ids
from .encoding import released, small_batches
from .toxicity import words_of

MATCH, MISMATCH, GAP = 2, -1, -1
PAIR = "doc_id long, item_id long, score double, n_seeds int, word_start int, word_end int"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    def __missing__(self, w: bytes) -> int:
        return 0


@dataclass
class Items:
    """A block of test items: word ids, segments, and their n-grams by hash."""

    vocabulary: dict
    item: list  # item id of each segment
    words: list  # word ids of each segment
    n: int
    grams: np.ndarray  # sorted distinct hashes
    of_gram: np.ndarray  # per occurrence: place in grams
    segment: np.ndarray  # per occurrence
    place: np.ndarray  # per occurrence: word offset in the segment
    flat: np.ndarray  # the words of all segments
    size: np.ndarray  # words of each segment


def hashes(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-grams whose words are all known (not 0)."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.cumsum(np.append(0, ids > 0))
    at = np.flatnonzero(known[n:] - known[:-n] == n)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h + ids[at + k].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return at, h


def index_items(rows: list[tuple[int, str]], n: int = 4, segment: int = 64) -> Items:
    vocabulary: dict = {}
    item, words, gram, seg, place = [], [], [], [], []
    for item_id, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)
        starts = [0] if len(ids) <= segment * 3 // 2 else [*range(0, len(ids) - segment, segment // 2), len(ids) - segment]
        for s in starts:
            part = ids[s : s + segment] if len(starts) > 1 else ids
            if not len(part):
                continue
            at, h = hashes(part, min(n, len(part)))
            gram.append(h)
            seg.append(np.full(len(h), len(words)))
            place.append(at)
            item.append(item_id)
            words.append(part.astype(np.int32))
    gram = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
    grams, of_gram = np.unique(gram, return_inverse=True)
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Items(vocabulary, item, words, n, grams, of_gram, whole(seg), whole(place), whole(words), np.array(list(map(len, words)), np.int64))


def text_hits(items: Items, known: _Known, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of a text; the places and numbers of the items' n-grams in it."""
    w = words_of(text)
    ids = np.fromiter(map(known.__getitem__, w), np.int32, len(w))
    at, gram = [], []
    for n in sorted({min(items.n, len(s)) for s in items.words}):
        a, h = hashes(ids, n)
        k = np.searchsorted(items.grams, h)
        ok = (k < len(items.grams)) & (items.grams[np.minimum(k, len(items.grams) - 1)] == h) if len(h) else np.zeros(0, bool)
        at.append(a[ok])
        gram.append(k[ok])
    return ids, np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(gram) if gram else np.zeros(0, np.int64)


def smith_waterman(segments: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair and where it ends in its window. All pairs advance together, one segment word a step."""
    n, m, w = len(segments), max(map(len, segments)), max(map(len, windows))
    a, b = np.full((n, m), -1, np.int32), np.full((n, w), -2, np.int32)
    for i, (s, t) in enumerate(zip(segments, windows)):
        a[i, : len(s)], b[i, : len(t)] = s, np.where(t == 0, -3, t)
    h, best, end = np.zeros((n, w + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    slope = -GAP * np.arange(w + 1, dtype=np.int32)
    for j in range(m):
        fresh = np.zeros_like(h)
        diagonal = h[:, :-1] + np.where(b == a[:, j : j + 1], MATCH, MISMATCH)
        np.maximum(fresh[:, 1:], np.maximum(diagonal, h[:, 1:] + GAP), out=fresh[:, 1:])
        h = np.maximum.accumulate(fresh + slope, axis=1) - slope
        at = h.argmax(1)
        top = h[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def reachable(items: Items, seg: np.ndarray, present: np.ndarray, min_score: float) -> np.ndarray:
    """Which of some segments have enough words among those present to reach min_score."""
    n = items.size[seg]
    before = np.cumsum(n) - n
    at = np.repeat((np.cumsum(items.size) - items.size)[seg] - before, n) + np.arange(n.sum())
    return np.add.reduceat(present[items.flat[at]].astype(np.int64), before) >= min_score * n if len(seg) else np.zeros(0, bool)


def align_batch(items: Items, texts: list[str | None], rare: np.ndarray, by_gram: tuple[np.ndarray, np.ndarray], known: _Known, min_score: float) -> list[tuple]:
    """(text, item, score, seeds, first word, last word) of the pairs found in some texts."""
    order, first = by_gram
    jobs = []
    for i, text in enumerate(texts):
        ids, at, gram = text_hits(items, known, text)
        if not len(at):
            continue
        n = first[gram + 1] - first[gram]
        occ = order[np.repeat(first[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        seg, begin = items.segment[occ], np.repeat(at, n) - items.place[occ]
        present = np.zeros(len(items.vocabulary) + 1, bool)
        present[ids] = True
        present[0] = False
        met, of_met = np.unique(seg, return_inverse=True)
        few = np.bincount(of_met, np.repeat(rare[gram], n)) > 0
        few[~few] = reachable(items, met[~few], present, min_score)
        ok = few[of_met]
        seg, begin, sure = seg[ok], begin[ok], np.repeat(rare[gram], n)[ok]
        if not len(seg):
            continue
        by = np.lexsort((begin, seg))
        seg, begin, sure = seg[by], begin[by], sure[by]
        size = items.size[seg]
        present[:] = False
        slack = np.maximum(8, size // 2)
        new = np.append(True, (seg[1:] != seg[:-1]) | (begin[1:] - begin[:-1] > size[1:] + 2 * slack[1:]))
        edges = [*np.flatnonzero(new).tolist(), len(seg)]
        for x, y in zip(edges, edges[1:]):
            lo, hi = max(0, int(begin[x] - slack[x])), min(len(ids), int(begin[y - 1] + size[x] + slack[x]))
            window = ids[lo:hi]
            if not sure[x:y].any():
                present[window[window > 0]] = True
                enough = reachable(items, seg[x : x + 1], present, min_score)[0]
                present[window] = False
                if not enough:
                    continue
            jobs.append((i, int(seg[x]), y - x, lo, window))
    jobs.sort(key=lambda j: (len(j[4]), len(items.words[j[1]])))
    best: dict[tuple, tuple] = {}
    k = 0
    while k < len(jobs):
        some = jobs[k : k + max(1, min(512, 400_000 // max(1, len(jobs[min(k + 511, len(jobs) - 1)][4]))))]
        k += len(some)
        score, end = smith_waterman([items.words[j[1]] for j in some], [j[4] for j in some])
        for (i, s, hits, lo, window), v, e in zip(some, score.tolist(), end.tolist()):
            share = v / (MATCH * len(items.words[s]))
            key = (i, items.item[s])
            if share >= min_score and share > best.get(key, (0,))[0]:
                _, back = smith_waterman([items.words[s][::-1]], [window[:e][::-1]])
                best[key] = (share, hits, lo + e - int(back[0]), lo + e)
    return [(*k, *v) for k, v in sorted(best.items(), key=lambda x: x[0][0])]


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 4, min_score: float = 0.5, rare_share: float = 2e-4, min_rare: int = 20, segment: int = 64, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_seeds, word_start, word_end of every leak."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    total = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // block_words)
    n_docs, found = rows.count() if blocks else 0, spark.createDataFrame([], PAIR)
    for k in range(blocks):
        block = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = index_items(sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), n, segment)
        if len(items.grams):
            found = found.unionByName(_block_leaks(rows, items, max(min_rare, int(rare_share * n_docs)), min_score))
    return found


def _block_leaks(rows: DataFrame, items: Items, most: int, min_score: float) -> DataFrame:
    """The leaks of one block, written: its items leave the driver and the tasks before the next block's come."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        known, n = _Known(items.vocabulary), np.zeros(len(items.grams), np.int64)
        for batch in batches:
            for b in small_batches(batch, "text"):
                for t in b.column("text").to_pylist():
                    n[np.unique(text_hits(items, known, t)[2])] += 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["gram", "n"])

    in_docs = np.zeros(len(items.grams), np.int64)
    for r in rows.mapInArrow(released(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # no more rows than grams in the block
        in_docs[r.gram] = r.n
    rare = in_docs <= most
    order = np.argsort(items.of_gram, kind="stable")
    first = np.searchsorted(items.of_gram[order], np.arange(len(items.grams) + 1))
    chosen = context.broadcast((rare, (order, first)))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (rare, by_gram) = sent.value, chosen.value
        known = _Known(items.vocabulary)
        for batch in batches:
            for b in small_batches(batch, "text"):
                got = align_batch(items, b.column("text").to_pylist(), rare, by_gram, known, min_score)
                if got:
                    i, item, score, hits, start, end = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(i)), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(hits, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                        ["doc_id", "item_id", "score", "n_seeds", "word_start", "word_end"],
                    )

    leaks = table(rows.mapInArrow(released(align), PAIR), "leaks")
    chosen.destroy()
    sent.destroy()
    return leaks


def drop_contaminated(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs without a leak. Leaks are pairs, so their ids are made distinct before the join."""
    return without_ids(docs, leaks.select("doc_id").distinct(), id_col)
