"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is a hashed word vector and the mean of its hashed character 3- to 5-gram vectors. Windows of `window` words
that overlap (each begins `stride` words after the one before; the last ends with the text) pass a GRU in both directions,
attention pools the states, and a logistic unit scores the window. A text's score is that of its highest window, so long
texts are read whole.

Labels are per document, so training picks windows: first those with the most telling words by log-odds, then, in later
rounds, the highest windows under the network itself (for label 0 as hard negatives). It runs on a bounded sample of
labelled rows: at most `max_positive` with label 1 and `max_negative` with label 0, by a hash of their id, none of
over `max_chars` characters. One task trains on it; the driver gets the weights alone.

Cases: null and empty texts get the sample's share of label 1, but under 0.5; with one label only, that share is every
score; null labels are not learned, and a document with both labels is learned with both; a text of fewer words than a window is one padded window; repeated rows get equal
scores; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import released, small_batches

WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8_192, 16_384, 8, 12, 8, 8
WINDOW, STRIDE = 32, 24
_BLANK = bytes(32 if (b < 48 or 57 < b < 97 or 122 < b < 128) else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's own vector; rows of its character n-grams, one word after another; how many it has."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        grams, owner, h = [], [], text.copy()
        for n in range(2, 6):
            h = h[:-1] * np.uint64(0x100000001B3) + text[n - 1 :]
            if n > 2:
                inside = of[: len(h)] == of[n - 1 :]
                grams.append(h[inside])
                owner.append(of[: len(h)][inside])
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        grams = (grams[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
        whole = np.zeros(len(words), np.uint64)
        begin = np.cumsum(size) - size
        power = np.uint64(1)
        for k in range(int(size.max())):
            here = begin[size > k] + k
            whole[size > k] += text[here] * power
            power *= np.uint64(0xC2B2AE3D27D4EB4F)
        whole = (whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
    return whole.astype(np.int64), grams.astype(np.int64), np.bincount(owner, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init_params(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s=None: (rng.standard_normal(shape) * (s or 1 / np.sqrt(shape[0]))).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": draw(WORD_ROWS, WORD_DIM, s=0.05), "char": draw(CHAR_ROWS, CHAR_DIM, s=0.1), "wa": draw(2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND), "w": draw(2 * h), "b": np.full(1, -1, np.float32)}
    for side in "fb":
        p |= {f"x{side}": draw(d, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"u{side}": draw(h, 3 * h)}
    return p


def inputs(p: dict, features: tuple) -> np.ndarray:
    """The input vector of each word."""
    own, grams, n = features
    sums = np.add.reduceat(p["char"][grams], np.cumsum(n) - n, axis=0) if len(n) else np.zeros((0, CHAR_DIM), np.float32)
    return np.concatenate([p["word"][own], sums / n[:, None].astype(np.float32)], 1)


def gru(xp: np.ndarray, u: np.ndarray, index: np.ndarray, mask: np.ndarray | None, back: bool, keep: bool):
    """States (time x windows x hidden). xp holds each word's projected input, index the words of the windows by time."""
    steps, n = index.shape
    h, out, saved = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
    a, b = 2 * HIDDEN, HIDDEN
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, hu = xp[index[t]], h @ u
        zr = _sigmoid(x[:, :a] + hu[:, :a])
        z, r = zr[:, :b], zr[:, b:]
        new = np.tanh(x[:, a:] + r * hu[:, a:])
        nxt = new + z * (h - new)
        if mask is not None:
            nxt = np.where(mask[t][:, None], nxt, h)
        if keep:
            saved.append((t, h, z, r, new, hu[:, a:]))
        h = nxt
        out[t] = h
    return out, saved


def forward(p: dict, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Logit of each window. x: input vectors of words; index: words of the windows (time x windows)."""
    sides = []
    for side, back in (("f", False), ("b", True)):
        sides.append(gru(x @ p[f"x{side}"] + p[f"c{side}"], p[f"u{side}"], index, mask, back, keep))
    o = np.concatenate([sides[0][0], sides[1][0]], 2)
    att = np.tanh(o @ p["wa"] + p["ba"])
    s = att @ p["va"]
    if mask is not None:
        s = np.where(mask, s, np.float32(-1e9))
    e = np.exp(s - s.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, o)
    logit = pooled @ p["w"] + p["b"][0]
    return (logit, (sides, o, att, alpha, pooled)) if keep else logit


def gradients(p: dict, features: tuple, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean log loss and its gradients, back through attention and both recurrences."""
    x = inputs(p, features)
    logit, (sides, o, att, alpha, pooled) = forward(p, x, index, mask, True)
    prob, n = _sigmoid(logit), len(y)
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    g = {}
    d = ((prob - y) / n).astype(np.float32)
    g["w"], g["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dpool = d[:, None] * p["w"]
    dalpha = np.einsum("tnh,nh->tn", o, dpool)
    do = alpha[..., None] * dpool
    ds = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["va"] = np.einsum("tn,tna->a", ds, att)
    dpre = ds[..., None] * p["va"] * (1 - att * att)
    g["wa"], g["ba"] = np.einsum("tnh,tna->ha", o, dpre), dpre.sum((0, 1))
    do += dpre @ p["wa"].T
    dx = np.zeros_like(x)
    order = np.argsort(index, axis=None, kind="stable")  # every word occurs, so each gets a run of its places
    runs = np.searchsorted(index.ravel()[order], np.arange(len(x)))
    for k, side in enumerate("fb"):
        u, du = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
        dstep = np.empty((*index.shape, 3 * HIDDEN), np.float32)
        dh = np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, new, hun in reversed(sides[k][1]):
            dh = dh + do[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            m = mask[t][:, None]
            live = dh * m
            da_n = live * (1 - z) * (1 - new * new)
            da_z = live * (h - new) * z * (1 - z)
            da_r = da_n * hun * r * (1 - r)
            dhu = np.concatenate([da_z, da_r, da_n * r], 1)
            dstep[t] = np.concatenate([da_z, da_r, da_n], 1)
            du += h.T @ dhu
            dh = dh * (1 - m) + live * z + dhu @ u.T
        dxp = np.add.reduceat(dstep.reshape(-1, 3 * HIDDEN)[order], runs, axis=0)
        g[f"u{side}"], g[f"x{side}"], g[f"c{side}"] = du, x.T @ dxp, dxp.sum(0)
        dx += dxp @ p[f"x{side}"].T
    own, grams, count = features
    sums = lambda rows, values, n: np.stack([np.bincount(rows, v, n) for v in values.T], 1).astype(np.float32)
    g["word"] = sums(own, dx[:, :WORD_DIM], WORD_ROWS)
    g["char"] = sums(grams, np.repeat(dx[:, WORD_DIM:] / count[:, None], count, 0), CHAR_ROWS)
    return loss, g


def window_starts(n: int) -> list[int]:
    """Where the overlapping windows of n words begin; all words are covered."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class _Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, w: bytes) -> int:
        self[w] = i = len(self)
        return i


def run_windows(p: dict, x: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and logit of every window of texts given as rows of x, the words' inputs."""
    text, start, full, at, before = [], [], [], [], 0
    for i, w in enumerate(ids):
        if len(w):
            s = window_starts(len(w))
            text += [i] * len(s)
            start += s
            full += [min(WINDOW, len(w))] * len(s)
            at += [before] * len(s)
            before += len(w)
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    words = np.append(np.concatenate(ids), np.zeros(WINDOW, np.int32))
    text, start, full, at = np.array(text), np.array(start), np.array(full), np.array(at)
    logit, steps = np.empty(len(text), np.float32), np.arange(WINDOW)[:, None]
    for whole in (True, False):
        which = np.flatnonzero((full == WINDOW) == whole)
        for k in range(0, len(which), 2_048):
            c = which[k : k + 2_048]
            used, index = np.unique(words[at[c] + start[c] + steps], return_inverse=True)
            logit[c] = forward(p, x[used], index.reshape(WINDOW, -1), None if whole else steps < full[c])
    return text, start, logit


class Scorer:
    """Scores texts; words' inputs are kept between batches up to max_words."""

    def __init__(self, params: dict, prior: float, trained: bool, max_words: int = 100_000):
        self.p, self.prior, self.trained, self.max_words = params, prior, trained, max_words
        self.known, self.x = _Vocabulary(), np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)

    def __getstate__(self):
        return {"p": self.p, "prior": self.prior, "trained": self.trained, "max_words": self.max_words, "known": _Vocabulary(), "x": self.x[:0]}

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and logit of every window."""
        if len(self.known) > self.max_words:
            self.known, self.x = _Vocabulary(), self.x[:0]
        old, number = len(self.known), self.known.__getitem__
        ids = [np.fromiter(map(number, w), np.int32, len(w)) for w in map(words_of, texts)]
        if len(self.known) > old:
            fresh = [w for w, _ in zip(reversed(self.known), range(len(self.known) - old))][::-1]
            self.x = np.concatenate([self.x, inputs(self.p, word_features(fresh))])
        return run_windows(self.p, self.x, ids)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.trained:
            text, _, logit = self.window_logits(texts)
            top = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(top, text, logit)
            seen = np.isfinite(top)
            out[seen] = _sigmoid(top[seen].astype(np.float64))
        return out


def _telling(ids: list[np.ndarray], y: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    """How telling each word is for label 1: the log-odds of the word or of its first five bytes, from the documents of each label that hold it."""
    stems = _Vocabulary()
    stem = np.fromiter((stems[w[:5]] if len(w) > 5 else -1 for w in vocabulary), np.int64, len(vocabulary))
    by_word, by_stem = np.zeros((2, len(vocabulary))), np.zeros((2, len(stems) + 1))
    for words, label in zip(ids, y.tolist()):
        u = np.unique(words)
        by_word[label, u] += 1
        by_stem[label, np.unique(stem[u])] += 1  # the last column takes words without a stem
    one, zero = int(y.sum()) + 1, len(y) - int(y.sum()) + 1
    odds = lambda n: np.where(n.sum(0) > 1, np.log((n[1] + 0.1) / one) - np.log((n[0] + 0.1) / zero), 0)
    return np.maximum(np.maximum(odds(by_word), 0), np.where(stem >= 0, odds(by_stem)[stem], 0))


def train(texts: list[str], labels: list[int], rounds: int = 8, epochs: int = 1, rate: float = 0.01, decay: float = 0.3, seed: int = 7) -> Scorer:
    """Trains the network on windows picked from labelled texts; the weights fade by `decay` times the rate a step.

    Vectors of words begin small, so that words never seen say little. The result is the mean of the weights over the steps of
    the last three rounds, which matters most where labels are few."""
    y = np.array(labels, np.int64)
    prior = min(0.49, float(y.mean())) if len(y) else 0.0
    p = init_params(seed)
    if len(y) == 0 or y.min() == y.max():
        return Scorer(p, prior if len(y) else 0.0, False)
    rng, vocabulary = np.random.default_rng(seed), _Vocabulary()
    ids = [np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) for w in map(words_of, texts)]
    words = list(vocabulary)
    telling = _telling(ids, y, words)
    parts = [word_features(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    own, grams, count = (np.concatenate([x[j].astype(np.int32) for x in parts]) if parts else np.zeros(0, np.int32) for j in range(3))
    del vocabulary, words, parts
    begin = np.cumsum(count) - count
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, n_mean, mean = 0, 0, {k: np.zeros_like(v, np.float64) for k, v in p.items()}
    for round_no in range(rounds):
        if round_no:
            x, by_doc = _all_inputs(p, own, grams, count), {}
            for first in range(0, len(ids), 300):
                for i, s, v in zip(*(a.tolist() for a in run_windows(p, x, ids[first : first + 300]))):
                    by_doc.setdefault(first + i, []).append((v, s))
            del x
        picked = []
        for i, w in enumerate(ids):
            if not len(w):
                continue
            starts = window_starts(len(w))
            ranked = sorted(by_doc[i], reverse=True) if round_no else sorted(((telling[w[s : s + WINDOW]].max(), s) for s in starts), reverse=True)
            if y[i]:
                good = [s for v, s in ranked[:3] if v >= (1 if round_no else 2.5)] or [ranked[0][1]]
                picked += [(i, s) for s in good]
            else:
                picked += [(i, s) for s in {ranked[0][1], ranked[min(1, len(ranked) - 1)][1], starts[rng.integers(len(starts))]}]
                if round_no:
                    picked += [(i, s) for v, s in ranked[:3] if v > -3] * 3
        batch = min(128, max(16, len(picked) // 40))
        for _ in range(epochs):
            order = rng.permutation(len(picked))
            for k in range(0, len(order), batch):
                some = [picked[j] for j in order[k : k + batch]]
                rows = [ids[i][s : s + WINDOW] for i, s in some]
                size = np.array([len(r) for r in rows])
                index = np.zeros((len(rows), WINDOW), np.int64)
                for j, r in enumerate(rows):
                    index[j, : len(r)] = r
                used, index = np.unique(index, return_inverse=True)
                n = count[used]
                take = np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                target = y[[i for i, _ in some]].astype(np.float32)
                _, g = gradients(p, (own[used], grams[take], n), index.reshape(len(rows), WINDOW).T, np.arange(WINDOW)[:, None] < size, target)
                step += 1
                lr = rate * min(1, step / 20) * (1 if round_no < rounds - 3 else 0.3)
                for name, d in g.items():
                    m, v = state[name]
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    p[name] *= 1 - lr * decay
                    p[name] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                if round_no >= rounds - 3:
                    n_mean += 1
                    for name in p:
                        mean[name] += p[name]
    return Scorer({k: (v / max(n_mean, 1)).astype(np.float32) for k, v in mean.items()}, prior, True)


def _all_inputs(p: dict, own: np.ndarray, grams: np.ndarray, count: np.ndarray, step: int = 20_000) -> np.ndarray:
    """The input vectors of all words, some at a time."""
    edge = np.append(0, np.cumsum(count))
    parts = [inputs(p, (own[k : k + step], grams[edge[k] : edge[min(k + step, len(own))]], count[k : k + step])) for k in range(0, len(own), step)]
    return np.concatenate(parts) if parts else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)


def sample(docs: DataFrame, labels: DataFrame, max_positive: int = 1_200, max_negative: int = 3_000, max_chars: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and toxic of a bounded sample of training rows, chosen by a hash of the id, in one partition.

    Ids are chosen among narrow rows (id and length); only the chosen ones, a bounded number, fetch their texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    narrow = rows.select("doc_id", F.length("text").alias("chars")).filter(F.col("chars") <= max_chars).select("doc_id").join(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)"), "doc_id")
    chosen = None
    for label, n in ((1, max_positive), (0, max_negative)):
        some = narrow.filter(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    return rows.join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= max_chars).orderBy("toxic", "doc_id", "text").limit(max_positive + max_negative).select("text", "toxic")


def fit(rows: DataFrame) -> Scorer:
    """Trains in one task on a bounded sample (text, toxic); only the weights (about 1 MB) come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            labels += b.column("toxic").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels))], pa.binary())], ["scorer"])

    got = rows.coalesce(1).mapInArrow(released(work), "scorer binary").collect()
    return pickle.loads(got[0].scorer) if got else train([], [])


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs and score."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(_scored(sent, ["doc_id"])), "doc_id long, score double")


def _scored(sent, keep: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            for b in small_batches(batch, "text", 1_000_000):
                scores = pa.array(scorer.score(b.column("text").to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), scores], [*keep, "score"])

    return work


def keep_below(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in small_batches(batch, text_col, 1_000_000):
                yield b.filter(pa.array(sent.value.score(b.column(text_col).to_pylist()) < threshold))

    return docs.mapInArrow(released(work), docs.schema)
