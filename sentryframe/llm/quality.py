"""Quality from trusted positives and unlabelled text: the exact minimum of the non-negative unbiased risk, from sums over all rows.

Each text becomes additive counts of its whole length: pairs of byte classes (letters, capitals, digits, blanks, kinds of
marks), words and lines that repeat the one up to four before, and lengths. Their shares, and fixed random ramps of these, are
the features x of a linear score f(x) = w.x with the squared loss (1 - y f)^2 / 4. With the class prior p, trusted rows P and
all training rows U (whatever their labels), the risk is

    p R_P(+1) + max(0, N),    N = R_U(-1) - p R_P(-1)

All terms are quadratic in w, so counts, means and products of features of P and of U, summed over all rows in tasks, are all
that training needs. The minimum is the saddle point over t in [0, 1] of p R_P(+1) + t N: for a given t, w solves a linear system,
and N at that w falls to 0 by bisection on t, or t is 1. Half of the rows by a hash tell the ridge by the risk of the other half.

The prior is the best-bin estimate: each half is scored by a model of the other that tells P from U; over thresholds, the share
of U above divided by the share of P above bounds the prior from above, and the threshold with the least upper
confidence limit gives it. Nothing here is a sample: sums and histograms cover all rows.

Cases: null counts as empty, and an empty text scores the prior; without trusted positives every score is 0; an id with both labels
is not trusted; null labels are none; a null id is unlabelled and not held out; repeated rows get equal scores; texts of over
a megabyte are counted in pieces, so memory is bounded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .encoding import release, small_batches, text_bytes

N_CLASSES, LAGS, RAMPS = 12, 4, 128
PAIRS = N_CLASSES * N_CLASSES
#: Counts after the pairs: pairs in all, words, words over 20 bytes, repeats by lag, lines, repeated lines by lag, bytes.
N_COUNTS = PAIRS + 3 + LAGS + 1 + LAGS + 1
N_BASE = PAIRS + 1 + 2 * LAGS + 3
DIM = 1 + N_BASE + RAMPS
PIECE, BINS, BLOCK, FAN = 1_000_000, 2_000, 16_384, 64
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _class_table() -> np.ndarray:
    c = np.full(256, 9, np.uint8)  # marks that follow no other rule
    for low, high, k in ((0x61, 0x7B, 0), (0x41, 0x5B, 1), (0x30, 0x3A, 2), (0x80, 0x100, 11)):
        c[low:high] = k
    for chars, k in ((b" \t\r\v\f", 3), (b"\n", 4), (b".,;:", 5), (b"!?", 6), (b"|", 7), (b"()[]{}<>/\\", 8), (b"'\"-_", 10)):
        c[list(chars)] = k
    return c


_CLASS, _LOWER = _class_table(), np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _span_hashes(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for the bytes of each span, alike for equal spans: differences of running sums, brought to a common power."""
    return (sums[end] - sums[begin]) * inverse[begin]


def _repeats(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By text and lag: how many spans equal the one so many before."""
    out = np.zeros((n_docs, LAGS))
    for lag in range(1, LAGS + 1):
        same = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
        out[:, lag - 1] = np.bincount(doc[lag:][same], minlength=n_docs)
    return out


def counts_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Additive counts (texts x N_COUNTS) of texts raw[at[i]:at[i + 1]], of about a megabyte together."""
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, N_COUNTS), np.float64)
    if not len(raw):
        return out
    doc = np.repeat(np.arange(n), size)
    c = _CLASS[raw]
    inside = doc[1:] == doc[:-1]
    pair = c[:-1].astype(np.int64) * N_CLASSES + c[1:]
    out[:, :PAIRS] = np.bincount((doc[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, PAIRS] = np.maximum(size - 1, 0)
    with np.errstate(over="ignore"):
        power, inverse = np.full(len(raw), _P), np.full(len(raw) + 1, _P_INVERSE)
        power[0] = inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(inverse, out=inverse)
        sums = np.append(np.uint64(0), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64))
        k = PAIRS + 1
        for parts, wide in ((np.isin(c, (3, 4)), True), (c == 4, False)):
            begin = ~parts
            begin[1:] &= parts[:-1] | ~inside
            last = ~parts
            last[:-1] &= parts[1:] | ~inside
            b, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
            of = doc[b]
            out[:, k] = np.bincount(of, minlength=n)
            k += 1
            if wide:
                out[:, k] = np.bincount(of[e - b > 20], minlength=n)
                k += 1
            out[:, k : k + LAGS] = _repeats(_span_hashes(sums, inverse, b, e), of, n)
            k += LAGS
    out[:, k] = size
    return out


def base_features(counts: np.ndarray) -> np.ndarray:
    """Shares of the counts (texts x N_BASE)."""
    n = counts.astype(np.float64)
    words, lines, size = n[:, PAIRS + 1 : PAIRS + 2], n[:, PAIRS + 3 + LAGS : PAIRS + 4 + LAGS], n[:, -1:]
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    long_, again, same = n[:, PAIRS + 2 : PAIRS + 3], n[:, PAIRS + 3 : PAIRS + 3 + LAGS], n[:, PAIRS + 4 + LAGS : PAIRS + 4 + 2 * LAGS]
    tall = np.log1p(size) / 12
    return np.concatenate([share(n[:, :PAIRS], n[:, PAIRS : PAIRS + 1]), share(long_, words), share(again, words), share(same, lines), tall, np.minimum(1, 8 / np.maximum(words, 1)), size / np.maximum(words, 1) / 20], 1)


def _ramps(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((N_BASE, RAMPS)) * 1.5, rng.uniform(-1.5, 0.5, RAMPS)


def expand(counts: np.ndarray) -> np.ndarray:
    """The features x (texts x DIM) of counts: 1, the shares, and ramps of them."""
    base = base_features(counts)
    r, b = _ramps()
    return np.concatenate([np.ones((len(base), 1)), base, np.maximum(base @ r + b, 0)], 1)


def count_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts (array of N_COUNTS floats) of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for b in small_batches(batch, "text", PIECE):
                raw, at = text_bytes(b.column("text"))
                n, edges = len(at) - 1, at
                if len(raw) > 2 * PIECE:  # a very long text: pieces, added up
                    edges = np.unique(np.concatenate([at, np.arange(0, len(raw), PIECE)]))
                    of = np.searchsorted(at, edges[:-1], "right") - 1
                    sums = np.zeros((n, N_COUNTS))
                    for i in range(len(of)):
                        sums[of[i]] += counts_of(raw[edges[i] : edges[i + 1]], np.array([0, edges[i + 1] - edges[i]]))[0]
                else:
                    sums = counts_of(raw, at)
                flat = pa.array(sums.astype(np.float32).ravel(), pa.float32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, n * N_COUNTS + 1, N_COUNTS), pa.int32()), flat)], ["doc_id", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, counts array<float>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(len(b), N_COUNTS)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


class Moments:
    """Count, mean vector and mean product matrix of features."""

    def __init__(self, n: float, m: np.ndarray, a: np.ndarray):
        self.n, self.m, self.a = n, m / max(n, 1), a / max(n, 1)

    def risk(self, w: np.ndarray, sign: int) -> float:
        """Mean of (1 - sign f)^2 / 4."""
        return float(1 - 2 * sign * (w @ self.m) + w @ self.a @ w) / 4


def add(parts: list[Moments]) -> Moments:
    n = sum(p.n for p in parts)
    return Moments(n, sum(p.m * p.n for p in parts), sum(p.a * p.n for p in parts))


def moments(marked: DataFrame) -> dict[tuple[bool, int], Moments]:
    """By (trusted, half): the moments of the features of rows doc_id, counts, trusted, half; unlabelled ones are all rows, trusted or not.

    Each task adds its rows up and gives its sums in blocks; blocks are added up over FAN tasks at a time. The driver gets four sums."""
    length = 1 + DIM + DIM * DIM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums, part = {}, 0
        for b in _slices(batches):
            part = b.column("part")[0].as_py()
            x, trusted, half = expand(_matrix(b)), b.column("trusted").to_numpy(zero_copy_only=False), b.column("half").to_numpy()
            for h in (0, 1):
                for kind, rows in ((0, half == h), (1, (half == h) & trusted)):
                    y = x[rows]
                    s = sums.setdefault(2 * kind + h, np.zeros(length))
                    s[0] += len(y)
                    s[1 : 1 + DIM] += y.sum(0)
                    s[1 + DIM :] += (y.T @ y).ravel()
        for kind, s in sums.items():
            for k in range(0, length, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([kind], pa.int32()), pa.array([k // BLOCK], pa.int32()), pa.array([s[k : k + BLOCK].tobytes()], pa.binary())], ["part", "kind", "block", "sums"])

    def merge(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in t.column("sums").to_pylist())
        return pa.table({"part": t.column("part")[:1], "kind": t.column("kind")[:1], "block": t.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    ddl = "part long, kind int, block int, sums binary"
    rows = table(marked.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(work, ddl), "moments")
    most = rows.agg(F.max("part")).first()[0] or 0
    while True:
        rows = table(rows.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "kind", "block").applyInArrow(merge, ddl), "moments")
        most //= FAN
        if most == 0:
            break
    got: dict[int, dict[int, bytes]] = {}
    for r in rows.collect():
        got.setdefault(r.kind, {})[r.block] = bytes(r.sums)
    out = {}
    for kind in range(4):
        s = np.frombuffer(b"".join(got[kind][k] for k in sorted(got[kind])), np.float64) if kind in got else np.zeros(length)
        out[bool(kind // 2), kind % 2] = Moments(s[0], s[1 : 1 + DIM], s[1 + DIM :].reshape(DIM, DIM))
    return out


def _solve(h: np.ndarray, g: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(h + ridge * np.eye(len(g)), g)


def minimise(p: Moments, u: Moments, prior: float, ridge: float) -> np.ndarray:
    """The weights of least non-negative risk, with ridge / 4 times their squares added."""

    def at(t: float) -> np.ndarray:
        return _solve(prior * (1 - t) * p.a + t * u.a, prior * (1 + t) * p.m - t * u.m, ridge)

    negative = lambda w: u.risk(w, -1) - prior * p.risk(w, -1)
    w = at(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0  # N is not negative at low
    for _ in range(40):
        t = (low + high) / 2
        low, high = (t, high) if negative(at(t)) >= 0 else (low, t)
    return at(low)


def risk(p: Moments, u: Moments, prior: float, w: np.ndarray) -> float:
    return prior * p.risk(w, 1) + max(0.0, u.risk(w, -1) - prior * p.risk(w, -1))


def telling(p: Moments, u: Moments, ridge: float = 1e-3) -> np.ndarray:
    """Weights that tell trusted rows (+1) from all rows (-1), both of equal weight."""
    return _solve((p.a + u.a) / 2, (p.m - u.m) / 2, ridge)


def prior_from(hist_p: np.ndarray, hist_u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The best-bin estimate from histograms of scores, low to high."""
    n_p, n_u = hist_p.sum(), hist_u.sum()
    if not n_p or not n_u:
        return 0.0
    q_p, q_u = np.cumsum(hist_p[::-1]) / n_p, np.cumsum(hist_u[::-1]) / n_u
    some = q_p > 0
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p))
    best = np.argmin(np.where(some, (q_u + slack) / np.maximum(q_p, 1e-12), np.inf))
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


class Model:
    """Weights and class prior; without trusted rows the weights are None."""

    def __init__(self, w: np.ndarray | None, prior: float):
        self.w, self.prior = w, prior

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.zeros(len(counts))
        s = np.clip((1 + expand(counts) @ self.w) / 2, 0, 1)
        return np.where(counts[:, -1] == 0, self.prior, s)


def estimate_prior(marked: DataFrame, sums: dict) -> float:
    """From the scores of all rows of each half under the model of the other half."""
    tell = [telling(sums[True, h], sums[False, h]) for h in (0, 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((2, BINS), np.int64)
        for b in _slices(batches):
            x, trusted, half = expand(_matrix(b)), b.column("trusted").to_numpy(zero_copy_only=False), b.column("half").to_numpy()
            s = np.where(half == 0, x @ tell[1], x @ tell[0])
            bin_ = np.clip(((s + 2) / 4 * BINS).astype(np.int64), 0, BINS - 1)
            hist += [np.bincount(bin_, minlength=BINS), np.bincount(bin_[trusted], minlength=BINS)]
        kind, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(hist[kind, at], pa.int64())], ["kind", "bin", "n"])

    hist = np.zeros((2, BINS))
    for r in marked.mapInArrow(work, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.kind, r.bin] = r.n
    return prior_from(hist[1], hist[0])


def fit(features: DataFrame, trusted: DataFrame) -> Model:
    """Trains on all rows of features (doc_id, counts), of which those with an id in trusted (distinct doc_id) are positives."""
    ids = trusted.select("doc_id", F.lit(True).alias("is_trusted"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    marked = table(features.join(ids, "doc_id", "left").select("doc_id", "counts", F.coalesce("is_trusted", F.lit(False)).alias("trusted"), half.alias("half")), "marked")
    sums = moments(marked)
    if any(sums[k].n == 0 for k in sums):
        if sums[True, 0].n + sums[True, 1].n == 0:
            return Model(None, 0.0)
        sums = {(k, h): add([sums[k, 0], sums[k, 1]]) for k in (True, False) for h in (0, 1)}  # too few rows for halves
    prior = estimate_prior(marked, sums)
    tried = [sum(risk(sums[True, 1 - h], sums[False, 1 - h], prior, minimise(sums[True, h], sums[False, h], prior, ridge)) for h in (0, 1)) for ridge in RIDGES]
    both = [add([sums[k, 0], sums[k, 1]]) for k in (True, False)]
    return Model(minimise(*both, prior, RIDGES[int(np.argmin(tried))]), prior)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids whose labels are all 1."""
    kept = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    return kept.groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low = 1 and high = 1").select("doc_id")


def score(features: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of features (doc_id, counts)."""
    sent = features.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(_matrix(b)), pa.float64())], ["doc_id", "score"])

    return features.mapInArrow(work, "doc_id long, score double")


def held_out(id_: Column) -> Column:
    """True where the CRC-32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))
