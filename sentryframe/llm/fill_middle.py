"""Fill-in-middle transformation: two cuts of a text, found in a wavelet matrix over character classes.

The UTF-8 bytes of a batch of texts are given classes (inner byte of a character, first letter of a word, other letter or
digit, blank, line feed, mark). A wavelet matrix of three bit planes holds them, each plane with counts of its ones by 64-bit
word, and answers rank(class, i): how often a class occurs before i. Sums of ranks count the boundaries of a unit: characters
begin at all bytes but inner ones, words at their first letters, lines after line feeds. Bisection on these counts
finds where unit k begins, for the cuts of all texts of a batch at once, so no text is decoded or walked.

A text becomes its plain self, `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm). The cuts and
the form come from the SHA-256 of a seed and the id, so repeated runs agree.

Cases: null text counts as empty; an empty text is plain; so is one that holds a marker; n units have n + 1 cuts, so prefix,
middle or suffix may be empty; a null id is drawn as an empty one; repeated rows come out alike; an empty table gives no
rows. A batch is about 1 MB of text, or one text that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .encoding import release, small_batches, text_bytes

INNER, FIRST, LETTER, BLANK, LINE, MARK = range(6)
PLANES = 3
UNITS = {"char": (FIRST, LETTER, BLANK, LINE, MARK), "word": (FIRST,), "line": (LINE,)}
MARKERS = ("<P>", "<S>", "<M>")
COLUMNS = "n long, form string, prefix_end long, middle_end long, prefix_bytes long, middle_bytes long, output binary"


def _base_classes() -> np.ndarray:
    c = np.full(256, LETTER, np.uint8)
    c[:0x80] = MARK
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        c[low:high] = LETTER
    c[0x80:0xC0] = INNER
    c[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
    c[0x0A] = LINE
    return c


_BASE = _base_classes()


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte. starts: where texts begin; a letter there, or after anything but a letter, begins a word."""
    c = _BASE[raw]
    letter = c == LETTER
    joined = letter | (c == INNER)  # bytes of a word: an inner byte belongs to the letter before it
    first = letter.copy()
    first[1:] &= ~joined[:-1]
    begins = starts[starts < len(raw)]
    first[begins] = letter[begins]
    c[first] = FIRST
    return c


class WaveletMatrix:
    """Ranks over a sequence of small numbers: each plane holds one bit of every number, stably parted by the planes above it."""

    def __init__(self, values: np.ndarray, planes: int = PLANES):
        self.n, self.words, self.ones, self.zeros = len(values), [], [], []
        for k in range(planes - 1, -1, -1):
            bit = (values >> k & 1).astype(bool)
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            bytes_ = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(bytes_)] = bytes_
            self.words.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones_before(self, plane: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[plane][w] + np.bitwise_count(self.words[plane][w] & low).astype(np.int64)

    def rank(self, value: int, i: np.ndarray) -> np.ndarray:
        """How many of the first i numbers are value, for an array of i."""
        low, high, planes = np.zeros_like(i), i, len(self.words)
        for p in range(planes):
            a, b = self._ones_before(p, low), self._ones_before(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if value >> (planes - 1 - p) & 1 else (low - a, high - b)
        return high - low


def boundaries(matrix: WaveletMatrix, unit: str, i: np.ndarray) -> np.ndarray:
    """How many units begin (lines: end) before byte i."""
    if unit == "char":
        return i - matrix.rank(INNER, i)
    return sum(matrix.rank(c, i) for c in UNITS[unit])


def cut_at(matrix: WaveletMatrix, unit: str, start: np.ndarray, end: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The byte at which the first k of the n units of each text [start, end) are over: 0 units end at its start, n at its end."""
    want = boundaries(matrix, unit, start) + k + (unit != "line")
    inside = (k > 0) & (k < n)
    low, high = np.where(inside, start, end - 1), end.copy()  # fewer than `want` boundaries stand before low, at least as many before high
    while (high - low > 1).any():
        middle = (low + high) >> 1
        enough = boundaries(matrix, unit, middle) >= want
        low, high = np.where(enough, low, middle), np.where(enough & (middle > low), middle, high)
    return np.where(k == 0, start, np.where(inside, high - (unit != "line"), end))


def check_markers(markers: tuple[str, str, str]) -> None:
    """A marker's first character must occur nowhere else in the markers: then none can arise where parts meet, and outputs can be taken apart."""
    if len(markers) != 3 or not all(markers) or len(set(markers)) < 3 or any(m[0] in "".join(x[1:] for x in markers) for m in markers):
        raise ValueError("three different markers are needed whose first characters occur in no marker's rest")


def restore(output: bytes, form: str, markers: tuple[str, str, str] = MARKERS) -> bytes:
    """The text from an output and its form."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in markers)
    head, _, middle = output.partition(m)
    one, other = (p, s) if form == "psm" else (s, p)
    first, _, second = head[len(one) :].partition(other)
    return first + middle + second if form == "psm" else second + middle + first


def draws(id_: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from the SHA-256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _transform(raw: np.ndarray, at: np.ndarray, h: np.ndarray, unit: str, markers: tuple[str, str, str], plain_pct: int, spm_pct: int) -> dict:
    """The result columns of one batch: texts are raw[at[i]:at[i + 1]], h their draws."""
    matrix, start, end = WaveletMatrix(classes(raw, at[:-1])), at[:-1], at[1:]
    n = boundaries(matrix, unit, end) - boundaries(matrix, unit, start)
    a, b = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    one, two = cut_at(matrix, unit, start, end, a, n), cut_at(matrix, unit, start, end, b, n)
    p, s, m = (x.encode() for x in markers)
    data, forms, outputs = raw.tobytes(), [], []
    for i, (x, y, u, v) in enumerate(zip(start.tolist(), end.tolist(), one.tolist(), two.tolist())):
        text = data[x:y]
        if not text or h[i, 2] % 100 >= plain_pct or any(k in text for k in (p, s, m)):
            forms.append("plain")
            outputs.append(text)
        elif h[i, 3] % 100 < spm_pct:
            forms.append("spm")
            outputs.append(s + data[v:y] + p + data[x:u] + m + data[u:v])
        else:
            forms.append("psm")
            outputs.append(p + data[x:u] + s + data[v:y] + m + data[u:v])
    cut = np.array([f != "plain" for f in forms], bool)
    some = lambda c: pa.array(c, pa.int64(), mask=~cut)
    return {"n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_end": some(a), "middle_end": some(b), "prefix_bytes": some(one - start), "middle_bytes": some(two - one), "output": pa.array(outputs, pa.binary())}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", markers: tuple[str, str, str] = MARKERS, plain_from: int = 90, spm_below: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units of the text), form, prefix_end and middle_end (in units), prefix_bytes, middle_bytes, output.

    unit: char, word or line. Of 100 texts, those drawn plain_from or more stay plain; of the others, those drawn under
    spm_below get the suffix first. A word's unit reaches up to the next word; what stands before the first word is with it."""
    check_markers(markers)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for b in small_batches(batch, "text", 1_000_000):
                raw, at = text_bytes(b.column("text"))
                h = np.array(b.column("h").to_pylist(), np.int64).reshape(-1, 4)
                made = _transform(raw, at, h, unit, markers, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made.values()], ["doc_id", *made])

    id_ = F.col(id_col)
    rows = docs.select(id_.cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), draws(id_, seed).alias("h"))
    return rows.mapInArrow(work, f"doc_id long, {COLUMNS}")


def restored(transformed: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Adds text: what the output and the form give back."""
    out = StructType([*transformed.schema.fields, StructField("text", BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [restore(o, f, markers) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary())], [*b.schema.names, "text"])

    return transformed.mapInArrow(work, out)


def digest_rows(docs: DataFrame) -> DataFrame:
    """The outputs and the texts rebuilt from them as digests."""
    rows = restored(fill_in_middle(docs))
    return rows.select("doc_id", "n", "form", F.col("prefix_end").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
