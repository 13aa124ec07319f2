"""Encoding whole texts with a tokenizer file of the tokenizers library, in the workers.

Byte-level tokenizers first cut a text into pre-tokens. Some places are certain cuts: before a blank that a character
other than white space follows, between a letter and a mark, and around a single line feed. Texts are cut there with
vector operations on their bytes; each distinct piece is encoded once per worker and its ids are copied to all its places.
"""

from __future__ import annotations

import ctypes
import gc
import os

import numpy as np
import pyarrow as pa

_ENCODERS: dict[tuple, "Encoder"] = {}
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
#: Bytes that begin a character which is surely no white space: graphic ASCII and most lead bytes.
_SOLID = _GRAPH.copy()
_SOLID[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?%&$#*")] = True


def _byte_alphabet() -> set[str]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in keep} | {chr(256 + i) for i in range(256 - len(keep))}


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def sure_cuts(b: np.ndarray) -> np.ndarray:
    """True at bytes before which a pre-token surely begins."""
    n = len(b)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        now, after = b[:-1], b[1:]
        cut[: n - 1] |= (now == 0x20) & _SOLID[after]
        cut[1:n] |= _LETTER[now] & _MARK[after]
    if n > 2:
        line = (b[1:-1] == 0x0A) & _GRAPH[b[:-2]] & _GRAPH[b[2:]]
        cut[1 : n - 1] |= line
        cut[2:n] |= line
    return cut[:n]


_FIELDS = 4  # a kept piece is at most as many 8-byte words
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Ids of at most `most` pieces of up to 32 bytes in flat arrays, found by open addressing on a hash and told apart by all their bytes.

    Some 55 bytes a piece, a fifth of what a dictionary takes. Pieces met in few batches make room when it is nearly full."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.bits = max(4, (2 * most - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = [np.empty(most, np.uint64) for _ in range(_FIELDS)]
        self.size, self.uses, self.count = (np.empty(most, np.uint8) for _ in range(3))
        self.start = np.empty(most, np.int32)
        self.pool, self.filled = np.empty(1024, "<u4"), 0

    @staticmethod
    def key(raw: np.ndarray, begins: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The bytes of each piece (the first 32) as words, filled up with zeros."""
        padded = np.append(raw, np.zeros(8 * _FIELDS, np.uint8))
        words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        return [words[begins + 8 * j if len(begins) else begins] & _MASKS[np.clip(size - 8 * j, 0, 8)] for j in range(_FIELDS)]

    def _slot(self, key: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64)
        for word in key:
            h = (h ^ word) * _MIX
            h ^= h >> np.uint64(29)
        return ((h * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 if it has none."""
        found, left, slot = np.full(len(size), -1, np.int64), np.flatnonzero(size <= 8 * _FIELDS), self._slot(key, size)
        slot = slot[left]
        while len(left):
            entry = self.slots[slot]
            some = entry >= 0
            left, slot, entry = left[some], slot[some], entry[some]
            same = self.size[entry] == size[left]
            for mine, theirs in zip(key, self.keys):
                same &= theirs[entry] == mine[left]
            found[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        hit = found[found >= 0]
        self.uses[hit] = np.minimum(self.uses[hit], 254) + 1
        return found

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot([k[entries] for k in self.keys], self.size[entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            rest = self.slots[slot] != entries
            entries, slot = entries[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def ids_at(self, ids: np.ndarray) -> int:
        """Writes ids behind those of the kept pieces, where they stay until the next call of add; gives their place."""
        if self.filled + len(ids) > len(self.pool):
            pool = np.empty((self.filled + len(ids)) * 5 // 4, "<u4")
            pool[: self.filled] = self.pool[: self.filled]
            self.pool = pool
        self.pool[self.filled : self.filled + len(ids)] = ids
        return self.filled

    def add(self, key: list[np.ndarray], size: np.ndarray, start: np.ndarray, count: np.ndarray, filled: int) -> None:
        """Keeps new, distinct pieces whose ids stand in the pool up to `filled`; those beyond `most` are not kept."""
        n = min(len(size), self.most - self.n)
        new = np.arange(self.n, self.n + n)
        for mine, theirs in zip(key, self.keys):
            theirs[new] = mine[:n]
        self.size[new], self.start[new], self.count[new], self.uses[new] = size[:n], start[:n], count[:n], 0
        self.n, self.filled = self.n + n, filled
        self._place(new)

    def make_room(self) -> None:
        """When seven eighths are taken, keeps at most half: the pieces met again most often."""
        if self.n <= self.most * 7 // 8:
            return
        uses, least = self.uses[: self.n], 1
        while (uses >= least).sum() > self.most // 2:
            least += 1
        kept = np.flatnonzero(uses >= least)
        count = self.count[kept].astype(np.int64)
        before = np.cumsum(count) - count
        self.pool = self.pool[np.repeat(self.start[kept] - before, count) + np.arange(count.sum())]
        for theirs in (*self.keys, self.size, self.count):
            theirs[: len(kept)] = theirs[kept]
        self.uses[: len(kept)], self.start[: len(kept)] = uses[kept] // 2, before
        self.n, self.filled = len(kept), len(self.pool)
        self.slots.fill(-1)
        self._place(np.arange(self.n))


class Encoder:
    """Keeps the ids of at most max_cached pieces of up to 32 bytes."""

    def __init__(self, path: str, specials_as_text: bool = False, max_cached: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = specials_as_text
        known = _byte_alphabet()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if token in added else len(token)
            if token not in added and not known.issuperset(token):
                raise ValueError("a byte-level vocabulary is needed")
        self.kept = Pieces(max_cached)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, some: list[bytes], before: bytes) -> list[bytes]:
        """Encodes pieces in one call, each with `before` in front, and deals the ids out by the widths of the tokens."""
        ids = self._ids((before + before.join(some)).decode())
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + len(before))
        cuts = ((np.searchsorted(np.cumsum(self.width[ids]), ends, "left") + 1) * 4).tolist()
        raw, skip = ids.tobytes(), 4 * bool(before)
        return [raw[i + skip : j] for i, j in zip([0, *cuts], cuts)]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        blank, other, out = [], [], [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if p[0] == 0x20 and len(p) > 1 and p[-1] > 0x20 and p[-1] < 0x7F:
                blank.append(i)
            elif 0x20 < p[0] < 0x7F and 0x20 < p[-1] < 0x7F:
                other.append(i)
            else:
                out[i] = self._ids(p.decode()).tobytes()
        for some, before in ((blank, b""), (other, b"\n")):
            for at in range(0, len(some), 5_000):
                chosen = some[at : at + 5_000]
                for i, ids in zip(chosen, self._learn([pieces[i] for i in chosen], before)):
                    out[i] = ids
        return out

    def encode(self, texts: pa.Array, end_id: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after another, end_id after each text, and the offsets of the texts."""
        raw, at = text_bytes(texts)
        cut = sure_cuts(raw)
        first = at[:-1][np.diff(at) > 0]
        cut[first] = True
        begins = np.flatnonzero(cut)
        bounds = np.append(begins, len(raw))
        size, kept = np.diff(bounds), self.kept
        kept.make_room()
        key = kept.key(raw, begins, size)
        entry = kept.find(key, size)
        known, fresh = entry >= 0, np.flatnonzero(entry < 0)
        start, each = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        start[known], each[known] = kept.start[entry[known]], kept.count[entry[known]]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.array(bounds, pa.int64()).buffers()[1], pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.take(pa.array(fresh)).dictionary_encode()
        which, values = coded.indices.to_numpy(zero_copy_only=False), self._encoded(coded.dictionary.to_pylist())
        count = np.fromiter(map(len, values), np.int64, len(values)) // 4
        lead = np.empty(len(values), np.int64)  # a place of each distinct new piece
        lead[which] = fresh
        order = np.argsort(size[lead] > 8 * _FIELDS, kind="stable")  # the long ones, which are not kept, last
        ends = np.cumsum(count[order])
        base = kept.ids_at(np.frombuffer(b"".join([*(values[i] for i in order.tolist()), np.array([end_id or 0], "<u4").tobytes()]), "<u4"))
        place = np.empty(len(values), np.int64)
        place[order] = base + ends - count[order]
        start[fresh], each[fresh] = place[which], count[which]
        short = order[size[lead[order]] <= 8 * _FIELDS]
        kept.add([k[lead[short]] for k in key], size[lead[short]], place[short], count[short], base + int(count[short].sum()))
        if end_id is not None:
            behind = np.searchsorted(begins, at[1:], "left")
            start, each = np.insert(start, behind, base + (int(ends[-1]) if len(ends) else 0)), np.insert(each, behind, 1)
        ends = np.cumsum(each)
        ids = kept.pool[np.repeat(start - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        done = np.searchsorted(begins, at, "left") + (np.arange(len(at)) if end_id is not None else 0)
        return ids, np.append(0, ends)[done]


def settle() -> None:
    """Gives memory that is free inside the worker back to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim is not None:
        trim(0)


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    key = (path, specials_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, specials_as_text)
    settle()
    return _ENCODERS[key]


def release() -> None:
    """Frees the worker's encoders; operators that don't encode call it, as Python workers serve one stage after another."""
    _ENCODERS.clear()
    gc.collect()
    settle()


def released(work):
    """work without the worker's encoders; what it used goes back to the system when it ends, as idle workers stay while the JVM needs memory."""

    def run(batches):
        release()
        yield from work(batches)
        release()

    return run


def small_batches(batch: pa.RecordBatch, text: str, max_bytes: int = 2_000_000):
    """Slices of an Arrow batch whose texts have about max_bytes together, so that long texts don't pile up."""
    at = text_bytes(batch.column(text))[1]
    group = at[:-1] // max_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
