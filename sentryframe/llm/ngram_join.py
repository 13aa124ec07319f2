"""Grouped prefix join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more, and their components.

1. A pass over the texts gives each document its set's size, keys and a parity bitmap; equal sets are one node from here
   on. Documents are taken in chunks; a chunk sends the distinct shingles of its sets to their hash ranges. Each range is
   counted alone and tells every chunk which of its shingles other chunks or sets have, and how common they are. Nothing of
   this is broadcast or passes the driver.
2. A set's shingles are put into one global order, rare ones first. Two similar sets share a shingle within their prefixes.
   Shingles of one set alone need no posting. Sets with identical prefix and size are collapsed into one group, and only
   groups are posted.
3. Groups that meet at a shingle are paired and filtered by size and place; only pairs that may be similar are expanded to
   members. Members are linked in rounds. In a round, each shingle's list picks two groups as pivots, one from the middle
   of a crowd and one by hash; other groups' members are compared with one member of the pivot, and links merge components.
   Lists and groups within one component drop out, so large groups of near copies cost rows in proportion to their members.
   A last pass pairs all groups that still share a prefix shingle and are not in one component, so no link is missed; its
   lists are split by bands of size, and the smaller side by place, so that impossible pairs don't meet.
4. A pair of members must pass a bound on the symmetric difference from the parity bitmaps; all that pass are compared by
   their whole sets.

Cases: null and empty texts have empty sets and are linked with nothing; a text of fewer words than a shingle is one
shingle; repeated rows are equal sets; a null id never names a component unless all its ids are null; empty tables give
no rows. Shingles are told apart by 64-bit hashes; sets by a 64-bit key, and if a second key shows that two different sets
have one key, all is done again with other keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, table, without_ids
from .encoding import released, small_batches

PARITY_BITS = 2_048
#: What a chunk keeps of each document: set is the place of its set in the chunk, -1 if the set is empty.
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i4"), ("set", "<i4"), ("gid", "<i8"), ("check", "<i8")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words; keeps at most `most`."""

    most = 100_000

    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < self.most:
            self[w] = h
        return h


def shingles(text: str | None, k: int, hashed: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles. Words are parted by ASCII white space, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    ids, size = np.fromiter(map(hashed.__getitem__, w), np.uint64, len(w)), min(k, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h ^= ids[j : len(h) + j]
            h *= _MIX
            h ^= h >> np.uint64(29)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def set_key(s: np.ndarray, seed: int = 0, bits: int = 64) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed) & ((1 << bits) - 1)).view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of elements fall on i: the bits in which two bitmaps differ bound the sets' difference from below."""
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1).astype(bool)).tobytes()


def needed(n_a, n_b):
    """Smallest intersection of sets of these sizes with 100 * both >= 75 * either."""
    return -(-3 * (n_a + n_b) // 7)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def commonness(times: np.ndarray) -> np.ndarray:
    """0 for shingles that occur once, else four steps for each doubling."""
    return np.where(times > 1, np.floor(4 * np.log2(np.maximum(times, 1))) - 3, 0).astype(np.uint8)


def _stable_order(key: np.ndarray) -> np.ndarray:
    """Order of keys under 2^32, ties by place: one sort of plain integers is faster than an argsort."""
    return (np.sort((key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sketch(docs: DataFrame, k: int, range_bits: int, seed: int, key_bits: int, chunk: int) -> DataFrame:
    """Kind 0: a piece (key) of a chunk: documents and, in the order of the tokens, the sets that hold them. Kind 1: the chunk's distinct tokens in one hash range (key).

    A token is the leading bits of a shingle's hash: those of its range and 32 more, 48 in all at most."""
    width = min(48, range_bits + 32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, part, chunk_no = WordHash(), TaskContext.get().partitionId() << 32, 0
        rows, sets, place = [], [], {}
        held = 0

        def flush():
            nonlocal rows, sets, place, held, chunk_no
            if not rows:
                return
            this = part + chunk_no
            # in place: each array of a chunk's shingles is 8 MB
            token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            token >>= np.uint64(64 - width)
            token <<= np.uint64(16)
            token |= np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            token.sort()
            owner = token.astype("<u2")
            token >>= np.uint64(16)
            new = np.append(True, token[1:] != token[:-1])[: len(token)]
            begins = np.flatnonzero(new)
            times = np.minimum(np.diff(begins, append=len(token)), 255).astype(np.uint8)
            value = token[begins]
            del token, begins
            rest = (value & np.uint64((1 << (width - range_bits)) - 1)).astype("<u4")
            value >>= np.uint64(width - range_bits)
            ranges = value.view(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])[: len(ranges)]), len(ranges))
            m, docs = len(edges) - 1, np.array(rows, DOC)
            # in pieces, as the JVM copes better with many small values than with a few of some MB
            n = max(-(-len(owner) // 131_072), -(-len(docs) // 4_000), -(-len(sets) // 1_000))
            data = [*(owner[131_072 * p : 131_072 * (p + 1)].tobytes() for p in range(n)), *(rest[a:b].tobytes() for a, b in zip(edges, edges[1:]))]
            extra = [*(np.packbits(new[131_072 * p : 131_072 * (p + 1)]).tobytes() for p in range(n)), *(times[a:b].tobytes() for a, b in zip(edges, edges[1:]))]
            none = [None] * m
            columns = [
                pa.array(np.append(np.zeros(n), np.ones(m)).astype(np.int32)),
                pa.array(np.append(np.arange(n), ranges[edges[:-1]]).astype(np.int64)),
                pa.array(np.full(n + m, this)),
                pa.array(data, pa.binary()),
                pa.array(extra, pa.binary()),
                pa.array([*(docs[4_000 * p : 4_000 * (p + 1)].tobytes() for p in range(n)), *none], pa.binary()),
                pa.array([*(b"".join(map(parity, sets[1_000 * p : 1_000 * (p + 1)])) for p in range(n)), *none], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "chunk", "data", "extra", "docs", "bits"])
            rows, sets, place, held, chunk_no = [], [], {}, 0, chunk_no + 1

        for batch in batches:
            for b in small_batches(batch, "text", 2_000_000):
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    s = shingles(t, k, hashed)
                    gid, at = set_key(s, seed, key_bits), -1
                    if len(s):
                        at = place.setdefault(gid, len(sets))
                        if at == len(sets):
                            sets.append(s)
                            held += len(s)
                    rows.append((i or 0, i is None, len(s), at, gid, set_key(s, seed + 1)))
                    if held >= chunk or len(sets) >= 60_000 or len(rows) >= 200_000:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(released(work), "kind int, key long, chunk long, data binary, extra binary, docs binary, bits binary")


def _count_ranges(sketch: DataFrame) -> DataFrame:
    """Passes chunks on; tells each chunk which of its tokens in a range are not alone (docs: a mask), these tokens (data) and how common they are (extra)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "chunk", "data", "extra", "docs", "bits"]
        now, held = None, []

        def flush():
            nonlocal held
            if not held:
                return
            chunks, rest, times = zip(*held)
            edges = np.cumsum([0, *map(len, rest)])
            rest, times = np.concatenate(rest), np.concatenate(times).astype(np.int64)
            order = _stable_order(rest)
            ordered = rest[order]
            begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            level = np.empty(len(rest), np.uint8)
            level[order] = np.repeat(commonness(np.add.reduceat(times[order], begins)), np.diff(np.append(begins, len(rest))))
            held = []
            for k in range(0, len(chunks), 500):
                some = list(zip(chunks, edges, edges[1:]))[k : k + 500]
                shared = [(level[a:b] > 0) for _, a, b in some]
                columns = [
                    pa.array(np.ones(len(some), np.int32)),
                    pa.array(np.full(len(some), now, np.int64)),
                    pa.array(np.array([c for c, _, _ in some], np.int64)),
                    pa.array([rest[a:b][s].tobytes() for s, (_, a, b) in zip(shared, some)], pa.binary()),
                    pa.array([level[a:b][s].tobytes() for s, (_, a, b) in zip(shared, some)], pa.binary()),
                    pa.array([np.packbits(s).tobytes() for s in shared], pa.binary()),
                    pa.array([len(s).to_bytes(4, "little") for s in shared], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            whole = b.column("kind").to_numpy() == 0
            if whole.any():
                yield b.filter(pa.array(whole))
            some = b.filter(pa.array(~whole))
            for key, c, data, extra in zip(*(some.column(x).to_pylist() for x in ("key", "chunk", "data", "extra"))):
                if key != now:
                    yield from flush()
                    now = key
                held.append((c, np.frombuffer(data, "<u4"), np.frombuffer(extra, np.uint8)))
        yield from flush()

    place = F.when(F.col("kind") == 0, F.xxhash64("chunk", "key")).otherwise(F.col("key"))
    ordered = sketch.repartition(place).sortWithinPartitions("kind", "key", "chunk")
    return ordered.mapInArrow(released(work), sketch.schema)


PREFIXES = "kind int, item long, pid long, n int, pos int, alone int, doc_id long, bits binary"


def _prefixes(counted: DataFrame, range_bits: int) -> DataFrame:
    """Kind 0: a set with its group (identical prefix and size). Kind 1: a group's prefix tokens that others have. Kind 2: a document with its set (pid: the second key)."""
    rest_bits = min(48, range_bits + 32) - range_bits

    def rows(kind: int, **columns) -> pa.RecordBatch:
        n = len(columns["item"])
        arrays = []
        for name, type_ in (("item", pa.int64()), ("pid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("alone", pa.int32()), ("doc_id", pa.int64()), ("bits", pa.binary())):
            v = columns.get(name)
            arrays.append(pa.nulls(n, type_) if v is None else v.cast(type_) if isinstance(v, pa.Array) else pa.array(v, type_))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *arrays], ["kind", "item", "pid", "n", "pos", "alone", "doc_id", "bits"])

    def finish(pieces: list[dict], parts: list[dict]) -> Iterator[pa.RecordBatch]:
        whole = {c: b"".join(p[c] for p in pieces) for c in ("docs", "data", "extra", "bits")}
        docs = np.frombuffer(whole["docs"], DOC)
        ids = pa.array(docs["id"], mask=docs["null"] > 0)
        for a in range(0, len(docs), 20_000):
            d = docs[a : a + 20_000]
            yield rows(2, item=d["gid"], pid=d["check"], n=d["n"], doc_id=ids.slice(a, len(d)))
        of = np.frombuffer(whole["data"], "<u2").astype(np.int64)
        if not len(of):
            return
        sets, lead = np.unique(docs["set"], return_index=True)
        lead = lead[sets >= 0]
        n, gid = docs["n"][lead].astype(np.int64), docs["gid"][lead]
        which = np.cumsum(np.unpackbits(np.frombuffer(whole["extra"], np.uint8), count=len(of))) - 1
        mask = np.concatenate([np.unpackbits(np.frombuffer(p["docs"], np.uint8), count=int.from_bytes(p["bits"], "little")) for p in parts]).astype(bool)
        token = np.concatenate([(np.int64(p["key"]) << rest_bits) | np.frombuffer(p["data"], "<u4").astype(np.int64) for p in parts])
        level = np.concatenate([np.frombuffer(p["extra"], np.uint8) for p in parts])
        shared = np.flatnonzero(mask[which])
        at = (np.cumsum(mask) - 1)[which[shared]]
        of = of[shared]
        alone = n - np.bincount(of, minlength=len(n))
        keep = prefix_length(n) - alone
        order = _stable_order((of << 8) | level[at])
        of, token = of[order], token[at[order]]
        begin = np.searchsorted(of, np.arange(len(n)))
        pos = np.arange(len(of)) - begin[of]
        prefix = pos < keep[of]
        of, token, pos = of[prefix], token[prefix], pos[prefix]
        begin, end = np.searchsorted(of, np.arange(len(n))), np.searchsorted(of, np.arange(len(n)), "right")
        posted = np.flatnonzero(end > begin)
        if not len(posted):
            return
        # a token of this set alone makes a prefix that no other set has
        pid = gid.copy()
        for i in posted[alone[posted] == 0].tolist():
            pid[i] = set_key(np.append(token[begin[i] : end[i]], n[i]))
        bits = [whole["bits"][i * (PARITY_BITS // 8) : (i + 1) * (PARITY_BITS // 8)] for i in posted.tolist()]
        for a in range(0, len(posted), 5_000):
            p = posted[a : a + 5_000]
            yield rows(0, item=gid[p], pid=pid[p], n=n[p], alone=alone[p], doc_id=ids.take(pa.array(lead[p])), bits=bits[a : a + 5_000])
        first = np.zeros(len(n), bool)
        first[posted[np.unique(pid[posted], return_index=True)[1]]] = True
        take = np.flatnonzero(first[of])
        for a in range(0, len(take), 50_000):
            t = take[a : a + 50_000]
            yield rows(1, item=token[t], pid=pid[of[t]], n=n[of[t]], pos=pos[t] + alone[of[t]], alone=alone[of[t]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, parts = [], []
        for batch in batches:
            for b in (batch.slice(a, 64) for a in range(0, len(batch), 64)):
                for r in b.to_pylist():
                    if r["kind"] == 0 and r["key"] == 0 and pieces:
                        yield from finish(pieces, parts)
                        pieces, parts = [], []
                    (parts if r["kind"] else pieces).append(r)
        if pieces:
            yield from finish(pieces, parts)

    return counted.repartition("chunk").sortWithinPartitions("chunk", "kind", "key").mapInArrow(released(work), PREFIXES)


def _whole_sets(docs: DataFrame, k: int, seed: int, key_bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in batches:
            for b in small_batches(batch, "text", 2_000_000):
                sets = [shingles(t, k, hashed) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s, seed, key_bits) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["gid", "elements"])

    return docs.mapInArrow(released(work), "gid long, elements binary")


def _close_enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, with sizes and bitmaps) whose sets may differ by no more than similar ones do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            bits = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(len(b), -1) for c in ("bits_a", "bits_b")]
            n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1)
            yield b.filter(pa.array(apart <= n - 2 * needed(n, 0))).select(["a", "b"])

    return pairs.mapInArrow(released(work), "a long, b long")


def _similar(pairs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(released(work), "a long, b long")


def _verify(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b): first by the bitmaps, then by whole sets."""
    side = lambda s: nodes.select(F.col("gid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    near = table(_close_enough(pairs.join(side("a"), "a").join(side("b"), "b")), "near")
    of = lambda s: sets.select(F.col("gid").alias(s), F.col("elements").alias(f"set_{s}"))
    return table(_similar(near.join(of("a"), "a").join(of("b"), "b")), "links")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the edges (a, b).

    Edges are contracted until none is left: every node hooks to its smallest neighbour; two nodes that hook to each other
    (no longer ring is possible) take the smaller one as root; hooks are followed to their roots by doubling, and edges
    become edges between roots. Each root has a node besides itself, so at most half of the nodes are left, whatever their
    order along a chain. A component's smallest node always is a root, so it is the last one."""
    rest = table(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = table(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "nodes")
    labels = ends.select("node", F.col("node").alias("label"))
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "hooks")
        back = least.select(F.col("node").alias("least"), F.col("least").alias("back"))
        root = F.when(F.col("back") == F.col("node"), F.least("node", "least")).otherwise(F.col("back"))
        hooks = table(least.join(back, "least").select("node", root.alias("root")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = table(hooks.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        of = lambda s: hooks.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
        ends = rest.join(of("a"), "a").join(of("b"), "b").filter("root_a != root_b")
        rest = table(ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        new = labels.join(hooks.select(F.col("node").alias("label"), "root"), "label", "left")
        labels = table(new.select("node", F.coalesce("root", "label").alias("label")), "labels")
    return labels


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """New component labels (gid, comp) after links between members."""
    if labels is None:
        return components(links).select(F.col("node").alias("gid"), F.col("label").alias("comp"))
    of = lambda s: labels.select(F.col("gid").alias(s), F.col("comp").alias(f"comp_{s}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = joined.select("a", "b", F.coalesce("comp_a", "a").alias("x"), F.coalesce("comp_b", "b").alias("y"))
    ends = table(ends, "ends")
    moved = components(ends.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    fresh = ends.select(F.col("a").alias("gid"), F.col("x").alias("comp")).unionByName(ends.select(F.col("b").alias("gid"), F.col("y").alias("comp")))
    known = labels.unionByName(fresh).distinct()
    return table(known.join(moved.select(F.col("node").alias("comp"), "label"), "comp", "left").select("gid", F.coalesce("label", "comp").alias("comp")), "comps")


def _possible(n_a, n_b, pos_a, pos_b):
    """Column condition: the sizes and places of a shared shingle leave room for a similar pair."""
    least, rest_a, rest_b = F.least(n_a, n_b), n_a - pos_a, n_b - pos_b
    return (4 * least >= 3 * F.greatest(n_a, n_b)) & (7 * F.least(rest_a, rest_b) >= 3 * (n_a + n_b))


def _states(members: DataFrame, labels: DataFrame | None, round_no: int) -> tuple[DataFrame, DataFrame]:
    """Members with their components; per group its lowest and highest component and one member, picked by hash."""
    if labels is None:
        members = members.withColumn("comp", F.col("gid"))
    else:
        members = table(members.join(labels, "gid", "left").withColumn("comp", F.coalesce("comp", "gid")), "members")
    one = F.struct(F.xxhash64("gid", F.lit(round_no)).alias("h"), "gid", "comp")
    return members, table(members.groupBy("pid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(one).alias("one")), "groups")


def _lists(posted: DataFrame, states: DataFrame) -> DataFrame:
    """The posted groups with their states, at tokens whose groups are not all in one component."""
    lists = posted.join(states, "pid")
    mixed = lists.groupBy("token").agg(F.min("c0").alias("low"), F.max("c1").alias("high")).filter("low != high").select("token")
    return table(lists.join(table(mixed, "mixed"), "token"), "lists")  # tables, so that Spark may split a hot token's list


def _star_groups(lists: DataFrame, states: DataFrame, round_no: int) -> DataFrame:
    """Groups (pid) and a member (one) of a pivot that they meet and may be similar to, unless they are in its component.

    A list's first pivot has the fewest shingles that only it has, so it lies in the middle of near copies (from the second
    round on a few more than the fewest, to try others); its second is picked by hash. A group of several components also
    meets its own member."""
    h = F.xxhash64("pid", F.lit(round_no))
    middle = F.col("alone") + F.pmod(h, F.lit(1 + 4 * round_no))
    me = lambda order: F.struct(order.alias("order"), h.alias("h"), "pid", "n", "pos", "one")
    pivots = lists.groupBy("token").agg(F.min(me(middle)).alias("lo"), F.min(me(h)).alias("hi"))
    met = lists.join(table(pivots, "pivots"), "token")
    out = []
    for p in ("lo", "hi"):
        apart = (F.col("c0") != F.col(f"{p}.one.comp")) | (F.col("c1") != F.col(f"{p}.one.comp"))
        ok = (F.col("pid") != F.col(f"{p}.pid")) & apart & _possible(F.col("n"), F.col(f"{p}.n"), F.col("pos"), F.col(f"{p}.pos"))
        out.append(F.when(ok, F.col(f"{p}.one")))
    across = met.select("pid", F.explode(F.array_distinct(F.array_compact(F.array(*out)))).alias("one"))
    within = states.filter("c0 != c1").select("pid", "one")
    return across.unionByName(within).select("pid", "one.gid", "one.comp").toDF("pid", "one", "one_comp").distinct()


def _with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of sets from pairs of a group and a set."""
    met = pairs.join(members.select("pid", "gid", "comp"), "pid").filter("comp != one_comp")
    return met.select(F.least("gid", "one").alias("a"), F.greatest("gid", "one").alias("b")).distinct()


def _all_groups(lists: DataFrame, states: DataFrame) -> DataFrame:
    """All pairs of groups that share a prefix token, may be similar and are not in one component.

    Sizes of similar sets differ by a third at most, so a group meets those of its own band of sizes and of the next; as the
    smaller of a pair it does so only by tokens in its first seventh."""
    rest = lists.drop("one").withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    small = rest.filter("7 * (n - pos) >= 6 * n").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    left, right = small.alias("l"), rest.alias("r")
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.band") == F.col("r.band"))
    on &= (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.pid") < F.col("r.pid")))
    on &= (F.least("l.c0", "r.c0") != F.greatest("l.c1", "r.c1")) & _possible(F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos"))
    across = left.join(right, on).select(F.col("l.pid").alias("p"), F.col("r.pid").alias("q"))
    return across.unionByName(states.filter("c0 != c1").select(F.col("pid").alias("p"), F.col("pid").alias("q"))).distinct()


def _all_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    of = lambda s, p: members.select(F.col("pid").alias(p), F.col("gid").alias(s), F.col("comp").alias(f"comp_{s}"))
    met = pairs.join(of("x", "p"), "p").join(of("y", "q"), "q").filter("comp_x != comp_y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _candidates(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posted groups at tokens that others have (token, pid, n, pos, alone), and members of groups that may be similar to anything (pid, gid)."""
    posted = prefixes.filter("kind = 1").select(F.col("item").alias("token"), "pid", "n", "pos", "alone")
    shared = table(posted.groupBy("token").agg(F.min("pid").alias("p0"), F.max("pid").alias("p1")).filter("p0 != p1").select("token"), "shared")
    posted = table(posted.join(shared, "token").distinct(), "posted")
    members = prefixes.filter("kind = 0").select("pid", F.col("item").alias("gid")).distinct()
    several = members.groupBy("pid").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("pid")
    return posted, table(members.join(posted.select("pid").unionByName(several).distinct(), "pid"), "members")


def links_of(prefixes: DataFrame, rows: DataFrame, k: int, star_rounds: int, seed: int, key_bits: int) -> DataFrame | None:
    """Component labels (gid, comp) of the sets that have a similar one; None if there are none."""
    posted, members = _candidates(prefixes)
    own = prefixes.filter("kind = 0").select(F.col("item").alias("gid"), "doc_id", "n", "bits")
    least = own.groupBy("gid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = table(least.join(members.select("gid").distinct(), "gid"), "nodes")
    n_nodes = nodes.count()
    if not n_nodes:
        return None
    # a null id doesn't tell the row, so those rows all come along
    some = maybe_in(rows.filter("doc_id is not null"), nodes, "doc_id", n_nodes).unionByName(rows.filter("doc_id is null"))
    sets = maybe_in(_whole_sets(some, k, seed, key_bits), nodes, "gid", n_nodes).dropDuplicates(["gid"])
    sets = table(sets.join(nodes.select("gid"), "gid", "left_semi"), "sets")
    labels = None
    for round_no in range(star_rounds):
        own, states = _states(members, labels, round_no)
        posted = _lists(posted.select("token", "pid", "n", "pos", "alone"), states)  # components only grow, so other lists are done with
        links = _verify(_with_members(_star_groups(posted, states, round_no), own), nodes, sets)
        if links.isEmpty():
            break
        labels = _merge(labels, links)
    own, states = _states(members, labels, star_rounds)
    lists = _lists(posted.select("token", "pid", "n", "pos", "alone"), states)
    links = _verify(_all_members(_all_groups(lists, states), own), nodes, sets)
    return labels if links.isEmpty() else _merge(labels, links)


def similar_components(docs: DataFrame, k: int = 5, star_rounds: int = 4, chunk: int = 1 << 20, key_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6).bit_length()  # of the number of shingles, about
    range_bits = min(20, max(8, size - 22))
    for seed in range(64):
        found = table(_prefixes(_count_ranges(_sketch(rows, k, range_bits, 2 * seed, key_bits, chunk)), range_bits), "prefixes")
        keyed = found.filter("kind = 2").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("item").alias("gid"), F.col("pid").alias("check"))
        if keyed.groupBy("gid").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).filter("c0 != c1").isEmpty():
            break
    else:
        raise RuntimeError("no keys tell all sets apart")
    labels = links_of(found, rows, k, star_rounds, 2 * seed, key_bits)
    keyed = keyed.drop("check")
    keyed = keyed.join(labels, "gid", "left") if labels is not None else keyed.withColumn("comp", F.lit(None).cast("long"))
    keyed = keyed.withColumn("comp", F.coalesce("comp", "gid"))
    least = keyed.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("first"))
    linked = keyed.filter("n_shingles > 0").join(table(least, "least"), "comp")  # a table, so that Spark may split a hot component
    linked = linked.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
    return linked.unionByName(keyed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which no similar document has a smaller id."""
    others = similar_components(docs, id_col=id_col, text_col=text_col).filter("component_id != doc_id")
    return without_ids(docs, others.select("doc_id").distinct(), id_col)
