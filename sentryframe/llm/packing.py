"""Best-fit packing in rounds: partitions pack their own pieces, nearly full bins are done, the rest meet in fewer partitions.

Round 0 encodes the texts, cuts those over the limit and best-fits the pieces of each input partition, longest first. Bins
with at most `slack` free places are emitted. The others are items of the next round: they are dealt by hash to a fraction
of the partitions, best-fitted as wholes, and so on until a round saves less than one bin in two hundred. A task holds at
most `items_per_task` items, so rounds never end in one large task. A bin carries its pieces (no more than the limit).

Cases: null text is empty (one end id); a text of more than `limit` ids is cut into pieces of `limit`, the first piece
taking what is left over; rows with equal ids are packed each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .encoding import encoder, settle, small_batches

PIECE = "struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long,offset:int>"
BIN = f"bin long, fill int, done boolean, pieces array<{PIECE}>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32())])


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """Bin of each item, longest first, each into the fullest bin that still takes it. A bit mask finds that bin."""
    where, free, mask, n = np.empty(len(sizes), np.int64), [[] for _ in range(limit + 1)], 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = limit, n, n + 1
        where[i] = b
        left = room - s
        if left:
            free[left].append(b)
            mask |= 1 << left
    return where, n


def first_id(round_no: int, partition: int) -> int:
    """The first bin number of a task: the round in the highest bits, 24 bits for the partition, 34 for its bins."""
    if not (0 <= partition < 1 << 24 and 0 <= round_no < 32):
        raise ValueError("more partitions or rounds than bin numbers can tell apart")
    return round_no << 58 | partition << 34


def _emit(sizes: np.ndarray, counts: np.ndarray, pieces: pa.Array, limit: int, slack: int, first: int) -> tuple[pa.RecordBatch, int]:
    """Packs items (each with `counts` pieces in a row) and gives one row per bin."""
    where, n = best_fit(sizes, limit)
    order = np.argsort(where, kind="stable")
    fill = np.bincount(where, sizes, n).astype(np.int32)
    begins, n_of = np.cumsum(counts) - counts, counts[order]
    take = np.repeat(begins[order] - (np.cumsum(n_of) - n_of), n_of) + np.arange(n_of.sum())
    offsets = np.append(0, np.cumsum(np.bincount(where, counts, n))).astype(np.int32)
    fields = dict(zip(pieces.type.names, pieces.take(pa.array(take)).flatten()))
    length = fields["length"].to_numpy().astype(np.int64)
    before = np.cumsum(length) - length
    fields["offset"] = pa.array((before - np.repeat(before[offsets[:-1]], np.diff(offsets))).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), fields=list(_PIECE)))
    names = ["bin", "fill", "done", "pieces"]
    return pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), pa.array(fill), pa.array(fill >= limit - slack), lists], names), n


def cut(at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of each piece of documents with these offsets; the first piece takes what is left over."""
    size = np.diff(at)
    n = -(-size // limit)
    row = np.repeat(np.arange(len(size)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lead = size[row] - (n[row] - 1) * limit
    start = np.where(number == 0, 0, lead + (number - 1) * limit)
    return row, number, start, np.where(number == 0, lead, limit)


def _first_round(docs: DataFrame, tokenizer_path: str, limit: int, slack: int, end_id: int, per_task: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first, held, n_held = encoder(tokenizer_path), first_id(0, TaskContext.get().partitionId()), [], 0

        def flush():
            nonlocal first, held, n_held
            if held:
                sizes = np.concatenate([h.field("length").to_numpy() for h in held]).astype(np.int64)
                out, n = _emit(sizes, np.ones(len(sizes), np.int64), pa.concat_arrays(held), limit, slack, first)
                first, held, n_held = first + n, [], 0
                yield from (out.slice(k, 20_000) for k in range(0, len(out), 20_000))

        for batch in batches:
            for b in small_batches(batch, "text", 500_000):
                ids, at = enc.encode(b.column("text"), end_id)
                row, number, start, length = cut(at, limit)
                raw, begin = memoryview(np.ascontiguousarray(ids)).cast("B"), at[row] + start
                crc = [zlib.crc32(raw[i * 4 : j * 4]) for i, j in zip(begin.tolist(), (begin + length).tolist())]
                held.append(pa.StructArray.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.zeros(len(row), np.int32))], fields=list(_PIECE)))
                n_held += len(row)
                if n_held >= per_task:
                    yield from flush()
        yield from flush()
        settle()

    return docs.mapInArrow(work, BIN)


def _next_round(bins: DataFrame, parts: int, round_no: int, limit: int, slack: int, per_task: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n_held = first_id(round_no, TaskContext.get().partitionId()), [], 0

        def flush():
            nonlocal first, held, n_held
            if held:
                lists = pa.concat_arrays([h.column("pieces") for h in held])
                sizes = np.concatenate([h.column("fill").to_numpy() for h in held]).astype(np.int64)
                out, n = _emit(sizes, np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten(), limit, slack, first)
                first, held, n_held = first + n, [], 0
                yield out

        for b in batches:
            held.append(b)
            n_held += len(b)
            if n_held >= 2 * per_task:
                yield from flush()
        yield from flush()

    return bins.select("bin", "fill", "pieces").repartition(parts, F.xxhash64("bin")).mapInArrow(work, BIN)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, slack: int = 8, items_per_task: int = 100_000, merge: int = 8, max_rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done, bins = [], table(_first_round(rows, tokenizer_path, limit, slack, end_id, items_per_task), "bins")
    parts, last = 0, 0
    for round_no in range(1, max_rounds + 1):
        left = bins.filter("not done")
        n = left.count()
        least = -(-n // items_per_task)
        if n < 2 or (parts == least and n > 0.995 * last):
            break
        done.append(bins.filter("done"))
        parts = max(least, parts // merge if parts else min(merge * rows.sparkSession.sparkContext.defaultParallelism, -(-n // 500)))
        last, bins = n, table(_next_round(left, parts, round_no, limit, slack, items_per_task), "bins")
    whole = bins
    for d in done:
        whole = whole.unionByName(d)
    flat = whole.select(F.col("bin").alias("sequence_id"), F.explode("pieces").alias("p"))
    return flat.select("p.doc_id", "p.piece", "p.start", F.col("p.length").cast("long").alias("length"), "p.ids_crc32", "sequence_id", F.col("p.offset").cast("long").alias("offset"))
