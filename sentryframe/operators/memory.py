"""Attack memory: normalised vectors, nearest known attack, variant screen, unlearning, and the calibrated threshold."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..checkpoints import cut, shared_path
from ..config import Calibration
from ..functions.decisions import normalized, rounded

BLOCK_ROWS = 20_000


def remember(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory and new rows (idx, text, embedding), embeddings normalised; duplicates are allowed."""
    return memory.unionByName(new.select("idx", "text", normalized(F.col("embedding")).alias("embedding")))


def nearest(queries: DataFrame, memory: DataFrame, key: str = "id", block_rows: int | None = None) -> DataFrame:
    """key, similarity and text of the most similar memory entry (the smallest idx on ties); (0.0, null) without memory or vector.

    Exact. A memory of one block (block_rows entries) is sent to the tasks as one matrix. A larger one is indexed in the shared
    folder, see build_index, and a query visits blocks by bound until no other can win."""
    block_rows = block_rows or BLOCK_ROWS
    if memory.count() <= block_rows:
        schema = StructType([queries.schema[key], *_FOUND])
        q, m = queries.select(key, "embedding"), memory.select("idx", "text", "embedding")
        best = q.mapInArrow(_best_of(q.sparkSession, sorted(m.limit(block_rows).collect(), key=lambda e: (e[0], e[1] is not None, e[1])), key), schema)
    else:
        best = search(queries, build_index(memory, block_rows), key)
    return best.select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "text")


_FOUND = [StructField("similarity", DoubleType()), StructField("idx", LongType()), StructField("text", StringType())]
SLICE = 256  # queries that meet a matrix at once
CELLS = 4_000_000  # similarities that a screen holds at once
CACHE_BYTES = 64 << 20  # blocks that a screening task keeps


@dataclass
class Index:
    """Pivots (a row each), the least and greatest distance of an entry from each, its number of blocks, and their folder."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray
    folder: str
    apart: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        apart = np.sqrt(np.maximum(2 - 2 * (self.pivots @ self.pivots.T), 0))
        self.apart = np.where(apart < 1e-6, np.inf, apart)  # no bound from pivots that are the same but for rounding

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """How near to each of some unit vectors an entry of each pivot can be: by the triangle inequality, and beyond the plane
        between the pivot and the vector's nearest one, on whose other side the pivot's entries are."""
        near = v @ self.pivots.T
        d, first = np.sqrt(np.maximum(2 - 2 * near, 0)), near.argmax(1)
        plane = (near[np.arange(len(v)), first][:, None] - near) / self.apart[first]
        return np.maximum(np.maximum(d - self.high, self.low - d), np.maximum(plane, 0))


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _file(folder: str, pivot: int, block: int) -> str:
    return f"{folder}/pivot-{pivot:05d}-{block:06d}.arrow"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(uri, safe=":/@?&=+,"))


def build_index(memory: DataFrame, block_rows: int = BLOCK_ROWS, max_pivots: int = 1_024, fine: bool = False) -> Index:
    """Entries by their nearest pivot, in blocks of about block_rows in the shared folder; fine: with as many pivots as entries of one.

    Pivots are entries picked by a hash, at most max_pivots, so what the driver and the tasks hold of the index is bounded. Of
    entries with equal vectors only the smallest idx can be an answer and is kept, so copies fill no block."""
    spark = memory.sparkSession
    best = memory.select("embedding", F.struct("idx", "text").alias("e")).groupBy("embedding").agg(F.min("e").alias("e"))
    rows = cut(best.select("e.idx", "e.text", "embedding"))
    n = rows.count()
    k = max(1, min(max_pivots, max(4 * -(-n // block_rows), math.isqrt(n) if fine else 0)))
    pivots = _unit([r.embedding for r in rows.select("idx", "embedding").orderBy(F.xxhash64("idx"), "idx").limit(k).collect()])
    sent, folder = spark.sparkContext.broadcast(pivots), shared_path(spark, "memory-index")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                near = _unit(b.column("embedding").to_pylist()) @ sent.value.T
                at = near.argmax(1)
                d = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(b)), at], 0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d)], ["idx", "text", "embedding", "pivot", "d"])

    dealt = cut(rows.mapInArrow(assign, "idx long, text string, embedding array<double>, pivot int, d double"))
    sums = dealt.groupBy("pivot").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).collect()  # a row a pivot
    index = Index(pivots, np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k, np.int64), folder)
    for r in sums:
        index.low[r.pivot], index.high[r.pivot], index.blocks[r.pivot] = r.low, r.high, -(-r.n // block_rows)
    of_pivot = F.array(*[F.lit(int(x)) for x in index.blocks])
    blocks = dealt.withColumn("block", F.pmod(F.xxhash64("idx"), F.element_at(of_pivot, F.col("pivot") + 1)))

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by([("idx", "ascending")])
        pivot, block = t.column("pivot")[0].as_py(), t.column("block")[0].as_py()
        system, path = _file_system(_file(folder, pivot, block))
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(part) as out, pa.ipc.new_file(out, t.select(["idx", "text", "embedding"]).schema) as w:
            w.write_table(t.select(["idx", "text", "embedding"]))
        system.move(part, path)  # a repeated attempt replaces it whole
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "n": pa.array([len(t)], pa.int64())})

    blocks.groupBy("pivot", "block").applyInArrow(write, "pivot int, n long").agg(F.sum("n")).collect()
    return index


def _read_block(folder: str, pivot: int, block: int) -> tuple[np.ndarray, np.ndarray, list]:
    system, path = _file_system(_file(folder, pivot, block))
    with system.open_input_file(path) as f:
        t = pa.ipc.open_file(f).read_all()
    return _flat(t.column("embedding").combine_chunks()), t.column("idx").to_numpy(), t.column("text").to_pylist()


def _flat(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers, none null, as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def search(queries: DataFrame, index: Index, key: str = "id", per_task: int = 50_000) -> DataFrame:
    """key, similarity, idx, text and visited (the number of pivots whose blocks were read) of every query.

    Round by round a query visits its next pivots in order of their bounds, 1, 4, 16 and so on, and stops when the next bound
    is beyond the best distance so far. Queries meet blocks by (pivot, block) and a hash of the query, so that pivots which
    many visit are many tasks; a task holds one block and SLICE queries at a time."""
    sent = queries.sparkSession.sparkContext.broadcast(index)
    asked = queries.select(key, F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("visited"))
    result = [key, "similarity", "idx", "text", "visited"]
    found = asked.filter("embedding is null").select(result)
    open_ = cut(asked.filter("embedding is not null").withColumn("q_row", F.monotonically_increasing_id()))  # keys may recur, rows don't
    salts = max(1, -(-open_.count() // per_task))
    plan = StructType([*open_.schema.fields, StructField("next", ArrayType(IntegerType()))])

    def planner(step: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            for batch in batches:
                for b in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                    if not len(b):
                        continue
                    bounds = x.bounds(_unit(b.column("embedding").to_pylist()))
                    order = np.lexsort((np.broadcast_to(np.arange(bounds.shape[1]), bounds.shape), bounds), axis=1)
                    best, seen = b.column("similarity").to_pylist(), b.column("visited").to_pylist()
                    nexts = []
                    for i, (s, v) in enumerate(zip(best, seen)):
                        most = np.inf if s is None else np.sqrt(max(2 - 2 * s, 0)) + 2e-6  # a tie in 12 digits may lie as far
                        some = order[i, v : v + step]
                        nexts.append([int(p) for p in some if bounds[i, p] <= most and x.blocks[p]])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nexts, pa.list_(pa.int32()))], [*b.schema.names, "next"])

        return work

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for b in batches:
            places = np.stack([b.column("pivot").to_numpy(), b.column("block").to_numpy()], 1)
            edges = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1).tolist(), len(b)]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    if (at := tuple(places[i].tolist())) != now:
                        now, block = at, _read_block(sent.value.folder, *at)
                    for k in range(i, j, SLICE):
                        yield pa.RecordBatch.from_arrays(_top(b.slice(k, min(SLICE, j - k)), "q_row", *block), ["q_row", "similarity", "idx", "text"])

    step = 1
    while True:
        planned = cut(open_.mapInArrow(planner(step), plan))
        found, going = found.unionByName(planned.filter("size(next) = 0").select(result)), planned.filter("size(next) > 0")
        if going.isEmpty():
            return found
        counts = F.array(*[F.lit(int(x)) for x in index.blocks])
        visits = going.select("q_row", "embedding", F.explode("next").alias("pivot")).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(counts, F.col("pivot") + 1) - 1)))
        dealt = visits.repartition("pivot", "block", F.pmod(F.xxhash64("q_row"), F.lit(salts))).sortWithinPartitions("pivot", "block")
        tops = dealt.mapInArrow(visit, StructType([StructField("q_row", LongType()), *_FOUND]))
        best = tops.groupBy("q_row").agg(F.max_by(F.struct("similarity", "idx", "text"), F.struct("similarity", -F.col("idx"))).alias("top"))
        better = F.col("similarity").isNull() | (F.struct(F.col("top.similarity"), -F.col("top.idx")) > F.struct("similarity", -F.col("idx")))
        met = going.join(best, "q_row").withColumn("now", F.when(better, F.col("top")).otherwise(F.struct("similarity", "idx", "text")))
        open_ = cut(met.select(key, "embedding", "now.similarity", "now.idx", "now.text", (F.col("visited") + F.size("next")).alias("visited"), "q_row"))
        step *= 4


def _matrix(entries: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Vectors, ids and texts of (idx, text, embedding) rows."""
    return np.array([e[2] for e in entries], np.float64), np.array([e[0] for e in entries], np.int64), [e[1] for e in entries]


def _top(b: pa.RecordBatch, key: str, matrix: np.ndarray, idx: np.ndarray, texts: list) -> list[pa.Array]:
    """The keys of a batch and each one's best entry: similarity, idx and text."""
    vectors = b.column("embedding").to_pylist()
    have = [i for i, v in enumerate(vectors) if v is not None and len(idx)]
    similarity, at = np.zeros(len(b)), np.full(len(b), -1)
    if have:
        scores = np.round(_unit([vectors[i] for i in have]) @ matrix.T, 12)
        at[have] = scores.argmax(1)
        similarity[have] = scores.max(1)
    found = at >= 0
    return [b.column(key), pa.array(similarity, mask=~found), pa.array(idx[at] if len(idx) else at, pa.int64(), mask=~found), pa.array([texts[i] if i >= 0 else None for i in at.tolist()], pa.string())]


def _best_of(spark: SparkSession, entries: list, key: str):
    sent = spark.sparkContext.broadcast(_matrix(entries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                yield pa.RecordBatch.from_arrays(_top(b, key, *sent.value), [key, "similarity", "idx", "text"])

    return work


def screener(memory: DataFrame, threshold: float, block_rows: int | None = None) -> Callable[[Column], Column]:
    """A function of an embedding column: whether some entry of memory (idx, embedding) has that similarity, to 12 digits. It is 0.0
    without memory or vector.

    It is evaluated where the rows are, so that they need no shuffle or join. A memory of one block is sent to the tasks. A larger one
    is indexed in the shared folder, from which a task reads, once for each of its batches, the blocks that may hold an entry near
    enough to a row that has none yet, the nearest pivots' blocks first."""
    spark, block_rows = memory.sparkSession, block_rows or BLOCK_ROWS
    entries = memory.select("idx", F.lit(None).cast("string").alias("text"), "embedding")
    n = entries.count()
    if n <= block_rows:
        rows = [r.embedding for r in entries.select("embedding").limit(block_rows).collect()]
        sent = spark.sparkContext.broadcast(np.array(rows, np.float64) if rows else None)
    else:
        sent = spark.sparkContext.broadcast(build_index(entries, block_rows, fine=True))

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[tuple[int, int], np.ndarray] = {}

        def read(pivot: int, block: int) -> np.ndarray:
            if (found := kept.pop((pivot, block), None)) is None:
                found = _read_block(sent.value.folder, pivot, block)[0]
                while kept and sum(m.nbytes for m in kept.values()) + found.nbytes > CACHE_BYTES:
                    del kept[next(iter(kept))]  # the one that was used longest ago
            kept[pivot, block] = found
            return found

        for b in batches:
            out, have, x = np.full(len(b), 0.0 >= threshold), np.flatnonzero(b.is_valid().to_numpy(zero_copy_only=False)), sent.value
            if len(have) and x is not None:
                v = _flat(b.drop_null())
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                out[have] = _reaches(v, np.arange(len(v)), x, threshold) if isinstance(x, np.ndarray) else _reaches_any(v, x, threshold, read)
            yield pa.array(out)

    return known


def _reaches(v: np.ndarray, rows: np.ndarray, matrix: np.ndarray, threshold: float) -> np.ndarray:
    """Whether these rows of v have that similarity with an entry of the matrix."""
    per = max(1, CELLS // len(matrix))
    return np.concatenate([np.round((v[rows[i : i + per]] @ matrix.T).max(1), 12) >= threshold for i in range(0, len(rows), per)])


def _reaches_any(v: np.ndarray, index: Index, threshold: float, read: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """Whether unit vectors have that similarity with an entry of the index. A block is read for those that its pivot's bound
    leaves open and for which no entry was found before."""
    known, first = np.zeros(len(v), bool), np.empty(len(v), np.int64)
    near, reach = np.empty((len(v), len(index.pivots)), bool), np.sqrt(max(2 - 2 * threshold, 0)) + 2e-6  # a tie in 12 digits may lie as far
    for i in range(0, len(v), SLICE):
        part = v[i : i + SLICE]
        near[i : i + SLICE], first[i : i + SLICE] = (index.bounds(part) <= reach) & (index.blocks > 0), (part @ index.pivots.T).argmax(1)
    for own in (True, False):
        for p in np.flatnonzero(near.any(0)).tolist():
            asked = near[:, p] & ((first == p) == own)
            for block in range(int(index.blocks[p])):
                if len(rows := np.flatnonzero(asked & ~known)):
                    matrix = read(p, block)
                    known[rows] = _reaches(v, rows, matrix, threshold) if len(matrix) else False
    return known


def screen(queries: DataFrame, memory: DataFrame, threshold: float = 0.9, key: str = "id", digits: int | None = None) -> DataFrame:
    """Adds known: whether the nearest entry's similarity, rounded to so many digits if given, reaches the threshold."""
    similarity = F.col("similarity") if digits is None else rounded(F.col("similarity"), digits)
    return nearest(queries, memory, key).withColumn("known", similarity >= threshold)


def unlearn(memory: DataFrame, texts: DataFrame) -> DataFrame:
    """memory without entries whose text is in texts, whoever added them."""
    return memory.join(texts.select("text").distinct(), "text", "left_anti")


def removed_count(memory: DataFrame, texts: DataFrame) -> DataFrame:
    return memory.join(texts.select("text").distinct(), "text", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def step(threshold: Column, score: Column, malicious: Column, c: Calibration = Calibration()) -> Column:
    """The threshold after one confirmed outcome: it moves toward the score on errors only, within its bounds."""
    pulled = F.when(malicious, F.least(score, threshold)).otherwise(F.greatest(score, threshold))
    return F.greatest(F.lit(c.low), F.least(F.lit(c.high), threshold * c.decay + (1 - c.decay) * pulled))


def calibrate(outcomes: DataFrame, c: Calibration = Calibration(), key: str = "key") -> DataFrame:
    """Final threshold and number of outcomes per key. outcomes: key, seq, score, malicious.

    The fold depends on order and is serial, but not held in memory: a task reads its keys sorted by seq and keeps one
    threshold. A null score moves nothing; equal seqs count in order of score and malicious."""
    kind = outcomes.schema[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, t, n = None, c.start, 0

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], type_), pa.array([x[1] for x in done], pa.float64()), pa.array([x[2] for x in done], pa.int64())], [key, "threshold", "n_outcomes"])

        for b in batches:
            type_, done = b.column(key).type, []
            for k, s, bad in zip(*(b.column(x).to_pylist() for x in (key, "score", "malicious"))):
                if n and k != now:
                    done.append((now, t, n))
                    t, n = c.start, 0
                now, n = k, n + 1
                if s is not None:
                    t = max(c.low, min(c.high, t * c.decay + (1 - c.decay) * (min(s, t) if bad else max(s, t))))
            yield rows(done)
        if n:
            yield rows([(now, t, n)])

    ordered = outcomes.select(key, "seq", F.col("score").cast("double").alias("score"), "malicious").repartition(key).sortWithinPartitions(key, "seq", "score", "malicious")
    schema = StructType([kind, StructField("threshold", DoubleType()), StructField("n_outcomes", LongType())])
    return ordered.select(key, "score", "malicious").mapInArrow(work, schema)


def restore(history: DataFrame, starts: DataFrame, default: float = 0.5) -> DataFrame:
    """The threshold as it was before each session: history (key, seq, threshold), starts (key, start_seq).

    One sort of starts and history per key; a start comes before a row with the same seq. The last row counts, even if null."""
    rows = history.filter("key is not null and seq is not null").select("key", "seq", F.lit(1).alias("kind"), F.struct("threshold").alias("last"))
    asked = starts.select("key", F.col("start_seq").alias("seq"), F.lit(0).alias("kind")).distinct().withColumn("last", F.lit(None).cast(rows.schema["last"].dataType))
    w = Window.partitionBy("key").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asked.unionByName(rows).withColumn("seen", F.last("last", ignorenulls=True).over(w)).filter("kind = 0")
    return seen.select("key", F.col("seq").alias("start_seq"), F.coalesce("seen.threshold", F.lit(default)).alias("threshold"))
