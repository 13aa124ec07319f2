"""Encoding, token files, packing and token counts against plain use of the tokenizer."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sentryframe.llm import packing, queries, token_counts, token_files
from sentryframe.llm.common import fresh_path
from sentryframe.llm.encoding import Encoder

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", None, "  ", " a", "a  b", "a \n b", "\n\n x  \t y ", "foo<|endoftext|> bar", "a　 b", "\x1c \x1d a", "é ñ  ß\r\n don't  we'll", "x" * 3000, "日本 語", "🙂 🙂  a🙂b", "word,word. word%%%\nword"]
DOCS = "doc_id long, text string, tokens int, part int, gone string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta,", "gamma.", "\n", "  ", "délta", "x1", "%%%"]
    rows = [(i, t, 1, 2, "g") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.choice([1, 20, 300, 3000]))), None, None, None) for i in range(80)]
    rows += [(None, "no id", 1, 1, ""), (105, "same id", 1, 1, ""), (105, "same id", 1, 1, "")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(plain):
    rng = random.Random(1)
    parts = ["ab", "\n", "word", "%%%", ",", ":", "'", "'re", "[", "E", " ", "  ", "a", "b1", "é", "<|endoftext|>", "\x0b", ".", "🙂", "\x1f", "​", "½"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(4000)]
    enc = Encoder(PATH, max_cached=500)
    for k in range(0, len(texts), 700):
        ids, at = enc.encode(pa.array(texts[k : k + 700], pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [plain(t) for t in texts[k : k + 700]]


def test_encoder_keeps_the_common_pieces_of_an_open_vocabulary():
    """Rare words are ever new; common ones are encoded once or twice, not again whenever the room is full."""
    enc, sent, plain_ids = Encoder(PATH, max_cached=1000), [], Encoder._ids
    enc._ids = lambda text: (sent.append(text), plain_ids(enc, text))[1]
    common, n = [f"common{i}" for i in range(300)], 40
    for k in range(n):
        enc.encode(pa.array([" ".join([*common, *(f"rare{k}x{i}" for i in range(200))])] * 2))
    words = " ".join(sent).split()
    assert sum(w.startswith("rare") for w in words) >= 200 * n
    assert sum(w.startswith("common") for w in words) <= 2 * len(common)


def test_encoder_tells_pieces_apart(plain):
    """Trailing zero bytes, pieces that agree in 32 bytes, the longest kept and the shortest other, a batch beyond the room, no texts."""
    texts = ["a", "a\0", "a\0\0", " a", " a\0", "x" * 31, "x" * 32, "x" * 33, "x" * 32 + "y", "x" * 32 + "z", "\0", "\0" * 8, "é" * 16, "é" * 17, *(f"w{i} w{i}" for i in range(60))]
    for most in (1, 8, 1000):
        enc = Encoder(PATH, max_cached=most)
        for some in (texts, texts[::-1], [], [None, ""], texts):
            ids, at = enc.encode(pa.array(some, pa.string()))
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [plain(t) for t in some]
            ids, at = enc.encode(pa.array(some, pa.string()), None)
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [plain(t)[:-1] for t in some]


def test_token_files(spark, docs, plain):
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, path, PATH, page_rows=10)
    got = sorted(map(tuple, token_files.token_digests(token_files.read_token_files(spark, path)).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = plain(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert token_files.read_index(spark, path).count() == len(rows)


def test_token_files_have_the_chosen_layout(spark, docs):
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs.coalesce(1), path, PATH, page_rows=10)
    meta = pq.ParquetFile(max(glob.glob(path.removeprefix("file://") + "/*.parquet"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["local_start"].encodings
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    plan = token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_token_files_of_no_rows(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame([], DOCS), path, PATH)
    assert token_files.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("limit", [64, 2048])
def test_packing(spark, docs, plain, limit):
    rows = packing.pack(docs, PATH, limit=limit, items_per_task=40).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= limit
    want = []
    for d in docs.collect():
        ids = plain(d.text)
        lead = len(ids) - (-(-len(ids) // limit) - 1) * limit
        cuts = [0, *range(lead, len(ids) + 1, limit)]
        want += [(d.doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    order = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    least = -(-sum(w[3] for w in want) // limit)
    assert len(bins) <= 1.1 * least + 3


def test_packing_of_large_items_ends(spark, docs):
    """Items over half the limit never pair up; the rounds must still end."""
    big = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text"))
    assert packing.pack(big, PATH, limit=60, items_per_task=50).select("sequence_id").distinct().count() == 300
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_bin_numbers_of_rounds_and_partitions_never_meet():
    first = [packing.first_id(r, p) for r in range(13) for p in (0, 1, 65_535, 65_536, 65_537, (1 << 24) - 1)]
    assert all(b - a >= 1 << 34 for a, b in zip(first, first[1:])) and first[-1] + (1 << 34) < 1 << 63
    with pytest.raises(ValueError):
        packing.first_id(0, 1 << 24)


def test_best_fit():
    where, n = packing.best_fit(np.array([5, 4, 3, 3, 2, 1]), 6)
    fill = np.bincount(where, [5, 4, 3, 3, 2, 1])
    assert n == 3 and sorted(fill) == [6, 6, 6]


@pytest.mark.parametrize("block", [10, 64, 1 << 20])
def test_token_counts(spark, docs, plain, block):
    folder = fresh_path(spark, "flat")
    listed = token_counts.write_flat(docs, folder, PATH, 50256)
    counts = token_counts.count_tokens(spark, folder, 50256, block_bytes=block, run_blocks=3).withColumn("shard", token_counts.shard_of(F.col("path")))
    assert counts.filter("not closed").count() == 0
    got = sorted((str(r.doc_id), r.n_tokens) for r in listed.join(counts, ["shard", "doc_no"]).collect())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = [(str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect()]
    assert got == sorted(want)


def test_token_counts_of_no_rows(spark, docs):
    folder = fresh_path(spark, "flat")
    assert token_counts.write_flat(docs.limit(0), folder, PATH, 50256).count() == 0
    assert token_counts.count_tokens(spark, folder, 50256).count() == 0


def test_op7_query_counts_every_document(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_tokens, r.closed) for r in queries.op7_token_counts(spark, sf_dir).collect())
    assert got == sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1, True) for r in texts)


def test_token_counts_of_an_unclosed_file(spark, tmp_path):
    for name, ids in (("a.bin", [1, 2, 9, 9, 3]), ("b.bin", []), ("c.bin", [4, 4, 4, 4, 4, 9])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    rows = token_counts.count_tokens(spark, f"file://{tmp_path}", 9, block_bytes=4).collect()
    assert sorted((r.path[-5:], r.doc_no, r.start, r.n_tokens, r.closed) for r in rows) == [("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 4, 1, False), ("c.bin", 0, 0, 6, True)]
