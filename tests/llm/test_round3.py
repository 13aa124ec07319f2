"""Quality, Merkle manifest and fill-in-middle against brute force, with their edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentryframe.llm import fill_middle as fim
from sentryframe.llm import merkle, quality, queries
from sentryframe.llm.encoding import text_bytes
from tests.test_catalog import rows

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_fill_middle"])
def test_queries_match_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df, r = queries.QUERIES[name](spark, sf_dir), c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())


# ---- Merkle manifest ----
def brute_manifest(docs, fanout=8):
    """(doc_id, leaf) to (subroot, root, proof, folded root), by plain recursion over lists; docs: doc_id, text, lang, source, n_chars."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: H(*map(field, (d[0], d[3], d[2], d[4], t)))

    def tree(hashes):
        """The root, and for each leaf its steps: (left, right) hashes."""
        steps, level, owner = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
        while len(level) > 1:
            up, own = [], []
            for k in range(0, len(level), fanout):
                run = level[k : k + fanout]
                for j, _ in enumerate(run):
                    for i in owner[k + j]:
                        steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(H(*run))
                own.append([i for o in owner[k : k + fanout] for i in o])
            level, owner = up, own
        return level[0], steps

    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d, leaf(d, d[1])))
    if not docs:
        return []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (d, h), own in zip(groups[g], trees[g][1]):
            steps = own + top
            t = d[1]
            if t is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            x = leaf(d, t)
            for a, b in steps:
                x = H(a, x, b)
            out.append((d[0], h, trees[g][0], root, H(*[a + b for a, b in steps]), x, x == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, hash string, n int, grp string, root string, proof string, up long"
EXTRA = (7, "h", 1, "g", "r", "p", 2)


def manifest_rows(spark, docs):
    df = merkle.manifest(merkle.document_rows(spark.createDataFrame([(*d, *EXTRA) for d in docs], SCHEMA)))
    cols = ["key", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), (f := merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))), f == F.col("root")]
    return [tuple(r) for r in df.select(cols).collect()]


def test_manifest_equals_brute_force(spark):
    """Groups of 1, 8, 9, 65 and 600 rows and a null one; nulls in every column, empty and long texts, repeated rows and ids."""
    rng, docs, i = random.Random(3), [], 0
    for lang, n in ((None, 9), ("", 1), ("a", 8), ("é", 65), ("b", 600), ("z", 1)):
        for _ in range(n):
            i += rng.randrange(1, 3)
            docs.append((i, rng.choice([None, "", "Ab C", "É ß", "X" * 50_000 if i % 50 == 0 else "x"]), lang, rng.choice([None, "s"]), rng.choice([None, 3])))
    docs += [(None, "Q", "a", None, None), (5, "one", "b", "s", 1), (5, "two", "b", "s", 1), (5, "two", "b", "s", 1)]
    key = lambda r: tuple(map(str, r))
    got = sorted(manifest_rows(spark, docs), key=key)
    assert got == sorted(brute_manifest(docs), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("docs", [[], [(1, "A", "x", None, None)], [(1, "A", "x", None, None), (2, "B", "y", "s", 1)]])
def test_manifest_of_few_rows(spark, docs):
    assert sorted(manifest_rows(spark, docs)) == sorted(brute_manifest(docs))


def test_manifest_of_many_groups(spark):
    """More groups than one run of the tree over their roots."""
    docs = [(i, "T", f"g{i % 75}", None, None) for i in range(300)]
    assert sorted(manifest_rows(spark, docs)) == sorted(brute_manifest(docs))


def test_numbers_are_spread(spark):
    """A group that holds all rows is numbered in several tasks."""
    rows_ = spark.range(20_000).select(F.lit("=g").alias("grp"), (F.col("id") * 7919 % 20_011).alias("key"))
    got = merkle.number(rows_, ["key"])
    assert [r.idx for r in got.orderBy("key").collect()] == list(range(20_000))
    assert {r.n for r in got.select("n").distinct().collect()} == {20_000}


# ---- fill in the middle ----
def brute_fim(doc_id, text):
    text = text or ""
    h = [int(H(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, H(text), H(text)
    p, m, s = text[:a], text[a:b], text[b:]
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h[3] % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return doc_id, n, form, a, b - a, H(out), H(text)


def test_fill_middle_equals_brute_force(spark):
    rng = random.Random(5)
    some = ["a", "Z", " ", "\n", "é", "漢", "🦆", ".", "<", "P", "S", ">", "́", "\x00"]
    texts = ["".join(rng.choices(some, k=rng.randrange(0, 90))) for _ in range(600)]
    texts += [None, "", "has <S> in it", "🦆", "x" * 2_500_000, "é漢" * 700_000, "<", "<P", "P>"]
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (3, texts[3], "x", 1), (3, texts[3], "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, output string, n int")
    got = sorted((tuple(r) for r in fim.digest_rows(docs).collect()), key=str)
    assert got == sorted((brute_fim(d[0], d[1]) for d in data), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.digest_rows(docs.limit(0)).collect() == []


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1_000):
        v = rng.integers(0, 6, n).astype(np.uint8)
        m, at = fim.WaveletMatrix(v), np.arange(n + 1)
        for c in range(6):
            assert (m.rank(c, at) == np.append(0, np.cumsum(v == c))).all()


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units(spark, unit):
    """Cuts by any unit stand at the boundaries that plain code finds, and give the text back."""
    rng = random.Random(9)
    texts = ["".join(rng.choices(["ab", "é", " ", "  ", "\n", ".", "7"], k=rng.randrange(1, 60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = lambda c: c.isalnum() or ord(c) > 127
    for r in fim.restored(fim.fill_in_middle(docs, unit=unit)).collect():
        t = texts[r.doc_id]
        assert r.text.decode() == t
        starts = {"char": list(range(len(t))), "word": [i for i, c in enumerate(t) if word(c) and not (i and word(t[i - 1]))], "line": [i + 1 for i, c in enumerate(t) if c == "\n"]}[unit]
        assert r.n == len(starts)
        if r.form != "plain":
            at = lambda k: 0 if k == 0 else len(t) if k == r.n else starts[k - (unit == "line")]
            a, b = at(r.prefix_end), at(r.middle_end)
            assert (r.prefix_bytes, r.middle_bytes) == (len(t[:a].encode()), len(t[a:b].encode()))


def test_markers_and_units_are_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="markers"):
            fim.fill_in_middle(docs, markers=bad)
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, unit="page")
    own = fim.restored(fim.fill_in_middle(docs, markers=("[pre]", "{suf}", "(mid)"), plain_from=100), markers=("[pre]", "{suf}", "(mid)")).first()
    assert own.text == b"a" and own.form != "plain"


# ---- quality ----
def test_counts_equal_plain_code():
    """Words, repeats and lines of texts, and their pairs of classes, one text at a time and together."""
    texts = ["a a b  a\nx y\nx y\n", "", "Wow!! Wow!!", "é é\n\n\né", "a", " ", "The the THE |x|"]
    raw, at = text_bytes(pa.array(texts))
    got = quality.counts_of(raw, at)
    for t, row in zip(texts, got):
        b = t.encode()
        pairs = np.zeros(quality.PAIRS)
        for x, y in zip(b, b[1:]):
            pairs[quality._CLASS[x] * quality.N_CLASSES + quality._CLASS[y]] += 1
        assert (row[: quality.PAIRS] == pairs).all() and row[quality.PAIRS] == max(len(b) - 1, 0) and row[-1] == len(b)
        low = bytes(b).lower()
        k = quality.PAIRS + 1
        words, lines = low.split(), [x for x in low.split(b"\n") if x]
        assert row[k] == len(words) and row[k + 1] == sum(len(w) > 20 for w in words)
        for of, at_ in ((words, k + 2), (lines, k + 3 + quality.LAGS)):
            for lag in range(1, quality.LAGS + 1):
                assert row[at_ + lag - 1] == sum(x == y for x, y in zip(of, of[lag:]))
        assert row[k + 2 + quality.LAGS] == len(lines)


def _cloud(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.ones((n, 1)), rng.standard_normal((n, 5)) + 1], 1)
    return x, quality.Moments(n, x.sum(0), x.T @ x)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.95])
def test_minimum_of_the_risk(prior):
    """No small step from the weights lowers the non-negative risk, computed row by row, whether or not its inner part is cut at 0."""
    (xp, p), (xu, u) = _cloud(), _cloud(60, 3)
    ridge = 1e-3

    def plain(w):
        loss = lambda x, s: np.mean((1 - s * (x @ w)) ** 2) / 4
        return prior * loss(xp, 1) + max(0.0, loss(xu, -1) - prior * loss(xp, -1)) + ridge / 4 * w @ w

    w = quality.minimise(p, u, prior, ridge)
    assert abs(plain(w) - quality.risk(p, u, prior, w) - ridge / 4 * w @ w) < 1e-9
    rng = np.random.default_rng(0)
    assert all(plain(w + d * s) >= plain(w) - 1e-9 for d in rng.standard_normal((300, len(w))) for s in (0.1, 0.003))


def test_prior_from_histograms():
    rng = np.random.default_rng(4)
    p, n = rng.normal(1, 0.4, 20_000), rng.normal(-1, 0.4, 20_000)
    for true in (0.2, 0.5, 0.9):
        u = np.concatenate([p[: int(10_000 * true)], n[: int(10_000 * (1 - true))]])
        hist = lambda v: np.histogram(v, 500, (-4, 4))[0].astype(float)
        assert abs(quality.prior_from(hist(p), hist(u)) - true) < 0.05


def test_sums_cover_all_rows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab C.!\n", k=rng.randrange(0, 80))) for _ in range(300)]
    f = quality.count_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    marked = f.select("doc_id", "counts", (F.col("doc_id") % 3 == 0).alias("trusted"), (F.col("doc_id") % 2).cast("int").alias("half"))
    got = quality.moments(marked)
    x = quality.expand(np.array([r.counts for r in f.orderBy("doc_id").collect()]))
    for (trusted, half), m in got.items():
        some = x[[i for i in range(300) if i % 2 == half and (not trusted or i % 3 == 0)]]
        assert m.n == len(some) and np.allclose(m.m, some.mean(0)) and np.allclose(m.a, some.T @ some / len(some))


def test_quality_on_held_out_rows(spark, sf_dir):
    got = queries.op11_quality(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet").collect()}
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got} == {True}
    test = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)
    bad = [b for a, b in test if a == 0]
    assert bad.count(0) >= 0.75 * len(bad)


def test_quality_edge_cases(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns; no rows; no trusted rows; labels that contradict."""
    long_ = "word and more. " * 200_000
    data = [(i, f"Some plain text {i} with words.", 0.1, "c") for i in range(40)] + [(90, None, 0.1, "c"), (91, "", 0.1, "c"), (92, long_, 0.1, "c"), (None, "no id at all", 0.1, "c"), (3, "Some plain text 3 with words.", 0.1, "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, score double, counts string")
    f = quality.count_features(docs)
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(19, 0), (None, 1), (21, None), (5, 1)], "doc_id long, quality int")
    ids = quality.trusted_ids(labels)
    assert sorted(r.doc_id for r in ids.collect()) == list(range(19))
    model = quality.fit(f, ids)
    got = quality.score(f, model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert scores[90] == scores[91] == [model.prior] and len(set(scores[3])) == 1
    whole = {r.doc_id: r.counts for r in f.collect()}[92]
    once = quality.counts_of(*text_bytes(pa.array(["word and more. " * 2_000])))[0]
    assert whole[-1] == len(long_) and abs(whole[quality.PAIRS + 1] / (100 * once[quality.PAIRS + 1]) - 1) < 1e-3
    assert quality.score(f, quality.fit(f, ids.limit(0))).agg(F.max("score")).first()[0] == 0
    assert quality.score(f.limit(0), quality.fit(f.limit(0), ids)).count() == 0
    assert [r[0] for r in spark.createDataFrame([(1,), (None,)], "i long").select(quality.held_out(F.col("i"))).collect()] == [zlib.crc32(b"1") % 3 == 1, False]
