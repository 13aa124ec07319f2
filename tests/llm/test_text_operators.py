"""Dedup, near-dup join, PII, language, toxicity, decontamination and WARC against brute force."""

import hashlib
import random
from urllib.parse import unquote
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentryframe.llm import decontamination, exact_dedup, language, ngram_join, pii, queries, toxicity, warc
from sentryframe.llm.common import as_pattern, filter_bits, fresh_path, mark_maybe, maybe_in, table

DOCS = "doc_id long, text string, lang string, gone string, digest string, maybe int"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "g", "d", 1) for i, t in texts], DOCS).repartition(4)


def landed(spark, df):
    path = fresh_path(spark, "test-docs")
    df.write.parquet(path)
    return path


# ---- exact dedup ----
COPIES = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (1, "other"), (2, None), (4, ""), (7, " "), (8, "x" * 100_000), (6, "x" * 100_000), (1, "other"), (None, "a b"), (None, "alone")]


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(keep[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup(spark, files):
    path = landed(spark, docs_of(spark, COPIES))
    got = exact_dedup.exact_dedup(spark, path, max_files=files).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.digest) for r in got) == brute_dedup(COPIES)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in COPIES})


def test_exact_dedup_tells_colliding_digests_apart(spark):
    rows = [(i, f"text {i % 37}") for i in range(200)]
    path = landed(spark, docs_of(spark, rows))
    short = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_dedup(spark, path, digest=short).collect()
    assert sorted((r.id, r.keep_id, r.kept) for r in got) == [(i, i % 37, i < 37) for i in range(200)]


def test_drop_copies_keeps_columns(spark):
    d = docs_of(spark, COPIES)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns and out.count() == len({norm(t) for _, t in COPIES})
    assert exact_dedup.drop_copies(d.limit(0)).count() == 0


def test_exact_dedup_has_no_python(spark, sf_dir):
    plan = queries.op8_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_exact_dedup_needs_the_state_of_earlier_batches(spark):
    """Copies lie in different files and each batch takes a few files, so only the state knows of the earlier ones."""
    path = fresh_path(spark, "test-docs")
    rows = [(i, f"text {i % 20}", "en", "g", "d", 1) for i in range(120)]
    for k in range(6):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], DOCS).coalesce(1).write.mode("append").parquet(path)
    written = exact_dedup.run_stream(spark, path)
    assert written.select("batch").distinct().count() >= 3
    assert written.groupBy("batch", "digest").count().filter("count > 1").count() == 0
    got = exact_dedup.exact_dedup(spark, path).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(i, i % 20, 6, i < 20) for i in range(120)]
    assert exact_dedup.scanned_folder(spark.read.parquet(path)) and not exact_dedup.scanned_folder(spark.read.parquet(path).filter("doc_id > 5"))
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(spark.read.parquet(path).filter("doc_id > 5")).collect()) == list(range(6, 26))


def test_filters_grow_with_their_keys(spark):
    assert [filter_bits(n) for n in (0, 1, 65_536, 65_537, 1 << 40)] == [1 << 20, 1 << 20, 1 << 20, 1 << 21, 1 << 44]
    rows, keys = spark.range(1000).select(F.col("id").alias("k")), spark.range(0, 1000, 7).select(F.col("id").alias("k"))
    few = maybe_in(rows, keys, "k", 143).collect()
    assert {r.k for r in few} >= set(range(0, 1000, 7)) and len(few) < 160
    exact = mark_maybe(rows.withColumn("x", F.lit(1)), keys.unionByName(keys), "k", 1 << 20, most_bits=1 << 20)  # too many for a bitmap
    assert exact.columns == ["k", "x", "maybe"] and {(r.k, r.maybe) for r in exact.collect()} == {(i, i % 7 == 0) for i in range(1000)}


def test_exact_dedup_of_any_path_and_size(spark):
    """One file or a folder, with a slash at the end, blanks and pattern characters; always several batches, of bounded bytes."""
    rows = [(i, f"text {i % 20} " * 30, "en", "g", "d", 1) for i in range(120)]
    folder = fresh_path(spark, "docs [a] {b} c*?%20")
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(folder)
    one = spark.read.parquet(as_pattern(folder)).inputFiles()[0]
    want = [(i, i % 20, 6, i < 20) for i in range(120)]
    for path in (folder, folder + "/", unquote(one)):
        assert exact_dedup.run_stream(spark, path).select("batch").distinct().count() >= 3
        assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path).collect()) == want
    rng = random.Random(6)
    large = landed(spark, spark.createDataFrame([(i, f"{rng.getrandbits(8_000):x}", "en", "g", "d", 1) for i in range(400)], DOCS).coalesce(1))
    size = spark.read.format("binaryFile").load(large).agg(F.max("length")).first()[0]
    copy, per_batch = exact_dedup.micro_batches(spark, large, 3, size // 8)
    assert per_batch <= size // 4 and spark.read.format("binaryFile").load(copy).count() >= 8
    assert exact_dedup.micro_batches(spark, copy, 3, 64 << 30)[0] == copy  # enough small files are read in place
    assert exact_dedup.scanned_folder(spark.read.parquet(as_pattern(folder))) == folder
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(spark.read.parquet(as_pattern(folder))).collect()) == list(range(20))


# ---- n-gram join ----
def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "z"
    return words


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", "one two", "One  TWO", "a b c d e", "A b c d e", "a b c d e f", " ".join(WORDS * 40)]
    common = rng.choices(WORDS, k=12)
    for _ in range(8):
        base = rng.choices(WORDS, k=rng.choice([8, 30, 120]))
        for _ in range(rng.choice([1, 3, 25])):
            w = edited(rng, base, rng.randint(0, max(1, len(base) // 20)))
            texts.append(" ".join(common + w if rng.random() < 0.5 else w))
    for k in range(12):  # a chain: neighbours are similar, ends are not
        chain = WORDS[3 * k : 3 * k + 60]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(spark, rows), chunk=[1 << 20, 400, 3_000][seed]).collect()}
    assert got == brute_components(rows)


def test_ngram_join_when_keys_of_sets_collide(spark):
    """With keys of 10 bits some of 70 sets get the same one, so the first keys are given up."""
    rng = random.Random(3)
    base = rng.choices(WORDS, k=60)
    rows = [(i, " ".join(edited(rng, base, 1 + i % 3) if i % 2 else rng.choices(WORDS, k=30))) for i in range(70)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(spark, rows), key_bits=10).collect()}
    assert got == brute_components(rows)


def test_ngram_join_links_through_rows_without_an_id(spark):
    chain = [" ".join(WORDS[a : a + 60]) for a in (0, 4, 8)]
    d = docs_of(spark, [(1, chain[0]), (None, chain[1]), (2, chain[2]), (3, "x y z")])
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(d).collect()} == {1: 1, None: 1, 2: 1, 3: 3}


def test_groups_that_cannot_be_similar_are_never_paired(spark):
    rng = random.Random(5)
    posts = [(t, p, 20 + 7 * p, rng.randrange(0, 6 + p), 0) for p in range(40) for t in rng.sample(range(12), 4)]
    posted = table(spark.createDataFrame(posts, "token long, pid long, n int, pos int, alone int"), "posted")
    one = "struct<h:long,gid:long,comp:long>"
    states = table(spark.createDataFrame([(p, p // 2, p // 2, (0, p, p // 2)) for p in range(40)], f"pid long, c0 long, c1 long, one {one}"), "states")
    want = set()
    for t, p, n, i, _ in posts:
        for u, q, m, j, _ in posts:
            if t == u and p < q and p // 2 != q // 2 and 4 * n >= 3 * m and 7 * min(n - i, m - j) >= 3 * (n + m):
                want.add((p, q))
    lists = ngram_join._lists(posted, states)
    got = sorted((r.p, r.q) for r in ngram_join._all_groups(lists, states).collect())
    assert got == sorted(want) and len(want) < 200
    for r in ngram_join._star_groups(lists, states, 0).collect():
        assert (min(r.pid, r.one), max(r.pid, r.one)) in want


def test_ngram_join_of_a_large_group(spark):
    """Near copies of one text that are not all similar to each other, with exact copies among them."""
    rng = random.Random(9)
    base = rng.choices(WORDS, k=200)
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 6)))) for i in range(150)] + [(200 + i, " ".join(base)) for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_edges(spark):
    none = ngram_join.similar_components(docs_of(spark, [(1, "x")]).limit(0))
    assert none.count() == 0
    d = docs_of(spark, [(1, "a b c"), (None, "a b c"), (1, "a b c"), (3, "")])
    assert sorted((str(r.doc_id), r.component_id) for r in ngram_join.similar_components(d).collect()) == [("1", 1), ("1", 1), ("3", 3), ("None", 1)]
    kept = ngram_join.keep_one(docs_of(spark, [(1, "a b c"), (2, "a b c"), (3, ""), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == DOCS.replace(",", "").split()[::2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (-5, 200)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, -5: -5, 200: -5}


def test_components_of_a_shuffled_chain(spark):
    rng = random.Random(4)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(1000)]
    edges = list(zip(ids, ids[1:])) + [(7, 7)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: min(ids) for i in ids} | {7: 7}


# ---- PII ----
def test_pii_equals_plain_expressions(spark):
    rng = random.Random(2)
    parts = list("@@..++--  ()0123456789ab%") + ["://", "IBAN", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 1234", "a@b.c", "é", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)] + [None, "", "9" * 50_000, "1." * 20_000, "a" * 50_000 + "@", "+1" * 20_000, "@" * 20_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest_columns(pii.detect(d)).collect():
        want = pii.brute_force(texts[r.doc_id] or "")
        assert r.base_sha256 == pii.spans_sha256(want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))


def test_pii_more_kinds_and_redaction(spark):
    text = "Mail a.b@c.example or see https://x.example/p?q=1. IBAN: DE89 3704 0044 0532 0130 00; account number 12345678, SSN 123-45-6789."
    at = lambda s: (text.index(s), text.index(s) + len(s))
    want = {("email", *at("a.b@c.example")), ("url", *at("https://x.example/p?q=1")), ("iban", *at("DE89 3704 0044 0532 0130 00")), ("account", *at("12345678")), ("ssn", *at("123-45-6789"))}
    found = {(pii.KINDS[k], s, e) for s, k, e in pii.find_spans(text)}
    assert want <= found and {k for k, _, _ in found - want} <= {"card", "phone", "ip"}
    for cue in ("iban", "IbAn", "IBAN"):
        assert ("iban", 7, 29) in {(pii.KINDS[k], s, e) for s, k, e in pii.find_spans(f"İ {cue} DE89370400440532013000")}
    long_ = "a" * 40 + "://x.example"
    assert pii.find_spans(long_) == [(0, 4, len(long_))]
    twice = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")
    assert sorted(pii.digest_columns(pii.detect(twice)).groupBy("doc_id").count().collect()) == [(1, 2), (2, 1)]
    assert pii.digest_columns(pii.detect(twice.limit(0))).collect() == []
    out = pii.redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert out[0].text.startswith("Mail <email> or see <url>. IBAN: <") and "123-45-6789" not in out[0].text and out[1].text is None


# ---- language ----
def test_suffix_automaton_knows_all_substrings():
    rng = np.random.default_rng(4)
    s = rng.integers(1, 4, 60).astype(np.uint8)
    move, other = language.suffix_automaton(s, 4)
    assert not other
    inside = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 7) + 1)}
    for _ in range(500):
        w, at = tuple(rng.integers(1, 4, rng.integers(1, 7)).tolist()), 0
        for c in w:
            at = move[at, c]
            if not at:
                break
        assert bool(at) == (w in inside)


def test_phrases_equal_greedy_parsing():
    samples = {"x": "the cat sat on the mat and the dog", "y": "der hund und die katze auf der matte"}
    p = language.CrossParser(samples, lane=16)
    texts = ["the cat and the dog", "die katze", "zzz ééé", "a" * 100, "The DOG 1234\n\n ok"]
    n, size = p.phrases(texts)
    for g, lang in enumerate(p.langs):
        ref = p.code_of[p._points(samples[lang].lower())].astype(np.uint8).tobytes()
        for j, t in enumerate(texts):
            codes, count = p.code_of[p._points(t.lower())].astype(np.uint8).tobytes(), 0
            for a in range(0, len(codes), 16):
                lane, i = codes[a : a + 16], 0
                while i < len(lane):
                    k = i
                    while k < len(lane) and lane[i : k + 1] in ref:
                        k += 1
                    if k == len(lane):
                        break
                    count += 1
                    # the character that ended the phrase begins the next one, unless the sample lacks it
                    i = k if lane[k : k + 1] in ref else k + 1
            assert n[g, j] == count
            assert size[j] == len(t)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_language(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_equals_brute_force(spark):
    """Every text of a small table against plain greedy parsing, ties and repeated rows included."""
    samples = {"a": "the cat sat on the mat and the dog ate it", "b": "der hund und die katze auf der matte", "c": "der hund und die katze auf der matte"}
    rng = random.Random(3)
    texts = ["".join(rng.choices("the catdogmn uikz", k=rng.randint(1, 90))) for _ in range(60)] + ["der hund", "der hund", "THE CAT", "7 7", "a" * 3000]

    def phrases(codes: bytes, ref: bytes) -> int:
        n = 0
        for a in range(0, len(codes), 256):
            lane, i = codes[a : a + 256], 0
            while i < len(lane):
                k = i
                while k < len(lane) and lane[i : k + 1] in ref:
                    k += 1
                if k == len(lane):
                    break
                n, i = n + 1, k if lane[k : k + 1] in ref else k + 1
        return n

    p = language.CrossParser(samples)
    code = lambda t: bytes(p.code_of[p._points(t.lower())].astype(np.uint8))
    want = {}
    for i, t in enumerate(texts):
        rates = [((phrases(code(t), code(samples[g])) + 1) / len(t), g) for g in sorted(samples)]
        (r0, lang), (r1, _) = sorted(rates)[:2]
        want[i] = (lang, round(1 - r0 / r1, 9)) if any(map(str.isalpha, t)) else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(docs_of(spark, list(enumerate(texts))), samples).collect()}
    assert got == want and got[60] == got[61] == ("b", 0.0) and language.identify(docs_of(spark, []), samples).count() == 0


def test_language_sample_is_bounded_and_takes_whole_texts(spark):
    texts = [(i, f"{'short' if i % 2 else 'lo' * (10 + i)} {i}") for i in range(60)]
    rows = [(i, t, "en") for i, t in texts] + [(100, "z" * 5000, "de"), (101, "y" * 4000, "de"), (102, None, "fr"), (103, "x", None)]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    got = language.sample(d, docs_per_lang=20, chars_per_lang=300, max_chars=50)
    assert got["de"] == "y" * 4000 and set(got) == {"de", "en"}
    lines = got["en"].split("\n")
    assert set(lines) <= {t for _, t in texts} and len(lines) <= 20 and 150 < sum(map(len, lines)) <= 300
    many = {f"l{k:03d}": f"abc{chr(0x400 + k)} {k} text" * 20 for k in range(60)}
    dense, sparse = language.CrossParser(many), language.CrossParser(many, dense_bytes=200_000)
    assert sparse.width < dense.width and (dense.phrases(["abc text", "abcЁ 1"])[0] == sparse.phrases(["abc text", "abcЁ 1"])[0]).all()


def test_language_edges(spark):
    d = docs_of(spark, [(1, None), (2, "123 !"), (3, "the cat sat"), (4, "")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(d, {"en": "the cat sat on the mat"}).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[3][0] == "en"
    assert {r.lang_pred for r in language.identify(d, {}).collect()} == {"und"}
    assert language.sample(d.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) == {}


def test_language_tells_languages_of_one_large_script_apart():
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(600)]
    text = lambda some, n: "".join(rng.choice(some) for _ in range(n))
    parser = language.CrossParser({"a": text(letters[:300], 3000), "b": text(letters[300:], 3000), "en": "the cat sat on the mat " * 20})
    tests = [("b", text(letters[300:], 40)) if i % 2 else ("a", text(letters[:300], 40)) for i in range(40)] + [("en", "the mat sat")]
    assert parser.predict([t for _, t in tests])[0] == [g for g, _ in tests]


# ---- toxicity ----
def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.init_params().items()}
    f = toxicity.word_features([b"abc", b"de", b"fghij", b"x"])
    index = rng.integers(0, 4, (toxicity.WINDOW, 5))
    index[:4, 0] = [0, 1, 2, 3]
    mask, y = np.arange(toxicity.WINDOW)[:, None] < np.array([32, 3, 10, 32, 1]), np.array([1, 0, 1, 0, 1.0])
    _, g = toxicity.gradients(p, f, index, mask, y)
    for k in g:
        v = p[k]
        i = (f[0][0], 1) if k == "word" else (f[1][0], 2) if k == "char" else tuple(rng.integers(0, s) for s in v.shape)
        old = v[i]
        v[i] = old + 1e-3
        up = toxicity.gradients(p, f, index, mask, y)[0]
        v[i] = old - 1e-3
        down = toxicity.gradients(p, f, index, mask, y)[0]
        v[i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-4 + 0.02 * abs(g[k][i]), k


def _toy(rng, n, toxic):
    words = [rng.choice(WORDS[:80]) for _ in range(n)]
    if toxic:
        for _ in range(2):
            words[rng.randrange(n)] = rng.choice(["scoundrel", "scoundrels", "vile"])
    return " ".join(words)


def test_toxicity_learns_and_reads_to_the_end(spark):
    rng = random.Random(1)
    labels = [int(i % 4 == 0) for i in range(400)]
    scorer = toxicity.train([_toy(rng, rng.choice([10, 40, 120]), y) for y in labels], labels)
    test = [int(i % 2) for i in range(100)]
    s = scorer.score([_toy(rng, 60, y) for y in test])
    assert np.mean((s >= 0.5) == np.array(test)) > 0.9
    long = " ".join(rng.choices(WORDS[:80], k=20_000))
    assert scorer.score([long + " scoundrel vile scoundrel"])[0] > max(0.5, scorer.score([long])[0])
    d = docs_of(spark, [(1, None), (2, ""), (3, "vile scoundrel vile"), (4, "w1 w2 w3")])
    got = {r.doc_id: r.score for r in toxicity.score(d, scorer).collect()}
    assert got[1] == got[2] < 0.5 < got[3] and all(0 <= v <= 1 for v in got.values())
    kept = toxicity.keep_below(d, scorer)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_toxicity_scores_equal_single_windows(spark):
    """A text's score is the highest of its windows, each run through the network alone."""
    rng = random.Random(4)
    labels = [int(i % 3 == 0) for i in range(90)]
    scorer = toxicity.train([_toy(rng, rng.choice([5, 50]), y) for y in labels], labels, rounds=2)
    texts = [_toy(rng, n, n % 2) for n in (1, 7, 31, 32, 33, 57, 200)] + ["vile", "é ß 日本", "", None]
    want = []
    for t in texts:
        words, best = toxicity.words_of(t), None
        for s in toxicity.window_starts(len(words)) if words else []:
            w = words[s : s + toxicity.WINDOW]
            x = toxicity.inputs(scorer.p, toxicity.word_features(w))
            index = np.arange(len(w))[:, None]
            logit = float(toxicity.forward(scorer.p, x, index, None)[0])
            best = logit if best is None else max(best, logit)
        want.append(scorer.prior if best is None else 1 / (1 + np.exp(-best)))
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, list(enumerate(texts))), scorer).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4)


def test_toxicity_edges(spark):
    assert toxicity.train([], []).score(["x", None]).tolist() == [0.0, 0.0]
    assert toxicity.train(["x", "y"], [1, 1]).score(["x"])[0] < 0.5
    assert toxicity.window_starts(32) == [0] and toxicity.window_starts(33) == [0, 1]
    starts = toxicity.window_starts(1000)
    assert starts[-1] == 1000 - toxicity.WINDOW and max(np.diff(starts)) <= toxicity.STRIDE
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.sample(docs_of(spark, [(1, "a"), (2, None), (3, "b")]), labels)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 0)]
    none = toxicity.fit(toxicity.sample(docs_of(spark, []), labels))
    assert none.score(["a"]).tolist() == [0.0] and toxicity.score(docs_of(spark, []), none).count() == 0
    twice = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, [(1, "a b"), (2, "a b")]), toxicity.fit(rows)).collect()}
    assert twice[1] == twice[2]


# ---- decontamination ----
def brute_align(a, b):
    best, h = 0, [0] * (len(b) + 1)
    for x in a:
        diagonal, row = 0, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = max(0, h[j - 1] + (2 if x == y and y else -1), h[j] - 1, row[j - 1] - 1)
            best = max(best, row[j])
        h = row
    return best


def test_smith_waterman():
    rng = np.random.default_rng(3)
    segs = [rng.integers(1, 6, rng.integers(1, 20)) for _ in range(60)]
    wins = [rng.integers(0, 6, rng.integers(1, 40)) for _ in range(60)]
    got, end = decontamination.smith_waterman(segs, wins)
    assert got.tolist() == [brute_align(a, b) for a, b in zip(segs, wins)] and all(e <= len(w) for e, w in zip(end, wins))


def test_leaks(spark):
    rng = random.Random(6)
    item = rng.choices(WORDS, k=40)
    long = rng.choices(WORDS[200:], k=400)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (3, "tiny item"), (4, None), (5, "")], "item_id long, text string")
    noise = lambda n: rng.choices([w + "q" for w in WORDS], k=n)
    changed = [w if k % 7 else w + "x" for k, w in enumerate(item)]
    dropped = [w for k, w in enumerate(item) if k % 6]
    texts = [
        (10, " ".join(noise(50) + item + noise(9000))),
        (11, " ".join(noise(30) + changed + noise(30))),
        (12, " ".join(noise(30) + dropped)),
        (13, " ".join(noise(300))),
        (14, " ".join(noise(20) + long[100:200] + noise(20))),
        (15, " ".join(noise(5)) + " TINY, item! " + " ".join(noise(5))),
        (16, None),
        (17, ""),
        (18, " ".join(noise(10) + item[:10] + noise(10))),
    ]
    d = docs_of(spark, texts)
    leaks = decontamination.find_leaks(d, bench)
    pairs = {(r.doc_id, r.item_id) for r in leaks.collect()}
    assert pairs == {(10, 1), (11, 1), (12, 1), (14, 2), (15, 3)}
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, bench, block_words=100).collect()} == pairs
    at = leaks.filter("doc_id = 10").first()
    assert (at.word_start, at.word_end, at.score) == (50, 90, 1.0)
    kept = decontamination.drop_contaminated(d, leaks)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [13, 16, 17, 18]
    assert decontamination.find_leaks(d, bench.limit(0)).count() == 0 == decontamination.find_leaks(d.limit(0), bench).count()


def test_leaks_equal_brute_force(spark):
    """All pairs of documents and items: a pair is a leak if they share an n-gram and the whole texts' alignment reaches the share."""
    rng = random.Random(12)
    pool = [w + "b" for w in WORDS[:60]]
    items = [(k, " ".join(rng.choices(pool, k=rng.choice([3, 12, 40, 60])))) for k in range(12)] + [(3, "again " + " ".join(pool[:9])), (50, " ".join(pool[:9]) + " again")]
    docs = [(900, None), (901, "")]
    for i in range(120):
        words = rng.choice(items)[1].split()
        words = [w if rng.random() > 0.12 else rng.choice(["", "x y", "zz"]) for w in words[rng.randrange(max(1, len(words) // 3)) :]]
        docs.append((i // 2, " ".join(rng.choices(WORDS, k=rng.randrange(40)) + words + rng.choices(WORDS, k=rng.randrange(40)))))
    docs += docs[5:8]  # repeated rows
    want = []
    for i, t in docs:
        w = [x.decode() for x in toxicity.words_of(t)]
        for k in {k for k, _ in items}:
            best = 0.0
            for _, text in (x for x in items if x[0] == k):
                s = text.split()
                n = min(4, len(s))
                grams = {tuple(s[a : a + n]) for a in range(len(s) - n + 1)}
                if any(tuple(w[a : a + n]) in grams for a in range(len(w) - n + 1)):
                    best = max(best, brute_align(s, w) / (2 * len(s)))
            if best >= 0.5:
                want.append((i, k, round(best, 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(docs_of(spark, docs), bench, min_rare=4)
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in got.collect()) == sorted(want) and len(want) > 60


def test_leaks_of_a_passage_in_most_documents(spark):
    rng = random.Random(7)
    item = " ".join(rng.choices(WORDS, k=30))
    d = docs_of(spark, [(i, f"n{i} " + (item if i % 3 else "clean") + f" m{i}") for i in range(300)])
    leaks = decontamination.find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string"), min_rare=5)
    assert {r.doc_id for r in leaks.collect()} == {i for i in range(300) if i % 3}


def test_leaks_of_edited_copies_of_a_frequent_passage(spark):
    rng = random.Random(8)
    item = WORDS[100:138]
    texts = [(i, " ".join([f"n{i}", *item])) for i in range(40)]
    for i in range(40, 80):
        broken = rng.sample(range(38), 4 + i % 3)
        words = [w + "x" if k in broken else w for k, w in enumerate(item)] if i % 4 else item[i // 8 :][:24]
        texts.append((i, " ".join(["a", "b", *words, "c"])))
    texts.append((99, " ".join(["a", *item[8:22], "b"])))
    best = {i: brute_align(item, t.split()) / 76 for i, t in texts}
    whole = {i for i, t in texts if any(" ".join(item[k : k + 4]) in t for k in range(35))}
    want = {(i, 1, best[i]) for i in whole if best[i] >= 0.5}
    assert len(want) > 70 and 99 not in {i for i, _, _ in want}
    leaks = decontamination.find_leaks(docs_of(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), min_rare=5)
    assert {(r.doc_id, r.item_id, r.score) for r in leaks.collect()} == want


# ---- WARC ----
def archived(df, folder, **options):
    directory = warc.write_archives(df, folder, **options)
    keys = df.select(warc.url_key_of("url").alias("key")).distinct()
    return directory, warc.checked(warc.captures(directory, keys).drop("key", "html"))


def test_warc(spark):
    urls = ["http://B.example.com/x?q=1", "https://a.example.com:8443/", "not a url", None, "http://[bad", "http://b.example.com/x?q=1"]
    pages = [(i, urls[i % len(urls)], ["<p>é</p>", "", None, "long " * 50_000][i % 4] if i < 20 else f"page {i}", "x") for i in range(60)]
    pages += [(None, "http://n.example/", "<p>é</p>", "x"), (7, urls[1], "seven", "x"), (7, urls[1], "seven", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    directory, records = archived(df, fresh_path(spark, "warc"), block_lines=7)
    got = records.collect()
    first = {}
    for i, _, h, _ in pages:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        revisit = i != first[b]
        want.append((str(i), len(b), warc.payload_digest(b), "revisit" if revisit else "response", str(first[b] if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    asked = spark.createDataFrame([("http://b.example.com:80/x?q=1",), ("http://nowhere/",)], "url string")
    found = warc.lookup(directory, asked).collect()
    assert {r.page_id for r in found} == {i for i, u, _, _ in pages if u and u.lower().startswith("http://b.")}
    html = dict((i, h) for i, _, h, _ in pages)
    assert all(bytes(r.html).decode() == (html[r.page_id] or "") for r in found if r.record_type == "response")
    none, records = archived(df.limit(0), fresh_path(spark, "warc"))
    assert records.count() == none.count() == warc.lookup(none, asked).count() == 0


def test_warc_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    _, records = archived(df, fresh_path(spark, "warc"), min_revisit_bytes=3)
    assert {r.page_id: r.record_type for r in records.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_wrong_revisits_are_found(spark):
    rows = [(1, "u", 3, "A", "x", "response", None), (2, "u", 3, "A", "x", "revisit", 1), (3, "u", 3, "A", "y", "revisit", 1)]
    assert warc.checked(spark.createDataFrame(rows[:2], warc.RECORD)).count() == 2
    with pytest.raises(Exception, match="no such response for page 3"):  # an equal SHA-1 and size, but another SHA-256: a forged page
        warc.checked(spark.createDataFrame(rows, warc.RECORD)).collect()


def test_warc_archives_are_rolled(spark):
    """A partition writes several archives of bounded size, in a folder whose name has a blank and pattern characters; all are found."""
    pages = [(i, f"http://h{i % 40:02d}.example/p", f"payload {i % 90} " * 50) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    directory, records = archived(df, fresh_path(spark, "warc a [b] 100%"), block_lines=7, archive_bytes=3_000)
    files = directory.select("warc_file").distinct().count()
    assert files > 10 and directory.select("part").distinct().count() < files
    got = {r.page_id: (r.record_type, r.refers_to) for r in records.collect()}
    assert got == {i: ("response", None) if i < 90 else ("revisit", i % 90) for i in range(200)}
    assert warc.with_shelves(directory, 2).select("shelf").distinct().count() <= 2


def test_op10_query_takes_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    want = []
    for r in pages:
        b, o = (r.html or "").encode(), first[r.html or ""]
        want.append((r.page_id, len(b), warc.payload_digest(b), *(("response", None) if o == r.page_id else ("revisit", o))))
    assert sorted(map(tuple, queries.op10_warc(spark, sf_dir).collect()), key=str) == sorted(want, key=str)


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b=c") == "com,example,www)/a?b=c"
    assert warc.url_key("https://x.y:8443") == "y,x:8443)/"
    assert warc.url_key(None) == warc.url_key("junk") == "-)/"


def test_blocks_are_found_by_binary_search(spark):
    keys = sorted(f"com,h{i:03d})/" for i in range(100))
    rows = [(i // 30, keys[i], keys[i + 9], 10, f"f{i // 30}", i, 1, "w", 0, 1) for i in range(0, 100, 10)]
    rows += [(i // 30, "com,i)/", "com,i)/", 10, f"f{i // 30}", i, 1, "w", 0, 1) for i in range(100, 200, 10)]  # one key over many blocks and files
    d = table(spark.createDataFrame(rows, warc.DIRECTORY), "directory")
    asked = spark.createDataFrame([(k,) for k in [*keys[::7], "com,i)/", "com,zzz)/", "a", "com,h0095)/"]], "key string")
    got = sorted((k, r.offset) for r in warc.find_blocks(d, asked).collect() for k in r.asked)
    want = [(k, keys.index(k) // 10 * 10) for k in keys[::7]] + [("com,i)/", i) for i in range(100, 200, 10)]
    assert got == sorted(want + [(k, i) for k, i in [("com,h0095)/", 0)] if keys[0] <= k <= keys[9]])
