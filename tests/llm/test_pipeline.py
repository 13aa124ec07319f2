"""The pipeline's stages one by one against plain re-computation, and the whole run."""

import corpus_pipeline as cp
from sentryframe.llm import decontamination, queries
from sentryframe.llm.toxicity import words_of
from tests.llm.test_text_operators import brute_align, brute_components, norm


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = queries.toxicity_scorer(spark, sf_dir)
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    clean = cp.table(stages["toxicity"](spark, docs, sf_dir), "a")
    rows = docs.orderBy("doc_id").collect()
    kept = [r for r, s in zip(rows, scorer.score([r.text for r in rows])) if s < 0.5]
    assert ids(clean) == [r.doc_id for r in kept] and clean.columns == docs.columns

    single = cp.table(stages["exact_dedup"](spark, clean, sf_dir), "b")
    first = {}
    for r in kept:
        first.setdefault(norm(r.text), r)
    assert ids(single) == sorted(r.doc_id for r in first.values()) and single.columns == docs.columns

    apart = cp.table(stages["ngram_join"](spark, single, sf_dir), "c")
    groups = brute_components([(r.doc_id, r.text) for r in first.values()])
    left = [r for r in first.values() if groups[r.doc_id][1] == r.doc_id]
    assert ids(apart) == sorted(r.doc_id for r in left) and apart.columns == docs.columns

    out = cp.table(stages["decontamination"](spark, apart, sf_dir), "d")
    items = [b" " + b" ".join(words_of(r.text)) + b" " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in left if any(i in b" " + b" ".join(words_of(r.text)) + b" " for i in items)}
    gone = {r.doc_id for r in left} - set(ids(out))
    assert exact <= gone and out.columns == docs.columns
    segments = decontamination.index_items([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text])
    word = {v: k for k, v in segments.vocabulary.items()}
    plain = [[word[i] for i in s.tolist()] for s in segments.words]
    for r in left:  # each document that went without an exact item aligns with some segment by half at least
        if r.doc_id in gone - exact:
            w = words_of(r.text)
            assert any(brute_align(s, w) >= len(s) for s in plain)

    packed = cp.run(spark, sf_dir).collect()
    assert sorted({r.doc_id for r in packed}) == ids(out)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_take_edge_cases(spark, sf_dir):
    """No rows, null and empty texts, repeated rows, null ids and columns of clashing names."""
    schema = "doc_id long, text string, lang string, digest string, gone string, maybe int, comp long, slot string, bucket long, score double"
    rest = ("en", "d", None, 1, 2, "s", 3, 0.9)
    rows = [(1, None, *rest), (2, "", *rest), (3, "a b c", *rest), (3, "a b c", *rest), (None, "d e f", *rest), (4, "word " * 60_000, *rest)]
    for some in (rows, []):
        docs = cp.table(spark.createDataFrame(some, schema), "edge")
        for name, stage in cp.STAGES[:-1]:
            before, docs = docs, cp.table(stage(spark, docs, sf_dir), name)
            assert docs.columns == before.columns, name
        kept = sorted((str(r.doc_id), (r.text or "")[:5]) for r in docs.collect())
        assert kept == ([("1", ""), ("3", "a b c"), ("4", "word "), ("None", "d e f")] if some else [])
        assert {tuple(r)[2:] for r in docs.collect()} == ({rest} if some else set())
        packed = dict(cp.STAGES)["packing"](spark, docs, sf_dir)
        assert packed.select("doc_id").distinct().count() == len(kept)
