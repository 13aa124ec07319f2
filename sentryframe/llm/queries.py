"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, fill_middle, language, merkle, ngram_join, packing, pii, quality, token_counts, token_files, toxicity, warc
from .common import fresh_path, in_training, read_table, table

EOT = 50_256


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: pairs of a document and a benchmark item, with the alignment's score and place."""
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, bpe_path())
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.detect(read_table(spark, sf_dir, "documents")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs, language.sample(docs.filter(in_training()).select("doc_id", "text", "lang")))
    return found.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), bpe_path())


def toxicity_scorer(spark: SparkSession, sf_dir: str) -> toxicity.Scorer:
    """Trained on labelled rows of documents that are not held out."""
    training = read_table(spark, sf_dir, "documents").filter(in_training())
    return toxicity.fit(toxicity.sample(training, read_table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), toxicity_scorer(spark, sf_dir))
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard, doc_no, start (in its shard), n_tokens (with the end id), closed."""
    folder = fresh_path(spark, "flat")
    listed = token_counts.write_flat(read_table(spark, sf_dir, "documents"), folder, bpe_path(), EOT)
    counts = token_counts.count_tokens(spark, folder, EOT).withColumn("shard", token_counts.shard_of(F.col("path"))).drop("path")
    return listed.join(counts, ["shard", "doc_no"], "full").select("doc_id", "shard", "doc_no", "start", "n_tokens", "closed")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, then looks the URL key of every page up through the index and reads what it finds."""
    pages = read_table(spark, sf_dir, "pages")
    directory = warc.write_archives(pages, fresh_path(spark, "warc"))
    records = warc.captures(directory, pages.select(warc.url_key_of("url").alias("key")).distinct())
    return warc.checked(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on documents that are not held out: their texts, and which of them are labelled 1."""
    features = table(quality.count_features(read_table(spark, sf_dir, "documents")), "features")
    training = ~quality.held_out(F.col("doc_id"))
    trusted = quality.trusted_ids(read_table(spark, sf_dir, "labels").filter(training))
    scored = quality.score(features, quality.fit(features.filter(training), trusted))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(merkle.document_rows(read_table(spark, sf_dir, "documents")))
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    out = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest_rows(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.shingles) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.shingles)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT html, min(page_id) AS original FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN g USING (html)
"""

#: Leaves, a level of each language's tree per step, and the tree over their roots; proofs are gathered by joins with all levels.
_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || {_field(_LOWERED)}) ELSE sha256(head || {_field("text")}) END AS used
  FROM (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)), 4294967295), 4294967295) AS crc FROM fields)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree(lang, level, idx, n, hash) AS (
  SELECT lang, 0, idx, n, leaf FROM ranked
  UNION ALL
  SELECT lang, level + 1, idx // 8, max((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, level, idx // 8),
subroots AS (SELECT lang, hash AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, idx, n, hash) AS (
  SELECT 0, idx, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, max((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 8),
nodes AS (
  SELECT r.doc_id, r.leaf, t.level, t.hash, t.idx < r.idx // pow(8, t.level)::BIGINT AS before, t.idx
  FROM ranked r JOIN tree t ON t.lang IS NOT DISTINCT FROM r.lang AND t.n > 1 AND t.idx // 8 = r.idx // pow(8, t.level + 1)::BIGINT AND t.idx <> r.idx // pow(8, t.level)::BIGINT
  UNION ALL
  SELECT r.doc_id, r.leaf, s.height + t.level, t.hash, t.idx < s.idx // pow(8, t.level)::BIGINT, t.idx
  FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang JOIN top t ON t.n > 1 AND t.idx // 8 = s.idx // pow(8, t.level + 1)::BIGINT AND t.idx <> s.idx // pow(8, t.level)::BIGINT),
sides AS (
  SELECT doc_id, leaf, level, coalesce(string_agg(hash, '' ORDER BY idx) FILTER (before), '') AS l, coalesce(string_agg(hash, '' ORDER BY idx) FILTER (NOT before), '') AS r FROM nodes GROUP BY doc_id, leaf, level),
heights AS (SELECT r.doc_id, r.leaf, r.used, s.subroot, s.height + (SELECT max(level) FROM top) AS height, (SELECT hash FROM top WHERE n = 1) AS root FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang),
folds(doc_id, leaf, level, height, hash) AS (
  SELECT doc_id, leaf, 0, height, used FROM heights
  UNION ALL
  SELECT f.doc_id, f.leaf, f.level + 1, f.height, sha256(coalesce(s.l, '') || f.hash || coalesce(s.r, '')) FROM folds f LEFT JOIN sides s USING (doc_id, leaf, level) WHERE f.level < f.height),
proofs AS (SELECT doc_id, leaf, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY doc_id, leaf)
SELECT h.doc_id, h.leaf, h.subroot, h.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = h.root AS verified
FROM heights h JOIN folds f ON f.doc_id = h.doc_id AND f.leaf = h.leaf AND f.level = h.height LEFT JOIN proofs p ON p.doc_id = h.doc_id AND p.leaf = h.leaf
"""

OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
d AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS x, ('0x' || d[9:16])::BIGINT % (n + 1) AS y, ('0x' || d[17:24])::BIGINT % 100 AS plain, ('0x' || d[25:32])::BIGINT % 100 AS spm FROM h),
f AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR plain >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_warc": op10_warc,
    "op11_quality": op11_quality,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_middle": op13_fill_middle,
}
ORACLE_SQL = {"op8_exact_dedup": OP8_SQL, "op9_ngram_join": OP9_SQL, "op10_warc": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_fill_middle": OP13_SQL}
