"""From raw documents to packed training sequences: toxic documents go, then copies, near copies and benchmark leaks; the rest is packed.

Each stage works on all that the one before kept; its result is written as Parquet into the shared folder and read again.
ORACLE_SQL is None: a trained network decides the first stage. Tests hold run() against a brute-force version.

Cases, for all stages: an empty table stays empty; whole texts are read, however long; columns besides doc_id and text are
carried through the first four stages, whatever their names and values, nulls included; no row is lost but by the stage's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentryframe.llm import decontamination, exact_dedup, ngram_join, packing, queries, toxicity
from sentryframe.llm.common import read_table, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on labelled rows that are not held out, scores under 0.5.

    Null and empty texts and a table without labels of both kinds reject nothing; repeated rows get equal scores; a score of
    exactly 0.5 is rejected."""
    return toxicity.keep_below(docs, queries.toxicity_scorer(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space runs count as one space) that with the smallest id.

    Null and empty texts are equal; of repeated rows with one id a single one stays; a null id stays only where no row of
    its group has an id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a shingle similarity of 0.75 or more that with the smallest id.

    Null, empty and blank texts are linked with nothing and stay; rows with a null id stay, as no id tells them apart."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts and items match nothing; without items all stay; rows with a null id stay."""
    return decontamination.drop_contaminated(docs, table(decontamination.find_leaks(docs, read_table(spark, sf_dir, "benchmark")), "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is one piece of its end id; repeated rows are packed each on its own."""
    return packing.pack(docs, queries.bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
