"""Raw documents to packed training sequences; each stage's rows are written as Parquet and read again by the next.

1. language: documents without a letter, or whose best language has a mean probability under LEAST_SCORE, go.
2. near_duplicates: of each group of near duplicates (five-word shingles, similarity 0.8) one document stays.
3. personal_data: spans of personal data become placeholders.
4. mixing: sources are drawn to their target weights; a document drawn twice is there twice. Rows come by output shard, shuffled within it.
5. packing: documents become pieces of sequences of 1024 tokens, in the order of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import langid, mixing, near, packing, pii
from marlpit.llm.common import discard, store

LEAST_SCORE = 0.35
#: The stages learn, hash and pack: SQL can't express them. tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a language; null texts and texts without a letter have none. Rows that are repeated stay; an empty table stays empty."""
    net = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, net).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, as near.dedup() says for nulls, ties and repeated rows."""
    return near.dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with placeholders for personal data; null texts stay null, and so do their lengths."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw, by shard and in the shard's order; a null source is a source, and texts without words are never drawn."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; a null or empty text is an end id alone."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents. Each stage's table is deleted when the next one is written; the last stage reads the mix as it runs.

    Null texts, and texts without a letter, have no language and go first. Null keys, sources and repeated rows are kept by all stages but
    the second, which keeps one row of each group (the smallest key, null last). An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
