"""A training corpus from raw documents: filter, deduplicate, mix and tokenise.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of docs;
the last returns the tokens. `run` applies them in order; a driver may write each result
and read it again in between.

Edge cases: null texts count as empty: not toxic, and rejected as no language; rows with a
null doc_id or one that repeats are judged on their text like any other, and of each group
of near duplicates exactly one row stays; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlog.llm import language_id, sentencepiece_bpe, simhash_dedup, source_mixing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    # scored beside the row's own columns, so that a document's column of that name stays
    own = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.score(own, model).filter("predicted = 0").select("doc.*")


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept."""
    return language_id.accepted(docs, ~language_id.held_out())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates; a null one counts as the largest."""
    return simhash_dedup.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by their source's repetition rate, globally shuffled."""
    return source_mixing.replicated(docs).select("doc.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, number and digest of the ids, digest of the decoded text."""
    coded = sentencepiece_bpe.encode_decode(docs.select("doc_id", "text"), sentencepiece_bpe.model_path())
    return sentencepiece_bpe.digests(coded, "doc_id", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: The stages' models and trees are not expressible in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
