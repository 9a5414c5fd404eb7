"""From raw documents to token shards: five stages, each one operator of ``corpusflow.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import mixing, ordinal_quality, simhash, templates, token_index
from corpusflow.llm.common import scratch_path, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a good grade is at least one half."""
    return ordinal_quality.drop_rejected(docs, ordinal_quality.model_of(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five words, similarity 0.8."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its own or other numbers and names."""
    return templates.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again, twice at most."""
    return mixing.mixed_documents(docs, repetition_limit=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes and indexes token shards; gives what they hold for each document."""
    folder = scratch_path(spark, "tokens")
    token_index.write_shards(docs, folder, token_index.tokenizer_path())
    return token_index.read_documents(token_index.locate(docs, folder), folder, payload=False)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

#: Fingerprints, trained models and token files have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
