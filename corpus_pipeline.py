"""From raw documents to token ids: quality rules, near-duplicates, benchmark passages, personal data, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.llm import bpe, contamination, neardup, pii, quality
from auditloom.llm.common import table
from auditloom.plans.lineage import cut

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _size(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, any shorter benchmark passage cut out of them."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=_size(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs, pii.learn(docs), size=_size(docs))


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest, and whether decoding gives the text's bytes back."""
    ids = bpe.encode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), RANKS, ["doc_id", "_sha"])
    both = bpe.decode(ids, RANKS, ["doc_id", "_sha", "ids"])
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"),
                       (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal data", personal_data), ("byte pairs", byte_pairs)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
