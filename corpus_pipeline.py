"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All but the last keep the columns of documents, and extra ones whatever their
names; empty tables give empty tables; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontam, langid, near, pii
from quire.llm._common import drop, scratch, table, until_exit


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without letters, or whose language stays unclear, go; so do null and empty texts.  Repeated rows stay."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 at five-word shingles and similarity 0.8: one document of each group of near copies stays, and every row without an id.

    Null, empty and blank texts are copies of each other.  The method is that of
    ``op6_simhash`` at the radius this similarity asks for; see ``quire.llm.near``.
    """
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark passage go, however short it is beside the rest; null texts and repeated rows without one stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data is replaced in the texts; every row stays, null texts as nulls."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the columns of documents become counts and digests of token ids and of what they decode to; every row stays, null texts as empty ones."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_pii", redact_pii), ("tokenize", tokenize)]

#: SQL can express neither the network nor the hashes of the first two stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written to the shared folder, read again by the next and then removed; the last one's stays until the application ends."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{scratch(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        until_exit(spark, path)
        done = spark.read.parquet(path)
        if i:
            drop(docs)
        docs = done
    return docs
