"""From raw documents to training tokens: five stages, each one operator of ``tenderlake.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the next stage reads it from
Parquet.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderlake.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality_nbsvm
from tenderlake.llm.common import documents, stage_table
from tenderlake.llm.queries import BYTE_BPE_RANKS, tokenizer_path
from tenderlake.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_nbsvm.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_nbsvm.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one stays."""
    return jaccard_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian int32) with digests of the ids and of the bytes decoded from them."""
    path = tokenizer_path(BYTE_BPE_RANKS)
    return byte_bpe.encode(docs, path, keep=("source",), digests=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]

#: SQL expresses neither the classifier nor the byte-pair merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
