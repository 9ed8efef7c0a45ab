"""Change-only embedding: texts that were embedded before keep their vectors.

A stored table holds one vector for each content (``content`` is the SHA-256 of role and text).  A run embeds only contents
that it does not hold (left anti join), each distinct content once however many chunks share it, and adds them; then every
chunk takes the vector of its content.  A release that did not change costs no model call, a changed one only
those of its chunks whose text changed.

Cases: a null text has no content and no vector; equal texts share a vector; texts of different roles do not.  The text column goes to
the model only for new contents.  A content that many chunks share is one row on the vector side of the join, and its
chunks are left to AQE's skew splitting.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators.embed import MODEL_DIM, embed_texts
from tenderlake.session import write_once


def content_hash(text: Column, role: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{role}:"), text), 256)


def no_vectors(spark) -> DataFrame:
    """The empty table of a first run."""
    return spark.createDataFrame([], "content string, embedding array<float>")


def new_vectors(chunks: DataFrame, stored: DataFrame, embedder_factory: Callable, role: str = "passage", dim: int = MODEL_DIM,
                text_col: str = "text") -> DataFrame:
    """``content, embedding`` of the contents of ``chunks`` that ``stored`` does not hold, written once."""
    texts = chunks.select(content_hash(F.col(text_col), role).alias("content"), F.col(text_col).alias("text")).filter(F.col("content").isNotNull())
    fresh = texts.join(stored.select("content"), "content", "left_anti").dropDuplicates(["content"])
    return write_once(embed_texts(fresh, "text", embedder_factory, role=role, dim=dim).select("content", F.col("embedding").cast(S.VECTOR).alias("embedding")),
                      "new-vectors")


def embed_changed(chunks: DataFrame, stored: DataFrame, embedder_factory: Callable, role: str = "passage", dim: int = MODEL_DIM,
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``chunks`` with ``embedding``, the new rows for the stored table)."""
    added = new_vectors(chunks, stored, embedder_factory, role, dim, text_col)
    vectors = stored.select("content", "embedding").unionByName(added)
    keyed = chunks.drop("embedding").withColumn("content", content_hash(F.col(text_col), role))
    return keyed.join(vectors, "content", "left").drop("content"), added
