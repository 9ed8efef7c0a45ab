"""Text -> vector jobs.

J2 ``hash_embed``: model-free lexical vectors (hashed token counts, L2
normalised).  It is *not* semantic; it lets text search run without a model.
Tokens are exploded and counted with a partially aggregated
``groupBy(id, bucket)``, so a document of any length becomes at most ``dim``
rows per map task before the shuffle, and the whole text is always used.

J1 ``embed_texts``: a caller-supplied batch model inside ``mapInArrow``:
role prefix, token limit, masked mean pooling, L2 normalisation and a width
check run per Arrow batch; the model is built once per Python worker.

D7 ``mean_pool``: masked mean pooling of token states as a Spark job.
"""

from __future__ import annotations

from typing import Callable, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S
from tenderlake.functions.text import PASSAGE_PREFIX, QUERY_PREFIX
from tenderlake.functions.vectors import l2_normalize

# Fixed values of the embedding contract.
MODEL_DIM = 384
MAX_TOKENS = 512
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def hash_buckets(df: DataFrame, id_col: str, text_col: str, dim: int = MODEL_DIM) -> DataFrame:
    """Sparse hashed counts: ``id, bucket, count`` (buckets with count > 0)."""
    tokens = df.select(F.col(id_col), F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("tok"))
    bucket = (F.conv(F.substring(F.md5(F.col("tok")), 1, 8), 16, 10).cast("long") % F.lit(dim)).cast("int")
    return (tokens.filter(F.col("tok") != F.lit(""))
                  .groupBy(F.col(id_col), bucket.alias("bucket"))
                  .agg(F.count(F.lit(1)).alias("count")))


def _densify(batches, id_col: str, dim: int, out_col: str):
    """(id, buckets, counts) Arrow batches -> (id, unit float vector of width ``dim``)."""
    for b in batches:
        n = b.num_rows
        buckets = b.column("buckets")
        counts = b.column("counts")
        lengths = pc.list_value_length(buckets).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), lengths)
        dense = np.zeros((n, dim), dtype=np.float64)
        dense[rows, pc.list_flatten(buckets).to_numpy(zero_copy_only=False)] = \
            pc.list_flatten(counts).to_numpy(zero_copy_only=False)
        norm = np.linalg.norm(dense, axis=1, keepdims=True)
        unit = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0).astype(np.float32)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)),
                                       pa.array(unit.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(id_col), vec], names=[id_col, out_col])


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = MODEL_DIM,
               out_col: str = "embedding") -> DataFrame:
    """Dense unit ``array<float>`` of width ``dim`` per id; a text without tokens has the zero vector.

    Per id at most ``dim`` (bucket, count) pairs are collected, then an Arrow
    batch scatters them into dense rows and normalises them with numpy."""
    sparse = hash_buckets(df, id_col, text_col, dim)
    every = df.select(id_col, F.lit(None).cast(sparse.schema["bucket"].dataType).alias("bucket"),
                      F.lit(None).cast(sparse.schema["count"].dataType).alias("count"))
    # the marker row of each id has no bucket; collect_list leaves its nulls out
    per_doc = (sparse.select(id_col, "bucket", "count").unionByName(every).groupBy(id_col)
                     .agg(F.collect_list("bucket").alias("buckets"), F.collect_list("count").alias("counts")))
    schema = T.StructType([df.schema[id_col], T.StructField(out_col, S.VECTOR)])
    return per_doc.mapInArrow(lambda it: _densify(it, id_col, dim, out_col), schema)


def mean_pool(tokens: DataFrame, text_col: str = "text_id", pos_col: str = "pos",
              mask_col: str = "mask", hidden_col: str = "hidden", normalize: bool = True) -> DataFrame:
    """Masked mean of token vectors per text and dimension, then L2 normalised.

    Token vectors are summed per text within each Arrow batch, so a text contributes one row a batch
    to the shuffle, not one a token and dimension.  A text whose tokens are all masked gets a zero vector."""
    id_field = tokens.schema[text_col]

    def partial(batches):
        for b in batches:
            if not b.num_rows:
                continue
            live = pc.and_(pc.greater(b.column(mask_col), 0), pc.is_valid(b.column(hidden_col))).fill_null(False)
            codes = b.column(text_col).dictionary_encode()
            group = codes.indices.to_numpy(zero_copy_only=False) if not codes.null_count else \
                codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            on = live.to_numpy(zero_copy_only=False)
            n_groups = int(group.max()) + 1
            counts = np.bincount(group[on], minlength=n_groups)
            width = pc.max(pc.list_value_length(b.column(hidden_col))).as_py() or 0
            sums = np.zeros((n_groups, width))
            kept = b.column(hidden_col).filter(live)
            if len(kept):
                flat = pc.list_flatten(kept).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), -1)
                order = np.argsort(group[on], kind="stable")
                g = group[on][order]
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                sums[g[starts]] = np.add.reduceat(flat[order], starts, axis=0)
            first = np.full(n_groups, -1)
            first[group[::-1]] = np.arange(len(group))[::-1]
            seen = np.flatnonzero(first >= 0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(seen) * width + 1, width or 1, dtype=np.int32)[:len(seen) + 1]
                                                    if width else np.zeros(len(seen) + 1, np.int32)), pa.array(sums[seen].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(text_col).take(pa.array(first[seen])), pa.array(counts[seen].astype(np.int64)), vec],
                                             names=[text_col, "n", "s"])

    schema = T.StructType([id_field, T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    parts = tokens.select(text_col, mask_col, hidden_col).mapInArrow(partial, schema)
    add = lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.zip_with(acc, x, lambda p, q: p + q))
    per_text = parts.groupBy(text_col).agg(F.sum("n").alias("n"), F.collect_list("s").alias("parts"))   # one part a batch
    total = F.aggregate("parts", F.array().cast("array<double>"), add)
    vec = per_text.select(text_col, "n", total.alias("s")).select(
        text_col, F.transform("s", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0))).alias("embedding"))
    if normalize:
        vec = vec.withColumn("embedding", l2_normalize("embedding", as_float=False))
    return vec


# ------------------------------------------------------------ J1: model-based

class BatchEmbedder(Protocol):
    """What ``embed_texts`` needs from a model: token ids and hidden states."""

    def tokenize(self, texts: list[str], max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """-> (ids, mask), both (batch, seq); padded to the longest text."""

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """-> hidden states (batch, seq, dim)."""


class EmbedderMissing(RuntimeError):
    pass


def pool_and_normalize(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over the sequence axis, then unit length; zero tokens give a zero vector."""
    m = (mask > 0).astype(np.float64)[:, :, None]
    s = (hidden.astype(np.float64) * m).sum(axis=1)
    n = m.sum(axis=1)
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.divide(mean, norm, out=np.zeros_like(mean), where=norm > 0)


FORWARD_TEXTS = 64                  # texts that go through the model at once


def embed_texts(df: DataFrame, text_col: str, embedder_factory: Callable[[], BatchEmbedder] | None,
                role: str = "query", dim: int = MODEL_DIM, max_tokens: int = MAX_TOKENS,
                out_col: str = "embedding") -> DataFrame:
    """Append ``out_col`` (``array<float>`` of width ``dim``) computed by a batch model.

    ``embedder_factory`` is called once per task, on its first text; a missing model is an error at
    plan time, not an empty result.  Texts go through the model ``FORWARD_TEXTS`` at a time, so memory
    does not depend on the Arrow batch size."""
    if embedder_factory is None:
        raise EmbedderMissing("no embedding model supplied; pass embedder_factory")
    if role not in ("query", "passage"):
        raise ValueError("role must be 'query' or 'passage'")
    prefix = QUERY_PREFIX if role == "query" else PASSAGE_PREFIX
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, S.VECTOR)])

    def run(batches):
        model = None
        for b in batches:
            texts = b.column(text_col).to_pylist()
            live = [i for i, t in enumerate(texts) if t is not None]
            rows = np.zeros((len(texts), dim), np.float32)
            for lo in range(0, len(live), FORWARD_TEXTS):
                model = model or embedder_factory()
                some = live[lo:lo + FORWARD_TEXTS]
                ids, mask = model.tokenize([prefix + texts[i] for i in some], max_tokens)
                hidden = model.forward(ids, mask)
                if hidden.ndim != 3 or hidden.shape[2] != dim:
                    raise ValueError(f"model output shape {hidden.shape}, expected (batch, seq, {dim})")
                rows[some] = pool_and_normalize(hidden, mask)
            null = np.ones(len(texts), bool)
            null[live] = False
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim, dtype=np.int32)), pa.array(rows.ravel()), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays(list(b.columns) + [arr], names=list(b.schema.names) + [out_col])

    return df.mapInArrow(run, out_schema)
