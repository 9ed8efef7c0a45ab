"""``search_text``: many text queries against the chunk index at once.

Queries and chunks are embedded with the same embedder (``hash_embed`` by
default, or a model through ``embed_texts``), then the exact top-k operator
ranks chunks per query: ranks 1..k by (score desc, doc_id), no dedup, text
not truncated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.embed import MODEL_DIM, embed_texts, hash_embed
from tenderlake.operators.joins import reduce_to_keys
from tenderlake.operators.knn import top_k_similar
from tenderlake.session import write_once


def search_text(queries: DataFrame, chunks: DataFrame, k: int = 10, dim: int = MODEL_DIM,
                query_id: str = "query_id", query_text: str = "text",
                corpus_vectors: DataFrame | None = None, embedder_factory=None,
                **knn_options) -> DataFrame:
    """``corpus_vectors[doc_id, embedding]`` is the stored index; without it the
    chunk texts are embedded on the fly with the same embedder.  With
    ``embedder_factory`` a model embeds the queries (``query:`` role) and, when
    no index is given, the chunks (``passage:`` role); otherwise hashed vectors."""
    if embedder_factory is not None:
        qv = (embed_texts(queries.select(query_id, query_text), query_text, embedder_factory,
                          role="query", dim=dim)
              .select(query_id, "embedding"))
        cv = corpus_vectors if corpus_vectors is not None else \
            embed_texts(chunks.select("doc_id", "text"), "text", embedder_factory, role="passage",
                        dim=dim).select("doc_id", "embedding")
    else:
        qv = hash_embed(queries, query_id, query_text, dim)
        cv = corpus_vectors if corpus_vectors is not None else \
            hash_embed(chunks.select("doc_id", "text"), "doc_id", "text", dim)
    hits = top_k_similar(qv, cv.select("doc_id", "embedding"), k, query_id=query_id, corpus_id="doc_id", **knn_options)
    return _with_chunks(hits, chunks, query_id)


def _with_chunks(hits: DataFrame, chunks: DataFrame, query_id: str) -> DataFrame:
    """The top-k needs ids and vectors only; the few hits then fetch their chunks."""
    hits = write_once(hits, "hits")
    found = reduce_to_keys(chunks.select("doc_id", "ocid", "chunk_type", "text", "cpv_codes"), hits, "doc_id", written=True)
    return (hits.join(found, "doc_id")
            .select(query_id, "rank", "doc_id", "ocid", "chunk_type", "text", "cpv_codes", "score"))


def search_vectors(query_vectors: DataFrame, chunks: DataFrame, k: int = 10, query_id: str = "query_id",
                   **knn_options) -> DataFrame:
    """The same ranking for queries that already carry an ``embedding``."""
    hits = top_k_similar(query_vectors, chunks.select("doc_id", "embedding"), k, query_id=query_id, corpus_id="doc_id", **knn_options)
    return _with_chunks(hits, chunks, query_id)
