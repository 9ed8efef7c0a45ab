"""Profile-to-tender matching.

One logical plan per call, for any number of profile requests at once:
resolve profiles -> vector top-k -> enrich with release metadata -> filter ->
best hit per OCID -> rank.

``mode="exact"`` (default) filters *before* the top-k and asks the top-k for
distinct OCIDs, so every request gets the true k best processes.
``mode="overfetch"`` reproduces the reference: fetch 3k (5k with filters)
chunks, then filter and dedup, which may return fewer than k.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.functions.text import (NO_EMBEDDING_MESSAGE, NOT_FOUND_MESSAGE, notice_url,
                                       truncate_utf8)
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tenderlake.operators.joins import reduce_to_keys
from tenderlake.operators.knn import PairFilter, top_k_similar
from tenderlake.operators.metadata import match_deadline
from tenderlake.session import write_once

MATCH_COLUMNS = ("profile_id", "rank", "doc_id", "ocid", "url", "chunk_type", "text", "cpv_codes",
                 "score", "title", "buyer_name", "procurement_method", "main_procurement_category",
                 "value_amount", "value_currency", "deadline", "documents_url")
META_OUT = ("notice_id", "title", "buyer_name", "procurement_method", "main_procurement_category",
            "value_amount", "value_currency", "deadline", "submission_deadline", "documents_url")


META_COLUMNS = META_OUT + ("has_awards", "tag", "eu_funded", "status", "location_nuts", "result_code", "party_nuts", "date")
HINT_CATEGORY_COL = "__hint_category"


def _hint_tables(qinfo: dict) -> dict:
    """Query-side lookup arrays, built once per executor (cached in the broadcast dict)."""
    cached = qinfo.get("__hint_tables")
    if cached is not None:
        return cached
    qcats, qcpvs = qinfo["categories"], qinfo["cpv_codes"]
    nq = len(qcats)
    vocab = sorted({c for cs in qcats for c in (cs or [])})
    pos = {c: i for i, c in enumerate(vocab)}
    allowed = np.zeros((len(vocab) + 1, nq), dtype=bool)        # last row: category not listed / NULL
    qdiv = np.zeros((100, nq), dtype=np.float32)
    for j, (cs, cp) in enumerate(zip(qcats, qcpvs)):
        for c in cs or []:
            allowed[pos[c], j] = True
        for c in cp or []:
            if len(c) >= 2 and c[:2].isdigit():
                qdiv[int(c[:2]), j] = 1.0
    tables = {"vocab": pa.array(vocab, type=pa.string()), "allowed": allowed, "qdiv": qdiv,
              "any_cat": np.array([not cs for cs in qcats])[None, :],
              "any_cpv": np.array([not cs for cs in qcpvs])[None, :]}
    qinfo["__hint_tables"] = tables
    return tables


def _hint_mask(qinfo: dict, batch: pa.RecordBatch) -> np.ndarray:
    """Profile hints: release category in the profile's categories (if it lists any) and a chunk CPV
    code sharing its 2-digit division with one of the profile's CPV codes (if it lists any)."""
    h = _hint_tables(qinfo)
    n = batch.num_rows
    idx = pc.index_in(batch.column(HINT_CATEGORY_COL), value_set=h["vocab"])
    row_cat = idx.fill_null(len(h["vocab"])).to_numpy(zero_copy_only=False).astype(np.int64)
    cat_ok = h["allowed"][row_cat] | h["any_cat"]
    codes = batch.column("cpv_codes")
    lengths = pc.list_value_length(codes).fill_null(0).to_numpy(zero_copy_only=False)
    heads = pc.utf8_slice_codeunits(pc.list_flatten(codes), 0, 2)
    ok = pc.and_(pc.utf8_is_digit(heads), pc.equal(pc.utf8_length(heads), 2)).fill_null(False)
    rows = np.repeat(np.arange(n), lengths)
    ok_np = ok.to_numpy(zero_copy_only=False)
    divs = pc.cast(pc.if_else(ok, heads, "-1"), pa.int64()).to_numpy(zero_copy_only=False)
    rdiv = np.zeros((n, 100), dtype=np.float32)
    rdiv[rows[ok_np], divs[ok_np]] = 1.0
    cpv_ok = (rdiv @ h["qdiv"] > 0) | h["any_cpv"]
    return cat_ok & cpv_ok


PROFILE_HINTS = PairFilter(query_cols=("categories", "cpv_codes"),
                           corpus_cols=(HINT_CATEGORY_COL, "cpv_codes"), fn=_hint_mask)


def resolve_profiles(requests: DataFrame, profiles: DataFrame, id_col: str = "profile_id",
                     with_hints: bool = False) -> DataFrame:
    """Three outcomes per request: ``ready`` (has a vector), ``no_embedding``, ``not_found`` (C4)."""
    hints = ["categories", "cpv_codes"] if with_hints else []
    p = profiles.select(F.col("id").alias(id_col), "embedding", *hints, F.lit(True).alias("__exists"))
    p = reduce_to_keys(p, requests, id_col)
    j = requests.select(id_col).join(p, id_col, "left")
    status = (F.when(F.col("embedding").isNotNull(), F.lit("ready"))
               .when(F.col("__exists"), F.lit("no_embedding"))
               .otherwise(F.lit("not_found")))
    message = (F.when(F.col("embedding").isNotNull(), F.lit(None).cast("string"))
                .when(F.col("__exists"), F.lit(NO_EMBEDDING_MESSAGE))
                .otherwise(F.concat(F.lit(NOT_FOUND_MESSAGE), F.col(id_col))))
    return j.select(id_col, status.alias("status"), message.alias("message"), "embedding", *hints)


def hit_ocids(hits: DataFrame) -> DataFrame:
    """Distinct OCIDs of a hit list (D3)."""
    return hits.select("ocid").distinct()


def enrich(hits: DataFrame, meta: DataFrame, written: bool = False) -> DataFrame:
    """Left join hits to release metadata on ``ocid`` (C1); missing releases keep the hit.

    The hit list is small (queries x k), the metadata large.  The hits are written once (so the
    top-k over the corpus runs once) and the metadata is reduced to their OCIDs before the join."""
    hits = hits if written else write_once(hits, "hits")
    return hits.join(reduce_to_keys(meta, hits, "ocid", written=True), "ocid", "left")


def dedup_by_ocid(df: DataFrame, group: str = "profile_id") -> DataFrame:
    """Best-scoring hit per (request, OCID); ties keep the earlier hit (lower doc_id)."""
    w = Window.partitionBy(group, "ocid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def rank_top(df: DataFrame, k: int, group: str = "profile_id", rank_col: str = "rank") -> DataFrame:
    """Number rows 1..k per request in (score desc, doc_id) order."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (df.withColumn(rank_col, F.row_number().over(w).cast("long"))
              .filter(F.col(rank_col) <= k))


def _shape(df: DataFrame, text_bytes: int) -> DataFrame:
    return df.select(
        "profile_id", "rank", "doc_id", "ocid",
        notice_url(F.col("notice_id")).alias("url"),
        "chunk_type",
        truncate_utf8(F.col("text"), text_bytes).alias("text"),
        "cpv_codes", "score", "title", "buyer_name", "procurement_method",
        "main_procurement_category", "value_amount", "value_currency",
        match_deadline().alias("deadline"), "documents_url")


def _with_chunk(rows: DataFrame, hits: DataFrame, chunks: DataFrame, *cols: str) -> DataFrame:
    """Columns of the hit chunks; ``hits``: a written table with the ids of ``rows``."""
    return rows.join(reduce_to_keys(chunks.select("doc_id", *cols), hits, "doc_id", written=True), "doc_id")


def match_tenders(requests: DataFrame, profiles: DataFrame, chunks: DataFrame, meta: DataFrame,
                  filters: FilterSpec = FilterSpec(), k: int = 10, mode: str = "exact",
                  text_bytes: int = 200, use_profile_hints: bool = False, **knn_options) -> DataFrame:
    """Ranked tender matches for every ``ready`` request (columns ``MATCH_COLUMNS``).

    Like the reference, a profile's own CPV codes and categories are ignored
    unless ``use_profile_hints=True``; then each profile only matches chunks of
    its categories and CPV divisions (an exact per-pair rule inside the top-k)."""
    if k <= 0:
        raise ValueError("k must be positive")
    resolved = resolve_profiles(requests, profiles, with_hints=use_profile_hints)
    hint_cols = ["categories", "cpv_codes"] if use_profile_hints else []
    queries = (resolved.filter(F.col("status") == "ready")
                       .select(F.col("profile_id"), F.col("embedding"), *hint_cols))
    # The top-k scan carries ids, keys and vectors; texts and metadata are joined to the hits.
    corpus = chunks.select("doc_id", "ocid", "embedding", "cpv_codes")
    if use_profile_hints:
        cats = meta.select("ocid", F.col("main_procurement_category").alias(HINT_CATEGORY_COL))
        corpus = corpus.join(cats, "ocid", "left")
        knn_options = dict(knn_options, pair_filter=PROFILE_HINTS)
    meta = meta.select("ocid", *META_COLUMNS)

    if mode == "overfetch":
        fetch_k = 5 * k if (filters.has_any() or use_profile_hints) else 3 * k
        hits = write_once(top_k_similar(queries, corpus, fetch_k, query_id="profile_id", corpus_id="doc_id", through=["ocid"],
                                        rank_col="hit_rank", **knn_options), "hits")
        joined = enrich(hits, meta, written=True)
        if filters.cpv_prefix is not None:
            joined = _with_chunk(joined, hits, chunks, "cpv_codes")
        out = rank_top(dedup_by_ocid(joined.filter(filters.column(cpv_col="cpv_codes"))), k).drop("cpv_codes")
    elif mode == "exact":
        if filters.cpv_prefix is not None:
            corpus = corpus.filter(FilterSpec(cpv_prefix=filters.cpv_prefix).column(cpv_col="cpv_codes"))
        if filters.needs_release():
            release_part = dataclasses.replace(filters, cpv_prefix=None)
            corpus = reduce_to_keys(corpus, meta.filter(release_part.column()), "ocid")
        hits = write_once(top_k_similar(queries, corpus, k, query_id="profile_id", corpus_id="doc_id", distinct_by="ocid",
                                        **knn_options), "hits")
        out = enrich(hits, meta, written=True)
    else:
        raise ValueError("mode must be 'exact' or 'overfetch'")
    return _shape(_with_chunk(out, hits, chunks, "chunk_type", "text", "cpv_codes"), text_bytes)
