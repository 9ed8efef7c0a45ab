"""Top-k, matching and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.functions.text import NO_EMBEDDING_MESSAGE, NOTICE_BASE_URL, NOT_FOUND_MESSAGE
from tenderlake.operators.knn import top_k_similar
from tenderlake.operators.knn_pruned import build_cells, pruned_top_k
from tenderlake.operators.matching import (dedup_by_ocid, enrich, hit_ocids, match_tenders,
                                           resolve_profiles)
from tenderlake.plans.oracle_views import cosine_sql, with_views
from tenderlake.plans.registry import joined, query, r6
from tenderlake.plans.sql_filters import sql_where, truncate_sql
from tenderlake.session import scratch_path, write_once
from tenderlake.sources.stored import Views

K = 10
NOTICE_URL_SQL = f"'{NOTICE_BASE_URL}'"


def _ready_queries(t: Views):
    res = resolve_profiles(t.requests, t.profiles)
    return res.filter(F.col("status") == "ready").select("profile_id", "embedding")


def _present_matches(df):
    return df.select("profile_id", "rank", "doc_id", "ocid", "url", "chunk_type", "text",
                     joined("cpv_codes").alias("cpv_codes"), r6("score").alias("score"), "title",
                     "buyer_name", "procurement_method", "main_procurement_category",
                     r6("value_amount").alias("value_amount"), "value_currency", "deadline",
                     "documents_url")


def run_match(spark, sf_dir, filters: FilterSpec = FilterSpec(), k: int = K, mode: str = "exact",
              hints: bool = False):
    t = Views(spark, sf_dir)
    meta = t.meta
    out = match_tenders(t.requests, t.profiles, t.chunks, meta, filters, k=k, mode=mode, use_profile_hints=hints)
    return _present_matches(out)


# ---------------------------------------------------------------- oracle SQL

_READY = "SELECT q.profile_id, p.embedding FROM requests q JOIN profiles p ON p.id = q.profile_id WHERE p.embedding IS NOT NULL"
_MATCH_OUT = f"""
SELECT m.profile_id, CAST(m.rank AS BIGINT) AS rank, m.doc_id, m.ocid,
       {NOTICE_URL_SQL} || r2.notice_id AS url, m.chunk_type, {truncate_sql('m.text')} AS text,
       array_to_string(list_sort(m.cpv_codes), ',') AS cpv_codes, round(m.score, 6) AS score,
       r2.title, r2.buyer_name, r2.procurement_method, r2.main_procurement_category,
       round(r2.value_amount, 6) AS value_amount, r2.value_currency,
       coalesce(r2.submission_deadline, r2.deadline) AS deadline, r2.documents_url
FROM ranked m LEFT JOIN releases r2 ON r2.ocid = m.ocid
WHERE m.rank <= {{k}}
"""


HINT_SQL = ("(len(ph.categories) = 0 OR coalesce(list_contains(ph.categories, rh.main_procurement_category), FALSE)) "
            "AND (len(ph.cpv_codes) = 0 OR list_has_any(list_transform(c.cpv_codes, lambda x: substr(x, 1, 2)), "
            "list_transform(ph.cpv_codes, lambda y: substr(y, 1, 2))))")
HINT_JOIN = "JOIN profiles ph ON ph.id = q.profile_id LEFT JOIN releases rh ON rh.ocid = c.ocid"


def match_ctes(filters: FilterSpec = FilterSpec(), k: int = K, mode: str = "exact", hints: bool = False):
    """(views, extra CTEs) ending in ``ranked``: the DuckDB twin of ``match_tenders``."""
    cond = sql_where(filters, r="r", c="c")
    score = cosine_sql("q.embedding", "c.embedding")
    hjoin = HINT_JOIN if hints else ""
    hcond = HINT_SQL if hints else "TRUE"
    views = ["requests", "profiles", "chunks", "releases", "release_nuts", "party_nuts"]
    if mode == "exact":
        join = "JOIN releases r ON r.ocid = c.ocid" if filters.needs_release() else "LEFT JOIN releases r ON r.ocid = c.ocid"
        extra = [
            ("ready", _READY),
            ("scored", f"SELECT q.profile_id, c.doc_id, c.ocid, c.chunk_type, c.text, c.cpv_codes, {score} AS score "
                       f"FROM ready q CROSS JOIN chunks c {join} {hjoin} "
                       f"WHERE c.embedding IS NOT NULL AND {cond} AND {hcond}"),
        ]
    else:
        fetch_k = 5 * k if (filters.has_any() or hints) else 3 * k
        extra = [
            ("ready", _READY),
            ("allscored", f"SELECT q.profile_id, c.doc_id, c.ocid, c.chunk_type, c.text, c.cpv_codes, {score} AS score "
                          f"FROM ready q CROSS JOIN chunks c {hjoin} WHERE c.embedding IS NOT NULL AND {hcond}"),
            ("hits", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, doc_id) AS hit_rank "
                     f"FROM allscored) WHERE hit_rank <= {fetch_k}"),
            ("scored", f"SELECT c.* FROM hits c LEFT JOIN releases r ON r.ocid = c.ocid WHERE {cond}"),
        ]
    extra += [
        ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, ocid ORDER BY score DESC, doc_id) AS rn "
                 "FROM scored) WHERE rn = 1"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, doc_id) AS rank FROM best"),
    ]
    return views, extra


def match_sql(filters: FilterSpec = FilterSpec(), k: int = K, mode: str = "exact", hints: bool = False) -> str:
    views, extra = match_ctes(filters, k, mode, hints)
    return with_views(views, _MATCH_OUT.format(k=k), extra)


# ------------------------------------------------------------------ queries

@query("chunk_scan", with_views(["chunks"], """
SELECT doc_id, ocid, chunk_type, text, array_to_string(cpv_codes, ',') AS cpv_codes,
       CAST(len(embedding) AS BIGINT) AS dim FROM chunks"""))
def chunk_scan(spark, sf_dir):
    c = Views(spark, sf_dir).chunks
    return c.select("doc_id", "ocid", "chunk_type", "text", joined("cpv_codes").alias("cpv_codes"),
                    F.size("embedding").cast("long").alias("dim"))


@query("knn_topk", with_views(["requests", "profiles", "chunks"], f"""
SELECT profile_id, CAST(rank AS BIGINT) AS rank, doc_id, ocid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.profile_id, c.doc_id, c.ocid, {cosine_sql('q.embedding', 'c.embedding')} AS score
    FROM ready q CROSS JOIN chunks c WHERE c.embedding IS NOT NULL))
WHERE rank <= {K}""", [("ready", _READY)]), headline=True)
def knn_topk(spark, sf_dir):
    t = Views(spark, sf_dir)
    hits = top_k_similar(_ready_queries(t), t.chunks, K, query_id="profile_id", through=["ocid"])
    return hits.select("profile_id", "rank", "doc_id", "ocid", r6("score").alias("score"))


@query("knn_topk_blocked", with_views(["requests", "profiles", "chunks"], f"""
SELECT profile_id, CAST(rank AS BIGINT) AS rank, doc_id, ocid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.profile_id, c.doc_id, c.ocid, {cosine_sql('q.embedding', 'c.embedding')} AS score
    FROM ready q CROSS JOIN chunks c WHERE c.embedding IS NOT NULL))
WHERE rank <= {K}""", [("ready", _READY)]))
def knn_topk_blocked(spark, sf_dir):
    """Same result with the queries cut into many blocks, as for query sets beyond one block."""
    t = Views(spark, sf_dir)
    hits = top_k_similar(_ready_queries(t), t.chunks, K, query_id="profile_id", through=["ocid"],
                         block_bytes=2 * 8 * 64)
    return hits.select("profile_id", "rank", "doc_id", "ocid", r6("score").alias("score"))


@query("knn_topk_pruned", with_views(["requests", "profiles", "chunks"], f"""
SELECT profile_id, CAST(rank AS BIGINT) AS rank, doc_id, ocid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.profile_id, c.doc_id, c.ocid, {cosine_sql('q.embedding', 'c.embedding')} AS score
    FROM ready q CROSS JOIN chunks c WHERE c.embedding IS NOT NULL))
WHERE rank <= {K}""", [("ready", _READY)]))
def knn_topk_pruned(spark, sf_dir):
    """Same result over cells of a pivot index, built here from the chunks; cells out of reach are not read."""
    t = Views(spark, sf_dir)
    cells = build_cells(t.chunks, scratch_path(spark, "cells"), through=["ocid"])
    hits, _ = pruned_top_k(_ready_queries(t), cells, K, query_id="profile_id", through=["ocid"])
    return hits.select("profile_id", "rank", "doc_id", "ocid", r6("score").alias("score"))


@query("match_tenders", match_sql(mode="overfetch"), headline=True)
def q_match_tenders(spark, sf_dir):
    return run_match(spark, sf_dir, mode="overfetch")


@query("match_tenders_exact", match_sql(mode="exact"), headline=True)
def q_match_tenders_exact(spark, sf_dir):
    return run_match(spark, sf_dir, mode="exact")


@query("profile_match_status", with_views(["requests", "profiles"], f"""
SELECT q.profile_id,
       CASE WHEN p.embedding IS NOT NULL THEN 'ready' WHEN p.id IS NOT NULL THEN 'no_embedding' ELSE 'not_found' END AS status,
       CASE WHEN p.embedding IS NOT NULL THEN NULL
            WHEN p.id IS NOT NULL THEN '{NO_EMBEDDING_MESSAGE}'
            ELSE '{NOT_FOUND_MESSAGE}' || q.profile_id END AS message
FROM requests q LEFT JOIN profiles p ON p.id = q.profile_id"""))
def profile_match_status(spark, sf_dir):
    t = Views(spark, sf_dir)
    return resolve_profiles(t.requests, t.profiles).select("profile_id", "status", "message")


_HITS30 = [("ready", _READY),
           ("hits", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, doc_id) AS hit_rank
               FROM (SELECT q.profile_id, c.doc_id, c.ocid, {cosine_sql('q.embedding', 'c.embedding')} AS score
                     FROM ready q CROSS JOIN chunks c WHERE c.embedding IS NOT NULL)) WHERE hit_rank <= {3 * K}""")]


def _hits30(t):
    return top_k_similar(_ready_queries(t), t.chunks, 3 * K, query_id="profile_id", through=["ocid"],
                         rank_col="hit_rank")


@query("hit_ocids", with_views(["requests", "profiles", "chunks"], "SELECT DISTINCT ocid FROM hits", _HITS30))
def q_hit_ocids(spark, sf_dir):
    return hit_ocids(_hits30(Views(spark, sf_dir)))


@query("match_dedup", with_views(["requests", "profiles", "chunks"], """
SELECT profile_id, ocid, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id, ocid ORDER BY score DESC, doc_id) AS rn FROM hits) WHERE rn = 1""",
                                  _HITS30))
def q_match_dedup(spark, sf_dir):
    d = dedup_by_ocid(_hits30(Views(spark, sf_dir)))
    return d.select("profile_id", "ocid", "doc_id", r6("score").alias("score"))


@query("match_enriched", with_views(["requests", "profiles", "chunks", "releases"], f"""
SELECT h.profile_id, CAST(h.hit_rank AS BIGINT) AS hit_rank, h.doc_id, h.ocid,
       {NOTICE_URL_SQL} || r.notice_id AS url, r.title, r.buyer_name, r.status,
       r.has_awards, r.ocid IS NOT NULL AS found
FROM hits h LEFT JOIN releases r ON r.ocid = h.ocid""", _HITS30))
def q_match_enriched(spark, sf_dir):
    from tenderlake.functions.text import notice_url
    t = Views(spark, sf_dir)
    meta = t.meta.withColumn("__found", F.lit(True))
    e = enrich(_hits30(t), meta)
    return e.select("profile_id", "hit_rank", "doc_id", "ocid", notice_url(F.col("notice_id")).alias("url"),
                    "title", "buyer_name", "status", "has_awards",
                    F.coalesce(F.col("__found"), F.lit(False)).alias("found"))


# ------------------------------------------------ filters (exact mode, SURVEY B1-B13, B18)

FILTER_CASES: dict[str, FilterSpec] = {
    "filter_cpv_prefix": FilterSpec(cpv_prefix="45"),
    "filter_category": FilterSpec(main_procurement_category="works"),
    "filter_method": FilterSpec(procurement_method="open"),
    "filter_status": FilterSpec(status="active"),
    "filter_value_range": FilterSpec(value_min=100000.0, value_max=300000.0),
    "filter_buyer": FilterSpec(buyer_name="CUSTOMER#0000000"),
    "filter_deadline": FilterSpec(deadline_after="1996-06-01", deadline_before="1999-06-01"),
    "filter_tag": FilterSpec(tag="award"),
    "filter_has_awards": FilterSpec(has_awards=True),
    "filter_has_awards_false": FilterSpec(has_awards=False),
    "filter_eu_funded": FilterSpec(eu_funded=True),
    "filter_eu_funded_false": FilterSpec(eu_funded=False),
    "filter_location_nuts": FilterSpec(location_nuts="DE3"),
    "filter_conjunction": FilterSpec(status="active", value_min=100000.0, cpv_prefix="45"),
}
OVERFETCH_CASES = {
    "match_overfetch_cpv_prefix": FilterSpec(cpv_prefix="45"),
    "match_overfetch_conjunction": FilterSpec(status="active", value_min=100000.0, cpv_prefix="45"),
    "match_overfetch_has_awards_false": FilterSpec(has_awards=False),
}


def _register_filter(name: str, spec: FilterSpec, mode: str):
    @query(name, match_sql(spec, mode=mode))
    def fn(spark, sf_dir):
        return run_match(spark, sf_dir, spec, mode=mode)
    fn.__name__ = name
    return fn


for _n, _s in FILTER_CASES.items():
    _register_filter(_n, _s, "exact")
for _n, _s in OVERFETCH_CASES.items():
    _register_filter(_n, _s, "overfetch")


@query("match_profile_hints", match_sql(mode="exact", hints=True))
def q_match_profile_hints(spark, sf_dir):
    """Opt-in: each profile only matches its own categories and CPV divisions."""
    return run_match(spark, sf_dir, mode="exact", hints=True)


@query("match_profile_hints_overfetch", match_sql(FilterSpec(status="complete"), mode="overfetch", hints=True))
def q_match_profile_hints_overfetch(spark, sf_dir):
    return run_match(spark, sf_dir, FilterSpec(status="complete"), mode="overfetch", hints=True)


@query("alert_lists_running", with_views(*match_ctes()[:1], "SELECT profile_id, CAST(rank AS BIGINT) AS rank, doc_id, ocid, round(score, 6) AS score "
                                         f"FROM ranked WHERE rank <= {K}", match_ctes()[1]))
def alert_lists_running(spark, sf_dir):
    """Lists kept over three batches of chunks equal the lists of all chunks at once."""
    from tenderlake.streaming.alerts import running_step
    t = Views(spark, sf_dir)
    profiles, meta, lists = write_once(t.profiles, "profiles"), t.meta, None
    chunks = write_once(t.chunks, "chunks").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    for k in range(3):
        lists, _ = running_step(lists, chunks.filter(F.col("_part") == k).drop("_part"), profiles, meta, k=K)
    return lists.select("profile_id", "rank", "doc_id", "ocid", r6("score").alias("score"))
