"""Listing, lookup and index queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.copartition import buckets_for, lookup, passes_for, write_copartitioned
from tenderlake.operators.listing import count_releases, get_releases, index_info, list_releases, summaries
from tenderlake.operators.metadata import release_metadata
from tenderlake.operators.paging import list_releases_located
from tenderlake.operators.postings import filter_with_postings, read_postings, write_postings
from tenderlake.plans.oracle_views import with_views
from tenderlake.plans.registry import ORACLE, joined, query, r6
from tenderlake.plans.sql_filters import sql_where
from tenderlake.session import scratch_path, write_once
from tenderlake.sources.stored import Views

LIST_VIEWS = ["releases", "release_nuts", "party_nuts", "release_cpvs"]
SUMMARY_SQL = """r.ocid, r.date, r.title, r.buyer_name, r.status, r.procurement_method,
       r.main_procurement_category, round(r.value_amount, 6) AS value_amount, r.value_currency,
       coalesce(r.submission_deadline, r.deadline) AS deadline, r.result_code, r.documents_url"""


def _meta(spark, sf_dir):
    return Views(spark, sf_dir).meta


def _present(df):
    return df.select("ocid", "date", "title", "buyer_name", "status", "procurement_method",
                     "main_procurement_category", r6("value_amount").alias("value_amount"),
                     "value_currency", "deadline", "result_code", "documents_url")


def _full_listing_sql(f: FilterSpec) -> str:
    return with_views(LIST_VIEWS, f"SELECT {SUMMARY_SQL} FROM releases r WHERE {sql_where(f, c=None)}")


def _register_listing(name: str, f: FilterSpec):
    @query(name, _full_listing_sql(f))
    def fn(spark, sf_dir):
        from tenderlake.operators.listing import filtered_releases, summaries
        return _present(summaries(filtered_releases(_meta(spark, sf_dir), f)))
    fn.__name__ = name


LISTING_CASES = {
    "filter_submission_deadline": FilterSpec(submission_deadline_after="1997-01-01",
                                             submission_deadline_before="1997-12-31T23:59:59Z"),
    "filter_result_code": FilterSpec(result_code="selec-w"),
    "filter_nuts_code": FilterSpec(nuts_code="DE2"),
    "filter_month": FilterSpec(month="1998-03"),
    "list_filter_cpv_prefix": FilterSpec(cpv_prefix="45"),
    "list_filter_all_shared": FilterSpec(main_procurement_category="goods", procurement_method="open",
                                         status="complete", value_min=50000.0, buyer_name="customer#00000",
                                         deadline_after="1995-06-01", tag="award", has_awards=True,
                                         eu_funded=False, location_nuts="DE"),
}
for _n, _f in LISTING_CASES.items():
    _register_listing(_n, _f)

PAGE_FILTER = FilterSpec(main_procurement_category="works", value_min=100000.0)


@query("list_releases_page", with_views(LIST_VIEWS, f"""
SELECT {SUMMARY_SQL} FROM releases r WHERE {sql_where(PAGE_FILTER, c=None)}
ORDER BY r.date DESC, r.ocid LIMIT 20 OFFSET 40"""), headline=True)
def list_releases_page(spark, sf_dir):
    return _present(list_releases(_meta(spark, sf_dir), PAGE_FILTER, limit=20, offset=40))


@query("list_releases_large_page", with_views(LIST_VIEWS, f"""
SELECT {SUMMARY_SQL} FROM releases r ORDER BY r.date DESC, r.ocid LIMIT 5000"""))
def list_releases_large_page(spark, sf_dir):
    """A page above the documented 200 that the caller asked for by name."""
    return _present(list_releases(_meta(spark, sf_dir), FilterSpec(), limit=5000, max_limit=5000))


@query("list_releases_deep_offset", with_views(LIST_VIEWS, f"""
SELECT {SUMMARY_SQL} FROM releases r ORDER BY r.date DESC, r.ocid LIMIT 50 OFFSET 12000"""))
def list_releases_deep_offset(spark, sf_dir):
    """Any offset is served."""
    return _present(list_releases(_meta(spark, sf_dir), FilterSpec(), limit=50, offset=12000))


@query("list_releases_located", with_views(LIST_VIEWS, f"""
SELECT {SUMMARY_SQL} FROM releases r ORDER BY r.date DESC, r.ocid LIMIT 50 OFFSET 12000"""))
def list_releases_located_page(spark, sf_dir):
    """The same page, found by counts: only the dates that it touches are sorted."""
    return _present(list_releases_located(_meta(spark, sf_dir), FilterSpec(), limit=50, offset=12000))


@query("list_releases_total", with_views(LIST_VIEWS, f"""
SELECT count(*) AS total FROM releases r WHERE {sql_where(PAGE_FILTER, c=None)}"""))
def list_releases_total(spark, sf_dir):
    return count_releases(_meta(spark, sf_dir), PAGE_FILTER)


POSTING_CASES = {
    "posting_cpv_prefix": FilterSpec(cpv_prefix="45"),
    "posting_location_nuts": FilterSpec(location_nuts="DE3"),
    "posting_nuts_code": FilterSpec(nuts_code="DE2"),
    "posting_buyer_name": FilterSpec(buyer_name="CUSTOMER#0000000"),
    "posting_buyer_short": FilterSpec(buyer_name="#0"),
    "posting_conjunction": FilterSpec(cpv_prefix="45", location_nuts="DE", buyer_name="customer#00000", status="active", value_min=100000.0),
}


def _register_posting(name: str, f: FilterSpec):
    @query(name, _full_listing_sql(f))
    def fn(spark, sf_dir):
        meta, path = write_once(_meta(spark, sf_dir), "posting-meta"), scratch_path(spark, "postings")       # planned once for all tables
        write_postings(meta, path)
        return _present(summaries(filter_with_postings(meta, read_postings(spark, path), f)))
    fn.__name__ = name


for _n, _f in POSTING_CASES.items():
    _register_posting(_n, _f)


KEYSET_AFTER = ("1998-01-01T00:00:00Z", "ocds-5")


@query("list_releases_keyset", with_views(LIST_VIEWS, f"""
SELECT {SUMMARY_SQL} FROM releases r
WHERE {sql_where(PAGE_FILTER, c=None)}
  AND (r.date < '{KEYSET_AFTER[0]}' OR (r.date = '{KEYSET_AFTER[0]}' AND r.ocid > '{KEYSET_AFTER[1]}'))
ORDER BY r.date DESC, r.ocid LIMIT 20"""))
def list_releases_keyset(spark, sf_dir):
    return _present(list_releases(_meta(spark, sf_dir), PAGE_FILTER, limit=20, after=KEYSET_AFTER))


@query("release_lookup", with_views(["chunks", "releases"], """
SELECT k.ocid, r.ocid IS NOT NULL AS found, r.title, r.status, r.buyer_name,
       array_to_string(r.tag, ',') AS tag
FROM (SELECT DISTINCT ocid FROM chunks) k LEFT JOIN releases r ON r.ocid = k.ocid"""))
def release_lookup(spark, sf_dir):
    t = Views(spark, sf_dir)
    keys = t.chunks.select("ocid").distinct()
    got = get_releases(keys, t.releases)
    return got.select("ocid", "found", F.col("tender.title").alias("title"),
                      F.col("tender.status").alias("status"), F.col("buyer.name").alias("buyer_name"),
                      F.array_join(F.col("tag"), ",").alias("tag"))


@query("release_lookup_copartitioned", ORACLE["release_lookup"])
def release_lookup_copartitioned(spark, sf_dir):
    """The same lookup on releases bucketed by ocid: only the keys are exchanged."""
    t = Views(spark, sf_dir)
    releases = t.releases
    buckets = buckets_for(releases, least=8)
    table = write_copartitioned(releases, f"releases_{uuid.uuid4().hex}", buckets=buckets, passes=passes_for(releases))
    got = lookup(t.chunks.select("ocid").distinct(), table, buckets=buckets)
    return got.select("ocid", "found", F.col("tender.title").alias("title"), F.col("tender.status").alias("status"), F.col("buyer.name").alias("buyer_name"),
                      F.array_join(F.col("tag"), ",").alias("tag"))


@query("index_info", with_views(["releases", "chunks", "profiles"], """
SELECT (SELECT count(*) FROM releases) AS api_release_count,
       (SELECT count(embedding) FROM chunks) AS api_embedding_count,
       (SELECT coalesce(CAST(max(len(embedding)) AS BIGINT), 0) FROM chunks) AS dimension,
       (SELECT count(*) FROM profiles) AS company_profile_count,
       (SELECT count(*) FROM profiles WHERE embedding IS NULL) AS unembedded_profile_count"""))
def q_index_info(spark, sf_dir):
    t = Views(spark, sf_dir)
    return index_info(t.releases, t.chunks, t.profiles)


@query("release_nuts", with_views(["releases", "release_nuts"], """
SELECT ocid, string_agg(nuts, ',' ORDER BY first_pos) AS location_nuts
FROM (SELECT ocid, nuts, min(pos) AS first_pos FROM release_nuts GROUP BY ocid, nuts)
GROUP BY ocid"""))
def q_release_nuts(spark, sf_dir):
    m = _meta(spark, sf_dir)
    return (m.filter(F.size("location_nuts") > 0)
             .select("ocid", joined("location_nuts", sort=False).alias("location_nuts")))


@query("release_metadata", with_views(LIST_VIEWS, f"""
SELECT {SUMMARY_SQL}, r.has_awards, r.eu_funded,
       coalesce((SELECT string_agg(DISTINCT p.nuts, ',' ORDER BY p.nuts) FROM party_nuts p WHERE p.ocid = r.ocid), '') AS party_nuts
FROM releases r"""))
def q_release_metadata(spark, sf_dir):
    """The projection of nested releases itself, row by row."""
    m = release_metadata(Views(spark, sf_dir).releases)
    extra = m.select("ocid", "has_awards", "eu_funded", joined("party_nuts").alias("party_nuts"))
    return _present(summaries(m)).join(extra, "ocid")
