"""Release listing, lookup and index statistics.

Listing pages use ``orderBy(date desc, ocid).offset(o).limit(l)`` which Spark
plans as a distributed top-(o+l) (``TakeOrderedAndProject``); deep pages use
keyset paging (``after``), which is a pushed-down range filter plus the same
top-l, so the cost does not grow with the page number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.joins import reduce_to_keys
from tenderlake.operators.metadata import match_deadline
from tenderlake.session import write_once

DEFAULT_LIMIT = 20
MAX_LIMIT = 200                 # the page size the tool documents; a larger page must be asked for by name
SUMMARY_COLUMNS = ("ocid", "date", "title", "buyer_name", "status", "procurement_method",
                   "main_procurement_category", "value_amount", "value_currency", "deadline",
                   "result_code", "documents_url")


def page_bounds(limit: int | None, offset: int | None, max_limit: int = MAX_LIMIT) -> tuple[int, int]:
    """Defaults for a page; a limit outside 1..``max_limit`` or a negative offset is an error, never cut."""
    lim = DEFAULT_LIMIT if limit is None else int(limit)
    off = 0 if offset is None else int(offset)
    if not 1 <= lim <= max_limit:
        raise ValueError(f"limit {lim} is not in 1..{max_limit}; pass max_limit for larger pages")
    if off < 0:
        raise ValueError("offset must not be negative")
    return lim, off


def filtered_releases(meta: DataFrame, filters: FilterSpec = FilterSpec()) -> DataFrame:
    """All releases passing the filters; the listing CPV prefix reads the release's item codes."""
    return meta.filter(filters.column(cpv_col="release_cpv_codes"))


def summaries(df: DataFrame) -> DataFrame:
    return df.select("ocid", "date", "title", "buyer_name", "status", "procurement_method",
                     "main_procurement_category", "value_amount", "value_currency",
                     match_deadline().alias("deadline"), "result_code", "documents_url")


def list_releases(meta: DataFrame, filters: FilterSpec = FilterSpec(), limit: int | None = None,
                  offset: int | None = None, after: tuple[str, str] | None = None,
                  max_limit: int = MAX_LIMIT) -> DataFrame:
    """One page of release summaries, newest first (``date desc, ocid asc``).

    Any offset works; its cost grows with the offset.  ``after=(date, ocid)`` continues after the last
    row of the previous page instead (keyset paging) and costs what the first page costs."""
    lim, off = page_bounds(limit, offset, max_limit)
    df = filtered_releases(meta, filters)
    if after is not None:
        d, o = after
        df = df.filter((F.col("date") < F.lit(d)) | ((F.col("date") == F.lit(d)) & (F.col("ocid") > F.lit(o))))
        off = 0
    page = df.orderBy(F.col("date").desc(), F.col("ocid").asc())
    if off:
        page = page.offset(off)
    return summaries(page.limit(lim))


def count_releases(meta: DataFrame, filters: FilterSpec = FilterSpec()) -> DataFrame:
    """Total number of releases passing the filters (one row, ``total``)."""
    return filtered_releases(meta, filters).agg(F.count(F.lit(1)).alias("total"))


def get_releases(keys: DataFrame, releases: DataFrame) -> DataFrame:
    """Look up releases by ``ocid``: every key comes back, with ``found``."""
    k = write_once(keys.select("ocid"), "keys")
    r = reduce_to_keys(releases, k, "ocid", written=True).withColumn("found", F.lit(True))
    return (k.join(r, "ocid", "left")
             .withColumn("found", F.coalesce(F.col("found"), F.lit(False))))


def index_info(releases: DataFrame, chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Release, embedding and profile counts in one row (D1). Empty inputs give zeros.

    Vectors have one width, so it is read from one row; the counts need only whether a vector is there."""
    r = releases.agg(F.count(F.lit(1)).alias("api_release_count"))
    c = chunks.agg(F.count("embedding").alias("api_embedding_count"))
    d = chunks.filter(F.col("embedding").isNotNull()).select(F.size("embedding").cast("long").alias("dimension")).limit(1)
    p = profiles.agg(F.count(F.lit(1)).alias("company_profile_count"),
                     F.count_if(F.col("embedding").isNull()).alias("unembedded_profile_count"))
    parts = (r.unionByName(c, allowMissingColumns=True).unionByName(d, allowMissingColumns=True)
             .unionByName(p, allowMissingColumns=True))
    cols = ["api_release_count", "api_embedding_count", "dimension", "company_profile_count",
            "unembedded_profile_count"]
    return parts.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in cols])
