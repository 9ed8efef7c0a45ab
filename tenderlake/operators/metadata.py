"""Flat release metadata, the columns the match and listing paths filter on.

``release_metadata`` is a pure projection of nested releases: no shuffle.
Written once as a table, its top-level columns get
parquet min/max statistics, so equality/range/prefix filters prune row groups
and nested fields the caller does not read are never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions.filters import effective_deadline

META_COLUMNS = (
    "ocid", "notice_id", "date", "title", "buyer_name", "procurement_method",
    "main_procurement_category", "value_amount", "value_currency", "deadline",
    "submission_deadline", "status", "tag", "has_awards", "eu_funded",
    "location_nuts", "documents_url", "result_code", "party_nuts", "release_cpv_codes",
)


def _strings(col: Column) -> Column:
    return F.coalesce(col, F.array().cast(T.ArrayType(T.StringType())))


def has_awards(awards: Column) -> Column:
    """Any award with a non-empty supplier list; no awards gives False."""
    return F.coalesce(F.exists(awards, lambda a: F.coalesce(F.size(a["suppliers"]), F.lit(0)) > 0),
                      F.lit(False))


def location_nuts(tender: Column) -> Column:
    """Ordered distinct NUTS codes: tender location first, then lots."""
    lot_codes = _strings(F.transform(tender["lots"], lambda l: l["location"]["nuts_code"]))
    codes = F.concat(F.array(tender["location"]["nuts_code"]), lot_codes)
    return F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))


def release_metadata(releases: DataFrame) -> DataFrame:
    t = F.col("tender")
    cols = releases.schema["tender"].dataType.fieldNames()
    eu = (F.coalesce(t["euFunded"], t["eu_funded"]) if "eu_funded" in cols and "euFunded" in cols
          else t["euFunded"] if "euFunded" in cols else t["eu_funded"])
    return releases.select(
        "ocid",
        F.col("id").alias("notice_id"),
        "date",
        t["title"].alias("title"),
        F.col("buyer")["name"].alias("buyer_name"),
        t["procurementMethod"].alias("procurement_method"),
        t["mainProcurementCategory"].alias("main_procurement_category"),
        t["value"]["amount"].alias("value_amount"),
        t["value"]["currency"].alias("value_currency"),
        t["tenderPeriod"]["endDate"].alias("deadline"),
        t["submissionDeadline"].alias("submission_deadline"),
        t["status"].alias("status"),
        _strings(F.col("tag")).alias("tag"),
        has_awards(F.col("awards")).alias("has_awards"),
        eu.alias("eu_funded"),
        location_nuts(t).alias("location_nuts"),
        t["documentsUrl"].alias("documents_url"),
        t["resultCode"].alias("result_code"),
        F.array_sort(F.array_distinct(_strings(F.filter(F.transform(F.col("parties"), lambda p: p["nutsCode"]),
                                                        lambda x: x.isNotNull())))).alias("party_nuts"),
        F.array_sort(F.array_distinct(F.filter(
            _strings(F.transform(t["items"], lambda i: i["classification"]["id"])),
            lambda x: x.isNotNull()))).alias("release_cpv_codes"),
    )


def match_deadline() -> Column:
    return effective_deadline(F.col("submission_deadline"), F.col("deadline"))
