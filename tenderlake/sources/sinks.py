"""Result sinks: one JSON document per result row.

Nulls are written as ``null`` except ``documents_url``, which is omitted
when it is NULL, like the reference's serialiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OMIT_WHEN_NULL = ("documents_url",)


def json_rows(df: DataFrame, omit_when_null=OMIT_WHEN_NULL) -> Column:
    opts = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(*[F.col(c) for c in df.columns]), opts)
    out = full
    for c in omit_when_null:
        if c in df.columns:
            slim = F.to_json(F.struct(*[F.col(x) for x in df.columns if x != c]), opts)
            out = F.when(F.col(c).isNull(), slim).otherwise(out)
    return out


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(json_rows(df).alias("value")).write.mode(mode).text(path)


def match_responses(matches: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One JSON document per request: ``{"profile_id", "count", "matches": [...]}``.

    ``matches`` is ``match_tenders`` output (at most k rows per request, so the
    per-request collection is bounded by k); requests without matches get
    ``count: 0`` and an empty list.  ``documents_url`` is omitted when NULL."""
    cols = [c for c in matches.columns if c != "profile_id"]
    opts = {"ignoreNullFields": "false"}
    row_json = F.to_json(F.struct(*[F.col(c) for c in cols]), opts)
    slim = F.to_json(F.struct(*[F.col(c) for c in cols if c != "documents_url"]), opts)
    if "documents_url" in cols:
        row_json = F.when(F.col("documents_url").isNull(), slim).otherwise(row_json)
    per = (matches.groupBy("profile_id")
                  .agg(F.count(F.lit(1)).alias("count"),
                       F.array_sort(F.collect_list(F.struct("rank", row_json.alias("j")))).alias("m")))
    if requests is not None:
        per = requests.select("profile_id").distinct().join(per, "profile_id", "left")
    body = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("m", lambda x: x["j"]), ","), F.lit("")),
                    F.lit("]"))
    head = F.to_json(F.struct(F.col("profile_id"), F.coalesce(F.col("count"), F.lit(0)).alias("count")))
    doc = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"matches":'), body, F.lit("}"))
    return per.select("profile_id", doc.alias("json"))
