"""Explicit schemas for the procurement data model (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()

VALUE = T.StructType([T.StructField("amount", D), T.StructField("currency", S)])
LOCATION = T.StructType([T.StructField(n, S) for n in ("city", "postal_code", "nuts_code", "country")])
PERIOD = T.StructType([T.StructField("startDate", S), T.StructField("endDate", S)])
CLASSIFICATION = T.StructType([T.StructField(n, S) for n in ("scheme", "id", "description")])
DURATION = T.StructType([T.StructField("value", D), T.StructField("unit", S),
                         T.StructField("start_date", S), T.StructField("end_date", S)])

LOT = T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("description", S),
    T.StructField("value", VALUE), T.StructField("location", LOCATION),
    T.StructField("duration", DURATION), T.StructField("euFunded", T.BooleanType()),
    T.StructField("maxRenewals", T.IntegerType()),
])
ITEM = T.StructType([
    T.StructField("id", S), T.StructField("description", S),
    T.StructField("classification", CLASSIFICATION), T.StructField("quantity", D),
    T.StructField("unit", S), T.StructField("relatedLot", S),
])
SUPPLIER = T.StructType([T.StructField("id", S), T.StructField("name", S)])
STATISTIC = T.StructType([T.StructField("code", S), T.StructField("count", T.LongType())])
AWARD = T.StructType([
    T.StructField("id", S), T.StructField("status", S), T.StructField("date", S),
    T.StructField("value", VALUE), T.StructField("suppliers", T.ArrayType(SUPPLIER)),
    T.StructField("relatedLots", T.ArrayType(S)), T.StructField("subcontracting", S),
    T.StructField("submissionStatistics", T.ArrayType(STATISTIC)),
    T.StructField("fieldsPrivacy", T.ArrayType(S)),
])
PARTY = T.StructType([
    T.StructField("id", S), T.StructField("name", S), T.StructField("roles", T.ArrayType(S)),
    T.StructField("nutsCode", S), T.StructField("companySize", S), T.StructField("companyId", S),
])
AWARD_CRITERION = T.StructType([T.StructField("name", S), T.StructField("criterionType", S),
                                T.StructField("weight", D)])
SELECTION_CRITERION = T.StructType([T.StructField("criterionType", S), T.StructField("description", S)])

TENDER = T.StructType([
    T.StructField("title", S), T.StructField("description", S), T.StructField("status", S),
    T.StructField("procurementMethod", S), T.StructField("procurementMethodDetails", S),
    T.StructField("mainProcurementCategory", S), T.StructField("value", VALUE),
    T.StructField("tenderPeriod", PERIOD), T.StructField("submissionDeadline", S),
    T.StructField("classification", CLASSIFICATION),
    T.StructField("selectionCriteria", T.ArrayType(SELECTION_CRITERION)),
    T.StructField("awardCriteria", T.ArrayType(AWARD_CRITERION)),
    T.StructField("resultCode", S), T.StructField("location", LOCATION),
    T.StructField("duration", DURATION),
    T.StructField("euFunded", T.BooleanType()), T.StructField("eu_funded", T.BooleanType()),
    T.StructField("maxRenewals", T.IntegerType()), T.StructField("maxLotsAwarded", T.IntegerType()),
    T.StructField("maxLotsSubmitted", T.IntegerType()), T.StructField("documentsUrl", S),
    T.StructField("lots", T.ArrayType(LOT)), T.StructField("items", T.ArrayType(ITEM)),
])

RELEASE = T.StructType([
    T.StructField("ocid", S), T.StructField("id", S), T.StructField("date", S),
    T.StructField("language", S), T.StructField("url", S),
    T.StructField("tag", T.ArrayType(S)),
    T.StructField("buyer", T.StructType([T.StructField("id", S), T.StructField("name", S)])),
    T.StructField("tender", TENDER),
    T.StructField("awards", T.ArrayType(AWARD)),
    T.StructField("parties", T.ArrayType(PARTY)),
])

VECTOR = T.ArrayType(T.FloatType())

CHUNK = T.StructType([
    T.StructField("doc_id", S), T.StructField("ocid", S), T.StructField("chunk_type", S),
    T.StructField("text", S), T.StructField("cpv_codes", T.ArrayType(S)),
    T.StructField("embedding", VECTOR),
])

PROFILE = T.StructType([
    T.StructField("id", S), T.StructField("name", S), T.StructField("description", S),
    T.StructField("cpv_codes", T.ArrayType(S)), T.StructField("categories", T.ArrayType(S)),
    T.StructField("location", S), T.StructField("created_at", T.TimestampType()),
    T.StructField("embedding", VECTOR),
])

NOTICE = T.StructType([
    T.StructField("notice_id", T.LongType()), T.StructField("ocid", S),
    T.StructField("ts", T.TimestampType()), T.StructField("phase", S),
    T.StructField("status", S), T.StructField("description", S),
    T.StructField("award_value", D),
])


def empty_array(element: T.DataType):
    """A typed empty array literal, for ``coalesce(arr, [])``."""
    from pyspark.sql import functions as F
    return F.array().cast(T.ArrayType(element))
