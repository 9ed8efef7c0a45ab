"""Nested release JSON -> typed rows.

The schema is explicit (never inferred); missing fields become NULL, and
lists that arrive as JSON ``null`` are read as empty lists, so one bad field
never drops a release's metadata.  Both ``euFunded`` and ``eu_funded`` are
accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S


def _empty(dt: T.DataType) -> Column:
    return F.array().cast(dt)


def normalize_releases(df: DataFrame) -> DataFrame:
    tender_t = S.TENDER
    award_t = S.AWARD
    awards = F.transform(F.coalesce(F.col("awards"), _empty(T.ArrayType(award_t))),
                         lambda a: a.withField("suppliers", F.coalesce(a["suppliers"], _empty(T.ArrayType(S.SUPPLIER))))
                                    .withField("relatedLots", F.coalesce(a["relatedLots"], _empty(T.ArrayType(T.StringType())))))
    tender = F.when(F.col("tender").isNotNull(),
                    F.col("tender")
                    .withField("lots", F.coalesce(F.col("tender.lots"), _empty(T.ArrayType(S.LOT))))
                    .withField("items", F.coalesce(F.col("tender.items"), _empty(T.ArrayType(S.ITEM)))))
    return (df.withColumn("tag", F.coalesce(F.col("tag"), _empty(T.ArrayType(T.StringType()))))
              .withColumn("awards", awards)
              .withColumn("parties", F.coalesce(F.col("parties"), _empty(T.ArrayType(S.PARTY))))
              .withColumn("tender", tender.cast(tender_t)))


def _untyped_suppliers(schema: T.StructType) -> T.StructType:
    """The release schema with ``awards[].suppliers`` as JSON texts, whatever their type."""
    award = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType())) if f.name == "suppliers" else f for f in S.AWARD.fields])
    return T.StructType([T.StructField(f.name, T.ArrayType(award)) if f.name == "awards" else f for f in schema.fields])


def _supplier(text: Column) -> Column:
    """An object as it is; any other value counts as a supplier of that name."""
    typed = F.from_json(text, S.SUPPLIER)
    plain = F.struct(F.lit(None).cast("string").alias("id"), text.alias("name"))
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), typed).otherwise(plain)


def parse_releases(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON texts -> releases; texts that are not a JSON object are left out."""
    ok = F.schema_of_variant(F.try_parse_json(F.col(json_col))).startswith("OBJECT")
    raw = lines.filter(ok).select(F.from_json(F.col(json_col), _untyped_suppliers(S.RELEASE)).alias("r")).select("r.*")
    awards = F.transform("awards", lambda a: a.withField("suppliers", F.transform(a["suppliers"], _supplier)))
    return normalize_releases(raw.withColumn("awards", awards))


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON-lines releases with the release schema; malformed lines are left out."""
    return parse_releases(spark.read.text(path))


def parse_with_rejects(lines: DataFrame, json_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(releases, rejects): what ``parse_releases`` leaves out comes back as ``value, reason``.

    Reasons: ``empty`` (null or blank), ``not json``, ``not an object``, ``no ocid`` (such a release is in both frames: it has content,
    but no lookup can find it).  So "missing" and "broken" can be told apart, and nothing is dropped without a trace."""
    text = F.col(json_col)
    kind = F.schema_of_variant(F.try_parse_json(text))
    ocid = F.get_json_object(text, "$.ocid")
    reason = (F.when(text.isNull() | (F.trim(text) == ""), F.lit("empty")).when(kind.isNull(), F.lit("not json"))
              .when(~kind.startswith("OBJECT"), F.lit("not an object")).when(ocid.isNull() | (ocid == ""), F.lit("no ocid")))
    return parse_releases(lines, json_col), lines.select(text.alias("value"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def read_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_with_rejects`` of the lines of JSON files."""
    return parse_with_rejects(spark.read.text(path))
