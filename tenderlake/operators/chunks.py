"""Release -> text chunks for embedding.

One ``summary`` and one ``tender`` chunk per release and one ``lot:<id>``
chunk per lot, unioned by name.  The field lists follow the chunk kinds the
guide describes; the exact text templates are ours.  Pure projections plus
one ``explode``: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.operators.metadata import location_nuts


def money(amount: Column, currency: Column) -> Column:
    return F.when(amount.isNotNull(),
                  F.concat_ws(" ", F.format_string("%.2f", amount), currency))


def _field(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != F.lit("")),
                  F.concat(F.lit(label + ": "), value.cast("string")))


def build_chunks(releases: DataFrame) -> DataFrame:
    t = F.col("tender")
    t_items = releases.schema["tender"].dataType["items"].dataType
    deadline = F.coalesce(t["submissionDeadline"], t["tenderPeriod"]["endDate"])
    cpvs = F.array_sort(F.array_distinct(F.filter(
        F.coalesce(F.transform(t["items"], lambda i: i["classification"]["id"]),
                   F.array().cast(T.ArrayType(T.StringType()))), lambda x: x.isNotNull())))
    nuts = F.array_join(location_nuts(t), ",")
    sep = "\n"
    summary = F.concat_ws(sep,
                          _field("Auftraggeber", F.col("buyer.name")), _field("Titel", t["title"]),
                          _field("Verfahren", t["procurementMethod"]),
                          _field("Kategorie", t["mainProcurementCategory"]),
                          _field("Frist", deadline), _field("NUTS", nuts))
    criteria = F.array_join(F.transform(t["awardCriteria"],
                                        lambda c: F.concat(c["criterionType"], F.lit(" "),
                                                           F.format_string("%.0f", c["weight"]), F.lit("%"))), ", ")
    selection = F.array_join(F.transform(t["selectionCriteria"], lambda c: F.concat_ws(": ", c["criterionType"], c["description"])), "; ")
    described = F.array_join(F.array_sort(F.array_distinct(F.transform(
        F.filter(F.coalesce(t["items"], F.array().cast(t_items)), lambda i: i["classification"]["description"].isNotNull()),
        lambda i: F.concat_ws(" ", i["classification"]["id"], i["classification"]["description"])))), "; ")
    tender = F.concat_ws(sep,
                         _field("Titel", t["title"]), _field("Beschreibung", t["description"]),
                         _field("Verfahren", t["procurementMethod"]),
                         _field("Kategorie", t["mainProcurementCategory"]),
                         _field("Wert", money(t["value"]["amount"], t["value"]["currency"])),
                         _field("Frist", deadline), _field("Auftraggeber", F.col("buyer.name")),
                         _field("CPV", F.array_join(cpvs, ",")), _field("CPV-Beschreibung", described),
                         _field("Eignungskriterien", selection),
                         _field("Zuschlagskriterien", criteria),
                         _field("Ergebnis", t["resultCode"]))
    base = releases.select("ocid", summary.alias("summary_text"), tender.alias("tender_text"),
                           cpvs.alias("cpv_codes"), t["lots"].alias("lots"))
    s = base.select(F.concat(F.col("ocid"), F.lit("#summary")).alias("doc_id"), "ocid",
                    F.lit("summary").alias("chunk_type"), F.col("summary_text").alias("text"), "cpv_codes")
    d = base.select(F.concat(F.col("ocid"), F.lit("#tender")).alias("doc_id"), "ocid",
                    F.lit("tender").alias("chunk_type"), F.col("tender_text").alias("text"), "cpv_codes")
    lots = base.select("ocid", "cpv_codes", F.explode("lots").alias("lot"))
    lot_text = F.concat_ws(sep, _field("Los", F.col("lot.title")), _field("Beschreibung", F.col("lot.description")),
                           _field("Wert", money(F.col("lot.value.amount"), F.col("lot.value.currency"))))
    lt = lots.select(F.concat(F.col("ocid"), F.lit("#lot:"), F.col("lot.id")).alias("doc_id"), "ocid",
                     F.concat(F.lit("lot:"), F.col("lot.id")).alias("chunk_type"), lot_text.alias("text"),
                     "cpv_codes")
    return s.unionByName(d).unionByName(lt)
