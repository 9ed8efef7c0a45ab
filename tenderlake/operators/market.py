"""Market reports over releases.

All are hash aggregations with partial (map-side) aggregation; distinct
counts are planned by Spark as a two-level aggregation whose first exchange
is on (key, ocid), so a dominant organisation, CPV division or region is
spread over many reducers before its final count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.joins import reduce_to_keys
from tenderlake.operators.metadata import location_nuts
from tenderlake.session import write_once

# EU thresholds for the threshold class (EUR).
EU_THRESHOLD_SUPPLIES_SERVICES = 221_000.0
EU_THRESHOLD_WORKS = 5_538_000.0
PLACEHOLDER_AWARD_VALUE = 1.0
CONFIDENTIAL_VALUE_FLAG = "val-tot"
SUBMITTED_TENDERS = "tenders"       # code of the submission statistic that counts bids


def competitor_parties(releases: DataFrame, ocids: DataFrame | None = None, written: bool = False) -> DataFrame:
    """One row per (release, organisation) in role ``tenderer`` or ``supplier``."""
    r = releases if ocids is None else reduce_to_keys(releases, ocids, "ocid", written)
    p = r.select("ocid", F.explode("parties").alias("p"))
    roles = F.col("p.roles")
    return (p.filter(F.array_contains(roles, "tenderer") | F.array_contains(roles, "supplier"))
             .select("ocid", F.col("p.name").alias("name"),
                     F.array_contains(roles, "supplier").alias("is_supplier")))


def competitor_frequency(releases: DataFrame, ocids: DataFrame | None = None) -> DataFrame:
    """How often each organisation bids and wins."""
    return (competitor_parties(releases, ocids)
            .groupBy("name")
            .agg(F.count_distinct("ocid").alias("n_releases"),
                 F.count_distinct(F.when(F.col("is_supplier"), F.col("ocid"))).alias("n_won")))


def likely_winner(releases: DataFrame) -> DataFrame:
    """Award releases: award suppliers if any; else parties in role supplier; else the only tenderer; else unknown."""
    award = releases.filter(F.array_contains(F.col("tag"), "award"))
    names = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
    in_role = lambda role: F.filter(F.col("parties"), lambda p: F.array_contains(p["roles"], role))
    suppliers = names(F.flatten(F.transform(F.col("awards"), lambda a: F.transform(a["suppliers"], lambda s: s["name"]))))
    parties = names(F.transform(in_role("supplier"), lambda p: p["name"]))
    named = F.when(F.size(suppliers) > 0, suppliers).when(F.size(parties) > 0, parties)
    tenderers = in_role("tenderer")
    return award.select(
        "ocid",
        F.when(named.isNotNull(), F.array_join(named, ","))
         .when(F.size(tenderers) == 1, F.get(tenderers, 0)["name"]).alias("winner"),
        F.when(named.isNotNull(), F.lit("supplier"))
         .when(F.size(tenderers) == 1, F.lit("sole_tenderer")).otherwise(F.lit("unknown")).alias("basis"))


def cpv_levels(cpv: Column) -> list[Column]:
    """Division, group, class prefixes (2, 4, 5 digits) and the whole 8 digits of a CPV code (H7)."""
    return [F.substring(cpv, 1, n).alias(f"d{n}") for n in (2, 4, 5, 8)]


def _with_lot_amounts(releases: DataFrame, *cols: str) -> DataFrame:
    """``ocid``, ``cols`` and ``lot_amount``: a map from lot id to its value; of lots that share an id the first counts."""
    entries = F.array_sort(F.transform("tender.lots", lambda l, i: F.struct(l["id"].alias("id"), i.alias("i"), l["value"]["amount"].alias("amount"))))
    r = releases.select("ocid", *cols, entries.alias("_lots"))
    first = F.filter("_lots", lambda e, i: e["id"].isNotNull() & ((i == 0) | ~F.get(F.col("_lots"), i - 1)["id"].eqNullSafe(e["id"])))
    return r.select("ocid", *[c.split(".")[-1] for c in cols],
                    F.map_from_entries(F.transform(first, lambda e: F.struct(e["id"], e["amount"]))).alias("lot_amount"))


def release_items(releases: DataFrame) -> DataFrame:
    """Items with their CPV code and the value of the lot they belong to."""
    it = _with_lot_amounts(releases, "tender.items").select("ocid", "lot_amount", F.explode("items").alias("item"))
    return it.select("ocid", F.col("item.classification.id").alias("cpv"),
                     F.element_at("lot_amount", F.col("item.relatedLot")).alias("amount"))


def cpv_rollup(releases: DataFrame) -> DataFrame:
    """Item counts, releases and lot value per CPV division, group, class and code."""
    items = release_items(releases).filter(F.col("cpv").isNotNull())
    return (items.select("ocid", "amount", *cpv_levels(F.col("cpv")))
                 .rollup("d2", "d4", "d5", "d8")
                 .agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n_items"),
                      F.count_distinct("ocid").alias("n_releases"), F.sum("amount").alias("value")))


def method_competition(releases: DataFrame) -> DataFrame:
    """Releases, bids, awards and value per procurement method.

    Bids are the tenders that the awards' submission statistics count, else the parties in role tenderer."""
    counted = F.filter(F.flatten(F.transform(F.filter("awards", lambda a: a["submissionStatistics"].isNotNull()),
                                             lambda a: a["submissionStatistics"])),
                       lambda s: (s["code"] == SUBMITTED_TENDERS) & s["count"].isNotNull())
    parties = F.size(F.filter("parties", lambda p: F.array_contains(p["roles"], "tenderer"))).cast("long")
    bids = F.when(F.size(counted) > 0, F.aggregate(counted, F.lit(0).cast("long"), lambda acc, s: acc + s["count"])).otherwise(parties)
    has_awards = F.coalesce(F.exists("awards", lambda a: F.coalesce(F.size(a["suppliers"]), F.lit(0)) > 0),
                            F.lit(False))
    base = releases.select(F.col("tender.procurementMethod").alias("procurement_method"), bids.alias("bids"),
                           has_awards.alias("has_awards"), F.col("tender.value.amount").alias("value"))
    return (base.groupBy("procurement_method")
                .agg(F.count(F.lit(1)).alias("n_releases"), F.avg("bids").alias("avg_bids"),
                     F.count_if("has_awards").alias("n_awarded"), F.sum("value").alias("total_value"),
                     F.avg("value").alias("avg_value")))


def field_coverage(releases: DataFrame) -> DataFrame:
    """Fill rates of the fields the guide warns about, in one pass."""
    t = F.col("tender")
    rate = lambda cond: F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))
    award = F.array_contains(F.col("tag"), "award")
    with_suppliers = F.exists("awards", lambda a: F.coalesce(F.size(a["suppliers"]), F.lit(0)) > 0)
    return releases.agg(
        F.count(F.lit(1)).alias("n_releases"),
        rate(t["documentsUrl"].isNotNull()).alias("documents_url"),
        rate(t["submissionDeadline"].isNotNull()).alias("submission_deadline"),
        rate(t["value"]["amount"].isNotNull()).alias("value"),
        rate(t["description"].isNotNull()).alias("description"),
        rate(t["procurementMethod"].isNotNull()).alias("procurement_method"),
        F.avg(F.when(award, F.when(with_suppliers, F.lit(1.0)).otherwise(F.lit(0.0)))).alias("award_suppliers"))


def award_value(awards: Column) -> Column:
    """Total usable award value: placeholder 1.00 and confidential values count as missing."""
    usable = F.filter(awards, lambda a: ~F.coalesce(F.array_contains(a["fieldsPrivacy"], CONFIDENTIAL_VALUE_FLAG),
                                                    F.lit(False)))
    vals = F.filter(F.transform(usable, lambda a: F.nullif(a["value"]["amount"], F.lit(PLACEHOLDER_AWARD_VALUE))),
                    lambda v: v.isNotNull())
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v))


def estimate_vs_award(releases: DataFrame) -> DataFrame:
    """Estimated vs awarded value per category, over releases that have both."""
    base = releases.select(F.col("tender.mainProcurementCategory").alias("category"),
                           F.col("tender.value.amount").alias("estimate"), award_value(F.col("awards")).alias("award"))
    both = base.filter(F.col("estimate").isNotNull() & F.col("award").isNotNull())
    return (both.groupBy("category")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("estimate").alias("sum_estimate"),
                     F.sum("award").alias("sum_award"))
                .withColumn("ratio", F.try_divide(F.col("sum_award"), F.col("sum_estimate"))))


def result_by_month(releases: DataFrame) -> DataFrame:
    """Release counts per month and result code, any code (D15); without one it counts as ``none``."""
    return _by_month(releases, F.coalesce(F.col("tender.resultCode"), F.lit("none")).alias("result_code"))


def result_status_by_month(releases: DataFrame) -> DataFrame:
    """Release counts per month, result code and tender status."""
    return _by_month(releases, F.coalesce(F.col("tender.resultCode"), F.lit("none")).alias("result_code"),
                     F.coalesce(F.col("tender.status"), F.lit("none")).alias("status"))


def _by_month(releases: DataFrame, *keys: Column) -> DataFrame:
    base = releases.select(F.substring("date", 1, 7).alias("month"), *keys)
    return base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("n_releases"))


def criteria_weights(releases: DataFrame) -> DataFrame:
    """Award-criterion weights by criterion type."""
    c = releases.select("ocid", F.explode("tender.awardCriteria").alias("c"))
    return (c.groupBy(F.col("c.criterionType").alias("criterion_type"))
             .agg(F.count(F.lit(1)).alias("n"), F.avg("c.weight").alias("avg_weight"),
                  F.min("c.weight").alias("min_weight"), F.max("c.weight").alias("max_weight")))


def criteria_sum_check(releases: DataFrame) -> DataFrame:
    """How many releases have weights adding up to 100."""
    s = releases.select(F.aggregate(F.transform("tender.awardCriteria", lambda c: F.coalesce(c["weight"], F.lit(0.0))),
                                    F.lit(0.0), lambda a, b: a + b).alias("total"),
                        F.size("tender.awardCriteria").alias("n"))
    s = s.filter(F.col("n") > 0)
    return s.agg(F.count(F.lit(1)).alias("n_releases"),
                 F.count_if(F.abs(F.col("total") - 100.0) < 1e-9).alias("n_sum_100"))


def nuts_rollup(releases: DataFrame, levels=(2, 3, 4, 5)) -> DataFrame:
    """Releases and estimated value by NUTS prefix of length 2..5."""
    base = releases.select("ocid", F.col("tender.value.amount").alias("value"),
                           F.explode(location_nuts(F.col("tender"))).alias("nuts"))
    lv = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("level"), F.substring("nuts", 1, n).alias("prefix"),
                                               (F.length("nuts") >= n).alias("ok")) for n in levels]),
                            lambda s: s["ok"]))
    per = base.select("ocid", "value", lv.alias("l")).select("ocid", "value", "l.level", "l.prefix").distinct()
    return (per.groupBy("level", "prefix")
               .agg(F.count(F.lit(1)).alias("n_releases"), F.sum("value").alias("total_value")))


def award_lot_link(releases: DataFrame) -> DataFrame:
    """Awards linked to the lots (and items) they cover.

    Awards, lots and items of a process are in one row, so the link is two map lookups there: no
    shuffle, and each array is sorted once instead of searched per award."""
    r = _with_lot_amounts(releases, "awards", "tender.items")
    by_lot = F.array_sort(F.transform(F.filter("items", lambda x: x["relatedLot"].isNotNull()),
                                      lambda x, i: F.struct(x["relatedLot"].alias("lot"), i.alias("i"), x["classification"]["id"].alias("cpv"))))
    r = r.select("ocid", "awards", "lot_amount", by_lot.alias("_items"))
    starts = F.filter(F.transform("_items", lambda x, i: F.when((i == 0) | (F.get(F.col("_items"), i - 1)["lot"] != x["lot"]), i)),
                      lambda p: p.isNotNull())
    r = r.select("ocid", "awards", "lot_amount", "_items", starts.alias("_at"))
    upto = lambda k: F.coalesce(F.get(F.col("_at"), k + 1), F.size("_items"))
    groups = F.map_from_arrays(F.transform("_at", lambda p: F.get(F.col("_items"), p)["lot"]),
                               F.transform("_at", lambda p, k: F.slice(F.col("_items"), p + 1, upto(k) - p)))
    aw = (r.select("ocid", "lot_amount", groups.alias("_by_lot"), F.explode("awards").alias("a"))
           .select("ocid", "lot_amount", "_by_lot", F.col("a.id").alias("award_id"), F.explode("a.relatedLots").alias("lot_id"),
                   F.size("a.suppliers").alias("n_suppliers")))
    return aw.select("ocid", "lot_id", "award_id", "n_suppliers", F.element_at("lot_amount", F.col("lot_id")).alias("lot_amount"),
                     F.explode_outer(F.element_at("_by_lot", F.col("lot_id"))).alias("_item")).select(
                         "ocid", "lot_id", "award_id", "n_suppliers", "lot_amount", F.col("_item.cpv").alias("item_cpv"))


def lifecycle(releases: DataFrame) -> DataFrame:
    """open / closed / other per release (H8)."""
    from tenderlake.operators.notices import lifecycle_state
    return releases.select("ocid", lifecycle_state(F.col("tag"), F.coalesce(F.col("tender.status"), F.lit("")))
                           .alias("state"))


def threshold_class(releases: DataFrame, supplies: float = EU_THRESHOLD_SUPPLIES_SERVICES,
                    works: float = EU_THRESHOLD_WORKS) -> DataFrame:
    """Estimated value above or below the EU threshold of its category (H9)."""
    cat = F.col("tender.mainProcurementCategory")
    thr = F.when(cat == "works", F.lit(works)).otherwise(F.lit(supplies))
    v = F.col("tender.value.amount")
    return releases.select("ocid", cat.alias("category"), thr.alias("threshold"),
                           F.when(v.isNull(), F.lit("unknown")).when(v >= thr, F.lit("above"))
                            .otherwise(F.lit("below")).alias("class"))


def competitors(requests: DataFrame, profiles: DataFrame, chunks: DataFrame, releases: DataFrame,
                meta: DataFrame, k: int = 30, mode: str = "exact") -> DataFrame:
    """Who bids on and wins the tenders that match each profile:
    match with ``tag=award, has_awards=true`` -> release parties -> counts per organisation."""
    from tenderlake.functions.filters import FilterSpec
    from tenderlake.operators.matching import match_tenders
    m = write_once(match_tenders(requests, profiles, chunks, meta, FilterSpec(tag="award", has_awards=True),
                                 k=k, mode=mode).select("profile_id", "ocid"), "matches")
    parties = competitor_parties(releases, m, written=True)
    return (m.join(parties, "ocid")
             .groupBy("profile_id", "name")
             .agg(F.count_distinct("ocid").alias("n_releases"),
                  F.count_distinct(F.when(F.col("is_supplier"), F.col("ocid"))).alias("n_won")))
