"""Procurement views derived from the driver's tables.

The rules are fixed in FIXTURES.md section 4 and are mirrored one for one by
the DuckDB oracle CTEs in ``tenderlake.plans.oracle_views``.

Scale notes
-----------
* ``lots`` aggregates lineitem on (orderkey, linenumber) with partial
  (map-side) aggregation, so a hot order only costs one pre-aggregated row per
  map task; the per-order fold in ``releases`` then sees at most one row per
  line number.
* ``nation`` has 25 rows by definition and is the only side broadcast by
  hint; every other join is left to the planner (AQE converts a join to a
  broadcast only when the measured side is under
  ``spark.sql.autoBroadcastJoinThreshold``).
* All joins of the release build are on ``o_orderkey``/``orderkey`` (one
  exchange per input) except the customer join on ``o_custkey``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S
from tenderlake.sources.tables import Tables

# Fixed values of the derived test views (FIXTURES.md section 4).
CPV_DIVISION_BY_PART_TYPE = {
    "ECONOMY": "33", "SMALL": "45", "MEDIUM": "72",
    "PROMO": "48", "STANDARD": "79", "LARGE": "90",
}
STATUS_BY_ORDER_STATUS = {"F": "complete", "O": "active", "P": "planning"}
METHOD_BY_PRIORITY = {"1-URGENT": "direct", "2-HIGH": "limited",
                      "3-MEDIUM": "selective", "5-LOW": "open"}
CATEGORY_BY_SEGMENT = {"BUILDING": "works", "HOUSEHOLD": "services"}  # else goods
DOCUMENTS_URL_BASE = "https://vergabe.example.org/unterlagen/"
ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
UNKNOWN_PROFILE_ID = "profile-unknown"


def _case(col: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def _tables(spark_or_tables, sf_dir: str | None = None) -> Tables:
    if isinstance(spark_or_tables, Tables):
        return spark_or_tables
    return Tables(spark_or_tables, sf_dir)


def nuts_code(regionkey: Column, nationkey: Column) -> Column:
    """Synthetic NUTS code of a nation: DE + region digit + nation digit."""
    return F.concat(F.lit("DE"), regionkey.cast("string"), (nationkey % 10).cast("string"))


def lots(t: Tables) -> DataFrame:
    """One row per (orderkey, line number): amount, supplier, CPV, NUTS."""
    g = (t.lineitem
         .groupBy(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("lot_num"))
         .agg(F.sum("l_extendedprice").alias("amount"),
              F.sum("l_quantity").alias("quantity"),
              F.min("l_suppkey").alias("suppkey"),
              F.min("l_partkey").alias("partkey"),
              F.bool_or(F.col("l_returnflag") == F.lit("A")).alias("awarded")))
    part = t.part.select(F.col("p_partkey").alias("partkey"), "p_type")
    supp = t.supplier.select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("supplier_name"),
                             "s_nationkey")
    nation = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))
    cpv = F.concat(_case(F.col("p_type"), CPV_DIVISION_BY_PART_TYPE),
                   F.lpad((F.col("partkey") % 1000000).cast("string"), 6, "0"))
    return (g.join(part, "partkey", "left")
             .join(supp, "suppkey", "left")
             .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
             .select("orderkey", "lot_num", F.col("lot_num").cast("string").alias("lot_id"),
                     "amount", "quantity", "suppkey", "supplier_name", "partkey", "awarded",
                     cpv.alias("cpv"),
                     F.when(F.col("n_nationkey").isNotNull(),
                            nuts_code(F.col("n_regionkey"), F.col("n_nationkey"))).alias("nuts")))


def _lot_rows(t: Tables, orderkey_filter: Column | None = None, lots_df: DataFrame | None = None) -> DataFrame:
    lt = lots(t) if lots_df is None else lots_df
    if orderkey_filter is not None:
        lt = lt.filter(orderkey_filter)
    # dealt by order before the nested fields are made of these: they are several times as wide
    lt = lt.select("orderkey", "lot_num", "lot_id", "amount", "quantity", "suppkey", "supplier_name", "cpv", "nuts", "awarded").repartition("orderkey")
    null_s = F.lit(None).cast("string")
    # the OCDS lot and item of each line, built here per row (whole-stage codegen)
    # so the release build only extracts them
    lot = F.struct(
        F.col("lot_id").alias("id"), F.concat(F.lit("Los "), F.col("lot_id")).alias("title"),
        null_s.alias("description"),
        F.struct(F.col("amount").cast("double").alias("amount"), F.lit("EUR").alias("currency")).alias("value"),
        F.struct(null_s.alias("city"), null_s.alias("postal_code"), F.col("nuts").alias("nuts_code"),
                 F.lit("DE").alias("country")).alias("location"),
        F.lit(None).cast(S.DURATION).alias("duration"), F.lit(None).cast("boolean").alias("euFunded"),
        F.lit(None).cast("int").alias("maxRenewals"))
    item = F.struct(
        F.col("lot_id").alias("id"), null_s.alias("description"),
        F.struct(F.lit("CPV").alias("scheme"), F.col("cpv").alias("id"), null_s.alias("description")).alias("classification"),
        F.col("quantity").alias("quantity"), F.lit("EA").alias("unit"), F.col("lot_id").alias("relatedLot"))
    return (lt.groupBy("orderkey")
              .agg(F.array_sort(F.collect_list(F.struct(
                  "lot_num", "lot_id", "amount", "quantity", "suppkey", "supplier_name",
                  "cpv", "nuts", "awarded", lot.alias("lot"), item.alias("item")))).alias("lot_rows")))


# ------------------------------------------------------------ order-level rules
# One definition each, used by the nested release build and the flat metadata.

def _iso(c: Column) -> Column:
    return F.date_format(c, ISO_FMT)


def _status(orderstatus: Column) -> Column:
    return _case(orderstatus, STATUS_BY_ORDER_STATUS)


def _method(priority: Column) -> Column:
    return _case(priority, METHOD_BY_PRIORITY)


def _category(segment: Column) -> Column:
    return _case(segment, CATEGORY_BY_SEGMENT, "goods")


def _value_amount(k: Column, totalprice: Column) -> Column:
    return F.when(k % 7 != 0, totalprice).cast("double")


def _end_date(orderdate: Column) -> Column:
    return _iso(orderdate + F.expr("INTERVAL 30 DAYS"))


def _submission_deadline(k: Column, orderdate: Column) -> Column:
    return F.when(k % 3 != 0, _iso(orderdate + F.expr("INTERVAL 21 DAYS")))


def _eu_funded(k: Column) -> Column:
    return F.when(k % 5 == 0, F.lit(True)).when(k % 5 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def _documents_url(k: Column) -> Column:
    return F.when(k % 5 == 2, F.concat(F.lit(DOCUMENTS_URL_BASE), k.cast("string")))


def _tag(orderstatus: Column) -> Column:
    return (F.when(orderstatus == F.lit("F"), F.array(F.lit("tender"), F.lit("award")))
             .when(orderstatus == F.lit("O"), F.array(F.lit("tender")))
             .when(orderstatus == F.lit("P"), F.array(F.lit("planning")))
             .otherwise(F.array().cast(T.ArrayType(T.StringType()))))


def _result_code(orderstatus: Column, with_award: Column) -> Column:
    is_final = orderstatus == F.lit("F")
    return (F.when(is_final & with_award, F.lit("selec-w")).when(is_final, F.lit("clos-nw"))
             .when(orderstatus == F.lit("O"), F.lit("open-nw")))


def _orders_with_buyer(t: Tables) -> DataFrame:
    o = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    cust = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"),
                                         F.col("n_regionkey").alias("c_regionkey")))
    return (o.join(cust, o.o_custkey == cust.c_custkey, "left")
             .join(nation, "c_nationkey", "left"))


def _buyer_nuts() -> Column:
    return F.when(F.col("c_regionkey").isNotNull(), nuts_code(F.col("c_regionkey"), F.col("c_nationkey")))


def releases(spark_or_tables, sf_dir: str | None = None, lots_df: DataFrame | None = None) -> DataFrame:
    """Nested OCDS-shaped releases, one per order.

    ``lots_df`` is an already stored ``lots`` table; without it lots are derived here."""
    t = _tables(spark_or_tables, sf_dir)
    docs = t.documents.select(F.col("doc_id").alias("o_orderkey"), F.col("text").alias("description"))
    lot_rows = _lot_rows(t, F.lit(True), lots_df).withColumnRenamed("orderkey", "o_orderkey")

    base = (_orders_with_buyer(t)
             .join(lot_rows, "o_orderkey", "left")
             .join(docs, "o_orderkey", "left"))

    k = F.col("o_orderkey")
    lot_type = T.ArrayType(base.schema["lot_rows"].dataType.elementType)
    # arrays shared by many fields below, computed once per release
    base = (base.withColumn("__rows", F.coalesce(F.col("lot_rows"), F.array().cast(lot_type)))
                .withColumn("__awarded_rows", F.filter(F.col("__rows"), lambda l: l["awarded"])))
    rows = F.col("__rows")
    awarded_rows = F.col("__awarded_rows")
    any_awarded = F.size(awarded_rows) > 0
    is_final = F.col("o_orderstatus") == F.lit("F")
    with_award = is_final & any_awarded
    award_sum = F.aggregate(awarded_rows, F.lit(0.0), lambda acc, l: acc + l["amount"])
    award_value = F.when(with_award, F.when(k % 13 == 0, F.lit(1.0)).otherwise(award_sum))
    buyer_nuts = _buyer_nuts()
    iso = _iso
    value = lambda amount: F.struct(amount.cast("double").alias("amount"), F.lit("EUR").alias("currency"))
    location = lambda nuts: F.struct(F.lit(None).cast("string").alias("city"),
                                     F.lit(None).cast("string").alias("postal_code"),
                                     nuts.alias("nuts_code"), F.lit("DE").alias("country"))
    no_duration = F.lit(None).cast(S.DURATION)
    null_s = F.lit(None).cast("string")

    supplier_of = lambda l: F.struct(F.concat(F.lit("S-"), l["suppkey"].cast("string")).alias("id"),
                                     l["supplier_name"].alias("name"))
    suppliers = F.array_distinct(F.transform(F.filter(awarded_rows, lambda l: l["supplier_name"].isNotNull()),
                                             supplier_of))
    award = F.struct(
        F.concat(F.lit("A-"), k.cast("string")).alias("id"),
        F.when(with_award, F.lit("active")).otherwise(F.lit("unsuccessful")).alias("status"),
        iso(F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")).alias("date"),
        F.when(with_award, value(award_value)).alias("value"),
        F.when(with_award, suppliers).otherwise(F.array().cast(T.ArrayType(S.SUPPLIER))).alias("suppliers"),
        F.when(with_award, F.transform(awarded_rows, lambda l: l["lot_id"]))
         .otherwise(F.array().cast(T.ArrayType(T.StringType()))).alias("relatedLots"),
        null_s.alias("subcontracting"),
        F.array(F.struct(F.lit("tenders").alias("code"),
                         F.size(F.array_distinct(F.transform(rows, lambda l: l["suppkey"]))).cast("long").alias("count"))
                ).alias("submissionStatistics"),
        F.when(with_award & (k % 17 == 0), F.array(F.lit("val-tot")))
         .otherwise(F.array().cast(T.ArrayType(T.StringType()))).alias("fieldsPrivacy"),
    )
    awards = F.when(is_final, F.array(award)).otherwise(F.array().cast(T.ArrayType(S.AWARD)))

    # parties: buyer, then one entry per distinct lot supplier (ordered by key)
    distinct_suppliers = F.array_sort(F.array_distinct(F.transform(
        F.filter(rows, lambda l: l["supplier_name"].isNotNull()),
        lambda l: F.struct(l["suppkey"].alias("suppkey"), l["supplier_name"].alias("name"), l["nuts"].alias("nuts")))))
    tenderer = lambda s: F.struct(
        F.concat(F.lit("S-"), s["suppkey"].cast("string")).alias("id"), s["name"].alias("name"),
        F.when(is_final & F.exists(rows, lambda l: (l["suppkey"] == s["suppkey"]) & l["awarded"]),
               F.array(F.lit("tenderer"), F.lit("supplier"))).otherwise(F.array(F.lit("tenderer"))).alias("roles"),
        s["nuts"].alias("nutsCode"), null_s.alias("companySize"), null_s.alias("companyId"))
    buyer_party = F.struct(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("id"),
                           F.col("c_name").alias("name"), F.array(F.lit("buyer")).alias("roles"),
                           buyer_nuts.alias("nutsCode"), null_s.alias("companySize"), null_s.alias("companyId"))
    parties = F.concat(F.array(buyer_party), F.transform(distinct_suppliers, tenderer))

    price_weight = (F.lit(30) + F.lit(10) * (k % 5)).cast("double")
    criteria = F.array(
        F.struct(F.lit("Preis").alias("name"), F.lit("price").alias("criterionType"), price_weight.alias("weight")),
        F.struct(F.lit("Qualitaet").alias("name"), F.lit("quality").alias("criterionType"),
                 (F.lit(100.0) - price_weight).alias("weight")))

    lots_col = F.transform(rows, lambda l: l["lot"])
    items_col = F.transform(rows, lambda l: l["item"])

    status = _status(F.col("o_orderstatus"))
    result_code = _result_code(F.col("o_orderstatus"), any_awarded)
    eu = _eu_funded(k)
    tender = F.struct(
        F.concat(F.lit("Tender "), k.cast("string")).alias("title"),
        F.col("description").alias("description"),
        status.alias("status"),
        _method(F.col("o_orderpriority")).alias("procurementMethod"),
        F.col("o_orderpriority").alias("procurementMethodDetails"),
        _category(F.col("c_mktsegment")).alias("mainProcurementCategory"),
        value(_value_amount(k, F.col("o_totalprice"))).alias("value"),
        F.struct(iso(F.col("o_orderdate")).alias("startDate"),
                 _end_date(F.col("o_orderdate")).alias("endDate")).alias("tenderPeriod"),
        _submission_deadline(k, F.col("o_orderdate")).alias("submissionDeadline"),
        F.struct(F.lit("CPV").alias("scheme"), F.get(rows, 0)["cpv"].alias("id"),
                 null_s.alias("description")).alias("classification"),
        F.array().cast(T.ArrayType(S.SELECTION_CRITERION)).alias("selectionCriteria"),
        criteria.alias("awardCriteria"),
        result_code.alias("resultCode"),
        location(buyer_nuts).alias("location"),
        no_duration.alias("duration"),
        eu.alias("euFunded"),
        F.lit(None).cast("boolean").alias("eu_funded"),
        F.lit(None).cast("int").alias("maxRenewals"),
        F.lit(None).cast("int").alias("maxLotsAwarded"),
        F.lit(None).cast("int").alias("maxLotsSubmitted"),
        _documents_url(k).alias("documentsUrl"),
        lots_col.alias("lots"),
        items_col.alias("items"),
    )
    tag = _tag(F.col("o_orderstatus"))
    return base.select(
        F.concat(F.lit("ocds-"), k.cast("string")).alias("ocid"),
        F.concat(F.lit("N-"), k.cast("string")).alias("id"),
        iso(F.col("o_orderdate")).alias("date"),
        F.lit("DEU").alias("language"),
        null_s.alias("url"),
        tag.alias("tag"),
        F.struct(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("id"),
                 F.col("c_name").alias("name")).alias("buyer"),
        tender.alias("tender"),
        awards.alias("awards"),
        parties.alias("parties"),
    )


def release_meta(spark_or_tables, sf_dir: str | None = None, lots_df: DataFrame | None = None) -> DataFrame:
    """The flat release metadata (``operators.metadata.META_COLUMNS``) straight from the lots.

    Equal to ``release_metadata(releases(...))`` but without building lot arrays:
    per order only booleans and sets of NUTS and CPV codes are aggregated (sets
    bounded by the code vocabularies), all partially before the shuffle, so an
    order with a huge number of lines is never collected into one row."""
    t = _tables(spark_or_tables, sf_dir)
    lt = lots(t) if lots_df is None else lots_df
    named = F.col("supplier_name").isNotNull()
    # the lots are read once: first by NUTS of an order, then by order
    by_nuts = (lt.groupBy("orderkey", "nuts")
                 .agg(F.bool_or("awarded").alias("any_awarded"), F.bool_or(F.col("awarded") & named).alias("awarded_supplier"),
                      F.bool_or(named).alias("named"), F.min("lot_num").alias("pos"), F.collect_set("cpv").alias("cpvs")))
    per_order = (by_nuts.groupBy(F.col("orderkey").alias("o_orderkey"))
                        .agg(F.bool_or("any_awarded").alias("any_awarded"),
                             F.bool_or("awarded_supplier").alias("awarded_supplier"),
                             F.array_sort(F.array_distinct(F.flatten(F.collect_list("cpvs")))).alias("release_cpv_codes"),
                             F.collect_set(F.when(F.col("named"), F.col("nuts"))).alias("supplier_nuts"),
                             F.array_sort(F.collect_list(F.when(F.col("nuts").isNotNull(), F.struct("pos", "nuts")))).alias("lot_nuts")))
    base = _orders_with_buyer(t).join(per_order, "o_orderkey", "left")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    strings = T.ArrayType(T.StringType())
    empty = F.array().cast(strings)
    buyer = F.array(_buyer_nuts())
    lot_nuts = F.coalesce(F.transform("lot_nuts", lambda x: x["nuts"]), empty)
    not_null = lambda a: F.filter(a, lambda x: x.isNotNull())
    any_awarded = F.coalesce(F.col("any_awarded"), F.lit(False))
    return base.select(
        F.concat(F.lit("ocds-"), k.cast("string")).alias("ocid"),
        F.concat(F.lit("N-"), k.cast("string")).alias("notice_id"),
        _iso(F.col("o_orderdate")).alias("date"),
        F.concat(F.lit("Tender "), k.cast("string")).alias("title"),
        F.col("c_name").alias("buyer_name"),
        _method(F.col("o_orderpriority")).alias("procurement_method"),
        _category(F.col("c_mktsegment")).alias("main_procurement_category"),
        _value_amount(k, F.col("o_totalprice")).alias("value_amount"),
        F.lit("EUR").alias("value_currency"),
        _end_date(F.col("o_orderdate")).alias("deadline"),
        _submission_deadline(k, F.col("o_orderdate")).alias("submission_deadline"),
        _status(status).alias("status"),
        _tag(status).alias("tag"),
        ((status == F.lit("F")) & F.coalesce(F.col("awarded_supplier"), F.lit(False))).alias("has_awards"),
        _eu_funded(k).alias("eu_funded"),
        F.array_distinct(not_null(F.concat(buyer, lot_nuts))).alias("location_nuts"),
        _documents_url(k).alias("documents_url"),
        _result_code(status, any_awarded).alias("result_code"),
        F.array_sort(F.array_distinct(not_null(F.concat(buyer, F.coalesce(F.col("supplier_nuts"), empty)))))
         .alias("party_nuts"),
        F.coalesce(F.col("release_cpv_codes"), empty).alias("release_cpv_codes"),
    )


def chunks(spark_or_tables, sf_dir: str | None = None, lots_df: DataFrame | None = None) -> DataFrame:
    """Embedded chunks: ``doc_id, ocid, chunk_type, text, cpv_codes, embedding``."""
    t = _tables(spark_or_tables, sf_dir)
    emb = t.embeddings.filter(F.col("vec_id") % 100 < 98).select("vec_id", "embedding")
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    cpvs = ((lots(t) if lots_df is None else lots_df).groupBy("orderkey")
            .agg(F.array_sort(F.collect_set("cpv")).alias("cpv_codes")))
    kind = F.col("vec_id") % 3
    return (emb.join(docs, "vec_id", "left")
               .withColumn("orderkey", F.expr("vec_id div 3"))
               .join(cpvs, "orderkey", "left")
               .select(F.col("vec_id").cast("string").alias("doc_id"),
                       F.concat(F.when(F.col("orderkey") % 11 == 10, F.lit("ocds-withdrawn-")).otherwise(F.lit("ocds-")),
                                F.col("orderkey").cast("string")).alias("ocid"),
                       F.when(kind == 0, F.lit("summary")).when(kind == 1, F.lit("tender"))
                        .otherwise(F.lit("lot:1")).alias("chunk_type"),
                       F.col("text"),
                       F.coalesce(F.col("cpv_codes"), S.empty_array(T.StringType())).alias("cpv_codes"),
                       F.col("embedding")))


def profiles(spark_or_tables, sf_dir: str | None = None) -> DataFrame:
    """Company profiles: vec_id % 100 = 99 with a vector, = 98 without."""
    t = _tables(spark_or_tables, sf_dir)
    emb = t.embeddings.filter(F.col("vec_id") % 100 >= 98).select("vec_id", "embedding")
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text"))
    odd = F.col("vec_id") % 2 == 1
    strings = T.ArrayType(T.StringType())
    return (emb.join(docs, "vec_id", "left")
               .select(F.concat(F.lit("profile-"), F.col("vec_id").cast("string")).alias("id"),
                       F.concat(F.lit("Company "), F.col("vec_id").cast("string")).alias("name"),
                       F.coalesce(F.col("text"), F.lit("")).alias("description"),
                       F.when(odd, F.array(F.lit("45000000"), F.lit("72000000")))
                        .otherwise(F.array().cast(strings)).alias("cpv_codes"),
                       F.when(odd, F.array(F.lit("works"))).otherwise(F.array().cast(strings)).alias("categories"),
                       F.when(odd, F.lit("Kassel, Hessen")).alias("location"),
                       (F.lit("2024-01-01 00:00:00").cast("timestamp")
                        + F.make_dt_interval(days=F.expr("cast(vec_id div 100 as int)"))).alias("created_at"),
                       F.when(F.col("vec_id") % 100 == 99, F.col("embedding")).alias("embedding")))


def match_requests(spark_or_tables, sf_dir: str | None = None) -> DataFrame:
    """Every profile id, plus one id that does not exist."""
    t = _tables(spark_or_tables, sf_dir)
    ids = profiles(t).select(F.col("id").alias("profile_id"))
    unknown = t.spark.range(1).select(F.lit(UNKNOWN_PROFILE_ID).alias("profile_id"))
    return ids.unionByName(unknown)


def notices(spark_or_tables, sf_dir: str | None = None) -> DataFrame:
    """Publication events of procurement processes (several per OCID)."""
    t = _tables(spark_or_tables, sf_dir)
    e = t.events
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("notice_id"),
        F.concat(F.lit("ocds-ev-"), (F.col("user_id") * 20 + F.col("event_id") % 20).cast("string")).alias("ocid"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(et == "view", F.lit("planning")).when(et.isin("click", "signup"), F.lit("tender"))
         .when(et == "purchase", F.lit("award")).alias("phase"),
        F.when(et == "view", F.lit("planning")).when(et == "click", F.lit("active"))
         .when(et == "purchase", F.lit("complete")).alias("status"),
        F.when(et == "click", F.col("props")).when(et == "signup", F.lit("")).alias("description"),
        F.when(et == "purchase", F.col("value")).alias("award_value"),
    )
