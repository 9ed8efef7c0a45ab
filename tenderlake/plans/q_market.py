"""Market report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators import market as M
from tenderlake.operators.distinct_counts import cpv_rollup_bitmaps
from tenderlake.plans.oracle_views import with_views
from tenderlake.plans.q_match import match_ctes
from tenderlake.plans.registry import query, r6
from tenderlake.sources.stored import Views


def r2(c):
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c, 2)


_TENDERERS = ("tenderers", """
SELECT r.ocid, l.suppkey, l.supplier_name AS name, (r.order_status = 'F' AND bool_or(l.awarded)) AS is_supplier
FROM releases r JOIN lots l ON l.orderkey = r.orderkey
WHERE l.supplier_name IS NOT NULL
GROUP BY r.ocid, r.order_status, l.suppkey, l.supplier_name""")


def _rel(spark, sf_dir):
    return Views(spark, sf_dir).releases


@query("competitor_frequency", with_views(["releases", "lots"], """
SELECT name, count(DISTINCT ocid) AS n_releases, count(DISTINCT CASE WHEN is_supplier THEN ocid END) AS n_won
FROM tenderers GROUP BY name""", [_TENDERERS]), headline=True)
def q_competitor_frequency(spark, sf_dir):
    return M.competitor_frequency(_rel(spark, sf_dir))


@query("likely_winner", with_views(["releases", "lots"], """
SELECT r.ocid,
       CASE WHEN s.names IS NOT NULL THEN s.names WHEN r.n_tenderers = 1 THEN t1.name END AS winner,
       CASE WHEN s.names IS NOT NULL THEN 'supplier' WHEN r.n_tenderers = 1 THEN 'sole_tenderer' ELSE 'unknown' END AS basis
FROM releases r
LEFT JOIN (SELECT r2.ocid, array_to_string(list_sort(list_distinct(list(l.supplier_name))), ',') AS names
           FROM releases r2 JOIN lots l ON l.orderkey = r2.orderkey
           WHERE r2.with_award AND l.awarded AND l.supplier_name IS NOT NULL GROUP BY r2.ocid) s ON s.ocid = r.ocid
LEFT JOIN (SELECT ocid, min(name) AS name FROM tenderers GROUP BY ocid) t1 ON t1.ocid = r.ocid
WHERE list_contains(r.tag, 'award')""", [_TENDERERS]))
def q_likely_winner(spark, sf_dir):
    return M.likely_winner(_rel(spark, sf_dir))


_ROLLUP_SQL = with_views(["releases", "lots"], """
SELECT CAST(GROUPING(d2, d4, d5, d8) AS BIGINT) AS gid, d2, d4, d5, d8, count(*) AS n_items,
       count(DISTINCT ocid) AS n_releases, round(sum(amount), 2) AS value
FROM (SELECT r.ocid, substr(l.cpv, 1, 2) AS d2, substr(l.cpv, 1, 4) AS d4, substr(l.cpv, 1, 5) AS d5,
             substr(l.cpv, 1, 8) AS d8, l.amount
      FROM releases r JOIN lots l ON l.orderkey = r.orderkey WHERE l.cpv IS NOT NULL)
GROUP BY ROLLUP (d2, d4, d5, d8)""")


def _present_rollup(c):
    return c.select("gid", "d2", "d4", "d5", "d8", "n_items", "n_releases", r2("value").alias("value"))


@query("cpv_rollup", _ROLLUP_SQL)
def q_cpv_rollup(spark, sf_dir):
    return _present_rollup(M.cpv_rollup(_rel(spark, sf_dir)))


@query("cpv_rollup_bitmaps", _ROLLUP_SQL)
def q_cpv_rollup_bitmaps(spark, sf_dir):
    """The same roll-up by mergeable bitmaps of dense release numbers."""
    return _present_rollup(cpv_rollup_bitmaps(_rel(spark, sf_dir)))


@query("method_competition", with_views(["releases", "lots"], """
SELECT procurement_method, count(*) AS n_releases,
       round(avg(CASE WHEN order_status = 'F' THEN coalesce(s.n, 0) ELSE n_tenderers END), 6) AS avg_bids,
       count(*) FILTER (WHERE has_awards) AS n_awarded, round(sum(value_amount), 2) AS total_value,
       round(avg(value_amount), 6) AS avg_value
FROM releases r LEFT JOIN (SELECT orderkey, count(DISTINCT suppkey) AS n FROM lots GROUP BY orderkey) s ON s.orderkey = r.orderkey
GROUP BY procurement_method"""), headline=True)
def q_method_competition(spark, sf_dir):
    m = M.method_competition(_rel(spark, sf_dir))
    return m.select("procurement_method", "n_releases", r6("avg_bids").alias("avg_bids"), "n_awarded",
                    r2("total_value").alias("total_value"), r6("avg_value").alias("avg_value"))


@query("field_coverage", with_views(["releases"], """
SELECT count(*) AS n_releases,
       round(avg(CASE WHEN documents_url IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS documents_url,
       round(avg(CASE WHEN submission_deadline IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS submission_deadline,
       round(avg(CASE WHEN value_amount IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS value,
       round(avg(CASE WHEN description IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS description,
       round(avg(CASE WHEN procurement_method IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS procurement_method,
       round(avg(CASE WHEN list_contains(tag, 'award') THEN (CASE WHEN has_awards THEN 1.0 ELSE 0.0 END) END), 6) AS award_suppliers
FROM releases"""))
def q_field_coverage(spark, sf_dir):
    f = M.field_coverage(_rel(spark, sf_dir))
    return f.select("n_releases", *[r6(c).alias(c) for c in f.columns if c != "n_releases"])


@query("estimate_vs_award", with_views(["releases"], """
SELECT main_procurement_category AS category, count(*) AS n, round(sum(value_amount), 2) AS sum_estimate,
       round(sum(award_value), 2) AS sum_award, round(sum(award_value) / sum(value_amount), 6) AS ratio
FROM releases
WHERE value_amount IS NOT NULL AND award_value IS NOT NULL AND award_value <> 1.0 AND NOT value_private
GROUP BY main_procurement_category"""))
def q_estimate_vs_award(spark, sf_dir):
    e = M.estimate_vs_award(_rel(spark, sf_dir))
    return e.select("category", "n", r2("sum_estimate").alias("sum_estimate"), r2("sum_award").alias("sum_award"),
                    r6("ratio").alias("ratio"))


@query("result_by_month", with_views(["releases"], """
SELECT substr(date, 1, 7) AS month, coalesce(result_code, 'none') AS result_code, count(*) AS n_releases
FROM releases GROUP BY 1, 2"""))
def q_result_by_month(spark, sf_dir):
    return M.result_by_month(_rel(spark, sf_dir))


@query("result_status_by_month", with_views(["releases"], """
SELECT substr(date, 1, 7) AS month, coalesce(result_code, 'none') AS result_code, coalesce(status, 'none') AS status,
       count(*) AS n_releases
FROM releases GROUP BY 1, 2, 3"""))
def q_result_status_by_month(spark, sf_dir):
    return M.result_status_by_month(_rel(spark, sf_dir))


_CRIT = ("crit", """SELECT ocid, 'price' AS t, price_weight AS w FROM releases
                    UNION ALL SELECT ocid, 'quality', 100.0 - price_weight FROM releases""")


@query("criteria_weights", with_views(["releases"], """
SELECT t AS criterion_type, count(*) AS n, round(avg(w), 6) AS avg_weight, min(w) AS min_weight, max(w) AS max_weight
FROM crit GROUP BY t""", [_CRIT]))
def q_criteria_weights(spark, sf_dir):
    c = M.criteria_weights(_rel(spark, sf_dir))
    return c.select("criterion_type", "n", r6("avg_weight").alias("avg_weight"), "min_weight", "max_weight")


@query("criteria_sum_check", with_views(["releases"], """
SELECT count(*) AS n_releases, count(*) FILTER (WHERE abs(s - 100.0) < 1e-9) AS n_sum_100
FROM (SELECT ocid, sum(w) AS s FROM crit GROUP BY ocid)""", [_CRIT]))
def q_criteria_sum_check(spark, sf_dir):
    return M.criteria_sum_check(_rel(spark, sf_dir))


@query("nuts_rollup", with_views(["releases", "release_nuts"], """
SELECT CAST(level AS BIGINT) AS level, prefix, count(*) AS n_releases, round(sum(value), 2) AS total_value
FROM (SELECT DISTINCT n.ocid, r.value_amount AS value, lv.level, substr(n.nuts, 1, lv.level) AS prefix
      FROM (SELECT DISTINCT ocid, nuts FROM release_nuts) n JOIN releases r ON r.ocid = n.ocid
      JOIN (VALUES (2), (3), (4), (5)) lv(level) ON length(n.nuts) >= lv.level)
GROUP BY level, prefix"""))
def q_nuts_rollup(spark, sf_dir):
    n = M.nuts_rollup(_rel(spark, sf_dir))
    return n.select(F.col("level").cast("long").alias("level"), "prefix", "n_releases",
                    r2("total_value").alias("total_value"))


@query("award_lot_link", with_views(["releases", "lots"], """
SELECT r.ocid, l.lot_id, 'A-' || CAST(r.orderkey AS VARCHAR) AS award_id, s.n_suppliers,
       round(l.amount, 2) AS lot_amount, l.cpv AS item_cpv
FROM releases r JOIN lots l ON l.orderkey = r.orderkey
JOIN (SELECT orderkey, count(DISTINCT suppkey) FILTER (WHERE awarded AND supplier_name IS NOT NULL) AS n_suppliers
      FROM lots GROUP BY orderkey) s ON s.orderkey = r.orderkey
WHERE r.with_award AND l.awarded"""))
def q_award_lot_link(spark, sf_dir):
    a = M.award_lot_link(_rel(spark, sf_dir))
    return a.select("ocid", "lot_id", "award_id", F.col("n_suppliers").cast("long").alias("n_suppliers"),
                    r2("lot_amount").alias("lot_amount"), "item_cpv")


@query("open_tenders", with_views(["releases"], """
SELECT ocid, CASE WHEN list_contains(tag, 'tender') AND list_contains(tag, 'award') THEN 'closed'
                  WHEN list_contains(tag, 'tender') AND coalesce(status = 'active', FALSE) THEN 'open'
                  ELSE 'other' END AS state
FROM releases"""))
def q_open_tenders(spark, sf_dir):
    return M.lifecycle(_rel(spark, sf_dir))


@query("threshold_class", with_views(["releases"], """
SELECT ocid, main_procurement_category AS category,
       CAST(CASE WHEN main_procurement_category = 'works' THEN 5538000.0 ELSE 221000.0 END AS DOUBLE) AS threshold,
       CASE WHEN value_amount IS NULL THEN 'unknown'
            WHEN value_amount >= CASE WHEN main_procurement_category = 'works' THEN 5538000.0 ELSE 221000.0 END THEN 'above'
            ELSE 'below' END AS class
FROM releases"""))
def q_threshold_class(spark, sf_dir):
    return M.threshold_class(_rel(spark, sf_dir))


COMPETITOR_FILTER = FilterSpec(tag="award", has_awards=True)
COMPETITOR_K = 30
_cv, _cx = match_ctes(COMPETITOR_FILTER, COMPETITOR_K, "exact")


@query("competitors", with_views(_cv + ["lots"], f"""
SELECT m.profile_id, t.name, count(DISTINCT m.ocid) AS n_releases,
       count(DISTINCT CASE WHEN t.is_supplier THEN m.ocid END) AS n_won
FROM (SELECT profile_id, ocid FROM ranked WHERE rank <= {COMPETITOR_K}) m JOIN tenderers t ON t.ocid = m.ocid
GROUP BY m.profile_id, t.name""", _cx + [_TENDERERS]))
def q_competitors(spark, sf_dir):
    """Who wins the tenders that match each profile: match (award, with suppliers) -> parties -> counts."""
    t = Views(spark, sf_dir)
    return M.competitors(t.requests, t.profiles, t.chunks, t.releases, t.meta, k=COMPETITOR_K)
