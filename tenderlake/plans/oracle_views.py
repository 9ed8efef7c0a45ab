"""DuckDB SQL for the procurement views (FIXTURES.md section 4).

These CTEs restate, in flat SQL, the same rules ``tenderlake.sources.procurement``
builds with the DataFrame API; every oracle query is ``WITH <views> SELECT ...``.
"""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%SZ'"

VIEWS: dict[str, str] = {}
DEPENDS: dict[str, tuple[str, ...]] = {}


def view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = sql
    DEPENDS[name] = deps


view("lots", """
SELECT g.orderkey, g.lot_num, CAST(g.lot_num AS VARCHAR) AS lot_id, g.amount, g.quantity,
       g.suppkey, s.s_name AS supplier_name, g.partkey, g.awarded,
       (CASE p.p_type WHEN 'ECONOMY' THEN '33' WHEN 'SMALL' THEN '45' WHEN 'MEDIUM' THEN '72'
                      WHEN 'PROMO' THEN '48' WHEN 'STANDARD' THEN '79' WHEN 'LARGE' THEN '90' END)
         || lpad(CAST(g.partkey % 1000000 AS VARCHAR), 6, '0') AS cpv,
       CASE WHEN n.n_nationkey IS NOT NULL
            THEN 'DE' || CAST(n.n_regionkey AS VARCHAR) || CAST(n.n_nationkey % 10 AS VARCHAR) END AS nuts
FROM (SELECT l_orderkey AS orderkey, l_linenumber AS lot_num, sum(l_extendedprice) AS amount,
             sum(l_quantity) AS quantity, min(l_suppkey) AS suppkey, min(l_partkey) AS partkey,
             bool_or(l_returnflag = 'A') AS awarded
      FROM lineitem GROUP BY l_orderkey, l_linenumber) g
LEFT JOIN part p ON p.p_partkey = g.partkey
LEFT JOIN supplier s ON s.s_suppkey = g.suppkey
LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
""")

view("lot_orders", """
SELECT orderkey,
       bool_or(awarded) AS any_awarded,
       bool_or(awarded AND supplier_name IS NOT NULL) AS awarded_with_supplier,
       sum(CASE WHEN awarded THEN amount END) AS awarded_amount,
       count(DISTINCT suppkey) AS n_bidders,
       count(DISTINCT CASE WHEN supplier_name IS NOT NULL THEN suppkey END) AS n_tenderers,
       min(lot_num) AS first_lot
FROM lots GROUP BY orderkey
""", ("lots",))

view("releases", f"""
SELECT 'ocds-' || CAST(o.o_orderkey AS VARCHAR) AS ocid,
       'N-' || CAST(o.o_orderkey AS VARCHAR) AS notice_id,
       o.o_orderkey AS orderkey, o.o_custkey AS custkey, o.o_orderstatus AS order_status,
       strftime(o.o_orderdate, {ISO}) AS date,
       'Tender ' || CAST(o.o_orderkey AS VARCHAR) AS title,
       d.text AS description,
       c.c_name AS buyer_name,
       CASE o.o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'active' WHEN 'P' THEN 'planning' END AS status,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'direct' WHEN '2-HIGH' THEN 'limited'
            WHEN '3-MEDIUM' THEN 'selective' WHEN '5-LOW' THEN 'open' END AS procurement_method,
       o.o_orderpriority AS procurement_method_details,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'works' WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'services'
            ELSE 'goods' END AS main_procurement_category,
       CASE WHEN o.o_orderkey % 7 <> 0 THEN o.o_totalprice END AS value_amount,
       'EUR' AS value_currency,
       strftime(o.o_orderdate, {ISO}) AS start_date,
       strftime(o.o_orderdate + INTERVAL 30 DAY, {ISO}) AS deadline,
       CASE WHEN o.o_orderkey % 3 <> 0 THEN strftime(o.o_orderdate + INTERVAL 21 DAY, {ISO}) END AS submission_deadline,
       CASE WHEN o.o_orderkey % 5 = 0 THEN TRUE WHEN o.o_orderkey % 5 = 1 THEN NULL ELSE FALSE END AS eu_funded,
       CASE o.o_orderstatus WHEN 'F' THEN ['tender', 'award'] WHEN 'O' THEN ['tender']
            WHEN 'P' THEN ['planning'] ELSE []::VARCHAR[] END AS tag,
       (o.o_orderstatus = 'F' AND coalesce(lo.any_awarded, FALSE)) AS with_award,
       (o.o_orderstatus = 'F' AND coalesce(lo.awarded_with_supplier, FALSE)) AS has_awards,
       CASE WHEN o.o_orderstatus = 'F' AND coalesce(lo.any_awarded, FALSE) THEN 'selec-w'
            WHEN o.o_orderstatus = 'F' THEN 'clos-nw'
            WHEN o.o_orderstatus = 'O' THEN 'open-nw' END AS result_code,
       CASE WHEN o.o_orderstatus = 'F' AND coalesce(lo.any_awarded, FALSE)
            THEN (CASE WHEN o.o_orderkey % 13 = 0 THEN 1.0 ELSE lo.awarded_amount END) END AS award_value,
       (o.o_orderstatus = 'F' AND coalesce(lo.any_awarded, FALSE) AND o.o_orderkey % 17 = 0) AS value_private,
       CASE WHEN o.o_orderkey % 5 = 2 THEN 'https://vergabe.example.org/unterlagen/' || CAST(o.o_orderkey AS VARCHAR) END AS documents_url,
       CASE WHEN cn.n_nationkey IS NOT NULL
            THEN 'DE' || CAST(cn.n_regionkey AS VARCHAR) || CAST(cn.n_nationkey % 10 AS VARCHAR) END AS buyer_nuts,
       CAST(30 + 10 * (o.o_orderkey % 5) AS DOUBLE) AS price_weight,
       coalesce(lo.n_tenderers, 0) AS n_tenderers
FROM orders o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation cn ON cn.n_nationkey = c.c_nationkey
LEFT JOIN lot_orders lo ON lo.orderkey = o.o_orderkey
LEFT JOIN documents d ON d.doc_id = o.o_orderkey
""", ("lot_orders",))

# every NUTS code of a release with its position: tender location (0), then lots
view("release_nuts", """
SELECT ocid, buyer_nuts AS nuts, 0 AS pos FROM releases WHERE buyer_nuts IS NOT NULL
UNION ALL
SELECT r.ocid, l.nuts, l.lot_num AS pos FROM releases r JOIN lots l ON l.orderkey = r.orderkey
WHERE l.nuts IS NOT NULL
""", ("releases", "lots"))

view("party_nuts", """
SELECT ocid, buyer_nuts AS nuts FROM releases WHERE buyer_nuts IS NOT NULL
UNION ALL
SELECT r.ocid, l.nuts FROM releases r JOIN lots l ON l.orderkey = r.orderkey
WHERE l.nuts IS NOT NULL AND l.supplier_name IS NOT NULL
""", ("releases", "lots"))

view("release_cpvs", """
SELECT DISTINCT r.ocid, l.cpv FROM releases r JOIN lots l ON l.orderkey = r.orderkey WHERE l.cpv IS NOT NULL
""", ("releases", "lots"))

view("chunks", """
SELECT CAST(e.vec_id AS VARCHAR) AS doc_id,
       CASE WHEN (e.vec_id // 3) % 11 = 10 THEN 'ocds-withdrawn-' ELSE 'ocds-' END || CAST(e.vec_id // 3 AS VARCHAR) AS ocid,
       CASE e.vec_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'tender' ELSE 'lot:1' END AS chunk_type,
       d.text AS text,
       coalesce(cp.cpv_codes, []::VARCHAR[]) AS cpv_codes,
       e.embedding
FROM embeddings e
LEFT JOIN documents d ON d.doc_id = e.vec_id
LEFT JOIN (SELECT orderkey, list_sort(list_distinct(list(cpv))) AS cpv_codes
           FROM lots WHERE cpv IS NOT NULL GROUP BY orderkey) cp ON cp.orderkey = e.vec_id // 3
WHERE e.vec_id % 100 < 98
""", ("lots",))

view("profiles", """
SELECT 'profile-' || CAST(e.vec_id AS VARCHAR) AS id,
       'Company ' || CAST(e.vec_id AS VARCHAR) AS name,
       coalesce(d.text, '') AS description,
       CASE WHEN e.vec_id % 2 = 1 THEN ['45000000', '72000000'] ELSE []::VARCHAR[] END AS cpv_codes,
       CASE WHEN e.vec_id % 2 = 1 THEN ['works'] ELSE []::VARCHAR[] END AS categories,
       CASE WHEN e.vec_id % 2 = 1 THEN 'Kassel, Hessen' END AS location,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(e.vec_id // 100 AS INTEGER)) AS created_at,
       CASE WHEN e.vec_id % 100 = 99 THEN e.embedding END AS embedding
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
WHERE e.vec_id % 100 >= 98
""")

view("requests", """
SELECT id AS profile_id FROM profiles UNION ALL SELECT 'profile-unknown' AS profile_id
""", ("profiles",))

view("notices", """
SELECT event_id AS notice_id,
       'ocds-ev-' || CAST(user_id * 20 + event_id % 20 AS VARCHAR) AS ocid,
       ts,
       CASE WHEN event_type = 'view' THEN 'planning' WHEN event_type IN ('click', 'signup') THEN 'tender'
            WHEN event_type = 'purchase' THEN 'award' END AS phase,
       CASE event_type WHEN 'view' THEN 'planning' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'complete' END AS status,
       CASE event_type WHEN 'click' THEN props WHEN 'signup' THEN '' END AS description,
       CASE WHEN event_type = 'purchase' THEN value END AS award_value
FROM events
""")

# pairwise cosine of two FLOAT[] columns, 0 for a zero vector, rounded like the top-k operator
def cosine_sql(a: str, b: str, digits: int = 6) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    na, nb = f"sqrt(list_dot_product({da}, {da}))", f"sqrt(list_dot_product({db}, {db}))"
    return (f"round(CASE WHEN {na} > 0 AND {nb} > 0 THEN list_dot_product({da}, {db}) / ({na} * {nb}) "
            f"ELSE 0.0 END, {digits})")


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in DEPENDS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names, body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` the named views (and what they depend on), extra CTEs, then ``body``."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in _closure(names)]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
