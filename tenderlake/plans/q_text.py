"""Text and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.functions.text import truncate_utf8, with_role_prefix
from tenderlake.functions.vectors import l2_normalize
from tenderlake.operators.chunks import build_chunks
from tenderlake.operators.embed import MODEL_DIM, hash_embed, mean_pool
from tenderlake.operators.search import search_text
from tenderlake.plans.oracle_views import with_views
from tenderlake.plans.registry import joined, query, r6
from tenderlake.plans.sql_filters import truncate_sql
from tenderlake.sources.stored import Views

K = 10
DIM = MODEL_DIM
SPLIT_SQL = r"'[^\p{L}\p{N}]+'"


@query("truncate_text", with_views([], f"SELECT doc_id, {truncate_sql('text')} AS text FROM documents"))
def q_truncate_text(spark, sf_dir):
    d = Views(spark, sf_dir).documents
    return d.select("doc_id", truncate_utf8(F.col("text"), 200).alias("text"))


@query("embed_prefix", with_views([], """
SELECT doc_id, md5('query: ' || text) AS query_md5, md5('passage: ' || text) AS passage_md5 FROM documents"""))
def q_embed_prefix(spark, sf_dir):
    d = Views(spark, sf_dir).documents
    return d.select("doc_id", F.md5(with_role_prefix("text", "query")).alias("query_md5"),
                    F.md5(with_role_prefix("text", "passage")).alias("passage_md5"))


@query("l2_normalize", with_views([], """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 6) AS value FROM (
  SELECT vec_id, unnest(range(len(v))) AS dim, unnest(v) AS x, nrm FROM (
    SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 1 + vec_id % 5 END) AS v
      FROM embeddings)))"""))
def q_l2_normalize(spark, sf_dir):
    e = Views(spark, sf_dir).embeddings
    k = F.when(F.col("vec_id") % 50 == 0, F.lit(0)).otherwise(F.lit(1) + F.col("vec_id") % 5).cast("double")
    scaled = F.transform("embedding", lambda x: x.cast("double") * k)
    n = e.select("vec_id", l2_normalize(scaled, as_float=False).alias("v"))
    return n.select("vec_id", F.posexplode("v").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), r6("x").alias("value"))


_TOK_SQL = """SELECT vec_id // 4 AS text_id, vec_id % 4 AS pos,
       CASE WHEN vec_id % 7 = 0 OR (vec_id // 4) % 25 = 0 THEN 0 ELSE 1 END AS mask, embedding AS hidden
FROM embeddings"""


@query("mean_pool", with_views([], """
SELECT pd.text_id, CAST(pd.dim AS BIGINT) AS dim, round(CASE WHEN nrm > 0 THEN m / nrm ELSE m END, 6) AS value
FROM pd JOIN (SELECT text_id, sqrt(sum(m * m)) AS nrm FROM pd GROUP BY text_id) nr USING (text_id)""",
                                [("tok", _TOK_SQL),
                                 ("ex", "SELECT text_id, mask, unnest(range(len(hidden))) AS dim, unnest(hidden) AS x FROM tok"),
                                 ("pd", """SELECT text_id, dim,
        CASE WHEN count(*) FILTER (WHERE mask > 0) > 0
             THEN sum(CAST(x AS DOUBLE)) FILTER (WHERE mask > 0) / count(*) FILTER (WHERE mask > 0) ELSE 0.0 END AS m
        FROM ex GROUP BY text_id, dim""")]))
def q_mean_pool(spark, sf_dir):
    e = Views(spark, sf_dir).embeddings
    v = F.col("vec_id")
    tokens = e.select((v / 4).cast("long").alias("text_id"), (v % 4).alias("pos"),
                      F.when((v % 7 == 0) | (((v / 4).cast("long") % 25) == 0), F.lit(0)).otherwise(F.lit(1)).alias("mask"),
                      F.col("embedding").alias("hidden"))
    pooled = mean_pool(tokens)
    return pooled.select("text_id", F.posexplode("embedding").alias("dim", "x")).select(
        "text_id", F.col("dim").cast("long").alias("dim"), r6("x").alias("value"))


def _bucket_sql(src: str, id_col: str, text_col: str) -> str:
    return f"""SELECT {id_col} AS id, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS UBIGINT) % {DIM} AS INTEGER) AS bucket,
                      count(*) AS cnt
               FROM (SELECT {id_col}, unnest(regexp_split_to_array(lower({text_col}), {SPLIT_SQL})) AS tok FROM {src})
               WHERE tok <> '' GROUP BY 1, 2"""


def _weights_sql(buckets: str) -> str:
    return f"""SELECT b.id, b.bucket, CAST(CAST(b.cnt / sqrt(n.ss) AS FLOAT) AS DOUBLE) AS w
               FROM {buckets} b JOIN (SELECT id, sum(cnt * cnt) AS ss FROM {buckets} GROUP BY id) n USING (id)"""


@query("hash_embed", with_views([], "SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM dw",
                                [("db", _bucket_sql("documents", "doc_id", "text")), ("dw", _weights_sql("db"))]))
def q_hash_embed(spark, sf_dir):
    d = Views(spark, sf_dir).documents
    v = hash_embed(d, "doc_id", "text", DIM)
    ex = v.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter(F.col("w") != 0)
    return ex.select("doc_id", "bucket", r6("w").alias("weight"))


@query("search_topk", with_views(["chunks"], f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, ocid, chunk_type, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT s.qid AS query_id, s.cid AS doc_id, c.ocid, c.chunk_type,
           round(s.dot / (qn.n * cn.n), 6) AS score
    FROM (SELECT q.id AS qid, c.id AS cid, sum(q.w * c.w) AS dot FROM qw q JOIN cw c USING (bucket) GROUP BY 1, 2) s
    JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM qw GROUP BY id) qn ON qn.id = s.qid
    JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM cw GROUP BY id) cn ON cn.id = s.cid
    JOIN chunks c ON c.doc_id = s.cid))
WHERE rank <= {K}""", [("qb", _bucket_sql("benchmark", "item_id", "text")), ("qw", _weights_sql("qb")),
                        ("cb", _bucket_sql("chunks", "doc_id", "text")), ("cw", _weights_sql("cb"))]),
       headline=True)
def q_search_topk(spark, sf_dir):
    t = Views(spark, sf_dir)
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    hits = search_text(queries, t.chunks, k=K, dim=DIM, corpus_vectors=t.chunk_hash_vectors)
    return hits.select("query_id", "rank", "doc_id", "ocid", "chunk_type", r6("score").alias("score"))


_NUTS_ORDERED = """SELECT ocid, string_agg(nuts, ',' ORDER BY first_pos) AS nuts
                   FROM (SELECT ocid, nuts, min(pos) AS first_pos FROM release_nuts GROUP BY ocid, nuts) GROUP BY ocid"""
_CPVS = "SELECT ocid, array_to_string(list_sort(list(cpv)), ',') AS cpvs FROM release_cpvs GROUP BY ocid"


def _f(label: str, v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL AND CAST({v} AS VARCHAR) <> '' THEN '{label}: ' || CAST({v} AS VARCHAR) END"


_SUMMARY_TXT = "concat_ws(chr(10), " + ", ".join([
    _f("Auftraggeber", "r.buyer_name"), _f("Titel", "r.title"), _f("Verfahren", "r.procurement_method"),
    _f("Kategorie", "r.main_procurement_category"), _f("Frist", "coalesce(r.submission_deadline, r.deadline)"),
    _f("NUTS", "n.nuts")]) + ")"
_TENDER_TXT = "concat_ws(chr(10), " + ", ".join([
    _f("Titel", "r.title"), _f("Beschreibung", "r.description"), _f("Verfahren", "r.procurement_method"),
    _f("Kategorie", "r.main_procurement_category"),
    _f("Wert", "CASE WHEN r.value_amount IS NOT NULL THEN printf('%.2f', r.value_amount) || ' ' || r.value_currency END"),
    _f("Frist", "coalesce(r.submission_deadline, r.deadline)"), _f("Auftraggeber", "r.buyer_name"),
    _f("CPV", "cp.cpvs"),
    _f("Zuschlagskriterien", "'price ' || printf('%.0f', r.price_weight) || '%, quality ' || printf('%.0f', 100.0 - r.price_weight) || '%'"),
    _f("Ergebnis", "r.result_code")]) + ")"
_LOT_TXT = "concat_ws(chr(10), " + ", ".join([
    _f("Los", "'Los ' || l.lot_id"), _f("Wert", "printf('%.2f', l.amount) || ' EUR'")]) + ")"


@query("build_chunks", with_views(["releases", "release_nuts", "release_cpvs", "lots"], f"""
SELECT r.ocid || '#summary' AS doc_id, r.ocid, 'summary' AS chunk_type, {_SUMMARY_TXT} AS text, coalesce(cp.cpvs, '') AS cpv_codes
FROM releases r LEFT JOIN nn n ON n.ocid = r.ocid LEFT JOIN cp ON cp.ocid = r.ocid
UNION ALL
SELECT r.ocid || '#tender', r.ocid, 'tender', {_TENDER_TXT}, coalesce(cp.cpvs, '')
FROM releases r LEFT JOIN cp ON cp.ocid = r.ocid
UNION ALL
SELECT r.ocid || '#lot:' || l.lot_id, r.ocid, 'lot:' || l.lot_id, {_LOT_TXT}, coalesce(cp.cpvs, '')
FROM releases r JOIN lots l ON l.orderkey = r.orderkey LEFT JOIN cp ON cp.ocid = r.ocid""",
                                  [("nn", _NUTS_ORDERED), ("cp", _CPVS)]))
def q_build_chunks(spark, sf_dir):
    c = build_chunks(Views(spark, sf_dir).releases)
    return c.select("doc_id", "ocid", "chunk_type", "text", joined("cpv_codes").alias("cpv_codes"))
