"""Profile-table queries.

Snapshots, change batches and key sets are all derived from the driver's
``embeddings`` and ``documents`` tables by fixed rules, in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.operators import profiles as K
from tenderlake.plans.oracle_views import with_views
from tenderlake.plans.registry import ORACLE, iso, joined, query
from tenderlake.session import scratch_path
from tenderlake.sources.stored import Views

STRINGS = T.ArrayType(T.StringType())
_PVEC = "CAST(regexp_extract(p.id, '([0-9]+)$', 1) AS BIGINT)"


def _snapshot(t):
    return t.profiles


def _vec_id():
    return F.regexp_extract(F.col("id"), r"([0-9]+)$", 1).cast("long")


def _present(df):
    return df.select("id", "name", F.md5(F.col("description")).alias("description_md5"),
                     joined("cpv_codes").alias("cpv_codes"), joined("categories").alias("categories"),
                     "location", iso("created_at").alias("created_at"),
                     F.col("embedding").isNotNull().alias("has_embedding"))


_PRESENT_SQL = """id, name, md5(description) AS description_md5,
       array_to_string(list_sort(cpv_codes), ',') AS cpv_codes,
       array_to_string(list_sort(categories), ',') AS categories, location,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, embedding IS NOT NULL AS has_embedding"""


# ------------------------------------------------------------------ create (K1)

def _create_batch(t):
    d = t.documents
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
                    F.concat(F.lit("Org "), F.col("doc_id").cast("string")).alias("name"),
                    F.col("text").alias("description"),
                    F.when(F.col("lang") == "de", F.array(F.lit("45000000"))).alias("cpv_codes"),
                    F.col("source").alias("location"),
                    (F.lit("2024-02-01 00:00:00").cast("timestamp")
                     + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))).alias("created_at"))


@query("profile_create", with_views(["profiles"], f"""
SELECT {_PRESENT_SQL} FROM (
  SELECT id, name, description, cpv_codes, categories, location, created_at, embedding FROM profiles
  UNION ALL
  SELECT 'doc-' || CAST(doc_id AS VARCHAR), 'Org ' || CAST(doc_id AS VARCHAR), text,
         CASE WHEN lang = 'de' THEN ['45000000'] ELSE []::VARCHAR[] END, []::VARCHAR[], source,
         TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id), NULL
  FROM documents)"""))
def profile_create(spark, sf_dir):
    t = Views(spark, sf_dir)
    return _present(K.create_profiles(_snapshot(t), _create_batch(t))[0])


@query("profile_create_status", with_views(["profiles"], """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id, TRUE AS created, FALSE AS embedded FROM documents
UNION ALL SELECT id, FALSE, FALSE FROM profiles"""))
def profile_create_status(spark, sf_dir):
    """New ids are created once; ids that exist are reported and not inserted again."""
    t = Views(spark, sf_dir)
    batch = _create_batch(t)
    again = _snapshot(t).select("id", F.lit("Again").alias("name"), "description", "cpv_codes", "location", "created_at")
    return K.create_profiles(_snapshot(t), batch.unionByName(again))[1]


@query("profile_import", with_views(["profiles"], f"SELECT {_PRESENT_SQL}, CAST(len(embedding) AS BIGINT) AS dim FROM profiles"))
def profile_import(spark, sf_dir):
    """A table in the old layout (lists as JSON text, vectors as BLOBs) reads as the current one."""
    snap = _snapshot(Views(spark, sf_dir))
    old = K.vectors_to_blobs(snap).drop("embedding").withColumnRenamed("embedding_blob", "embedding")
    old = old.withColumn("cpv_codes", K.encode_json_array(F.col("cpv_codes"))).withColumn("categories", K.encode_json_array(F.col("categories")))
    c = K.conform(old)
    return _present(c).join(c.select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dim")), "id")


# ------------------------------------------------------------------ update (K2)

def _sup(flag, value, dtype):
    return F.struct(flag.alias("supplied"), F.when(flag, value).cast(dtype).alias("value"))


def _changes(t):
    snap = _snapshot(t).withColumn("__v", _vec_id())
    case = (F.col("__v") / 100).cast("long") % 5
    known = snap.select(
        "id",
        _sup(case == 0, F.concat(F.lit("Renamed "), F.col("__v").cast("string")), "string").alias("name"),
        _sup(case == 1, F.col("description"), "string").alias("description"),
        _sup(case == 4, F.array(F.lit("72000000")), STRINGS).alias("cpv_codes"),
        _sup(case == 4, F.array(F.lit("services")), STRINGS).alias("categories"),
        _sup(case == 2, F.lit(""), "string").alias("location"))
    no, yes = F.lit(False), F.lit(True)
    unknown = t.spark.range(2).select(
        F.concat(F.lit("profile-unknown-"), F.col("id").cast("string")).alias("id"),
        _sup(F.col("id") == 0, F.lit("Ghost"), "string").alias("name"),
        _sup(no, F.lit(None), "string").alias("description"),
        _sup(no, F.lit(None), STRINGS).alias("cpv_codes"),
        _sup(no, F.lit(None), STRINGS).alias("categories"),
        _sup(no & yes, F.lit(None), "string").alias("location"))
    return known.unionByName(unknown)


_UPD_CTE = [("chg", f"""
SELECT p.id, ({_PVEC} // 100) % 5 AS c FROM profiles p
UNION ALL SELECT 'profile-unknown-0', -1 UNION ALL SELECT 'profile-unknown-1', -2""")]


@query("profile_update", with_views(["profiles"], f"""
SELECT {_PRESENT_SQL} FROM (
  SELECT p.id,
         CASE WHEN c.c = 0 THEN 'Renamed ' || CAST({_PVEC} AS VARCHAR) ELSE p.name END AS name,
         p.description,
         CASE WHEN c.c = 4 THEN ['72000000'] ELSE p.cpv_codes END AS cpv_codes,
         CASE WHEN c.c = 4 THEN ['services'] ELSE p.categories END AS categories,
         CASE WHEN c.c = 2 THEN NULL ELSE p.location END AS location,
         p.created_at,
         CASE WHEN c.c = 1 THEN NULL ELSE p.embedding END AS embedding
  FROM profiles p LEFT JOIN chg c ON c.id = p.id)""", _UPD_CTE))
def profile_update(spark, sf_dir):
    t = Views(spark, sf_dir)
    nxt, _ = K.update_profiles(_snapshot(t), _changes(t))
    return _present(nxt)


@query("profile_update_bucketed", ORACLE["profile_update"])
def profile_update_bucketed(spark, sf_dir):
    """The same changes on a bucketed table: only the buckets of the changed ids are rewritten."""
    t = Views(spark, sf_dir)
    base = scratch_path(spark, "profile-buckets")
    K.write_buckets(_snapshot(t), base, buckets=16)
    K.change_buckets(spark, base, _changes(t), K.update_profiles, buckets=16)
    return _present(K.read_buckets(spark, base))


@query("profile_update_status", with_views(["profiles"], """
SELECT c.id, p.id IS NOT NULL AS updated, (p.id IS NOT NULL AND c.c = 1) AS needs_embedding
FROM chg c LEFT JOIN profiles p ON p.id = c.id""", _UPD_CTE))
def profile_update_status(spark, sf_dir):
    t = Views(spark, sf_dir)
    _, status = K.update_profiles(_snapshot(t), _changes(t))
    return status


# ------------------------------------------------------------- delete

def _delete_keys(t):
    snap = _snapshot(t).withColumn("__v", _vec_id())
    known = snap.filter(((F.col("__v") / 100).cast("long") % 2) == 0).select("id")
    return known.unionByName(t.spark.range(1).select(F.lit("profile-unknown").alias("id")))


_DEL_CTE = [("dk", f"""SELECT p.id FROM profiles p WHERE ({_PVEC} // 100) % 2 = 0
                       UNION ALL SELECT 'profile-unknown'""")]


@query("profile_delete", with_views(["profiles"], """
SELECT id, embedding IS NOT NULL AS has_embedding FROM profiles WHERE id NOT IN (SELECT id FROM dk)""", _DEL_CTE))
def profile_delete(spark, sf_dir):
    t = Views(spark, sf_dir)
    nxt, _ = K.delete_profiles(_snapshot(t), _delete_keys(t))
    return nxt.select("id", F.col("embedding").isNotNull().alias("has_embedding"))


@query("profile_delete_status", with_views(["profiles"], """
SELECT dk.id, p.id IS NOT NULL AS deleted FROM dk LEFT JOIN profiles p ON p.id = dk.id""", _DEL_CTE))
def profile_delete_status(spark, sf_dir):
    t = Views(spark, sf_dir)
    _, status = K.delete_profiles(_snapshot(t), _delete_keys(t))
    return status


# ------------------------------------------------------- lookup / list

def _request_keys(t):
    return t.requests.select(F.col("profile_id").alias("id"))


@query("profile_exists", with_views(["profiles", "requests"], """
SELECT DISTINCT q.profile_id AS id FROM requests q WHERE q.profile_id IN (SELECT id FROM profiles)"""))
def profile_exists(spark, sf_dir):
    t = Views(spark, sf_dir)
    return K.profiles_exist(_snapshot(t), _request_keys(t))


@query("profile_lookup", with_views(["profiles", "requests"], """
SELECT q.profile_id AS id, p.id IS NOT NULL AS found, p.name, md5(p.description) AS description_md5,
       array_to_string(list_sort(p.cpv_codes), ',') AS cpv_codes,
       array_to_string(list_sort(p.categories), ',') AS categories, p.location,
       strftime(p.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
       p.embedding IS NOT NULL AS has_embedding
FROM requests q LEFT JOIN profiles p ON p.id = q.profile_id"""))
def profile_lookup(spark, sf_dir):
    t = Views(spark, sf_dir)
    g = K.get_profiles(_request_keys(t), _snapshot(t))
    return g.select("id", "found", "name", F.md5("description").alias("description_md5"),
                    joined("cpv_codes").alias("cpv_codes"), joined("categories").alias("categories"),
                    "location", iso("created_at").alias("created_at"),
                    (F.col("found") & F.col("has_embedding")).alias("has_embedding"))


@query("profile_list", with_views(["profiles"], """
SELECT id, name, array_to_string(list_sort(cpv_codes), ',') AS cpv_codes,
       array_to_string(list_sort(categories), ',') AS categories, location,
       strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, embedding IS NOT NULL AS has_embedding
FROM profiles ORDER BY created_at DESC, id"""))
def profile_list(spark, sf_dir):
    lst = K.list_profiles(_snapshot(Views(spark, sf_dir)))
    return lst.select("id", "name", joined("cpv_codes").alias("cpv_codes"), joined("categories").alias("categories"),
                      "location", iso("created_at").alias("created_at"), "has_embedding")


@query("profile_count", with_views(["profiles"], "SELECT count(*) AS count FROM profiles"))
def profile_count(spark, sf_dir):
    return K.count_profiles(_snapshot(Views(spark, sf_dir)))


@query("unembedded_profiles", with_views(["profiles"], "SELECT id, name FROM profiles WHERE embedding IS NULL"))
def unembedded_profiles(spark, sf_dir):
    return K.unembedded(_snapshot(Views(spark, sf_dir))).select("id", "name")


# ------------------------------------------------------- encodings

def _json_snapshot(t):
    snap = _snapshot(t).withColumn("__v", _vec_id())
    case = (F.col("__v") / 100).cast("long") % 3
    txt = K.encode_json_array(F.col("cpv_codes"))
    return snap.select("id", F.when(case == 0, txt)
                       .when(case == 1, F.expr("substring(to_json(cpv_codes), 1, length(to_json(cpv_codes)) - 1)"))
                       .alias("cpv_json"),
                       K.encode_json_array(F.col("categories")).alias("categories_json"))


@query("profile_json_arrays", with_views(["profiles"], f"""
SELECT id, cpv_json,
       array_to_string(CASE WHEN json_valid(cpv_json) AND json_type(cpv_json) = 'ARRAY'
                            THEN CAST(CAST(cpv_json AS JSON) AS VARCHAR[]) ELSE []::VARCHAR[] END, ',') AS cpv_codes,
       array_to_string(CASE WHEN json_valid(categories_json) AND json_type(categories_json) = 'ARRAY'
                            THEN CAST(CAST(categories_json AS JSON) AS VARCHAR[]) ELSE []::VARCHAR[] END, ',') AS categories
FROM (SELECT p.id,
             CASE ({_PVEC} // 100) % 3 WHEN 0 THEN to_json(p.cpv_codes)::VARCHAR
                  WHEN 1 THEN left(to_json(p.cpv_codes)::VARCHAR, length(to_json(p.cpv_codes)::VARCHAR) - 1) END AS cpv_json,
             to_json(p.categories)::VARCHAR AS categories_json
      FROM profiles p)"""))
def profile_json_arrays(spark, sf_dir):
    js = _json_snapshot(Views(spark, sf_dir))
    return js.select("id", "cpv_json", F.array_join(K.decode_json_array(F.col("cpv_json")), ",").alias("cpv_codes"),
                     F.array_join(K.decode_json_array(F.col("categories_json")), ",").alias("categories"))


@query("profile_schema_evolution", with_views(["profiles"], """
SELECT id, embedding IS NOT NULL AS has_embedding, array_to_string(list_sort(cpv_codes), ',') AS cpv_codes
FROM profiles"""))
def profile_schema_evolution(spark, sf_dir):
    """An old-layout snapshot (no vector column) read together with a current one."""
    snap = _snapshot(Views(spark, sf_dir))
    old = snap.filter(F.col("embedding").isNull()).drop("embedding")
    new = snap.filter(F.col("embedding").isNotNull())
    both = K.conform(new.unionByName(old, allowMissingColumns=True))
    return both.select("id", F.col("embedding").isNotNull().alias("has_embedding"),
                       joined("cpv_codes").alias("cpv_codes"))


@query("profile_vector_import", with_views(["profiles"], """
SELECT id, CAST(len(embedding) AS BIGINT) AS dim, TRUE AS same FROM profiles WHERE embedding IS NOT NULL"""))
def profile_vector_import(spark, sf_dir):
    """Vectors exported to raw f32 BLOBs and imported back are bit-identical (A4)."""
    snap = _snapshot(Views(spark, sf_dir)).filter(F.col("embedding").isNotNull())
    blobs = K.vectors_to_blobs(snap.select("id", F.col("embedding").alias("orig")), vec_col="orig")
    back = K.vectors_from_blobs(blobs)
    return back.select("id", F.size("embedding").cast("long").alias("dim"),
                       (F.col("embedding") == F.col("orig")).alias("same"))
