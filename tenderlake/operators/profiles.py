"""Company-profile table maintained in bulk.

The table is a versioned parquet snapshot; every operation takes the current
snapshot plus a batch of requests and returns the next snapshot (and, where
the reference reports an outcome, a status frame).  All are joins on ``id``
(hash-partitioned; no broadcast of a side whose size is not bounded).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S
from tenderlake.session import write_once

PROFILE_COLUMNS = ("id", "name", "description", "cpv_codes", "categories", "location",
                   "created_at", "embedding")
SUMMARY_COLUMNS = ("id", "name", "cpv_codes", "categories", "location", "created_at", "has_embedding")
CHANGE_FIELDS = ("name", "description", "cpv_codes", "categories", "location")
STRINGS = T.ArrayType(T.StringType())


def _strings_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(STRINGS))


# ------------------------------------------------------------------ encoding

def decode_json_array(text: Column) -> Column:
    """JSON text -> array<string>; NULL, malformed or non-array text, or one with a null in it, gives [] (A3)."""
    parsed = F.from_json(text, STRINGS)
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json(text)), F.lit(""))
    ok = (shape == "ARRAY<STRING>") & ~F.exists(parsed, lambda x: x.isNull())
    return F.when(ok, _strings_or_empty(parsed)).otherwise(F.array().cast(STRINGS))


def encode_json_array(arr: Column) -> Column:
    """array<string> -> compact JSON text."""
    return F.to_json(_strings_or_empty(arr))


def conform(df: DataFrame) -> DataFrame:
    """Bring any profile frame to the current schema (A3, A4, A5): lists stored as JSON text are decoded, a
    binary vector is read as little-endian f32, and an old snapshot without ``embedding`` gains a NULL
    vector; rows are kept."""
    cols = set(df.columns)
    out = df
    for c in ("cpv_codes", "categories"):
        if c in cols and isinstance(df.schema[c].dataType, T.StringType):
            out = out.withColumn(c, decode_json_array(F.col(c)))
    if "embedding" in cols and isinstance(df.schema["embedding"].dataType, T.BinaryType):
        out = vectors_from_blobs(out, "embedding", "embedding")
    for f in S.PROFILE.fields:
        if f.name not in cols:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = (out.withColumn("cpv_codes", _strings_or_empty(F.col("cpv_codes").cast(STRINGS)))
              .withColumn("categories", _strings_or_empty(F.col("categories").cast(STRINGS))))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.PROFILE.fields])


def read_profiles(spark: SparkSession, *paths: str) -> DataFrame:
    """Read snapshots, old and new layouts alike.

    A path that holds versions (``v=<n>``) is read as its latest one; several paths are read together,
    each in its own layout."""
    frames = []
    for path in paths:
        df = conform(spark.read.parquet(_latest(spark, path)))
        frames.append(df)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _latest(spark: SparkSession, path: str) -> str:
    """``path``, or its folder ``v=<n>`` of the largest n (found through Spark's own file listing)."""
    if re.search(r"/v=\d+/?$", path):
        return path
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
             .select(F.regexp_extract("path", r"/v=(\d+)/[^/]*$", 1).alias("v")).filter("v <> ''")
             .agg(F.max(F.col("v").cast("bigint"))).first()[0])
    return path if found is None else f"{path.rstrip('/')}/v={found}"


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write the next durable snapshot ``base/v=<version>`` (A7); returns its path."""
    path = f"{base.rstrip('/')}/v={int(version)}"
    conform(df).write.mode("errorifexists").parquet(path)
    return path


# ---------------------------------------------------------------- bucketed table

BUCKETS = 256


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """Write a profile table in ``buckets`` folders by hash of the id (A7), for changes that rewrite few of them.

    Each folder also holds one row without an id, so that a bucket whose last profile goes is rewritten as well."""
    rows = conform(df).withColumn("bucket", _bucket(buckets))
    empty = df.sparkSession.range(buckets).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in conform(df).schema.fields],
                                                  F.col("id").cast("int").alias("bucket"))
    (rows.unionByName(empty).repartition("bucket").sortWithinPartitions("bucket", "id")
     .write.mode("errorifexists").partitionBy("bucket").parquet(base))


def read_buckets(spark: SparkSession, base: str) -> DataFrame:
    """The profiles of a bucketed table, with their ``bucket``."""
    return spark.read.parquet(base).filter(F.col("id").isNotNull())


def change_buckets(spark: SparkSession, base: str, batch: DataFrame, change, buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """Apply ``change(snapshot, batch) -> (next, status)`` (K1-K3) to the buckets that the batch's ids fall into.

    Only those folders are read and rewritten (``partitionOverwriteMode=dynamic``); the others stay as they are.  Returns the status
    rows and the rewritten buckets.  ``batch`` needs ids; give new profiles theirs first.  The next rows are written to the shared
    folder before a bucket is replaced, so a failed change leaves the table as it was or can be run again."""
    kept = write_once(batch, "profile-batch")
    touched = sorted(r["b"] for r in kept.filter(F.col("id").isNotNull()).select(_bucket(buckets).alias("b")).distinct().collect())   # at most ``buckets``
    snapshot = read_buckets(spark, base).filter(F.col("bucket").isin(touched) if touched else F.lit(False)).drop("bucket")
    nxt, status = change(snapshot, kept)
    status = write_once(status, "profile-status")
    rows = write_once(conform(nxt).withColumn("bucket", _bucket(buckets)), "profile-buckets")
    if touched:
        marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
        marks = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "bucket"], "bucket")
        (rows.unionByName(marks).repartition("bucket").sortWithinPartitions("bucket", "id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(base))
    return status, touched


# ---------------------------------------------------------------- operations

def create_profiles(snapshot: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert a batch (K1).  Returns (next snapshot, status[id, created, embedded]).

    Arrays default to [], the vector is NULL until embedded.  ``id`` and ``created_at`` are taken from
    the batch when present, else a random UUID and the current UTC time (H12).  An id that exists, or that
    repeats within the batch, is not inserted again: the existing row, or the first by content, stays."""
    cols = set(batch.columns)
    new = batch.select(
        (F.col("id") if "id" in cols else F.expr("uuid()")).alias("id"),
        "name", "description",
        _strings_or_empty(F.col("cpv_codes") if "cpv_codes" in cols else F.lit(None).cast(STRINGS)).alias("cpv_codes"),
        _strings_or_empty(F.col("categories") if "categories" in cols else F.lit(None).cast(STRINGS)).alias("categories"),
        (F.col("location") if "location" in cols else F.lit(None).cast("string")).alias("location"),
        (F.col("created_at") if "created_at" in cols else F.current_timestamp()).alias("created_at"),
        F.lit(None).cast(S.VECTOR).alias("embedding"))
    new = write_once(conform(new), "new-profiles")      # random ids are drawn once
    snap = conform(snapshot)
    known = snap.select("id").withColumn("__known", F.lit(True))
    first = Window.partitionBy("id").orderBy("__known", "name", "description", "location", "created_at", F.xxhash64("cpv_codes", "categories"))
    marked = new.join(known, "id", "left").withColumn("__n", F.row_number().over(first))
    fresh = F.col("__known").isNull() & (F.col("__n") == 1)
    status = marked.select("id", fresh.alias("created"), F.lit(False).alias("embedded"))
    return snap.unionByName(marked.filter(fresh).select(*PROFILE_COLUMNS)), status


def _fold_changes(changes: DataFrame) -> DataFrame:
    """Several changes for one id apply in ``seq`` order: per field the last supplied value wins.

    Without ``seq`` one change of an id may supply fields; a second would have no defined order and is an error."""
    if "seq" in changes.columns:
        seq = F.col("seq")
    else:
        twice = F.raise_error(F.lit("several changes for one id need a seq column")).cast("int")
        supplies = functools.reduce(lambda a, b: a | b, [F.coalesce(F.col(f)["supplied"], F.lit(False)) for f in CHANGE_FIELDS if f in changes.columns], F.lit(False))
        count = F.count_if(supplies).over(Window.partitionBy("id"))
        changes = changes.withColumn("__seq", F.when(count > 1, twice).otherwise(F.lit(0)))
        seq = F.col("__seq")
    aggs = []
    for f in CHANGE_FIELDS:
        if f not in changes.columns:
            continue
        sup = F.col(f)["supplied"]
        aggs.append(F.max_by(F.col(f)["value"], F.when(F.coalesce(sup, F.lit(False)), seq)).alias(f"{f}__v"))
        aggs.append(F.bool_or(F.coalesce(sup, F.lit(False))).alias(f"{f}__s"))
    return changes.groupBy("id").agg(*aggs)


def update_profiles(snapshot: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply partial updates (K2).  Returns (next snapshot, status[id, updated, needs_embedding]).

    Only supplied fields change; any supplied description (even an identical
    one) clears the vector; a supplied ``location`` of ``""`` sets NULL; a
    change with nothing supplied only tests that the id exists."""
    snap = conform(snapshot)
    folded = _fold_changes(changes)
    present = [f for f in CHANGE_FIELDS if f"{f}__s" in folded.columns]
    any_supplied = F.lit(False)
    for f in present:
        any_supplied = any_supplied | F.col(f"{f}__s")
    j = snap.join(folded, "id", "left")
    sel = []
    for f in PROFILE_COLUMNS:
        if f in present:
            v = F.col(f"{f}__v")
            if f == "location":
                v = F.when(v == F.lit(""), F.lit(None).cast("string")).otherwise(v)
            if f in ("cpv_codes", "categories"):
                v = _strings_or_empty(v)
            sel.append(F.when(F.coalesce(F.col(f"{f}__s"), F.lit(False)), v).otherwise(F.col(f)).alias(f))
        elif f == "embedding" and "description" in present:
            sel.append(F.when(F.coalesce(F.col("description__s"), F.lit(False)), F.lit(None).cast(S.VECTOR))
                       .otherwise(F.col("embedding")).alias("embedding"))
        else:
            sel.append(F.col(f))
    nxt = j.select(*sel)
    exists = snap.select("id").withColumn("__found", F.lit(True))
    desc_s = F.col("description__s") if "description" in present else F.lit(False)
    status = (folded.join(exists, "id", "left")
                    .select("id", F.coalesce(F.col("__found"), F.lit(False)).alias("updated"),
                            (F.coalesce(F.col("__found"), F.lit(False)) & desc_s).alias("needs_embedding")))
    return nxt, status


def delete_profiles(snapshot: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove profiles (and their vectors) by id (K3/C5); status says whether each id existed."""
    snap = conform(snapshot)
    k = keys.select("id").distinct()
    nxt = snap.join(k, "id", "left_anti")
    status = (k.join(snap.select("id").withColumn("__found", F.lit(True)), "id", "left")
               .select("id", F.coalesce(F.col("__found"), F.lit(False)).alias("deleted")))
    return nxt, status


def profiles_exist(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of ``keys`` that exist.

    An inner equi-join on the (unique) snapshot ids, so the optimizer keeps a
    hash join even when ``keys`` is a union with constant rows."""
    return keys.select("id").distinct().join(snapshot.select("id"), "id", "inner")


def get_profiles(keys: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Full rows with ``has_embedding``, or ``found = false`` (K4)."""
    from tenderlake.operators.joins import reduce_to_keys
    snap = reduce_to_keys(conform(snapshot), keys, "id").withColumn("found", F.lit(True))
    return (keys.select("id").join(snap, "id", "left")
                .withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
                .withColumn("has_embedding", F.col("embedding").isNotNull())
                .drop("embedding"))


def list_profiles(snapshot: DataFrame) -> DataFrame:
    """Summaries without the description, newest first, ties by id."""
    s = conform(snapshot)
    return (s.select("id", "name", "cpv_codes", "categories", "location", "created_at",
                     F.col("embedding").isNotNull().alias("has_embedding"))
             .orderBy(F.col("created_at").desc(), F.col("id").asc()))


def count_profiles(snapshot: DataFrame) -> DataFrame:
    """Profile count beside the list."""
    return snapshot.agg(F.count(F.lit(1)).alias("count"))


def unembedded(snapshot: DataFrame) -> DataFrame:
    """The embedding backlog: profiles without a vector (K6)."""
    return conform(snapshot).filter(F.col("embedding").isNull())


def apply_vectors(snapshot: DataFrame, vectors: DataFrame) -> DataFrame:
    """Set vectors from ``vectors[id, embedding]``; other rows unchanged (K6).

    Of several vectors for one id the largest (as an array) counts."""
    v = vectors.groupBy("id").agg(F.max(F.col("embedding").cast(S.VECTOR)).alias("__new"))
    return (conform(snapshot).join(v, "id", "left")
            .withColumn("embedding", F.coalesce(F.col("__new"), F.col("embedding")))
            .drop("__new").select(*PROFILE_COLUMNS))


def _decode_batch(column: pa.Array) -> pa.Array:
    """Binary column of equal or different widths -> list<float>, one reinterpretation of the whole buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if (size % 4).any():
        raise ValueError("a vector BLOB is not a whole number of 4-byte floats")
    raw = b"".join(pc.drop_null(column).to_pylist())
    at = np.append(0, np.cumsum(size // 4)).astype(np.int32)
    null = None if not column.null_count else column.is_null()
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(raw, "<f4")), mask=null)


def _encode_blobs(vecs: pd.Series) -> pd.Series:
    return vecs.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def vectors_from_blobs(df: DataFrame, blob_col: str = "embedding_blob", out_col: str = "embedding") -> DataFrame:
    """Bulk import of raw little-endian f32 BLOBs into ``array<float>`` (A4), whole Arrow buffers at once."""
    fields = [f for f in df.schema.fields if f.name != out_col] + [T.StructField(out_col, S.VECTOR)]

    def run(batches):
        for b in batches:
            keep = [n for n in b.schema.names if n != out_col]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], _decode_batch(b.column(blob_col))], names=[*keep, out_col])

    return df.mapInArrow(run, T.StructType(fields))


def vectors_to_blobs(df: DataFrame, vec_col: str = "embedding", out_col: str = "embedding_blob") -> DataFrame:
    """Inverse of ``vectors_from_blobs`` (export, tests)."""
    encode = F.pandas_udf(_encode_blobs, T.BinaryType())
    return df.withColumn(out_col, encode(F.col(vec_col)))
