"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Built-in functions only.  Each step looks only at the groups that survived the step before:

1. byte lengths that occur more than once;
2. of those rows, (length, hash of the first characters) that occur more than once;
3. of those rows, SHA-256 of the whole normalised text; equal (length, hash) is a group of copies.

Survivor sets are handed to the next scan as bitmaps of hashes, sized by their count (about 16 bits a
key, 256 MB at most): they are broadcast, and texts are hashed where they lie, never shuffled, by ``exact_dedup``.
A bit shared by chance lets a row into the next step, which compares exactly; nothing is lost.
Groups are pre-aggregated before their shuffle, and on the way back to the rows a group is split by
its count, so one that holds a third of all rows is spread over many tasks.  ``drop_copies`` moves only the
texts of rows whose id is among the dropped or repeated ones (by such a bitmap); all others stay where they lie.

Cases: a null text is the empty text; empty texts are copies of each other.  A null id sorts below
every number.  ``group_size`` counts rows; rows that repeat an id with an equal text are kept or
dropped together by ``exact_dedup`` (``drop_copies`` then leaves one of them).  Columns besides
id and text are ignored, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import ascii_lower, bitmap_bits, bitmap_hit, bitmap_rows, salted_join, stage_table

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """Lower case for A-Z only; null is empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _in_repeated(rows: DataFrame, keys: DataFrame, hit: str) -> DataFrame:
    """Add ``hit`` to ``rows``: may the value of the columns of ``keys`` be one that several rows of ``keys`` hold?"""
    many = (keys.groupBy(*keys.columns).agg(F.count("*").alias("_n")).filter("_n > 1")
            .select(F.xxhash64(*[F.col(k) for k in keys.columns]).alias("_h")))
    many = stage_table(many, "exact-repeated")
    bits = bitmap_bits(many.count())
    bitmap = stage_table(bitmap_rows(many, "_h", bits), "exact-bitmap")
    return bitmap_hit(rows, F.xxhash64(*[F.col(k) for k in keys.columns]), bitmap, bits, hit)


def _verdicts(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest: bool = False) -> DataFrame:
    """``_id, _full, keep_id, group_size`` a row; ``_full`` is null where the text proved unique early.

    ``digest``: also ``_sha``, the SHA-256 of every normalised text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    sha = F.sha2(ascii_lower(F.col("_t")), 256)
    with_len = rows.withColumn("_len", F.octet_length("_t"))
    prefix = F.xxhash64(ascii_lower(F.left(F.col("_t"), F.lit(prefix_chars)))).alias("_p")
    marked = _in_repeated(with_len, with_len.select("_len"), "_again")
    second = marked.filter("_again").select("_len", prefix)
    marked = _in_repeated(marked.select("*", prefix), second, "_twice").withColumn("_twice", F.col("_again") & F.col("_twice"))
    if digest:
        marked = marked.withColumn("_sha", sha)
    full = F.when(F.col("_twice"), F.col("_sha") if digest else sha).alias("_full")
    extra = ["_sha"] if digest else []
    tagged = stage_table(marked.select("_id", "_len", full, *extra), "exact-dedup")
    alone = tagged.filter(F.col("_full").isNull())
    rest = tagged.filter(F.col("_full").isNotNull())
    groups = rest.groupBy("_len", "_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = salted_join(rest, groups, ["_len", "_full"], F.col("_id")).select("_id", "_full", "keep_id", "group_size", *extra)
    return joined.unionByName(alone.select("_id", "_full", F.col("_id").alias("keep_id"),
                                           F.lit(1).cast("bigint").alias("group_size"), *extra))


def _kept() -> Column:
    return F.col("_id").eqNullSafe(F.col("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                digest: bool = False) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept``; the largest id of a group stays.

    ``digest``: also ``text_sha256``, the lowercase hex SHA-256 of the normalised text.
    """
    v = _verdicts(docs, id_col, text_col, prefix_chars, digest)
    more = [F.col("_sha").alias("text_sha256")] if digest else []
    return v.select(F.col("_id").alias(id_col), "keep_id", "group_size", _kept().alias("kept"), *more)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts left (all columns unchanged)."""
    v = stage_table(_verdicts(docs, id_col, text_col, prefix_chars), "exact-dedup-verdicts")
    odd = (v.groupBy("_id").agg(F.count("*").alias("_rows"), F.min(_kept()).alias("_all"))
           .filter("_rows > 1 OR NOT _all").withColumnRenamed("_id", "_gid"))
    odd = stage_table(odd.withColumn("_h", F.xxhash64("_gid")), "exact-dedup-odd")
    bits = bitmap_bits(odd.count())
    bitmap = stage_table(bitmap_rows(odd, "_h", bits), "exact-bitmap")
    # the whole row travels as one struct, so its column names meet no others
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"))
    own_id, own_text = F.col(f"_doc.{id_col}"), F.col(f"_doc.{text_col}")
    whole = bitmap_hit(whole, F.xxhash64(own_id), bitmap, bits, "_odd")
    marked = whole.filter("_odd").join(odd.select("_gid", "_rows"), own_id.eqNullSafe(F.col("_gid")), "left")
    plain = whole.filter("NOT _odd").select("_doc.*").unionByName(marked.filter("_rows IS NULL").select("_doc.*"))
    # Rows of an id that repeats are told apart by their text; of equal ones the first by content stays.
    known = v.filter("_full IS NOT NULL").select(F.col("_id").alias("_vid"), "_full", "keep_id").distinct()
    first = Window.partitionBy("_h", "_gid").orderBy(F.xxhash64("_doc"))
    again = (marked.filter("_rows > 1").withColumn("_h", F.sha2(normalised(own_text), 256))
             .join(known, (F.col("_h") == F.col("_full")) & own_id.eqNullSafe(F.col("_vid")), "left")
             .filter(F.col("_full").isNull() | own_id.eqNullSafe(F.col("keep_id")))
             .withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select("_doc.*"))
    return plain.unionByName(again)
