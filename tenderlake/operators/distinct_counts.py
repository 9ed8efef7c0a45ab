"""Exact distinct counts that merge, by bitmaps of dense numbers.

``dense_numbers`` numbers distinct keys 0, 1, 2, ... without one global window: keys are range-partitioned, counted by
range, and numbered within a range from the range's offset.  A set of keys is then a few bitmaps of 32 768 bits, one for each bucket
of numbers.  Bitmaps of one group are built in the map-side aggregate and merge by OR, so a roll-up reads the items
once: the finest level gives bitmaps, and each coarser level ORs those of the level below.  No row is repeated for the levels and
no distinct (group, key) pair is shuffled after the first aggregate.

Groups that hold few keys of each bucket (a code with thirty of a million releases) take ``words=True``: only the 64-bit words with a
bit are rows, so a key costs at most one word, not a bitmap of 4 KB; words merge by OR and count like bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.operators.market import _with_lot_amounts
from tenderlake.session import write_once


def dense_numbers(keys: DataFrame, key: str) -> DataFrame:
    """``key, number``: the distinct non-null keys with numbers from 0 in key order, without gaps."""
    ranged = keys.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    ranged = write_once(ranged, "dense-keys")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))                             # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (ranged.withColumn("_i", inner).join(sizes.select("_range", before.alias("_before")), "_range")
            .select(key, (F.col("_before") + F.col("_i")).alias("number")))


WORD = 64


def bitmaps(rows: DataFrame, groups: list[str], number: str = "number", sums: dict[str, Column] | None = None, words: bool = False) -> DataFrame:
    """``groups, _bucket, _bits`` and further sums: the distinct numbers of each group as bitmaps, or as their 64-bit words.

    Bit positions count from bucket to bucket as ``bitmap_bucket_number`` does."""
    n = F.col(number) + 1                                       # the built-ins count from 1
    extra = [c.alias(name) for name, c in (sums or {}).items()]
    if words:
        bit = F.expr(f"shiftleft(1L, cast(pmod(`{number}`, {WORD}) as int))")
        return rows.groupBy(*groups, F.expr(f"`{number}` div {WORD}").alias("_bucket")).agg(F.bit_or(bit).alias("_bits"), *extra)
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(n)).withColumn("_bit", F.bitmap_bit_position(n))
    return marked.groupBy(*groups, "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"), *extra)


def _in_words(level: DataFrame) -> bool:
    return isinstance(level.schema["_bits"].dataType, T.LongType)


def merge_bitmaps(level: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """The same for coarser groups."""
    merged = F.bit_or("_bits") if _in_words(level) else F.bitmap_or_agg("_bits")
    return level.groupBy(*groups, "_bucket").agg(merged.alias("_bits"), *[F.sum(s).alias(s) for s in sums])


def count_bitmaps(level: DataFrame, groups: list[str], count: str, sums: list[str]) -> DataFrame:
    """``groups, count`` (distinct numbers) and the sums."""
    held = F.bit_count("_bits").cast("long") if _in_words(level) else F.bitmap_count("_bits")
    return level.groupBy(*groups).agg(F.sum(held).alias(count), *[F.sum(s).alias(s) for s in sums])


def cpv_rollup_bitmaps(releases: DataFrame) -> DataFrame:
    """``market.cpv_rollup`` by bitmaps: items, releases and lot value per CPV division, group, class and code.

    A release is numbered before its items are exploded, so the numbers are joined a row a release.  Coarser codes are prefixes of
    the finest, which alone travels with the items; a code has few of the releases, so the bitmaps are words."""
    prices = _with_lot_amounts(releases, "tender.items")
    item = lambda i: F.struct(F.substring(i["classification"]["id"], 1, 8).alias("code"),
                              F.element_at("lot_amount", i["relatedLot"]).alias("amount"))
    held = F.filter(F.transform("items", item), lambda i: i["code"].isNotNull())
    items = write_once(prices.select("ocid", held.alias("items")).filter(F.size("items") > 0), "cpv-items")
    numbered = items.join(dense_numbers(items, "ocid"), "ocid").select("number", F.explode("items").alias("_i")).select("number", "_i.code", "_i.amount")
    digits, sums = [2, 4, 5, 8], ["n_items", "value"]
    level = write_once(bitmaps(numbered, ["code"], sums={"n_items": F.count(F.lit(1)), "value": F.sum("amount")}, words=True), "cpv-bitmaps")
    out, upper = None, level.repartition("_bucket")             # the levels above merge within the buckets, without another exchange
    for depth in range(len(digits), -1, -1):
        if depth < len(digits):
            code = F.substring("code", 1, digits[depth - 1]) if depth else F.lit("")
            level = upper = merge_bitmaps(upper.withColumn("code", code), ["code"], sums)
        part = count_bitmaps(level, ["code"] if depth else [], "n_releases", sums)
        row = part.select(F.lit((1 << (len(digits) - depth)) - 1).cast("long").alias("gid"),
                          *[(F.substring("code", 1, n) if i < depth else F.lit(None).cast("string")).alias(f"d{n}") for i, n in enumerate(digits)],
                          "n_items", "n_releases", "value")
        out = row if out is None else out.unionByName(row)
    # without items the grand total counts nothing, like a roll-up of no rows
    return out.withColumn("n_items", F.coalesce("n_items", F.lit(0))).withColumn("n_releases", F.coalesce("n_releases", F.lit(0)))
