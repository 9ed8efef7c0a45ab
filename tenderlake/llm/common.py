"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.session import checkpoint_dir
from tenderlake.sources.tables import read_table

# The characters that separate words everywhere in this sub-package: blank and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    It cuts the lineage: a lost executor re-reads files that every machine sees, and what is read
    twice is computed once.  Each call writes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                over: int = 2000, counted: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Join on ``keys`` (nulls equal nulls); a key with more than ``over`` rows in ``big`` is split by its count.

    Such a key meets one task for every ``over`` rows, and only its rows of ``small`` are repeated, so at most one row
    for each ``over`` rows of ``big`` comes on top.  ``spread`` tells the rows of one key in ``big`` apart;
    ``counted`` is a cheaper table with the same keys, to count them in (``weight``: its column of row numbers).
    """
    many = F.count("*") if weight is None else F.sum(weight)
    hot = ((big if counted is None else counted).groupBy(*keys).agg(many.alias("_n")).filter(F.col("_n") > over)
           .select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("_n") / over).cast("int").alias("_salts")))
    hot = stage_table(hot, "hot-keys")
    right = small
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")

    def same(a: str, b: str) -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
        return on

    gone = ["_salt", "_rsalt", *[f"_r_{k}" for k in keys]]
    if hot.isEmpty():
        return big.join(right, same("", "_r_"), how).drop(*gone)
    away = ["_salts", *[f"_h_{k}" for k in keys]]
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    left = big.join(hot, same("", "_h_"), "left").withColumn("_salt", salt).drop(*away)
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))
    right = right.join(hot, same("_r_", "_h_"), "left").withColumn("_rsalt", F.explode(every)).drop(*away)
    return left.join(right, (F.col("_salt") == F.col("_rsalt")) & same("", "_r_"), how).drop(*gone)


def spread_join(big: DataFrame, small: DataFrame, key: str, spread: Column, over: int = 1000,
                counted: DataFrame | None = None) -> DataFrame:
    """``salted_join`` on one key, for wide rows in ``small``."""
    return salted_join(big, small, [key], spread, over=over, counted=counted)


BITMAP_WORD = 32768                                           # bits in one row of a stored bitmap


def bitmap_bits(n: int, per_key: int = 16, most: int = 31) -> int:
    """log2 of the bits of a bitmap for ``n`` keys: about ``per_key`` bits a key, 2**16 to 2**``most`` (256 MB)."""
    return min(max(16, (max(n, 1) * per_key - 1).bit_length()), most)


def bitmap_rows(hashes: DataFrame, col: str, bits: int) -> DataFrame:
    """``_part, _bits``: the leading ``bits`` bits of 64-bit hashes as a bitmap, 4 KB a row (built-ins only)."""
    slot = F.shiftrightunsigned(col, 64 - bits)
    return (hashes.select(F.shiftright(slot, 15).cast("int").alias("_part"), slot.bitwiseAND(F.lit(BITMAP_WORD - 1)).alias("_at"))
            .groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits")))


def bitmap_hit(rows: DataFrame, h: Column, bitmap: DataFrame, bits: int, hit: str) -> DataFrame:
    """Add ``hit``: is the bit of ``h`` set?  The bitmap (of bounded size) is broadcast; built-ins only."""
    slot = F.shiftrightunsigned(h, 64 - bits)
    marked = rows.join(F.broadcast(bitmap), F.shiftright(slot, 15).cast("int") == F.col("_part"), "left")
    at = slot.bitwiseAND(F.lit(BITMAP_WORD - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return marked.withColumn(hit, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("_part", "_bits")


def hash_bitmap(hashes: DataFrame, col: str, bits: int):
    """The same bitmap as bytes (numpy), for tasks in Python."""
    import numpy as np
    out = np.zeros(((1 << bits) // 8 // 4096, 4096), np.uint8)
    for r in bitmap_rows(hashes, col, bits).collect():        # at most 2**(bits - 15) rows of 4 KB
        out[r["_part"]] = np.frombuffer(r["_bits"], np.uint8)
    return out.ravel()


def bitmap_holds(bitmap, h, bits: int):
    """Which of the hashes (uint64) have their bit set in ``hash_bitmap``'s bytes."""
    import numpy as np
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def worker_store() -> dict:
    """A dict that lives as long as the Python worker process, across tasks.

    Functions reach workers by value, so module globals are new in each task; a module object put
    in ``sys.modules`` is not.
    """
    mod = sys.modules.get("_tenderlake_worker_store")
    if mod is None:
        mod = sys.modules["_tenderlake_worker_store"] = types.ModuleType("_tenderlake_worker_store")
        mod.store = {}
    return mod.store


def once(key, make):
    """``make()``, kept for the life of the Python worker under ``key``."""
    store = worker_store()
    if key not in store:
        store[key] = make()
    return store[key]


def enter(operator: str) -> None:
    """Called first in a task: what another operator kept in this worker is dropped, so kept tables don't add up."""
    store = worker_store()
    if store.get("operator") != operator:
        store.clear()
        store["operator"] = operator
        tidy()


def tidy() -> None:
    """Give memory that Arrow and the allocator hold without use back to the system."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:                                    # not glibc
        pass
