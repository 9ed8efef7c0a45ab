"""Tables laid out by hash of their key, so that joins on it move only the other side.

``write_copartitioned`` writes a table bucketed and sorted by ``ocid``.  Releases, metadata and chunks written with the same number
of buckets join each other without an exchange, and a lookup or enrichment hashes only its small side (keys,
hits) into those buckets: the large table is neither shuffled nor sorted again.  One task reads one bucket, so the number of
buckets has to grow with the tables: ``buckets_for`` gives one for the files that they are derived from.  A hot process is one bucket's rows;
its share is that of its rows, as in any join by key.  The shuffles behind a table take several times its size on disk;
``passes_for`` gives the passes that share them out.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import notice_url
from tenderlake.operators.matching import enrich
from tenderlake.session import scratch_path, shuffles_removed

BUCKETS = 64
BUCKET_INPUT = 4 * 1024 * 1024      # bytes of input files behind a bucket; rows of nested releases take several times as much
PASSES = 8
PASS_INPUT = 64 * 1024 * 1024       # bytes of input files behind a pass, until there are PASSES of them


def _input_bytes(*frames: DataFrame) -> int:
    """Size of the files that the frames read; their contents are not read."""
    files = sorted({unquote(f) for df in frames for f in df.inputFiles()})
    if not files:
        return 0
    return frames[0].sparkSession.read.format("binaryFile").load(files).select("length").agg(F.sum("length")).first()[0] or 0


def buckets_for(*frames: DataFrame, least: int = BUCKETS, bucket_input: int = BUCKET_INPUT) -> int:
    """Buckets for tables that are to join each other: ``least``, or more by the size of the files that they read."""
    return max(least, math.ceil(_input_bytes(*frames) / bucket_input))


def passes_for(*frames: DataFrame, most: int = PASSES, pass_input: int = PASS_INPUT) -> int:
    """Passes to write tables in: one for little input, up to ``most``, so that the input is not read ever more often as it grows."""
    return min(most, max(1, math.ceil(_input_bytes(*frames) / pass_input)))


def _share(df: DataFrame, key: str, buckets: int, passes: int, i: int) -> DataFrame:
    """The rows of every ``passes``-th bucket, from bucket ``i`` on."""
    return df if passes == 1 else df.filter(F.pmod(F.pmod(F.hash(key), F.lit(buckets)), F.lit(passes)) == F.lit(i))


def write_copartitioned(df: DataFrame, table: str, key: str = "ocid", buckets: int = BUCKETS, path: str | None = None, passes: int = 1) -> DataFrame:
    """Write ``df`` as the table ``table``, in ``buckets`` buckets by ``key``, and read it back.

    Rows are dealt to the buckets first, so each bucket is one file.  Of several ``passes`` each writes its share of the buckets (null
    keys have a bucket, too) and its shuffle files go before the next begins: the disk holds the table and one pass's shuffles.  The share
    is a condition on ``key``, so the planner takes it down to the inputs of joins and groups by that key.  Every pass reads the inputs
    again, so a row's key must come out the same each time."""
    spark = df.sparkSession
    where = path or scratch_path(spark, table)
    for i in range(passes):
        with shuffles_removed(spark):
            (_share(df, key, buckets, passes, i).repartition(buckets, key).write.mode("append" if i else "errorifexists").option("compression", "zstd")
             .bucketBy(buckets, key).sortBy(key).option("path", where).saveAsTable(table))
    return spark.table(table)


def lookup(keys: DataFrame, table: DataFrame, key: str = "ocid", buckets: int | None = None) -> DataFrame:
    """Every key with its row of the table and ``found``; the planner hashes the keys into the table's buckets.

    The hint names a sort-merge join, which keeps the table's buckets; small key sets are broadcast by ``get_releases``.  Keys that are
    already dealt to more partitions than the table has buckets would have the table exchanged: with ``buckets``, they are dealt anew."""
    rows = table.withColumn("found", F.lit(True)).hint("merge")
    wanted = keys.select(key) if buckets is None else keys.select(key).repartition(buckets, key)
    return wanted.join(rows, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def enrich_copartitioned(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """``matching.enrich`` with a co-partitioned metadata table, plus the notice's URL."""
    return enrich(hits, meta.hint("merge")).withColumn("url", notice_url(F.col("notice_id")))
