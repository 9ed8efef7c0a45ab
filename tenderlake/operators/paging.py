"""Deep pages by rank location.

``list_releases`` keeps offset + limit rows in one task.  Here counts find the page first: releases are counted by month, then, in the
months that the page touches, by date; only the rows of the dates that the page touches go on, with the offset that is left.
If these are many (a third of all releases on one date), they are range-partitioned by (date, ocid) and written; the counts of
the ranges locate the page again, and only its ranges are sorted.  So no task holds more than one range
of one date, at any offset, and what reaches the driver is one row a month, one a date of a month, and one a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.listing import MAX_LIMIT, filtered_releases, page_bounds, summaries
from tenderlake.session import write_once

RANGE_ROWS = 100_000             # rows that one task may sort


def _touched(counts: list[tuple], offset: int, limit: int) -> tuple[list, int]:
    """Of ordered (bin, rows): the bins that rows ``offset`` to ``offset + limit`` lie in, and the offset within them."""
    bins, before, start = [], 0, offset
    for name, n in counts:
        if before + n > offset and before < offset + limit:
            if not bins:
                start = offset - before
            bins.append(name)
        before += n
    return bins, start


def _counted(rows: DataFrame, bin_: Column) -> list[tuple]:
    """Rows of every bin, newest first."""
    return [(r["_bin"], r["_n"]) for r in rows.groupBy(bin_.alias("_bin")).agg(F.count("*").alias("_n")).orderBy(F.col("_bin").desc()).collect()]


def locate(rows: DataFrame, offset: int, limit: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """The rows of the bins that a page touches, and the page's offset among them (order: ``date desc, ocid``)."""
    date = F.coalesce(F.col("date"), F.lit(""))                 # no date sorts last
    left = offset
    for bin_ in (F.substring(date, 1, 7), date):
        counts = _counted(rows, bin_)
        bins, left = _touched(counts, left, limit)
        rows = rows.filter(bin_.isin(bins) if bins else F.lit(False))
        n = sum(c for b, c in counts if b in set(bins))
    if n <= range_rows:
        return rows, left
    order = [F.col("date").desc(), F.col("ocid").asc()]
    ranged = rows.repartitionByRange(-(-n // range_rows), *order).withColumn("_range", F.spark_partition_id())
    ranged = write_once(ranged, "page-ranges")
    counts = [(r["_range"], r["_n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("_n")).orderBy("_range").collect()]
    bins, left = _touched(counts, left, limit)
    return ranged.filter(F.col("_range").isin(bins) if bins else F.lit(False)).drop("_range"), left


def list_releases_located(meta: DataFrame, filters: FilterSpec = FilterSpec(), limit: int | None = None, offset: int | None = None,
                          max_limit: int = MAX_LIMIT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``list_releases`` for any offset at about the cost of one count."""
    lim, off = page_bounds(limit, offset, max_limit)
    rows, left = locate(filtered_releases(meta, filters), off, lim, range_rows)
    page = rows.orderBy(F.col("date").desc(), F.col("ocid").asc())
    return summaries((page.offset(left) if left else page).limit(lim))
