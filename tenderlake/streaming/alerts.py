"""Tender alerts: newly arriving chunks matched against the profile table.

``start_alerts`` gives every profile its best new tenders of each micro-batch.  ``start_running_alerts`` also remembers:
it keeps each profile's list of the ``k`` best distinct processes seen so far, and a hit is an alert when it
enters that list.  Lists merge (``merge_lists``), so after any split of the chunks into micro-batches they equal the
lists of one batch.

Each micro-batch is written once and read from there, profiles are written once a stream, and an epoch's scratch tables take
the place of those of the epoch before the last, so nothing piles up.  Alerts are written by epoch; a re-run of an epoch
overwrites its own folder, and it starts from the lists that the epoch before left in the other of two places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.matching import match_tenders
from tenderlake.session import scratch_scope, write_once

LIST_COLUMNS = ("profile_id", "rank", "doc_id", "ocid", "score")


def alert_batch(profiles: DataFrame, meta: DataFrame, filters: FilterSpec = FilterSpec(), k: int = 10):
    """``foreachBatch`` body factory: (new chunks, epoch) -> alerts DataFrame."""
    requests = profiles.select(F.col("id").alias("profile_id"))

    def run(new_chunks: DataFrame, epoch_id: int) -> DataFrame:
        m = match_tenders(requests, profiles, write_once(new_chunks, "new-chunks"), meta, filters, k=k, mode="exact")
        return m.withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
    return run


def start_alerts(chunk_stream: DataFrame, profiles: DataFrame, meta: DataFrame, target: str,
                 checkpoint: str, filters: FilterSpec = FilterSpec(), k: int = 10, trigger_once: bool = False):
    run = alert_batch(write_once(profiles, "alert-profiles"), meta, filters, k)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        with scratch_scope(f"{checkpoint.rstrip('/')}-scratch/{int(epoch_id) % 2}"):
            (run(batch, epoch_id).write.mode("overwrite")
                .parquet(f"{target.rstrip('/')}/epoch={int(epoch_id)}"))

    w = chunk_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def merge_lists(lists: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """Two sets of ranked lists (``LIST_COLUMNS``) as one: the ``k`` best distinct processes of each profile.

    Of several hits of one process the best counts (score, then the smallest chunk id); at most 2 k rows a profile meet."""
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    both = lists.select(*LIST_COLUMNS).unionByName(more.select(*LIST_COLUMNS))
    best = both.withColumn("_n", F.row_number().over(Window.partitionBy("profile_id", "ocid").orderBy(*order))).filter("_n = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= k).select(*LIST_COLUMNS)


def running_step(lists: DataFrame | None, new_chunks: DataFrame, profiles: DataFrame, meta: DataFrame, filters: FilterSpec = FilterSpec(),
                 k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(next lists, alerts) after some new chunks: an alert is a row of the next lists whose process was not in the lists before."""
    requests = profiles.select(F.col("id").alias("profile_id"))
    hits = match_tenders(requests, profiles, write_once(new_chunks, "new-chunks"), meta, filters, k=k, mode="exact").select(*LIST_COLUMNS)
    if lists is None:
        nxt = write_once(hits, "lists")
        return nxt, nxt
    nxt = write_once(merge_lists(lists, hits, k), "lists")
    return nxt, nxt.join(lists.select("profile_id", "ocid"), ["profile_id", "ocid"], "left_anti").select(*LIST_COLUMNS)


def _slot(target: str, epoch_id: int) -> str:
    return f"{target.rstrip('/')}/lists/{'even' if epoch_id % 2 == 0 else 'odd'}"


def read_lists(spark: SparkSession, target: str, epoch_id: int) -> DataFrame:
    """The lists that epoch ``epoch_id`` left."""
    return spark.read.parquet(_slot(target, epoch_id)).select(*LIST_COLUMNS)


def start_running_alerts(chunk_stream: DataFrame, profiles: DataFrame, meta: DataFrame, target: str, checkpoint: str,
                         filters: FilterSpec = FilterSpec(), k: int = 10, trigger_once: bool = False):
    """Stream of chunks -> ``target/alerts/epoch=<n>`` (new entries of the lists) and ``target/lists`` (the lists themselves)."""
    spark = chunk_stream.sparkSession
    known = write_once(profiles, "alert-profiles")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        with scratch_scope(f"{checkpoint.rstrip('/')}-scratch/{int(epoch_id) % 2}"):
            before = read_lists(spark, target, epoch_id - 1) if epoch_id else None
            nxt, alerts = running_step(before, batch, known, meta, filters, k)
            nxt.write.mode("overwrite").parquet(_slot(target, epoch_id))
            alerts.write.mode("overwrite").parquet(f"{target.rstrip('/')}/alerts/epoch={int(epoch_id)}")

    w = chunk_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
