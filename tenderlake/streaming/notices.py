"""Structured Streaming jobs over notice events.

S1  ``merge_notices_stream``: stateful ``groupBy(ocid)`` with the same
    aggregates as the batch merge; ``update`` mode emits the full current
    row of every touched OCID, which ``upsert_snapshot`` writes into a
    versioned parquet snapshot from ``foreachBatch`` (idempotent per epoch).
    State holds one small row per OCID and is kept for good: a process can
    receive a correction at any time, so no watermark bounds the key.
S3  ``daily_phase_counts_stream``: event-time tumbling windows with a
    watermark; late notices beyond the bound are dropped, results appended
    once a day is final.
S4  ``dedup_notices_stream``: duplicate deliveries of one ``notice_id``
    suppressed within the watermark.
S3 after S4 in one query: ``deduped_daily_counts_stream``; the notices that arrived are counted by
    ``observe``, those beyond the watermark by ``late_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators.notices import merge_aggregates


def read_notice_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet notice files arriving in a folder, with the explicit notice schema."""
    r = spark.readStream.schema(S.NOTICE)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def merge_notices_stream(notices: DataFrame) -> DataFrame:
    return notices.groupBy("ocid").agg(*merge_aggregates(notices.schema))


def upsert_snapshot(target: str, generation: int = 0):
    """``foreachBatch`` function: replace the rows of the touched OCIDs.

    Each epoch writes ``target/generation=<g>-epoch=<id>``; a re-run of an epoch after a failure
    overwrites the same folder, so the sink is idempotent.  Epochs count from 0 again with a new
    streaming checkpoint: give that run the next ``generation``.  Rows carry both numbers, and readers
    take, per OCID, the row of the highest (generation, epoch)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("generation", F.lit(int(generation)).cast("long")).withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
              .write.mode("overwrite").parquet(f"{target.rstrip('/')}/generation-{int(generation)}-epoch-{int(epoch_id)}"))
    return write


def _newest(spark: SparkSession, folders: tuple[str, ...]) -> DataFrame:
    """Per OCID the row of the highest (generation, epoch), with partial aggregation before the shuffle."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(*folders)
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct("generation", "epoch"))
    return df.groupBy("ocid").agg(row.alias("r")).select("r.*")


def read_snapshot(spark: SparkSession, *folders: str) -> DataFrame:
    """Current merged state from an upsert target, compacted copies, or both together."""
    return _newest(spark, folders).drop("generation", "epoch")


def compact_snapshot(spark: SparkSession, target: str, out: str) -> str:
    """Periodic job: write the current merged state once (one row per OCID) to ``out``.

    Generation and epoch stay, so ``read_snapshot(spark, out, target)`` is right beside epochs that
    arrive later; epochs up to the compaction may then be removed from ``target``."""
    _newest(spark, (target,)).write.mode("errorifexists").parquet(out)
    return out


def daily_phase_counts_stream(notices: DataFrame, lateness: str = "1 day") -> DataFrame:
    return (notices.filter(F.col("phase").isNotNull())
                   .withWatermark("ts", lateness)
                   .groupBy(F.window("ts", "1 day").alias("w"), "phase")
                   .agg(F.count(F.lit(1)).alias("n"))
                   .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "phase", "n"))


def dedup_notices_stream(notices: DataFrame, lateness: str = "1 day") -> DataFrame:
    return notices.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["notice_id"])


def deduped_daily_counts_stream(notices: DataFrame, lateness: str = "1 day", observed: str = "arrived") -> DataFrame:
    """Daily counts in which repeated deliveries count once: two stateful steps chained in one query (append mode).

    Every notice that arrives is counted in the observation ``observed`` (``n``).  The counts hold each notice that was neither
    a repetition nor beyond the watermark."""
    seen = notices.observe(observed, F.count(F.lit(1)).alias("n"))
    known = seen.filter(F.col("phase").isNotNull()).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["notice_id"])
    return (known.groupBy(F.window("ts", "1 day").alias("w"), "phase").agg(F.count(F.lit(1)).alias("n"))
                 .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "phase", "n"))


def late_rows(progress: list) -> int:
    """Notices that the first stateful step of a query dropped as late, over its progress reports."""
    import json
    total = 0
    for p in progress:
        states = json.loads(p.json)["stateOperators"] if hasattr(p, "json") else p["stateOperators"]
        total += sum(s.get("numRowsDroppedByWatermark", 0) for s in states if s["operatorName"] == "dedupeWithinWatermark")
    return total


def observed_rows(progress: list, observed: str = "arrived") -> int:
    """Notices that arrived, over a query's progress reports."""
    import json
    reports = [json.loads(p.json) if hasattr(p, "json") else p for p in progress]
    return sum(int(r.get("observedMetrics", {}).get(observed, {}).get("n") or 0) for r in reports)
