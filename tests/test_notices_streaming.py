"""Notice merge edge cases and Structured Streaming jobs (stream = batch under shuffled arrival)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators.notices import daily_phase_counts, merge_notices
from tenderlake.streaming.notices import (daily_phase_counts_stream, dedup_notices_stream, merge_notices_stream,
                                          compact_snapshot, read_notice_stream, read_snapshot, upsert_snapshot)

T0 = dt.datetime(2024, 1, 1)


def _n(i, ocid, minutes, phase, status=None, desc=None, value=None):
    return (i, ocid, T0 + dt.timedelta(minutes=minutes), phase, status, desc, value)


EDGE = [
    _n(1, "a", 10, "tender", "active", "first"),
    _n(2, "a", 30, "award", "complete", "", 5.0),      # empty description must not overwrite
    _n(3, "a", 20, None, None, None),                  # correction without phase
    _n(4, "b", 5, "planning", "planning", None),
    _n(5, "b", 5, "tender", "active", "tie wins by id"),  # equal ts: higher notice_id is later
]


def test_merge_edge_cases(spark):
    df = spark.createDataFrame(EDGE, S.NOTICE)
    rows = {r.ocid: r for r in merge_notices(df.repartition(3)).collect()}
    a, b = rows["a"], rows["b"]
    assert a.tag == ["award", "tender"] and a.status == "complete" and a.description == "first"
    assert a.award_value == 5.0 and a.n_notices == 3
    assert b.status == "active" and b.description == "tie wins by id"


def _write_batches(spark, rows, base, n_files):
    random.Random(3).shuffle(rows)
    chunk = (len(rows) + n_files - 1) // n_files
    for i in range(n_files):
        spark.createDataFrame(rows[i * chunk:(i + 1) * chunk], S.NOTICE).coalesce(1).write.mode("append").parquet(base)


def test_stream_merge_equals_batch(spark, tmp_path):
    from tenderlake.sources import procurement as P
    notices = P.notices(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in notices.collect()]
    src = str(tmp_path / "in")
    _write_batches(spark, rows, src, 3)
    stream = merge_notices_stream(read_notice_stream(spark, src, max_files_per_trigger=1))
    target = str(tmp_path / "snap")
    q = (stream.writeStream.outputMode("update").foreachBatch(upsert_snapshot(target))
               .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    got = read_snapshot(spark, target)
    want = merge_notices(notices)
    cols = ["ocid", "tag", "status", "description", "award_value", "n_notices", "first_ts", "last_ts"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_daily_counts_drop_late(spark, tmp_path):
    on_time = [_n(i, "x", i * 60, "tender") for i in range(1, 30)] + [_n(100, "y", 60 * 24 * 3, "award")]
    late = [_n(200, "z", 5, "tender")]               # day 1, after the watermark passed day 3
    src = str(tmp_path / "in")
    spark.createDataFrame(on_time, S.NOTICE).coalesce(1).write.parquet(src)
    q = (daily_phase_counts_stream(read_notice_stream(spark, src, 1)).writeStream.outputMode("append")
         .format("memory").queryName("daily_counts_t").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame(late, S.NOTICE).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {(r.day, r.phase): r.n for r in spark.sql("SELECT * FROM daily_counts_t").collect()}
    assert got[("2024-01-01", "tender")] == 23           # the late notice is not counted
    assert got[("2024-01-02", "tender")] == 6
    batch = {(r.day, r.phase): r.n for r in daily_phase_counts(spark.createDataFrame(on_time + late, S.NOTICE)).collect()}
    assert batch[("2024-01-01", "tender")] == 24


def test_stream_dedup(spark, tmp_path):
    rows = [_n(1, "a", 1, "tender"), _n(1, "a", 1, "tender"), _n(2, "a", 2, "award")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, S.NOTICE).coalesce(1).write.parquet(src)
    q = (dedup_notices_stream(read_notice_stream(spark, src)).writeStream.format("memory")
         .queryName("dedup_t").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    assert sorted(r.notice_id for r in spark.sql("SELECT notice_id FROM dedup_t").collect()) == [1, 2]


def test_alert_stream_matches_batch(spark, tmp_path):
    """New chunks arriving as a stream are matched against the profiles per micro-batch."""
    from tenderlake.sources.stored import Views
    from tenderlake.operators.matching import match_tenders
    from tenderlake.streaming.alerts import start_alerts
    v = Views(spark, "/root/testdata/sf0.001")
    chunks = v.chunks
    src = str(tmp_path / "chunks")
    chunks.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(chunks.schema).parquet(src)
    target = str(tmp_path / "alerts")
    q = start_alerts(stream, v.profiles, v.meta, target, str(tmp_path / "ck"), k=5, trigger_once=True)
    q.awaitTermination(240)
    got = spark.read.parquet(target).select("profile_id", "rank", "doc_id", "ocid", "score")
    want = match_tenders(v.profiles.select(F.col("id").alias("profile_id")), v.profiles, chunks, v.meta, k=5) \
        .select("profile_id", "rank", "doc_id", "ocid", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_merge_array_fields_latest_nonempty(spark):
    from pyspark.sql import types as T
    schema = T.StructType(S.NOTICE.fields + [T.StructField("awards", T.ArrayType(T.StringType()))])
    rows = [(1, "a", T0, "tender", "active", None, None, ["x"]),
            (2, "a", T0 + dt.timedelta(minutes=5), "award", "complete", None, None, []),
            (3, "a", T0 + dt.timedelta(minutes=9), None, None, None, None, None)]
    r = merge_notices(spark.createDataFrame(rows, schema)).first()
    assert r.awards == ["x"] and r.status == "complete" and r.n_notices == 3


def test_stream_merge_survives_restart(spark, tmp_path):
    """Stop the merge after some micro-batches and restart from the checkpoint: the result equals batch."""
    from tenderlake.sources import procurement as P
    notices = P.notices(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in notices.collect()]
    src, target, ck = str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "ck")
    _write_batches(spark, rows[: len(rows) // 2], src, 2)

    def run_once():
        stream = merge_notices_stream(read_notice_stream(spark, src, max_files_per_trigger=1))
        q = (stream.writeStream.outputMode("update").foreachBatch(upsert_snapshot(target))
                   .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(240)

    run_once()                                    # first half, then the job "dies"
    _write_batches(spark, rows[len(rows) // 2:], src, 2)
    run_once()                                    # restarted from the same checkpoint
    cols = ["ocid", "tag", "status", "description", "award_value", "n_notices", "first_ts", "last_ts"]
    got = read_snapshot(spark, target).select(cols)
    want = merge_notices(notices).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nested_fields_merge_one_by_one(spark):
    schema = ("notice_id long, ocid string, ts timestamp, phase string, tender struct<title:string,description:string,"
              "value:struct<amount:double,currency:string>,lots:array<string>>, buyer struct<name:string>, awards array<struct<id:string>>")
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "a", t(1), "tender", ("T1", "desc", (1.0, "EUR"), ["l"]), ("B",), [("A1",)]),
            (2, "a", t(2), "award", ("T1b", None, (2.0, None), []), None, []),
            (3, "a", t(3), "award", None, ("",), None), (4, "b", t(1), "tender", None, None, None)]
    got = {r.ocid: r for r in merge_notices(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    a = got["a"]
    assert (a.tender.title, a.tender.description, a.tender.value.amount, a.tender.value.currency, a.tender.lots) == ("T1b", "desc", 2.0, "EUR", ["l"])
    assert a.buyer.name == "B" and [x.id for x in a.awards] == ["A1"]
    assert got["b"].tender is None and got["b"].buyer is None


def test_compaction_reads_beside_new_epochs(spark, tmp_path):
    target, out = str(tmp_path / "snap"), str(tmp_path / "compact")
    frame = lambda rows: spark.createDataFrame(rows, "ocid string, n long")
    write = upsert_snapshot(target)
    write(frame([("a", 1), ("b", 1)]), 0)
    write(frame([("a", 2)]), 7)
    compact_snapshot(spark, target, out)
    assert sorted(map(tuple, read_snapshot(spark, out).collect())) == [("a", 2), ("b", 1)]
    upsert_snapshot(target, generation=1)(frame([("b", 5)]), 0)         # a new checkpoint counts epochs from 0
    assert sorted(map(tuple, read_snapshot(spark, out, target).collect())) == [("a", 2), ("b", 5)]
