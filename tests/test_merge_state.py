"""S1 on keyed state with timers: whatever the arrival order, timers, restarts and checkpoints, the releases equal the batch merge."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators.notices import merge_notices
from tenderlake.streaming import merge_state as M
from tenderlake.streaming.notices import read_notice_stream

T0 = dt.datetime(2024, 1, 1)


def _notices(seed=1, n=90, keys=7):
    """Processes of very unequal size, gaps in every field, equal times."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ocid = f"o{min(r.randint(0, keys - 1), r.randint(0, keys - 1))}"
        rows.append((i, ocid, T0 + dt.timedelta(minutes=r.randint(0, 40)), r.choice([None, "planning", "tender", "award"]), r.choice([None, "", "active", "complete"]),
                     r.choice([None, "", f"text {i}"]), r.choice([None, float(i)])))
    return rows


def _arrive(spark, rows, src, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], S.NOTICE).coalesce(1).write.mode("append").parquet(src)


def _run(spark, src, target, ck, **kw):
    q = M.start_merge_states(M.merge_state_stream(read_notice_stream(spark, src, 1), **kw), target, ck, trigger_once=True)
    assert q.awaitTermination(100)
    assert q.exception() is None
    return q


def _same(spark, rows, *folders):
    want = merge_notices(spark.createDataFrame(rows, S.NOTICE))
    got = M.read_states(spark, *folders).select(want.columns)
    key = lambda t: t[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


@pytest.mark.parametrize("order, kw", [("as made", {}), ("reversed", {"parts": 1}), ("shuffled", {"quiet_ms": 0, "closed_quiet_ms": 0})])
def test_stream_equals_batch_in_any_order_with_a_restart(spark, tmp_path, order, kw):
    rows = _notices()
    late = {"as made": rows, "reversed": rows[::-1], "shuffled": random.Random(2).sample(rows, len(rows))}[order]
    src, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    _arrive(spark, late[:60], src, 2)
    _run(spark, src, target, ck, **kw)
    _same(spark, late[:60], target)
    _arrive(spark, late[60:], src, 1)
    _run(spark, src, target, ck, **kw)                     # the same checkpoint again
    _same(spark, rows, target)


def test_timers_clear_states_and_corrections_open_new_ones(spark, tmp_path):
    rows = [(1, "a", T0, "tender", "active", "first", None), (2, "a", T0 + dt.timedelta(hours=1), "award", "complete", None, 5.0),
            (3, "b", T0, "tender", "active", None, None)]
    fix = [(9, "a", T0 + dt.timedelta(minutes=30), None, None, "older than the award, newer than the first text", None)]
    other = [(20, "c", T0, "tender", None, None, None)]
    src, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    done = []
    for some in (rows, other, fix):
        done += some
        _arrive(spark, some, src, 1)
        q = _run(spark, src, target, ck, parts=1, closed_quiet_ms=0)
        _same(spark, done, target)
    opened = {r["ocid"]: r["n"] for r in M.newest_states(spark, target).groupBy("ocid").agg(F.count("*").alias("n")).collect()}
    assert opened == {"a": 2, "b": 1, "c": 1}              # the closed process had left the state, the open one had not


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    rows, (src, target, ck) = _notices(3, 30), (str(tmp_path / x) for x in ("in", "out", "ck"))
    _arrive(spark, rows, src, 2)
    _run(spark, src, target, ck)
    again = str(tmp_path / "again")
    spark.read.parquet(target).write.parquet(again)
    _same(spark, rows, target, again)


@pytest.mark.parametrize("resume", [True, False])
def test_new_checkpoint_goes_on_beside_old_rows(spark, tmp_path, resume):
    rows, (src, src2, target, small) = _notices(5), (str(tmp_path / x) for x in ("in", "in2", "out", "small"))
    _arrive(spark, rows[:50], src, 2)
    _run(spark, src, target, str(tmp_path / "ck"))
    M.compact_states(spark, target, small)
    initial = M.initial_states(spark, small) if resume else None
    before = M.newest_states(spark, small).count()
    _arrive(spark, rows[50:], src2, 2)
    _run(spark, src2, target, str(tmp_path / "ck2"), initial=initial)
    _same(spark, rows, target)
    _same(spark, rows, small, target)
    grown = M.newest_states(spark, target).count() - before
    keys = spark.createDataFrame(rows, S.NOTICE).select("ocid", F.pmod(F.xxhash64("notice_id"), F.lit(M.PARTS))).distinct().count()
    assert grown == keys - before if resume else grown > keys - before


def test_nested_fields_and_lists(spark, tmp_path):
    schema = ("notice_id long, ocid string, ts timestamp, phase string, tender struct<title:string,value:struct<amount:double,currency:string>,"
              "lots:array<string>>, awards array<struct<id:string>>")
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(1, "a", t(1), "tender", ("T1", (1.0, "EUR"), ["l"]), [("A1",)]), (2, "a", t(2), "award", ("T1b", (2.0, None), []), []),
            (3, "a", None, "award", None, None), (4, "b", t(1), None, None, None)]
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, schema)
    for k in (3, 1, 2, 4):
        frame.filter(F.col("notice_id") == k).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(src)
    q = M.start_merge_states(M.merge_state_stream(stream, parts=2), target, str(tmp_path / "ck"), trigger_once=True)
    assert q.awaitTermination(100)
    got = M.read_states(spark, target, schema=frame.schema)
    want = merge_notices(frame).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_state_calls_grow_with_buckets_not_processes(spark, tmp_path):
    """Many processes in few buckets: a bucket is one state and one timer, however many states of processes it holds."""
    rows = _notices(7, 900, 400)
    src, target, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for some in (rows[:500], rows[500:]):
        _arrive(spark, some, src, 1)
        q = _run(spark, src, target, ck, buckets=3, closed_quiet_ms=0)
        assert 3 <= q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12       # values, timers and their index
    _same(spark, rows, target)
    assert M.buckets_for(10) == M.PER_BUCKET and M.buckets_for(6_000_000) * M.PER_BUCKET >= 6_000_000


def test_kept_lists_of_rows_are_written_back(spark, tmp_path):
    """Other processes' notices rewrite the whole bucket, nested values with it."""
    schema = "notice_id long, ocid string, ts timestamp, phase string, awards array<struct<id:string,at:timestamp>>"
    rows = [(i, f"o{i % 3}", T0 + dt.timedelta(hours=i), "award", [(f"A{i}", T0)] if i < 3 else None) for i in range(9)]
    src, target, frame = str(tmp_path / "in"), str(tmp_path / "out"), spark.createDataFrame(rows, schema)
    for k in range(3):
        frame.filter(F.floor(F.col("notice_id") / 3) == k).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame.schema).parquet(src)
        q = M.start_merge_states(M.merge_state_stream(stream, parts=1, buckets=1), target, str(tmp_path / "ck"), trigger_once=True)
        assert q.awaitTermination(100)
    got = M.read_states(spark, target, schema=frame.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, merge_notices(frame).select(got.columns).collect()))


def test_one_timer_moves_to_the_first_state_that_is_due():
    kept, timers = {}, set()

    class State:
        exists = staticmethod(lambda: "v" in kept)
        get = staticmethod(lambda: kept["v"])
        update = staticmethod(lambda v: kept.update(v=v))
        clear = staticmethod(kept.clear)

    class Handle:
        getValueState = staticmethod(lambda name, schema: State)
        registerTimer, deleteTimer = staticmethod(timers.add), staticmethod(timers.discard)

    class At:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    merge = M._Merge(M._state_type(S.NOTICE), ["_v0", "_v1", "_v2"], quiet_ms=100, closed_quiet_ms=10)
    merge.init(Handle)
    row = Row("ocid", "part", "notice_id", "ts", "phase", "_v0", "_v1", "_v2")
    arrive = lambda now, *rows: [r["ocid"] for r in merge.handleInputRows((0,), iter(rows), At(now))]
    assert arrive(1000, row("a", 0, 1, 5, "tender", "s", None, None), row("b", 0, 2, 6, "tender", None, None, 1.0)) == ["a", "b"]
    assert timers == {1100}
    assert arrive(1050, row("a", 0, 3, 7, "award", None, None, None)) == ["a"] and timers == {1060}     # closed: due earlier
    merge.handleExpiredTimer((0,), At(1070), None)
    assert kept["v"][0] == ["b"] and 1100 in timers
    merge.handleExpiredTimer((0,), At(1100), None)
    assert not kept
