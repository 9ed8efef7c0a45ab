"""Alerts with memory, chained stateful steps, change-only embedding, rejects."""

import collections
import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.operators import embed_changes
from tenderlake.operators.matching import match_tenders
from tenderlake.session import scratch_path, scratch_scope, write_once
from tenderlake.sources import releases_json
from tenderlake.sources.stored import Views
from tenderlake.streaming import alerts
from tenderlake.streaming import notices as N

SF = "/root/testdata/sf0.001"


def test_scratch_scope_reuses_names(spark, tmp_path):
    for k in range(3):
        with scratch_scope(str(tmp_path / "s")):
            assert [write_once(spark.range(k + n), "x").count() for n in (1, 2)] == [k + 1, k + 2]
    assert sorted(os.listdir(tmp_path / "s")) == ["0-x", "1-x"]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_running_alerts_equal_one_batch_after_any_split(spark, tmp_path):
    v = Views(spark, SF)
    chunks = v.chunks.orderBy(F.xxhash64("doc_id")).collect()
    src = tmp_path / "in"
    for k, part in enumerate((chunks[:25], chunks[25:90], chunks[90:])):
        if part:
            spark.createDataFrame(part, v.chunks.schema).coalesce(1).write.mode("append").parquet(str(src))
            files = [f for f in os.listdir(src) if f.endswith(".parquet")]
            for f in files:                                    # arrival order is modification order
                if os.stat(src / f).st_mtime > 2_000_000:
                    os.utime(src / f, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(v.chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    target, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = alerts.start_running_alerts(stream, v.profiles, v.meta, target, ck, k=4, trigger_once=True)
    q.awaitTermination(300)
    epochs = sorted(int(f.split("=")[1]) for f in os.listdir(f"{target}/alerts"))
    assert len(epochs) == 3 and sorted(os.listdir(f"{ck}-scratch")) == ["0", "1"]
    want = match_tenders(v.profiles.select(F.col("id").alias("profile_id")), v.profiles, v.chunks, v.meta, k=4).select(*alerts.LIST_COLUMNS)
    got = alerts.read_lists(spark, target, epochs[-1])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    fired = spark.read.parquet(f"{target}/alerts").select("profile_id", "ocid", "epoch").collect()
    seen = collections.Counter((r[0], r[1]) for r in fired)
    final = {(r["profile_id"], r["ocid"]) for r in got.collect()}
    assert final <= set(seen)                                  # whatever is in a list was an alert when it entered


def test_merge_lists_keeps_the_best_of_each_process(spark):
    schema = "profile_id string, rank long, doc_id string, ocid string, score double"
    a = spark.createDataFrame([("p", 1, "d1", "o1", 0.9), ("p", 2, "d2", "o2", 0.5), ("q", 1, "d1", "o1", 0.1)], schema)
    b = spark.createDataFrame([("p", 1, "d7", "o2", 0.9), ("p", 2, "d3", "o3", 0.5), ("p", 3, "d9", "o4", 0.4)], schema)
    want = [("p", 1, "d1", "o1", 0.9), ("p", 2, "d7", "o2", 0.9), ("p", 3, "d3", "o3", 0.5), ("q", 1, "d1", "o1", 0.1)]
    assert sorted(map(tuple, alerts.merge_lists(a, b, 3).collect())) == want == sorted(map(tuple, alerts.merge_lists(b, a, 3).collect()))


def _notice(i, ts, phase="tender"):
    return (i, f"o{i}", ts, phase, None, None, None)


def test_duplicates_count_once_and_late_rows_are_reported(spark, tmp_path):
    day = dt.datetime(2024, 5, 1)
    hour = dt.timedelta(hours=1)
    batches = [[_notice(1, day + 3 * hour), _notice(1, day + 3 * hour), _notice(2, day + 5 * hour, "award")],
               [_notice(1, day + 3 * hour), _notice(3, day + 100 * hour), _notice(9, day + 100 * hour, None)],
               [_notice(4, day + 2 * hour), _notice(5, day + 101 * hour), _notice(5, day + 101 * hour)],      # 4 is late
               [_notice(6, day + 400 * hour)], [_notice(7, day + 401 * hour)]]
    src = str(tmp_path / "in")
    os.makedirs(src)
    names = [f.name for f in S.NOTICE.fields]
    order = ["notice_id", "ocid", "ts", "phase", "status", "description", "award_value"]
    out = {}
    stream = N.deduped_daily_counts_stream(N.read_notice_stream(spark, src, 1), "1 day")
    q = (stream.writeStream.outputMode("append").format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        for rows in batches:
            data = [tuple(dict(zip(order, r))[n] for n in names) for r in rows]
            spark.createDataFrame(data, S.NOTICE).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        progress = q.recentProgress
    finally:
        q.stop()
    for r in spark.sql("SELECT * FROM deduped").collect():
        out[(r["day"], r["phase"])] = r["n"]
    assert out[("2024-05-01", "tender")] == 1 and out[("2024-05-01", "award")] == 1
    assert out[("2024-05-05", "tender")] == 2                  # 3 and 5, each once
    reports = [json.loads(p.json) if hasattr(p, "json") else p for p in progress]
    assert N.late_rows(reports) == 1 and N.observed_rows(reports) == sum(map(len, batches))


def _factory(log):
    """A stub model that writes down its texts; everything is local, so that workers get it by value."""
    import numpy as np

    class Model:
        def __init__(self, log):
            self.log = log

        def tokenize(self, texts, limit):
            with open(self.log, "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            ids = np.array([[len(t), sum(map(ord, t)) % 997] for t in texts])
            return ids, np.ones_like(ids)

        def forward(self, ids, mask):
            return np.stack([ids, ids[:, ::-1] + 1, ids * 2], axis=2).astype(np.float32)

    return lambda: Model(log)


def test_only_changed_chunks_are_embedded(spark, tmp_path):
    log = str(tmp_path / "calls")
    open(log, "w").close()
    factory = _factory(log)
    texts = {f"o{k}#{c}": f"text {k} {c}" if k % 4 else "shared text" for k in range(12) for c in "ab"}
    frame = lambda t: spark.createDataFrame(list(t.items()) + [("null", None)], "doc_id string, text string").repartition(3)
    calls = lambda: sum(1 for _ in open(log))
    first, added = embed_changes.embed_changed(frame(texts), embed_changes.no_vectors(spark), factory, dim=3)
    one = {r["doc_id"]: r["embedding"] for r in first.collect()}
    assert calls() == 19 == added.count() and one["null"] is None and one["o0#a"] == one["o8#b"]      # 18 own texts and the shared one
    stored = write_once(added, "vectors")
    changed = {**texts, "o5#a": "another text", "o6#b": "text 5 a"}                                   # one new content, one known
    second, more = embed_changes.embed_changed(frame(changed), stored, factory, dim=3)
    two = {r["doc_id"]: r["embedding"] for r in second.collect()}
    assert calls() == 20 and more.count() == 1
    assert {d: v for d, v in two.items() if d not in ("o5#a", "o6#b")} == {d: v for d, v in one.items() if d not in ("o5#a", "o6#b")}
    assert two["o6#b"] == one["o5#a"] and two["o5#a"] != one["o5#a"]
    none, nothing = embed_changes.embed_changed(frame(changed), stored.unionByName(more), factory, dim=3)
    assert none.count() == 25 and nothing.count() == 0 and calls() == 20


def test_rejects_tell_broken_from_missing(spark):
    lines = ['{"ocid": "a", "tender": {"title": "x"}}', "", None, "  ", "{broken", "[1]", '"text"', "12", '{"id": "no key"}', '{"ocid": ""}', '{"ocid": "b"}']
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = releases_json.parse_with_rejects(frame)
    assert sorted(r["ocid"] or "" for r in good.collect()) == ["", "", "a", "b"]
    assert collections.Counter(r["reason"] for r in bad.collect()) == {"empty": 3, "not json": 1, "not an object": 3, "no ocid": 2}
