"""Property and skew tests."""

import datetime as dt

import random

from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.text import truncate_utf8
from tenderlake.operators.notices import merge_notices


def _ref_truncate(text, max_bytes=200):
    b = text.encode()
    if len(b) <= max_bytes:
        return text
    end = max_bytes
    while end > 0 and (b[end] & 0xC0) == 0x80:
        end -= 1
    return b[:end].decode() + "…"


def _random_texts(n=400, seed=5):
    rng = random.Random(seed)
    ranges = [(0x20, 0x7E), (0xA0, 0x24F), (0x370, 0x3FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F64F)]
    out = []
    for _ in range(n):
        length = rng.randint(40, 260)
        out.append("".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(length)))
    return out


def test_truncate_matches_reference_on_random_unicode(spark):
    texts = _random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", truncate_utf8(F.col("t"), 200).alias("x")).collect()}
    assert all(got[i] == _ref_truncate(t) for i, t in enumerate(texts))


def test_merge_with_a_hot_process(spark):
    """One OCID holds a third of all notices: the merge is exact and aggregates map-side first."""
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        ocid = "hot" if i % 3 == 0 else f"o{i % 97}"
        status = ["planning", "active", "complete", None, ""][i % 5]
        rows.append((i, ocid, t0 + dt.timedelta(seconds=i), "tender" if i % 2 else "award", status, None,
                     float(i) if i % 7 == 0 else None))
    df = spark.createDataFrame(rows, S.NOTICE).repartition(8)
    merged = merge_notices(df)
    plan = merged._sc._jvm.PythonSQLUtils.explainString(merged._jdf.queryExecution(), "formatted")
    assert "partial_max_by" in plan and "partial_collect_set" in plan
    hot = merged.filter("ocid = 'hot'").first()
    hot_rows = [r for r in rows if r[1] == "hot"]
    last_status = max((r for r in hot_rows if r[4]), key=lambda r: (r[2], r[0]))[4]
    last_value = max((r for r in hot_rows if r[6] is not None), key=lambda r: (r[2], r[0]))[6]
    assert hot.n_notices == 1000 and hot.status == last_status and hot.award_value == last_value
    assert hot.tag == ["award", "tender"]
