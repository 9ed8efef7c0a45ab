"""Edge cases for text and vector functions (FIXTURES.md section 2)."""

import numpy as np
from pyspark.sql import functions as F

from tenderlake.functions.text import notice_url, truncate_utf8, with_role_prefix
from tenderlake.functions.vectors import cosine, l2_normalize


def _ref_truncate(text, max_bytes=200):
    b = text.encode()
    if len(b) <= max_bytes:
        return text
    end = max_bytes
    while end > 0 and (b[end] & 0xC0) == 0x80:
        end -= 1
    return b[:end].decode() + "…"


def test_truncate_boundaries(spark):
    cases = ["a" * 199, "a" * 200, "a" * 201, "a" * 199 + "é" + "b", "a" * 198 + "€" + "x" * 5,
             "😀" * 60, "", "ü" * 100, "ü" * 101]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "t string")
    got = [r[0] for r in df.select(truncate_utf8(F.col("t"), 200)).collect()]
    assert got[:-1] == [_ref_truncate(c) for c in cases]
    assert got[-1] is None


def test_notice_url_and_prefix(spark):
    df = spark.createDataFrame([("N-1", "x"), (None, "y")], "id string, t string")
    rows = df.select(notice_url("id").alias("u"), with_role_prefix("t", "passage").alias("p")).collect()
    assert rows[0].u.endswith("noticeId=N-1") and rows[1].u is None
    assert rows[0].p == "passage: x"


def test_l2_normalize_zero_and_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(l2_normalize("v", as_float=False).alias("n")).collect()
    assert np.allclose(rows[0].n, [0.6, 0.8]) and rows[1].n == [0.0, 0.0]


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-12
