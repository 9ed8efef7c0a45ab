"""Embedding jobs (stub model), pooling, listing plans, index info on empty tables."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tenderlake import schemas as S
from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.embed import EmbedderMissing, embed_texts, hash_embed, mean_pool
from tenderlake.operators.listing import index_info, list_releases, page_bounds


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class StubModel:
    """Whitespace tokens; token t -> one-hot on (len(t) % dim)."""

    def __init__(self, dim=4):
        self.dim = dim

    def tokenize(self, texts, max_tokens):
        toks = [t.split()[:max_tokens] for t in texts]
        seq = max(1, max(len(t) for t in toks))
        ids = np.zeros((len(texts), seq), dtype=np.int64)
        mask = np.zeros((len(texts), seq), dtype=np.int64)
        for i, t in enumerate(toks):
            for j, w in enumerate(t):
                ids[i, j] = len(w) % self.dim
                mask[i, j] = 1
        return ids, mask

    def forward(self, ids, mask):
        return np.eye(self.dim)[ids]


def test_embed_texts_stub(spark):
    df = spark.createDataFrame([(1, "ab abc"), (2, None)], "id long, text string")
    out = {r.id: r.embedding for r in embed_texts(df, "text", lambda: StubModel(4), role="query", dim=4,
                                                  max_tokens=2).collect()}
    # tokens: "query:" (6 -> 2), "ab" (2 -> 2); third token cut by the limit
    assert np.allclose(out[1], [0, 0, 1, 0]) and out[2] is None


def test_embed_texts_needs_model_and_width(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(EmbedderMissing):
        embed_texts(df, "text", None)
    with pytest.raises(Exception):
        embed_texts(df, "text", lambda: StubModel(4), dim=8).collect()


def test_mean_pool_all_masked_is_zero(spark):
    tok = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (1, 1, 0, [3.0, 4.0]), (2, 0, 1, [3.0, 4.0]),
                                 (2, 1, 0, [9.0, 9.0])], "text_id long, pos int, mask int, hidden array<double>")
    got = {r.text_id: r.embedding for r in mean_pool(tok).collect()}
    assert got[1] == [0.0, 0.0] and np.allclose(got[2], [0.6, 0.8])


def test_hash_embed_whole_text(spark):
    long_text = " ".join(["alpha"] * 5000 + ["omega"])
    df = spark.createDataFrame([(1, long_text), (2, "!!!")], "id long, text string")
    rows = {r.id: r.embedding for r in hash_embed(df, "id", "text", 16).collect()}
    v = np.array(rows[1])
    assert rows[2] == [0.0] * 16 and abs(np.linalg.norm(v) - 1) < 1e-6 and np.count_nonzero(v) == 2


def test_page_bounds():
    assert page_bounds(None, None) == (20, 0) and page_bounds(5000, 30_000, max_limit=5000) == (5000, 30_000)
    for limit, offset in ((201, 0), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            page_bounds(limit, offset)


def test_listing_pushes_filters_to_scan(spark):
    from tenderlake.sources.stored import Views
    meta = Views(spark, "/root/testdata/sf0.001").meta
    page = list_releases(meta, FilterSpec(status="active", value_min=1000.0, month="1996-01"), limit=5)
    plan = page._sc._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(value_amount" in plan and "EqualTo(status,active)" in plan


def test_index_info_empty(spark):
    e_rel = spark.createDataFrame([], "ocid string")
    e_chunks = spark.createDataFrame([], "doc_id string, embedding array<float>")
    e_prof = spark.createDataFrame([], S.PROFILE)
    r = index_info(e_rel, e_chunks, e_prof).first()
    assert tuple(r) == (0, 0, 0, 0, 0)


def test_json_sink_omits_null_documents_url(spark, tmp_path):
    import json
    from tenderlake.sources.sinks import write_json
    df = spark.createDataFrame([("a", None, None), ("b", "u", None)], "ocid string, documents_url string, title string")
    write_json(df, str(tmp_path / "out"))
    rows = sorted((json.loads(l) for l in spark.read.text(str(tmp_path / "out")).toPandas()["value"]),
                  key=lambda d: d["ocid"])
    assert rows[0] == {"ocid": "a", "title": None}
    assert rows[1] == {"ocid": "b", "documents_url": "u", "title": None}


def test_deep_offset_and_keyset(spark):
    from tenderlake.sources.stored import Views
    meta = Views(spark, "/root/testdata/sf0.001").meta
    n = meta.count()
    assert list_releases(meta, offset=50_000).count() == 0
    assert [r.ocid for r in list_releases(meta, limit=5, offset=n - 2).collect()] == \
        [r.ocid for r in list_releases(meta, limit=n, max_limit=n).collect()][-2:]
    first = list_releases(meta, limit=3).collect()
    nxt = list_releases(meta, limit=3, after=(first[-1].date, first[-1].ocid)).collect()
    both = list_releases(meta, limit=6).collect()
    assert [r.ocid for r in first + nxt] == [r.ocid for r in both]


def test_match_responses_shape(spark):
    import json
    from tenderlake.operators.matching import match_tenders
    from tenderlake.sources.sinks import match_responses
    from tenderlake.sources.stored import Views
    v = Views(spark, "/root/testdata/sf0.001")
    m = match_tenders(v.requests, v.profiles, v.chunks, v.meta, k=3)
    docs = {r.profile_id: json.loads(r.json) for r in match_responses(m, v.requests).collect()}
    ready = [p for p, d in docs.items() if d["count"]]
    assert len(ready) == 5 and all(docs[p]["count"] == 3 for p in ready)
    first = docs[ready[0]]["matches"]
    assert [x["rank"] for x in first] == [1, 2, 3] and "url" in first[0] and "profile_id" not in first[0]
    assert docs["profile-unknown"] == {"profile_id": "profile-unknown", "count": 0, "matches": []}


def test_search_text_with_model(spark):
    from tenderlake.operators.search import search_text
    chunks = spark.createDataFrame(
        [("c1", "o1", "tender", "ab ab ab", []), ("c2", "o2", "tender", "abc abcd", []), ("c3", "o3", "lot:1", None, [])],
        "doc_id string, ocid string, chunk_type string, text string, cpv_codes array<string>")
    queries = spark.createDataFrame([("q", "ab")], "query_id string, text string")
    hits = search_text(queries, chunks, k=2, dim=4, embedder_factory=lambda: StubModel(4)).collect()
    # passage chunks: "passage: ab ab ab" -> tokens passage:(8->0) ab ab ab (2) ; query "query: ab" -> 2, 2
    assert [h.doc_id for h in sorted(hits, key=lambda h: h.rank)] == ["c1", "c2"]
    assert all(h.query_id == "q" for h in hits) and len(hits) == 2
