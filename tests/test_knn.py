"""Exact top-k against brute force: ties, zero/NULL vectors, distinct keys, any number of query blocks."""

import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tenderlake.operators.knn import top_k_similar

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _brute(q, c, ids, keys, k, distinct):
    out = {}
    cn = c / np.where(np.linalg.norm(c, axis=1, keepdims=True) > 0, np.linalg.norm(c, axis=1, keepdims=True), 1)
    for qi, qv in q.items():
        qn = qv / np.linalg.norm(qv)
        s = np.round(cn @ qn, 6)
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))
        res, seen = [], set()
        for i in order:
            if distinct and keys[i] in seen:
                continue
            seen.add(keys[i])
            res.append((ids[i], float(s[i])))
            if len(res) == k:
                break
        out[qi] = res
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 2 * 8 * 8])
@pytest.mark.parametrize("distinct", [False, True])
def test_topk_matches_brute_force(spark, block_bytes, distinct):
    rng = np.random.default_rng(7)
    n, d = 300, 8
    c = rng.integers(-2, 3, size=(n, d)).astype(float)   # many exact ties
    c[5] = 0.0                                             # zero vector
    ids = [f"d{i:03d}" for i in range(n)]
    keys = [f"o{i % 40}" for i in range(n)]
    q = {f"q{j}": rng.integers(-2, 3, size=d).astype(float) + 0.5 for j in range(6)}
    corpus = spark.createDataFrame(
        [(ids[i], keys[i], c[i].tolist()) for i in range(n)] + [("dnull", "o0", None)],
        "doc_id string, ocid string, embedding array<float>")
    queries = spark.createDataFrame([(k_, v.tolist()) for k_, v in q.items()], "query_id string, embedding array<float>")
    res = top_k_similar(queries, corpus.repartition(3), 7, through=["ocid"],
                        distinct_by="ocid" if distinct else None, block_bytes=block_bytes).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == _brute(q, c, ids, keys, 7, distinct)
    ranks = {}
    for r in res:
        ranks.setdefault(r.query_id, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_width_mismatch_is_an_error(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    with pytest.raises(Exception):
        top_k_similar(queries, corpus.coalesce(1), 1).collect()


def test_no_queries_gives_empty(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0])], "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", None)], "query_id string, embedding array<float>")
    assert top_k_similar(queries, corpus, 3).count() == 0


def test_plan_has_no_cartesian_product(spark):
    corpus = spark.createDataFrame([("a", "o", [1.0, 0.0])], "doc_id string, ocid string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    df = top_k_similar(queries, corpus, 3, distinct_by="ocid")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan


def test_many_query_blocks_and_small_sim_blocks(spark, monkeypatch):
    import tenderlake.operators.knn as knn
    monkeypatch.setattr(knn, "SIM_BLOCK_ELEMENTS", 64)      # forces query blocks inside every batch
    rng = np.random.default_rng(11)
    c = rng.normal(size=(120, 6))
    ids = [f"d{i:03d}" for i in range(120)]
    q = {f"q{j}": rng.normal(size=6) for j in range(9)}
    corpus = spark.createDataFrame([(ids[i], c[i].tolist()) for i in range(120)], "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([(k_, v.tolist()) for k_, v in q.items()], "query_id string, embedding array<float>")
    c32 = np.array(c, dtype=np.float32).astype(float)
    q32 = {k_: np.array(v, dtype=np.float32).astype(float) for k_, v in q.items()}
    want = _brute(q32, c32, ids, ids, 5, False)
    for opts in ({"block_bytes": 4 * 8 * 6}, {}):
        res = knn.top_k_similar(queries, corpus.repartition(2), 5, **opts).collect()
        got = {}
        for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert got == want


def test_repeated_queries_count_once(spark):
    corpus = spark.range(200).selectExpr("cast(id as string) as doc_id", "id as extra",
                                         "array(cast(id % 7 as float), cast(id % 5 as float) + 1) as embedding").repartition(16)
    queries = spark.createDataFrame([("q", [1.0, 1.0]), ("r", [1.0, 2.0])], "query_id string, embedding array<float>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    once = rows(top_k_similar(queries, corpus, 5))
    assert rows(top_k_similar(queries.unionByName(queries), corpus, 5)) == once
    assert rows(top_k_similar(queries, corpus, 5, carry=["extra"])) == once


def test_building_runs_no_job_over_the_corpus(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    corpus = (spark.range(50).selectExpr("cast(id as string) as doc_id", "'a long text' as text", "array(cast(id as float), 1f) as embedding")
              .mapInArrow(count, "doc_id string, text string, embedding array<float>"))
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<float>")
    hits = top_k_similar(queries, corpus, 3)
    assert seen.value == 0
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    inner = plan[plan.rindex("MapInArrow"):]
    assert hits.count() == 3 and seen.value == 50 and "text" not in re.findall(r"MapInArrow\nInput \[\d+\]: \[([^\]]*)\]", inner + plan)[0]


def _parity_mask(qinfo, batch):
    qpar = np.array(qinfo["par"])[None, :]
    rpar = np.array(batch.column("rpar").to_pylist())[:, None]
    return qpar == rpar


@pytest.mark.parametrize("block_bytes", [1 << 20, 2 * 8 * 5])
def test_pair_filter_is_exact(spark, block_bytes):
    from tenderlake.operators.knn import PairFilter
    rng = np.random.default_rng(3)
    c = rng.normal(size=(150, 5))
    ids = [f"d{i:03d}" for i in range(150)]
    q = {f"q{j}": rng.normal(size=5) for j in range(6)}
    corpus = spark.createDataFrame([(ids[i], i % 2, c[i].tolist()) for i in range(150)],
                                   "doc_id string, rpar int, embedding array<float>")
    queries = spark.createDataFrame([(k_, j % 2, v.tolist()) for j, (k_, v) in enumerate(q.items())],
                                    "query_id string, par int, embedding array<float>")
    pf = PairFilter(query_cols=("par",), corpus_cols=("rpar",), fn=_parity_mask)
    res = top_k_similar(queries, corpus.repartition(3), 4, pair_filter=pf,
                        block_bytes=block_bytes).collect()
    c32 = np.array(c, dtype=np.float32).astype(float)
    for j, (k_, v) in enumerate(q.items()):
        keep = [i for i in range(150) if i % 2 == j % 2]
        want = _brute({k_: np.array(v, dtype=np.float32).astype(float)}, c32[keep], [ids[i] for i in keep],
                      [ids[i] for i in keep], 4, False)[k_]
        got = [(r.doc_id, r.score) for r in sorted((r for r in res if r.query_id == k_), key=lambda r: r.rank)]
        assert got == want


@pytest.mark.parametrize("distinct", [False, True])
def test_small_blocks_share_one_scan_of_the_corpus(spark, distinct):
    """Blocks of two queries: the corpus is read once for all of them, and every slice keeps the right rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rng = np.random.default_rng(5)
    c, q = rng.integers(-2, 3, size=(9000, 4)).astype(float), rng.integers(-2, 3, size=(31, 4)) + 0.5
    ids, keys = [f"d{i:05d}" for i in range(len(c))], [f"o{i % 50}" for i in range(len(c))]
    corpus = (spark.createDataFrame([(i, o, v.tolist()) for i, o, v in zip(ids, keys, c)], "doc_id string, ocid string, embedding array<float>")
              .coalesce(1).mapInArrow(count, "doc_id string, ocid string, embedding array<float>"))
    queries = spark.createDataFrame([(f"q{j:02d}", v.tolist()) for j, v in enumerate(q)], "query_id string, embedding array<float>")
    res = top_k_similar(queries, corpus, 6, distinct_by="ocid" if distinct else None, block_bytes=2 * 8 * 4).collect()
    assert seen.value == len(c)
    got = {}
    for r in sorted(res, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == _brute({f"q{j:02d}": v for j, v in enumerate(q)}, c, ids, keys, 6, distinct)


def test_many_scans_equal_one(spark, monkeypatch):
    import tenderlake.operators.knn as knn
    rng = np.random.default_rng(12)
    corpus = spark.createDataFrame([(f"d{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))], "doc_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))], "query_id string, embedding array<float>")
    once = sorted(map(tuple, knn.top_k_similar(queries, corpus, 5).collect()))
    monkeypatch.setattr(knn, "STATE_ROWS", 60)              # twelve queries a scan
    assert sorted(map(tuple, knn.top_k_similar(queries, corpus, 5).collect())) == once and len(once) == 200


def _all_true(qinfo, batch):
    assert len(qinfo["par"]) <= 256 and batch.num_rows <= 4096
    return np.ones((batch.num_rows, len(qinfo["par"])), dtype=bool)


def test_task_memory_is_bounded(spark):
    """One task's arrays do not grow with queries x rows of a batch, nor does a pair rule see more than a slice and a block."""
    import tracemalloc

    import pyarrow as pa

    from tenderlake.operators import knn
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(2500, 8)), rng.normal(size=(10_000, 8))
    batch = pa.record_batch({"doc_id": [f"d{i:05d}" for i in range(len(c))], "embedding": pa.array(c.tolist(), pa.list_(pa.float32()))})
    schema = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64()), ("__salt", pa.int32())])
    rows = knn.SIM_BLOCK_ELEMENTS // knn.BATCH_ROWS
    blocks = [(knn._unit_rows(q[i:i + rows]), {"par": [0] * len(q[i:i + rows])}) for i in range(0, len(q), rows)]
    rule = knn.PairFilter(query_cols=("par",), corpus_cols=(), fn=_all_true)
    tracemalloc.start()
    out = pa.Table.from_batches(knn._partition_topk([batch] * 3, blocks, pa.array([f"q{j}" for j in range(len(q))]), 10, 1e6, "doc_id", "embedding", None,
                                                    ["doc_id"], "query_id", "score", schema, 0, rule))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 10 * len(q) and peak < 10_000 * 2500 * 8       # less than one matrix of all pairs of a batch
