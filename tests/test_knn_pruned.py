import numpy as np
import pytest

from tenderlake.operators.knn import top_k_similar
from tenderlake.operators.knn_pruned import CELL, build_cells, bounds, pruned_top_k


def _frame(spark, vectors, name, prefix, extra=None):
    rows = [(f"{prefix}{i:05d}", f"key{i % 7}" if extra else None, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} string, key string, embedding array<float>").repartition(3)


def _clustered(seed=1, clusters=12, each=60, dim=8, spread=0.02):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    points = np.concatenate([c + spread * r.normal(size=(each, dim)) for c in centres])
    return centres, points


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("distinct, blocks", [(None, 64 << 20), ("key", 64 << 20), (None, 8 * 64 * 5)])
def test_equals_the_unpruned_search(spark, tmp_path, distinct, blocks):
    centres, points = _clustered()
    vectors = [*points, *points[:5], None, np.zeros(8)]         # ties, a null and a zero vector
    corpus = _frame(spark, vectors, "doc_id", "d", extra=True)
    queries = _frame(spark, [*(centres + 0.01), *(-centres[:2]), np.zeros(8), None], "query_id", "q").drop("key")
    cells = build_cells(corpus, str(tmp_path / f"c{distinct}{blocks}"), n_cells=24, through=["key"])
    got, visits = pruned_top_k(queries, cells, 9, distinct_by=distinct, through=["key"], block_bytes=blocks)
    want = top_k_similar(queries, corpus, 9, distinct_by=distinct, through=["key"])
    assert _rows(got) == _rows(want.select(got.columns))
    assert visits.cells == len(cells.rows) and cells.rows.sum() == len(vectors) - 1


def test_tight_clusters_are_skipped(spark, tmp_path):
    """Queries near a cluster read its cells only; the plan reads only those folders."""
    centres, points = _clustered(seed=2, spread=0.01)
    corpus = _frame(spark, points, "doc_id", "d")
    cells = build_cells(corpus, str(tmp_path / "cells"), n_cells=40)
    queries = _frame(spark, centres[:1], "query_id", "q").drop("key")
    got, visits = pruned_top_k(queries, cells, 5)
    assert _rows(got) == _rows(top_k_similar(queries, corpus, 5).select(got.columns))
    assert visits.comparisons_made <= 0.2 * visits.comparisons and visits.pairs_visited < 0.5 * visits.pairs
    plan = cells.table.filter(f"{CELL} IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and CELL in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_the_bound_is_never_below_a_score_and_is_tight(spark, tmp_path):
    r = np.random.default_rng(3)
    corpus = _frame(spark, r.normal(size=(300, 6)), "doc_id", "d")
    cells = build_cells(corpus, str(tmp_path / "cells"), n_cells=10)
    q = r.normal(size=(40, 6))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    bound = bounds(cells, q)
    gap = []
    for row in cells.table.collect():
        v = np.array(row["embedding"])
        score = q @ (v / np.linalg.norm(v))
        assert (score <= bound[:, row[CELL]] + 1e-9).all()
        gap.append((bound[:, row[CELL]] - score).min())
    # in the plane of pivot and farthest member the bound is reached
    far = max(cells.table.collect(), key=lambda x: -float(np.dot(cells.pivots[x[CELL]], np.array(x["embedding"]) / np.linalg.norm(x["embedding"]))))
    v, p = np.array(far["embedding"]) / np.linalg.norm(far["embedding"]), cells.pivots[far[CELL]]
    beyond = v + 0.05 * (v - p * (v @ p))
    beyond /= np.linalg.norm(beyond)
    assert bounds(cells, beyond[None])[0, far[CELL]] - beyond @ v < 1e-6


def test_empty_sides(spark, tmp_path):
    corpus = _frame(spark, _clustered()[1][:20], "doc_id", "d")
    none = corpus.filter("doc_id = ''")
    cells = build_cells(corpus, str(tmp_path / "a"), n_cells=4)
    queries = corpus.select(corpus.doc_id.alias("query_id"), "embedding")
    assert pruned_top_k(queries.limit(0), cells, 3)[0].count() == 0
    empty = build_cells(none, str(tmp_path / "b"))
    assert pruned_top_k(queries, empty, 3)[0].count() == 0
    assert pruned_top_k(queries, cells, 50)[0].count() == 20 * 20
