import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import exact_dedup, mixing
from tenderlake.llm.queries import LLM_ORACLE, LLM_QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_sql(spark, duck_small, name, monkeypatch):
    from tenderlake.plans import check, registry
    monkeypatch.setitem(registry.QUERIES, name, LLM_QUERIES[name])
    monkeypatch.setitem(registry.ORACLE, name, LLM_ORACLE[name])
    assert check.compare(spark, duck_small, name, "/root/testdata/sf0.001")["status"] == "match"


def _groups(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[(r[1] or "").translate(LOWER)].append(r[0])
    return by


def test_exact_dedup_edge_cases(edge, edge_rows):
    groups = _groups(edge_rows)
    want = collections.Counter()
    for r in edge_rows:
        ids = groups[(r[1] or "").translate(LOWER)]
        best = max((i for i in ids if i is not None), default=None)
        want[(r[0], best, len(ids), r[0] == best)] += 1
    assert collections.Counter(map(tuple, exact_dedup.exact_dedup(edge).collect())) == want


def test_drop_copies_leaves_one_of_each_text(edge, edge_rows, nothing):
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    got = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in left.collect()]
    groups = _groups(edge_rows)
    assert sorted(t for _, t in got) == sorted(groups)                 # each text once
    for i, t in got:
        assert i == max((x for x in groups[t] if x is not None), default=None)
    assert exact_dedup.drop_copies(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_is_native_and_shuffles_no_text(small_docs):
    plan = small_docs._sc._jvm.PythonSQLUtils.explainString(exact_dedup.exact_dedup(small_docs)._jdf.queryExecution(), "formatted")
    assert "Python" not in plan and "Arrow" not in plan and "text" not in plan


def _fill(sizes: dict, weights=(5, 2, 1), epochs=3):
    """Rounds of clamping, as the text of the contract says."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: epochs * sizes[s] for s in over})


def test_mix_targets_and_taken(spark, edge, edge_rows, nothing):
    rows = [(d, " ".join(["w"] * (1 + d * 7 % 60)), f"s{d % 4}" if d % 11 else None) for d in range(3000)]
    rows += [(9000 + k, "only a few words", "tiny") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target, source = _fill(sizes), {d: s for d, _, s in rows}
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["repeats"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(5, 0.001 * target[s]), s
    edge_got = mixing.mix(edge).collect()
    assert len(edge_got) == len(edge_rows)
    sizes = collections.Counter()
    for r in edge_rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = _fill(sizes)
    assert {round(r["target"], 6) for r in edge_got} == {round(v, 6) for v in want.values()}
    assert mixing.mix(nothing).count() == 0 and mixing.take_mix(nothing).count() == 0


def test_mix_reaches_targets_beside_a_very_long_document(spark):
    """The long document's draw and share vary; small documents always suffice to fill the target."""
    rows = [(d, " ".join(["w"] * (5 + d * 13 % 90)), f"s{d % 8}") for d in range(2400)]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    rows += [(5000 + k, " ".join(["w"] * int(sizes[f"s{k}"] * share)), f"s{k}") for k, share in enumerate((0.05, 0.2, 0.5, 0.8, 0.05, 0.2, 0.5, 0.8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    source, taken, target = {d: s for d, _, s in rows}, collections.Counter(), {}
    got = mixing.mix(docs).collect()
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert len(target) == 8 and all(abs(taken[s] - t) <= 10 for s, t in target.items()), [(s, t, taken[s]) for s, t in target.items()]
    assert collections.Counter(r["doc_id"] for r in mixing.take_mix(docs).collect()) == +collections.Counter({r["doc_id"]: r["repeats"] for r in got})


def test_take_mix_repeats_rows(small_docs):
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(small_docs).collect()}
    mixed = mixing.take_mix(small_docs)
    assert mixed.columns == small_docs.columns
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert got == +collections.Counter(plan)


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2


def test_hash_of_normalised_text(spark):
    docs = spark.createDataFrame([("ÀB", ), (None, )], "text string")
    got = [r[0] for r in docs.select(F.sha2(exact_dedup.normalised(F.col("text")), 256)).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in ("Àb", "")]
