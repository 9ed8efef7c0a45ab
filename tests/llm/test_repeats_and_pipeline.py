import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tenderlake.llm import components, exact_dedup, jaccard_join, mixing, quality_nbsvm, substring_dedup
from tenderlake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_substrings(rows):
    least = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k:k + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49 if i is not None else 0):
            if least[tuple(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def _sha(rows):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows)


def test_op4_query_and_edge_cases(spark, small_rows, edge, edge_rows, nothing):
    got = collections.Counter(map(tuple, LLM_QUERIES["op4_substring_dedup"](spark, SF).collect()))
    assert got == brute_substrings(small_rows)
    assert _sha(substring_dedup.remove_repeats(edge).collect()) == brute_substrings([r[:2] for r in edge_rows])
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("group", [1, 3, 2000])
def test_passages_shared_by_many(spark, group):
    r = random.Random(9)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for d in range(60):
        own = [f"d{d}w{r.randint(0, 30)}" for _ in range(r.randint(0, 90))]
        cut = r.randint(0, 25)
        at = r.randint(0, len(own))
        rows.append((d, " ".join(own[:at] + (passage[cut:] if d % 3 else []) + own[at:])))
    rows += [(70, " ".join(["same"] * 400)), (71, " ".join(["same"] * 120)), (72, "x " + " ".join(["same"] * 49))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _sha(substring_dedup.remove_repeats(frame, group=group).collect()) == brute_substrings(rows)


def shingles(t):
    w = words((t or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * 100 >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def _near(n=90, seed=11):
    """Near copies around the threshold, a common passage, chains."""
    r = random.Random(seed)
    base = [[f"b{b}w{k}" for k in range(60 + 20 * b)] for b in range(4)]
    common = [f"c{k}" for k in range(30)]
    rows = []
    for d in range(n):
        w = list(base[d % 4])
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"e{d}x{r.randint(0, 99)}"
        if d % 5 == 0:
            w = [f"u{d}w{k}" for k in range(r.randint(3, 40))]
        rows.append((1000 - d, " ".join(w + (common if d % 3 == 0 else []))))
    return rows + [(5000, rows[3][1].upper()), (1, "a b"), (2, "A  b"), (3, "a b c"), (4, None), (6, "")]


@pytest.mark.parametrize("short,block,frequent,minor", [(32, 4096, 100, 100), (2, 8, 4, 1000), (1, 3, 10 ** 6, 1000), (1, 3, 10 ** 6, 0)])
def test_classes_equal_brute_force(spark, monkeypatch, short, block, frequent, minor):
    monkeypatch.setattr(jaccard_join, "MINOR", minor)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = _near()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.linked_classes(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_classes(rows)


def test_rows_of_a_long_list_grow_with_its_length(spark, monkeypatch):
    """A list of one large class and a few others: every two entries of different classes meet once, in few rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    rows = [(7, k, 0 if k >= 5 else k + 1) for k in range(400)] + [(8, k, 3) for k in range(100)]
    tagged = spark.createDataFrame(rows, "token long, key long, tag long")
    lists = spark.createDataFrame([(7, 400), (8, 100)], "token long, entries long")
    got = jaccard_join._class_blocks(tagged, lists).collect()
    assert {r["token"] for r in got} == {7} and len(got) == 395 + 5 * 40 and jaccard_join._leader_blocks(tagged, lists).count() == 500
    groups = collections.defaultdict(list)
    for r in got:
        assert r["i"] == r["j"]
        groups[r["i"]].append(r)
    met = collections.Counter()
    for g, some in groups.items():
        for x in some:
            for y in some:
                if x["key"] < y["key"] and x["tag"] != y["tag"] and not (x["minor"] and y["minor"] and min(x["block"], y["block"]) != g):
                    met[(x["key"], y["key"])] += 1
    assert met == collections.Counter({(a, b): 1 for a in range(5) for b in range(a + 1, 400)})


def test_op9_query_and_edge_cases(spark, small_rows, edge, edge_rows, nothing):
    got = collections.Counter(map(tuple, LLM_QUERIES["op9_jaccard_join"](spark, SF).collect()))
    assert got == brute_classes(small_rows)
    got = jaccard_join.linked_classes(edge).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_classes([r[:2] for r in edge_rows])
    assert jaccard_join.linked_classes(nothing).count() == 0
    kept = jaccard_join.keep_one_of_each(edge)
    assert kept.columns == edge.columns and jaccard_join.keep_one_of_each(nothing).count() == 0


def _parity_words():
    """Two words with equal values under every polynomial hash in an odd base modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("group", [1, 2000])
def test_words_that_share_a_polynomial_hash(spark, group):
    t, u = _parity_words()
    tail = " ".join(f"w{i}" for i in range(49))
    rows = list(enumerate([t, u, f"{t} {tail}", f"{u} {tail}", f"{t} {tail}"], 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _sha(substring_dedup.remove_repeats(docs, group=group).collect()) == brute_substrings(rows)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_classes(docs).collect())
    assert got == brute_classes(rows)


def test_deep_nodes_equal_sorting():
    """Suffixes under a node of ``window`` words: those whose first words another suffix of their group shares."""
    r = random.Random(12)
    rows = [[f"x{r.randint(0, 2)}" for _ in range(r.randint(0, 30))] for _ in range(40)]
    group = np.sort(np.array([r.randint(0, 5) for _ in rows]))
    row, at, node = substring_dedup.deep_nodes(pa.array([" ".join(x).encode() for x in rows], pa.binary()), group, 6)
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for a, b, n in zip(row.tolist(), at.tolist(), node.tolist()):
        got[n].add((a, b))
    for k, x in enumerate(rows):
        for i in range(len(x) - 5):
            want[(group[k], *x[i:i + 6])].add((k, i))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 1 << 62, n)).astype(np.uint64)
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.15], r.integers(0, 1 << 62, int(r.integers(0, 30))).astype(np.uint64)]))
        a, b = jaccard_join.parity(x), jaccard_join.parity(y)
        to = min(len(a), len(b)) * 8
        far = (jaccard_join._fold(int.from_bytes(a, "little"), len(a) * 8, to) ^ jaccard_join._fold(int.from_bytes(b, "little"), len(b) * 8, to)).bit_count()
        assert far <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200 + k, 200 + r.randint(0, k - 1)) for k in range(1, 50)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, **{k: 200 for k in range(200, 250)}}


def test_pipeline_equals_brute_force(spark, small_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    from tenderlake.sources.tables import read_table
    model = quality_nbsvm.train(small_docs, read_table(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality_nbsvm.score(small_docs, model).collect() if r["predicted"]}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in small_docs.collect() if r["doc_id"] in good]
    best = {}
    for i, t, _ in rows:
        k = (t or "").translate(LOWER)
        best[k] = max(best.get(k, i), i)
    rows = [r for r in rows if best[(r[1] or "").translate(LOWER)] == r[0]]
    rows = [r for r in rows if (r[0], len(shingles(r[1])), r[0]) in brute_classes([x[:2] for x in rows])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix(frame).collect()}
    want = collections.Counter({(i, s, hashlib.sha256((t or "").encode()).hexdigest()): repeats[i] for i, t, s in rows if repeats[i]})
    got = collections.Counter((r["doc_id"], r["source"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_the_columns(spark, edge):
    import tempfile
    labels = tempfile.mkdtemp()
    spark.createDataFrame([(k, k % 2, 0) for k in range(18)], "doc_id long, quality int, toxic int").write.parquet(f"{labels}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, labels).columns == edge.columns
        assert stage(spark, edge.limit(0), labels).count() == 0
    assert exact_dedup.drop_copies(edge).count() > 0
