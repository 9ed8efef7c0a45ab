import collections
import itertools
import random
import re
import zlib

import pytest

from tenderlake.llm import spelling
from tenderlake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _count(rows, slip=199, min_length=6, min_count=5):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % slip == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _brute(n, ratio=5):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and _one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n}


def _rows(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op13_query(spark, small_rows):
    got = _rows(LLM_QUERIES["op13_spelling_variants"](spark, SF))
    assert got == _brute(_count(small_rows)) and any(f for _, f, *_ in got)


def test_edge_cases(edge, edge_rows, nothing):
    assert _rows(spelling.variants(edge, min_count=1)) == _brute(_count([r[:2] for r in edge_rows], min_count=1))
    assert spelling.variants(nothing).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdeé×", "abcdefghijklmnop"])
def test_close_words_of_few_letters(spark, letters):
    """Words at the ends of each other, repeated bigrams, chains of forms, ties."""
    r = random.Random(len(letters))
    words = {"".join(r.choices(letters, k=r.randint(6, 9))) for _ in range(160)}
    for w in list(words):
        k = r.randint(0, len(w) - 1)
        words |= {w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1:], r.choice(letters) + w, w + r.choice(letters)}
    rows = [(i, " ".join([w] * r.choice([1, 1, 2, 5, 6, 25, 30, 125]))) for i, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _rows(spelling.variants(docs, min_count=1)) == _brute(_count(rows, min_count=1))


def test_pivots_are_the_rarest_disjoint_grams_of_the_prefix():
    r = random.Random(3)
    for _ in range(300):
        word = "".join(r.choices("abcd", k=r.randint(6, 12)))
        grams = sorted({word[i:i + 2] for i in range(len(word) - 1)}, key=lambda g: (r.random(), g))
        order = {g: (k, k * k + r.randint(0, k)) for k, g in enumerate(grams)}
        places = spelling.prefix_places(word, order)
        assert len(places) >= 3 and max(order[word[i:i + 2]][0] for i in places) <= min([order[word[i:i + 2]][0] for i in range(len(word) - 1) if i not in places], default=999)
        a, b = spelling.pivots(word, places, order)
        cost = lambda p: sum(order[word[i:i + 2]][1] for i in p)
        assert b - a >= 2 and cost((a, b)) == min(cost(p) for p in itertools.combinations(places, 2) if p[1] - p[0] >= 2)


def test_slips(spark):
    """One run in ``slip`` loses the code point that its hash names."""
    rows = [(d, "Colour Étagères colour") for d in range(2000)]
    got = {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1).collect()}
    assert got == _count(rows, min_count=1) and len(got) > 6
