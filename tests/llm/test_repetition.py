import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tenderlake.llm import repetition_rules as rules
from tenderlake.llm import textarrays
from tenderlake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def _method(words, least):
    """By the definition: repeats of any length, those that no word on either side extends, and the words they cover."""
    n, inside, longest, repeats = len(words), set(), 0, 0
    length = least
    while length <= n:
        places = collections.defaultdict(list)
        for i in range(n - length + 1):
            places[tuple(words[i:i + length])].append(i)
        some = [p for p in places.values() if len(p) > 1]
        if not some:
            break
        for p in some:
            longest = length
            inside.update(i + k for i in p for k in range(length))
            left = {words[i - 1] if i else None for i in p}
            right = {words[i + length] if i + length < n else None for i in p}
            ends = any(i + length == n for i in p)
            repeats += (len(left) > 1 or None in left) and (len(right) > 1 or ends)
        length += 1
    return len(inside), longest, repeats


def _want(text, least, covered, longest):
    base = _base(text)
    n = base[0]
    c, m, r = _method(WORD.findall(text or ""), least)
    return (*base, not base[-1] and c <= covered * n and m <= longest, c, m, r)


def _texts(r, n, vocabulary, upto):
    out = []
    for _ in range(n):
        words = r.choices(vocabulary, k=r.randint(0, upto))
        for _ in range(r.randint(0, 3)):
            if words:
                a = r.randint(0, len(words) - 1)
                part = words[a:a + r.randint(1, 30)]
                at = r.randint(0, len(words))
                words = words[:at] + part + words[at:]
        out.append("".join(w + r.choice([" ", " ", "\n", "\t"]) for w in words))
    return out


@pytest.mark.parametrize("letters, upto", [(2, 60), (6, 150), (80, 200)])
def test_measures_equal_the_definition(letters, upto):
    r = random.Random(letters)
    texts = [*_texts(r, 120, [f"w{k}é" for k in range(letters - 1)] + ["#"], upto), "", None, "a " * 200, "a b " * 100, "x", "\n\n", "p\np\n p\np"]
    got = rules.measure(pa.array(texts, pa.string()), least=4)
    for k, t in enumerate(texts):
        c, m, n = _method(WORD.findall(t or ""), 4)
        assert [int(got[x][k]) for x in rules.COUNTS] == [*_base(t)[:5], c, m, n], (k, t)


def test_suffix_array_equals_sorting():
    r = random.Random(8)
    docs = [r.choices(range(3), k=r.randint(0, 40)) for _ in range(60)] + [[1] * 50]
    first = np.cumsum([0, *map(len, docs)])
    got = rules.suffix_array(np.array([w for d in docs for w in d], np.int64), first)
    for d, words in enumerate(docs):
        lo = int(first[d])
        order = sorted(range(len(words)), key=lambda i: words[i:])
        assert (got.order[lo:first[d + 1]] - lo).tolist() == order
        for k, (i, j) in enumerate(zip(order, order[1:]), 1):
            same = 0
            while i + same < len(words) and j + same < len(words) and words[i + same] == words[j + same]:
                same += 1
            assert got.common[lo + k] == same
        assert not len(words) or got.common[lo] == 0


def test_op11_query(spark, small_rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in LLM_QUERIES["op11_repetition_rules"](spark, SF).collect()}
    assert got == {i: _want(t, rules.LEAST, rules.MAX_COVERED, rules.MAX_LONGEST)[:-2] for i, t in small_rows}


def test_clean_documents_stay(spark):
    """What the labels call good is rejected by the base rules only."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = LLM_QUERIES["op11_repetition_rules"](spark, "/root/testdata/sf0.01").collect()
    good = [r for r in rows if labels.get(r["doc_id"]) == 1]
    assert len(good) > 200 and all(r["kept"] or r["base_failed"] for r in good)


def test_verdict_and_edge_cases(spark, edge, edge_rows, nothing):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat", "n_repeats"]
    got = collections.Counter(tuple(r) for r in rules.judge(edge).select("doc_id", *columns).collect())
    assert got == collections.Counter((r[0], *_want(r[1], rules.LEAST, rules.MAX_COVERED, rules.MAX_LONGEST)) for r in edge_rows)
    assert rules.judge(nothing).count() == 0
    fresh = [f"u{k}" for k in range(1000)]
    rows = [(1, " ".join(fresh[:200])), (2, " ".join(fresh[:45] + fresh[100:130] + fresh[:45])), (3, " ".join(fresh[:45] + fresh[100:900] + fresh[:45])),
            (4, " ".join(fresh[:60] + fresh[100:900] + fresh[:60])), (5, " ".join(fresh[:30] + fresh[100:200] + fresh[:30] + fresh[300:350])),
            (6, " ".join(fresh[:13] + fresh[100:150] + fresh[:13]))]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3, 4, 5, 6)] == [True, False, True, False, False, True]
    assert got[2]["longest_repeat"] == 45 and got[2]["base_failed"] and not got[4]["base_failed"] and got[4]["longest_repeat"] == 60
    assert not got[5]["base_failed"] and got[5]["n_covered"] == 60 and got[6]["longest_repeat"] == 0
    assert rules.repeated_spans(rows[2][1]) == [(0, 45), (845, 890)]


def test_words_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(textarrays, "block_hashes", lambda b: (b.size % 3 + 1).astype(np.uint64))
    w = textarrays.split_words(pa.array(["a bb ccc dddd a eeee bb longerthaneight longerthaneighT"]), hashes=False)
    ids, n = textarrays.word_ids(w)
    assert len(set(ids.tolist())) == 7 and ids.max() < n and ids[0] == ids[4] and ids[1] == ids[6]
