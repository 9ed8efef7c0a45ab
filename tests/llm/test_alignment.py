import bisect
import collections
import hashlib
import json
import random

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tenderlake.llm import token_alignment
from tenderlake.llm.queries import BYTE_BPE_JSON, LLM_QUERIES, PIECE_BPE, tokenizer_path

A, B = tokenizer_path(BYTE_BPE_JSON), tokenizer_path(PIECE_BPE)
SF = "/root/testdata/sf0.001"


def _brute(rows):
    """Whole texts through the libraries, one after the other; groups and links by the definition."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(token_alignment.byte_letters())}
    texts = []
    for _, text in rows:
        groups = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
            pieces = [sp.id_to_piece(i) for i in b]
            bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends, cuts = [], []
                for tokens in (bytes_a, bytes_b):
                    at, mine = 0, []
                    for t in tokens:
                        at += len(t)
                        mine.append(at)
                    ends.append(mine)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cuts]
                for which, (ids, mine) in enumerate(((a, ends[0]), (b, ends[1]))):
                    for i, e in zip(ids, mine):
                        groups[bisect.bisect_left(cuts, e)][which].append(i)
        texts.append(groups)
    count = collections.Counter()
    for groups in texts:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (i, _), groups in zip(rows, texts):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return collections.Counter(out)


def test_op12_query(spark, small_rows):
    assert collections.Counter(map(tuple, LLM_QUERIES["op12_token_alignment"](spark, SF).collect())) == _brute(small_rows)


def test_edge_cases_and_copies(spark, edge, edge_rows, nothing):
    got = token_alignment.align(edge, A, B, block_bytes=2000)
    assert collections.Counter(map(tuple, got.collect())) == _brute([r[:2] for r in edge_rows])
    assert token_alignment.align(nothing, A, B).count() == 0


def test_odd_texts_in_small_blocks(spark, monkeypatch):
    """Random texts of many scripts and kinds of white space, with copies; blocks that texts share and that tasks cut."""
    r = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "​", "\x85", " ", "᠎", "é", "é", "中文", "😀", "▁", "'s", "<s>", "</s>", "<|endoftext|>", "<0x41>",
            "1", "٣", "don't", ".", ",", "“q”", "\x00", "\x1c", "ﬁ", "Straße", "﻿"]
    rows = [(k, "".join(r.choices(bits, k=r.randint(0, 14)))) for k in range(400)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(300)] + [(5000, "same"), (5000, "same"), (None, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _brute(rows)
    assert collections.Counter(map(tuple, token_alignment.align(docs, A, B, block_bytes=300).collect())) == want
    whole = token_alignment.Aligner(A, B)                      # without segments: texts go whole through the libraries
    assert whole.cuts
    whole.cuts = False
    some = whole.align(pa.array([t for _, t in rows if t]))
    cut = token_alignment.Aligner(A, B, slots_log2=10).align(pa.array([t for _, t in rows[:100] if t]))
    assert (cut.counts == some.counts[:len(cut.counts)]).all() and cut.digests() == some.digests()[:len(cut.counts)]


def test_byte_letters_are_those_of_the_file():
    with open(A, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    assert set(token_alignment.byte_letters()) <= set(vocab) and len(set(token_alignment.byte_letters())) == 256


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_counts_are_documents(spark, block):
    """Copies count each, repeats inside a text once."""
    rows = [(k, "word word other") for k in range(30)] + [(50, "word"), (51, "other thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, token_alignment.align(docs, A, B, block_bytes=block).collect())) == _brute(rows)
