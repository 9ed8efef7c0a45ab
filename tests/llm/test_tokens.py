import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tenderlake.llm import byte_bpe, repair_shards, textarrays
from tenderlake.llm.queries import BYTE_BPE_RANKS, LLM_QUERIES, WORD_BPE, tokenizer_path
from tenderlake.llm.textarrays import PieceCache, text_bytes

RANKS = tokenizer_path(BYTE_BPE_RANKS)
PIECES = ["a", "B", "s", "t", "re", "'", " ", "  ", "\n", "\t", "1", "٣", "é", "É", "中", "!", "?", "'s", "'ll", "'ve", "'d", " ", "　", "x" * 70,
          "<|endoftext|>", "😀", "́", "D", "\x1c", "\x85", "\x00", "᠎", "​", "가", "ᄀ", "ᅡ", "İ", "ß", "ÑA", "ij", ",", ".", "×", "Σ"]


def _texts(n=4000, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randint(0, 30))) for _ in range(n)] + ["", " ", "\n", " \n", " a", "a" * 5000, "'" * 301, " " * 400 + "x"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_public_library(reference):
    texts = _texts()
    ranks = byte_bpe.Ranks(RANKS)
    for text, (ids, counts) in zip(texts, ranks.encode(*text_bytes(pa.array(texts)))):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert byte_bpe.decode_ids(ranks, ids) == text.encode() and counts.sum() == len(ids)
        assert b"".join(byte_bpe.decode_slice(ranks, ids, counts, k) for k in range(min(3, len(counts)))) == \
            byte_bpe.decode_ids(ranks, ids[:counts[:3].sum()])


def test_scan_is_associative():
    element, times, apply, n, _ = byte_bpe._monoid()
    r = np.random.default_rng(0)
    elements = element[r.integers(0, len(element), 5000)]
    got = byte_bpe.scan(elements, times, n, block=16)
    state = 3
    for e, g in zip(elements, got):
        state = int(apply[int(e) * 8 + state])
        assert state == apply[int(g) * 8 + 3]


def test_heap_and_matrix_merges_agree():
    ranks = byte_bpe.Ranks(RANKS)
    words = [w.encode() for w in ("internationalisation", "aaaaaaaaaaaaaaa", "über", "tionheinthe")]
    ids, size = ranks.make(words)
    assert [list(x) for x in np.split(ids, np.cumsum(size)[:-1])] == [ranks.merge_long(w) for w in words]


def test_piece_cache_starts_anew_when_full():
    cache = PieceCache(slots_log2=6)
    make = lambda pieces: (np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32), np.array(list(map(len, pieces))))
    r = random.Random(1)
    for _ in range(50):
        words = [bytes(r.choices(b"abc", k=r.randint(1, 4))) for _ in range(30)]
        raw = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        ids, size = cache.ids(raw, end - [len(w) for w in words], end, make)
        assert ids.tolist() == list(b"".join(words)) and size.tolist() == [len(w) for w in words]


def _bpe_rows(rows, reference):
    out = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_op3_query_and_edge_cases(spark, small_rows, edge, edge_rows, nothing, reference):
    got = LLM_QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == _bpe_rows(small_rows, reference)
    got = byte_bpe.encode(edge, RANKS, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == _bpe_rows([r[:2] for r in edge_rows], reference)
    plain = byte_bpe.decode(byte_bpe.encode(edge, RANKS, keep=("key",)), RANKS, keep=("key",))
    assert sorted(bytes(r["decoded"]) for r in plain.collect()) == sorted((r[1] or "").encode() for r in edge_rows)
    assert byte_bpe.encode(nothing, RANKS).count() == 0


def test_word_encoder_equals_the_public_library():
    enc = repair_shards.WordEncoder(tokenizer_path(WORD_BPE))
    texts = _texts(seed=5) + [None, "Étude, Straße. word, don't. a.b ÀÀ."]
    want = Tokenizer.from_file(tokenizer_path(WORD_BPE)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert enc.plain
    for t, ids, e in zip(texts, enc.encode(pa.array(texts)), want):
        assert ids.tolist() == e.ids, t


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(2)
    phrases = [r.integers(0, 90, 12) for _ in range(20)]
    docs = [np.concatenate([*[phrases[k] for k in r.integers(0, 20, n)], r.integers(0, 90, 5), [1]]).astype(np.uint32) for n in r.integers(0, 40, 60)]
    docs[7] = np.array([1, 1, 1, 1], np.uint32)               # closing ids inside a text
    docs[8] = np.append(np.full(500, 4), 1).astype(np.uint32)
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs]) - 1
    got = repair_shards.compress(ids, ends)
    assert len(got["sequence"]) < 0.5 * len(ids) and len(got["rules"])
    grammar = repair_shards.Grammar({k: v.tobytes() for k, v in got.items()})
    assert (grammar.expand(grammar.sequence) == ids).all() and len(grammar.ends) == len(docs)
    for k, d in enumerate(docs):
        for a, b in ((0, None), (1, 3), (len(d) // 2, len(d) // 2 + 7), (len(d), len(d) + 5)):
            assert grammar.read_tokens(k, a, b).tolist() == d[a:b].tolist()


def _repair_rows(rows):
    tok, out, at = Tokenizer.from_file(tokenizer_path(WORD_BPE)), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op2_query_and_edge_cases(spark, small_rows, edge, edge_rows, nothing, tmp_path, monkeypatch):
    got = LLM_QUERIES["op2_repair_shards"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == _repair_rows(small_rows)
    monkeypatch.setattr(repair_shards, "SHARD_TOKENS", 500)   # several shards a task
    for name, frame, rows in (("edge", edge, edge_rows), ("none", nothing, [])):
        repair_shards.write_shards(frame, tokenizer_path(WORD_BPE), str(tmp_path / name))
        got = repair_shards.read_documents(spark, str(tmp_path / name)).drop("ids").collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == _repair_rows([r[:2] for r in rows])


@pytest.mark.parametrize("top", [100_000, 1 << 31])
def test_repair_of_a_large_alphabet(top):
    """More distinct ids than 16 bits hold: symbols take 32 bits, rules and random access work as before."""
    r = np.random.default_rng(3)
    phrase = r.integers(top - 500, top, 9)
    plain = r.permutation(90_000) * (top // 90_000)
    docs = [np.concatenate([part, *[phrase] * 40, [1]]).astype(np.uint32) for part in np.array_split(plain, 30)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs]) - 1
    got = repair_shards.compress(ids, ends)
    assert len(got["alphabet"]) > 65536 and got["sequence"].dtype == np.uint32 and len(got["rules"]) and len(got["sequence"]) < len(ids) - 8000
    grammar = repair_shards.Grammar({k: v.tobytes() for k, v in got.items()})
    assert (grammar.expand(grammar.sequence) == ids).all()
    assert grammar.read_tokens(4, 2990, 3100).tolist() == docs[4][2990:3100].tolist()


def _parity_words():
    """Two words with equal values under every polynomial hash in an odd base modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_share_a_polynomial_hash(spark):
    """op2 and op3 give such words, and documents that hold them, the ids and bytes of their own."""
    t, u = _parity_words()
    tail = " ".join(f"w{i}" for i in range(49))
    rows = list(enumerate([t, u, f"{t} {tail}", f"{u} {tail}"], 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = tokenizer_path(BYTE_BPE_RANKS)
    got = byte_bpe.encode(docs, path, digests=True).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in rows}
    enc = repair_shards.WordEncoder(tokenizer_path(WORD_BPE))
    tok = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    assert [x.tolist() for x in enc.encode(pa.array([x for _, x in rows]))] == [tok.encode(x, add_special_tokens=False).ids for _, x in rows]


def test_cache_compares_bytes(monkeypatch):
    """Even if all pieces shared one hash, each gets its own ids."""
    monkeypatch.setattr(textarrays, "block_hashes", lambda b: np.full(len(b.size), 7, np.uint64))
    cache = textarrays.PieceCache(slots_log2=8)
    make = lambda some: (np.array([x[0] for x in some], np.uint32), np.ones(len(some), np.int64))
    for _ in range(2):
        column = pa.array(["a bb a cccccccccc", "b a cccccccccd d"])
        w = textarrays.split_words(column, hashes=False)
        ids, size = cache.ids(w.buf, w.start, w.end, make)
        assert bytes(ids.tolist()) == b"abacbacd" and (size == 1).all()
