"""Cross-tokenizer alignment, each distinct text once.

Two tokenizers cut the bytes of blank + text: A, a byte-level file of the tokenizers library, and B, a
sentencepiece model (which adds that blank itself).  Offsets where tokens of both end cut the tokens
into groups; all A-B pairs of one group are links.  An id pair counts in how many documents it is linked.

1. Documents are grouped by their full text (copies meet in the map-side aggregate already), so each
   distinct text is tokenised and aligned once, with its multiplicity.  The distinct texts are written
   in blocks of about ``BLOCK_BYTES``.
2. Every block gives its distinct linked pairs with the summed multiplicity of the texts that hold them;
   corpus counts are sums of these, and the best count of every A id their maximum.
3. The counts go back to the blocks that hold the pair (a pair in very many blocks is split by its
   count), and each block's texts are measured against them.
4. The measures are joined to the documents by the SHA-256 of the text, hot texts split by their count.

Inside a task, texts are cut before blanks that follow no white space.  There A's pattern splits and no
piece of B continues (checked when the model is loaded; else texts stay whole), so every such segment is
tokenised by the libraries and aligned once and then taken from a cache of bounded size.

Cases: a null or empty text, or one that either tokenizer does not give back byte by byte (such as one
with U+2581), has no tokens: zeros and an empty digest, and counts nowhere.  Special tokens' strings are
plain text.  Every row counts as a document, also with a null or repeated id; equal rows get equal
results.  A null id is passed on.  Columns besides id and text are ignored, whatever their names.  An
empty table gives an empty table.  Ids up to 2**24 are supported.
"""

from __future__ import annotations

import hashlib
import json
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import enter, once, salted_join, stage_table
from tenderlake.llm.textarrays import PieceCache, Pool, chunks, spans, text_bytes

BLOCK_BYTES = 16 << 20
ID_BITS = 24                     # a pair is a << 24 | b
TEXT_ROWS = 1 << 16              # texts in one step: text << 48 | pair fits 64 bits
SEGMENT_SLOTS = 20               # log2 of the slots of a worker's cache
COMMA, BAR, SEMICOLON = 0, 1, 2


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class TokenizerA:
    """A byte-level tokenizer file: ids of pieces, and the bytes of each id."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            before = json.load(f).get("pre_tokenizer") or {}
        # only this splitter is known to cut before a blank that follows no white space
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)

    def encode(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids


class TokenizerB:
    """A sentencepiece model: ids of pieces of text that begin with a blank, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        self.cuts = True
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace("▁", " ").encode())
            self.cuts &= "▁" not in piece.lstrip("▁")
        self.lead = self.sp.encode("x")
        probe = ["a b", "  a  b ", "x é\n c"]
        self.cuts &= all(self.sp.encode("x " + t) == self.lead + self.sp.encode(t) for t in probe)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a blank, as if more stood before it."""
        return self.sp.encode("x" + text)[len(self.lead):]     # after a letter, so that no blank is added or dropped

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text whose first blank is the one that the model adds itself."""
        return self.sp.encode(text[1:])


def _white_before(buf: np.ndarray) -> np.ndarray:
    """May the character that ends at each byte be white space?  (Some others too; it only makes segments longer.)"""
    one = np.append(np.zeros(2, np.uint8), buf)                # one[i + 2] is byte i
    x, y, z = one[2:], one[1:-1], one[:-2]
    wide = ((z == 0xE1) & (((y == 0x9A) & (x == 0x80)) | ((y == 0xA0) & (x == 0x8E)))) | ((z == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((z == 0xE3) & (y == 0x80))
    return (x <= 0x20) | (x == 0x7F) | ((y == 0xC2) & (x <= 0xA0)) | wide


class TokenBytes:
    """The bytes of each id in one array."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def get(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans(self.first[ids], self.size[ids])]


class Aligner(PieceCache):
    """Segments with their links (pairs), token and group counts, and the tokens in the order in which groups show them."""

    def __init__(self, path_a: str, path_b: str, slots_log2: int = SEGMENT_SLOTS):
        self.a, self.b = TokenizerA(path_a), TokenizerB(path_b)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << ID_BITS:
            raise ValueError("ids beyond 2**24")
        self.cuts = self.a.cuts and self.b.cuts
        self.tokens = [TokenBytes(t.bytes) for t in (self.a, self.b)]
        super().__init__(slots_log2)

    def clear(self) -> None:
        super().clear()
        self.made = Pool(np.int64)
        self.facts = Pool(np.int32)                            # n_a, n_b, n_groups, valid
        self.shown = Pool(np.uint32)                           # id << 2 | the sign after it

    def _alone(self, text: str, raw: bytes) -> list[np.ndarray] | None:
        """Ids of one text, or none if a tokenizer does not give it back."""
        got = [np.array(ids, np.int64) for ids in (self.a.encode(text), self.b.encode(text) if self.cuts else self.b.encode_whole(text))]
        return got if all(t.get(ids).tobytes() == raw for t, ids in zip(self.tokens, got)) else None

    def _together(self, texts: list[str], raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For A and B: ids of all segments and tokens of each, from one text that holds them one after the other."""
        joined, want = "".join(texts), np.frombuffer(b"".join(raw), np.uint8)
        edge = np.cumsum([len(r) for r in raw])
        out = []
        for tok, lib in zip(self.tokens, (self.a, self.b)):
            ids = np.array(lib.encode(joined), np.int64)
            ends = np.cumsum(tok.size[ids])
            at = np.searchsorted(ends, edge)
            if not len(ids) or ends[-1] != len(want) or (ends[np.minimum(at, len(ends) - 1)] != edge).any() or (tok.get(ids) != want).any():
                return None
            out.append((ids, np.diff(np.append(0, at + 1))))
        return out

    def _encode(self, pieces: list[bytes]):
        """For A and B: ids of all pieces and tokens of each; and which pieces both give back byte by byte."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        # segments that end in white space, or with marks that a library may change, go alone
        plain = self.cuts and np.array([not t[-1].isspace() and "\u2581" not in t for t in texts], bool)
        some = np.flatnonzero(plain) if self.cuts else np.zeros(0, np.int64)
        got = self._together([texts[k] for k in some.tolist()], [pieces[k] for k in some.tolist()]) if len(some) else None
        if got is None:
            some = np.zeros(0, np.int64)
        good = np.ones(len(texts), bool)
        count = np.zeros((2, len(texts)), np.int64)
        rest = np.setdiff1d(np.arange(len(texts)), some)
        lone = {}
        for k in rest.tolist():
            ids = self._alone(texts[k], pieces[k])
            good[k] = ids is not None
            if ids is not None:
                lone[k] = ids
                count[:, k] = [len(x) for x in ids]
        ids = []
        for which in (0, 1):
            if got is not None:
                count[which][some] = got[which][1]
            to = np.cumsum(count[which])
            out = np.empty(int(to[-1]) if len(to) else 0, np.int64)
            if got is not None:
                out[spans((to - count[which])[some], count[which][some])] = got[which][0]
            for k, x in lone.items():
                out[to[k] - len(x[which]):to[k]] = x[which]
            ids.append(out)
        return ids, count, good

    def make(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, count, good = self._encode(pieces)
        # ends as offsets into all texts one after the other, so that texts never share one
        ends = [np.cumsum(t.size[i]) for t, i in zip(self.tokens, ids)]
        at = np.searchsorted(ends[1], ends[0])
        cut = ends[0][at < len(ends[1])]
        cut = cut[ends[1][at[at < len(ends[1])]] == cut]
        cut = cut[np.append(True, cut[1:] != cut[:-1])[:len(cut)]]     # tokens without bytes share their end
        group = [np.searchsorted(cut, e) for e in ends]
        size = [np.bincount(g, minlength=len(cut)) for g in group]
        first_b = np.cumsum(size[1]) - size[1]
        many = size[1][group[0]]                               # links of each A token
        pair = (np.repeat(ids[0], many) << ID_BITS) | ids[1][spans(first_b[group[0]], many)]
        of_token = np.repeat(np.arange(len(pieces)), count[0])
        links = np.bincount(np.repeat(of_token, many), minlength=len(pieces))
        first_a = np.append(0, np.cumsum(count[0]))
        last = np.append(-1, group[0])                         # groups up to a text's last token
        n_groups = np.where(count[0] > 0, last[first_a[1:]] - last[first_a[:-1]], 0)
        self.facts.add(np.stack([*count, n_groups, good.astype(np.int64)], axis=1).astype(np.int32).ravel(), np.full(len(pieces), 4))
        # A's tokens of a group, then B's; a comma after each, a bar after A's last and a semicolon after B's last
        sign = [np.where(np.append(g[1:] != g[:-1], True)[:len(g)], s, COMMA) for g, s in zip(group, (BAR, SEMICOLON))]
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        self.shown.add((np.concatenate(ids) << 2 | np.concatenate(sign))[order].astype(np.uint32), count.sum(axis=0))
        return pair, links

    def segments(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The cache entries of all segments of the texts, and the first segment of each text (one more than texts)."""
        buf, off = text_bytes(column)
        texts = len(off) - 1
        buf = np.insert(buf, off[:-1], 0x20)
        off = off + np.arange(texts + 1)
        opens = np.zeros(len(buf), bool)
        if self.cuts:
            opens[1:] = (buf[1:] == 0x20) & ~_white_before(buf)[:-1]
        opens[off[:-1]] = True
        start = np.flatnonzero(opens)
        entry = self.entry(buf, start, np.append(start[1:], len(buf)), self.make)
        return entry, np.searchsorted(start, off)

    def align(self, column: pa.Array) -> "Aligned":
        entry, first = self.segments(column)
        facts = self.facts.data[(entry.astype(np.int64) << 2)[:, None] + np.arange(4)]
        total = np.zeros((len(entry) + 1, 3), np.int64)
        np.cumsum(facts[:, :3], axis=0, out=total[1:])
        bad = np.append(0, np.cumsum(facts[:, 3] == 0))
        valid = (bad[first[1:]] == bad[first[:-1]]) & (np.diff(first) > 0)
        links = self.made.size(entry)
        keep = np.repeat(valid, np.diff(first))
        text = np.repeat(np.arange(len(valid)), np.diff(first))[keep]
        counts = np.where(valid[:, None], total[first[1:]] - total[first[:-1]], 0)
        return Aligned(counts, valid, self.made.get(entry[keep]), np.repeat(text, links[keep]), self.shown, entry[keep])


class Aligned:
    """Texts of a chunk: ``counts`` (n_a, n_b, n_groups of each), ``valid``, all link pairs and the text of each."""

    def __init__(self, counts, valid, pair, text, shown, entry):
        self.counts, self.valid, self.pair, self.text = counts, valid, pair, text
        self.shown, self.entry = shown, entry

    def digests(self) -> list[str]:
        """SHA-256 of the groups in decimal, by text; empty for texts without tokens."""
        token = self.shown.get(self.entry)
        number = token >> np.uint32(2)
        width = len(str(int(number.max(initial=0))))
        digits = np.empty((len(token), width + 1), np.uint8)
        left = number
        for k in range(width - 1, -1, -1):
            left, digits[:, k] = left // np.uint32(10), 48 + left % np.uint32(10)
        digits[:, width] = np.array([44, 124, 59], np.uint8)[token & np.uint32(3)]
        many = 1 + sum((number >= np.uint32(10 ** k)).astype(np.int64) for k in range(1, width))
        flat = digits[np.arange(width + 1)[None, :] >= (width - many)[:, None]].tobytes()
        upto = np.append(0, np.cumsum(many + 1))
        to = upto[np.cumsum(self.counts[:, 0] + self.counts[:, 1])].tolist()
        return [hashlib.sha256(flat[a:max(a, b - 1)]).hexdigest() if ok else "" for a, b, ok in zip([0, *to], to, self.valid.tolist())]


def _aligner(path_a: str, path_b: str) -> Aligner:
    return once(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in chunks(batch, "_text"):
        for lo in range(0, part.num_rows, TEXT_ROWS):
            yield part.slice(lo, TEXT_ROWS)


def distinct_texts(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_block, _key, _n, _text``: every distinct text once, its SHA-256, multiplicity and block, written."""
    texts = (docs.select(F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull() & (F.col("_text") != ""))
             .groupBy("_text").agg(F.count("*").alias("_n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            off = text_bytes(batch.column("_text"))[1]
            upto = held + off[1:]
            held = int(upto[-1]) if len(upto) else held
            yield pa.record_batch([pa.array(base + upto // block_bytes), batch.column("_n"), batch.column("_text")], names=["_block", "_n", "_text"])

    blocks = texts.mapInArrow(run, "_block bigint, _n bigint, _text string")
    return stage_table(blocks.select("_block", _key(F.col("_text")).alias("_key"), "_n", "_text"), "align-texts")


def _key(text):
    return F.unhex(F.sha2(text, 256))


def block_pairs(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``block, pair, n``: the distinct linked pairs of each block, ``n`` documents of it hold the pair.

    A block that two tasks read gives two rows a pair; both count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("align")
        aligner = _aligner(path_a, path_b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block = None

        def merge() -> None:
            pair, n = (np.concatenate(x) for x in zip(*held))
            distinct, at = np.unique(pair, return_inverse=True)
            held[:] = [(distinct, np.bincount(at, n, len(distinct)).astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                merge()
                (pair, n), = held
                held.clear()
                yield pa.record_batch([pa.array(np.full(len(pair), block, np.int64)), pa.array(pair), pa.array(n)], names=["block", "pair", "n"])

        for batch in batches:
            for part in _steps(batch):
                blocks, n = part.column("_block").to_numpy(), part.column("_n").to_numpy()
                got = aligner.align(part.column("_text"))
                once_each = np.unique((got.text.astype(np.uint64) << np.uint64(2 * ID_BITS)) | got.pair.astype(np.uint64))
                text = (once_each >> np.uint64(2 * ID_BITS)).astype(np.int64)
                pair = (once_each & np.uint64((1 << 2 * ID_BITS) - 1)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)]):
                    if blocks[lo] != block:
                        yield from flush()
                        block = int(blocks[lo])
                    some = slice(*np.searchsorted(text, [lo, hi]).tolist())
                    held.append((pair[some], n[text[some]]))
                    if sum(len(p) for p, _ in held[1:]) > 2_000_000:
                        merge()
        yield from flush()

    return texts.select("_block", "_n", "_text").mapInArrow(run, "block bigint, pair bigint, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold each pair, and whether no pair of its A id has more."""
    counts = stage_table(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    a = F.shiftright("pair", ID_BITS).alias("_a")
    most = counts.groupBy(a).agg(F.max("count").alias("_most"))
    return (counts.withColumn("_a", a).join(most, "_a").select("pair", "count", (F.col("count") == F.col("_most")).alias("best")))


_MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
MEASURES = [m.split()[0] for m in _MEASURES.split(", ")]


def measure_blocks(texts: DataFrame, counted: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``_key`` and the measures of every distinct text; ``counted``: ``block, pair, count, best``."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = counted.select(F.col("block").alias("_block"), "pair", "count", "best", none("binary", "_key"), none("string", "_text")).unionByName(
        texts.select("_block", none("bigint", "pair"), none("bigint", "count"), none("boolean", "best"), "_key", "_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("align")
        aligner = _aligner(path_a, path_b)
        block, held, table = None, [], None                    # a block's counts come before its texts

        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            is_text = ~np.asarray(batch.column("_key").is_null().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (is_text[1:] != is_text[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)]):
                if hi == lo:
                    continue
                if blocks[lo] != block:
                    block, held, table = blocks[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not is_text[lo]:
                    held.append((part.column("pair").to_numpy(), part.column("count").to_numpy(), part.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if table is None:
                    pair, count, best = (np.concatenate(x) for x in zip(*held)) if held else [np.zeros(0, np.int64)] * 3
                    order = np.argsort(pair, kind="stable")
                    table, held = (pair[order], count[order], best[order].astype(bool)), []
                for some in _steps(part.select(["_key", "_text"])):
                    got = aligner.align(some.column("_text"))
                    at = np.searchsorted(table[0], got.pair)
                    rows_ = len(got.valid)
                    measures = [*got.counts.T, np.bincount(got.text, minlength=rows_), np.bincount(got.text[table[2][at]], minlength=rows_),
                                _sums(got.text, table[1][at], rows_)]
                    yield pa.record_batch([some.column("_key"), *[pa.array(m.astype(np.int64)) for m in measures], pa.array(got.digests(), pa.string())],
                                          names=["_key", *MEASURES])

    return (rows.repartition("_block").sortWithinPartitions("_block", F.col("_key").isNotNull())
            .mapInArrow(run, f"_key binary, {_MEASURES}"))


def _sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums; ``group`` ascends."""
    total = np.append(0, np.cumsum(value, dtype=np.int64))
    edge = np.searchsorted(group, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    texts = distinct_texts(docs, text_col, block_bytes)
    pairs = stage_table(block_pairs(texts, path_a, path_b), "align-pairs")
    counted = salted_join(pairs.select("block", "pair"), pair_counts(pairs), ["pair"], F.col("block"), over=20_000)
    measured = stage_table(measure_blocks(texts, counted, path_a, path_b), "align-measures")
    zero = [F.lit("") if m == MEASURES[-1] else F.lit(0).cast("bigint") for m in MEASURES]
    bare = F.col(text_col).isNull() | (F.col(text_col) == "")
    rows = docs.filter(~bare).select(F.col(id_col), _key(F.col(text_col)).alias("_key"))
    joined = salted_join(rows, measured, ["_key"], F.col(id_col), counted=texts.select("_key", "_n"), weight="_n").select(id_col, *MEASURES)
    return joined.unionByName(docs.filter(bare).select(id_col, *[z.alias(m) for z, m in zip(zero, MEASURES)]))
