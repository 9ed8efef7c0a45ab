"""Token ids in Re-Pair compressed shard files, with random access.

Write: documents are range-partitioned by id and sorted; each task encodes its documents and packs
them, in order, into shards of about ``SHARD_TOKENS`` ids (one longer document is a shard alone).
A shard is one row of a Parquet table: its grammar and its compressed sequence.

Re-Pair, per shard: count all adjacent pairs, make nonterminals of the most frequent ones, replace
them left to right without overlap, repeat on the shorter sequence until no pair is frequent or a
round no longer pays.  Pairs never span documents (each document's closing id is a symbol that does
not pair), so documents are found in the compressed sequence without decoding it.  Stored: the
alphabet, the rules (two symbols each; symbols take 16 bits, or 32 where a shard's alphabet is large), the expansion length of every symbol, the rules made per
round, the sequence.  ``read_tokens`` uses the lengths to decode any range of one document alone.

Encoding: the tokenizer's words never span white space, so each distinct white-space-free piece is
encoded once by the library and then taken from a cache of bounded size.

Cases: a null or empty text has only its closing id; documents with equal ids stay side by side in
text order; a null id sorts first; a closing id that also occurs inside a text is told apart by its
own symbol.  Other columns are ignored.  An empty table gives no files and an empty result.
"""

from __future__ import annotations

import re
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import enter, once
from tenderlake.llm.textarrays import PieceCache, chunks, split_words

SHARD_TOKENS = 1 << 21
NARROW = 3 << 14                 # an alphabet up to this size leaves room for rules in 16-bit symbols; larger ones take 32 bits
MAX_SYMBOLS = {2: 1 << 16, 4: 1 << 24}
RULES_PER_ROUND = 4096
MIN_COUNT = 8                    # a pair this frequent in its shard becomes a rule
MIN_GAIN = 0.02                  # a round that shortens the sequence by less is the last


_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([,.]?)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordEncoder:
    """A tokenizer file of the tokenizers library, with a cache of white-space-free pieces.

    New pieces of Latin letters (and one closing comma or stop), which the file's normaliser only
    lower-cases and its splitter leaves whole, go straight to the library's merge model; all others
    through the whole library.  ``plain`` says whether the file is of that kind.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.cache = PieceCache()
        self.letter = _byte_letters()
        probe = ["Hello", "\u00c9t\u00e9,", "\u00f1.", "don", "\u00dfx", "O"]
        self.plain = all(self._merge(p) == self.tok.encode(p, add_special_tokens=False).ids for p in probe)

    def _merge(self, piece: str) -> list[int]:
        sign = piece[-1] if piece[-1] in ",." else ""
        word = piece[:-1] if sign else piece
        out = []
        for part in (word, sign):
            if part:
                text = "".join([self.letter[b] for b in part.lower().encode()]) if not part.isascii() else part.lower()
                out += [t.id for t in self.tok.model.tokenize(text)]
        return out

    def make(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        out: list = [None] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if self.plain and _PLAIN.fullmatch(t):
                out[k] = self._merge(t)
            else:
                rest.append(k)
        for k, e in zip(rest, self.tok.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.uint32, int(size.sum())), size

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of every text."""
        words = split_words(column, hashes=False)
        ids, size = self.cache.ids(words.buf, words.start, words.end, self.make)
        to = np.append(0, np.cumsum(size))[words.first].tolist()
        return [ids[a:b] for a, b in zip(to, to[1:])]


def _encoder(path: str) -> WordEncoder:
    return once(("word-encoder", path), lambda: WordEncoder(path))


def _match(key: np.ndarray, rule_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys that are rules, and which; of rules that share a slot only the first takes part."""
    bits = 18
    wide = key.dtype == np.uint64
    factor, shift = (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)) if wide else (np.uint32(2654435761), np.uint32(32 - bits))
    slot_of = lambda k: (k * factor) >> shift
    slots = slot_of(rule_key)[::-1]
    held = np.zeros(1 << bits, key.dtype)                     # 0 is the key of no rule
    held[slots] = rule_key[::-1]
    which = np.zeros(1 << bits, np.int32)
    which[slots] = np.arange(len(rule_key), dtype=np.int32)[::-1]
    slot = slot_of(key)
    pos = np.flatnonzero(held[slot] == key)
    rule = which[slot[pos]]
    real = rule_key[rule] == key[pos]                         # key 0 meets empty slots
    return pos[real], rule[real]


def compress(ids: np.ndarray, ends: np.ndarray) -> dict:
    """Re-Pair of ``ids`` (uint32); ``ends``: positions of the closing ids."""
    is_end = np.zeros(len(ids), bool)
    is_end[ends] = True
    closing = ids[ends[0]] if len(ends) else 0
    if ids.max(initial=0) < 1 << 22:
        seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
        seen[ids[~is_end]] = True
        used = np.flatnonzero(seen)
        seq = np.cumsum(seen, dtype=np.uint32)[ids]
    else:
        used = np.unique(ids[~is_end])
        seq = (np.searchsorted(used, ids) + 1).astype(np.uint32)
    alphabet = np.append(closing, used).astype(np.uint32)
    seq[is_end] = 0                                           # symbol 0: a document's end
    rules, rounds = [], []
    n_symbols = len(alphabet)
    width = 2 if n_symbols <= NARROW else 4                   # bytes a symbol
    pair, half = (np.uint32, np.uint32(16)) if width == 2 else (np.uint64, np.uint64(32))
    low = pair((1 << int(half)) - 1)
    while n_symbols < MAX_SYMBOLS[width] and len(seq) > 1:
        key = (seq[:-1].astype(pair) << half) | seq[1:]
        runs = np.sort(key)
        at = np.flatnonzero(runs[1:] != runs[:-1]) + 1
        at = np.append(0, at)
        count = np.diff(np.append(at, len(runs)))
        often = np.flatnonzero(count >= MIN_COUNT)
        often = often[(runs[at[often]] > low) & (runs[at[often]] & low != 0)]   # not across documents
        room = min(RULES_PER_ROUND, MAX_SYMBOLS[width] - n_symbols)
        if len(often) > room:
            often = often[np.argpartition(-count[often], room)[:room]]
        often = often[np.argsort(-count[often], kind="stable")]
        rule_key = runs[at[often]]
        if not len(rule_key):
            break
        pos, rule = _match(key, rule_key)
        # of touching matches take every other one, left to right
        start = np.append(True, pos[1:] != pos[:-1] + 1)[:len(pos)]
        rank = np.arange(len(pos))
        take = (rank - np.maximum.accumulate(np.where(start, rank, 0))) % 2 == 0
        pos, rule = pos[take], rule[take]
        if len(pos) < MIN_GAIN * len(seq):
            break
        live = np.unique(rule)                                # rules that lost every match are not stored
        new = np.zeros(len(rule_key), np.uint32)
        new[live] = np.arange(n_symbols, n_symbols + len(live))
        rules.append(np.stack([rule_key[live] >> half, rule_key[live] & low], axis=1).astype(np.uint32))
        rounds.append(len(live))
        n_symbols += len(live)
        seq[pos] = new[rule]
        keep = np.ones(len(seq), bool)
        keep[pos + 1] = False
        seq = seq[keep]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    length = np.ones(n_symbols, np.uint32)
    base = len(alphabet)
    for size in rounds:
        part = table[base - len(alphabet):base - len(alphabet) + size]
        length[base:base + size] = length[part[:, 0]] + length[part[:, 1]]
        base += size
    kind = np.uint16 if width == 2 else np.uint32
    return {"alphabet": alphabet, "rules": table.astype(kind), "rounds": np.array(rounds, np.uint32),
            "lengths": length, "sequence": seq.astype(kind)}


class Grammar:
    """A stored grammar, ready to expand symbols."""

    def __init__(self, row: dict):
        self.alphabet = np.frombuffer(row["alphabet"], np.uint32)
        kind = np.uint16 if len(self.alphabet) <= NARROW else np.uint32
        rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
        self.length = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.offset = np.zeros(len(self.length), np.int64)
        n = len(self.alphabet)
        self.offset[:n] = np.arange(n)
        self.offset[n:] = n + np.cumsum(self.length[n:]) - self.length[n:]
        self.pool = np.zeros(int(n + self.length[n:].sum()), np.uint32)
        self.pool[:n] = self.alphabet
        base = n
        for size in np.frombuffer(row["rounds"], np.uint32).tolist():
            lo = int(self.offset[base]) if size else 0
            out = self.expand(rules[base - n:base - n + size].ravel())
            self.pool[lo:lo + len(out)] = out
            base += size
        self.sequence = np.frombuffer(row["sequence"], kind)
        self.ends = np.flatnonzero(self.sequence == 0)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.length[symbols]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        return self.pool[np.arange(total) + np.repeat(self.offset[symbols] - (to - size), size)]

    def read_tokens(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of the shard's document ``doc``; only the symbols that cover them are expanded."""
        lo = int(self.ends[doc - 1]) + 1 if doc else 0
        symbols = self.sequence[lo:int(self.ends[doc]) + 1]
        to = np.cumsum(self.length[symbols])
        stop = int(to[-1]) if stop is None else min(stop, int(to[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(to, start, "right")), int(np.searchsorted(to, stop))
        skip = int(to[a] - self.length[symbols[a]])
        return self.expand(symbols[a:b + 1])[start - skip:stop - skip]


_SHARD = ("part int, shard int, n_docs bigint, n_tokens bigint, doc_ids binary, alphabet binary, rules binary, "
          "rounds binary, lengths binary, sequence binary")


def write_shards(docs: DataFrame, tokenizer: str, out_path: str, closing_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode, compress and write all documents in ascending order of ``id_col`` (a bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enter("repair")
        part, enc, shard = TaskContext.get().partitionId(), _encoder(tokenizer), 0
        close = np.uint32(closing_id).tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def pack():
            ids = np.frombuffer(b"".join([b for _, b in held]), np.uint32)
            ends = np.cumsum([len(b) >> 2 for _, b in held]) - 1
            got = compress(ids, ends)
            who = pa.array([i for i, _ in held], pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
                w.write_batch(pa.record_batch([who], names=["id"]))
            names = ["part", "shard", "n_docs", "n_tokens", "doc_ids", "alphabet", "rules", "rounds", "lengths", "sequence"]
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(held)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                + [pa.array([got[k].tobytes()], pa.binary()) for k in names[5:]], names=names)

        for batch in batches:
            for piece in chunks(batch, text_col):
                for i, own in zip(piece.column(id_col).to_pylist(), enc.encode(piece.column(text_col))):
                    ids = own.tobytes() + close
                    if held and size + (len(ids) >> 2) > SHARD_TOKENS:
                        yield pack()
                        held, size, shard = [], 0, shard + 1
                    held.append((i, ids))
                    size += len(ids) >> 2
        if held:
            yield pack()

    (docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col))
     .repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
     .mapInArrow(run, _SHARD).write.parquet(out_path))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Decode the files: ``id_col, start, n_tokens, ids_crc32, ids`` a document (ids: uint32 bytes)."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                grammar = Grammar(got)
                who = pa.ipc.open_stream(got["doc_ids"]).read_all().column("id").combine_chunks()
                full = grammar.expand(grammar.sequence)
                to = np.cumsum(grammar.length[grammar.sequence])[grammar.ends]
                start = np.append(0, to[:-1])
                ids = [full[a:b].tobytes() for a, b in zip(start.tolist(), to.tolist())]
                n = len(ids)
                yield pa.record_batch(
                    [pa.array([got["part"]] * n, pa.int32()), pa.array([got["shard"]] * n, pa.int32()), who,
                     pa.array(start, pa.int64()), pa.array(to - start, pa.int64()),
                     pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["_part", "_shard", id_col, "_start", "n_tokens", "ids_crc32", "ids"])

    docs = shards.mapInArrow(run, f"_part int, _shard int, `{id_col}` bigint, _start bigint, n_tokens bigint, "
                                  "ids_crc32 bigint, ids binary")
    # Ids before each shard: sums by task (as many rows as tasks wrote), then within the task.
    sizes = shards.select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("_part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("_part", earlier(Window.orderBy("_part")).alias("_a"))
    inner = sizes.select("_part", "_shard", earlier(Window.partitionBy("_part").orderBy("_shard")).alias("_b"))
    before = inner.join(parts, "_part").select("_part", "_shard", (F.col("_a") + F.col("_b")).alias("_before"))
    return (docs.join(before, ["_part", "_shard"])
            .select(id_col, (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", "ids"))
