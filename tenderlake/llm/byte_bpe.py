"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation uses no regular expression.  The code points of a chunk of texts become an array
of classes (letter, number, blank, other white space, apostrophe, other) from one lookup table, and
with the classes of the next one to three code points an array of automaton symbols.  Each symbol
is a function from states to states; the functions form a finite monoid under composition, so
prefix compositions of whole blocks are found by an associative scan over one multiplication table
(all blocks advance together, block totals are scanned the same way).  Applied to the state at a
block's start they give the state before each code point, and with it every boundary.

The slices between boundaries feed a cache of bounded size (by 64-bit hash); slices not in it are merged together, all words of one
length class as rows of a matrix, one lowest-rank leftmost merge a row and step, as the public
library does.  Very long slices use a heap.  Slice offsets (in tokens and in bytes) are returned
with the ids, so any slice can be decoded alone.

The pattern that this reproduces (fixed value, public):
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Cases: a null or empty text has no tokens and decodes to the empty text.  Special-token strings in
a text are ordinary text.  A text of any length is one row; chunks of ``CHUNK_BYTES`` bound memory
for all others.  Rows are independent: repeated rows give equal results, other columns are ignored,
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenderlake.llm.common import enter, once
from tenderlake.llm.textarrays import PieceCache, chunks, text_bytes

CHUNK_BYTES = 1 << 20
HEAP_BYTES = 64                  # slices longer than this merge through a heap

# character classes
OTHER, LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, END = range(7)
# automaton symbols: classes refined by what follows
(S_OTHER, S_LETTER, S_NUMBER, S_SPACE_IN, S_BLANK_LAST, S_SPACE_LAST, S_SHORT, S_LONG, S_END) = range(9)
# states: what the open slice is
(Q_NONE, Q_LETTER, Q_NUMBER, Q_OTHER, Q_SPACE, Q_PREFIX, Q_ONE_MORE, Q_TWO_MORE) = range(8)


def _class_table() -> np.ndarray:
    import regex
    table = np.zeros(0x110000, np.uint8)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    where = np.array(every)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[where[m.start():m.end()]] = cls
    table[0x20], table[0x27] = BLANK, APOSTROPHE
    return table


def _automaton():
    """``step[symbol, state]`` and ``opens[symbol, state]``: next state; does a slice start here."""
    step = np.zeros((9, 8), np.uint8)
    opens = np.ones((9, 8), bool)
    for sym, run in ((S_LETTER, Q_LETTER), (S_NUMBER, Q_NUMBER), (S_OTHER, Q_OTHER)):
        step[sym] = run
        opens[sym, [run, Q_PREFIX]] = False
    for sym, left in ((S_SHORT, Q_ONE_MORE), (S_LONG, Q_TWO_MORE)):
        step[sym] = left
        step[sym, [Q_OTHER, Q_PREFIX]] = Q_OTHER
        opens[sym, [Q_OTHER, Q_PREFIX]] = False
    step[S_LETTER, Q_ONE_MORE], step[S_LETTER, Q_TWO_MORE] = Q_NONE, Q_ONE_MORE
    opens[S_LETTER, [Q_ONE_MORE, Q_TWO_MORE]] = False
    step[S_SPACE_IN] = Q_SPACE
    opens[S_SPACE_IN, Q_SPACE] = False
    step[S_BLANK_LAST], step[S_SPACE_LAST], step[S_END] = Q_PREFIX, Q_NONE, Q_NONE
    return step, opens


def _monoid():
    """Closure of the symbols' functions: ``element[symbol]``, ``times[a, b]`` (a first), ``apply[e, state]``."""
    step, opens = _automaton()
    found = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    for f in todo:
        for s in range(9):
            g = tuple(int(step[s][q]) for q in f)
            if g not in found:
                found[g] = len(found)
                todo.append(g)
    apply = np.array(list(found), np.uint8)
    element = np.array([found[tuple(map(int, step[s]))] for s in range(9)], np.uint16)
    n = len(found)
    times = np.zeros((n, n), np.uint16)
    for i, f in enumerate(found):
        for j, g in enumerate(found):
            times[i, j] = found[tuple(g[q] for q in f)]
    return element, times.ravel(), apply.ravel(), n, opens.ravel()


def scan(elements: np.ndarray, times: np.ndarray, n: int, block: int = 128) -> np.ndarray:
    """Inclusive prefix products of monoid elements (0 is the identity)."""
    size = len(elements)
    if size <= block:
        out = elements.copy()
        for i in range(1, size):
            out[i] = times[int(out[i - 1]) * n + int(out[i])]
        return out
    rows = -(-size // block)
    grid = np.zeros((rows, block), np.uint16)
    grid.ravel()[:size] = elements
    grid = np.ascontiguousarray(grid.T)                  # step j of every block is one row
    for j in range(1, block):
        grid[j] = times[grid[j - 1].astype(np.int32) * n + grid[j]]
    before = np.zeros(rows, np.uint16)
    before[1:] = scan(grid[-1], times, n, block)[:-1]
    grid = times[before.astype(np.int32) * n + grid]
    return np.ascontiguousarray(grid.T).ravel()[:size]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Does a slice start at each code point?  ``points``: uint32, texts each closed by 0x110000."""
    table = once("bpe-classes", _class_table)
    element, times, apply, n, opens = once("bpe-monoid", _monoid)
    ended = points == 0x110000
    cls = table[np.where(ended, 0, points)]
    cls[ended] = END
    white = (cls == BLANK) | (cls == SPACE)
    sym = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE_IN, S_SPACE_IN, S_OTHER, S_END], np.uint8)[cls]
    last = white.copy()
    last[:-1] &= ~(white[1:] | ended[1:])
    last[-1:] = False
    sym[last & (cls == BLANK)] = S_BLANK_LAST
    sym[last & (cls == SPACE)] = S_SPACE_LAST
    at = np.flatnonzero(cls == APOSTROPHE)
    if len(at):
        pad = np.append(points, [0, 0, 0])
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.any([(one == a) & (two == b) for a, b in pairs], axis=0)
        sym[at[short]] = S_SHORT
        sym[at[long & ~short]] = S_LONG
    prefix = scan(element[sym], times, n)
    state = np.zeros(len(sym), np.uint8)
    state[1:] = apply[prefix[:-1].astype(np.int32) * 8 + Q_NONE]
    return opens[sym.astype(np.int32) * 8 + state]


class Ranks:
    """A rank file as arrays: bytes of each id, and the pairs of ids that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.width = len(self.bytes)
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    vals.append(rank)
        order = np.argsort(keys)
        self.pair_key = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array(vals, np.int64)[order], 0)
        self.none = self.width                                # larger than any rank
        self.cache = PieceCache(slots_log2=20)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of ids a and b (-1: no id), or ``none``."""
        key = a * self.width + b
        at = np.searchsorted(self.pair_key, key)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], self.none)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """``ids``: a matrix of byte ids padded with -1; the same with all merges made."""
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(ids))
        cur, done = ids.copy(), ids.copy()
        col = np.arange(ids.shape[1])
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            going = best < self.none
            if not going.all():
                done[live[~going]] = cur[~going]
                live, cur, rank, at, best = live[going], cur[going], rank[going], at[going], best[going]
                if not len(live):
                    break
            row = np.arange(len(live))
            shift = col[None, :] > at[:, None]
            cur = np.where(shift, np.append(cur[:, 1:], np.full((len(cur), 1), -1), axis=1), cur)
            cur[row, at] = best
            later = col[None, :-1] > at[:, None]
            rank = np.where(later, np.append(rank[:, 1:], np.full((len(rank), 1), self.none), axis=1), rank)
            right = np.minimum(at + 1, cur.shape[1] - 1)
            has = at < rank.shape[1]
            rank[row[has], at[has]] = np.where(at[has] + 1 < cur.shape[1], self.pair(best[has], cur[row[has], right[has]]), self.none)
            left = at > 0
            rank[row[left], at[left] - 1] = self.pair(cur[row[left], at[left] - 1], best[left])
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """One long slice, by a heap of candidate pairs over a linked list."""
        n = len(piece)
        part = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i):
            j = after[i]
            if j < n and (r := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], alive[j] = a + b, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[part[i]] for i in range(n) if alive[i]]

    def make(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of ids of each."""
        size = np.zeros(len(pieces), np.int64)
        groups: dict[int, list[int]] = {}
        got: list[tuple[np.ndarray, np.ndarray]] = []              # pieces, their ids in the same order
        for k, raw in enumerate(pieces):
            if len(raw) > HEAP_BYTES:
                ids = np.array(self.merge_long(raw), np.uint32)
                size[k] = len(ids)
                got.append((np.array([k]), ids))
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(k)
        for width, some in groups.items():
            for lo in range(0, len(some), 20_000):
                part = np.array(some[lo:lo + 20_000])
                raws = [pieces[k] for k in part.tolist()]
                flat = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raws]), np.uint8).reshape(len(part), width)
                length = np.fromiter(map(len, raws), np.int64, len(raws))
                ids = np.where(np.arange(width)[None, :] < length[:, None], self.byte_id[flat], -1)
                ids = self.merge_rows(ids)
                size[part] = (ids >= 0).sum(axis=1)
                got.append((part, ids[ids >= 0].astype(np.uint32)))
        to = np.cumsum(size)
        out = np.empty(int(to[-1]) if len(to) else 0, np.uint32)
        for part, ids in got:
            n = size[part]
            upto = np.cumsum(n)
            out[np.arange(len(ids)) + np.repeat(to[part] - n - (upto - n), n)] = ids
        return out, size

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each UTF-8 text ``buf[offsets[d]:offsets[d + 1]]`` its ids and the number of ids of each slice."""
        raw = buf.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        size = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        byte_at = np.append(0, np.cumsum(size))
        closing = np.searchsorted(byte_at, offsets[1:])                 # code points before each text's end
        marked = np.insert(points, closing, 0x110000)
        cut = np.flatnonzero(boundaries(marked))
        point_at = cut - np.searchsorted(closing + np.arange(len(closing)), cut)    # without the closing marks
        at = byte_at[point_at]
        real = marked[cut] != 0x110000
        start, stop = at[:-1][real[:-1]], at[1:][real[:-1]]
        ids, count = self.cache.ids(buf, start, stop, self.make)
        first = np.searchsorted(start, offsets)
        to = np.append(0, np.cumsum(count))[first].tolist()
        return [(ids[a:b], count[c:d]) for a, b, c, d in zip(to, to[1:], first.tolist(), first[1:].tolist())]


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _digests(ranks: Ranks, ids: np.ndarray) -> tuple[str, str]:
    """SHA-256 of the decimal ids joined by commas, and of the bytes decoded from them."""
    return (hashlib.sha256(",".join([ranks.decimal[i] for i in ids.tolist()]).encode()).hexdigest(),
            hashlib.sha256(decode_ids(ranks, ids)).hexdigest())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
           digests: bool = False) -> DataFrame:
    """``id_col``, columns ``keep``, ``n_tokens, ids, slice_tokens``: ids and tokens per slice as little-endian int32.

    With ``digests`` each text's ids are decoded again in the same pass: also ``ids_sha256, decoded_sha256``.
    """
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("byte_bpe")
        ranks = _ranks(path)
        for batch in batches:
            for part in chunks(batch, text_col, CHUNK_BYTES):
                got = ranks.encode(*text_bytes(part.column(text_col)))
                out = [*[part.column(c) for c in cols], pa.array([len(i) for i, _ in got], pa.int64()),
                       pa.array([i.tobytes() for i, _ in got], pa.binary()),
                       pa.array([s.astype(np.int32).tobytes() for _, s in got], pa.binary())]
                names = [*cols, "n_tokens", "ids", "slice_tokens"]
                if digests:
                    sha = [_digests(ranks, i) for i, _ in got]
                    out += [pa.array([a for a, _ in sha], pa.string()), pa.array([b for _, b in sha], pa.string())]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.record_batch(out, names=names)

    tail = "n_tokens bigint, ids binary, slice_tokens binary" + (", ids_sha256 string, decoded_sha256 string" if digests else "")
    return docs.select(*dict.fromkeys([*cols, text_col])).mapInArrow(run, f"{_kinds(docs, cols)}, {tail}")


def decode_ids(ranks: Ranks, ids: np.ndarray) -> bytes:
    return b"".join([ranks.bytes[i] for i in ids.tolist()])


def decode_slice(ranks: Ranks, ids: np.ndarray, slice_tokens: np.ndarray, at: int) -> bytes:
    """The bytes of one slice alone."""
    lo = int(slice_tokens[:at].sum())
    return decode_ids(ranks, ids[lo:lo + int(slice_tokens[at])])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, columns ``keep``, ``n_tokens, decoded`` (bytes) of encoded texts."""
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("byte_bpe")
        ranks = _ranks(path)
        for batch in batches:
            for part in chunks(batch, "ids", 2 * CHUNK_BYTES):
                out = [decode_ids(ranks, np.frombuffer(raw or b"", np.int32)) for raw in part.column("ids").to_pylist()]
                yield pa.record_batch([*[part.column(c) for c in cols], part.column("n_tokens"), pa.array(out, pa.binary())],
                                      names=[*cols, "n_tokens", "decoded"])

    return encoded.select(*dict.fromkeys([*cols, "n_tokens", "ids"])).mapInArrow(run, f"{_kinds(encoded, cols)}, n_tokens bigint, decoded binary")


def _ranks(path: str) -> Ranks:
    return once(("bpe-ranks", path), lambda: Ranks(path))
