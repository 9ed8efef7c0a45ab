"""Texts of an Arrow batch as flat numpy arrays: bytes, word slices, word hashes, and a cache by piece."""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tenderlake.llm.common import once, tidy

MULT = 0x9E3779B97F4A7C15
LENGTH_KEY = 0xD6E8FEB86659FD93


class Words(NamedTuple):
    """Words of several texts in order; ``first[d]:first[d + 1]`` are the words of text ``d``."""

    buf: np.ndarray      # uint8, all texts
    start: np.ndarray    # int64 byte position of each word
    end: np.ndarray
    first: np.ndarray    # int64, one more than texts
    hash: np.ndarray     # uint64, equal for equal words


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Blocks(NamedTuple):
    """Slices cut into 8-byte blocks (the last one padded with zeros); ``first[i]:first[i + 1]`` are those of slice i."""

    value: np.ndarray    # uint64
    place: np.ndarray    # int64, number of the block in its slice
    first: np.ndarray    # int64, one more than slices
    size: np.ndarray     # int64, bytes of each slice


def blocks_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Blocks:
    size = (end - start).astype(np.int64)
    many = (size + 7) >> 3
    first = np.append(0, np.cumsum(many))
    place = np.arange(first[-1]) - np.repeat(first[:-1], many)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    every = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))     # the 8 bytes from each position on
    value = every[np.repeat(start, many) + (place << 3)]
    over = np.maximum(((place + 1) << 3) - np.repeat(size, many), 0).astype(np.uint64)
    value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (over << np.uint64(3))
    return Blocks(value, place, first, size)


def block_hashes(b: Blocks) -> np.ndarray:
    """64-bit hashes: every block goes with the key of its place through a nonlinear mix; the sum is mixed with the
    length.  Never 0.  Two given different slices meet with a chance of about 2**-64, whatever their form."""
    keyed = mix64(b.value ^ mix64((b.place.astype(np.uint64) + np.uint64(1)) * np.uint64(MULT)))
    total = np.append(np.uint64(0), np.cumsum(mix64(keyed + np.uint64(MULT)), dtype=np.uint64))
    h = total[b.first[1:]] - total[b.first[:-1]]
    return np.maximum(mix64(h + b.size.astype(np.uint64) * np.uint64(LENGTH_KEY)), np.uint64(1))


def slice_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, equal for equal bytes; see ``block_hashes``."""
    return block_hashes(blocks_of(buf, start, end))


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the spans that begin at ``first`` and have ``size`` entries."""
    to = np.cumsum(size)
    total = int(to[-1]) if len(to) else 0
    return np.arange(total) + np.repeat(first - (to - size), size)


class Pool:
    """Arrays of many entries one after the other, with room to grow; entry i ends where i + 1 begins."""

    def __init__(self, kind):
        self.offset = np.zeros(1 << 16, np.int64)
        self.data = np.zeros(1 << 18, kind)
        self.entries = 0

    def add(self, data: np.ndarray, size: np.ndarray) -> None:
        start = int(self.offset[self.entries])
        need, many = start + len(data), self.entries + len(size) + 1
        while len(self.data) < need:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while len(self.offset) < many:
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        self.data[start:need] = data
        self.offset[self.entries + 1:many] = start + np.cumsum(size)
        self.entries = many - 1

    def size(self, entry: np.ndarray) -> np.ndarray:
        return self.offset[entry + 1] - self.offset[entry]

    def get(self, entry: np.ndarray) -> np.ndarray:
        return self.data[spans(self.offset[entry], self.size(entry))]


class PieceCache:
    """Ids of text pieces: an open-addressing table by 64-bit hash in flat arrays, for whole chunks at once.

    Every hit is compared with the bytes kept for its entry; a piece that meets another one's hash gets ids of
    its own.  When the table is full it starts anew, so memory is bounded by ``slots``.
    """

    PROBES = 12

    def __init__(self, slots_log2: int = 21):
        self.bits = slots_log2
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.key = np.zeros(size, np.uint64)                   # 0: free
        self.where = np.zeros(size, np.int32)
        self.made = Pool(np.uint32)                            # ids of each entry
        self.text = Pool(np.uint64)                            # its blocks
        self.length = Pool(np.int64)                           # its bytes

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.key[slot]
        same = key == h
        out[same] = self.where[slot[same]]
        left = np.flatnonzero(~same & (key != 0))
        for step in range(1, self.PROBES):
            if not len(left):
                break
            at = (slot[left] + step) & mask
            key = self.key[at]
            same = key == h[left]
            out[left[same]] = self.where[at[same]]
            left = left[~same & (key != 0)]
        return out

    def _store(self, b: Blocks, which: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, make) -> np.ndarray:
        """New entries for the slices ``which``; returns their numbers."""
        base = self.made.entries
        ids, size = make([raw[a:c] for a, c in zip(start[which].tolist(), end[which].tolist())])
        self.made.add(ids, size)
        many = b.first[which + 1] - b.first[which]
        self.text.add(b.value[spans(b.first[which], many)], many)
        self.length.add(b.size[which], np.ones(len(which), np.int64))
        return np.arange(base, self.made.entries, dtype=np.int32)

    def _enter(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        for step in range(self.PROBES):
            at = (slot + step) & mask
            free = self.key[at] == 0
            self.key[at[free]] = h[free]                       # of several, one stays
            won = free & (self.key[at] == h)
            self.where[at[won]] = entry[won]
            h, slot, entry = h[~won], slot[~won], entry[~won]
            if not len(h):
                break

    def _differs(self, b: Blocks, entry: np.ndarray) -> np.ndarray:
        """Slices whose bytes are not those of their entry."""
        wrong = self.length.data[entry] != b.size
        same = np.flatnonzero(~wrong)
        many = b.first[same + 1] - b.first[same]
        unlike = b.value[spans(b.first[same], many)] != self.text.get(entry[same])
        if unlike.any():
            wrong[np.repeat(same, many)[unlike]] = True
        return np.flatnonzero(wrong)

    def ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices, one after the other, and their number in each; ``make`` gives those of new pieces."""
        entry = self.entry(buf, start, end, make)
        return self.made.get(entry), self.made.size(entry)

    def entry(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, make) -> np.ndarray:
        """The entry of every slice, valid until the next call."""
        b = blocks_of(buf, start, end)
        h = block_hashes(b)
        entry = self.find(h)
        new = np.flatnonzero(entry < 0)
        raw = b""
        if len(new):
            raw = buf.tobytes()
            fresh, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.made.entries + len(fresh) > 0.6 * (1 << self.bits):
                self.clear()
                new = np.arange(len(h))
                fresh, at, back = np.unique(h, return_index=True, return_inverse=True)
            made = self._store(b, new[at], raw, start, end, make)
            self._enter(fresh, made)
            entry[new] = made[back]
        clash = self._differs(b, entry)
        if len(clash):                                         # another piece has this hash: entries that no hash leads to
            raw = raw or buf.tobytes()
            own: dict[bytes, int] = {}
            for i in clash.tolist():
                own.setdefault(raw[start[i]:end[i]], i)
            made = dict(zip(own, self._store(b, np.array(list(own.values())), raw, start, end, make).tolist()))
            entry[clash] = [made[raw[start[i]:end[i]]] for i in clash.tolist()]
        return entry


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes, or one text if that is longer."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    tidy()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null is empty) and the offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def word_ids(words: Words) -> tuple[np.ndarray, int]:
    """A number for every word, equal for equal bytes only, and how many numbers there are.  Hashes are checked."""
    b = blocks_of(words.buf, words.start, words.end)
    _, at, ids = np.unique(block_hashes(b), return_index=True, return_inverse=True)
    pick = at[ids]
    wrong = b.size[pick] != b.size
    same = np.flatnonzero(~wrong)
    many = b.first[same + 1] - b.first[same]
    unlike = b.value[spans(b.first[same], many)] != b.value[spans(b.first[pick[same]], many)]
    wrong[np.repeat(same, many)[unlike]] = True
    n = len(at)
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(wrong).tolist():                   # words that share a hash with another one
        ids[i] = own.setdefault(words.buf[words.start[i]:words.end[i]].tobytes(), n + len(own))
    return ids, n + len(own)


def _punctuation_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    return t


def _trim(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ASCII punctuation at their ends; words of nothing else go."""
    sign = once("punctuation-table", _punctuation_table)
    start, end = start.copy(), end.copy()
    for at, step, offset in ((start, 1, 0), (end, -1, -1)):
        live = np.arange(len(at))
        while len(live):
            live = live[start[live] < end[live]]
            live = live[sign[buf[at[live] + offset]]]
            at[live] += step
    real = start < end
    return start[real], end[real]


def split_words(column: pa.Array, lower: bool = False, hashes: bool = True, trim: bool = False) -> Words:
    """Words (maximal runs without blanks and \\x09-\\x0D) of every text, with 64-bit hashes."""
    buf, off = text_bytes(column)
    if lower:
        buf = once("lower-table", _lower_table)[buf]
    space = once("space-table", _space_table)[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = ~space
    opens = word.copy()
    opens[1:] &= space[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if trim:
        start, end = _trim(buf, start, end)
    first = np.searchsorted(start, off)
    if not hashes:
        return Words(buf, start, end, first, np.zeros(0, np.uint64))
    return Words(buf, start, end, first, slice_hashes(buf, start, end))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes (windows that cross texts included), by doubling."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, have, out, at = 1, words, None, 0
    while True:
        if width & done:
            part = have[at:at + n]
            out = part if out is None else mix64(out) * np.uint64(MULT) + part
            at += done
        if done * 2 > width:
            return mix64(out * np.uint64(MULT) + np.uint64(width))
        have = mix64(have[:-done]) * np.uint64(MULT) + have[done:]
        done *= 2
