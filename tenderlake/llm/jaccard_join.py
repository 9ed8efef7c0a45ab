"""N-gram Jaccard join with set-relation skipping, and the classes of linked documents.

A document's set holds its distinct ``SHINGLE``-word shingles (A-Z lower-cased); documents link when
|x n y| / |x u y| >= 0.8, checked on the sets themselves.  Equal sets are one node.

Candidates come from an exact prefix index: in one global order of shingles, linked sets share one of
their first n - ceil(0.8 n) + 1.  The order is: shingles that are frequent (seen often enough within
the chunks of one scan, or in more than ``CROWDED`` prefixes under the order so far; bitmaps of fixed size)
last, then by hash, so common lines and passages
hardly enter the index.  It changes the work, never the result.

Set relations skip work in the index lists (one list a shingle):

* *Index level*: a list is sorted by set size; members out of the size range of a set, and members
  whose place of the shingle says that too many others differ, are skipped in whole blocks.
* A parity bitmap of about one bit a shingle (2 % of the text) stands for each set: the sets differ
  in at least as many shingles as the bitmaps do in bits, which rules out almost every pair without
  reading the sets.
* *Answer level*: in long lists sets are gathered around leaders first, and only leader pairs are
  checked.  Sets that are then known to be linked need no answers between them; between classes a
  set's answers are derived from those of a similar set already answered (its bit distances, less
  the distance between the two), and only what remains is compared.

So a list of m near copies gives about m pairs, not m * m / 2.  Lists over ``BLOCK`` entries are cut into
blocks: leaders are found block by block, then entries outside the list's largest class visit all its blocks, so no list is
gathered whole and its rows grow with its length.  Of copies
one row enters the index (a bitmap of fixed size tells which), joins on a frequent key are salted, components are found in Spark.

Cases: a text with fewer words than a shingle has its whole sequence as one shingle; a null, empty
or word-less text has the empty set and links with nothing.  A null id links like any other but
never names a class unless all ids are null.  Rows equal in id and text count as one document; rows
that share an id but not the text are separate.  Other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import enter, salted_join, spread_join, stage_table
from tenderlake.llm.components import connected_components
from tenderlake.llm.textarrays import chunks, mix64, split_words, window_hashes

SHINGLE = 5
PERCENT = 80                     # the threshold; the bounds below are written for it
FREQUENT_LOCAL = 3               # documents of one chunk of COUNT_SHINGLES that a shingle is in to be counted
FREQUENT = 9                     # counted documents that make a shingle frequent
CROWDED = 4                      # prefixes that a shingle may be in before it goes last, too
COUNT_SHINGLES = 2_000_000
SHORT = 32                       # lists up to this many entries give their pairs at once
BLOCK = 4096
MINOR = 32_768                   # entries outside a list's largest class that may go to all its blocks
LONG_BYTES = 2048                # at most, of a bitmap that travels with an entry of a long list
LONG_BITS = 8                    # bits a shingle of such a bitmap
BITS = 26                        # log2 of the bits of each bitmap handed to the scans: 8 MB whatever the input
ROUNDS = 2                       # rounds over the nearest classes before all remaining pairs are compared
NEAREST = 2                      # partners a set gets in such a round
HELD = 500_000                  # index entries that a task holds to drop repeated ones


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    w = split_words(column, lower=True)
    grams = window_hashes(w.hash, SHINGLE)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            some = np.sort(grams[a:b - SHINGLE + 1])
            out.append(some[np.append(True, some[1:] != some[:-1])])
        elif b > a:
            out.append(window_hashes(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    if not len(s):
        return 0
    h = int(mix64(s).sum(dtype=np.uint64)) ^ (int(np.bitwise_xor.reduce(s)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return int(np.array([h], np.uint64).view(np.int64)[0]) or 1


def parity(s: np.ndarray, each: int = 1) -> bytes:
    """A bit a bucket: odd number of shingles.  At least ``each`` buckets a shingle, a power of two, 64 or more."""
    size = max(64, 1 << (each * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order, as many as linked sets cannot both miss."""
    if not len(s):
        return s
    many = len(s) - -(-len(s) * PERCENT // 100) + 1
    late = _holds(frequent, s)
    first = s[~late]
    return first[:many] if len(first) >= many else np.concatenate([first, s[late][:many - len(first)]])


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _bitmap(rows: DataFrame, col: str) -> np.ndarray:
    """A bit for each leading residue of a hash column: fixed size whatever the input."""
    slot = F.shiftrightunsigned(col, 64 - BITS)
    got = (rows.select(F.shiftright(slot, 15).cast("int").alias("_part"), slot.bitwiseAND(F.lit(32767)).alias("_at"))
           .groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits")).collect())
    out = np.zeros(((1 << BITS) // 8 // 4096, 4096), np.uint8)
    for r in got:
        out[r["_part"]] = np.frombuffer(r["_bits"], np.uint8)
    return out.ravel()


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def scan_sets(rows: DataFrame) -> DataFrame:
    """One scan, two kinds of rows: ``doc`` (id, row, key, size, bits) and others (shingle, documents within a chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        held, size = [], 0

        def often() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.append(True, every[1:] != every[:-1])[:len(every)])
            n = np.diff(np.append(at, len(every)))
            pick = n >= FREQUENT_LOCAL
            k = int(pick.sum())
            return pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), _as_long(every[at[pick]]), pa.array(n[pick].astype(np.int64)),
                                    pa.nulls(k, pa.binary()), pa.array([False] * k, pa.bool_())], names=["_id", "_row", "h", "n", "bits", "doc"])

        for batch in batches:
            for part in chunks(batch, "_text"):
                sets = shingle_sets(part.column("_text"))
                k = len(sets)
                yield pa.record_batch([part.column("_id"), part.column("_row"), pa.array([set_key(s) for s in sets], pa.int64()),
                                       pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()),
                                       pa.array([True] * k, pa.bool_())], names=["_id", "_row", "h", "n", "bits", "doc"])
                held += sets
                size += sum(map(len, sets))
                if size >= COUNT_SHINGLES:
                    yield often()
                    held, size = [], 0
        yield often()

    return rows.mapInArrow(run, "_id bigint, _row bigint, h bigint, n bigint, bits binary, doc boolean")


def _standing(part: pa.RecordBatch, stand: np.ndarray) -> pa.Array:
    """Texts of the rows in the bitmap."""
    return part.column("_text").filter(pa.array(_holds(stand, part.column("_row").to_numpy().view(np.uint64))))


def prefix_shingles(rows: DataFrame, frequent, stand) -> DataFrame:
    """Prefix shingles of the rows that stand for a set (and of the few copies that the bitmap lets pass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            for part in chunks(batch, "_text"):
                some = [prefix(s, frequent.value) for s in shingle_sets(_standing(part, stand.value))]
                yield pa.record_batch([_as_long(np.concatenate([*some, np.zeros(0, np.uint64)]))], names=["token"])

    return rows.select("_row", "_text").mapInArrow(run, "token bigint")


def index_entries(rows: DataFrame, frequent, shared, stand) -> DataFrame:
    """``token, key, n, pos`` for prefix shingles that occur more than once, from the rows that stand for a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        held: list[tuple] = []

        def entries() -> pa.RecordBatch:
            token, key, n, pos = [np.concatenate(c) for c in zip(*held)] if held else [np.zeros(0, np.int64)] * 4
            held.clear()
            order = np.lexsort((key, token))
            token, key = token[order], key[order]
            keep = order[np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))[:len(order)]]
            fresh = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))[:len(order)])
            return pa.record_batch([pa.array(token[fresh]), pa.array(key[fresh]), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                                   names=["token", "key", "n", "pos"])

        for batch in batches:
            for part in chunks(batch, "_text"):
                for s in shingle_sets(_standing(part, stand.value)):
                    p = prefix(s, frequent.value)
                    at = np.flatnonzero(_holds(shared.value, p))
                    if len(at):
                        held.append((p[at].view(np.int64), np.full(len(at), set_key(s)), np.full(len(at), len(s)), at))
                if sum(len(h[0]) for h in held) > HELD:
                    yield entries()
        yield entries()

    return rows.select("_row", "_text").mapInArrow(run, "token bigint, key bigint, n int, pos int")


def full_sets(rows: DataFrame, wanted, long_bits: bool = False) -> DataFrame:
    """``key, set`` of the rows in the bitmap, or (``long_bits``) their bitmaps for long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            for part in chunks(batch, "_text"):
                sets = [s for s in shingle_sets(_standing(part, wanted.value)) if len(s)]
                body = [_small(parity(s, LONG_BITS)) if long_bits else s.tobytes() for s in sets]
                yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.int64()), pa.array(body, pa.binary())], names=["key", "set"])

    return rows.select("_row", "_text").mapInArrow(run, "key bigint, set binary")


def _small(bits: bytes) -> bytes:
    """At most ``LONG_BYTES`` bytes: halves are added up (still never more bits than shingles differ)."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > LONG_BYTES:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x.tobytes()


def _fold(x: int, size: int, to: int) -> int:
    while size > to:
        size >>= 1
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return x


def _could_link(n1, p1, n2, p2):
    """Sizes and places of a shared shingle allow a link (arrays or numbers)."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    apart = np.abs(p1 - p2) + np.abs((n1 - p1) - (n2 - p2))
    return (100 * small >= PERCENT * large) & (9 * apart <= n1 + n2)


class _List:
    """Entries of one list, sorted by size, with their bitmaps by number of buckets."""

    def __init__(self, key, n, pos, bits, tag, block, minor):
        order = np.lexsort((key, n))
        self.key, self.n, self.pos, self.tag, self.block, self.minor = (x[order] for x in (key, n, pos, tag, block, minor))
        raw = [bits[k] for k in order.tolist()]
        self.width = np.array([len(b) for b in raw])
        self.begin = {int(w): int(np.searchsorted(self.width, w)) for w in np.unique(self.width)}      # sizes ascend, so do widths
        self.rows = {w: np.frombuffer(b"".join(raw[lo:lo + int((self.width == w).sum())]), np.uint64).reshape(-1, w // 8)
                     for w, lo in self.begin.items()}

    def reach(self, k: int) -> int:
        """End of the block of entries, from k on, whose size is in range."""
        return int(np.searchsorted(self.n, self.n[k] * 100 // PERCENT, "right"))

    def distance(self, k: int, others: np.ndarray) -> np.ndarray:
        """Differing bits between entry k and entries ``others`` (no smaller than k, so as wide or twice as wide)."""
        w = int(self.width[k])
        mine = self.rows[w][k - self.begin[w]]
        out = np.empty(len(others), np.int64)
        for v, lo in self.begin.items():
            at = np.flatnonzero(self.width[others] == v)
            if len(at):
                rows = self.rows[v][others[at] - lo]
                while rows.shape[1] > len(mine):
                    half = rows.shape[1] // 2
                    rows = rows[:, :half] ^ rows[:, half:]
                out[at] = np.bitwise_count(rows ^ mine).sum(axis=1)
        return out


def _leader_pairs(one: _List) -> list[tuple[int, int]]:
    """Each set with the first leader that it may link with; a set without one becomes a leader."""
    free = np.ones(len(one.n), bool)
    pairs = []
    for k in range(len(one.n)):
        if not free[k]:
            continue
        others = np.arange(k + 1, one.reach(k))
        others = others[free[others]]
        others = others[_could_link(one.n[k], one.pos[k], one.n[others], one.pos[others])]
        if len(others):
            others = others[9 * one.distance(k, others) <= one.n[k] + one.n[others]]
            free[others] = False
            pairs += [(k, o) for o in others.tolist()]
    return pairs


def _class_pairs(one: _List, two_blocks: bool, group: int, nearest: int) -> list[tuple[int, int]]:
    """Pairs that may link across classes (``tag``), deriving answers from the last set answered in the class.

    ``nearest``: only so many partners a set, the nearest ones; 0: all.
    """
    pairs = []
    known: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}      # class: a set, entries in its range, distances to them
    for k in range(len(one.n)):
        others = np.arange(k + 1, one.reach(k))
        others = others[(one.tag[others] != one.tag[k]) & _could_link(one.n[k], one.pos[k], one.n[others], one.pos[others])]
        if two_blocks:
            others = others[one.block[others] != one.block[k]]
        elif one.minor[k]:                                     # two entries that are in all blocks meet in one of them
            others = others[~one.minor[others] | (np.minimum(one.block[others], one.block[k]) == group)]
        if not len(others):
            continue
        r, seen, far = known.get(int(one.tag[k]), (-1, None, None))
        if r >= 0 and one.width[r] == one.width[k]:
            near = int(one.distance(r, np.array([k]))[0])
            at = np.searchsorted(seen, others)
            at[at == len(seen)] = 0
            answered = seen[at] == others
            out = answered & (9 * (far[at] - near) > one.n[k] + one.n[others])      # too far from r, so too far from k
            others = others[~out]
        dist = one.distance(k, others)
        if r < 0 or len(others) > 4 * len(seen):
            known[int(one.tag[k])] = (k, others, dist)
        ok = 9 * dist <= one.n[k] + one.n[others]
        others, dist = others[ok], dist[ok]
        if nearest and len(others) > nearest:
            others = others[np.argsort(dist, kind="stable")[:nearest]]
        pairs += [(k, o) for o in others.tolist()]
    return pairs


def _lists(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole lists (rows sorted by ``by``), several at a time."""
    held: list[pa.RecordBatch] = []
    group = lambda b, k: [b.column(c)[k].as_py() for c in by]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        same = np.all([c == c[-1] for c in cols], axis=0)
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last or (held and group(held[0], 0) != group(batch, 0)):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def short_pairs(index: DataFrame, bits: DataFrame) -> DataFrame:
    """``a, b``: keys of sets that may link, from lists of up to ``SHORT`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for table in _lists(batches, ("token",)):
            token, key, n, pos = [table.column(c).to_numpy().astype(np.int64) for c in ("token", "key", "n", "pos")]
            once = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))
            token, key, n, pos = token[once], key[once], n[once], pos[once]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(start, len(token)))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.unique(size[size > 1]).tolist():               # all lists of one length at once
                at = start[size == g]
                i, j = np.triu_indices(g, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = _could_link(n[x], pos[x], n[y], pos[y])
                a.append(key[x[ok]])
                b.append(key[y[ok]])
            yield _pair_batch(np.concatenate(a), np.concatenate(b))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, m, n in zip(*[batch.column(c).to_pylist() for c in ("_x", "_y", "_m", "_n")]):
                to = 8 * min(len(x), len(y))
                far = _fold(int.from_bytes(x, "little"), 8 * len(x), to) ^ _fold(int.from_bytes(y, "little"), 8 * len(y), to)
                ok.append(9 * far.bit_count() <= m + n)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = (index.repartition("token").sortWithinPartitions("token", "key").select("token", "key", "n", "pos").mapInArrow(run, "a bigint, b bigint")
             .filter("a <> b").distinct())
    found = stage_table(found, "jaccard-found")
    first = spread_join(found, bits.select(F.col("key").alias("a"), F.col("bits").alias("_x"), F.col("n").alias("_m")), "a", F.col("b"))
    both = spread_join(first, bits.select(F.col("key").alias("b"), F.col("bits").alias("_y"), F.col("n").alias("_n")), "b", F.col("a"), counted=found)
    return both.mapInArrow(near, "a bigint, b bigint")


def long_pairs(index: DataFrame, classes: bool, nearest: int = 0) -> DataFrame:
    """``a, b`` from long lists: leader pairs, or (``classes``) what may link across classes ``tag``.

    ``index``: ``token, i, j, block, key, n, pos, bits, tag, minor``; a list, a block or two blocks of it are (token, i, j).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for table in _lists(batches, ("token", "i", "j")):
            token, i, j, block, key, n, pos, tag = [table.column(c).to_numpy() for c in ("token", "i", "j", "block", "key", "n", "pos", "tag")]
            minor = np.asarray(table.column("minor").to_pandas(), bool)
            bits = table.column("bits").to_pylist()
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            start = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            a, b = [], []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(token)]):
                part = slice(lo, hi)
                one = _List(key[part], n[part], pos[part], bits[part], tag[part], block[part], minor[part])
                for x, y in _class_pairs(one, i[lo] != j[lo], int(i[lo]), nearest) if classes else _leader_pairs(one):
                    a.append(one.key[x])
                    b.append(one.key[y])
            yield _pair_batch(np.array(a, np.int64), np.array(b, np.int64))

    return (index.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
            .select("token", "i", "j", "block", "key", "n", "pos", "bits", "tag", "minor").mapInArrow(run, "a bigint, b bigint").filter("a <> b").distinct())


def check_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs that do link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            ok, last, mine = [], None, None
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist()):
                if x != last:
                    last, mine = x, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(mine) + len(other) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = spread_join(pairs, sets.select(F.col("key").alias("a"), F.col("set").alias("_x")), "a", F.col("b"))
    second = spread_join(first, sets.select(F.col("key").alias("b"), F.col("set").alias("_y")), "b", F.col("a"), counted=pairs)
    return second.select("a", "b", "_x", "_y").mapInArrow(run, "a bigint, b bigint")


def _cut(index: DataFrame, lists: DataFrame) -> DataFrame:
    """Add ``block`` and ``_m``: lists over ``BLOCK`` entries are cut into ``_m`` blocks, each list in a way of its own."""
    big = lists.filter(F.col("entries") > BLOCK).select(F.col("token").alias("_t"), F.ceil(F.col("entries") / BLOCK).cast("int").alias("_m"))
    marked = index.join(big, F.col("token") == F.col("_t"), "left").drop("_t")
    return marked.withColumn("block", F.when(F.col("_m").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("token", "key"), F.col("_m")).cast("int")))


def _leader_blocks(index: DataFrame, lists: DataFrame) -> DataFrame:
    """One group for each block of a list: near copies gather around leaders block by block, and meet through their other lists."""
    return (_cut(index, lists).withColumn("i", F.col("block")).withColumn("j", F.col("block")).withColumn("tag", F.lit(0).cast("bigint"))
            .withColumn("minor", F.lit(False)).drop("_m"))


def _class_blocks(tagged: DataFrame, lists: DataFrame) -> DataFrame:
    """Groups in which every two entries of different classes of a list meet once; lists of one class have none.

    Entries of a list's largest class stay in their block, the few others go to all blocks of the list, so the rows
    grow with the list and not with its square.  Only a list whose other classes hold more than ``MINOR`` entries
    has every two blocks meet in a group of their own.
    """
    tagged = stage_table(tagged, "jaccard-tagged")
    sizes = tagged.groupBy("token", "tag").agg(F.count("*").alias("_n")).groupBy("token").agg(
        F.max_by(F.struct("tag", "_n"), F.struct("_n", "tag")).alias("_most"), F.sum("_n").alias("_all"))
    several = stage_table(sizes.filter(F.col("_most._n") < F.col("_all")).select(
        F.col("token").alias("_st"), F.col("_most.tag").alias("_major"), (F.col("_all") - F.col("_most._n") <= MINOR).alias("_few")), "jaccard-several")
    held = _cut(tagged, lists).join(several, F.col("token") == F.col("_st"))
    cut = F.col("_m").isNotNull()
    minor = cut & F.col("_few") & (F.col("tag") != F.col("_major"))
    every = F.sequence(F.lit(0), F.col("_m") - 1)
    meets = F.when(~cut | (F.col("_few") & ~minor), F.array(F.col("block"))).otherwise(every)
    spread = held.withColumn("minor", minor).withColumn("_k", F.explode(meets))
    pairs = cut & ~F.col("_few")
    return (spread.withColumn("i", F.when(pairs, F.least("block", "_k")).otherwise(F.col("_k")))
            .withColumn("j", F.when(pairs, F.greatest("block", "_k")).otherwise(F.col("_k"))).drop("_m", "_k", "_st", "_major", "_few"))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links: the links between classes are few, so only those are solved anew."""
    named = classes.select(F.col("node").alias("_node"), "component")
    ends = links
    for c in ("a", "b"):
        ends = ends.join(named, F.col(c) == F.col("_node"), "left").withColumn(c, F.coalesce("component", c)).drop("_node", "component")
    over = stage_table(connected_components(ends), "class-links").select(F.col("node").alias("_c"), F.col("component").alias("_to"))
    fresh = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().join(classes, "node", "left_anti")
    every = classes.unionByName(fresh.withColumn("component", F.col("node")))
    return (every.join(over, F.col("component") == F.col("_c"), "left")
            .select("node", F.coalesce("_to", "component").alias("component")))


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col, n_shingles, component_id`` and ``_row`` (hash of id and text), ``_class``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), _row_key(id_col, text_col).alias("_row"))
    sc = docs.sparkSession.sparkContext
    scanned = stage_table(scan_sets(rows), "jaccard-scan")
    own = scanned.filter("doc").select("_id", "_row", F.col("h").alias("key"), "n")
    frequent = scanned.filter("NOT doc").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    frequent = sc.broadcast(_bitmap(frequent, "h"))
    # one row stands for each set: its shingles enter the index, its bitmap and its set speak for all copies
    first = F.min_by(F.struct("_row", "n", "bits"), "_row").alias("f")
    bits = stage_table(scanned.filter("doc AND n > 0").groupBy(F.col("h").alias("key")).agg(first).select("key", "f.*"), "jaccard-bits")
    stand = sc.broadcast(_bitmap(bits, "_row"))

    def count_lists(last) -> DataFrame:
        counted = prefix_shingles(rows, last, stand).groupBy("token").agg(F.count("*").alias("entries")).filter("entries > 1")
        return stage_table(counted, "jaccard-lists")

    # Shingles that turn out to be in several prefixes go last as well; what moves up in their place is mostly rare.
    crowded = count_lists(frequent).filter(F.col("entries") > CROWDED)
    frequent = sc.broadcast(frequent.value | _bitmap(crowded, "token"))
    lists = count_lists(frequent)
    shared = sc.broadcast(_bitmap(lists, "token"))

    index = stage_table(index_entries(rows, frequent, shared, stand), "jaccard-index")
    long = stage_table(lists.filter(F.col("entries") > SHORT), "jaccard-long-lists")
    pairs = short_pairs(index.join(long.select("token"), "token", "left_anti"), bits)

    def fetch(keys: DataFrame, long_bits: bool = False) -> DataFrame:
        chosen = bits.select("key", "_row").join(keys.select("key").distinct(), "key", "left_semi")
        return stage_table(full_sets(rows, sc.broadcast(_bitmap(chosen, "_row")), long_bits), "jaccard-sets")

    def both(some: DataFrame) -> DataFrame:
        return some.select(F.col("a").alias("key")).unionByName(some.select(F.col("b").alias("key")))

    has_long = not long.isEmpty()
    if has_long:
        members = index.join(long.select("token"), "token", "left_semi").dropDuplicates(["token", "key"])
        members = stage_table(members, "jaccard-members")
        wide = fetch(members, long_bits=True).select("key", F.col("set").alias("bits"))
        members = stage_table(spread_join(members, wide.dropDuplicates(["key"]), "key", F.col("token")), "jaccard-long")
        pairs = pairs.unionByName(long_pairs(_leader_blocks(members, long), classes=False)).distinct()
    pairs = stage_table(pairs, "jaccard-pairs")
    links = stage_table(check_pairs(pairs, fetch(both(pairs))), "jaccard-links")
    classes = stage_table(connected_components(links), "jaccard-classes")

    def across(nearest: int) -> DataFrame:
        tags = classes.select(F.col("node").alias("key"), F.col("component").alias("tag"))
        tagged = salted_join(members, tags, ["key"], F.col("token"), "left").withColumn("tag", F.coalesce("tag", "key"))
        return stage_table(long_pairs(_class_blocks(tagged, long), True, nearest).join(pairs, ["a", "b"], "left_anti"), "jaccard-across")

    for round_ in range(ROUNDS + 1) if has_long else ():      # nearest classes first, then whatever remains
        more = across(NEAREST if round_ < ROUNDS else 0)
        if more.isEmpty():
            continue
        found = stage_table(check_pairs(more, fetch(both(more))), "jaccard-links")
        pairs = pairs.unionByName(more)
        if not found.isEmpty():
            classes = stage_table(_joined(classes, found), "jaccard-classes")

    named = classes.select(F.col("node").alias("key"), F.col("component").alias("_class"))
    own = salted_join(own, named, ["key"], F.col("_row"), "left").withColumn("_class", F.coalesce("_class", "key"))
    own = stage_table(own, "jaccard-own")
    empty, some = own.filter("n = 0"), own.filter("n > 0")
    smallest = some.groupBy("_class").agg(F.min("_id").alias("component_id"))
    linked = salted_join(some, smallest, ["_class"], F.col("_row"))
    out = linked.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "_row", "_class")
    return out.unionByName(empty.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), "_row",
                                        F.lit(None).cast("bigint").alias("_class")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class (the smallest id; of equal ids the smallest row hash) left."""
    found = linked_classes(docs, id_col, text_col)
    stays = found.filter("_class IS NOT NULL").groupBy("_class").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_i"), F.col("_row").alias("_r"))).alias("_best")).select("_best._r", "_best._i")
    stays = stays.unionByName(found.filter("_class IS NULL").select(F.col("_row").alias("_r"), F.col(id_col).alias("_i"))).distinct()
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), _row_key(id_col, text_col).alias("_row"))
    same = (F.col("_row") == F.col("_r")) & F.col(f"_doc.{id_col}").cast("bigint").eqNullSafe(F.col("_i"))
    return whole.join(stays, same, "left_semi").select("_doc.*")
