"""Improbable-feature digests: rare byte windows in chained Bloom filters, and their likeness.

Features are the ``WINDOW``-byte windows of a text.  A window's entropy (in thousandths of the
maximum) is ranked by how rare that entropy is over all windows of the corpus: rarest first, windows
of too little entropy never.  In every run of ``RUN`` consecutive windows the first one of lowest rank
gets a point; windows with ``POINTS`` points or more (fewer in short texts) are the selected features.  Each is hashed to
``HASHES`` bits of a Bloom filter of ``FILTER_BYTES`` bytes; a filter takes ``FILTER_FEATURES``
features, then the next one is begun.  A feature that repeats in a text counts once.

Likeness: for every filter of the digest with fewer filters the best match in the other, averaged.
Two filters match by the bits they share, normalised from what chance gives (with a margin) to the
most that is possible.

Windows slide by integer updates: the number of equal bytes ahead of and behind each byte within a
window comes from one sort and one search, the entropy from a running sum.

Cases: a null text is empty; the empty text has the empty digest; a text shorter than a window, or
without any selected window, has one feature, all its bytes (or its window of most points).  Equal
digests have likeness 1, an empty one has 0 with any other.  Rows are ordered by id (null first),
equal ids by text; with one row it is its own next.  Other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import enter, once, stage_table
from tenderlake.llm.textarrays import MULT, chunks, mix64, text_bytes

WINDOW = 64
RUN = 64
POINTS = 16
FEW = 16                         # a text of w windows asks for w // FEW points, 1 at least and POINTS at most
LEVELS = 1001
LEAST_ENTROPY = 100              # thousandths; windows below say too little
FILTER_BYTES = 256
FILTER_FEATURES = 160
HASHES = 5
CHANCE_MARGIN = 0.1
CHUNK_BYTES = 1 << 20


def _entropy_steps() -> np.ndarray:
    """Scaled c log2 c - (c - 1) log2 (c - 1) for c = 0 .. WINDOW."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    f = np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0) * 65536).astype(np.int32)
    return np.append(0, np.diff(f)).astype(np.int32)


def window_entropy(buf: np.ndarray) -> np.ndarray:
    """Entropy, 0 to 1000, of every window of the buffer, by its first byte."""
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    step = once("entropy-steps", _entropy_steps)
    order = np.argsort(buf, kind="stable")
    wide = np.int32 if n < 1 << 22 else np.int64
    key = buf[order].astype(wide) * wide(n + WINDOW) + order.astype(wide)
    to = np.searchsorted(key, key + wide(WINDOW - 1), "right")       # past the last equal byte within a window ahead
    at = np.arange(n)
    ahead = np.empty(n, np.int32)
    ahead[order] = step[to - at]
    earlier = np.cumsum(np.bincount(to, minlength=n + 1))[:n]       # first equal byte within a window behind
    change = np.empty(n, np.int32)
    change[order] = step[at - earlier + 1]
    change[WINDOW:] -= ahead[:n - WINDOW]
    total = np.cumsum(change, dtype=np.int64)[WINDOW - 1:]
    most = WINDOW * np.log2(WINDOW) * 65536
    return (1000 - total * (1000 / most) + 0.5).astype(np.int32).clip(0, LEVELS - 1)


def _select(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the selected windows, and the text that each belongs to."""
    n = len(buf)
    size = np.diff(off)
    entropy = window_entropy(buf)
    m = len(entropy)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, np.int32)
    has = size >= WINDOW
    np.add.at(edge, off[:-1][has], 1)
    np.add.at(edge, off[1:][has] - WINDOW + 1, -1)
    valid = np.cumsum(edge)[:m] > 0
    mine = rank[entropy].astype(np.int64)
    usable = valid & (mine < LEVELS)
    mine[~usable] = LEVELS
    key = mine << 40 | np.arange(m)
    width = 1
    while width < RUN:                                       # minimum over RUN positions, by doubling
        key[:-width or None] = np.minimum(key[:-width], key[width:]) if len(key) > width else key
        width *= 2
    best = key & ((1 << 40) - 1)
    points = np.bincount(best[valid & (key >> 40 < LEVELS)], minlength=m)
    doc_of = np.searchsorted(off, np.arange(m), "right") - 1
    chosen = points >= np.clip((size - WINDOW + 1) // FEW, 1, POINTS)[doc_of]
    pos = np.flatnonzero(chosen)
    doc = doc_of[pos]
    got = np.zeros(len(size), bool)
    got[doc] = True
    bare = np.flatnonzero(has & ~got)
    if len(bare):                                             # the window of most points stands for the text
        extra = [int(off[d] + points[off[d]:off[d + 1] - WINDOW + 1].argmax()) for d in bare]
        pos, doc = np.append(pos, extra), np.append(doc, bare)
        order = np.argsort(pos, kind="stable")
        pos, doc = pos[order], doc[order]
    return pos.astype(np.int64), doc.astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def digests(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its Bloom filters (rows of bytes) and the number of features in each."""
    n = len(buf)
    pos, doc = _select(buf, off, rank)
    size = 1 << max(16, n.bit_length())
    store = once("digest-powers", dict)
    if size not in store:
        store.clear()
        store[size] = (_powers(MULT, size), _powers(pow(MULT, -1, 1 << 64), size))
    up, down = store[size]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    short = np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < WINDOW))
    start = np.concatenate([pos, off[short]])
    end = np.concatenate([pos + WINDOW, off[short + 1]])
    owner = np.concatenate([doc, short])
    h = mix64((total[end] - total[start]) * down[start])
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(off)))
    out = []
    for d in range(len(off) - 1):
        hashes = h[first[d]:first[d + 1]]
        if len(hashes) > 1:                                   # a repeated feature counts once, where it is first
            hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
        chain = -(-len(hashes) // FILTER_FEATURES)
        bits = np.zeros((chain, FILTER_BYTES * 8), bool)
        which = np.arange(len(hashes)) // FILTER_FEATURES
        for k in range(HASHES):
            bits[which, ((hashes >> np.uint64(11 * k)) & np.uint64(2047)).astype(np.int64)] = True
        out.append((np.packbits(bits, axis=1), np.bincount(which, minlength=chain)))
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    fa, na = a
    fb, nb = b
    if fa.shape == fb.shape and (fa == fb).all() and (na == nb).all():
        return 1.0
    if not len(fa) or not len(fb):
        return 0.0
    if len(fa) > len(fb):
        fa, na, fb, nb = fb, nb, fa, na
    ua, ub = fa.view(np.uint64), fb.view(np.uint64)
    ca, cb = np.bitwise_count(ua).sum(axis=1, dtype=np.int64), np.bitwise_count(ub).sum(axis=1, dtype=np.int64)
    miss = 1 - 1 / (FILTER_BYTES * 8)
    best = np.zeros(len(ua))
    for i in range(len(ua)):
        shared = np.bitwise_count(ua[i] & ub).sum(axis=1, dtype=np.int64)
        most = np.minimum(ca[i], cb)
        pa_, pb = miss ** (HASHES * na[i]), miss ** (HASHES * nb)
        chance = FILTER_BYTES * 8 * (1 - pa_ - pb + pa_ * pb)
        cut = chance + CHANCE_MARGIN * np.maximum(most - chance, 0)
        best[i] = np.clip((shared - cut) / np.maximum(most - cut, 1e-9), 0, 1).max()
    return float(best.mean())


def to_string(d: tuple[np.ndarray, np.ndarray]) -> str:
    """Number of features of each filter, then the filters in base 64."""
    return ",".join(map(str, d[1].tolist())) + ":" + base64.b64encode(d[0].tobytes()).decode() if len(d[0]) else ""


def from_string(s: str) -> tuple[np.ndarray, np.ndarray]:
    if not s:
        return np.zeros((0, FILTER_BYTES), np.uint8), np.zeros(0, np.int64)
    counts, data = s.split(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, FILTER_BYTES), np.array(counts.split(","), np.int64)


def entropy_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level by its number of windows in the whole corpus (1001 sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("digest")
        count = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in chunks(batch, text_col, CHUNK_BYTES):
                buf, off = text_bytes(part.column(text_col))
                e = window_entropy(buf)
                edge = np.zeros(len(buf) + 1, np.int32)
                has = np.diff(off) >= WINDOW
                np.add.at(edge, off[:-1][has], 1)
                np.add.at(edge, off[1:][has] - WINDOW + 1, -1)
                count += np.bincount(e[np.cumsum(edge)[:len(e)] > 0], minlength=LEVELS)
        yield pa.record_batch([pa.array(np.arange(LEVELS), pa.int32()), pa.array(count)], names=["level", "n"])

    rows = docs.select(text_col).mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(LEVELS, np.int64)
    for r in rows:
        count[r["level"]] = r["n"]
    order = np.lexsort((np.arange(LEVELS), count))
    rank = np.empty(LEVELS, np.int32)
    rank[order] = np.arange(LEVELS)
    rank[:LEAST_ENTROPY] = LEVELS
    return rank


def digest_texts(texts: list[str], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out, lo = [], 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) <= CHUNK_BYTES:
            size += len(raw[hi])
            hi += 1
        off = np.append(0, np.cumsum([len(r) for r in raw[lo:hi]])).astype(np.int64)
        out += digests(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), off, rank)
        lo = hi
    return out


def fingerprint(docs: DataFrame, rank: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(entropy_ranks(docs, text_col) if rank is None else rank)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("digest")
        for batch in batches:
            for part in chunks(batch, text_col, CHUNK_BYTES):
                got = digests(*text_bytes(part.column(text_col)), shared.value)
                yield pa.record_batch([part.column(id_col), pa.array([to_string(d) for d in got], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the start of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_ROWS = ("part int, kind string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double, body string")
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _compare(texts: list[str], rank: np.ndarray) -> list[tuple]:
    """Results for all texts but the last, each with the one after it."""
    new = [edited(t, u) for t, u in zip(texts, texts[1:])]
    got = digest_texts(texts + new, rank)
    own, after = got[:len(texts)], got[len(texts):]
    return [(len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_string(a), to_string(b), likeness(a, b), likeness(a, c))
            for t, e, a, b, c in zip(texts, new, own, after, own[1:])]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text, and compare with the edited and the next one.

    Documents are range-partitioned and sorted by id.  A task finishes all its documents but its
    last, whose next one is the first of the following task; those few meet in a second step.
    """
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(entropy_ranks(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: int, what: str, ids: list, results: list[tuple] | None, bodies: list[str] | None, id_type) -> pa.RecordBatch:
        n = len(ids)
        cols = list(zip(*results)) if results else [[None] * n] * 6
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(ids, id_type), pa.array([part] * n, pa.int32()), pa.array([what] * n, pa.string()),
                                *[pa.array(c, t) for c, t in zip(cols, types)], pa.array(bodies or [None] * n, pa.string())],
                               names=[id_col, *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("digest")
        from pyspark import TaskContext
        part, ids, texts, id_type = TaskContext.get().partitionId(), [], [], None
        for batch in batches:
            for piece in chunks(batch, text_col, CHUNK_BYTES):
                id_type = piece.column(id_col).type
                if not ids and piece.num_rows:
                    yield rows(part, "first", piece.column(id_col)[:1].to_pylist(), None, [piece.column(text_col)[0].as_py() or ""], id_type)
                ids += piece.column(id_col).to_pylist()
                texts += [t or "" for t in piece.column(text_col).to_pylist()]
                if len(ids) > 1:
                    yield rows(part, "done", ids[:-1], _compare(texts, rank.value), None, id_type)
                    ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield rows(part, "last", ids, None, texts, id_type)

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    out = stage_table(ordered.mapInArrow(run, f"`{id_col}` {kind}, {_ROWS}"), "digest-rows")

    parts = out.filter("kind = 'first'").select("part")                # one narrow row a task
    everyone = Window.orderBy("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(everyone),
                                             F.min("part").over(everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    heads = out.filter("kind = 'first'").select(F.col("part").alias("_next"), F.col("body").alias("_head"))
    ends = out.filter("kind = 'last'").select(id_col, "part", "body").join(follow, "part").join(heads, "_next").select(id_col, "body", "_head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_compare([t, u], rank.value)[0] for t, u in zip(batch.column("body").to_pylist(), batch.column("_head").to_pylist())]
            if got:
                yield rows(0, "done", batch.column(id_col).to_pylist(), got, None, batch.column(id_col).type)

    edge = ends.mapInArrow(finish, f"`{id_col}` {kind}, {_ROWS}")
    keep = [id_col, *_NAMES[2:-1]]
    return out.filter("kind = 'done'").select(*keep).unionByName(edge.select(*keep))
