"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words.  Every word covered by a window whose word sequence also
starts in a document with a smaller id is removed; windows are judged on the input.

Each window is the head of a suffix.  Suffixes are partitioned by a prefix of variable length: its *anchor*
is the ``GRAM``-word run inside the window with the smallest hash (the first of equals), and the words up to
the end of the anchor are the prefix, between ``GRAM`` and ``WINDOW`` words long.  Equal windows have equal
prefixes.  About one run in twenty is an anchor, and a group whose anchor occurs in one document only
holds no repeat: it is never shuffled.

1. One scan counts the anchors: documents (smallest and largest id) and occurrences of each.
   Anchors in two documents or more, and among them those with more than ``GROUP`` occurrences, are
   handed on as bitmaps sized by their number; a chance hit costs a comparison, never a result.
2. A second scan sends the suffixes of repeated anchors to the task of their anchor, with their words: one row for
   each run of windows that share an anchor place.  There a group's suffixes are sorted by their words (told apart by
   their bytes) and the common-prefix lengths of neighbours computed.  Neighbours that share ``WINDOW`` words
   or more lie under one deep internal node of the group's suffix tree; the node's smallest id decides for them.
   Windows decided one after the other are the spans of maximal repeats.
3. Groups over ``GROUP`` occurrences do not fit one task's memory; their prefix is made as long as the window, so each
   node is a partition of its own, keyed by 128 bits of two independent hashes of its words.  Rows with the
   same words are merged first (smallest id, pre-aggregated before the shuffle), and what is decided for them is
   joined back, split by count, so a passage in a third of all documents meets many tasks and no group is
   ever gathered whole.

Cases: a null text has no words; texts under ``WINDOW`` words keep everything.  Rows that share an id
do not remove each other; rows equal in id and text get equal results.  A null id is neither
smaller nor larger than any: nothing of it is removed and it removes nothing.  Other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import bitmap_bits, bitmap_holds, enter, hash_bitmap, salted_join, stage_table
from tenderlake.llm.suffixes import suffix_array
from tenderlake.llm.textarrays import chunks, mix64, split_words, text_bytes, window_hashes, word_ids

WINDOW = 50
GRAM = 10
GROUP = 2000
SECOND = 0xA0761D6478BD642F      # of the second hash of a window's words


def anchored_windows(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor place: text, first window (in the text), number of windows, anchor hash."""
    grams = window_hashes(words, gram)
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    span = window - gram + 1
    place = np.uint64((1 << 32) - 1)                          # the hash's upper half, then the place: equals keep their order
    key = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    done, best = 1, key
    out, at = None, 0
    while True:                                                # minimum over ``span`` runs, by doubling
        if span & done:
            part = best[at:at + n]
            out = part if out is None else np.minimum(out, part)
            at += done
        if done * 2 > span:
            break
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    anchor = (out & place).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = doc[:n] == doc[window - 1:window - 1 + n]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[:n - 1])
    start = np.flatnonzero(opens)
    shut = valid.copy()
    shut[:-1] &= ~valid[1:] | opens[1:]
    stop = np.flatnonzero(shut) + 1
    owner = doc[start]
    return owner, start - first[owner], stop - start, grams[anchor[start]]


def _pieces(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    return chunks(batch, text_col)


def count_anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor, first_id, last_id, n`` over ``_id, _text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        for batch in batches:
            for part in _pieces(batch, "_text"):
                w = split_words(part.column("_text"))
                owner, _, _, anchor = anchored_windows(w.hash, w.first, window, gram)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), part.column("_id").take(pa.array(owner))], names=["anchor", "_id"])

    return (rows.select("_id", "_text").mapInArrow(run, "anchor bigint, _id bigint").groupBy("anchor")
            .agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.count("*").alias("n")))


_SUFFIXES = "anchor bigint, _id bigint, _h bigint, at int, words binary, large boolean"


def suffix_runs(rows: DataFrame, repeated: tuple[np.ndarray, int], large: tuple[np.ndarray, int], window: int, gram: int) -> DataFrame:
    """Runs of windows under repeated anchors with their words, each white space a blank."""
    shared = rows.sparkSession.sparkContext.broadcast((repeated, large))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        rep, big = shared.value
        for batch in batches:
            for part in _pieces(batch, "_text"):
                w = split_words(part.column("_text"))
                owner, at, many, anchor = anchored_windows(w.hash, w.first, window, gram)
                pick = np.flatnonzero(bitmap_holds(rep[0], anchor, rep[1]))
                owner, at, many, anchor = owner[pick], at[pick], many[pick], anchor[pick]
                lo = w.first[owner] + at
                raw = np.where((w.buf >= 9) & (w.buf <= 13), 0x20, w.buf).astype(np.uint8).tobytes() if len(pick) else b""
                body = [raw[a:b] for a, b in zip(w.start[lo].tolist(), w.end[lo + many + window - 2].tolist())]
                take = pa.array(owner)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), part.column("_id").take(take), part.column("_h").take(take),
                                       pa.array(at.astype(np.int32)), pa.array(body, pa.binary()), pa.array(bitmap_holds(big[0], anchor, big[1]))],
                                      names=["anchor", "_id", "_h", "at", "words", "large"])

    return rows.mapInArrow(run, _SUFFIXES)


_DECIDED = "_id bigint, _h bigint, a bigint, b bigint"


def _runs(who: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Consecutive windows of a row as ``_id, _h, a, b`` (first and last)."""
    order = np.lexsort((at, h, who))
    who, h, at = who[order], h[order], at[order]
    fresh = np.append(True, (who[1:] != who[:-1]) | (h[1:] != h[:-1]) | (at[1:] > at[:-1] + 1))[:len(at)]
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(at))[:len(start)] - 1
    return pa.record_batch([pa.array(x, pa.int64()) for x in (who[start], h[start], at[start], at[stop])], names=["_id", "_h", "a", "b"])


def deep_nodes(column: pa.Array, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes under internal nodes of ``window`` words or more: row, first word in the row, node.

    ``column``: the words of each row; only rows of one (ascending) ``group`` are compared.
    """
    w = split_words(column, hashes=False)
    ids, _ = word_ids(w)
    tree = suffix_array(ids, w.first, group, depth=window)
    deep = tree.common >= window                               # shares a node with the suffix before it
    under = deep | np.append(deep[1:], False)[:len(deep)]
    at = tree.order[under]
    row = np.searchsorted(w.first, at, "right") - 1
    return row, at - w.first[row], np.cumsum(~deep)[under]


def _subtrees(suffixes: DataFrame, window: int) -> DataFrame:
    """``_id, _h, a, b``: windows a to b of a row that also start in a smaller id, from whole anchor groups."""

    def decide(table: pa.Table) -> pa.RecordBatch:
        anchor = table.column("anchor").to_numpy()
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])[:len(anchor)]) - 1
        row, at, node = deep_nodes(table.column("words").combine_chunks(), group, window)
        who = table.column("_id").to_numpy()[row]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])[:len(node)])      # suffixes come node by node
        least = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(node)))) if len(node) else who
        hit = who > least
        return _runs(who[hit], table.column("_h").to_numpy()[row[hit]], table.column("at").to_numpy().astype(np.int64)[row[hit]] + at[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        held: list[pa.RecordBatch] = []                       # rows of the last anchor, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last or (held and held[0].column("anchor")[0].as_py() != anchor[0]):
                yield decide(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield decide(pa.Table.from_batches(held))

    return (suffixes.repartition("anchor").sortWithinPartitions("anchor")
            .select("anchor", "_id", "_h", "at", "words").mapInArrow(run, _DECIDED))


def _large_groups(suffixes: DataFrame, window: int) -> DataFrame:
    """The same for groups of any size: rows with equal words are merged, then every node is a partition of its own."""
    occur = suffixes.withColumn("ctx", F.unhex(F.sha2("words", 256)))
    contexts = occur.groupBy("ctx").agg(F.min("_id").alias("_least"), F.first("words").alias("words"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        for batch in batches:
            w = split_words(batch.column("words"))
            one, two = window_hashes(w.hash, window), window_hashes(mix64(w.hash ^ np.uint64(SECOND)), window)
            many = np.diff(w.first) - window + 1
            k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(w.first[:-1], many) + k
            take = pa.array(np.repeat(np.arange(batch.num_rows), many))
            yield pa.record_batch([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), batch.column("ctx").take(take),
                                   batch.column("_least").take(take), pa.array(k.astype(np.int32))], names=["node", "node2", "ctx", "_least", "k"])

    nodes = stage_table(contexts.select("words", "ctx", "_least").mapInArrow(explode, "node bigint, node2 bigint, ctx binary, _least bigint, k int"),
                        "substring-nodes")
    # a node of one context only is decided by that context's smallest id alone
    least = nodes.groupBy("node", "node2").agg(F.min("_least").alias("_first"))
    decided = (salted_join(nodes.select("node", "node2", "ctx", "k"), least, ["node", "node2"], F.col("ctx")).groupBy("ctx")
               .agg(F.array_sort(F.collect_list(F.struct("k", "_first"))).alias("_d")).select("ctx", F.col("_d._first").alias("_firsts")))
    places = stage_table(occur.groupBy("ctx", "_id", "_h").agg(F.collect_list("at").alias("_at")), "substring-places")      # bounded by the row's words
    both = salted_join(places, decided, ["ctx"], F.xxhash64("_id", "_h")).filter(F.array_min("_firsts") < F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for who, h, at, firsts in zip(*[batch.column(c).to_pylist() for c in ("_id", "_h", "_at", "_firsts")]):
                hit = np.flatnonzero(np.array(firsts) < who)
                win = np.unique((np.array(at, np.int64)[:, None] + hit[None, :]).ravel())
                for column, values in zip(out, (np.full(len(win), who), np.full(len(win), h), win)):
                    column.append(values)
            yield _runs(*map(np.concatenate, out))

    return both.select("_id", "_h", "_at", "_firsts").mapInArrow(run, _DECIDED)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``_id, _h, a, b``: word windows a to b (by first word) of a row (id and text hash) that also start in a smaller id."""
    rows = (docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h")))
    found = stage_table(count_anchors(rows, window, gram).filter("first_id < last_id").select("anchor", "n"), "substring-anchors")
    crowded = found.filter(F.col("n") > group)
    many = crowded.count()
    sized = [(rows_, bitmap_bits(n)) for rows_, n in ((found, found.count()), (crowded, many))]
    suffixes = suffix_runs(rows, *[(hash_bitmap(rows_, "anchor", bits), bits) for rows_, bits in sized], window, gram)
    small = _subtrees(suffixes.filter("NOT large"), window)
    if not many:
        return small
    return small.unionByName(_large_groups(stage_table(suffixes.filter("large"), "substring-large"), window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col, n_words, n_removed, kept`` (the kept words joined by one space)."""
    runs = repeated_windows(docs, window, gram, group, id_col, text_col)
    merged = (runs.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("_runs"))      # bounded by the document's words
              .select(F.col("_id").alias("_ri"), F.col("_h").alias("_rh"), F.col("_runs.a").alias("_a"), F.col("_runs.b").alias("_b")))
    texts = docs.select(id_col, F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"))
    own = (F.col(id_col).cast("bigint") == F.col("_ri")) & (F.col("_h") == F.col("_rh"))
    both = texts.join(merged, own, "left").select(id_col, "_text", "_a", "_b")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        for batch in batches:
            for part in _pieces(batch, "_text"):
                buf, off = text_bytes(part.column("_text"))
                raw = buf.tobytes()
                words, gone, kept = [], [], []
                for lo, hi, a, b in zip(off.tolist(), off[1:].tolist(), part.column("_a").to_pylist(), part.column("_b").to_pylist()):
                    own = raw[lo:hi].split()
                    words.append(len(own))
                    if a:
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, a, 1)
                        np.add.at(edge, np.array(b) + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        own = [w for w, s in zip(own, stay.tolist()) if s]
                    gone.append(words[-1] - len(own))
                    kept.append(b" ".join(own).decode())
                yield pa.record_batch([part.column(id_col), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                      names=[id_col, "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")
