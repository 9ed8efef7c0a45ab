"""Quality rules on repetition: a suffix array of words, its common-prefix intervals, and limits on what they cover.

The word sequence of a text gets a suffix array (prefix doubling: suffixes are ranked by their first
1, 2, 4, ... words; only those that still share their rank go on) and the common-prefix length of every two neighbours.
An interval of neighbours that share ``least`` words or more is a repeated word sequence that cannot be extended
to the right; if its occurrences follow different words it cannot be extended to the left either: a
*maximal repeat*.  The spans of all occurrences of maximal repeats are united.  A text is kept if they cover at most
``max_covered`` (a fraction) of its words and the longest repeat has at most ``max_longest`` words.  (Each suffix lies in one
deepest interval, whose span holds those of the others, so the union needs one span a suffix.)

Base rules come from the same arrays: words in 3-word windows that occur twice or more, code points in words,
symbols, and repeated lines; a text with under ``MIN_WORDS`` words, or more than half of them in such windows, fails.

Scale: one pass, no shuffle; texts of a chunk share one suffix array (a text's suffixes are ranked apart), about 1 MB at a
time or one longer text.  Words are told apart by their bytes, not by a hash alone.  Memory is a few
numbers a word, and one more for each doubling while anything repeats.

Cases: a null, empty or blank text has no words, zero counts, fails the base rules and is not kept.  Repeated rows and ids get equal
results; a null id is passed on.  Columns besides id and text are ignored, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenderlake.llm.common import enter, once
from tenderlake.llm.suffixes import Suffixes, suffix_array
from tenderlake.llm.textarrays import Words, chunks, split_words, text_bytes, word_ids

MIN_WORDS = 50
REPEAT_WORDS = 3                 # the base rule's windows
LEAST = 16                       # words of the shortest repeat that counts: a sentence; single lines may occur again
MAX_COVERED = 0.2                # of a text's words
MAX_LONGEST = 50                 # words
_SYMBOLS = b"#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"


def maximal_repeats(suffixes: Suffixes, ids: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``depth, lo, hi``: maximal repeats of ``depth >= least`` words; their occurrences are ``order[lo:hi]``."""
    order, common = suffixes.order, suffixes.common
    before = np.append(-1, ids)[order]                         # the word before each suffix; a first word follows none
    starts = np.isin(order, first[:-1])
    before[starts] = -1 - order[starts]
    change = np.append(0, np.cumsum(before[1:] != before[:-1])) if len(order) else np.zeros(0, np.int64)
    out = []
    long = np.flatnonzero(common >= least)
    runs = np.flatnonzero(np.append(True, long[1:] != long[:-1] + 1)[:len(long)])
    for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(long)]):
        stack: list[tuple[int, int]] = []                      # depth, first place
        lo, hi = int(long[a]), int(long[b - 1])
        for i, depth in zip(range(lo, hi + 2), [*common[lo:hi + 1].tolist(), 0]):
            place = i - 1
            while stack and stack[-1][0] > depth:
                d, place = stack.pop()
                if change[i - 1] > change[place]:
                    out.append((d, place, i))
            if depth >= least and (not stack or stack[-1][0] < depth):
                stack.append((depth, place))
    return out


def covered(suffixes: Suffixes, least: int) -> np.ndarray:
    """Which words lie in an occurrence of a repeat of ``least`` words or more; also the longest repeat at each suffix."""
    common = suffixes.common
    reach = np.maximum(common, np.append(common[1:], 0)[:len(common)])
    reach[reach < least] = 0
    edge = np.zeros(len(common) + 1, np.int64)
    np.add.at(edge, suffixes.order, (reach > 0).astype(np.int64))
    np.add.at(edge, suffixes.order + reach, -(reach > 0).astype(np.int64))
    longest = np.zeros(len(common), np.int64)
    longest[suffixes.order] = reach
    return np.cumsum(edge[:-1]) > 0, longest


def _in_windows(suffixes: Suffixes, first: np.ndarray) -> np.ndarray:
    """Words in windows of three words that their text holds twice or more."""
    n = len(suffixes.order)
    inside = np.zeros(n, bool)
    if len(suffixes.ranks) < 2:
        return inside                                          # not even two words repeat
    one, two = suffixes.ranks[0].astype(np.int64), suffixes.ranks[1].astype(np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.bincount(two, minlength=n)[two] > 1)
    at = at[at + REPEAT_WORDS <= end[at]]
    _, which, many = np.unique(two[at] * n + one[np.minimum(at + 2, n - 1)], return_inverse=True, return_counts=True)
    at = at[many[which] > 1]
    for k in range(REPEAT_WORDS):
        inside[at + k] = True
    return inside


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[first[1:]] - total[first[:-1]]


def _symbol_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(_SYMBOLS)] = True
    return t


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    return len(lines) - len(set(lines))


def measure(column: pa.Array, least: int = LEAST) -> dict[str, np.ndarray]:
    """The measures of every text of a string column."""
    w: Words = split_words(column, hashes=False)
    ids, _ = word_ids(w)
    suffixes = suffix_array(ids, w.first)
    inside, longest = covered(suffixes, least)
    repeats = maximal_repeats(suffixes, ids, w.first, least)
    texts = len(w.first) - 1
    owner = np.repeat(np.arange(texts), np.diff(w.first))
    off = text_bytes(column)[1]
    starts = (w.buf & 0xC0) != 0x80                            # first bytes of code points
    points = np.append(0, np.cumsum(starts, dtype=np.int64))
    sizes = points[w.end] - points[w.start]
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, owner, longest)
    return {
        "n_words": np.diff(w.first), "word_chars": _sums(sizes, w.first), "n_symbols": _sums(once("symbol-table", _symbol_table)[w.buf], off),
        "n_dup_lines": np.array([_dup_lines(t) for t in column.to_pylist()], np.int64), "n_repeat_words": _sums(_in_windows(suffixes, w.first), w.first),
        "n_covered": _sums(inside, w.first), "longest_repeat": most,
        "n_repeats": np.bincount(owner[suffixes.order[[lo for _, lo, _ in repeats]]] if repeats else np.zeros(0, np.int64), minlength=texts).astype(np.int64)}


def repeated_spans(text: str, least: int = LEAST) -> list[tuple[int, int]]:
    """The united spans of a text's maximal repeats, as first word and word after the last."""
    w = split_words(pa.array([text], pa.string()), hashes=False)
    inside, _ = covered(suffix_array(word_ids(w)[0], w.first), least)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats"]


def judge(docs: DataFrame, least: int = LEAST, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``COUNTS``, ``base_failed, kept``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repetition")
        for batch in batches:
            for part in chunks(batch, text_col):
                m = measure(part.column(text_col), least)
                n = m["n_words"]
                failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * n)
                kept = ~failed & (m["n_covered"] <= max_covered * n) & (m["longest_repeat"] <= max_longest)
                yield pa.record_batch([part.column(id_col), *[pa.array(m[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(kept)],
                                      names=[id_col, *COUNTS, "base_failed", "kept"])

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {counts}, base_failed boolean, kept boolean")
