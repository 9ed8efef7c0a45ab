"""Spelling variants by pivotal grams: words one edit apart, and the frequent form that each one varies.

Words come from maximal runs of ``[A-Za-zÀ-ÿ]``, A-Z lower-cased.  (The contract's slips: where the
CRC-32 of ``<doc_id>:<run>`` is a multiple of ``slip``, the run loses one code point.)  Words of at least
``min_length`` code points and ``min_count`` occurrences are compared; two are near if exactly one inserted, deleted or replaced
code point tells them apart.

Pivotal grams.  All bigrams have one global order: fewest words first.  A word's *prefix* holds the
bigrams that come first in that order, three or more (all places of the last one's bigram included).
Its *pivots* are two bigrams of the prefix that do not overlap, those that the fewest words hold, chosen by
dynamic programming.  One edit cannot touch both pivots, so near words r and s, r's prefix ending no later than
s's, share a pivot of r in the prefix of s: the left pivot at the same place from the left, or the right
pivot at the same place from the right.  The place limit is used whole: everything on that side of the pivot
must agree as well, so the key of the index is the word's head up to and with its left pivot, or its tail from its right
pivot on.  Each unordered pair is found once; Levenshtein verifies it.

A word's form is its near word of largest n (ties: smallest in code-point order), if that n is at
least ``ratio`` times its own; root follows forms to the last (n grows ``ratio``-fold each step, so there are no cycles and
pointer doubling ends after a few joins).

Scale: runs are cut, slipped and counted in the JVM with partial sums before the one shuffle; only distinct words go on.
The bigram counts are bounded by the alphabet (90 letters squared) and travel in one broadcast.  Index keys that
many words share are split by their count.

Cases: a null text has no words; a null id slips like an empty id text; rows that repeat count each.  Extra columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import UPPER, enter, salted_join, stage_table

RUN = "[A-Za-zÀ-ÿ]+"
SLIP = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
GRAM = 2
EDITS = 1
PREFIX = GRAM * EDITS + 1        # grams that near words cannot both miss


def _slipped(run: Column, id_text: Column, slip: int) -> Column:
    """The run, without the code point at hash modulo length where ``slip`` divides the hash."""
    h = F.crc32(F.concat(id_text, F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("bigint")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(slip)) == 0, cut).otherwise(run)


def count_words(docs: DataFrame, slip: int = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all documents."""
    if min_length < PREFIX + GRAM - 1:
        raise ValueError(f"words need {PREFIX + GRAM - 1} code points for {PREFIX} grams")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("_run"))
    lower = runs.select("_id", F.translate("_run", UPPER, UPPER.lower()).alias("_run")).filter(F.char_length("_run") >= min_length)
    words = lower.select(_slipped(F.col("_run"), F.col("_id"), slip).alias("word")).filter(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Every bigram with its place in the global order and the words that hold it: at most the alphabet squared."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)))
    grams = words.select("word", at.alias("_at")).select("word", F.substring(F.col("word"), F.col("_at"), F.lit(GRAM)).alias("gram")).distinct()
    counted = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()
    return {r["gram"]: (k, r["n"]) for k, r in enumerate(counted)}


def prefix_places(word: str, order: dict) -> list[int]:
    """Places of the grams of a word's prefix, in ascending place."""
    ranks = [order[word[i:i + GRAM]][0] for i in range(len(word) - GRAM + 1)]
    last = sorted(ranks)[min(PREFIX, len(ranks)) - 1]
    return [i for i, r in enumerate(ranks) if r <= last]


def pivots(word: str, places: list[int], order: dict, many: int = EDITS + 1) -> list[int]:
    """``many`` places among ``places`` whose grams do not overlap and are held by the fewest words, by dynamic programming.

    ``best[j]`` after place i: the least sum of j grams up to i, and their places.
    """
    best: list[list] = [[(0, [])] for _ in range(many + 1)]
    none = (float("inf"), [])
    for j in range(1, many + 1):
        best[j] = [none]
    for k, i in enumerate(places, 1):
        before = max((m for m in range(k) if m == 0 or places[m - 1] + GRAM <= i), default=0)
        cost = order[word[i:i + GRAM]][1]
        for j in range(1, many + 1):
            base = best[j - 1][before] if j > 1 else (0, [])
            best[j].append(min(best[j][k - 1], (base[0] + cost, [*base[1], i]), key=lambda x: (x[0], x[1])))
    return best[many][len(places)][1]


def index_keys(words: DataFrame, order: dict) -> DataFrame:
    """``word, n, last, pivot, head, key``: for every word the keys of its pivots and of all grams of its prefix.

    ``last``: the place of the prefix's last gram in the global order.  ``head``: the key is the word up to and with a
    gram, else from a gram on.  ``skip``: code points of the head up to and with the left pivot.
    """
    shared = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        names = ["word", "n", "last", "pivot", "head", "skip", "key"]
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                places = prefix_places(word, shared.value)
                last = max(shared.value[word[i:i + GRAM]][0] for i in places)
                left, right = pivots(word, places, shared.value)
                skip = left + GRAM
                out += [(word, n, last, True, True, skip, word[:skip]), (word, n, last, True, False, skip, word[right:])]
                for i in places:
                    out += [(word, n, last, False, True, 0, word[:i + GRAM]), (word, n, last, False, False, 0, word[i:])]
            types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, last int, pivot boolean, head boolean, skip int, key string")


def near_words(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every unordered pair of near words once."""
    keys = stage_table(index_keys(words, gram_order(words)), "spelling-keys")
    size = F.char_length("word").alias("size")
    r = keys.filter("pivot").select("head", "key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"),
                                    F.col("skip"), size.alias("size_a"))
    # the length class is part of the key: lengths differ by one at most
    r = r.withColumn("_size", F.explode(F.array(F.col("size_a") - 1, F.col("size_a"), F.col("size_a") + 1)))
    s = keys.filter("NOT pivot").select("head", "key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"), size.alias("_size"))
    met = salted_join(r, s, ["head", "key", "_size"], F.col("a"), over=2000)
    ordered = (F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b")))
    # a pair that meets in its heads is not counted again for its tails
    fresh = F.col("head") | (F.substring(F.col("a"), F.lit(1), F.col("skip")) != F.substring(F.col("b"), F.lit(1), F.col("skip")))
    return (met.filter(ordered & fresh & (F.levenshtein("a", "b", EDITS) == EDITS)).select("a", "n_a", "b", "n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form, by pointer doubling."""
    step = stage_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = salted_join(step, ahead, ["root"], F.col("word"), "left")
        if not moved.filter(F.col("_next").isNotNull()).limit(1).count():
            return step
        step = stage_table(moved.select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, slip: int = SLIP, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: ``word, form, root, n, n_near, form_n``."""
    words = stage_table(count_words(docs, slip, min_length, min_count, id_col, text_col), "spelling-words")
    pairs = stage_table(near_words(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min_by(F.struct("b", "n_b"), F.struct(-F.col("n_b"), F.col("b"))).alias("_best")
    near = both.groupBy(F.col("a").alias("_w")).agg(F.count("*").alias("n_near"), best)
    named = words.join(near, F.col("word") == F.col("_w"), "left").drop("_w")
    strong = F.col("_best.n_b") >= F.lit(ratio) * F.col("n")
    named = stage_table(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                     F.when(strong, F.col("_best.b")).alias("form"), F.when(strong, F.col("_best.n_b")).alias("form_n")), "spelling-forms")
    roots = _roots(named.filter(F.col("form").isNotNull())).withColumnRenamed("word", "_w")
    return (named.join(roots, F.col("word") == F.col("_w"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
