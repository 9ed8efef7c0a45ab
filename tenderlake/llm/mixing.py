"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Built-in functions only.  A document's size is its number of words.  The sources share the sum of
all sizes by weight; a source whose share exceeds ``max_epochs`` times its own size is clamped
there and the excess goes to the others by weight, until none is above.

A source with target / size = w + f is taken w times whole; the fraction f of its words comes by
size class (powers of two), long documents first: each class gives f of its words, plus or less what
the longer classes left open, in a seeded order of its documents: a document's bin is 12 bits of an MD5 of
seed and id, and whole bins are taken in order while the sum of their sizes stays within that, and the next
one if it brings the sum nearer.  So a document that is too long for the rest never ends the filling, and
what it leaves open is made good by shorter ones.  What is open at last is closed by one more document, or
one less: the one whose size is nearest to it, if that brings the sum nearer.

All classes are cut on one histogram of at most 4096 bins a source and class (some twenty classes; every
document is counted, pre-aggregated before the shuffle), so a source that holds a third of all rows is never
gathered in one task.  Sources are ranked by code point within range partitions plus offsets, not in one
global window.

Cases: a null or empty text has size 0 and is taken 0 times in words (it repeats as its source
does, with f by its draw); a null source is a source of its own, last in order; a source of size 0 has target 0;
without any words all targets are 0.  Equal rows share their draw, so reruns agree and repeated
rows are taken alike.  Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import WORD_PATTERN, salted_join, stage_table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
BINS = 4096                      # 12 bits of an MD5
SPLIT = 20_000                   # rows of one source that meet its plan in one task


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")


def draw(id_col: Column, seed: int) -> Column:
    """The seeded bin of a document."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")


def size_class(size: Column) -> Column:
    """Floor of the binary logarithm, -1 for no words."""
    return (F.length(F.bin(size)) - F.when(size == 0, 2).otherwise(1)).cast("int")


def _rank_sources(src: DataFrame) -> DataFrame:
    """Add ``_rank`` (0-based, by code point, null last)."""
    order = F.col("source").asc_nulls_last()
    parts = stage_table(src.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()), "mix-sources")
    sizes = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_pid", before.alias("_before"))            # a row for each range partition
    inner = F.row_number().over(Window.partitionBy("_pid").orderBy(order))
    return (parts.withColumn("_rn", inner).join(offsets, "_pid")
            .withColumn("_rank", F.col("_before") + F.col("_rn") - 1).drop("_pid", "_rn", "_before"))


def water_fill(src: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Each round is one aggregate over the sources; only two sums reach the driver.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    src = stage_table(_rank_sources(src).select("source", "source_size", w.cast("bigint").alias("_w")), "mix-weights")
    cap = F.col("source_size") * F.lit(int(max_epochs))
    total, weight = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    rest, free = total, weight
    while free:
        share = F.col("_w") * F.lit(float(rest)) / F.lit(float(free))
        capped = src.filter(cap < share).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if (total - capped[0], weight - capped[1]) == (rest, free):
            break
        rest, free = total - capped[0], weight - capped[1]
    share = F.col("_w") * F.lit(float(rest)) / F.lit(float(free or 1))
    return src.select("source", "source_size", F.least(cap.cast("double"), share).alias("target"))


def _null_safe(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.withColumnRenamed("source", "_src")
    return a.join(b, F.col("source").eqNullSafe(F.col("_src")), how).drop("_src")


def _class_bins(sized: DataFrame) -> DataFrame:
    """``source, _classes``: for every size class, long ones first, its bins and the words up to each (at most ``BINS``)."""
    hist = sized.filter("_class >= 0").groupBy("source", "_class", "_draw").agg(F.sum("_size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("source", "_class").orderBy("_draw"))
    bins = F.array_sort(F.collect_list(F.struct("_draw", "_upto"))).alias("_bins")
    classes = hist.withColumn("_upto", upto).groupBy("source", "_class").agg(bins)
    return classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_class", "_bins")), asc=False).alias("_classes"))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fill(f: Column, state: Column, one: Column) -> Column:
    """One size class: what it gives of the open words ``state.gap`` and of its own fraction; adds its cut to ``state.cuts``."""

    def end(uptos, open_, within, base, over):
        words, want = F.element_at(uptos, -1), F.greatest(open_, F.lit(0.0))
        nearer = base + over - want < want - base
        taken = F.when(over.isNull(), words).otherwise(base + F.when(nearer, over).otherwise(F.lit(0)))
        cut = F.when(over.isNull(), F.lit(BINS)).otherwise(F.get(one["_bins"]["_draw"], within) + nearer.cast("int"))
        return F.struct((open_ - taken).alias("gap"), F.concat(state["cuts"], F.array(F.struct(one["_class"].alias("key"), cut.alias("value")))).alias("cuts"))

    # ``within``: bins whose words up to there are wanted; ``over``: the words of the next bin, null if there is none
    def cut_at(uptos, open_):
        return _let(F.size(F.filter(uptos, lambda u: u <= F.greatest(open_, F.lit(0.0)))), lambda within:
                    _let(F.when(within == 0, F.lit(0).cast("bigint")).otherwise(F.get(uptos, within - 1)), lambda base:
                         _let(F.get(uptos, within) - base, lambda over: end(uptos, open_, within, base, over))))

    return _let(one["_bins"]["_upto"], lambda uptos: _let(state["gap"] + f * F.element_at(uptos, -1), lambda open_: cut_at(uptos, open_)))


def _within(drawn: Column, kind: Column) -> Column:
    return drawn < F.coalesce(F.element_at("_cuts", kind), F.lit(0))


def plan_sources(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each source: ``source, source_size, target, _whole, _cuts, _close``.

    ``sized``: ``_id, source, _size, _draw, _class`` of every document.
    """
    src = water_fill(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, max_epochs)
    safe = F.greatest(F.col("source_size"), F.lit(1))
    src = (src.withColumn("_whole", F.floor(F.col("target") / safe))
           .withColumn("_f", (F.col("target") - F.col("_whole") * F.col("source_size")) / safe))
    src = _null_safe(src, _class_bins(sized), "left")
    empty = F.array(F.struct(F.lit(-1).alias("key"), F.floor(F.col("_f") * BINS).cast("int").alias("value")))
    none = F.expr("CAST(array() AS array<struct<_class:int,_bins:array<struct<_draw:int,_upto:bigint>>>>)")
    filled = F.aggregate(F.coalesce("_classes", none), F.struct(F.lit(0.0).alias("gap"), empty.alias("cuts")),
                         lambda state, one: _fill(F.col("_f"), state, one))
    src = stage_table(src.withColumn("_s", filled).select("source", "source_size", "target", "_whole", F.col("_s.gap").alias("_gap"),
                                                          F.map_from_entries("_s.cuts").alias("_cuts")), "mix-targets")
    # One more document (or one less) closes the gap: the nearest in size.
    miss = F.abs(F.col("_size") - F.abs("_gap"))
    close = (salted_join(sized, src.select("source", "_cuts", "_gap"), ["source"], F.col("_id"), over=SPLIT)
             .filter((_within(F.col("_draw"), F.col("_class")) == (F.col("_gap") < 0)) & (miss < F.abs("_gap")))
             .groupBy("source")
             .agg(F.min_by(F.struct("_id"), F.struct(miss, F.col("_draw"), F.col("_id"))).alias("_close")))
    return stage_table(_null_safe(src.drop("_gap"), close, "left"), "mix-plan")


def _repeats(id_col: Column, drawn: Column, kind: Column) -> Column:
    chosen = F.col("_close").isNotNull() & id_col.eqNullSafe(F.col("_close._id"))
    return F.col("_whole").cast("bigint") + (_within(drawn, kind) != chosen).cast("bigint")


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                        n_words(F.col(text_col)).alias("_size"), draw(F.col(id_col), seed).alias("_draw"))
    return stage_table(sized.withColumn("_class", size_class(F.col("_size"))), "mix-sizes")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, repeats, taken``."""
    sized = _sized(docs, seed, id_col, text_col, source_col)
    rows = salted_join(sized, plan_sources(sized, weights, max_epochs), ["source"], F.col("_id"), over=SPLIT)
    repeats = _repeats(F.col("_id"), F.col("_draw"), F.col("_class"))
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
                       repeats.alias("repeats"), (F.col("_size") * repeats).alias("taken"))


def take_mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken (all columns unchanged)."""
    sized = _sized(docs, seed, id_col, text_col, source_col)
    plan = plan_sources(sized, weights, max_epochs)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col(source_col).alias("source"))
    keyed = keyed.withColumn("_kind", size_class(n_words(F.col(f"_doc.{text_col}"))))
    rows = salted_join(keyed, plan, ["source"], F.col(f"_doc.{id_col}"), over=SPLIT, counted=sized)
    repeats = _repeats(F.col(f"_doc.{id_col}"), draw(F.col(f"_doc.{id_col}"), seed), F.col("_kind"))
    return (rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), repeats.cast("int")))).select("_doc.*"))
