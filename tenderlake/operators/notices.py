"""Notice merge and notice counts.

``merge_notices`` is one hash aggregation on ``ocid``.  Every aggregate is
partial (map-side): ``max_by`` keeps one candidate per key and task,
``collect_set`` of phases holds at most the handful of phase values, so a
process with millions of notices still costs one small row per map task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S


KEY, ORDER, PHASE = "ocid", ("ts", "notice_id"), "phase"


def _present(path: str, kind: T.DataType) -> Column:
    c = F.col(path)
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != F.lit(""))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def _merged(path: str, kind: T.DataType) -> Column:
    """Latest present value by (ts, notice_id); structs are merged field by field, NULL when nothing is present."""
    if isinstance(kind, T.StructType):
        parts = [_merged(f"{path}.`{f.name}`", f.dataType).alias(f.name) for f in kind.fields]
        some = functools.reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
        return F.when(some, F.struct(*parts))
    return F.max_by(F.col(path), F.when(_present(path, kind), F.struct(*ORDER)))


def merge_aggregates(schema: T.StructType | None = None) -> list[Column]:
    """Aggregates of the merge for a notice schema, flat or release-shaped (nested ``tender``, ``buyer``).

    ``phase`` values are unioned into ``tag``; every other field, at any depth of structs, takes its
    latest value by (ts, notice_id) among the notices where it is present: non-NULL, strings also
    non-empty, arrays also non-empty.  So an absent or empty field never erases an earlier value, and
    ``awards`` come from the latest notice that has some."""
    fields = (schema or S.NOTICE).fields
    aggs = [F.array_sort(F.collect_set(PHASE)).alias("tag")]
    aggs += [_merged(f"`{f.name}`", f.dataType).alias(f.name) for f in fields if f.name not in (KEY, PHASE, *ORDER)]
    aggs += [F.count(F.lit(1)).alias("n_notices"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    return aggs


def merge_notices(notices: DataFrame) -> DataFrame:
    """Notices of one OCID -> one release (D8): tag is the union of phases;
    other fields take the latest present value; arrival order is irrelevant."""
    return notices.groupBy(KEY).agg(*merge_aggregates(notices.schema))


def value_leaves(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    """Path and type of every field that a notice's state keeps as ``v<k>``, in the order of k."""
    return _leaves(schema.fields)


def _leaves(fields, path: str = "") -> list[tuple[str, T.DataType]]:
    """Paths and types of all fields that are not structs, outside the key, phase and order columns."""
    out: list[tuple[str, T.DataType]] = []
    for f in fields:
        here = f"{path}.`{f.name}`" if path else f"`{f.name}`"
        if not path and f.name in (KEY, PHASE, *ORDER):
            continue
        out += _leaves(f.dataType.fields, here) if isinstance(f.dataType, T.StructType) else [(here, f.dataType)]
    return out


def notice_state(notices: DataFrame) -> DataFrame:
    """Partial merge of some notices: ``ocid, tag, n_notices, first_ts, last_ts`` and, for the k-th leaf field, ``v<k>``, its latest
    present value with the (ts, notice_id) that it came with."""
    aggs = []
    for k, (path, kind) in enumerate(_leaves(notices.schema.fields)):
        here = F.struct(*ORDER, F.col(path).alias("value"))
        aggs.append(F.max_by(here, F.when(_present(path, kind), F.struct(*ORDER))).alias(f"v{k}"))
    return notices.groupBy(KEY).agg(F.array_sort(F.collect_set(PHASE)).alias("tag"), F.count(F.lit(1)).alias("n_notices"),
                                    F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *aggs)


def combine_states(states: DataFrame) -> DataFrame:
    """Any partial merges, several for an OCID, as one for each OCID."""
    values = [c for c in states.columns if c[:1] == "v" and c[1:].isdigit()]
    known = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(F.col(f"{v}.ts"), F.col(f"{v}.notice_id")))).alias(v) for v in values]
    return states.groupBy(KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tag")))).alias("tag"),
                                   F.sum("n_notices").alias("n_notices"), F.min("first_ts").alias("first_ts"),
                                   F.max("last_ts").alias("last_ts"), *known)


def merge_states(state: DataFrame, more: DataFrame) -> DataFrame:
    """Two partial merges as one; associative and commutative, so days can come in any order and grouping.

    Notices must not be in both: they would count twice in ``n_notices`` (values and times would stay right)."""
    return combine_states(state.unionByName(more))


def _rebuilt(fields, count, top: bool = True) -> list[Column]:
    out = []
    for f in fields:
        if top and f.name in (KEY, PHASE, *ORDER):
            continue
        if isinstance(f.dataType, T.StructType):
            parts = _rebuilt(f.dataType.fields, count, top=False)
            some = functools.reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
            out.append(F.when(some, F.struct(*parts)).alias(f.name))
        else:
            out.append(F.col(f"v{next(count)}.value").alias(f.name))
    return out


def finish_state(state: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The releases of a merged state, in the columns of ``merge_notices`` (``schema``: that of the notices)."""
    import itertools
    return state.select(KEY, "tag", *_rebuilt((schema or S.NOTICE).fields, itertools.count()), "n_notices", "first_ts", "last_ts")


def lifecycle_state(tag: Column, status: Column) -> Column:
    """``open``: tender without award and status active; ``closed``: tender and award (H8)."""
    has_tender = F.array_contains(tag, F.lit("tender"))
    has_award = F.array_contains(tag, F.lit("award"))
    return (F.when(has_tender & has_award, F.lit("closed"))
             .when(has_tender & ~has_award & (status == F.lit("active")), F.lit("open"))
             .otherwise(F.lit("other")))


def daily_phase_counts(notices: DataFrame) -> DataFrame:
    """Publications per UTC day and phase (batch twin of the streaming S3 job)."""
    return (notices.filter(F.col("phase").isNotNull())
                   .groupBy(F.window("ts", "1 day").alias("w"), "phase")
                   .agg(F.count(F.lit(1)).alias("n"))
                   .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "phase", "n"))
