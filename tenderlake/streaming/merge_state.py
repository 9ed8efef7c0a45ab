"""S1 on keyed state with timers: the notice merge whose state forgets quiet processes, without changing any result.

``merge_state_stream`` keeps, per OCID and part, the partial merge of ``operators.notices`` (``transformWithState``,
RocksDB state store).  Each micro-batch that touches an (ocid, part) emits its whole partial merge so far.  A timer
clears an (ocid, part) that has had no notice for a while (sooner when its notices say that the process is closed);
a later correction opens a new state under a new ``opened_by``.

The grouping key is a bucket of (ocid, part)s, by hash: a call to the state store costs the Python worker far more than
the fold of a notice, so a bucket's states are read once and written once a micro-batch, with one timer at the earliest
time that one of them is due; they are kept as one array a field, which are much cheaper to pass than rows in rows.  A micro-batch of few notices rewrites the whole buckets it touches, so a bucket should hold
some tens of states: ``buckets_for`` gives their number, and it grows with the notices.

So one process may have several partial merges over time, and ``read_states`` makes its release out of them:

* of one (ocid, part, opened_by) the row with most notices is the newest, since every emission adds notices;
* the newest ones are merged by ``notices.combine_states``, which is associative.

No row needs an epoch or a generation: a batch that is written twice after a failure changes nothing, and a new
checkpoint goes on beside the old rows, with ``initial_states`` or without, as long as it reads new files only.  When a
state is cleared never matters to the result, so timers follow the processing time and no notice is too late.

A bucket's notices are folded one by one from an iterator, so memory does not depend on their number but on its states, and a
hot process is spread over ``parts`` buckets.  A notice delivered twice counts twice (S4 comes first); notices need ids: they name the states.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tenderlake.operators.notices import KEY, ORDER, PHASE, combine_states, finish_state, value_leaves

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 4
BUCKETS = 4096
PER_BUCKET = 128
HOUR = 3_600_000
FIXED = 8                                     # fields of a state before its leaves


def buckets_for(notices: int) -> int:
    """Buckets for a stream that is to bring about so many notices: at most some ``PER_BUCKET`` states in each."""
    return max(PER_BUCKET, -(-notices // PER_BUCKET))


def _state_type(schema: T.StructType) -> T.StructType:
    """The state of one (ocid, part): counts, times in microseconds, phases, and each leaf's latest value with its order."""
    ids = schema["notice_id"].dataType
    fields = [T.StructField(KEY, T.StringType()), T.StructField("part", T.IntegerType()),
              T.StructField("opened_by", T.StringType()), T.StructField("n_notices", T.LongType()), T.StructField("first_ts", T.LongType()),
              T.StructField("last_ts", T.LongType()), T.StructField("tag", T.ArrayType(T.StringType())), T.StructField("seen", T.LongType())]
    for k, (_, kind) in enumerate(value_leaves(schema)):
        fields.append(T.StructField(f"v{k}", T.StructType([T.StructField("ts", T.LongType()), T.StructField("notice_id", ids),
                                                           T.StructField("value", kind)])))
    return T.StructType(fields)


def _bucket_type(state_type: T.StructType) -> T.StructType:
    """The states of one bucket: an array for each field, three for each leaf (its value is null if the leaf has none)."""
    flat = [(f"{f.name}_{x.name}", x.dataType) for f in state_type[FIXED:] for x in f.dataType]
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in [(f.name, f.dataType) for f in state_type[:FIXED]] + flat])


def _plain(value):
    """Rows at any depth as tuples, which the state store takes back."""
    if isinstance(value, (tuple, list)):
        return (tuple if isinstance(value, tuple) else list)(map(_plain, value))
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


class _Merge(StatefulProcessor):
    """Folds the notices of one bucket into the states of its (ocid, part)s."""

    def __init__(self, state_type: T.StructType, columns: list[str], quiet_ms: int, closed_quiet_ms: int):
        self.state_type, self.columns, self.quiet_ms, self.closed_quiet_ms = state_type, columns, quiet_ms, closed_quiet_ms
        self.bucket_type = _bucket_type(state_type)
        self.leaves = range(FIXED, len(self.bucket_type), 3)
        self.nested = [j for j, f in enumerate(self.bucket_type) if j >= FIXED and isinstance(f.dataType.elementType, (T.ArrayType, T.MapType))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", self.bucket_type)

    def _known(self) -> dict:
        """The bucket's states by (ocid, part): tuples in the order of the bucket type."""
        if not self.state.exists():
            return {}
        fields = list(self.state.get())
        for j in self.nested:
            fields[j] = _plain(fields[j])
        return {s[:2]: s for s in zip(*fields)}

    def _keep(self, states) -> None:
        self.state.update(tuple(map(list, zip(*states))))

    def _due(self, states) -> int | None:
        """When the first of some states is to go."""
        return min((s[7] + (self.closed_quiet_ms if s[6] and "tender" in s[6] and "award" in s[6] else self.quiet_ms) for s in states), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rank = lambda ts, i: (ts is not None, ts or 0, i is not None, i or 0)  # noqa: E731  nulls come first
        now = timerValues.getCurrentProcessingTimeInMs()
        states = self._known()
        before = self._due(states.values())
        touched, least = {}, {}
        for row in rows:
            name = (row[KEY], row["part"])
            state = touched.get(name)
            if state is None:
                known = states.get(name)
                state = touched[name] = list(known or (*name, None, 0, None, None, [], now, *[None] * (3 * len(self.columns))))
                state[6], state[7] = set(state[6] or []), now
            ts, i = row["ts"], row["notice_id"]
            here = rank(ts, i)
            state[3] += 1
            if ts is not None:
                state[4], state[5] = ts if state[4] is None else min(state[4], ts), ts if state[5] is None else max(state[5], ts)
            if row["phase"] is not None:
                state[6].add(row["phase"])
            if name not in states and (name not in least or here < least[name]):
                least[name] = here
                state[2] = f"{i}@{ts}"
            for j, c in zip(self.leaves, self.columns):
                value = row[c]
                if value is None or (isinstance(value, (str, list, dict)) and not value):
                    continue
                if state[j + 2] is None or here > rank(state[j], state[j + 1]):
                    state[j:j + 3] = ts, i, value
        for name, state in touched.items():
            state[6] = sorted(state[6])
            states[name] = tuple(state)
        self._keep(states.values())
        due = self._due(states.values())
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        out = Row(*self.state_type.names)
        for s in touched.values():
            yield out(*s[:FIXED], *[None if s[j + 2] is None else tuple(s[j:j + 3]) for j in self.leaves])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """One timer a bucket: the states that are due go, and it moves on to the first of the others."""
        now, states = timerValues.getCurrentProcessingTimeInMs(), self._known()
        left = [s for s in states.values() if self._due([s]) > now]
        if not left:
            self.state.clear()
        else:
            if len(left) < len(states):
                self._keep(left)
            self.handle.registerTimer(self._due(left))
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """All of a bucket's states at once, in the columns of the bucket type."""
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.state.exists():
            states = [(*s[:7], now, *s[8:]) for s in zip(*(initialState[name] for name in self.bucket_type.names))]
            self._keep(states)
            self.handle.registerTimer(self._due(states))

    def close(self) -> None:
        pass


def merge_state_stream(notices: DataFrame, quiet_ms: int = 30 * 24 * HOUR, closed_quiet_ms: int = 24 * HOUR, parts: int = PARTS,
                       initial: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Partial merges of the touched (ocid, part)s (update mode): ``ocid, part, opened_by, n_notices, first_ts, last_ts, tag, v<k>...``.

    ``quiet_ms``: processing time without a notice after which an (ocid, part)'s state is cleared; ``closed_quiet_ms``: the same once it
    has seen a tender and an award.  ``initial``: rows of ``initial_states`` for a new checkpoint.  ``buckets``: see ``buckets_for``."""
    leaves = value_leaves(notices.schema)
    kinds = _state_type(notices.schema)
    columns = [f"_v{k}" for k in range(len(leaves))]
    bucket = F.pmod(F.xxhash64(KEY, "part"), F.lit(buckets)).alias("bucket")
    flat = notices.select(KEY, F.pmod(F.xxhash64("notice_id"), F.lit(parts)).cast("int").alias("part"), F.col("notice_id"),
                          F.unix_micros("ts").alias("ts"), F.col(PHASE), *[F.col(path).alias(c) for (path, _), c in zip(leaves, columns)])
    if initial is not None:
        flat_leaves = [(F.unix_micros(f"{v}.ts") if x == "ts" else F.col(f"{v}.{x}")).alias(f"{v}_{x}")
                       for v in kinds.names[FIXED:] for x in ("ts", "notice_id", "value")]
        one = initial.dropDuplicates([KEY, "part"]).select(
            KEY, "part", "opened_by", "n_notices", F.unix_micros("first_ts").alias("first_ts"), F.unix_micros("last_ts").alias("last_ts"),
            "tag", F.lit(0).cast("long").alias("seen"), *flat_leaves)
        initial = (one.groupBy(bucket).agg(F.collect_list(F.struct(*one.columns)).alias("s"))
                      .select("bucket", *[F.col(f"s.{c}").alias(c) for c in one.columns]).groupBy("bucket"))
    states = flat.select("*", bucket).groupBy("bucket").transformWithState(
        statefulProcessor=_Merge(kinds, columns, quiet_ms, closed_quiet_ms), outputStructType=kinds, outputMode="Update",
        timeMode="ProcessingTime", initialState=initial)
    back = [F.when(F.col(v).isNotNull(), F.struct(F.timestamp_micros(f"{v}.ts").alias(ORDER[0]), F.col(f"{v}.notice_id"), F.col(f"{v}.value"))).alias(v)
            for v in kinds.names if v[:1] == "v"]
    return states.select(KEY, "part", "opened_by", "n_notices", F.timestamp_micros("first_ts").alias("first_ts"),
                         F.timestamp_micros("last_ts").alias("last_ts"), "tag", *back)


def start_merge_states(states: DataFrame, target: str, checkpoint: str, every: str = "1 minute", trigger_once: bool = False):
    """Append every emission of ``merge_state_stream`` to the Parquet folder ``target``; returns the running query.

    The query uses the RocksDB state store, whatever the session uses elsewhere.  ``every``: the trigger, at which timers fire too.
    With ``trigger_once`` the query ends with the last file that is there; timers then fire in batches that have
    notices only (a batch for timers alone would always be followed by the next)."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("append").parquet(target)

    spark, w = states.sparkSession, states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if trigger_once:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime=every)).start()     # takes the settings along
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def newest_states(spark: SparkSession, *folders: str) -> DataFrame:
    """The newest row of each state ever opened (partial aggregation before the shuffle)."""
    df = spark.read.parquet(*folders)
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.col("n_notices"))
    return df.groupBy(KEY, "part", "opened_by").agg(row.alias("r")).select("r.*")


def read_states(spark: SparkSession, *folders: str, schema: T.StructType | None = None) -> DataFrame:
    """The releases of everything emitted so far, in the columns of ``merge_notices`` (``schema``: that of the notices)."""
    return finish_state(combine_states(newest_states(spark, *folders).drop("part", "opened_by")), schema)


def initial_states(spark: SparkSession, *folders: str, since=None) -> DataFrame:
    """One state for each (ocid, part) to go on with in a new checkpoint: the one with the latest notice, ``since`` a time or from ever."""
    newest = newest_states(spark, *folders)
    if since is not None:
        newest = newest.filter(F.col("last_ts") >= F.lit(since))
    row = F.max_by(F.struct(*[F.col(c) for c in newest.columns]), F.struct("last_ts", "opened_by"))
    return newest.groupBy(KEY, "part").agg(row.alias("r")).select("r.*")


def compact_states(spark: SparkSession, target: str, out: str) -> str:
    """Periodic job: the newest row of each state once; ``read_states(spark, out, target)`` stays right beside later rows."""
    newest_states(spark, target).write.mode("errorifexists").parquet(out)
    return out
