"""Notice merge and count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.operators.notices import (daily_phase_counts, finish_state, lifecycle_state, merge_notices, merge_states,
                                          notice_state)
from tenderlake.plans.oracle_views import with_views
from tenderlake.plans.registry import query, r6
from tenderlake.session import scratch_path, write_once
from tenderlake.sources import procurement as P
from tenderlake.streaming.merge_state import buckets_for, merge_state_stream, read_states, start_merge_states
from tenderlake.streaming.notices import read_notice_stream

TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
TS_SQL = "'%Y-%m-%dT%H:%M:%S.%fZ'"

_MERGED_SQL = """
SELECT ocid,
       coalesce(list(DISTINCT phase) FILTER (WHERE phase IS NOT NULL), []::VARCHAR[]) AS tag,
       arg_max(status, {'ts': ts, 'id': notice_id}) FILTER (WHERE status IS NOT NULL AND status <> '') AS status,
       arg_max(description, {'ts': ts, 'id': notice_id}) FILTER (WHERE description IS NOT NULL AND description <> '') AS description,
       arg_max(award_value, {'ts': ts, 'id': notice_id}) FILTER (WHERE award_value IS NOT NULL) AS award_value,
       count(*) AS n_notices, min(ts) AS first_ts, max(ts) AS last_ts
FROM notices GROUP BY ocid"""


def present_merged(m):
    return m.select("ocid", F.array_join("tag", ",").alias("tag"), "status", "description",
                    r6("award_value").alias("award_value"), "n_notices",
                    F.date_format("first_ts", TS_FMT).alias("first_ts"),
                    F.date_format("last_ts", TS_FMT).alias("last_ts"))


@query("notice_merge", with_views(["notices"], f"""
SELECT ocid, array_to_string(list_sort(tag), ',') AS tag, status, description,
       round(award_value, 6) AS award_value, n_notices,
       strftime(first_ts, {TS_SQL}) AS first_ts, strftime(last_ts, {TS_SQL}) AS last_ts
FROM merged""", [("merged", _MERGED_SQL)]), headline=True)
def notice_merge(spark, sf_dir):
    return present_merged(merge_notices(P.notices(spark, sf_dir)))


@query("notice_merge_incremental", with_views(["notices"], f"""
SELECT ocid, array_to_string(list_sort(tag), ',') AS tag, status, description,
       round(award_value, 6) AS award_value, n_notices,
       strftime(first_ts, {TS_SQL}) AS first_ts, strftime(last_ts, {TS_SQL}) AS last_ts
FROM merged""", [("merged", _MERGED_SQL)]))
def notice_merge_incremental(spark, sf_dir):
    """The same releases from stored partial merges: a state of the earlier months, to which each later month's is added."""
    n = P.notices(spark, sf_dir)
    month = F.date_format("ts", "yyyy-MM")
    months = sorted(r["m"] for r in n.select(month.alias("m")).distinct().collect())        # the months of the input
    state = None
    for later in (months[:-2], months[-2:-1], months[-1:]):
        part = notice_state(n.filter(month.isin(later) if later else F.lit(False)))
        state = write_once(part if state is None else merge_states(state, part), "notice-state")
    return present_merged(finish_state(state))


@query("notice_merge_states", with_views(["notices"], f"""
SELECT ocid, array_to_string(list_sort(tag), ',') AS tag, status, description,
       round(award_value, 6) AS award_value, n_notices,
       strftime(first_ts, {TS_SQL}) AS first_ts, strftime(last_ts, {TS_SQL}) AS last_ts
FROM merged""", [("merged", _MERGED_SQL)]))
def notice_merge_states(spark, sf_dir):
    """The same releases from a stream on keyed state with timers: notices arrive in two halves, the query restarts from its checkpoint
    for the second, and closed processes leave the state at once."""
    folder = scratch_path(spark, "notice-stream")
    src, target = f"{folder}/in", f"{folder}/out"
    notices = write_once(P.notices(spark, sf_dir), "notices")
    buckets = buckets_for(notices.count())
    for half in range(2):
        notices.filter(F.pmod(F.xxhash64("notice_id"), F.lit(2)) == half).write.mode("append").parquet(src)
        states = merge_state_stream(read_notice_stream(spark, src), closed_quiet_ms=0, buckets=buckets)
        start_merge_states(states, target, f"{folder}/checkpoint", trigger_once=True).awaitTermination()
    return present_merged(read_states(spark, target))


@query("notice_merge_nested", with_views(["notices"], """
SELECT ocid, status, description, round(award_value, 6) AS award_value,
       (SELECT count(*) FROM notices x WHERE x.ocid = m.ocid AND x.award_value IS NOT NULL) > 0 AS has_award
FROM merged m""", [("merged", _MERGED_SQL)]))
def notice_merge_nested(spark, sf_dir):
    """Release-shaped notices: fields inside ``tender`` merge one by one, ``awards`` come from the latest notice with some."""
    n = P.notices(spark, sf_dir)
    award = F.struct(F.col("award_value").alias("value"))
    nested = n.select("notice_id", "ocid", "ts", "phase", F.struct("status", "description").alias("tender"),
                      F.when(F.col("award_value").isNotNull(), F.array(award)).otherwise(F.array().cast("array<struct<value:double>>")).alias("awards"))
    m = merge_notices(nested)
    return m.select("ocid", "tender.status", "tender.description", r6(F.get("awards", 0)["value"]).alias("award_value"),
                    F.coalesce(F.size("awards") > 0, F.lit(False)).alias("has_award"))


@query("notice_lifecycle", with_views(["notices"], """
SELECT ocid, CASE WHEN list_contains(tag, 'tender') AND list_contains(tag, 'award') THEN 'closed'
                  WHEN list_contains(tag, 'tender') AND coalesce(status = 'active', FALSE) THEN 'open'
                  ELSE 'other' END AS state
FROM merged""", [("merged", _MERGED_SQL)]))
def notice_lifecycle(spark, sf_dir):
    m = merge_notices(P.notices(spark, sf_dir))
    return m.select("ocid", lifecycle_state(F.col("tag"), F.coalesce(F.col("status"), F.lit(""))).alias("state"))


@query("daily_phase_counts", with_views(["notices"], """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, phase, count(*) AS n
FROM notices WHERE phase IS NOT NULL GROUP BY 1, 2"""))
def q_daily_phase_counts(spark, sf_dir):
    return daily_phase_counts(P.notices(spark, sf_dir))
