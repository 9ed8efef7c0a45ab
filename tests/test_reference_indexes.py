"""Posting tables, rank location, bitmaps, buckets and partial merges against plain definitions."""

import collections
import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators import distinct_counts, market, notices, paging, postings
from tenderlake.operators import profiles as K
from tenderlake.operators.listing import filtered_releases, list_releases
from tenderlake.sources.stored import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def meta(spark):
    return Views(spark, SF).meta


@pytest.fixture(scope="module")
def tables(spark, meta, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    postings.write_postings(meta, path)
    return postings.read_postings(spark, path)


@pytest.mark.parametrize("spec", [FilterSpec(cpv_prefix="4"), FilterSpec(location_nuts="DE"), FilterSpec(nuts_code="DE21"), FilterSpec(nuts_code="zz"),
                                  FilterSpec(buyer_name="mer#0000"), FilterSpec(buyer_name="#"), FilterSpec(buyer_name="%"), FilterSpec(buyer_name=""),
                                  FilterSpec(cpv_prefix="45", buyer_name="9", status="active", month="1996-05"), FilterSpec(status="active"), FilterSpec()])
def test_postings_equal_the_scan(meta, tables, spec):
    got = postings.filter_with_postings(meta, tables, spec).select("ocid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, filtered_releases(meta, spec).select("ocid").collect()))


def test_prefix_reaches_the_scan(spark, tables):
    """The prefix is a pushed filter on a scalar column, and files are sorted by it."""
    plan = postings.ocids_with_prefix(tables, "location", "DE3")._jdf.queryExecution().toString()
    assert "StringStartsWith(code,DE3)" in plan and "EqualTo(kind,location)" in plan
    grams = postings.names_containing(tables, "mer#0000")._jdf.queryExecution().toString()
    assert "In(gram, [" in grams
    rows = [tuple(r) for r in tables.codes.collect()]
    assert len(rows) == len(set(rows))


def test_trigram_names_with_odd_patterns(spark, tmp_path):
    names = ["Ämter & Söhne", "ÄMTER", "aaa", "aaaa", "aa", "", None, "50%_off", "a.b", "İstanbul", "a\nb c"]
    meta = spark.createDataFrame([(f"o{k}", n) for k, n in enumerate(names)], "ocid string, buyer_name string")
    for c in ("release_cpv_codes", "location_nuts", "party_nuts"):
        meta = meta.withColumn(c, F.array().cast("array<string>"))
    postings.write_postings(meta, str(tmp_path / "p"))
    tables = postings.read_postings(spark, str(tmp_path / "p"))
    for pattern in ("ämter", "aaa", "aaaa", "aa", "", "%_o", ".b", "b c", "zzz", "a\nb", "söhne"):
        want = meta.filter(F.lower("buyer_name").contains(pattern.lower())).select("ocid").collect()
        assert sorted(map(tuple, postings.ocids_of_buyers(tables, pattern).collect())) == sorted(map(tuple, want)), pattern


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_located_pages_equal_sorted_pages(spark, range_rows):
    r = random.Random(4)
    dates = [None, "1997-01-05", "1997-01-05T10:00:00Z", "1998-11-30", "1996-02-01"] + ["1999-09-09"] * 6      # one date holds most rows
    rows = [(f"o{k:04d}", r.choice(dates)) for k in range(400)]
    frame = spark.createDataFrame(rows, "ocid string, date string").repartition(5)
    order = sorted(rows, key=lambda x: x[0])
    order.sort(key=lambda x: x[1] or "", reverse=True)
    for offset, limit in ((0, 10), (3, 1), (150, 20), (199, 60), (390, 50), (399, 1), (400, 5), (5000, 5)):
        got, left = paging.locate(frame, offset, limit, range_rows)
        page = got.orderBy(F.col("date").desc(), F.col("ocid")).offset(left).limit(limit)
        assert [tuple(x) for x in page.collect()] == order[offset:offset + limit], (offset, limit)


def test_located_listing(meta):
    for offset, spec in ((0, FilterSpec()), (700, FilterSpec()), (37, FilterSpec(status="active"))):
        want = list_releases(meta, spec, limit=30, offset=offset).collect()
        assert paging.list_releases_located(meta, spec, limit=30, offset=offset, range_rows=50).collect() == want
    with pytest.raises(ValueError):
        paging.list_releases_located(meta, limit=0)


def test_located_page_sorts_only_its_ranges(spark):
    """No range that is sorted holds offset + limit rows."""
    rows = spark.range(20_000).select(F.format_string("o%05d", "id").alias("ocid"), F.lit("1999-01-01").alias("date"))
    got, left = paging.locate(rows, 15_000, 10, range_rows=2000)
    assert got.count() <= 6000 and left < 6000
    assert [r[0] for r in got.orderBy("ocid").offset(left).limit(10).collect()] == [f"o{k:05d}" for k in range(15_000, 15_010)]


def test_dense_numbers_and_bitmap_counts(spark):
    r = random.Random(6)
    rows = [(r.choice("abc"), r.choice("xy"), f"k{r.randint(0, 90_000)}") for _ in range(120_000)] + [("a", "x", None)]
    frame = spark.createDataFrame(rows, "g string, h string, key string").repartition(4)
    numbers = distinct_counts.dense_numbers(frame, "key")
    got = {k: n for k, n in numbers.collect()}
    keys = sorted({k for *_, k in rows if k is not None})
    assert got == {k: i for i, k in enumerate(keys)}
    fine = distinct_counts.bitmaps(frame.join(numbers, "key"), ["g", "h"], sums={"n": F.count("*")})
    assert fine.count() <= 6 * 4                                # four buckets of numbers
    coarse = distinct_counts.merge_bitmaps(fine, ["g"], ["n"])
    want = collections.defaultdict(set)
    for g, h, k in rows:
        if k is not None:
            want[(g, h)].add(k)
            want[(g,)].add(k)
    for level, groups in ((fine, ["g", "h"]), (coarse, ["g"])):
        for row in distinct_counts.count_bitmaps(level, groups, "d", ["n"]).collect():
            assert row["d"] == len(want[tuple(row[c] for c in groups)])


def test_rollup_by_bitmaps_has_no_expand(spark):
    releases = Views(spark, SF).releases
    by_bitmaps = distinct_counts.cpv_rollup_bitmaps(releases)
    plain = market.cpv_rollup(releases)
    assert "Expand" in plain._jdf.queryExecution().toString() and "Expand" not in by_bitmaps._jdf.queryExecution().toString()
    key = ["gid", "d2", "d4", "d5", "d8", "n_items", "n_releases"]
    assert sorted(map(str, by_bitmaps.select(key).collect())) == sorted(map(str, plain.select(key).collect()))
    none = distinct_counts.cpv_rollup_bitmaps(releases.limit(0)).collect()
    assert [(r["gid"], r["n_items"], r["n_releases"]) for r in none] in ([], [(15, 0, 0)])


def test_sparse_bitmaps_are_words(spark):
    """Groups with few keys of every bucket hold words, not bitmaps of 4 KB, and merge and count the same."""
    rows = [(f"g{k % 400}", f"h{k % 4}", (k * 7919) % 70_000) for k in range(4000)] * 2
    frame = spark.createDataFrame(rows, "g string, h string, number long").repartition(3)
    fine = distinct_counts.bitmaps(frame, ["g", "h"], sums={"n": F.count("*")}, words=True)
    assert fine.schema["_bits"].dataType.simpleString() == "bigint" and fine.count() <= len(set(rows))
    coarse = distinct_counts.merge_bitmaps(fine, ["h"], ["n"])
    assert coarse.count() <= 4 * (70_000 // 64 + 1)
    for level, groups in ((fine, ["g", "h"]), (coarse, ["h"])):
        got = {tuple(r[c] for c in groups): (r["d"], r["n"]) for r in distinct_counts.count_bitmaps(level, groups, "d", ["n"]).collect()}
        want = collections.defaultdict(list)
        for g, h, number in rows:
            want[(g, h) if len(groups) == 2 else (h,)].append(number)
        assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}


def test_rollup_carries_no_dense_bitmap(spark, monkeypatch):
    """What the roll-up writes at its finest level is a word a row, and one exchange serves the levels above."""
    written = {}

    def keep(df, name):
        written[name] = df
        return write_once(df, name)
    from tenderlake.session import write_once
    monkeypatch.setattr(distinct_counts, "write_once", keep)
    out = distinct_counts.cpv_rollup_bitmaps(Views(spark, SF).releases)
    out.collect()
    assert written["cpv-bitmaps"].schema["_bits"].dataType.simpleString() == "bigint"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"hashpartitioning\((_bucket#\d+)", plan))) <= 4 and "bitmap_or_agg" not in plan


def test_postings_plan_the_metadata_once(spark, meta, tmp_path):
    """Its rows are made once, whatever the number of posting tables."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    some = meta.select("ocid", "buyer_name", "release_cpv_codes", "location_nuts", "party_nuts").limit(300).coalesce(1)
    postings.write_postings(some.mapInArrow(count, some.schema), str(tmp_path / "p"))
    assert seen.value == 300


def test_metadata_reads_the_lines_once(spark):
    from tenderlake.sources import procurement
    plan = procurement.release_meta(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[.*l_orderkey", plan)) == 1


def test_buckets_grow_with_the_input(spark, tmp_path):
    from tenderlake.operators import copartition
    path = str(tmp_path / "a b%20c")
    spark.range(4000).selectExpr("uuid() as ocid").repartition(3).write.parquet(path)
    held = spark.read.parquet(path)
    size = sum(os.path.getsize(f) for f in _files(path))
    assert copartition.buckets_for(held, least=8) == 8
    assert copartition.buckets_for(held, held, least=8, bucket_input=size // 20) in (20, 21)
    assert copartition.buckets_for(spark.range(3), least=5) == 5


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    return {f for f in iter(lambda: blocks.next().getPath() if blocks.hasNext() else None, None) if "/shuffle_" in f and f.endswith(".data")}


def test_a_copartitioned_table_is_written_in_passes(spark, tmp_path):
    """Every row comes once, a bucket is one sorted file, and no pass leaves its shuffle files to the next."""
    import time
    import uuid

    from tenderlake.operators import copartition
    rows = [(f"ocds-{i % 90}" if i % 10 else None, i) for i in range(1000)] + [("ocds-7", 7)] * 50
    sides = spark.createDataFrame(rows, "ocid string, n int"), spark.createDataFrame([(f"ocds-{i}", i) for i in range(0, 90, 2)], "ocid string, m int")
    df = sides[0].join(sides[1].hint("merge"), "ocid", "left")
    name, before, conf = uuid.uuid4().hex, _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(conf, None)
    held = copartition.write_copartitioned(df, f"passes_{name}", buckets=6, path=str(tmp_path / "t"), passes=4)
    for _ in range(50):                                             # files are removed in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(conf, None) == had
    assert sorted(map(str, held.collect())) == sorted(map(str, df.collect()))
    files = sorted(_files(str(tmp_path / "t")))
    in_bucket = [re.search(r"_(\d{5})\.", f).group(1) for f in files]
    assert len(set(in_bucket)) == len(in_bucket) <= 6               # as from one pass
    for f in files:
        got = [r.ocid or "" for r in spark.read.parquet(f).collect()]
        assert got == sorted(got)
    spark.sql(f"DROP TABLE passes_{name}")


def test_passes_grow_with_the_input_to_a_bound(spark, tmp_path):
    from tenderlake.operators import copartition
    path = str(tmp_path / "t")
    spark.range(4000).selectExpr("uuid() as ocid").repartition(3).write.parquet(path)
    held = spark.read.parquet(path)
    size = sum(os.path.getsize(f) for f in _files(path))
    assert copartition.passes_for(held) == copartition.passes_for(spark.range(3)) == 1
    assert copartition.passes_for(held, pass_input=size // 3) in (3, 4)
    assert copartition.passes_for(held, pass_input=1) == copartition.PASSES


def test_a_pass_reads_its_share_of_orders_lines_and_texts(spark):
    from tenderlake.operators import copartition
    from tenderlake.sources import procurement
    plan = copartition._share(procurement.releases(spark, SF), "ocid", 8, 4, 1)._jdf.queryExecution().optimizedPlan().toString()
    for key in ("o_orderkey", "l_orderkey", "doc_id"):
        assert re.search(rf"Filter .*pmod\(pmod\(hash\(concat\(ocds-, cast\({key}#.*\n.*Relation \[", plan), key


def test_lots_are_dealt_by_order_before_they_are_nested(spark):
    from tenderlake.sources import procurement
    lines = procurement.releases(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = next(i for i, x in enumerate(lines) if "RepartitionByExpression [orderkey" in x)
    assert any("EUR" in x for x in lines[:dealt]) and not any("EUR" in x for x in lines[dealt:])


def test_lookup_keeps_buckets_below_the_shuffle_partitions(spark, tmp_path):
    """Keys that come in more partitions than the table has buckets are exchanged, not the table."""
    import uuid

    from tenderlake.operators import copartition
    name = uuid.uuid4().hex
    held = copartition.write_copartitioned(spark.createDataFrame([("ocds-1", 1), ("ocds-1", 2), (None, 3)], "ocid string, n int"), f"few_{name}",
                                           buckets=2, path=str(tmp_path / "t"))
    keys = spark.createDataFrame([("ocds-1",), ("none",), (None,), ("none",)], "ocid string").distinct()
    found = copartition.lookup(keys, held, buckets=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan[plan.index("Bucketed: true") - 300:]
    assert sorted(map(str, found.collect())) == sorted(map(str, copartition.lookup(keys, held).collect())) and found.count() == 4
    spark.sql(f"DROP TABLE few_{name}")


def _files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    base = str(tmp_path / "profiles")
    rows = spark.range(500).select(F.format_string("p%03d", "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("d").alias("description"))
    K.write_buckets(rows, base, buckets=64)
    before = _files(base)
    assert len(before) == 64
    sup = lambda v: F.struct(F.lit(True).alias("supplied"), v.alias("value"))
    ids = [f"p{k:03d}" for k in (1, 50, 99, 200, 300, 301, 302, 400, 499)] + ["unknown"]
    changes = spark.createDataFrame([(i,) for i in ids], "id string").select("id", sup(F.lit("renamed")).alias("name"))
    status, touched = K.change_buckets(spark, base, changes, K.update_profiles, buckets=64)
    after = _files(base)
    assert len(touched) <= 10 and len(set(before) - set(after)) <= 10 and len(set(before) & set(after)) >= 54
    assert {r["id"]: r["updated"] for r in status.collect()} == {i: i != "unknown" for i in ids}
    got = {r["id"]: r["name"] for r in K.read_buckets(spark, base).collect()}
    assert got == {f"p{k:03d}": "renamed" if f"p{k:03d}" in ids else f"n{k}" for k in range(500)}
    everything = K.read_buckets(spark, base).select("id")
    gone = {r["id"] for r in everything.collect() if int(r["id"][1:]) % 2}
    K.change_buckets(spark, base, spark.createDataFrame([(i,) for i in gone], "id string"), K.delete_profiles, buckets=64)
    assert {r["id"] for r in K.read_buckets(spark, base).collect()} == set(got) - gone
    one = spark.createDataFrame([("p900", "new", "x")], "id string, name string, description string")
    status, touched = K.change_buckets(spark, base, one, K.create_profiles, buckets=64)
    assert len(touched) == 1 and status.collect()[0]["created"] and K.read_buckets(spark, base).count() == 251
    K.change_buckets(spark, base, K.read_buckets(spark, base).select("id"), K.delete_profiles, buckets=64)      # the last of every bucket
    assert K.read_buckets(spark, base).count() == 0


def _nested(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        text = r.choice([None, "", "a", "b", "c"])
        rows.append((f"n{k:03d}", f"o{r.randint(0, 25)}", f"2024-01-{r.randint(1, 6):02d} 0{r.randint(0, 3)}:00:00", r.choice([None, "tender", "award"]),
                     (r.choice([None, "x", ""]), text) if r.random() < 0.8 else None, [r.random()] if r.random() < 0.4 else r.choice([None, []])))
    schema = "notice_id string, ocid string, t string, phase string, tender struct<status:string,description:string>, awards array<double>"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_partial_merges_in_any_order(spark):
    """Days merged one by one, in any order and grouping, give the merge of all notices."""
    frame = _nested(spark).persist()
    want = sorted(map(str, notices.merge_notices(frame).select("ocid", "tag", "tender", "awards", "n_notices", "first_ts", "last_ts").collect()))
    day = F.dayofmonth("ts")
    states = {d: notices.notice_state(frame.filter(day == d)).persist() for d in range(1, 7)}
    for order in itertools.islice(itertools.permutations(range(1, 7)), 0, 720, 240):
        state = states[order[0]]
        for d in order[1:]:
            state = notices.merge_states(state, states[d])
        got = notices.finish_state(state, frame.schema).select("ocid", "tag", "tender", "awards", "n_notices", "first_ts", "last_ts")
        assert sorted(map(str, got.collect())) == want
    left = notices.merge_states(notices.merge_states(states[1], states[2]), states[3])
    right = notices.merge_states(states[4], notices.merge_states(states[5], states[6]))
    got = notices.finish_state(notices.merge_states(right, left), frame.schema).select("ocid", "tag", "tender", "awards", "n_notices", "first_ts", "last_ts")
    assert sorted(map(str, got.collect())) == want


def test_copartitioned_tables_are_not_exchanged(spark, meta, tmp_path):
    """Lookup and enrichment hash only their small side; two tables of one layout join without any exchange."""
    import uuid

    from tenderlake.operators import copartition
    from tenderlake.operators.matching import enrich
    v = Views(spark, SF)
    name = uuid.uuid4().hex
    held = copartition.write_copartitioned(meta, f"meta_{name}", buckets=4, path=str(tmp_path / "meta"))
    chunks = copartition.write_copartitioned(v.chunks.select("doc_id", "ocid"), f"chunks_{name}", buckets=4, path=str(tmp_path / "chunks"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = spark.createDataFrame([("ocds-1",), ("ocds-2",), ("none",)], "ocid string")
        found = copartition.lookup(keys, held)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        both = chunks.join(held.hint("merge"), "ocid")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r["ocid"]: r["found"] for r in found.collect()} == {"ocds-1": True, "ocds-2": True, "none": False}
    hits = v.chunks.select(F.lit("p").alias("profile_id"), "doc_id", "ocid")
    cols = ["doc_id", "ocid", "title", "buyer_name"]
    assert sorted(map(str, copartition.enrich_copartitioned(hits, held).select(cols).collect())) == sorted(map(str, enrich(hits, meta).select(cols).collect()))
    spark.sql(f"DROP TABLE meta_{name}")
    spark.sql(f"DROP TABLE chunks_{name}")
