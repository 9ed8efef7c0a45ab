"""Release JSON edge cases, filter null logic and the match pipeline on hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from tenderlake.functions.filters import FilterSpec
from tenderlake.operators.matching import match_tenders
from tenderlake.operators.metadata import release_metadata
from tenderlake.sources.releases_json import read_releases

RELEASES = [
    {"ocid": "o-missing-tender", "id": "R1", "tag": ["tender"]},
    {"ocid": "o-null-tag", "id": "R2", "tag": None, "awards": None,
     "tender": {"status": "active", "euFunded": True, "submissionDeadline": "2024-01-01T10:00:00+01:00"}},
    {"ocid": "o-empty-awards", "id": "R3", "tag": ["award"], "awards": [],
     "tender": {"eu_funded": False, "tenderPeriod": {"endDate": "2024-01-01T09:30:00Z"}}},
    {"ocid": "o-empty-suppliers", "id": None, "tag": ["award"], "awards": [{"suppliers": []}],
     "tender": {"location": {"nuts_code": "DE3"}, "lots": [{"location": {"nuts_code": "DE3"}}, {"location": {"nuts_code": "DE21"}}]}},
    {"ocid": "o-awarded", "id": "R5", "tag": ["tender", "award"],
     "awards": [{"suppliers": [{"id": "s", "name": "Acme"}]}],
     "buyer": {"name": "Stadt München"}, "tender": {"value": {"amount": 100.0, "currency": "EUR"}}},
]


@pytest.fixture(scope="module")
def meta(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("rel") / "r.json"
    p.write_text("\n".join(json.dumps(r) for r in RELEASES))
    return release_metadata(read_releases(spark, str(p))).cache()


def _ids(meta, spec):
    return sorted(r.ocid for r in meta.filter(spec.column("release_cpv_codes")).select("ocid").collect())


def test_defaults_and_has_awards(meta):
    rows = {r.ocid: r for r in meta.collect()}
    assert rows["o-null-tag"].tag == [] and rows["o-null-tag"].has_awards is False
    assert rows["o-empty-awards"].has_awards is False
    assert rows["o-empty-suppliers"].has_awards is False
    assert rows["o-awarded"].has_awards is True
    assert rows["o-missing-tender"].has_awards is False


def test_untyped_suppliers_and_malformed_lines(spark, tmp_path):
    lines = [json.dumps({"ocid": "o-text", "awards": [{"suppliers": ["Acme", 7]}, {"suppliers": None}], "parties": [
                {"nutsCode": "DE9"}, {"nutsCode": "DE1"}, {"nutsCode": "DE9"}, {"nutsCode": None}]}),
             json.dumps({"ocid": "o-mixed", "awards": [{"suppliers": [{"id": "s", "name": "B {x}"}, "C"]}]}),
             '{"ocid": "broken", ', "", "[1, 2]", json.dumps({"ocid": "o-bad-field", "tag": "no list", "id": "R"})]
    p = tmp_path / "r.json"
    p.write_text("\n".join(lines))
    rows = {r.ocid: r for r in read_releases(spark, str(p)).collect()}
    assert sorted(rows) == ["o-bad-field", "o-mixed", "o-text"]
    assert [s.name for s in rows["o-text"].awards[0].suppliers] == ["Acme", "7"] and rows["o-text"].awards[1].suppliers == []
    assert [(s.id, s.name) for s in rows["o-mixed"].awards[0].suppliers] == [("s", "B {x}"), (None, "C")]
    assert rows["o-bad-field"].id == "R"
    m = {r.ocid: r for r in release_metadata(read_releases(spark, str(p))).collect()}
    assert m["o-text"].has_awards and m["o-text"].party_nuts == ["DE1", "DE9"]


def test_repeated_requests_change_nothing(spark):
    from tenderlake.plans.q_match import K
    from tenderlake.sources.stored import Views
    t = Views(spark, "/root/testdata/sf0.001")
    rows = lambda req: sorted((r.profile_id, r["rank"], r.ocid, r.doc_id) for r in match_tenders(
        req, t.profiles, t.chunks, t.meta, FilterSpec(status="complete"), k=K, mode="overfetch").collect())
    assert rows(t.requests.unionByName(t.requests)) == rows(t.requests)


def test_eu_funded_both_spellings_and_null(meta):
    assert _ids(meta, FilterSpec(eu_funded=True)) == ["o-null-tag"]
    assert _ids(meta, FilterSpec(eu_funded=False)) == ["o-empty-awards"]


def test_location_nuts_ordered_distinct(meta):
    r = meta.filter("ocid = 'o-empty-suppliers'").first()
    assert r.location_nuts == ["DE3", "DE21"]
    assert _ids(meta, FilterSpec(location_nuts="DE2")) == ["o-empty-suppliers"]


def test_deadline_text_vs_instant(meta):
    # 10:00+01:00 is 09:00Z: as text it sorts after 09:30Z, as an instant before
    text = _ids(meta, FilterSpec(deadline_before="2024-01-01T09:45:00Z"))
    instant = _ids(meta, FilterSpec(deadline_before="2024-01-01T09:45:00Z", deadline_mode="instant"))
    assert text == ["o-empty-awards"]
    assert instant == ["o-empty-awards", "o-null-tag"]


def test_buyer_unicode_lower(meta):
    assert _ids(meta, FilterSpec(buyer_name="MÜNCHEN")) == ["o-awarded"]


def test_has_any():
    assert not FilterSpec().has_any()
    assert FilterSpec(has_awards=False).has_any() and FilterSpec(value_min=0).has_any()
    assert not FilterSpec(month="2024-01").has_any()


def test_match_pipeline_null_logic(spark, meta):
    # chunk of an OCID without a release is kept unfiltered, rejected by any release filter
    chunks = spark.createDataFrame([
        ("c1", "o-awarded", "tender", "x" * 250, ["45000000"], [1.0, 0.0]),
        ("c2", "o-awarded", "summary", "short", ["45000000"], [1.0, 0.0]),     # tie with c1, same OCID
        ("c3", "o-unknown", "tender", "t", [], [0.9, 0.1]),
        ("c4", "o-null-tag", "tender", "t", ["72000000"], [0.5, 0.5]),
    ], "doc_id string, ocid string, chunk_type string, text string, cpv_codes array<string>, embedding array<float>")
    profiles = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", None)], "id string, embedding array<float>")
    requests = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "profile_id string")
    out = match_tenders(requests, profiles, chunks, meta, FilterSpec(), k=10).collect()
    assert [(r.rank, r.ocid, r.doc_id) for r in sorted(out, key=lambda r: r.rank)] == \
        [(1, "o-awarded", "c1"), (2, "o-unknown", "c3"), (3, "o-null-tag", "c4")]
    top = [r for r in out if r.rank == 1][0]
    assert top.text.endswith("…") and len(top.text.encode()) == 203 and top.url.endswith("=R5")
    unknown = [r for r in out if r.ocid == "o-unknown"][0]
    assert unknown.url is None and unknown.title is None
    no_awards = match_tenders(requests, profiles, chunks, meta, FilterSpec(has_awards=False), k=10).collect()
    assert sorted(r.ocid for r in no_awards) == ["o-null-tag"]
    for mode in ("exact", "overfetch"):
        cpv = match_tenders(requests, profiles, chunks, meta, FilterSpec(cpv_prefix="72"), k=10, mode=mode).collect()
        assert [r.ocid for r in cpv] == ["o-null-tag"]


def test_exact_never_worse_than_overfetch(spark):
    from tenderlake.sources.stored import Views
    v = Views(spark, "/root/testdata/sf0.001")
    spec = FilterSpec(status="active", value_min=100000.0)
    args = (v.requests, v.profiles, v.chunks, v.meta, spec)
    ex = match_tenders(*args, k=10, mode="exact").toPandas()
    ov = match_tenders(*args, k=10, mode="overfetch").toPandas()
    for pid, g in ov.groupby("profile_id"):
        e = ex[ex.profile_id == pid]
        assert len(e) >= len(g)
        assert e.score.min() >= g.score.min() - 1e-12 or len(e) > len(g)
    assert not ex.duplicated(["profile_id", "ocid"]).any()


def test_flat_metadata_equals_nested_projection(spark):
    """The stored metadata (bounded aggregates over lots) equals the projection of the nested releases."""
    from tenderlake.sources import procurement as P
    from tenderlake.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.01")
    flat = P.release_meta(t)
    nested = release_metadata(P.releases(t))
    norm = lambda df: df.withColumn("party_nuts", F.array_sort(F.array_distinct("party_nuts")))
    cols = sorted(flat.columns)
    assert cols == sorted(nested.columns)
    a, b = norm(flat).select(cols), norm(nested).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
