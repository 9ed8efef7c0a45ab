"""Profile lifecycle, mirroring the reference's integration test, plus update edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake import schemas as S
from tenderlake.operators import profiles as K

EMPTY = None


def _empty(spark):
    return spark.createDataFrame([], S.PROFILE)


def _change(spark, rows):
    sup = lambda t: T.StructType([T.StructField("supplied", T.BooleanType()), T.StructField("value", t)])
    schema = T.StructType([T.StructField("id", T.StringType())] + [
        T.StructField(f, sup(T.ArrayType(T.StringType()) if f in ("cpv_codes", "categories") else T.StringType()))
        for f in K.CHANGE_FIELDS])
    return spark.createDataFrame(rows, schema)


def _nothing():
    return {f: (False, None) for f in K.CHANGE_FIELDS}


def _row(id_, **supplied):
    d = _nothing()
    d.update({k: (True, v) for k, v in supplied.items()})
    return (id_,) + tuple(d[f] for f in K.CHANGE_FIELDS)


def test_lifecycle(spark):
    batch = spark.createDataFrame(
        [("p1", "Acme Corp", "Bridges and roads", ["45000000"], ["works"], "Berlin, Germany",
          dt.datetime(2024, 1, 1))],
        "id string, name string, description string, cpv_codes array<string>, categories array<string>, "
        "location string, created_at timestamp")
    snap, made = K.create_profiles(_empty(spark), batch)
    assert [tuple(r) for r in made.collect()] == [("p1", True, False)]
    again, made = K.create_profiles(snap, batch.unionByName(batch))
    assert again.count() == 1 and [tuple(r) for r in made.collect()] == [("p1", False, False)] * 2
    got = K.get_profiles(spark.createDataFrame([("p1",)], "id string"), snap).first()
    assert got.found and not got.has_embedding and got.cpv_codes == ["45000000"]
    snap2, status = K.update_profiles(snap, _change(spark, [_row("p1", name="Acme Industries")]))
    r = snap2.first()
    assert r.name == "Acme Industries" and r.description == "Bridges and roads" and r.location == "Berlin, Germany"
    assert status.first().updated
    assert K.count_profiles(snap2).first()["count"] == 1
    snap3, st = K.delete_profiles(snap2, spark.createDataFrame([("p1",)], "id string"))
    assert st.first().deleted and snap3.count() == 0
    gone = K.get_profiles(spark.createDataFrame([("p1",)], "id string"), snap3).first()
    assert gone.found is False


def test_update_edge_cases(spark):
    snap = spark.createDataFrame(
        [("a", "A", "desc", ["1"], [], "Köln", dt.datetime(2024, 1, 1), [1.0, 0.0]),
         ("b", "B", "desc", [], [], "Bonn", dt.datetime(2024, 1, 1), [0.0, 1.0])], S.PROFILE)
    changes = _change(spark, [_row("a", description="desc"), _row("b", location=""), _row("b"), _row("zz")])
    nxt, status = K.update_profiles(snap, changes)
    rows = {r.id: r for r in nxt.collect()}
    assert rows["a"].embedding is None                      # identical description still clears
    assert rows["b"].location is None and rows["b"].embedding is not None
    st = {r.id: (r.updated, r.needs_embedding) for r in status.collect()}
    assert st == {"a": (True, True), "b": (True, False), "zz": (False, False)}


def test_list_order_and_json(spark):
    snap = spark.createDataFrame(
        [("b", "B", "d", [], [], None, dt.datetime(2024, 1, 1), None),
         ("a", "A", "d", [], [], None, dt.datetime(2024, 1, 1), None),
         ("c", "C", "d", [], [], None, dt.datetime(2024, 1, 2), None)], S.PROFILE)
    assert [r.id for r in K.list_profiles(snap).collect()] == ["c", "a", "b"]
    df = spark.createDataFrame([('["x","y"]',), ('["x"',), (None,), ('{"a":1}',), ("[1,2]",), ('["a",null]',), ("[null]",), ("[]",)], "t string")
    got = [r[0] for r in df.select(K.decode_json_array(F.col("t"))).collect()]
    assert got == [["x", "y"]] + [[]] * 7


def test_schema_evolution_and_vectors(spark, tmp_path):
    old = spark.createDataFrame([("o", "Old", "d", None, None, None, dt.datetime(2023, 1, 1))],
                                "id string, name string, description string, cpv_codes array<string>, "
                                "categories array<string>, location string, created_at timestamp")
    old.write.parquet(str(tmp_path / "v=0"))
    new = spark.createDataFrame([("n", "New", "d", [], [], None, dt.datetime(2024, 1, 1), [0.5, 0.25])], S.PROFILE)
    new.write.parquet(str(tmp_path / "v=1"))
    both = K.read_profiles(spark, str(tmp_path / "v=0"), str(tmp_path / "v=1"))
    rows = {r.id: r for r in both.collect()}
    assert rows["o"].embedding is None and rows["o"].cpv_codes == [] and rows["n"].embedding == [0.5, 0.25]
    blobs = K.vectors_to_blobs(new.select("id", "embedding"))
    assert blobs.first().embedding_blob == bytes.fromhex("0000003f0000803e")
    back = K.vectors_from_blobs(blobs.select("id", "embedding_blob"))
    assert back.first().embedding == [0.5, 0.25]
    filled = K.apply_vectors(both, back.select("id", "embedding"))
    assert K.unembedded(filled).select("id").collect()[0].id == "o"


def test_create_generates_ids_and_snapshot_versions(spark, tmp_path):
    batch = spark.createDataFrame([("N", "d")], "name string, description string")
    snap, _ = K.create_profiles(_empty(spark), batch)
    r = snap.first()
    assert len(r.id) == 36 and r.created_at is not None and r.cpv_codes == [] and r.embedding is None
    p0 = K.write_snapshot(snap, str(tmp_path), 0)
    assert p0.endswith("v=0") and K.read_profiles(spark, p0).count() == 1
    K.write_snapshot(snap, str(tmp_path), 1)
    K.write_snapshot(snap, str(tmp_path), 10)
    assert K.read_profiles(spark, str(tmp_path)).count() == 1         # the latest version only


def test_imported_layout_and_vector_rules(spark, tmp_path):
    spark.createDataFrame([("a", "A", "d", '["45000000"]', "[null]", None, dt.datetime(2024, 1, 1), bytes.fromhex("0000003f0000803e")),
                           ("b", "B", "d", None, "x", None, dt.datetime(2024, 1, 1), None)],
                          "id string, name string, description string, cpv_codes string, categories string, location string, "
                          "created_at timestamp, embedding binary").write.parquet(str(tmp_path / "old"))
    snap = K.read_profiles(spark, str(tmp_path / "old"))
    rows = {r.id: r for r in snap.collect()}
    assert rows["a"].cpv_codes == ["45000000"] and rows["a"].categories == [] and rows["a"].embedding == [0.5, 0.25]
    assert rows["b"].cpv_codes == [] and rows["b"].embedding is None
    two = spark.createDataFrame([("b", [1.0, 2.0]), ("b", [0.0, 9.0])], "id string, embedding array<float>")
    done = {r.id: r.embedding for r in K.apply_vectors(snap, two).collect()}
    assert done == {"a": [0.5, 0.25], "b": [1.0, 2.0]}
    with pytest.raises(Exception, match="seq"):
        K.update_profiles(snap, _change(spark, [_row("a", name="x"), _row("a", name="y")]))[0].collect()
