"""Files, versions, and records against brute force."""

import json
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, parties, resolve
from tessera.plans import transactions as tx
from tessera.sources import files
from tessera.sources.versions import VersionedTable


def test_json_documents(spark, tmp_path):
    for name, body in (("RT1", {"a": {"b": 1}, "tags": ["x"]}), ("RT2", {"a": {"b": 2}}), ("_meta", {"a": None})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    got = files.documents(spark, str(tmp_path)).select("id", "a.b").collect()
    assert sorted(map(tuple, got)) == [("RT1", 1), ("RT2", 2)]
    assert files.documents(spark, str(tmp_path / "none"), "a string").count() == 0
    (tmp_path / "stores").mkdir()
    (tmp_path / "stores" / "x.json").write_text(json.dumps([{"brand": "", "lat": 1.0, "lng": 2.0}, {"brand": "B", "lat": None, "lng": 2.0}, {"brand": "C", "lat": 3.0, "lng": 0.0}]))
    rows = files.records(spark, str(tmp_path / "stores"), "brand string, lat double, lng double")
    assert [tuple(r) for r in files.located(rows, "D").collect()] == [("D", 1.0, 2.0)]


def test_pages_csv_and_geojson(spark, tmp_path):
    for kind in ("retail", "land"):
        (tmp_path / "html" / f"kind={kind}").mkdir(parents=True)
        (tmp_path / "html" / f"kind={kind}" / f"{kind}1.html").write_text(f"<p>{kind}\nx</p>")
    got = files.pages(spark, str(tmp_path / "html")).collect()
    assert sorted((r.id, r.kind, r.html) for r in got) == [("land1", "land", "<p>land\nx</p>"), ("retail1", "retail", "<p>retail\nx</p>")]
    assert [r.id for r in files.pages(spark, str(tmp_path / "html"), "land").collect()] == ["land1"]
    (tmp_path / "b.csv").write_text("name,aliases\nTim,Tims; TH\nAda,\nBob,tims\n")
    assert {r.key: r.name for r in files.aliases(spark, str(tmp_path / "b.csv")).collect()} == {"TIM": "Tim", "TIMS": "Bob", "TH": "Tim", "ADA": "Ada", "BOB": "Bob"}
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    shapes = [{"id": "p", "geometry": {"type": "Polygon", "coordinates": [square]}}, {"id": "m", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"id": "n", "geometry": None}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    rings = files.polygons(spark, str(tmp_path / "g.json"))
    assert sorted(r.polygon_id for r in rings.collect()) == ["m", "m", "p"]
    points = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.5, 0.5)], "id long, lat double, lng double")
    assert {tuple(r) for r in resolve.containing(points, rings.filter("polygon_id = 'p'"), 0.3).collect()} == {(1, "p")}
    area = rings.filter("polygon_id = 'p'").select(resolve.ring_area_m2(F.col("ring"))).first()[0]
    assert abs(area / (111_320.0**2) - 1) < 1e-3
    assert json.loads(files.features(points).first().value)["geometry"] == {"type": "Point", "coordinates": [0.25, 0.5]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], "x"), (2, None, "y")], "id long, tags array<string>, t string")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()))[0] == ("1", "a, b", "x")
    for _ in range(2):
        files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_documents(rows, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    new = spark.createDataFrame([(2, ["c"], "z"), (3, [], "w")], rows.schema)
    assert sorted((r.id, r.t) for r in files.upsert(rows, new, ["id"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    done = spark.createDataFrame([(1, False), (2, True)], "id long, failed boolean")
    assert [r.id for r in files.pending(new.union(rows), done, "id").distinct().collect()] == [3]
    assert {r.id for r in files.pending(new.union(rows), done, "id", "failed").collect()} == {2, 3}


def test_versions(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        store.promote()
    assert store.versions() == [] and store.active_version() is None
    for k in (1, 2):
        store.write_sandbox(spark.range(k))
        assert store.promote() == f"v{k:03d}" and store.active().count() == k
    store.rollback("v001")
    assert store.active().count() == 1 and store.versions() == ["v001", "v002"]
    store.write_sandbox(spark.range(5))
    store.discard()
    with pytest.raises(FileNotFoundError):
        store.promote()
    with pytest.raises(FileNotFoundError):
        store.rollback("v009")


def test_nested_diff_of_equal_documents_is_empty(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1]}}'), (2, None)], "id long, record string")
    other = spark.createDataFrame([(1, '{"b": {"c": [1]}, "a": 1}'), (2, None)], "id long, record string")
    assert {tuple(r)[:2] for r in checks.nested_diff(rows, other, "id", "record").collect() if r.id == 1} == {(1, "unchanged")}


def test_numbers_follow_the_order(spark):
    got = parties.numbered(spark.range(1000).selectExpr("id * 7 % 1000 as x"), "x").collect()
    assert {r.x: r.number for r in got} == {k: k + 1 for k in range(1000)}


def test_no_parties(spark):
    none = spark.createDataFrame([], "id long, name string, phones array<string>, contact string, address string, is_company boolean")
    assert parties.clustered(none).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None), (2, None, None, None, None, None), (2, None, None, None, None, None)], none.schema)
    assert sorted(map(tuple, parties.clustered(nulls).collect())) == [(1, 1), (2, 2)]


def test_the_view_is_stored_once_and_made_anew_for_changed_files(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", folder)
    first = tx.transactions(spark, folder)
    assert tx.transactions(spark, folder) is first and first.count() == tx.joined(spark, folder).count()
    (tmp_path / "sf").chmod(0o755)
    (tmp_path / "sf" / "orders.parquet").unlink()
    pq.write_table(pq.read_table("/root/testdata/sf0.001/orders.parquet").slice(0, 10), f"{folder}/orders.parquet")
    assert tx.transactions(spark, folder).count() <= 10
