"""Scans, sinks, versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.sources import ply, scans
from atlasloom.sources.versions import VersionStore


def test_ply(spark, tmp_path):
    v = np.array([(1.5, -2.0, 3.0, 10, 20, 30, 7)] * 3, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("label", "<i4")])
    (tmp_path / "a.ply").write_bytes(ply.encoded(v, ("edge 0.02",)))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    (tmp_path / "c.ply").write_bytes(ply.encoded(v[:0]))
    rows = ply.read(spark, str(tmp_path), chunk=2)
    assert rows.count() == 4
    got = rows.where("path LIKE '%b.ply'").first()
    assert (got.x, got.r, got.label) == (1.0, None, None)
    back = ply.write(rows.where("path LIKE '%a.ply'").coalesce(1), ("kept",)).first()
    assert back.n == 3 and ply.header(back.content)[3] == ["kept"] and ply.vertices(back.content).tolist() == v.tolist()
    with pytest.raises(ValueError):
        ply.vertices(ply.encoded(v)[:-3])


def test_record_scans(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"type": "meta", "name": "x"}\n{"type": "robot", "t": 1.5, "base_x": 2.0}\n{"type": "objects", "list": []}\n')
    parts = scans.episode(spark, str(tmp_path / "e.jsonl"))
    assert parts["robot"].first().t == 1.5 and parts["meta"].count() == 1 and parts["objects"].count() == 1
    (tmp_path / "t.json").write_text(json.dumps({"a": {"op": ">=", "value": 0.9}, "b": {"parts": {"p": {"op": "<", "value": 2}, "q": {"op": ">", "value": 1}}}, "c": {"between": [1, 2]}, "d": {"info": True}}))
    t = {(r.metric_id, r.part): r for r in scans.targets(spark, str(tmp_path / "t.json")).collect()}
    assert t[("a", None)].target == 0.9 and t[("b", "p")].op == "<" and t[("c", None)].op == "between" and t[("c", None)].hi == 2.0 and t[("d", None)].info
    (tmp_path / "v.txt").write_text("# comment\nTea cup = a cup\n\ntea  cup = other\nsofa\n")
    assert {(r.key, r.prompt) for r in scans.vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {("tea cup", "a cup"), ("sofa", "sofa")}
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs/j.json").write_text('{"id": "1", "state": "fusing"}\n{"id": "2", "state": "committed"}\n')
    assert {r.id: r.state for r in scans.recovered_jobs(spark, str(tmp_path / "jobs")).collect()} == {"1": "failed", "2": "committed"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/f1.json").write_text('{"name": "f1"}')
    with pytest.raises(Exception, match="missing key pose"):
        scans.sidecars(spark, str(tmp_path / "s"), "name string, pose string", ["pose"]).collect()
    (tmp_path / "house.json").write_text(json.dumps({"rooms": [{"id": "r", "floorPolygon": [{"x": 0, "z": 1}, {"x": 2, "z": 3}]}], "walls": [{"id": "w", "polygon": [{"x": 0, "z": 0}, {"x": 5, "z": 0}]}], "doors": []}))
    plan = scans.floor_plan(spark, str(tmp_path / "house.json"))
    assert plan["rooms"].first().polygon[1].y == 3.0 and plan["walls"].first().bx == 5.0 and plan["doors"].count() == 0


def test_first_source(spark):
    rows = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("d", 3, "z")], "key string, p int, v string")
    assert {r.key: r.v for r in scans.first_source(rows, "key", "p").collect()} == {"c": "a", "d": "z"}


def test_versions(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/map")
    assert store.latest() is None
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert store.commit(rows(1, 2), id_mark=2) == 1
    assert store.commit(rows(3), add=True, id_mark=3) == 2
    assert sorted(r.id for r in store.read().collect()) == [1, 2, 3]
    assert store.revert(1) == 3
    assert sorted(r.id for r in store.read().collect()) == [1, 2]
    m = store.manifest()
    assert (m["kind"], m["reverted_to"], m["id_mark"]) == ("revert", 1, 3)
    assert [r.id for r in store.difference(2, 3, ["id"]).collect()] == [3]
    assert store.prune(newest=1) == [1, 2]
    assert sorted(r.id for r in store.read().collect()) == [1, 2]


def test_schema_evolution(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/old")
    spark.range(2).withColumn("flat", F.lit(1)).write.parquet(f"{tmp_path}/new")
    rows = scans.merged_tables(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert rows.where("flat IS NULL").count() == 2
