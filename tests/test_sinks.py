"""Topologies to files and back, property graphs, the catalog and documents."""

import datetime
import json

import pytest
from graphloom.plans.catalogue import Saved
from graphloom.sinks import catalog, documents, topology

NODES = "id string, parent_id string, service_id string, depth int, ord long, type string, name string, kind string, line int, end_line int, metadata map<string,string>, raw string"


def tables(spark):
    services = spark.createDataFrame([("s:1", "users", "users", "backend"), ("s:2", 'quo"te\n', None, None)], "id string, name string, code string, kind string")
    rows = [
        ("e:1", None, "s:1", 0, 1, "endpoint", "GET /", "GET", 1, 9, {"path": "/"}, "secret source"),
        ("f:1", None, "s:1", 0, 2, "function", "list", "method", 11, 30, {}, None),
        ("c:2", "f:1", "s:1", 1, 2, "call", "b", None, 14, 14, None, None),
        ("c:1", "f:1", "s:1", 1, 1, "flowControl", "if", "if", 12, 13, None, "if (x)"),
        ("r:1", "c:1", "s:1", 2, 1, "return", 'a "b" {}', None, 13, 13, {"status": "200"}, None),
    ]
    return services, spark.createDataFrame(rows, NODES)


def test_round_trip(spark, tmp_path):
    services, nodes = tables(spark)
    path = topology.write_topology(services, nodes, f"{tmp_path}/topology", Saved(spark).save, roots=(str(tmp_path),))
    text = "".join(p.read_text() for p in sorted((tmp_path / "topology").glob("part-*")))
    docs = {d["id"]: d for d in map(json.loads, text.strip().split("\n"))}
    assert set(docs) == {"s:1", "s:2"} and "secret source" not in text and docs["s:2"]["name"] == 'quo"te\n'
    (fn,) = docs["s:1"]["functions"]
    assert [c["id"] for c in fn["children"]] == ["c:1", "c:2"] and fn["children"][0]["children"][0]["name"] == 'a "b" {}'
    s, n = topology.read_topology(spark, path, Saved(spark).save)
    assert {tuple(r) for r in s.collect()} == {tuple(r) for r in services.collect()}
    got = {r.id: r for r in n.collect()}
    for r in nodes.collect():
        assert (got[r.id].parent_id, got[r.id].depth, got[r.id].type, got[r.id].line, got[r.id].end_line) == (r.parent_id, r.depth, r.type, r.line, r.end_line)
        assert (got[r.id].metadata or {}) == (r.metadata or {}) and got[r.id].raw is None
    topology.write_topology(services, nodes, f"{tmp_path}/raw", Saved(spark).save, roots=(str(tmp_path),), raw=True)
    assert {r.id: r.raw for r in topology.read_topology(spark, f"{tmp_path}/raw", Saved(spark).save)[1].collect()}["e:1"] == "secret source"


def test_wrapped_and_empty(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"topology": {"id": "s:1", "name": "n", "endpoints": [], "functions": [{"id": "f:1", "type": "function", "line": 3, "children": []}]}}))
    s, n = topology.read_topology(spark, str(tmp_path / "w.json"), Saved(spark).save)
    assert s.first().id == "s:1" and [(r.id, r.depth) for r in n.collect()] == [("f:1", 0)]
    services, nodes = tables(spark)
    assert {json.loads(r.json)["id"] for r in topology.documents(services, nodes.limit(0), Saved(spark).save).collect()} == {"s:1", "s:2"}


def test_paths_outside_are_refused(tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "link").symlink_to("/etc")
    assert topology.check_inside(f"{tmp_path}/repo/out", f"{tmp_path}/repo")
    for bad in (f"{tmp_path}/repo/../out", "/etc/out", f"{tmp_path}/link/out", f"{tmp_path}/repository"):
        with pytest.raises(ValueError):
            topology.check_inside(bad, f"{tmp_path}/repo")


def test_flatten_and_summary(spark, tmp_path):
    services, nodes = tables(spark)
    t = {"services": services, "nodes": nodes, "edges": spark.createDataFrame([("e:1", "f:1", "calls")] * 2, "source string, target string, kind string")}
    n, e = topology.flatten(topology.without_raw(t))
    assert {(r.id, r.labels[-1]) for r in n.collect()} >= {("s:1", "Service"), ("r:1", "Return"), ("c:1", "FlowControl")}
    assert "raw" not in n.where("id = 'e:1'").first().props
    assert {tuple(r) for r in e.collect()} == {("e:1", "f:1", "CALLS"), ("f:1", "c:1", "CONTAINS"), ("f:1", "c:2", "CONTAINS"), ("c:1", "r:1", "CONTAINS")}
    assert "services: 2" in topology.summary_text(topology.summary(t))
    topology.write_tables({"services": services}, f"{tmp_path}/t")
    assert topology.read_tables(spark, f"{tmp_path}/t", {"services": services.schema})["services"].count() == 2


def test_json_tables(spark, tmp_path):
    schema = "id string, n long"
    assert topology.read_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    topology.write_stamped(spark.createDataFrame([("a", 1)], schema), f"{tmp_path}/some")
    assert topology.read_or_empty(spark, f"{tmp_path}/some", schema + ", updatedAt string").first().updatedAt.endswith("Z")
    topology.write_pending(spark.createDataFrame([("x", 2)], schema), f"{tmp_path}/top")
    assert topology.read_pending(spark, f"{tmp_path}/top", schema).first().id == "x"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        topology.read_pending(spark, f"{tmp_path}/other", schema).count()


def test_catalog(spark):
    at = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", "Shop API", "local", ["x", "y"], at, at, "p"), ("b", "users", "git", None, at, at, "q")], catalog.STORED)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(catalog.find(d, "shop")) == ["a"] and ids(catalog.find(d, tags=["y"])) == ["a"] and ids(catalog.find(d, tags=["y", "z"])) == [] and ids(catalog.find(d)) == ["a", "b"]
    rows, n = catalog.page(d, ["name"], 1, 1)
    assert (ids(rows), n) == (["b"], 2)
    new = catalog.save(d, spark.createDataFrame([("a", "Shop", "local", [], None, None, "p2"), ("c", "new", "git", [], None, None, "r")], catalog.STORED))
    got = {r.id: r for r in new.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].created_at == at and got["a"].updated_at > at and got["c"].created_at > at
    assert {r.id: r.name for r in catalog.update(d, "a", name="N").collect()} == {"a": "N", "b": "users"} and ids(catalog.delete(d, "a")) == ["b"]
    s = spark.createDataFrame([("old", at), ("young", at + datetime.timedelta(minutes=20))], "id string, created_at timestamp")
    assert ids(catalog.open_sessions(s, at + datetime.timedelta(minutes=31))) == ["young"]
    c = spark.createDataFrame([("1", "pending_review", None), ("2", "pending_review", None), ("3", "resolved", "e:0"), ("4", "pending_review", None)], "id string, status string, endpoint_id string")
    k = spark.createDataFrame([("1", "e:9"), ("2", "unresolvable"), ("3", "e:9"), ("4", None)], "call_id string, decision string")
    assert {r.id: (r.status, r.endpoint_id) for r in catalog.decide(c, k).collect()} == {"1": ("resolved", "e:9"), "2": ("unresolvable", None), "3": ("resolved", "e:0"), "4": ("pending_review", None)}


def test_documents(spark):
    e = spark.createDataFrame([("e:1", "s:1", "GET", "/a|b"), ("e:2", "s:1", None, None)], "id string, service_id string, method string, path string")
    r = spark.createDataFrame([("e:1", 404, "throw"), ("e:1", 200, "return")], "endpoint string, status int, type string")
    u = spark.createDataFrame([("e:1", "users", ["create", "findMany"])], "endpoint string, `table` string, operations array<string>")
    got = {x.id: x.markdown for x in documents.endpoint_pages(e, r, u).collect()}
    assert got["e:1"].index("| 200 | return |") < got["e:1"].index("| 404 | throw |") and "| users | create, findMany |" in got["e:1"] and got["e:2"] == "# ? ?"
    s = spark.createDataFrame([("s:1", "users", "backend")], "id string, name string, kind string")
    d = spark.createDataFrame([("s:1", "db:1", "database")], "service string, target string, target_kind string")
    assert "| GET | /a\\|b |" in documents.service_pages(s, e, d).first().markdown
    n = spark.range(50).selectExpr("'g' AS g", "'n' || lpad(id, 2, '0') AS id", "'<' || id AS label")
    placed = documents.grid(n, "g", ["id"])
    assert {r.col for r in placed.collect()} == {0, 1, 2} and placed.agg({"row": "max"}).first()[0] == 16
    xml = documents.drawio(placed, spark.createDataFrame([("g", "n00", "n01")], "g string, source string, target string"), "g").first().xml
    import xml.etree.ElementTree as E

    assert len(E.fromstring(xml).findall(".//mxCell")) == 2 + 50 + 1
