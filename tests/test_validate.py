"""The validation rules, case by case."""

import pytest
from graphloom.operators import validate
from graphloom.plans.catalogue import Saved

SCHEMAS = {
    "services": "id string, name string, code string, kind string",
    "endpoints": "id string, service_id string, method string, path string, file string",
    "functions": "id string, service_id string, name string, kind string",
    "nodes": "id string, service_id string, type string, parent_id string, kind string, database_id string, operation string, method string, path string, event_name string, level string, branches int",
    "databases": "id string, name string, engine string, alias string",
    "brokers": "id string, name string, engine string, alias string",
    "screens": "id string, name string, file string",
    "edges": "source string, target string, kind string, operation string, topic string",
}
BASE = {
    "services": [("svc:1", "users", "users", "backend")],
    "endpoints": [("ep:1", "svc:1", "GET", "/users", "a.ts")],
    "functions": [("fn:1", "svc:1", "listUsers", "method")],
    "databases": [("db:1", "main", "postgresql", "main")],
    "edges": [("ep:1", "fn:1", "calls", None, None)],
}


def node(id_, type_, parent="ep:1", **kw):
    names = [c.split()[0] for c in SCHEMAS["nodes"].split(", ")]
    return tuple({"id": id_, "service_id": "svc:1", "type": type_, "parent_id": parent, **kw}.get(c) for c in names)


#: Columns that hold ids; each case has its own.
IDS = {"id", "service_id", "parent_id", "source", "target", "database_id"}


def run_all(spark, changes):
    """The findings of each case: ids of all cases are told apart by a prefix, so that one run does for all. Findings without any id come with every case."""
    tables = {t: [] for t in SCHEMAS}
    for i, change in enumerate(changes):
        for t, rows in (BASE | change).items():
            names = [c.split()[0] for c in SCHEMAS[t].split(", ")]
            tables[t] += [tuple(f"{i}/{v}" if c in IDS and v else v for c, v in zip(names, r)) for r in rows]
    frames = {t: spark.createDataFrame(tables[t], s) for t, s in SCHEMAS.items()}
    found = [tuple(r) for r in validate.validate(frames, Saved(spark).save).collect()]
    out = []
    for i in range(len(changes)):
        mine = [f for f in found if f'"{i}/' in f[4] or f" {i}/" in f[4] or (f[3] or "").startswith(f"{i}/") or not f[3]]
        out.append([(*f[:4], f[4].replace(f"{i}/", "")) for f in mine])
    return out


@pytest.fixture(scope="module")
def findings(spark):
    return run_all(spark, [{}, *(c[0] for c in CASES), *(c[0] for c in PASSES), {"edges": [("ep:1", "fn:1", "calls", None, None)] * 3}])


def has(found, text, level=None, check=None):
    return any(text in f[4] and level in (None, f[0]) and check in (None, f[2]) for f in found)


def test_minimal_is_valid(findings):
    assert [f for f in findings[0] if f[0] != "info" and f[3]] == []


CASES = [
    ({"services": [("svc:1", None, "u", "backend")]}, "missing name", "error", "VL-4"),
    ({"services": [("svc:1", "users", "", "backend")]}, "missing code", "warning", "VL-4"),
    ({"services": [("svc:1", "users", "u", "frontend")]}, "frontend", "warning", "VL-5"),
    ({"endpoints": [("ep:1", "svc:1", None, "/u", "a.ts")]}, "missing method", "error", "VL-6"),
    ({"endpoints": [("ep:1", "svc:1", "FETCH", "/u", "a.ts")]}, "invalid method", "error", "VL-6"),
    ({"endpoints": [("ep:1", "svc:1", "GET", "", "a.ts")]}, "missing path", "error", "VL-6"),
    ({"endpoints": [(None, "svc:1", None, "", "a.ts")]}, "missing id", "error", "VL-6"),
    ({"functions": [("fn:1", "svc:1", "listUsers", "lambda")]}, "unexpected kind", "warning", "VL-7"),
    ({"databases": [("db:1", "main", None, "main")]}, "missing engine", "error", "VL-1"),
    ({"databases": [("db:1", "main", "mysql", None)]}, "missing connectionAlias", "error", "VL-1"),
    ({"brokers": [("b:1", None, "kafka", "k")]}, "missing name", "warning", "VL-2"),
    ({"screens": [("s:1", "Cart", None)]}, "missing filePath", "warning", "VL-3"),
    ({"edges": [("nonexistent:123", "fn:1", "calls", None, None)]}, '"nonexistent:123" not found in topology node index', "warning", "VL-17"),
    ({"edges": [("ep:1", "nonexistent:456", "calls", None, None)]}, '"nonexistent:456" not found in topology node index', "warning", "VL-17"),
    ({"edges": [("fn:1", "fn:1", "calls", None, None)]}, "Self-loop", "warning", "VL-16"),
    ({"edges": [("ep:1", "fn:1", "calls", None, None)] * 2}, "Duplicate edge", "info", "VL-18"),
    ({"edges": [("ep:1", "db:1", "reads_from", None, None)]}, "missing metadata.operation", "info", "VL-19"),
    ({"edges": [("ep:1", "fn:1", "publishes_to", None, None)]}, "missing metadata.topic", "info", "VL-20"),
    ({"edges": [(None, "fn:1", "calls", None, None)]}, "missing source", "error", "VL-15"),
    ({"edges": []}, "no outgoing edges", "info", "VL-21"),
    ({"nodes": [node("c:1", "call")]}, "no return or throw nodes", "warning", "VL-22"),
    ({"nodes": [node("f:1", "flowControl", kind="if", branches=0)]}, "no children or branches", "info", "VL-23"),
    ({"nodes": [node("t:1", "flowControl", kind="try")]}, "no corresponding catch", "info", "VL-24"),
    ({"nodes": [node(None, "call")]}, "missing id", "error", "VL-8"),
    ({"nodes": [node("d:1", "dbProcess", operation="create")]}, "missing databaseId", "warning", "VL-9"),
    ({"nodes": [node("e:1", "externalCall", path="/x")]}, "missing method", "warning", "VL-10"),
    ({"nodes": [node("v:1", "event")]}, "missing eventName", "warning", "VL-11"),
    ({"nodes": [node("l:1", "log", level="loud")]}, "invalid level", "warning", "VL-12"),
    ({"nodes": [node("m:1", "telemetry", kind="gauge")]}, "invalid kind", "warning", "VL-13"),
    ({"nodes": [node("f:1", "flowControl")]}, "missing kind", "warning", "VL-14"),
    ({"functions": [("fn:1", "svc:1", "go", "method")]}, "short name", "warning", "VL-25"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_found(findings, i):
    _, text, level, check = CASES[i]
    assert has(findings[1 + i], text, level, check)


PASSES = [
    ({}, "not found in topology node index"),
    ({}, "no outgoing edges"),
    ({"nodes": [node("r:1", "return")]}, "no return or throw nodes"),
    ({"nodes": [node("r:1", "throw"), node("c:1", "call")]}, "no return or throw nodes"),
    ({"nodes": []}, "no return or throw nodes"),
    ({"nodes": [node("f:1", "flowControl", kind="if"), node("r:1", "return", "f:1")]}, "no return or throw nodes"),
    ({"nodes": [node("t:1", "flowControl", kind="try"), node("k:1", "flowControl", kind="catch")]}, "no corresponding catch"),
    ({"nodes": [node("t:1", "flowControl", kind="try"), node("k:1", "flowControl", "t:1", kind="catch")]}, "no corresponding catch"),
    ({"nodes": [node("f:1", "flowControl", kind="if")]}, "no children or branches"),
    ({"nodes": [node("l:1", "log", level="warn")]}, "invalid level"),
]


@pytest.mark.parametrize("i", range(len(PASSES)))
def test_not_found(findings, i):
    assert not has(findings[1 + len(CASES) + i], PASSES[i][1])


def test_three_repeats_are_two_findings(findings):
    assert sum("Duplicate" in f[4] for f in findings[-1]) == 2
