"""Documents as variants: round trips of any depth, and nested ones against the reader of levels."""

import json

import pytest
from graphloom.saved import Saved
from graphloom.sinks import topology, variants

SCHEMA = "id string, parent_id string, service_id string, ord bigint, depth int, type string, name string, kind string, line int, end_line int, metadata map<string,string>"


def test_a_node_a_line(spark, tmp_path):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "s", 0, i, "call", f'na"me\n{i}', None, i, i + 1, {"k": "é", "n": "1"} if i % 2 else None) for i in range(3000)]
    variants.write_nodes(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/nodes")
    got = variants.read_nodes(spark, f"{tmp_path}/nodes")
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[4]) == rows
    variants.write_nodes(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert variants.read_nodes(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "bad").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|INVALID"):
        variants.read_nodes(spark, f"{tmp_path}/bad").collect()


def node(k, *children):
    return {"id": k, "type": "call", "name": k, "kind": "x", "line": 1, "endLine": 2, "metadata": {"a": k}, "children": list(children)}


def test_nested_documents(spark, tmp_path):
    deep = node("d0")
    for i in range(1, 120):
        deep = node(f"d{i}", deep, node(f"leaf{i}"))
    docs = [{"id": "s", "name": "S", "code": "s", "kind": "backend", "endpoints": [node("e", node("f"), node("g", node("h")))], "functions": [deep]}, {"topology": {"id": "t", "endpoints": [], "functions": [node("only")]}}]
    (tmp_path / "docs.json").write_text("\n".join(json.dumps(d) for d in docs) + "\n\n")
    got = variants.read_nested(spark, f"{tmp_path}/docs.json", Saved(spark).save)
    want = topology.read_topology(spark, f"{tmp_path}/docs.json", Saved(spark).save)[1]
    names = ["service_id", "parent_id", "ord", "depth", "id", "type", "name", "kind", "line", "end_line", "metadata"]
    key = lambda r: tuple(str(r[n]) for n in names)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*names).collect()))
    assert max(r.depth for r in got.collect()) == 119
