"""Structural edges, resources and scalar functions, case by case."""

from graphloom.functions import text as X
from graphloom.operators import edges as E
from graphloom.operators import errors, links, resources
from pyspark.sql import functions as F


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def test_imports(spark):
    files = spark.createDataFrame([("src/a/util.ts", "s:a", 1), ("src/b/util.ts", "s:b", 2), ("src/b/myutil.ts", "s:c", 0)], "file string, service string, ord long")
    m = spark.createDataFrame([("s:x", "./util"), ("s:x", "../b/util.ts"), ("s:x", "lodash"), ("s:x", "./nowhere"), ("s:x", None), ("s:x", "./util")], "service string, module string")
    assert rows(links.imports(m, files), "source", "target", "kind") == {("s:x", "s:a", "imports"), ("s:x", "s:b", "imports"), ("s:x", "lodash", "imports"), ("s:x", "./nowhere", "imports")}


def test_constructors_and_inheritance(spark):
    f = spark.createDataFrame([("f1", "constructor", "User", 1, []), ("f2", "constructor", "User", 2, []), ("f3", "constructor", "App", 3, [("u", "User<X>"), ("n", "number"), ("S", "String"), ("a", "App"), ("z", None)])], "id string, kind string, class_name string, ord long, params array<struct<name string, type string>>")
    assert rows(links.injected(f), "source", "target") == {("f3", "f2")}
    d = spark.createDataFrame([("d1", "Base", None, None, 1), ("d2", "Base", None, None, 2), ("d3", "Sub", "Base", ["Face", "Base"], 3), ("d4", "Own", "User", None, 4), ("d5", "Lost", "Nothing", None, 5)], "id string, name string, super_class string, implements array<string>, ord long")
    assert rows(links.inherits(d, f), "source", "target", "kind") == {("d3", "d2", "extends"), ("d4", "f2", "extends"), ("d3", "d2", "uses")}


def test_calls_and_components(spark):
    c = spark.createDataFrame([("c1", "f1", "resolved", "e1", 0.95, "exact", "s2"), ("c2", None, "resolved", "e2", 1.0, None, "s2"), ("c3", "f1", "pending_review", "e1", 0.8, None, None), ("c4", "f1", "resolved", None, 0.8, None, None)], "id string, container_id string, status string, endpoint_id string, confidence double, reason string, target_service string")
    got = links.resolved_calls(c)
    assert rows(got, "source", "target", "kind") == {("f1", "e1", "resolves_to"), ("c2", "e2", "resolves_to")} and got.where("source = 'f1'").first().meta["confidence"] == "0.95"
    s = spark.createDataFrame([("scr", ["Button", "Card", "Button", "Missing"])], "id string, `references` array<string>")
    k = spark.createDataFrame([("k2", "Button", 2), ("k1", "Button", 1), ("k3", "Card", 3)], "id string, name string, ord long")
    assert rows(links.components(s, k)) == {("scr", "k1"), ("scr", "k3")}
    assert rows(links.caller_service(spark.createDataFrame([("a.ts", "s2", 2), ("a.ts", "s1", 1)], "file string, service string, ord long"))) == {("a.ts", "s1")}
    d = spark.createDataFrame([("s1", "db:1", "sync", None, True)], "service string, target string, call_kind string, protocol string, critical boolean")
    assert links.depends_on(d).first().meta == {"kind": "sync", "protocol": None, "critical": "true"}


def test_resources(spark):
    t = spark.createDataFrame([("a", "Users", None, False, None, 1), ("a", "users", "User", None, True, 2), ("b", "users", "", None, None, 3)], "alias string, name string, entity_name string, has_timestamps boolean, has_soft_delete boolean, ord long")
    assert rows(resources.merge_tables(t)) == {("a", "users", "Users", "User", False, True), ("b", "users", "users", None, False, False)}
    u = spark.createDataFrame([("k", "t", "produce", "s1"), ("k", "t", "produce", "s1"), ("k", "t", "consume", "s2"), ("k", "t", "produce", "s0")], "alias string, topic string, role string, service string")
    assert resources.topic_lists(resources.merge_topics(u)).first()[2:] == (["s0", "s1"], ["s2"])
    h = spark.createDataFrame([("pg", "postgresql", "sql"), ("r", "redis", "kv"), ("r", "redis", "kv")], "alias string, engine string, category string")
    assert rows(resources.with_hints(h.limit(1), h), "alias") == {("pg",), ("r",)} and resources.with_hints(h.limit(1), h).count() == 2
    calls = spark.createDataFrame([("s1", "c2", "e1"), ("s1", "c1", "e1"), ("s2", "c3", "e1")], "service string, id string, endpoint_id string")
    ends = spark.createDataFrame([("e1", "s2")], "id string, service string")
    assert [tuple(r) for r in resources.resolved_dependencies(calls, ends).collect()] == [("s1", "s2", ["c1", "c2"])]
    f = spark.createDataFrame([("o1", "t1", "Name"), ("o1", "t1", "zzz"), ("o2", "t1", "zzz")], "op_id string, table_id string, field string")
    c = spark.createDataFrame([("col1", "t1", "name", "varchar", None, True, None, "orgs", None)], "id string, table_id string, name string, type string, nullable boolean, unique boolean, primary_key boolean, ref_table string, ref_column string")
    assert rows(resources.link_columns(f, c)) == {("o1", "col1", "column"), ("o2", "t1", "table")}
    assert resources.column_nodes(c).first()[1:] == ("t1", "name", "varchar", True, True, False, "orgs.id")
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int")
    assert rows(resources.upsert(old, new, ["id"])) == {("a", 1), ("b", 3), ("c", 4)} and rows(resources.insert_absent(old, new, ["id"])) == {("a", 1), ("b", 2), ("c", 4)}
    assert rows(resources.used_columns(spark.createDataFrame([("s", ["c1", "c1", "c2"]), ("s", None)], "service string, column_ids array<string>"))) == {("s", "c1"), ("s", "c2")}
    s3 = resources.remove_service(spark.createDataFrame([("s1",), ("s2",)], "id string"), spark.createDataFrame([("d1", "x/s1/db"), ("d2", None)], "id string, file string"), spark.createDataFrame([("s1", "d1"), ("s2", "d2")], "source string, target string"), "s1")
    assert [rows(x) for x in s3] == [{("s2",)}, {("d2", None)}, {("s2", "d2")}]


def test_views(spark):
    e = spark.createDataFrame([("s1", "d1", "sync"), ("s1", "d1", "sync"), ("s1", "x", "sync")], "source string, target string, kind string")
    t = spark.createDataFrame([("d1", "main"), ("s1", "web")], "id string, name string")
    assert rows(links.neighbours(e, t)) == {("s1", "d1", "main", "sync")}
    deps = spark.createDataFrame([("s1", "d1"), ("s1", "b1"), ("s1", "gone")], "service string, target string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(links.drawn_dependencies(ids("s1", "s2"), deps, ids("d1"), ids("b1", "d1"))) == {("s1", "d1", "database"), ("s1", "b1", "broker"), ("s2", None, None)}
    r = spark.createDataFrame([("r1", "f9", []), ("r2", None, ["'/x'", "mw", "ctl.find"]), ("r3", None, ["'/x'"]), ("r4", None, ["a.b"])], "id string, resolved_to string, arguments array<string>")
    f = spark.createDataFrame([("f2", "Ctl.find", 2), ("f1", "Other.find", 1)], "id string, name string, ord int")
    assert rows(links.handlers_of(r, f)) == {("r1", "f9"), ("r2", "f1"), ("r3", None), ("r4", None)}
    assert rows(links.owner_of(spark.createDataFrame([("e1", "s1")], "id string, service_id string"), t)) == {("e1", "s1", "web")}


def test_sources(spark, tmp_path, monkeypatch):
    import pytest
    from graphloom.sources import adapters, parse, scan

    assert adapters.prepare({"kind": "local", "path": str(tmp_path)}) == f"file://{tmp_path}" and adapters.prepare({"kind": "local", "path": "s3a://b/x"}) == "s3a://b/x"
    with pytest.raises(FileNotFoundError):
        adapters.prepare({"kind": "local", "path": f"{tmp_path}/none"})
    with pytest.raises(ValueError):
        adapters.prepare({"kind": "github"})
    monkeypatch.setitem(adapters.ADAPTERS, "given", lambda s: s["where"])
    assert adapters.prepare({"kind": "given", "where": "file:///x"}) == "file:///x"
    d = spark.createDataFrame([(p, 1, bytearray(b"x")) for p in ("a.ts", "b.tsx", "c.py", ".output/d.ts", "Pods/e.swift", "f.d.ts")], "path string, size long, content binary")
    got = lambda **k: {r.path for r in scan.source_files(d, **k).collect()}
    assert got() == {"a.ts", "b.tsx", "c.py"} and got(frontend=False) == {"a.ts", "c.py"} and got(extensions=[".py"]) == {"c.py"}
    monkeypatch.setitem(parse.PARSERS, "cobol", lambda path, text: [parse.Node("function", text, None, 1, 0, 1)])
    assert [n.name for n in parse.nodes_of("x", "cobol", "MAIN")] == ["MAIN"]
    one = spark.createDataFrame([("s", "x", "cobol", "MAIN")], "service string, path string, language string, text string")
    assert [r.name for r in parse.parse(one).collect()] == ["MAIN"]  # tasks know it too


def test_global_handlers(spark):
    f = spark.createDataFrame([("1", ["Catch(HttpException)"], ["e", "host"], "res.status(418)"), ("2", [], ["err", "req", "res", "next"], None), ("3", None, ["req", "res"], None), ("4", [], ["x", "req", "res", "next"], None)], "id string, decorators array<string>, params array<string>, raw string")
    assert rows(errors.global_handlers(f)) == {("1", 418), ("2", 500)}


def test_unresolved(spark):
    r = spark.createDataFrame([("e", "f", 1)], "endpoint string, node string, depth int")
    c = spark.createDataFrame([("f", "a.b", None), ("f", "this.x", None), ("f", "plain", None), ("f", "c.d", "f2")], "owner string, callee string, resolved_to string")
    assert rows(errors.unresolved(r, c)) == {("e", "a.b")}


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_log_categories(spark):
    cases = [("Unauthorized access", "error", "security"), ("boom", "fatal", "error"), ("incoming call", "info", "request"), ("user reply", "info", "response"), ("a crash", "warn", "error"), ("it took long", "info", "performance"), ("login ok", "info", "security"), ("server ready", "info", "lifecycle"), ("hallo", "info", "general"), ("span", "debug", "performance")]
    d = spark.createDataFrame([c[:2] for c in cases], "m string, l string")
    assert [r[0] for r in d.select(X.log_category(F.col("m"), F.col("l"))).collect()] == [c[2] for c in cases]
    go = spark.createDataFrame([("it took long", "info"), ("a crash", "info"), ("5 ms", "info")], "m string, l string")
    assert [r[0] for r in go.select(X.log_category(F.col("m"), F.col("l"), "go")).collect()] == ["general", "general", "performance"]


def test_error_status(spark):
    d = spark.createDataFrame([("HttpException",), ("AuthenticationError",), ("Foo",)], "n string")
    assert [tuple(r) for r in d.select(X.error_status(F.col("n")), X.error_status(F.col("n"), "java")).collect()] == [(400, None), (401, None), (None, None)]


def test_redact(spark):
    d = spark.createDataFrame([({"apiKey": "1", "credential": "2", "privateKey": "3", "authHeader": "4", "name": "x" * 600},)], "m map<string,string>")
    got = d.select(X.redact(F.col("m"))).first()[0]
    assert {k for k, v in got.items() if v == "[redacted]"} == {"apiKey", "credential", "privateKey", "authHeader"} and len(got["name"]) == 500
    n = spark.createDataFrame([(("u", ("p", [("t", 1)] * 30)),)], "s struct<user string, inner struct<password string, items array<struct<token string, n int>>>>")
    r = n.select(X.redact_struct(F.col("s"), n.schema["s"].dataType).alias("r")).first().r
    assert r.user == "u" and r.inner.password == "[redacted]" and len(r.inner["items"]) == 20 and r.inner["items"][0].token == "[redacted]" and r.inner["items"][0].n == 1


def test_small_functions(spark):
    assert one(spark, "/a/${id}//b", X.normalize_url) == "/a/:param/b"
    assert one(spark, "a.b*c(d)", X.escape_regex) == r"a\.b\*c\(d\)"
    assert one(spark, 'text {"a": [1, {"b": 2}]} more', X.json_in) == '{"a": [1, {"b": 2}]}' and one(spark, "no { json", X.json_in) is None
    assert one(spark, 120.0, X.clamp_score, "double") == 100 and one(spark, None, X.clamp_score, "double") == 50 and one(spark, -3.0, X.clamp_score, "double") == 0
    assert one(spark, "intro\n## A\nx\ny\n## B\nz\n## A\nlast", X.sections) == {"A": "last", "B": "z"}
    assert one(spark, "traceId=1 user_id", X.log_ids) == (True, True, False)
    assert [one(spark, e, X.database_category) for e in ("mysql", "redis", "neo4j", "other")] == ["sql", "kv", "graph", "nosql"] and one(spark, "pubsub", X.broker_category) == "event-bus"
    assert one(spark, 40, X.node_size, "int") == 56 and one(spark, 3, X.node_size, "int") == 32
    assert E.dedup(spark.createDataFrame([("a", "b", "k", 2), ("a", "b", "k", 1)], "source string, target string, kind string, ord long")).first().ord == 1
