"""Resolution with an oracle and in both directions, types, shapes, filters and hooks."""

from graphloom.operators import enrich, resolve
from graphloom.plans.catalogue import Saved
from pyspark.sql import functions as F


def rows(df):
    return {tuple(r) for r in df.collect()}


CALLS = "id string, service string, method string, path string, n_params int, base string, status string, endpoint_id string"
ENDS = "id string, service string, method string, path string, n_params int"


def parts(spark):
    calls = spark.createDataFrame([
        ("c1", "web", "GET", "/u/:param", 1, "http://users", None, None), ("c2", "web", "GET", "/x", 0, "", None, None), ("c3", "web", "GET", "/none", 0, "", None, None),
        ("c4", "web", "GET", "/x", 0, "", "resolved", "old"), ("c5", "users", "GET", "/u/:param", 1, "", None, None), ("c6", "web", "POST", "/one", 0, "", None, None),
    ], CALLS)
    ends = spark.createDataFrame([("e1", "users", "GET", "/u/:param", 1), ("e2", "a", "GET", "/x", 0), ("e3", "b", "GET", "/x", 2), ("e4", "a", "POST", "/one", 0), ("e5", "a", "GET", "/x", 0)], ENDS)
    return calls, ends, resolve.candidate_groups(calls, ends, F.col("base").contains(F.col("target_service")))


def test_resolution(spark):
    calls, ends, groups = parts(spark)
    assert {(r.id, r.target_service, r.n, r.best, r.endpoint_id) for r in groups.collect() if r.id in ("c1", "c2")} == {("c1", "users", 1, 1.0, "e1"), ("c2", "a", 2, 0.8, "e2"), ("c2", "b", 1, 0.6, "e3")}
    got = {r.id: tuple(r)[1:4] for r in resolve.resolution(calls, groups).collect()}
    assert got == {"c1": (1, "resolved", "e1"), "c2": (3, "pending_review", None), "c3": (0, "unresolvable", None), "c4": (3, "resolved", "old"), "c5": (0, "unresolvable", None), "c6": (1, "pending_review", None)}
    oracle = spark.createDataFrame([("c2", "e3", True), ("c6", "e4", False)], "id string, endpoint_id string, sure boolean")
    told = resolve.resolution(calls, groups, oracle)
    assert {(r.id, r.status, r.endpoint_id) for r in told.collect() if r.id in ("c2", "c6")} == {("c2", "resolved", "e3"), ("c6", "pending_review", None)}
    wait = {r.id: [(c.endpoint_id, c.confidence) for c in r.candidates] for r in resolve.pending(calls, resolve.resolution(calls, groups), groups).collect()}
    assert wait == {"c2": [("e2", 0.8), ("e3", 0.6)], "c6": [("e4", 0.8)]}
    stored = calls.withColumn("status", F.lit("unresolvable"))
    both = resolve.both_ways(calls.limit(1), ends, stored, spark.createDataFrame([("n1", "new", "GET", "/none", 0)], ENDS), F.lit(False))
    assert {(r.id, r.endpoint_id) for r in both.collect()} == {("c1", "e1"), ("c3", "n1")}


def test_types(spark):
    d = spark.createDataFrame([("Array<User>",), ("User[]",), ("User?",), ("string",), ("Promise<string>",)], "t string")
    assert [r[0] for r in d.select(enrich.base_type(F.col("t"))).collect()] == ["User", "User", "User", None, None]
    index = spark.createDataFrame([("User", "name", "string", 1), ("User", "org", "Old", 1), ("User", "org", "Org", 2), ("Org", "owner", "User", 1), ("Org", "tag", "Tag[]", 1), ("Tag", "deep", "Deep", 1), ("Deep", "x", "string", 1)], "name string, field string, type string, ord int")
    got = rows(enrich.type_fields(spark.createDataFrame([("r", "Page<User>")], "id string, type string"), index))
    assert got == {("r", "name", "string"), ("r", "org", "Org"), ("r", "org.owner", "User"), ("r", "org.tag", "Tag[]"), ("r", "org.tag.deep", "Deep")}
    s = spark.createDataFrame([("{ id: 1,\n name,\n 'x': y, return }",)], "t string")
    assert s.select(enrich.return_shape(F.col("t"))).first()[0] == ["id", "name", "x"]


def test_filters(spark):
    logs = spark.createDataFrame([("a", "debug"), ("b", "warn"), ("c", "fatal")], "id string, level string")
    assert rows(enrich.at_least(logs, "warn").select("id")) == {("b",), ("c",)}
    k = spark.createDataFrame([("react", 0, 2, 0), ("express", 3, 0, 1), ("kafka", 0, 0, 2)], "f string, e int, s int, c int")
    assert [r[0] for r in k.select(enrich.service_kind(*[F.col(c) for c in "fesc"])).collect()] == ["frontend", "backend", "worker"]
    assert spark.createDataFrame([("apollo",)], "f string").select(enrich.protocol(F.col("f"))).first()[0] == "graphql"
    n = spark.createDataFrame([("1", "call", "f"), ("2", "log", "f"), ("2", "log", "f")], "id string, type string, parent_id string")
    assert rows(enrich.shown(n)) == {("1", "call", "f")} and enrich.logs_and_telemetry(n).count() == 1
    f = spark.createDataFrame([("f", "method"), ("g", "method"), ("h", "constructor")], "id string, kind string")
    assert rows(enrich.enrichable(f, n)) == {("f", "method")}
    assert enrich.mean_score(spark.createDataFrame([], "score double")).first().score == 100 and enrich.mean_score(spark.createDataFrame([(50.0,), (71.0,)], "score double")).first().score == 61
    sc = spark.createDataFrame([("a", None), ("b", "s1"), ("c", "s2")], "id string, service_id string")
    assert {r.id for r in enrich.screens_of(sc, "s1").collect()} == {"a", "b"}


def test_hooks(spark):
    n = spark.createDataFrame([("e", None, 0, "endpoint", "GET /"), ("a", "e", 2, "call", "x"), ("b", "e", 1, "flowControl", "if"), ("c", "b", 1, "return", None)], "id string, parent_id string, ord long, type string, name string")
    flows = enrich.flow_text(n, Saved(spark).save)
    assert flows.first().text == "flowControl if\n  return \ncall x"
    assert enrich.judge(flows).first().score == 100 and enrich.judge(flows, lambda d: d.withColumn("score", F.lit(140))).first().score == 100
    items = spark.createDataFrame([("i", "Makes things. And more.")], "id string, text string")
    assert enrich.describe(items).first().description == "Makes things." and enrich.describe(items, lambda d: d.select("id", F.lit("m").alias("description"))).first().description == "m"
    assert {(r.id, r.batch) for r in enrich.batches(n, "type", ["id"], 1).collect()} == {("e", 0), ("a", 0), ("b", 0), ("c", 0)}


def test_return_fields(spark):
    t = spark.createDataFrame
    returns = t([("f", 1, "value"), ("f", 2, "{}"), ("f", 3, "{\n  id: user.id,\n  name ,\n  id: 2,\n  return: x\n  total + 1\n}"), ("f", 4, "{\n other\n}"), ("g", 1, "{ a: 1"), ("h", 1, None)], "fn_id string, ord int, value string")
    variables = t([("f", 1, "name", "string"), ("f", 2, "name", "Name"), ("f", 3, "id", ""), ("g", 1, "id", "x")], "fn_id string, ord int, name string, type string")
    assert sorted(map(tuple, enrich.return_fields(returns, variables).collect())) == [("f", 1, "id", "unknown"), ("f", 2, "name", "Name")]
