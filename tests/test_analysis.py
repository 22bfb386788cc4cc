"""A small repository in four languages, from files to edges."""

import pytest
from graphloom.plans import analysis
from graphloom.sources import parse, scan
from pyspark.sql import functions as F

FILES = {
    "users/requirements.txt": "fastapi\nsqlalchemy\npsycopg2\n",
    "users/app.py": '''
from fastapi import FastAPI
app = FastAPI()

class Store:
    def __init__(self, session):
        self.session = session

    def load(self, user_id):
        if user_id < 0:
            raise ValidationError("bad")
        return self.session.query(User).first()

@app.get("/users/{user_id}")
async def get_user(user_id: int):
    logger.info("loading user")
    try:
        found = await store.load(user_id)
    except KeyError:
        return None
    producer.send("user.read", found)
    return found

def helper():
    return get_user(1)
''',
    "web/package.json": '{"dependencies": {"express": "4"}}',
    "web/src/server.ts": '''
import express from "express";
// router.get("/comment", x)
export class UserClient {
  async load(id: string) {
    const res = await axios.get(`http://users/users/${id}`);
    if (!res.ok) { throw new NotFoundException("no"); }
    return res.data;
  }
  other() { return this.load("1"); }
}
app.get("/profile/:id", async (req, res) => {
  console.log("profile");
  res.json(await client.load(req.params.id));
});
''',
    "orders/pom.xml": "<artifactId>spring-boot</artifactId>",
    "orders/Order.java": '''
@RestController
@RequestMapping("/orders")
public class OrderController {
  private final OrderRepository repository;
  @GetMapping("/{id}")
  public Order find(Long id) {
    log.info("find");
    for (int i = 0; i < 3; i++) { touch(i); }
    return repository.findById(id);
  }
  private void touch(int i) { kafkaTemplate.send("order.touched", i); }
}
''',
    "stock/go.mod": "module stock\n",
    "stock/main.go": '''
package main
func (s *Server) List(c *gin.Context) {
  if c == nil { panic("nil") }
  s.db.Find(&items)
}
func main() {
  r.GET("/stock/:sku", s.List)
}
''',
    "web/src/server.test.ts": "it('x', () => {})",
    "users/broken.py": "def broken(:\n",
    "web/node_modules/x/index.js": "ignored()",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return f"file://{root}"


@pytest.fixture(scope="module")
def nodes(spark, repo):
    return analysis.nodes(spark, repo).cache()


def test_scan(spark, repo):
    files = scan.read_files(spark, repo)
    got = {r.path: r.language for r in scan.source_files(files).collect()}
    assert got == {"users/app.py": "python", "users/broken.py": "python", "web/src/server.ts": "typescript", "orders/Order.java": "java", "stock/main.go": "go"}
    found = scan.boundaries(files)
    assert {(r.root, r.manifest) for r in found.collect()} == {("users", "requirements.txt"), ("web", "package.json"), ("orders", "pom.xml"), ("stock", "go.mod")}
    stacks = {r.service: (r.framework, {h.engine for h in r.hints or []}) for r in scan.stacks(files, found).collect()}
    assert stacks["users"] == ("fastapi", {"postgres"}) and stacks["web"][0] == "express" and stacks["orders"][0] == "spring"
    none = scan.boundaries(files.where("path like '%.ts'"))
    assert [tuple(r) for r in none.collect()] == [("", "docker")]


def test_is_test(spark):
    cases = {"a/x.test.ts": True, "tests/x.py": False, "a/tests/x.py": True, "a/test_x.py": True, "x_test.go": True, "a/latest.py": False}
    rows = spark.createDataFrame(list(cases.items()), "path string, want boolean").withColumn("got", scan.is_test(F.col("path"))).collect()
    assert all(r.want == r.got for r in rows)


def test_nodes(nodes):
    rows = nodes.collect()
    of = lambda s, t: {(r.name, r.kind) for r in rows if r.service == s and r.type == t}
    endpoints = {(r.service, r.kind, r.meta["path"]) for r in rows if r.type == "endpoint"}
    assert endpoints == {("users", "GET", "/users/{user_id}"), ("web", "GET", "/profile/:id"), ("orders", "GET", "/orders/{id}"), ("stock", "GET", "/stock/:sku")}
    assert {"Store.__init__", "Store.load", "get_user", "helper"} == {n for n, _ in of("users", "function")}
    assert {"UserClient.load", "UserClient.other"} <= {n for n, _ in of("web", "function")}
    assert {"OrderController.find", "OrderController.touch"} <= {n for n, _ in of("orders", "function")}
    assert {"Server.List", "main"} == {n for n, _ in of("stock", "function")}
    assert ("user.read", "publish") in of("users", "event") and ("order.touched", "publish") in of("orders", "event")
    assert ("GET http://users/users/:param", "GET") in of("web", "externalCall")
    assert {"if", "try", "catch"} <= {n for n, _ in of("users", "flowControl")} and "for" in {n for n, _ in of("orders", "flowControl")}
    assert {r.meta["status"] for r in rows if r.type == "throw"} >= {"400", "404", "500"}
    for s in ("users", "web", "orders"):
        assert of(s, "log") and of(s, "call") and of(s, "return")
    assert of("users", "dbProcess") and of("orders", "dbProcess") and of("stock", "dbProcess")
    assert [r.path for r in rows if r.type == "diagnostic"] == ["users/broken.py"]


def test_edges(nodes):
    name = {r.id: r.name for r in nodes.where("type in ('function', 'endpoint')").collect()}
    edges = analysis.derived_edges(nodes).collect()
    calls = {(name.get(e.source), name.get(e.target)) for e in edges if e.kind == "calls"}
    assert ("helper", "get_user") in calls and ("UserClient.other", "UserClient.load") in calls and ("get_user", "get_user") in calls
    assert {e.kind for e in edges} >= {"calls", "reads_from", "publishes_to"}
    assert len(edges) == len({(e.source, e.target, e.kind) for e in edges})
    assert {r.rule for r in analysis.diagnostics(nodes, analysis.derived_edges(nodes)).collect()} >= {"function.unused", "file.unreadable"}


def test_nesting(nodes):
    rows = analysis.nested(nodes).collect()
    by_id = {r.id: r for r in rows}
    assert len(rows) == nodes.count()
    for r in rows:
        if r.parent_id:
            p = by_id[r.parent_id]
            assert p.path == r.path and p.line <= r.line <= p.end_line
    throw = next(r for r in rows if r.type == "throw" and r.service == "users")
    assert by_id[throw.parent_id].name == "if"


def test_cross_service(nodes):
    found = analysis.cross_service(nodes).collect()
    assert [(r.service, r.target_service, r.confidence) for r in found] == [("web", "users", 1.0)]


def test_masked():
    assert parse.mask('a("x{") // y{\n/* { */ `{`') == 'a("  ")      \n        ` `'
    assert parse.nodes_of("x.rb", "ruby", "x") == []


@pytest.fixture(scope="module")
def whole(spark, repo):
    from graphloom.plans.catalogue import Saved

    return analysis.topology(spark, repo, Saved(spark).save)


def test_topology(spark, whole, tmp_path):
    from graphloom.plans.catalogue import Saved
    from graphloom.sinks import topology

    save, t = Saved(spark).save, whole
    assert {(r.name, r.kind) for r in t["services"].collect()} == {(s, "backend") for s in ("users", "web", "orders", "stock")}
    known = {r.id for r in validate_ids(t)}
    for e in t["edges"].collect():
        assert e.source in known and (e.target in known or e.kind == "imports")
    assert not [r.message for r in t["diagnostics"].collect() if r.level == "error"]
    assert t["progress"].first().endpoints == 4 == t["endpoints"].count()
    handled = {(r.error_class, r.handled) for r in t["error_paths"].collect()}
    assert ("NotFoundException", False) in handled and ("ValidationError", True) in handled
    path = topology.write_topology(t["services"], t["tree"], f"{tmp_path}/t", save, roots=(str(tmp_path),))
    s, n = topology.read_topology(spark, path, save)
    assert s.count() == 4 and n.count() == t["tree"].count()


def validate_ids(t):
    from graphloom.operators import validate

    return validate.node_ids(t).collect()


def test_command_line(spark, repo, whole, tmp_path, capsys, monkeypatch):
    from graphloom.__main__ import main

    monkeypatch.setattr(analysis, "topology", lambda *a: whole)
    monkeypatch.chdir(tmp_path)
    assert main(["analyze", repo.removeprefix("file://"), "--output", f"{tmp_path}/out"]) == 0
    assert "services: 4" in capsys.readouterr().out
    assert main(["inspect", f"{tmp_path}/out"]) == 0 and "endpoints: 4" in capsys.readouterr().out
    said = lambda *a: (main(list(a)), capsys.readouterr().out.strip().splitlines()[-1])[1]
    first = said("enrich", f"{tmp_path}/out", "--dry-run")
    n = int(first.split()[2])
    assert n > 4 and first == f"to describe: {n} of {n}"
    assert said("enrich", f"{tmp_path}/out") == f"described: {n} of {n}"
    assert said("enrich", f"{tmp_path}/out") == f"described: 0 of {n}"  # nothing has changed
    with pytest.raises(SystemExit):
        main(["analyze", f"{tmp_path}/nothing"])
    with pytest.raises(ValueError):
        main(["analyze", repo.removeprefix("file://"), "--output", "/etc/out"])


MORE = {
    "web/package.json": '{"dependencies": {"express": "4", "pg": "8"}}',
    "web/src/math.ts": """
export function sum(req, res) {
  if (req.x) { }
  return add(x, y) + add(y, x) + add(x, x);
}
export function add(a, b) { return a + b; }
""",
    "web/src/routes.ts": """
import { sum } from "./math";
app.get("/sum", auth, sum);
app.post("/own", (req, res) => { return res.json(sum(1)); });
""",
    "web/src/long.ts": "export function wide() { " + "x(1); " * 2000 + "if (deep) { y(2); } return 3; }",
}


def test_handlers_repeats_and_long_lines(spark):
    """A route takes its handler's body; calls of one line are nodes each; columns beyond 4096 nest rightly; VL-23 can fire."""
    from graphloom.saved import Saved

    files = spark.createDataFrame([(p, len(t), bytearray(t.encode())) for p, t in MORE.items()], "path string, size long, content binary")
    t = analysis.topology_of(files, Saved(spark).save)
    names = {r.id: r.name for r in t["functions"].collect()}
    ends = {r.path: r for r in t["endpoints"].collect()}
    assert names[ends["/sum"].handler_fn_id] == "sum"
    tree = t["tree"].collect()
    ids = [r.id for r in tree]
    assert len(ids) == len(set(ids))
    own = lambda top: [r for r in tree if r.parent_id == top]
    assert [r.name for r in own(ends["/sum"].id) if r.type == "call"] == ["add"] * 3
    assert [r.type for r in own(ends["/sum"].id) if r.type in ("flowControl", "return")] == ["flowControl", "return"]
    assert "return" in {r.type for r in own(ends["/own"].id)}
    found = [(r.check, r.rule, r.node) for r in t["diagnostics"].collect()]
    assert not [f for f in found if f[0] == "VL-21" and f[2] == ends["/sum"].id]
    assert not [f for f in found if f[1] == "function.unused" and names.get(f[2]) == "sum"]
    assert [f for f in found if f[0] == "VL-23"]  # the empty branch
    deep = next(r for r in tree if r.name == "y")
    by_id = {r.id: r for r in tree}
    assert by_id[deep.parent_id].type == "flowControl" and len([r for r in tree if r.name == "x"]) == 2000
    assert [r.engine for r in t["databases"].collect()] in ([], ["postgres"])
    from graphloom.sinks import topology

    resolves = topology.flatten(t)[1].where("kind = 'RESOLVES'").collect()
    assert len([r for r in resolves if names[r.target] == "add"]) == 3
