"""Files made of the tables: dealt before they are parsed, and parsed nodes handed on by type."""

import ast
import pathlib

import graphloom
from graphloom.plans import analysis, sources
from graphloom.sources import parse
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def test_files_are_dealt(spark):
    # the tables are one file each, which one task reads: it would parse all texts
    for like in ("svc%/c%.py", "svc%/s%.py", "web/src/pages/%"):
        found = sources.files(spark, D).where(f"path like '{like}'").groupBy(F.spark_partition_id().alias("p")).count()
        assert found.count() > 1


def test_types(spark):
    every = analysis.nodes_of(sources.files(spark, D).where("path like 'svc1/%' or path like 'web/src/pages/S1%'"))
    for types in (["column"], ["throw", "endpoint"], []):
        one = analysis.nodes_of(sources.files(spark, D).where("path like 'svc1/%' or path like 'web/src/pages/S1%'"), types=types)
        assert one.schema == every.schema
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(one) == rows(every.where(F.col("type").isin(types)))


def test_source_of_expressions():
    given = ["a.b.c", "f(x, 'y', k=1)(2).z", "1 .real", "'a'.join(b)", "await f(x)", "a < b <= c", "not a", "a if b else c", "f(*a, **b)", "f(-1)", "u'x'", "1.5", "1e999", "b'x'", "a is not None", "(a, b) in c", "f(x for x in y)", "a[1].b", "(a + b).c", "(await f)(x)", "lambda: 1", "f(k=(yield))", "x == -1", "f'{a}'", "...", "a not in b", "(a := 1)", "(a < b) < c"]
    trees = [ast.parse(f"async def f():\n  {x}").body[0].body[0].value for x in given]
    trees += [ast.parse(x).body[0] for x in ("raise", "raise E", "raise E('x', status_code=404)", "raise E(1) from e", "raise f(-1)")]
    for f in pathlib.Path(graphloom.__file__).parent.rglob("*.py"):
        trees += [x for x in ast.walk(ast.parse(f.read_text())) if isinstance(x, (ast.expr, ast.Raise)) and not isinstance(x, ast.Starred)]
    for x in trees:
        assert parse.source(x) == ast.unparse(x)


def written(monkeypatch, run):
    """The names of the tables that run() writes."""
    from graphloom.saved import Saved

    names, save = [], Saved.save
    monkeypatch.setattr(Saved, "save", lambda self, df, name: (names.append(name), save(self, df, name))[1])
    run()
    return names


def test_edges_place_calls_and_operations_by_one_sweep(spark, monkeypatch):
    assert written(monkeypatch, lambda: sources.source_edges(spark, D)).count("swept") == 1


def test_dependencies_need_no_whole_topology(spark, monkeypatch):
    assert written(monkeypatch, lambda: sources.source_dependencies(spark, D)) == ["parsed"]


def test_points_of_keys_over_many_partitions(spark):
    from graphloom.operators import nest

    # a file of 400 nested functions with points in each, over several partitions, and small ones
    big = [("big", k, k, 1000 - k, k) for k in range(400)]
    containers = spark.createDataFrame(big + [(f"s{k}", 10_000 + k, 0, 5, 0) for k in range(50)], "k string, container_id long, low long, high long, ord long")
    points = spark.createDataFrame([("big", k, k) for k in range(0, 1100, 3)] + [(f"s{k}", 10_000 + k, k % 9) for k in range(50)], "k string, node_id long, at long")
    one, two = (sorted(nest.smallest_span(points, containers, "k", "at", once=once).collect()) for once in (True, False))
    assert one == two and len(one) > 300


def test_nesting_puts_only_split_files_together(spark, monkeypatch):
    from graphloom.operators import nest
    from graphloom.saved import Saved

    asked, around = [], nest.around
    monkeypatch.setattr(nest, "around", lambda *a: (asked.append(a[5]), around(*a))[1])
    got = analysis.nested(Saved(spark).save(analysis.nodes_of(sources.files(spark, D).where("path like 'svc1/%'")), "parsed"))
    assert asked == [True, True]  # each node asks once
    assert got.where("type = 'throw' and parent_id like 'flowControl:%'").count() == got.where("type = 'throw'").count() > 0
