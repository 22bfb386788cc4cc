"""Stored tables, pages, incremental graphs, sessions and the repository source, each against a plain form."""

import glob
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from graphloom.operators import increment
from graphloom.saved import Saved
from graphloom.sinks.store import Ecosystem, Pages, Store
from graphloom.sources import repository
from graphloom.streaming import sessions
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mtimes(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/t", T.StructType.fromDDL("id string, part int, value string"), ("id", "part"), 8)
    r, want = random.Random(1), {}
    rows = lambda n: {(f"k{r.randrange(30)}" if r.random() < 0.95 else None, r.randrange(2)): f"v{r.random()}" for _ in range(n)}
    df = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], "id string, part int, value string")
    for turn in range(4):
        before = mtimes(s.path)
        if turn % 2 == 0:
            batch = rows(6)
            touched = s.upsert(df(batch))
            want |= batch
        elif turn == 1:
            batch = rows(5)
            touched = s.insert_absent(df(batch))
            want = batch | want
        else:
            touched = s.delete(F.col("id") < "k2")
            want = {k: v for k, v in want.items() if not (k[0] is not None and k[0] < "k2")}
        after = mtimes(s.path)
        for f, t in before.items():
            if int(f.split("_bucket=")[1].split("/")[0]) not in touched:
                assert after[f] == t
        assert {(x.id, x.part): x.value for x in s.table().collect()} == want
    k = next(k for k in want if k[0])
    assert [x.value for x in s.get(*k).collect()] == [want[k]] and s.get("none", 1).collect() == []
    plan = s.get(*k)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(_bucket" in plan
    assert s.delete(F.lit(True)) and s.table().collect() == [] and s.delete(F.lit(True)) == []
    assert s.upsert(df({})) == []


def test_order_of_batches_does_not_matter(spark, tmp_path):
    batches = [[(f"a{i}", "x")] for i in range(3)] + [[(f"b{i}", "y") for i in range(4)]]
    got = []
    for name, order in (("p", batches), ("q", batches[::-1])):
        s = Store(spark, f"{tmp_path}/{name}", T.StructType.fromDDL("id string, v string"), ("id",), 4)
        for b in order:
            s.upsert(spark.createDataFrame(b, "id string, v string"))
        got.append(sorted(map(tuple, s.table().collect())))
    assert got[0] == got[1] == sorted(x for b in batches for x in b)


def test_ecosystem(spark, tmp_path):
    e = Ecosystem.at(spark, str(tmp_path), 4)
    t = spark.createDataFrame
    put = lambda s, n: e.put(t([(s, s.upper(), n)], "id string, name string, endpoint_count long"), t([("db", "main", "pg", f"{s}/x.ts")], "id string, name string, engine string, file string"), t([(s, "db", "uses"), ("z", s, "calls")], "source string, target string, kind string"))
    put("a", 1)
    put("b", 2)
    put("a", 3)
    assert sorted(map(tuple, e.services.table().collect())) == [("a", "A", 3), ("b", "B", 2)]
    assert [r.file for r in e.databases.table().collect()] == ["a/x.ts"] and e.edges.table().count() == 4
    e.remove("a")
    assert [r.id for r in e.services.table().collect()] == ["b"] and e.databases.table().count() == 0
    assert sorted((r.source, r.target) for r in e.edges.table().collect()) == [("b", "db"), ("z", "b")]


def test_pages(spark, tmp_path):
    rows = [(i * 7 % 1000, None if i % 50 == 0 else f"n{i % 13}") for i in range(1000)]
    p = Pages(spark, str(tmp_path))
    p.write(spark.createDataFrame(rows, "id int, name string"), ["name", "id"], 6)
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))
    for limit, offset in ((20, 0), (20, 490), (300, 100), (20, 990), (20, 5000), (0, 3)):
        got, total = p.page(limit, offset)
        assert [tuple(r) for r in got.collect()] == want[offset : offset + limit] and total == 1000
    got, _ = p.page(20, 700)
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [_part" in plan or "PartitionFilters: [isnotnull(_part" in plan
    used = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert used.count(",") <= 2, used  # one or two partitions


def extract(files):
    calls = files.select("path", F.explode("calls").alias("c")).select("path", "c.*")
    return calls.select("path", F.col("_1").alias("source"), F.col("_2").alias("callee")), files.select("path", F.explode("functions").alias("c")).select("path", F.col("c._1").alias("callee"), F.col("c._2").alias("target"))


def test_any_changes_equal_recomputation(spark):
    r, files, g = random.Random(2), {}, increment.CallGraph.empty(spark)
    save, read = Saved(spark).save, []
    schema = "path string, calls array<struct<_1:string,_2:string>>, functions array<struct<_1:string,_2:string>>"

    def seen(fresh):
        read.append({x.path for x in fresh.select("path").collect()})
        return extract(fresh)

    for _ in range(4):
        before = dict(files)
        for p in r.sample([f"f{i}" for i in range(8)], 4):
            if p in files and r.random() < 0.4:
                del files[p]
            else:
                files[p] = ([(f"s{r.randrange(4)}", f"n{r.randrange(5)}") for _ in range(r.randrange(4))], [(f"n{r.randrange(5)}", f"t{r.randrange(4)}") for _ in range(r.randrange(3))])
        df = spark.createDataFrame([(p, *x) for p, x in files.items()], schema).withColumn("hash", increment.hash_object("functions", "calls"))
        g = g.step(df, seen, save)
        edges = Counter((s, t) for c, _ in files.values() for s, n in c for _, fs in files.values() for m, t in fs if n == m)
        assert {(x.source, x.target): x.n for x in g.edges.collect()} == edges
        assert {x.target: x.n for x in g.degrees.collect()} == Counter(t for _, t in edges)
        assert read[-1] == {p for p in files if files[p] != before.get(p)}


def test_stale_items_and_bad_deltas(spark):
    t = spark.createDataFrame
    items = t([("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)], "id string, v int, w string")
    had = items.where("id <> 'c'").withColumn("hash", increment.hash_object("w", "v")).withColumn("v", F.lit(0))
    assert [r.id for r in increment.stale(had, items, ["v", "w"]).collect()] == ["c"]
    assert sorted(r.id for r in increment.stale(had, items.withColumn("w", F.when(F.col("id") == "a", "z").otherwise(F.col("w"))), ["v", "w"]).collect()) == ["a", "c"]
    with pytest.raises(Exception, match="takes away"):
        increment.merge(t([("a", 1)], "k string, n long"), t([("a", -2)], "k string, n long")).collect()


def simulate(events, end):
    """Plain rule: a clock, a map, a sweep every ten minutes that comes before events of its moment."""
    out, opened = [], {}
    ticks = [("tick", t) for t in range(0, end + 1, 600)]
    for what in sorted([(t, 0, None, None) for _, t in ticks] + [(t, 1 if k == "open" else 2, s, k) for s, t, k in events if t <= end], key=lambda x: (x[0], x[1], str(x[2]))):
        t, turn, s, k = what
        if turn == 0:
            for x in [x for x, c in opened.items() if c < t - 1800]:
                out.append((x, t, "expired"))
                del opened[x]
        elif k == "open":
            out.append((s, t, "opened"))
            opened[s] = t
        else:
            out.append((s, t, "decided" if opened.pop(s, None) is not None else "unknown"))
    return sorted(out)


def test_sessions(spark, tmp_path):
    r = random.Random(5)
    events = [(f"s{r.randrange(12)}", r.randrange(0, 200) * 60 + r.choice([0, 0, 17]), r.choice(["open", "open", "decide"])) for _ in range(120)]
    events = list({(s, t): (s, t, k) for s, t, k in events}.values()) + [("end", 400 * 60, "decide")]
    base = datetime(2024, 1, 1)
    schema = "session_id string, at timestamp, kind string"
    # four batches by time, each with some events of the next
    by_time = sorted(events, key=lambda e: e[1] + r.randrange(0, 1200))
    cuts = [by_time[i : i + 32] for i in range(0, len(by_time), 32)]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        for b in cuts:
            spark.createDataFrame([(s, base + timedelta(seconds=t), k) for s, t, k in b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = sessions.outcomes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "30 minutes")
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            q.awaitTermination(300)
    finally:
        spark.conf.set(key, before)
    got = sorted((x.session_id, int((x.at - base).total_seconds()), x.outcome) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == simulate(events, 400 * 60 - 1800)
    assert {o for _, _, o in got} == {"opened", "decided", "unknown", "expired"}


def test_repository_source(spark, tmp_path):
    for name, text in {"a/x.py": "print(1)", "a/y.ts": "let y", "b/z.py": "z" * 500, "node_modules/q.py": "no", "b/empty.py": "", "top.go": "package a"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    repository.register(spark)
    df = spark.read.format("repository").load(str(tmp_path))
    all_ = {r.path: (r.extension, r.size, bytes(r.content)) for r in df.collect()}
    assert set(all_) == {"a/x.py", "a/y.ts", "b/z.py", "top.go"} and all_["a/x.py"] == (".py", 8, b"print(1)")
    from graphloom.sources import scan

    want = {(r.path, r.text) for r in scan.source_files(scan.read_files(spark, f"file://{tmp_path}")).collect()}
    assert {(r.path, r.text) for r in scan.source_files(df.select("path", "size", "content")).collect()} == want
    (tmp_path / "a/link.py").symlink_to(tmp_path / "a/x.py")
    assert df.count() == 4
    for cond in ("extension = '.py' and size < 100", "path like 'b/%'", "size >= 9 and extension in ('.go', '.py')", "extension = '.py' or size = 5", "length(path) > 6", "path is not null and path like '%.py'"):
        want = {r.path for r in spark.createDataFrame(df.collect(), df.schema).where(cond).collect()}
        assert {r.path for r in df.where(cond).collect()} == want == {r.path for r in repository.read(spark, str(tmp_path), cond).collect()}
    pushed = repository.RepositoryReader({"path": str(tmp_path), "push": "true"})
    from pyspark.sql import datasource as D

    rest = list(pushed.pushFilters([D.EqualTo(("extension",), ".py"), D.LessThan(("size",), 100), D.IsNull(("content",))]))
    assert [p for p, _ in pushed.walk()] == ["a/x.py"] and [type(f) for f in rest] == [D.IsNull]
    plan = repository.read(spark, str(tmp_path), "extension = '.py'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Filter" not in plan.split("BatchScan")[0] and "EqualTo(extension,.py)" in plan.replace("`", "").replace(" ", "")
    with pytest.raises(Exception, match="isn't a folder"):
        spark.read.format("repository").load(f"{tmp_path}/nothing").collect()
