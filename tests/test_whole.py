"""The queries that leave nothing out, against brute force on small tables."""

from graphloom.operators import resolve
from graphloom.plans import catalogue
from pyspark.sql import functions as F


def saver(spark):
    return catalogue.Saved(spark).save


def test_reach_from_every_supplier(spark):
    # a ring, a ring before it, a tail behind it, a loner, and a node that is no supplier on the way
    pairs = [(1, 2), (2, 3), (3, 1), (1, 3), (30, 31), (31, 30), (31, 1), (3, 99), (99, 40), (40, 41), (50, 41)]
    ids = [1, 2, 3, 30, 31, 40, 41, 50, 60]
    suppliers = [(k, k % 4, -1.0 if k in (2, 30, 41) else None if k == 60 else 1.0) for k in ids]
    s = spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double")
    for edges in (pairs, [], [(b, a) for a, b in pairs]):
        want = set()
        for root in ids:
            seen, todo = {root}, [root]
            while todo:
                at = todo.pop()
                new = {b for a, b in edges if a == at} - seen
                seen |= new
                todo += new
            hit = [x for x in suppliers if x[0] in seen]
            bad = [x for x in hit if x[2] is not None and x[2] < 0]
            throws = bool(bad) if any(x[2] is not None for x in hit) else None
            want.add((root, throws, len(hit), len({x[1] for x in bad})))
        got = catalogue.reached(s, spark.createDataFrame(edges, "source long, target long"), saver(spark)).collect()
        assert len(got) == len(ids) and {tuple(r) for r in got} == want


def test_summary_follows_where_lines_are_left(spark):
    pairs = [(1, k) for k in range(100, 140)] + [(2, 1), (3, 2), (100, 3), (100, 1)]
    got = {tuple(r) for r in catalogue.summary(spark.createDataFrame(pairs, "source long, target long"), saver(spark)).collect()}
    want = set()
    for root in {a for a, _ in pairs}:
        one = {b for a, b in pairs if a == root}
        two = {b for a, b in pairs if a in one} - one - {root}
        rows = sorted([(1, x) for x in one] + [(2, x) for x in two])[:30]
        want |= {(root, x, depth, line) for line, (depth, x) in enumerate(rows, 1)}
    assert got == want


def test_no_supplier_is_left_out(spark):
    d = "/root/testdata/sf0.01"
    every = {r[0] for r in catalogue.table(spark, d, "supplier").select("s_suppkey").collect()}
    assert {r.root for r in catalogue.reach_can_throw(spark, d).collect()} == every and max(every) > 20


def test_every_page_is_call_and_endpoint(spark):
    hosts, paths = ["a.com", "b.com", "c.com"], ["/x", "/y", "/z"]
    rows = [(k, hosts[k % 7 % 3], paths[k % 5 % 3], k % 3, "GET" if k % 2 else "POST", f"see {hosts[k % 3]}") for k in range(40)]
    rows += [(100, "a.com", "/one", 1, "GET", "b.com"), (101, "b.com", "/one", 1, "GET", ""), (102, "c.com", "/two", 0, "GET", ""), (103, "a.com", "/two", 1, "GET", ""), (104, "a.com", "/alone", 0, "GET", "")]
    pages = spark.createDataFrame(rows, "page_id long, service string, path string, n_params long, method string, html string")
    score = lambda c, e: (60 + 20 * (c[3] == e[3]) + 20 * (e[1] in c[5])) / 100
    want = {}
    for c in rows:
        for e in rows:
            if c[1] != e[1] and c[2] == e[2] and c[4] == e[4]:
                n, best = want.get((c[0], e[1]), (0, 0))
                want[(c[0], e[1])] = (n + 1, max(best, score(c, e)))
    p = pages.withColumnRenamed("page_id", "id")
    groups = resolve.candidate_groups(p, p, F.col("html").contains(F.col("target_service")))
    found = groups.collect()
    assert len(found) == len(want) and {(r.id, r.target_service): (r.n, r.best) for r in found} == want
    calls = p.select("id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("endpoint_id"))
    status = {r.id: (r.n_candidates, r.status) for r in resolve.resolution(calls, groups, certain=0.8).collect()}
    for c in rows:
        mine = [v for (a, _), v in want.items() if a == c[0]]
        n = sum(k for k, _ in mine)
        assert status[c[0]] == (n, "unresolvable" if not n else "resolved" if n == 1 and mine[0][1] >= 0.8 else "pending_review")
    assert len(status) == len(rows) and {s for _, s in status.values()} == {"unresolvable", "resolved", "pending_review"}


def test_every_user_of_a_topic(spark):
    d = "/root/testdata/sf0.01"
    rows = catalogue.table(spark, d, "events").select("event_type", "user_id", "value").collect()
    want = {("u" + str(r.user_id), r.event_type) for r in rows if r.value is not None and r.value > 50}
    edges = catalogue.topic_edges(spark, d).collect()
    got = [(r.source, r.topic) for r in edges if r.kind == "publishes_to"]
    assert len(got) == len(want) and set(got) == want and max(int(s[1:]) for s, _ in got) >= 50
    assert {("u" + u, r.topic) for r in catalogue.topic_merge(spark, d).collect() for u in r.producers.split(",")} == want
