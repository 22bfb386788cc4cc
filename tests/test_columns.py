"""Columns of operations against pairs of all fields and columns."""

import random

from graphloom.operators import resources


def test_links(spark):
    r = random.Random(5)
    fields = [(r.randrange(30), r.choice(["a", "b", None]), r.choice(["x", "X", "y", "z", "none", None])) for _ in range(200)]
    columns = [(r.choice(["c1", "c2", "c3", "c4", "c5", None]), r.choice(["a", "b", None]), r.choice(["X", "x", "Y", "w", None])) for _ in range(12)] + [("c6", "a", "z"), ("c6", "a", "Z"), ("c7", "b", "x")]
    f, c = spark.createDataFrame(fields, "op_id long, table_id string, field string"), spark.createDataFrame(columns, "id string, table_id string, name string")
    hit = {(o, i, "column") for o, t, x in fields for i, u, n in columns if None not in (t, x, n, i) and t == u and x.lower() == n.lower()}
    none = {(o, t, "table") for o, t, _ in fields if o not in {h[0] for h in hit}}
    df = resources.link_columns(f, c)
    got = [tuple(x) for x in df.collect()]
    assert sorted(got, key=repr) == sorted(hit | none, key=repr)
    # links of columns with one name aren't put together after the join
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert next(x for x in plan.split("\n") if x.startswith(":- ")).startswith(":- Project")
