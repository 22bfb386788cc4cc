"""Pre-order numbers and subtree sums against a plain walk; trees of any depth."""

import random

import pytest
from graphloom.operators import tree
from graphloom.plans.catalogue import Saved
from pyspark.sql import functions as F

SCHEMA = "id string, parent_id string, ord int, a int, b long, extra string"


def walk(rows):
    ids = {r[0] for r in rows}
    kids = {}
    for r in rows:
        kids.setdefault(r[1] if r[1] in ids else None, []).append(r)
    out, n = {}, 0
    for top in sorted(kids.get(None, []), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        stack, base = [(top, 0, False)], n
        path = []
        while stack:
            r, depth, done = stack.pop()
            if done:
                pre, a, b = path.pop()
                out[r[0]] = (top[0], depth, pre, n - 1, pre - base, a, b)
                if path:
                    path[-1][1] += a
                    path[-1][2] += b
                continue
            path.append([n, r[3] or 0, r[4] or 0])
            n += 1
            stack.append((r, depth, True))
            for c in sorted(kids.get(r[0], []), key=lambda r: (r[2] is not None, r[2] or 0, r[0]), reverse=True):
                stack.append((c, depth + 1, False))
    return {r[0]: out.get(r[0], (None,) * 7) for r in rows}


def run(spark, rows):
    d = tree.tour(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), Saved(spark).save, ["a", "b"])
    return {r.id: (r.root_id, r.depth, r.pre, r.last, r.position, r.total_a, r.total_b) for r in d.collect()}


def test_random_forest_with_cycles(spark):
    r = random.Random(4)
    rows = [(f"n{i}", f"n{r.randrange(max(1, i - 40), i)}" if i > 5 and r.random() < 0.95 else r.choice([None, "gone"]), r.choice([0, 1, 2, None]), r.choice([None, 1, 5]), i) for i in range(300)]
    rows += [("n400", "n402", 0, 1, 1), ("n401", "n400", 0, 1, 1), ("n402", "n401", 0, 1, 1), ("n403", "n402", 0, 1, 1), ("n500", "n500", 0, 1, 1)]
    assert run(spark, rows) == walk(rows)


def test_star_and_none(spark):
    rows = [("top", None, 0, 1, 1)] + [(f"leaf{i:04}", "top", -i, 1, i) for i in range(500)]
    assert run(spark, rows) == walk(rows)
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        run(spark, rows + rows[:1])


def test_a_chain_of_100_000(spark):
    n = 100_000
    d = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("ord"), F.lit(1).alias("a"))
    got = tree.tour(d, Saved(spark).save, ["a"]).cache()
    assert got.where("pre = id and depth = id and last = 99999 and total_a = 100000 - id and root_id = 0").count() == n
    got.unpersist()


def test_pairs_below_a_depth_of_100(spark):
    rows = [(i, i - 1 if i else None) for i in range(130)] + [(200, 202), (201, 200), (202, 201)]
    got = tree.descendants(spark.createDataFrame(rows, "id int, parent_id int"), Saved(spark).save).collect()
    want = {(a, b, b - a) for a in range(130) for b in range(a + 1, 130)}
    want |= {(a, b, d) for a, b, d in [(200, 201, 1), (200, 202, 2), (201, 202, 1), (201, 200, 2), (202, 200, 1), (202, 201, 2)]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_levels_and_list_agree(spark):
    r = random.Random(7)
    rows = [(f"n{i}", f"n{r.randrange(max(1, i // 3))}" if i > 9 and r.random() < 0.97 else r.choice([None, "gone"]), r.choice([0, 1, None]), r.choice([None, 1, 5]), i) for i in range(400)]
    rows += [("n500", "n501", 0, 1, 1), ("n501", "n500", 0, 1, 1), ("n502", "n500", 0, 1, 1)]
    df = spark.createDataFrame([(*x, "x") for x in rows], SCHEMA).repartition(5)
    for levels in (12, 0):
        folder = Saved(spark)
        d = tree.tour(df, folder.save, ["a", "b"], levels)
        assert {x.id: (x.root_id, x.depth, x.pre, x.last, x.position, x.total_a, x.total_b) for x in d.collect()} == walk(rows)
        names = [p.rpartition("/")[2] for _, p in folder.paths]
        assert sum(x.rpartition("-")[2].startswith("tour_") for x in names) <= 12, names  # rounds leave no tables
