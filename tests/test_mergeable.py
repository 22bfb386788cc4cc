"""Bitmaps of stored topologies against recomputation; forces of a layout against all pairs."""

import math
import random

import numpy as np
from graphloom.operators import edges, mergeable
from graphloom.saved import Saved
from graphloom.sinks import layout
from pyspark.sql import functions as F


def test_merged_coupling_equals_recomputed(spark):
    r = random.Random(3)
    functions = spark.createDataFrame([(i, f"g{i % 6}", f"c{i % 17}") for i in range(60)], "id long, grp string, cls string")
    e = [(r.randrange(70), r.randrange(70)) for _ in range(200)]
    parts = [spark.createDataFrame(e[i::3], "source long, target long") for i in range(3)]
    save = Saved(spark).save
    numbers = mergeable.dense(functions.where("id < 20"), "cls", save)
    early = {x.cls: x.number for x in numbers.collect()}
    numbers = mergeable.more_numbers(numbers, functions, "cls", save)
    got = {x.cls: x.number for x in numbers.collect()}
    assert sorted(got.values()) == list(range(17)) and all(got[k] == v for k, v in early.items())
    for inside in (False, True):
        stored = [mergeable.coupling_maps(p, functions, numbers, inside) for p in parts]
        merged = mergeable.merged(mergeable.merged(stored[0], stored[1]), stored[2])
        found = {tuple(x) for x in mergeable.coupling(merged, functions, "service").collect()}
        want = edges.coupling(parts[0].unionByName(parts[1]).unionByName(parts[2]), functions, "service", inside)
        assert found == {tuple(x) for x in want.collect()}


def test_numbers_beyond_one_bitmap(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("number"))
    m = mergeable.maps(rows, ["k"], "number")
    assert {x.k: x.n for x in mergeable.merged(m, m).groupBy("k").agg(F.sum(F.bitmap_count("map")).alias("n")).collect()} == {0: 33334, 1: 33333, 2: 33333}
    deps = spark.createDataFrame([("a", "d"), ("b", "d"), ("a", "e"), ("a", "d")], "service string, target string")
    numbers = mergeable.dense(deps, "service", Saved(spark).save)
    stored = mergeable.merged(mergeable.connections(deps.where("service = 'a'"), numbers), mergeable.connections(deps, numbers))
    assert {tuple(x) for x in mergeable.connection_counts(stored).collect()} == {("d", 2), ("e", 1)}


def test_forces_are_near_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 300, (1200, 2)), rng.normal(900, 60, (500, 2)), rng.uniform(-1500, 1500, (300, 2))])
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = np.array([[r.fx, r.fy] for r in layout.repulsion(at, Saved(spark).save).orderBy("id").collect()])
    d = xy[None] - xy[:, None]
    d2 = np.maximum((d**2).sum(2), layout.NEAR)
    want = (layout.CHARGE * d / d2[..., None]).sum(1)
    off = np.linalg.norm(got - want, axis=1) / np.linalg.norm(want, axis=1)
    print("relative error: median", np.median(off), "0.95", np.quantile(off, 0.95))
    assert np.linalg.norm(got - want) / np.linalg.norm(want) < 0.05 and np.quantile(off, 0.9) < 0.05


def test_layout(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(40)], "id string")
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(19)] + [("n1", "n1"), ("n0", "gone")], "source string, target string")
    one, two, other = (layout.layout(nodes, links, Saved(spark).save, rounds=4, seed=s).orderBy("id").collect() for s in (1, 1, 2))
    assert one == two != other and len(one) == 40
    at = {r.id: (r.x, r.y) for r in one}
    linked = [math.dist(at[f"n{i}"], at[f"n{i + 1}"]) for i in range(19)]
    apart = [math.dist(at[f"n{i}"], at[f"n{j}"]) for i in range(20) for j in range(20, 40)]
    assert np.mean(linked) < np.mean(apart)
    assert layout.layout(nodes.limit(0), links, Saved(spark).save, rounds=1).count() == 0
