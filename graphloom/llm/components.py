"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Pairs that make a node a hub, and hubs that are sent to all tasks, at most.
MANY, HUBS = 200, 10_000


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """(node, component): the least node that each node of edges(a, b) is connected with.

    Alternates two steps until nothing changes, each linear in the edges: every
    node hands its larger neighbours to its least one (large star), then its
    smaller ones too (small star). Trees become stars in a number of rounds that
    grows with the logarithm of their size. Minima are aggregated before the
    shuffle; nodes with many neighbours are joined by sending their minima instead
    of gathering their neighbours.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = ws.write(e, f"{name}_0")
    done, turn = e.isEmpty(), 0
    while not done:
        # large star: (u, v) in both directions; neighbours above u go to the least around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("k")), f"{name}_low_{turn + 1}")
        large = with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.write(large, f"{name}_large_{turn + 1}")
        # small star: u and its smaller neighbours go to the least of them
        low = ws.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), f"{name}_least_{turn + 1}")
        moved = with_least(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        turn += 1
        small = ws.write(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}_{turn}")
        # both steps keep the number of edges or lower it; a star forest is where neither changes any
        same = small.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in ("large", "low", "least"):
            ws.drop(f"{name}_{old}_{turn}")
        if turn > 1:
            ws.drop(f"{name}_{turn - 2}")
        e, done = small, same
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_least(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """pairs(u, v) with m of low(u, m, k). Nodes with many pairs are few: at most HUBS of them, those of most pairs, are sent to all tasks, so that none of them gathers its pairs in one; the others are joined on u."""
    hubs = low.where(F.col("k") > MANY).orderBy(F.desc("k"), "u").limit(HUBS).select("u", "m")
    near = pairs.join(F.broadcast(hubs), "u", "left")  # HUBS rows
    rest = near.where("m is null").drop("m").join(low.join(F.broadcast(hubs.select("u")), "u", "left_anti").select("u", "m"), "u")
    return near.where("m is not null").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))
