"""Reachability over cyclic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(roots: DataFrame, edges: DataFrame, save, most: int | None = None) -> DataFrame:
    """(root, node, depth): every node that a root reaches, at its least depth, itself at 0.

    Each round joins the frontier with edges(source, target), and an anti join takes away what was visited. save(df, name)
    writes a table and returns it read back, so lineage stays short and lost executors lose nothing. A round's rows are
    linear in the edges out of the frontier. most: the largest depth.
    """
    seen = save(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")), "reach_0")
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        step = save(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"reach_{depth}")
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
        frontier = step
    return seen


def contract(edges: DataFrame, save) -> tuple[DataFrame, DataFrame]:
    """(node, part) of the nodes that reach the node of most edges out and are reached by it, all with it as their part; and
    the edges(source, target) between parts, where any other node is its own part. What reaches what stays the same.

    In a dense graph nearly all nodes are in this part, so that their pairs need not be listed.
    """
    hub = save(edges.groupBy(F.col("source").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id"), "hub")
    ahead = reach(hub, edges, lambda df, name: save(df, f"ahead_{name}"))
    back = reach(hub, edges.select(F.col("target").alias("source"), F.col("source").alias("target")), lambda df, name: save(df, f"back_{name}"))
    knot = save(ahead.join(back.select("node"), "node").select("node", F.col("root").alias("part")), "knot")
    a = knot.select(F.col("node").alias("source"), F.col("part").alias("a"))
    b = knot.select(F.col("node").alias("target"), F.col("part").alias("b"))
    out = edges.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("a", "source").alias("source"), F.coalesce("b", "target").alias("target"))
    return knot, save(out.where("source <> target").distinct(), "between")
