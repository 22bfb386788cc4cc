"""A seeded force-directed layout: links pull, all nodes push each other.

The push of what is far is summed over grid cells. On every level of a grid of 2^l by
2^l cells a node meets the cells that are near its cell's parent but not near its own
cell, at most 27, as if their nodes were in their middle of mass; only nodes of cells
next to its own on the finest level are met one by one. So a round makes a bounded
number of rows a node and level, and no pair of all nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the layout of an ecosystem uses: push of a node, distance of linked nodes and pull of a link.
CHARGE, DISTANCE, PULL = -600.0, 180.0, 0.4
#: Nodes of a cell of the finest level, about.
CELL = 4
#: Squared distance below which a push grows no more.
NEAR = 1.0


def start(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(id, x, y): nodes(id) on a square as wide as their number asks for, by a hash of id and seed."""
    n = nodes.count()
    side = 30.0 * math.sqrt(max(1, n))
    unit = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40) - 0.5) * side
    return nodes.select("id", unit(1).alias("x"), unit(2).alias("y"))


def _push(dx: Column, dy: Column, mass: Column, charge: float) -> tuple[Column, Column]:
    """The push of a mass at a distance: charge / distance away from it."""
    d2 = F.greatest(dx * dx + dy * dy, F.lit(NEAR))
    return dx * mass * charge / d2, dy * mass * charge / d2


def repulsion(at: DataFrame, save, charge: float = CHARGE) -> DataFrame:
    """(id, fx, fy): the push of all other nodes on each of at(id, x, y), those of far cells taken together. Nodes of equal place don't push each other."""
    box = at.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box.n:
        return at.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    deepest = max(2, math.ceil(math.log2(max(1.0, box.n / CELL)) / 2))
    side = max(box.x1 - box.x0, box.y1 - box.y0, 1e-9) * (1 + 1e-9)
    cell = lambda c, low, level: F.floor((F.col(c) - F.lit(low)) / side * (1 << level))
    fine = save(at.select("id", "x", "y", cell("x", box.x0, deepest).alias("i"), cell("y", box.y0, deepest).alias("j")), "cells")
    # mass and middle of every cell of every level
    sums = fine.groupBy("i", "j").agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).withColumn("level", F.lit(deepest))
    every = sums.select(F.explode(F.sequence(F.lit(2), F.lit(deepest))).alias("level"), "i", "j", "m", "sx", "sy")
    up = lambda c: F.expr(f"shiftright({c}, {deepest} - level)").alias(c)
    cells = save(every.select("level", up("i"), up("j"), "m", "sx", "sy").groupBy("level", "i", "j").agg(*[F.sum(c).alias(c) for c in ("m", "sx", "sy")]), "masses")
    # children of the cells around the parent, but those next to the cell itself: six by six places
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(6) for b in range(6)]))
    own = fine.select("id", "x", "y", F.explode(F.sequence(F.lit(2), F.lit(deepest))).alias("level"), "i", "j").select("id", "x", "y", "level", up("i"), up("j"))
    # forces of cells are taken once for each cell that meets them, as masses; only then do nodes meet them
    ask = own.select("level", "i", "j").distinct().select("level", "i", "j", steps.alias("s"))
    other = lambda c, s: ((F.expr(f"shiftright({c}, 1)") - 1) * 2 + F.col(f"s.{s}")).alias(f"{c}2")
    ask = ask.select("level", "i", "j", other("i", "a"), other("j", "b")).where("abs(i2 - i) > 1 or abs(j2 - j) > 1")
    far = ask.join(cells.select("level", F.col("i").alias("i2"), F.col("j").alias("j2"), "m", (F.col("sx") / F.col("m")).alias("cx"), (F.col("sy") / F.col("m")).alias("cy")), ["level", "i2", "j2"]).select("level", "i", "j", "m", "cx", "cy")
    hit = own.join(far, ["level", "i", "j"])
    fx, fy = _push(F.col("cx") - F.col("x"), F.col("cy") - F.col("y"), F.col("m"), charge)
    parts = hit.select("id", fx.alias("fx"), fy.alias("fy"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = fine.select("id", "x", "y", "i", "j", around.alias("s")).select(F.col("id").alias("me"), "x", "y", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    close = near.join(fine.select("id", F.col("x").alias("ox"), F.col("y").alias("oy"), "i", "j"), ["i", "j"]).where("me <> id")
    fx, fy = _push(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"), F.lit(1), charge)
    parts = parts.unionByName(close.select(F.col("me").alias("id"), fx.alias("fx"), fy.alias("fy")))
    total = parts.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    zero = F.lit(0.0)
    return at.select("id").join(total, "id", "left").select("id", F.coalesce("fx", zero).alias("fx"), F.coalesce("fy", zero).alias("fy"))


def pulls(at: DataFrame, links: DataFrame, distance: float = DISTANCE, pull: float = PULL) -> DataFrame:
    """(id, fx, fy): springs of links(source, target) towards a distance, each end drawn half of what is missing."""
    a = at.select(F.col("id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = at.select(F.col("id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = links.where("source <> target").select("source", "target").distinct().join(a, "source").join(b, "target")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
    k = (d - distance) / d * (pull / 2)
    ends = F.array(F.struct(F.col("source").alias("id"), (dx * k).alias("fx"), (dy * k).alias("fy")), F.struct(F.col("target").alias("id"), (-dx * k).alias("fx"), (-dy * k).alias("fy")))
    return e.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def layout(nodes: DataFrame, links: DataFrame, save, rounds: int = 10, seed: int = 0, charge: float = CHARGE) -> DataFrame:
    """(id, x, y) of nodes(id), distinct, after some rounds that cool down; the same for the same seed. The middle of all nodes is kept at 0."""
    at = save(start(nodes, seed), "start")
    heat = 1.0
    for _ in range(rounds):
        heat *= 0.85
        push, pull = repulsion(at, save, charge), pulls(at, links)
        both = push.unionByName(pull).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        # sums of doubles depend on their order in the last digits: rounded, reruns agree
        moved = at.join(both, "id").select("id", F.round(F.col("x") + F.col("fx") * heat, 6).alias("x"), F.round(F.col("y") + F.col("fy") * heat, 6).alias("y"))
        moved = save(moved, "moved")
        mean = moved.agg(F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("y"), 6).alias("my")).first()
        at = moved.select("id", (F.col("x") - (mean.mx or 0.0)).alias("x"), (F.col("y") - (mean.my or 0.0)).alias("y"))
        at = save(at, "at")
    return at
