"""Edges of a property graph: building, deduplication, degrees, coupling, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import round2


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One edge for each (source, target, kind): the one of the least `order`. An aggregate of structs, so that tasks reduce before the shuffle."""
    rest = [c for c in edges.columns if c not in ("source", "target", "kind", order)]
    if not rest:  # numbers alone stay in hash aggregates
        return edges.groupBy("source", "target", "kind").agg(F.min(order).alias(order))
    first = edges.groupBy("source", "target", "kind").agg(F.min(F.struct(order, *rest)).alias("_f"))
    return first.select("source", "target", "kind", *[F.col(f"_f.{c}").alias(c) for c in [order, *rest]])


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, max_degree) of every node, zeros filled in."""
    count = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.select("id").join(count, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    most = count.join(nodes.select("id"), "id", "left_semi").agg(F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree"))  # counted edges, a small table
    return out.crossJoin(F.broadcast(most))  # one row


def coupling(edges: DataFrame, functions: DataFrame, group: str, inside_too: bool) -> DataFrame:
    """(group, ca, ce, instability) for calls between functions(id, grp, cls).

    ca: distinct outside classes that call in; ce: distinct outside classes that are called; instability: ce / (ca + ce), two
    digits, 0 without either. inside_too: classes of the same group count, if they aren't the group itself.
    """
    a = functions.select(F.col("id").alias("source"), F.col("grp").alias("s_grp"), F.col("cls").alias("s_cls"))
    b = functions.select(F.col("id").alias("target"), F.col("grp").alias("t_grp"), F.col("cls").alias("t_cls"))
    pairs = edges.select("source", "target").join(a, "source").join(b, "target").where("s_grp <> t_grp" if not inside_too else "s_cls <> t_cls")
    # many calls are between the same two classes: these are told apart once, then each pair counts at both of its ends
    pairs = pairs.select("s_grp", "s_cls", "t_grp", "t_cls").distinct()
    ends = F.array(F.struct(F.col("s_grp").alias("g"), F.lit(1).alias("out"), F.col("t_cls").alias("cls")), F.struct(F.col("t_grp").alias("g"), F.lit(0).alias("out"), F.col("s_cls").alias("cls")))
    seen = pairs.select(F.explode(ends).alias("e")).select("e.g", "e.out", "e.cls").distinct()
    counts = seen.groupBy(F.col("g").alias(group)).agg(F.sum("out").alias("ce"), (F.count(F.lit(1)) - F.sum("out")).alias("ca"))
    every = functions.select(F.col("grp").alias(group)).distinct().join(counts, group, "left")
    ca, ce = F.coalesce("ca", F.lit(0)).cast("long"), F.coalesce("ce", F.lit(0)).cast("long")
    return every.select(group, ca.alias("ca"), ce.alias("ce")).withColumn("instability", F.when(F.col("ca") + F.col("ce") == 0, F.lit(0.0)).otherwise(round2(F.col("ce") / (F.col("ca") + F.col("ce")))))


def unused(functions: DataFrame, edges: DataFrame, entry_point: Column, utility: Column) -> DataFrame:
    """(id, level) of functions that no edge targets and that aren't entry points; info for utilities, else warning."""
    called = edges.select(F.col("target").alias("id"))
    return functions.where(~entry_point).join(called, "id", "left_anti").select("id", F.when(utility, F.lit("info")).otherwise(F.lit("warning")).alias("level"))


def dangling(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose `end` is no node."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
