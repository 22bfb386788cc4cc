"""Views of siblings in order: bodies of loops that have no children, best candidates, unused locals, utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of loops, and types that a view of siblings leaves out.
LOOPS = ["for", "for_in", "for_of", "while", "do_while"]
SKIPPED = ["log", "telemetry", "event"]
#: Fixed value: folders of utilities.
UTILITY = r"(?i)/(utils?|helpers?|shared|common|lib)/"


def loop_bodies(nodes: DataFrame) -> DataFrame:
    """(header, id, position) of nodes(id, parent_id, ord, type, kind, resolved_to): what belongs to each loop, in order.

    A loop with children has these. One without has the siblings before it, back to
    the nearest boundary: another loop, a return, a throw, a call that is resolved.
    Runs between boundaries are numbered by one running count a parent.
    """
    n = nodes.where(~F.col("type").isin(SKIPPED))
    loop = (F.col("type") == "flowControl") & F.coalesce(F.col("kind").isin(LOOPS), F.lit(False))
    bound = loop | F.col("type").isin("return", "throw") | ((F.col("type") == "call") & F.col("resolved_to").isNotNull())
    full = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("_full", F.lit(True))
    w = Window.partitionBy("parent_id").orderBy("ord", "id")
    run = F.coalesce(F.sum(bound.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = n.select("id", "parent_id", "ord", loop.alias("loop"), bound.alias("bound"), run.alias("run"))
    heads = rows.where("loop").join(full, "id", "left")
    empty = heads.where("_full is null").select(F.col("id").alias("header"), F.col("parent_id").alias("_p"), F.col("run").alias("_r"))
    before = rows.where("not bound").join(empty, F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("run") == F.col("_r"))).select("header", "id", "ord")
    inside = nodes.join(heads.where("_full").select(F.col("id").alias("header")), F.col("parent_id") == F.col("header")).select("header", "id", "ord")
    place = F.row_number().over(Window.partitionBy("header").orderBy("ord", "id"))
    return before.unionByName(inside).select("header", "id", place.alias("position"))


def best(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate of the highest confidence of each key, the first in `ord` of equal ones: candidates(key, ord, confidence, ...)."""
    rest = [c for c in candidates.columns if c not in (key, "ord", "confidence")]
    first = candidates.groupBy(key).agg(F.max_by(F.struct("ord", "confidence", *rest), F.struct("confidence", -F.col("ord"))).alias("b"))
    return first.select(key, "b.*")


def unused_locals(data: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Of data(id, parent_id, name, scope) the local ones that are children of functions(id) and no source of a `uses` edge."""
    mine = data.where("scope = 'local'").join(functions.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return mine.join(edges.where("kind = 'uses'").select(F.col("source").alias("id")), "id", "left_anti").select("id", "name")


def is_utility(path: Column) -> Column:
    return F.coalesce(path.rlike(UTILITY), F.lit(False))
