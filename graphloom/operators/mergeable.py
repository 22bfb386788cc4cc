"""Coupling and connections of stored topologies as exact bitmaps, which are or-ed where topologies are merged: their edges aren't needed any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import round2


def dense(values: DataFrame, column: str, save, start: int = 0) -> DataFrame:
    """(column, number): distinct values, not null, numbered from `start` in their order. Each range partition counts for itself; one row a partition tells what comes before."""
    v = values.where(F.col(column).isNotNull()).select(column).distinct()
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = save(v.repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    size = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") + start).alias("_before"))
    rows = placed.join(F.broadcast(before), part == F.col("_part"))  # one row a partition
    return save(rows.select(column, (F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")).alias("number")), "numbers")


def more_numbers(known: DataFrame, values: DataFrame, column: str, save) -> DataFrame:
    """known(column, number) with new values numbered after those it has, which keep theirs."""
    last = known.agg(F.max("number")).first()[0]
    new = values.select(column).distinct().join(known.select(column), column, "left_anti")
    return known.unionByName(dense(new, column, save, 0 if last is None else last + 1))


def coupling_maps(edges: DataFrame, functions: DataFrame, numbers: DataFrame, inside_too: bool) -> DataFrame:
    """(grp, out, bucket, classes): bitmaps of the numbers(cls, number) of the outside classes that each group of functions(id, grp, cls) calls (out = 1) or is called by (0). A row holds 32,768 numbers."""
    a = functions.select(F.col("id").alias("source"), F.col("grp").alias("s_grp"), F.col("cls").alias("s_cls"))
    b = functions.select(F.col("id").alias("target"), F.col("grp").alias("t_grp"), F.col("cls").alias("t_cls"))
    pairs = edges.select("source", "target").join(a, "source").join(b, "target").where("s_grp <> t_grp" if not inside_too else "s_cls <> t_cls")
    pairs = pairs.select("s_grp", "s_cls", "t_grp", "t_cls").distinct()
    ends = F.array(F.struct(F.col("s_grp").alias("grp"), F.lit(1).alias("out"), F.col("t_cls").alias("cls")), F.struct(F.col("t_grp").alias("grp"), F.lit(0).alias("out"), F.col("s_cls").alias("cls")))
    seen = pairs.select(F.explode(ends).alias("e")).select("e.grp", "e.out", "e.cls").join(numbers, "cls")
    return maps(seen, ["grp", "out"], "number").withColumnRenamed("map", "classes")


def maps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, bucket, map): the distinct whole numbers of each key."""
    n = F.col(number) + 1  # buckets begin at 1
    return rows.select(*keys, F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("_bit")).groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("map"))


def merged(*stored: DataFrame) -> DataFrame:
    """Bitmaps of several topologies, made with the same numbers, as those of all."""
    all_ = stored[0]
    for s in stored[1:]:
        all_ = all_.unionByName(s)
    bits = next(c for c in ("classes", "map") if c in all_.columns)
    return all_.groupBy(*[c for c in all_.columns if c != bits]).agg(F.bitmap_or_agg(bits).alias(bits))


def coupling(classes: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, ca, ce, instability) of every group of groups(grp), from bitmaps alone; as edges.coupling()."""
    n = classes.groupBy("grp").agg(F.sum(F.when(F.col("out") == 1, F.bitmap_count("classes"))).alias("ce"), F.sum(F.when(F.col("out") == 0, F.bitmap_count("classes"))).alias("ca"))
    every = groups.select("grp").distinct().join(n, "grp", "left")
    zero = F.lit(0).cast("long")
    out = every.select(F.col("grp").alias(group), F.coalesce("ca", zero).alias("ca"), F.coalesce("ce", zero).alias("ce"))
    return out.withColumn("instability", F.when(F.col("ca") + F.col("ce") == 0, F.lit(0.0)).otherwise(round2(F.col("ce") / (F.col("ca") + F.col("ce")))))


def connections(dependencies: DataFrame, numbers: DataFrame) -> DataFrame:
    """(target, bucket, map): bitmaps of the numbered services, numbers(service, number), of dependencies(service, target)."""
    return maps(dependencies.select("service", "target").join(numbers, "service"), ["target"], "number")


def connection_counts(stored: DataFrame) -> DataFrame:
    """(target, connection_count): how many services depend on each target."""
    return stored.groupBy("target").agg(F.sum(F.bitmap_count("map")).alias("connection_count"))
