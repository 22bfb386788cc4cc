"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a fresh local folder only where it is unset and all tasks run in the driver's process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """Intermediate Parquet tables of one run of an operator.

    A written table survives lost executors: tasks that read it again need no
    lineage. drop() removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write df and return the table, read back with the same schema."""
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets(spark: SparkSession) -> int:
    """How many buckets work is dealt into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_keyed(ws: Workspace, rows: DataFrame, facts: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """rows, left-joined with facts(key, n, ...) of which each key has one; nulls are a key; n is how many rows have it.

    Keys with more than one row in `share` are fewer than `share`: their facts are
    sent to all tasks. The others' rows and facts meet by a shuffle in which no key
    has more than that part of all rows.
    """
    facts = ws.write(facts.withColumnRenamed(key, "_key"), "facts")
    hot = F.col("n") > total / share
    same = F.col(key).eqNullSafe(F.col("_key"))
    often = facts.where(hot).drop("n").withColumn("_often", F.lit(True))
    rest = facts.where(~hot).drop("n")
    found = rows.join(F.broadcast(often), same, "left")
    plain = found.where("_often is null").select(*rows.columns).join(rest, same, "left").drop("_key")
    return found.where("_often").drop("_key", "_often").unionByName(plain)


def ranked(ws: Workspace, df: DataFrame, order: list[str], group: str | None = None, name: str = "ranked", weight: str | None = None, modulus: int = 0) -> tuple[DataFrame, DataFrame]:
    """Dense 0-based ranks of all rows in a global order, without one task seeing them all.

    Rows are range-partitioned by (group, order...), so that a hot group spans
    many partitions. A row's rank is its place in its partition plus the number
    of rows before that partition, from one small count per partition. Adds
    `rank`, within `group` if one is given (nulls are a group), and with `weight`,
    a whole number, `before`: the sum of the weights of the group's earlier rows,
    modulo `modulus`. Returns (rows, counts: per group its `group_rows`). Equal
    rows get different ranks; which of two equal rows comes first doesn't matter
    to any column of df.
    """
    spark = ws.spark
    keys = ([group] if group else []) + order
    sorted_rows = df.repartitionByRange(buckets(spark), *[F.col(c).asc_nulls_last() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in keys])
    # the upper 31 bits are the partition, the lower 33 the place in it
    placed = ws.write(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33).alias("_part")
    g = F.col(group).alias("_group") if group else F.lit("").alias("_group")
    load = F.col(weight) if weight else F.lit(0)
    runs = placed.select(part, g, "_place", load.alias("_load")).groupBy("_part", "_group").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"), (F.sum("_load") % modulus if weight else F.lit(0)).alias("_load"))
    # one row per partition and group present in it: no more than partitions, for any one group
    runs = ws.write(runs, name + "_runs")
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_loads", F.coalesce(F.sum("_load").over(earlier), F.lit(0)))
    before = before.select(F.col("_part").alias("_part2"), F.col("_group").alias("_group2"), "_first", "_before", "_loads")
    counts = runs.groupBy("_group").agg(F.sum("_n").alias("group_rows"))
    me = placed.withColumn("_part", F.shiftright("_place", 33))
    if weight:  # a partition's rows of one group, as many as a range partition has at most
        here = Window.partitionBy("_part", *([group] if group else [])).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        me = me.withColumn("_sum", F.coalesce(F.sum(weight).over(here), F.lit(0)))
    key = F.col(group).eqNullSafe(F.col("_group2")) if group else F.lit(True)
    out = me.join(before, (F.col("_part") == F.col("_part2")) & key, "left").withColumn("rank", F.col("_place") - F.col("_first") + F.col("_before"))
    if weight:
        out = out.withColumn("before", (F.col("_sum") + F.col("_loads")) % modulus).drop("_sum")
    return out.drop("_place", "_part", "_part2", "_group2", "_first", "_before", "_loads"), counts
