"""Stored tables in hash buckets: a change rewrites the buckets of its keys and leaves all other files as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Store:
    """A table at `path` with distinct `keys`, in `buckets` folders by a hash of them.

    Writers of different buckets don't touch each other's files; batches with
    different keys may come in any order. A bucket is replaced as a whole when its
    rows are written: one that is left without rows keeps a mark, so that it is
    replaced too. Two writers of one bucket at a time must be kept apart by the caller.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in self.schema]
        s = T.StructType([*fields, T.StructField("_live", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], s)
        return self.spark.read.schema(s).parquet(self.path)

    def table(self) -> DataFrame:
        """All rows."""
        return self._stored().where("_live").drop("_live", "_bucket")

    def get(self, *key) -> DataFrame:
        """The row of a key, from its bucket alone."""
        one = self.spark.createDataFrame([key], T.StructType([self.schema[k] for k in self.keys])).select(self.bucket()).first()[0]
        same = [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, key)]
        hit = self._stored().where((F.col("_bucket") == one) & F.col("_live"))
        for s in same:
            hit = hit.where(s)
        return hit.drop("_live", "_bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _same(self, a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        k = b.select(*[F.col(c).alias(f"_{c}") for c in self.keys])
        cond = F.lit(True)
        for c in self.keys:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return a.join(k, cond, how)

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        marks = self.spark.createDataFrame([(b,) for b in touched], "_bucket int")
        for f in self.schema:
            marks = marks.withColumn(f.name, F.lit(None).cast(f.dataType))
        both = rows.select(*self.schema.names).withColumn("_live", F.lit(True)).withColumn("_bucket", self.bucket()).unionByName(marks.withColumn("_live", F.lit(False)))
        w = both.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        w.partitionBy("_bucket").parquet(self.path)

    def upsert(self, new: DataFrame) -> list[int]:
        """Put rows of distinct keys in place of those that have their keys; the buckets rewritten."""
        touched = self._touched(new)
        if touched:
            old = self._stored().where(F.col("_bucket").isin(touched) & F.col("_live"))
            self._write(self._same(old, new, "left_anti").select(*self.schema.names).unionByName(new.select(*self.schema.names)), touched)
        return touched

    def insert_absent(self, new: DataFrame) -> list[int]:
        """Add rows whose keys aren't there, one of each key; buckets that get none stay."""
        buckets = self._touched(new)
        if not buckets:
            return []
        old = self._stored().where(F.col("_bucket").isin(buckets) & F.col("_live"))
        fresh = self._same(new.select(*self.schema.names).dropDuplicates(list(self.keys)), old, "left_anti")
        touched = self._touched(fresh)
        if touched:
            self._write(old.where(F.col("_bucket").isin(touched)).select(*self.schema.names).unionByName(fresh), touched)
        return touched

    def delete(self, where: Column) -> list[int]:
        """Drop rows; only buckets that have some are rewritten. A null condition keeps a row."""
        live = self._stored().where("_live")
        touched = sorted(r[0] for r in live.where(where).select("_bucket").distinct().collect())
        if touched:
            self._write(live.where(F.col("_bucket").isin(touched)).where(~F.coalesce(where, F.lit(False))).select(*self.schema.names), touched)
        return touched


@dataclass(frozen=True)
class Ecosystem:
    """Services by id, databases by id and name, and edges, each in its store."""

    services: Store
    databases: Store
    edges: Store

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> Ecosystem:
        t = lambda name, ddl, *keys: Store(spark, f"{path}/{name}", T.StructType.fromDDL(ddl), keys, buckets)
        return cls(t("services", "id string, name string, endpoint_count bigint", "id"), t("databases", "key string, id string, name string, engine string, file string", "key"), t("edges", "source string, target string, kind string", "source", "target", "kind"))

    def put(self, services: DataFrame, databases: DataFrame, edges: DataFrame) -> None:
        """Latest services(id, name, endpoint_count) and databases(id, name, engine, file) win; edges(source, target, kind) that are there stay."""
        self.services.upsert(services)
        self.databases.upsert(databases.withColumn("key", F.concat_ws(":", "id", "name")))
        self.edges.insert_absent(edges)

    def remove(self, id_: str) -> None:
        """Drop a service, databases whose file contains its id, and edges that touch it."""
        self.services.delete(F.col("id") == id_)
        self.databases.delete(F.col("file").contains(id_))
        self.edges.delete((F.col("source") == id_) | (F.col("target") == id_))


@dataclass(frozen=True)
class Pages:
    """Rows in one order, cut into range partitions whose sizes are known, so that any page reads the one or two that hold it."""

    spark: SparkSession
    path: str

    def write(self, rows: DataFrame, order: list[str], parts: int | None = None) -> None:
        """Sort rows by `order`, nulls first; a total order makes pages repeatable."""
        parts = parts or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        by = [F.col(c).asc_nulls_first() for c in order]
        placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
        placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_place", F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)).drop("_at")
        placed.write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/rows")
        self.spark.read.parquet(f"{self.path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")

    def page(self, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
        """(the rows of a page, in order; how many there are in all). The driver reads one count a partition."""
        counts = sorted((r["_part"], r.n) for r in self.spark.read.parquet(f"{self.path}/counts").collect())
        total, before, ranges = sum(n for _, n in counts), 0, []
        for part, n in counts:
            low, high = max(0, offset - before), min(n, offset + limit - before)
            if low < high:
                ranges.append((part, low, high))
            before += n
        rows = self.spark.read.parquet(f"{self.path}/rows")
        cond = F.lit(False)
        for part, low, high in ranges:
            cond = cond | ((F.col("_part") == part) & F.col("_place").between(low, high - 1))
        hit = rows.where(F.col("_part").isin([p for p, _, _ in ranges]) & cond)
        return hit.orderBy("_part", "_place").drop("_part", "_place"), total
