"""Derived tables kept up to date from changes alone: content hashes, signed rows, delta joins with support counts.

A counted table has a column `n`, how many times a row is derived; a delta has signed
counts. The delta of a join is da with old b, old a with db, and da with db, so only
rows that meet a changed one are joined. A derived row exists while its count is above 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_object(*columns: str) -> Column:
    """SHA-1 of some columns as JSON with sorted names: equal values have equal hashes, whatever order the columns come in. Nulls are left out, as in JSON."""
    return F.sha1(F.to_json(F.struct(*sorted(columns))))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of what differs between old(key, hash) and new(key, hash): added, changed or removed."""
    both = old.select(key, F.col("hash").alias("_was")).join(new.select(key, F.col("hash").alias("_is")), key, "full")
    what = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_was") != F.col("_is"), "changed")
    return both.select(key, what.alias("change")).where("change is not null")


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta that turns rows old into rows new, of the same columns: rows in both cancel out."""
    cols = new.columns
    both = old.select(*cols, F.lit(-1).alias("n")).unionByName(new.select(*cols, F.lit(1).alias("n")))
    return both.groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0")


def join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The delta of a join b, counts multiplied, from old tables and their deltas."""
    def product(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.withColumnRenamed("n", "_n").join(y.withColumnRenamed("n", "_m"), on).withColumn("n", F.col("_n") * F.col("_m")).drop("_n", "_m")

    return product(da, b).unionByName(product(a, db)).unionByName(product(da, db))


def merge(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """stored with a delta of the same columns added up; rows of no support go. A count below 0 is an error: the delta is of another table."""
    keys = [c for c in stored.columns if c != "n"]
    all_ = stored.unionByName(delta.select(*stored.columns)).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    return all_.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("a delta takes away what isn't there")).cast("long")).otherwise(F.col("n")))


def flips(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of delta whose support begins (n = 1) or ends (n = -1)."""
    keys = [c for c in delta.columns if c != "n"]
    had = delta.withColumnRenamed("n", "_d").join(stored.select(*keys, F.col("n").alias("_n")), keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    before, after = (F.col("_n") > 0).cast("long"), (F.col("_n") + F.col("_d") > 0).cast("long")
    return had.select(*keys, (after - before).alias("n")).where("n <> 0")


@dataclass(frozen=True)
class CallGraph:
    """What is kept of a repository: hashes(path, hash), calls(path, source, callee, n), functions(path, callee, target, n), edges(source, target, n), degrees(target, n), where a degree counts distinct edges."""

    hashes: DataFrame
    calls: DataFrame
    functions: DataFrame
    edges: DataFrame
    degrees: DataFrame

    @classmethod
    def empty(cls, spark, id_type: str = "string") -> CallGraph:
        t = lambda s: spark.createDataFrame([], s)
        return cls(t("path string, hash string"), t(f"path string, source {id_type}, callee string, n long"), t(f"path string, callee string, target {id_type}, n long"), t(f"source {id_type}, target {id_type}, n long"), t(f"target {id_type}, n long"))

    def step(self, files: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], save) -> CallGraph:
        """The graph of a new listing of files(path, hash, ...), of which only those added or changed are read.

        extract(files) gives their calls(path, source, callee) and functions(path,
        callee, target); what removed and changed files gave before is taken away. A call
        is an edge to every function of its name. save(df, name) writes a table and
        returns it read back.
        """
        now = save(files.select("path", "hash"), "hashes")
        change = save(changes(self.hashes, now, "path"), "changes")
        fresh = files.join(change.where("change <> 'removed'").select("path"), "path", "left_semi")
        gone = change.where("change <> 'added'").select("path")
        calls, functions = extract(fresh)
        old = lambda t: t.join(gone, "path", "left_semi").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_k", "n")
        d_calls = save(signed(old(self.calls), calls.select("path", "source", "callee")), "d_calls")
        d_functions = save(signed(old(self.functions), functions.select("path", "callee", "target")), "d_functions")
        # which file a call or function is in doesn't matter to an edge
        by_name = lambda t, c: t.groupBy("callee", c).agg(F.sum("n").alias("n")).where("n <> 0")
        delta = join_delta(by_name(self.calls, "source"), by_name(d_calls, "source"), by_name(self.functions, "target"), by_name(d_functions, "target"), ["callee"])
        delta = save(delta.groupBy("source", "target").agg(F.sum("n").alias("n")).where("n <> 0"), "d_edges")
        begun = flips(self.edges, delta).groupBy("target").agg(F.sum("n").alias("n")).where("n <> 0")
        return replace(self, hashes=now, calls=save(merge(self.calls, d_calls), "calls"), functions=save(merge(self.functions, d_functions), "functions"), edges=save(merge(self.edges, delta), "edges"), degrees=save(merge(self.degrees, begun), "degrees"))


def stale(described: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Those of items(id, ...) that described(id, hash, ...) doesn't have with the same hash of `columns`: only these are described again."""
    hashed = items.withColumn("hash", hash_object(*columns))
    return hashed.join(described.select("id", "hash"), ["id", "hash"], "left_anti")
