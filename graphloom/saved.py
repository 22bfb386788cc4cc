"""Tables of one run of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark removes the shuffle files of a write when it is done, not whenever the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Saved:
    """Tables of one run, in the shared folder."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = root or "file://" + tempfile.mkdtemp(prefix="graphloom-")
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/graphloom/{uuid.uuid4().hex}", 0
        self.paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it read back. A name may come again; each has its own folder."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [path for df, path in self.paths if any(df is t for t in tables)]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = [x for x in self.paths if not any(x[0] is t for t in tables)]


def drop(save, *tables: DataFrame) -> None:
    """Delete tables that save() gave, if it is that of a Saved; other ways of saving keep theirs."""
    owner = getattr(save, "__self__", None)
    if isinstance(owner, Saved):
        owner.drop(*tables)
