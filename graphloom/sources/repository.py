"""A data source `repository`: source files of a folder as rows, with filters pushed to the walk.

    repository.read(spark, "/path", "extension = '.py' and size < 10000")

Filters are pushed only where the option `push` asks for it, as read() does: Spark
4.1 keeps the reader that filters were pushed to with the DataFrame, so another
query on the same one would miss files. The driver lists names and sizes; files are read in tasks of about PART bytes. The
folder must be one that driver and executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from graphloom.sources.adapters import local
from graphloom.sources.scan import IGNORED, MOST_BYTES

#: Bytes of files in a partition.
PART = 32 << 20
SCHEMA = "path string, extension string, size bigint, content binary"


@dataclass
class Files(D.InputPartition):
    """Files of a partition: names relative to the root, and sizes."""

    names: list[tuple[str, int]]


class RepositorySource(D.DataSource):
    """Option `path`: the folder. Empty files, those above MOST_BYTES, links and ignored folders are left out."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


#: Comparisons that the walk understands, of the columns that are known before a file is read.
_TESTS = {
    D.EqualTo: lambda v, x: v == x,
    D.In: lambda v, x: v in x,
    D.GreaterThan: lambda v, x: v > x,
    D.GreaterThanOrEqual: lambda v, x: v >= x,
    D.LessThan: lambda v, x: v < x,
    D.LessThanOrEqual: lambda v, x: v <= x,
    D.StringStartsWith: lambda v, x: v.startswith(x),
    D.StringEndsWith: lambda v, x: v.endswith(x),
    D.StringContains: lambda v, x: x in v,
}


class RepositoryReader(D.DataSourceReader):
    def __init__(self, options):
        root = local({"path": options["path"]})
        if not root.startswith("file://"):
            raise ValueError(f"{root}: only folders that executors can open; use scan.read_files()")
        self.root, self.push = root.removeprefix("file://"), str(options.get("push", "false")).lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if not self.push:
                yield f
            elif type(f) in _TESTS and column in (("path",), ("extension",), ("size",)):
                self.tests.append((column[0], type(f).__name__, f.value))
            elif not (isinstance(f, D.IsNotNull) and column != ("content",)):
                yield f

    def wanted(self, path: str, size: int) -> bool:
        known = {"path": path, "extension": os.path.splitext(path)[1].lower(), "size": size}
        by_name = {t.__name__: f for t, f in _TESTS.items()}
        return all(by_name[kind](known[c], value) for c, kind, value in self.tests)

    def walk(self) -> Iterator[tuple[str, int]]:
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(x for x in folders if x not in IGNORED)
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.islink(full):
                    continue
                path, size = os.path.relpath(full, self.root), os.path.getsize(full)
                if 0 < size <= MOST_BYTES and self.wanted(path, size):
                    yield path, size

    def partitions(self) -> list[Files]:
        out, held, total = [], [], 0
        for path, size in self.walk():
            if held and total + size > PART:
                out.append(Files(held))
                held, total = [], 0
            held.append((path, size))
            total += size
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, size in partition.names:
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "extension": pa.array([os.path.splitext(path)[1].lower()]), "size": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)


def read(spark: SparkSession, root: str, condition: str | None = None) -> DataFrame:
    """(path, extension, size, content) of the files that a condition holds for; what it says of path, extension and size is decided before files are read. Each call has a reader of its own."""
    register(spark)
    files = spark.read.format("repository").option("push", str(condition is not None).lower()).load(root)
    return files.where(condition) if condition else files
