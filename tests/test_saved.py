"""What saved tables leave on disk."""

import os

from graphloom.operators import scc
from graphloom.saved import Saved, drop


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_drop(spark):
    folder = Saved(spark)
    a, b = folder.save(spark.range(5), "a"), folder.save(spark.range(7), "b")
    drop(folder.save, a)
    drop(lambda df, name: df, b)  # not of a Saved: kept
    assert [x.split("-")[1] for x in os.listdir(folder.root.removeprefix("file://"))] == ["b"] and b.count() == 7


def test_rounds_of_components_leave_only_results(spark):
    folder = Saved(spark)
    edges = spark.createDataFrame([(k, (k + 1) % 60) for k in range(60)] + [(k, k + 1) for k in range(100, 140)], "source long, target long")
    got = scc.strong(spark.range(200), edges, folder.save)
    left = {x.split("-")[1].split("_")[0] for x in os.listdir(folder.root.removeprefix("file://"))}
    assert left <= {"alone", "found"}
    assert got.where("part = 0").count() == 60 and got.count() == 200


def test_a_write_leaves_no_shuffle_files(spark):
    import time

    folder, local = Saved(spark), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x.rpartition("/")[2] for x in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = names()
    folder.save(spark.range(10_000).selectExpr("id % 100 as k").groupBy("k").count(), "counted")
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.1)
    assert not names() - before
