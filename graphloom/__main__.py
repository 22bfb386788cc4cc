"""python -m graphloom analyze <repository> [--output FOLDER] [...] | enrich <topology> [--dry-run] | inspect <topology>"""

from __future__ import annotations

import argparse
import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import enrich, increment
from graphloom.plans import analysis
from graphloom.saved import Saved
from graphloom.sinks import topology

DESCRIBED = "id string, hash string, description string"


def describe(spark: SparkSession, path: str, save, dry_run: bool = False) -> tuple[int, int]:
    """(how many functions and endpoints of a topology have no description of what they are now, how many there are); unless dry_run, they get one, in a table next to the topology. What hasn't changed isn't described again."""
    _, nodes = topology.read_topology(spark, path, save)
    items = nodes.where("type in ('endpoint', 'function')").select("id", "type", "name", "kind", F.to_json("metadata").alias("facts"))
    items = items.withColumn("text", F.concat_ws(" ", F.concat(F.initcap("type"), F.lit(" ")), "name", "kind"))
    columns = ["type", "name", "kind", "facts"]
    # a topology without descriptions has no such table
    had = topology.read_or_empty(spark, f"{path}.descriptions", DESCRIBED)
    new = save(increment.stale(had, items, columns), "stale")
    if not dry_run and not new.isEmpty():
        fresh = new.select("id", "hash").join(enrich.describe(new.select("id", "text")), "id")
        kept = had.join(items.withColumn("hash", increment.hash_object(*columns)).select("id", "hash"), ["id", "hash"], "left_semi")
        save(fresh.unionByName(kept.select(*fresh.columns)), "described").write.mode("overwrite").json(f"{path}.descriptions")
    return new.count(), items.count()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyze", help="read a repository and write its topology")
    a.add_argument("repository")
    a.add_argument("-o", "--output")
    a.add_argument("--raw", "--include-raw", action="store_true", help="keep source text")
    a.add_argument("--include-tests", action="store_true", help="read test files too")
    a.add_argument("--no-frontend", action="store_true", help="leave out files of user interfaces")
    a.add_argument("--no-pretty", action="store_true", help="documents are always one line each; for scripts that ask for it")
    a.add_argument("--enrich", action="store_true", help="describe functions and endpoints")
    a.add_argument("--verbose", action="store_true", help="count what was found by service and type")
    e = sub.add_parser("enrich", help="describe functions and endpoints of a topology that have changed")
    e.add_argument("topology")
    e.add_argument("--no-pretty", action="store_true")
    e.add_argument("--dry-run", action="store_true", help="only count what would be described")
    i = sub.add_parser("inspect", help="count what a topology holds")
    i.add_argument("topology")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    save = Saved(spark).save
    if args.what == "analyze":
        if not os.path.isdir(args.repository):
            p.error(f"{args.repository} isn't a folder")
        root = os.path.abspath(args.repository)
        t = analysis.topology(spark, f"file://{root}", save, not args.include_tests, not args.no_frontend)
        path = topology.write_topology(t["services"], t["tree"], args.output or f"{root}/topology.json", save, roots=(root, os.getcwd()), raw=args.raw)
        print(path)
        print(topology.summary_text(topology.summary({k: t[k] for k in ("services", "endpoints", "functions", "edges", "diagnostics")})))
        if args.verbose:
            for r in t["tree"].groupBy("service_id", "type").count().orderBy("service_id", "type").collect():
                print(f"{r.service_id} {r.type}: {r['count']}")
        if args.enrich:
            print("described: {} of {}".format(*describe(spark, path, save)))
    elif args.what == "enrich":
        n, total = describe(spark, args.topology, save, args.dry_run)
        print(f"{'to describe' if args.dry_run else 'described'}: {n} of {total}")
    else:
        services, nodes = topology.read_topology(spark, args.topology, save)
        print(topology.summary_text(topology.summary({"services": services, "endpoints": nodes.where("type = 'endpoint'"), "functions": nodes.where("type = 'function'"), "nodes": nodes})))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
