"""Catalogue queries on tables that are kept: incremental graphs, stores, pages, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import increment, mergeable
from graphloom.plans import stand_in as S
from graphloom.plans.catalogue import ORACLES, functions, query
from graphloom.saved import Saved
from graphloom.sinks import layout
from graphloom.sinks.store import Pages, Store
from graphloom.streaming import sessions

INCREMENT_SQL = """
WITH calls AS (SELECT 'c' || o_custkey AS source, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
functions AS (SELECT s_suppkey, CASE WHEN s_acctbal > 9000 THEN 'big' ELSE 'n' END || s_nationkey AS target FROM supplier)
SELECT source, target, count(*) AS n FROM calls JOIN functions ON l_suppkey = s_suppkey GROUP BY 1, 2
"""


def _listings(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two listings of files: orders call suppliers by their lines, suppliers define what nations have. In the second, some orders are gone, some have more lines, some suppliers are new and some define something else."""
    line = S._read(spark, d, "lineitem").join(S._read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
    call = F.struct(S.tag("c", "o_custkey").alias("source"), F.col("l_suppkey").cast("string").alias("callee"))
    no_call, no_function = F.lit(None).cast("array<struct<source:string,callee:string>>"), F.lit(None).cast("array<struct<callee:string,target:string>>")
    order = lambda x: x.groupBy(S.tag("o", "l_orderkey").alias("path")).agg(F.array_sort(F.collect_list(call)).alias("calls")).withColumn("functions", no_function)
    s = S._read(spark, d, "supplier")
    supplier = lambda x, target: x.select(S.tag("s", "s_suppkey").alias("path"), no_call.alias("calls"), F.array(F.struct(F.col("s_suppkey").cast("string").alias("callee"), target.alias("target"))).alias("functions"))
    nation = F.col("s_nationkey").cast("string")
    first = order(line.where("l_linestatus = 'F'")).unionByName(supplier(s.where("s_acctbal > 0"), F.concat(F.lit("n"), nation)))
    second = order(line.where("o_orderstatus <> 'P'")).unionByName(supplier(s, F.concat(F.when(F.col("s_acctbal") > 9000, "big").otherwise("n"), nation)))
    return [x.withColumn("hash", increment.hash_object("calls", "functions")) for x in (first, second)]


def _extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.select("path", F.explode("calls").alias("x")).select("path", "x.*"), files.select("path", F.explode("functions").alias("x")).select("path", "x.*")


@query(INCREMENT_SQL)
def incremental_edges(spark, d):
    """UD-3: edges with their support after two listings of files, of which the second reads changed ones only."""
    save, g = Saved(spark).save, increment.CallGraph.empty(spark)
    for files in _listings(spark, d):
        g = g.step(save(files, "files"), _extract, save)
    return g.edges


@query(f"SELECT target, count(*) AS n FROM ({INCREMENT_SQL}) GROUP BY 1")
def incremental_degrees(spark, d):
    """UD-3: degrees after the same changes, kept up to date from edges that begin or end."""
    save, g = Saved(spark).save, increment.CallGraph.empty(spark)
    for files in _listings(spark, d):
        g = g.step(save(files, "files"), _extract, save)
    return g.degrees


STORE_SQL = """
WITH last AS (SELECT o_custkey AS id, o_orderstatus = 'F' AS old, arg_max(o_orderkey, o_orderkey) AS ord, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2),
kept AS (SELECT id, ord, priority FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY old) AS n FROM last) WHERE n = 1),
more AS (SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS ord, c_mktsegment AS priority FROM customer WHERE c_custkey NOT IN (SELECT id FROM kept))
SELECT * FROM (SELECT * FROM kept UNION ALL SELECT * FROM more) WHERE priority <> '1-URGENT'
"""


@query(STORE_SQL)
def stored_changes(spark, d):
    """ST-4, ST-5, ST-6, SNK-7: two batches upserted, absent keys inserted, some rows deleted, in buckets."""
    folder = Saved(spark)
    store = Store(spark, f"{folder.root}/store", T.StructType.fromDDL("id bigint, ord bigint, priority string"), ("id",), 16)
    o = S._read(spark, d, "orders")
    last = lambda x: x.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("ord"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    store.upsert(last(o.where("o_orderstatus = 'F'")))
    store.upsert(last(o.where("o_orderstatus <> 'F'")))
    store.insert_absent(S._read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("ord"), F.col("c_mktsegment").alias("priority")))
    store.delete(F.col("priority") == "1-URGENT")
    return store.table()


@query("SELECT o_orderkey AS id, o_totalprice AS price, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 700")
def deep_page(spark, d):
    """TK-1: a page far from the first, from the partitions that hold it."""
    pages = Pages(spark, f"{Saved(spark).root}/pages")
    pages.write(S._read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), ["price", "id"])
    rows, total = pages.page(20, 700)
    return rows.withColumn("total", F.lit(total).cast("long"))


SESSION_SQL = """
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
k AS (SELECT *, 'u' || user_id || '.' || count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_id FROM e),
opened AS (SELECT session_id, t, (CAST(floor((t + 1800) / 600) AS BIGINT) + 1) * 600 AS ends FROM k WHERE event_type = 'signup'),
decides AS (SELECT k.session_id, k.t, ends, row_number() OVER (PARTITION BY k.session_id ORDER BY k.t, event_id) AS n FROM k LEFT JOIN opened o ON k.session_id = o.session_id WHERE event_type = 'purchase')
SELECT session_id, t AS at, 'opened' AS outcome FROM opened
UNION ALL SELECT session_id, t, CASE WHEN n = 1 AND t < ends THEN 'decided' ELSE 'unknown' END FROM decides
UNION ALL SELECT session_id, ends, 'expired' FROM opened o WHERE NOT EXISTS (SELECT 1 FROM decides x WHERE x.session_id = o.session_id AND x.n = 1 AND x.t < o.ends)
"""


@query(SESSION_SQL)
def session_outcomes(spark, d):
    """RS-4: a stream of signups, which open sessions, and purchases, which decide them."""
    e = S._read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    opens = (F.col("event_type") == "signup").cast("int")
    n = F.sum(opens).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = e.withColumn("session_id", F.concat(S.tag("u", "user_id"), F.lit("."), n.cast("string"))).where("event_type in ('signup', 'purchase')")
    rows = rows.select("session_id", F.date_trunc("second", "at").alias("at"), F.when(F.col("event_type") == "signup", "open").otherwise("decide").alias("kind"))
    # the last event moves the watermark past every sweep that is due
    end = rows.agg(F.max("at").alias("at")).where("at is not null").select(F.lit("end").alias("session_id"), (F.col("at") + F.expr("interval 2 hours")).alias("at"), F.lit("decide").alias("kind"))
    folder = Saved(spark)
    folder.save(rows.unionByName(end), "events")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = sessions.outcomes(spark.readStream.schema(rows.schema).parquet(f"{folder.root}/1-events"))
        out = stream.writeStream.format("parquet").option("path", f"{folder.root}/outcomes").option("checkpointLocation", f"{folder.root}/progress")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = spark.read.schema(sessions.OUTCOMES).parquet(f"{folder.root}/outcomes")
    return got.where("session_id <> 'end'").select("session_id", F.unix_seconds("at").alias("at"), "outcome")




@query(ORACLES["service_coupling"])
def merged_coupling(spark, d):
    """AG-7, ST-7: coupling of three stored topologies, lines by return flag, from their bitmaps alone."""
    folder = Saved(spark)
    f = functions(spark, d).withColumnRenamed("nation", "grp")
    numbers = mergeable.dense(f, "cls", folder.save)
    line = S._read(spark, d, "lineitem").join(S._read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    stored = []
    for flag in ("A", "N", "R"):
        calls = line.where(F.col("l_returnflag") == flag).select(F.col("o_custkey").alias("source"), (-F.col("l_suppkey") - 1).alias("target"))
        stored.append(folder.save(mergeable.coupling_maps(calls, f, numbers, False), flag))
    return mergeable.coupling(mergeable.merged(*stored), f, "service")


@query("SELECT l_suppkey AS target, count(DISTINCT o_custkey) AS connection_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def merged_connections(spark, d):
    """AG-13, ST-7: how many customers each supplier is connected with, from stored halves."""
    folder = Saved(spark)
    line = S._read(spark, d, "lineitem").join(S._read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("service")), "l_orderkey")
    numbers = mergeable.dense(line, "service", folder.save)
    halves = [folder.save(mergeable.connections(line.where(c).withColumnRenamed("l_suppkey", "target"), numbers), "half") for c in ("l_linestatus = 'F'", "l_linestatus <> 'F'")]
    return mergeable.connection_counts(mergeable.merged(*halves))


@query()
def force_layout(spark, d):
    """GR-10: parts placed by force, linked where an order has them next to each other and both lines are returned; no SQL can say it, tests hold forces against all pairs."""
    line = S._read(spark, d, "lineitem").where("l_returnflag = 'R'")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    links = line.select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target")).where("target is not null")
    save = Saved(spark).save
    return layout.layout(S._read(spark, d, "part").select(F.col("p_partkey").alias("id")), save(links, "links"), save, rounds=3)
