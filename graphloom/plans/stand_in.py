"""A whole topology made of the given tables, and the same in SQL, so that operators on graph tables run at every size.

Nations are services, customers endpoints, suppliers functions, order lines code
nodes (the first line of an order is flow control, others hang below it or below
the endpoint, by their status) and calls, regions databases, brands topics. Values
are missing or odd where some attribute says so, as in real repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.saved import Saved


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tag(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def services(spark, d):
    n = _read(spark, d, "nation")
    kind = F.when(F.col("n_regionkey") == 0, "frontend").when(F.col("n_regionkey") == 1, "worker").otherwise("backend")
    return n.select(tag("service:", "n_nationkey").alias("id"), F.when(F.col("n_nationkey") != 7, F.col("n_name")).alias("name"), F.when(F.col("n_nationkey") < 20, F.lower("n_name")).alias("code"), kind.alias("kind"))


def endpoints(spark, d):
    c = _read(spark, d, "customer")
    names = {"AUTOMOBILE": "GET", "BUILDING": "POST", "FURNITURE": "FETCH", "MACHINERY": "DELETE"}
    method = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("c_mktsegment"))
    path = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("/customers/"), F.col("c_custkey").cast("string")))
    return c.select(tag("endpoint:", "c_custkey").alias("id"), tag("service:", "c_nationkey").alias("service_id"), F.col("c_name").alias("name"), method.alias("method"), path.alias("path"), F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit(".ts")).alias("file"), F.col("c_custkey").alias("ord"))


def functions(spark, d):
    s = _read(spark, d, "supplier")
    kind = F.when(F.col("s_acctbal") < 0, "lambda").when(F.col("s_acctbal") > 9000, "constructor").otherwise("method")
    return s.select(tag("function:", "s_suppkey").alias("id"), tag("service:", "s_nationkey").alias("service_id"), F.col("s_name").alias("name"), kind.alias("kind"), F.concat(F.lit("Class"), (F.floor(F.col("s_acctbal") / 500)).cast("string")).alias("class_name"), F.col("s_suppkey").alias("ord"))


def nodes(spark, d):
    """One node for each order and line number."""
    line = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_suppkey", "l_quantity")])
    first = line.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"))
    x = line.join(first, "l_orderkey").join(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.col("l_linenumber") == F.col("first")
    node = lambda n: F.concat(F.lit("node:"), F.col("l_orderkey").cast("string"), F.lit("."), F.col(n).cast("string"))
    names = F.array(*[F.lit(t) for t in ("call", "dbProcess", "externalCall", "event", "log", "return", "throw")])
    type_ = F.when(head, "flowControl").otherwise(F.get(names, F.col("l_linenumber") - 1))
    kind = F.when(head, F.when(F.col("l_returnflag") == "R", "try").when(F.col("l_returnflag") == "A", "if")).otherwise(F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06), "catch"))
    type_ = F.when(kind == "catch", "flowControl").otherwise(type_)
    parent = F.when(head | (F.col("l_linestatus") == "F"), tag("endpoint:", "o_custkey")).otherwise(node("first"))
    return x.select(
        node("l_linenumber").alias("id"), parent.alias("parent_id"), type_.alias("type"), kind.alias("kind"),
        F.when(F.col("l_suppkey") % 5 > 0, tag("database:", "l_suppkey")).alias("database_id"), F.when(F.col("l_tax") > 0, "findMany").alias("operation"),
        F.when(F.col("l_discount") > 0, "GET").alias("method"), F.when(F.col("l_tax") < 0.07, "/x").alias("path"), F.when(F.col("l_discount") < 0.1, "made").alias("event_name"),
        F.when(F.col("l_tax") > 0.07, "loud").otherwise("info").alias("level"), F.when(F.col("l_discount") < 0.05, 0).alias("branches"),
        F.when(F.col("l_quantity") > 25, 400).otherwise(500).alias("status"), F.col("l_linenumber").cast("long").alias("ord"), tag("f", "l_orderkey").alias("file"),
    )


def edges(spark, d):
    line = _read(spark, d, "lineitem").join(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "reads_from").when(F.col("l_tax") > 0, "publishes_to")
    target = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), tag("external:", "l_partkey")).when(F.col("l_quantity") < 2, tag("endpoint:", "o_custkey")).otherwise(tag("function:", "l_suppkey"))
    # endpoints of customers deep in debt call nothing
    busy = _read(spark, d, "customer").where("c_acctbal > -800").select(F.col("c_custkey").alias("o_custkey"))
    return line.join(busy, "o_custkey").select(
        tag("endpoint:", "o_custkey").alias("source"), F.when(F.col("l_discount") < 0.1, target).alias("target"), kind.alias("kind"),
        F.when(F.col("l_tax") > 0.01, "findMany").alias("operation"), F.when(F.col("l_discount") > 0.01, "made").alias("topic"),
    )


def resources(spark, d):
    r = _read(spark, d, "region")
    database = r.select(tag("database:", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") > 0, "postgresql").alias("engine"), F.when(F.col("r_regionkey") != 1, F.lower("r_name")).alias("alias"))
    broker = r.select(F.when(F.col("r_regionkey") != 2, tag("broker:", "r_regionkey")).alias("id"), F.when(F.col("r_regionkey") != 3, F.col("r_name")).alias("name"), F.lit("kafka").alias("engine"), F.lower("r_name").alias("alias"))
    screen = r.select(tag("screen:", "r_regionkey").alias("id"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("name"), F.when(F.col("r_regionkey") > 2, F.lower("r_name")).alias("file"))
    return database, broker, screen


def topology(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    database, broker, screen = resources(spark, d)
    return {"services": services(spark, d), "endpoints": endpoints(spark, d), "functions": functions(spark, d), "nodes": nodes(spark, d), "edges": edges(spark, d), "databases": database, "brokers": broker, "screens": screen}


def saved(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """The topology, with the tables that a query reads more than once written and read back."""
    folder, t = Saved(spark), topology(spark, d)
    return t | {n: folder.save(t[n], n) for n in names}


#: The same tables as common table expressions.
SQL = """
services AS (SELECT 'service:' || n_nationkey AS id, CASE WHEN n_nationkey <> 7 THEN n_name END AS name, CASE WHEN n_nationkey < 20 THEN lower(n_name) END AS code,
    CASE n_regionkey WHEN 0 THEN 'frontend' WHEN 1 THEN 'worker' ELSE 'backend' END AS kind FROM nation),
endpoints AS (SELECT 'endpoint:' || c_custkey AS id, 'service:' || c_nationkey AS service_id, c_name AS name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GET' WHEN 'BUILDING' THEN 'POST' WHEN 'FURNITURE' THEN 'FETCH' WHEN 'MACHINERY' THEN 'DELETE' END AS method,
    CASE WHEN c_acctbal >= 0 THEN '/customers/' || c_custkey END AS path, 'src/' || lower(c_mktsegment) || '.ts' AS file, c_custkey AS ord FROM customer),
functions AS (SELECT 'function:' || s_suppkey AS id, 'service:' || s_nationkey AS service_id, s_name AS name,
    CASE WHEN s_acctbal < 0 THEN 'lambda' WHEN s_acctbal > 9000 THEN 'constructor' ELSE 'method' END AS kind,
    'Class' || CAST(floor(s_acctbal / 500) AS BIGINT) AS class_name, s_suppkey AS ord FROM supplier),
lines AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS state, min(l_tax) AS tax, min(l_discount) AS discount, min(l_suppkey) AS supp,
    min(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
heads AS (SELECT *, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS head, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first
    FROM lines JOIN orders ON l_orderkey = o_orderkey),
kinds AS (SELECT *, CASE WHEN head THEN CASE flag WHEN 'R' THEN 'try' WHEN 'A' THEN 'if' END WHEN flag = 'R' AND tax > 0.06 THEN 'catch' END AS kind FROM heads),
nodes AS (SELECT 'node:' || l_orderkey || '.' || l_linenumber AS id,
    CASE WHEN head OR state = 'F' THEN 'endpoint:' || o_custkey ELSE 'node:' || l_orderkey || '.' || first END AS parent_id,
    CASE WHEN head OR kind = 'catch' THEN 'flowControl' ELSE ['call', 'dbProcess', 'externalCall', 'event', 'log', 'return', 'throw'][l_linenumber] END AS type, kind,
    CASE WHEN supp % 5 > 0 THEN 'database:' || supp END AS database_id, CASE WHEN tax > 0 THEN 'findMany' END AS operation, CASE WHEN discount > 0 THEN 'GET' END AS method,
    CASE WHEN tax < 0.07 THEN '/x' END AS path, CASE WHEN discount < 0.1 THEN 'made' END AS event_name, CASE WHEN tax > 0.07 THEN 'loud' ELSE 'info' END AS level,
    CASE WHEN discount < 0.05 THEN 0 END AS branches, CASE WHEN quantity > 25 THEN 400 ELSE 500 END AS status, CAST(l_linenumber AS BIGINT) AS ord, 'f' || l_orderkey AS file FROM kinds),
edges AS (SELECT 'endpoint:' || o_custkey AS source, CASE WHEN l_discount < 0.1 THEN CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'external:' || l_partkey
    WHEN l_quantity < 2 THEN 'endpoint:' || o_custkey ELSE 'function:' || l_suppkey END END AS target,
    CASE WHEN l_returnflag = 'A' THEN 'calls' WHEN l_returnflag = 'R' THEN 'reads_from' WHEN l_tax > 0 THEN 'publishes_to' END AS kind,
    CASE WHEN l_tax > 0.01 THEN 'findMany' END AS operation, CASE WHEN l_discount > 0.01 THEN 'made' END AS topic
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > -800),
databases AS (SELECT 'database:' || r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey > 0 THEN 'postgresql' END AS engine,
    CASE WHEN r_regionkey <> 1 THEN lower(r_name) END AS alias FROM region),
brokers AS (SELECT CASE WHEN r_regionkey <> 2 THEN 'broker:' || r_regionkey END AS id, CASE WHEN r_regionkey <> 3 THEN r_name END AS name, 'kafka' AS engine, lower(r_name) AS alias FROM region),
screens AS (SELECT 'screen:' || r_regionkey AS id, CASE WHEN r_regionkey > 1 THEN r_name END AS name, CASE WHEN r_regionkey > 2 THEN lower(r_name) END AS file FROM region)
"""
