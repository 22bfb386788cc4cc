"""Topologies as documents of type VARIANT: a node a line, which any depth and size fits, or whole services, which one recursive query takes apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a node's document, where they come from, and their types.
FIELDS = [("id", "id", "string"), ("parentId", "parent_id", "string"), ("serviceId", "service_id", "string"), ("ord", "ord", "bigint"), ("depth", "depth", "int"), ("type", "type", "string"), ("name", "name", "string"), ("kind", "kind", "string"), ("line", "line", "int"), ("endLine", "end_line", "int"), ("metadata", "metadata", "map<string,string>")]


def write_nodes(nodes: DataFrame, path: str) -> None:
    """A JSON line for each of nodes(id, parent_id, service_id, ord, depth, type, name, kind, line, end_line, metadata). No line grows with what is below its node."""
    nodes.select(F.to_json(F.struct(*[F.col(c).alias(k) for k, c, _ in FIELDS])).alias("value")).write.mode("overwrite").text(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes that write_nodes() wrote. Lines that aren't JSON are an error."""
    v = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    return v.select(*[F.try_variant_get("v", f"$.{k}", t).alias(c) for k, c, t in FIELDS])


_NESTED = """
WITH RECURSIVE documents AS (SELECT coalesce(variant_get(v, '$.topology'), v) AS v FROM (SELECT parse_json(value) AS v FROM {text} WHERE trim(value) <> '')),
tops AS (
  SELECT variant_get(d.v, '$.id', 'string') AS service_id, e.pos AS ord, e.value AS node FROM documents d, LATERAL variant_explode_outer(variant_get(d.v, '$.endpoints')) e
  UNION ALL SELECT variant_get(d.v, '$.id', 'string'), e.pos, e.value FROM documents d, LATERAL variant_explode_outer(variant_get(d.v, '$.functions')) e),
below(service_id, parent_id, ord, depth, node) MAX RECURSION LEVEL 1001 AS (
  SELECT service_id, CAST(NULL AS STRING), ord, 0, node FROM tops WHERE node IS NOT NULL
  UNION ALL SELECT b.service_id, variant_get(b.node, '$.id', 'string'), c.pos, b.depth + 1, c.value FROM below b, LATERAL variant_explode(variant_get(b.node, '$.children')) c)
SELECT service_id, parent_id, CAST(ord AS BIGINT) AS ord, depth, node FROM below
"""


def read_nested(spark: SparkSession, path: str, save) -> DataFrame:
    """(service_id, parent_id, ord, depth, id, type, name, kind, line, end_line, metadata) of nested documents, one a line, which may be wrapped as {"topology": ...}.

    Each line is parsed once; a level of the tree is a step of one recursive query.
    Spark's JSON reader takes up to 1,000 brackets within each other; what is deeper
    is written and read a node a line. save(df, name) writes a table and returns it
    read back.
    """
    rows = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "-1")  # no limit, while the query runs
    try:
        found = spark.sql(_NESTED, text=spark.read.text(path))
        own = [(k, c, t) for k, c, t in FIELDS if c not in ("parent_id", "service_id", "ord", "depth")]
        return save(found.select("service_id", "parent_id", "ord", "depth", *[F.try_variant_get("node", f"$.{k}", t).alias(c) for k, c, t in own]), "nested")
    finally:
        spark.conf.set(rows, before)
