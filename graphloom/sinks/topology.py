"""Topologies as files: tables as Parquet, one JSON document a service, property graphs, and summaries.

Tables are as in operators.validate. A JSON document nests code nodes by parent:
{"id", "name", "code", "kind", "endpoints": [node...], "functions": [node...]}, and
a node is {"id", "type", "name", "kind", "line", "endLine", "metadata", "children"}.
Documents are lines of text files, written in parallel; a service is one line.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NODE = "id string, type string, name string, kind string, line int, endLine int, metadata map<string,string>, raw string, children string"
SERVICE = "id string, name string, code string, kind string, endpoints string, functions string"


def check_inside(path: str, *roots: str) -> str:
    """The path, if it is a folder below one of the roots; links are followed first. URLs of other file systems pass, as Spark's own rights hold there."""
    local = path.removeprefix("file://")
    if "://" in local:
        return path
    real = os.path.realpath(local)
    if not any(os.path.commonpath([real, os.path.realpath(r.removeprefix("file://"))]) == os.path.realpath(r.removeprefix("file://")) for r in roots):
        raise ValueError(f"{path} isn't below {' or '.join(roots)}")
    return path


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in schemas.items()}


def without_raw(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without source text."""
    return {name: df.drop("raw") for name, df in tables.items()}


def nested_json(nodes: DataFrame, save, raw: bool = False) -> DataFrame:
    """(id, parent_id, service_id, ord, json) of nodes(id, parent_id, service_id, depth, ord, type, name, kind, line, end_line, metadata[, raw]) from the deepest up: each holds its children, in order. A level of the tree is one grouped step."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("id", "parent_id", "service_id", "ord", F.lit("").alias("json"))
    out, below = None, None
    for depth in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is not None:
            kids = below.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "json"))), lambda c: c["json"]), ",").alias("kids"))
            level = level.join(kids, "id", "left")
        else:
            level = level.withColumn("kids", F.lit(None).cast("string"))
        fields = ["id", "type", "name", "kind", "line", F.col("end_line").alias("endLine"), "metadata", *(["raw"] if raw else [])]
        head = F.to_json(F.struct(*fields))
        level = level.select("id", "parent_id", "service_id", "ord", F.concat(F.left(head, F.length(head) - 1), F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}")).alias("json"))
        below = save(level, f"json_{depth}")
        out = below
    return out


def documents(services: DataFrame, nodes: DataFrame, save, raw: bool = False) -> DataFrame:
    """(id, json) of every service. nodes: endpoints and functions are those of depth 0."""
    tops = nested_json(nodes, save, raw)
    kind = F.when(tops["json"].startswith('{"id":'), F.get_json_object("json", "$.type"))
    of = lambda t: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t") == t, F.struct("ord", "id", "json")))), lambda c: c["json"]), ",").alias(t)
    lists = tops.withColumn("_t", kind).groupBy(F.col("service_id").alias("id")).agg(of("endpoint"), of("function"))
    head = F.to_json(F.struct("id", "name", "code", "kind"))
    arrays = F.concat(F.lit(',"endpoints":['), F.coalesce("endpoint", F.lit("")), F.lit('],"functions":['), F.coalesce("function", F.lit("")), F.lit("]}"))
    return services.join(lists, "id", "left").select("id", F.concat(F.left(head, F.length(head) - 1), arrays).alias("json"))


def write_topology(services: DataFrame, nodes: DataFrame, path: str, save, *, roots: tuple[str, ...] = (".",), raw: bool = False) -> str:
    """Write documents() as text files below one of the roots; returns the path."""
    check_inside(path, *roots)
    documents(services, nodes, save, raw).select(F.col("json").alias("value")).write.mode("overwrite").text(path)
    return path


def read_topology(spark: SparkSession, path: str, save) -> tuple[DataFrame, DataFrame]:
    """(services, nodes) of documents, which may be wrapped as {"topology": ...}. Nodes get parent_id, depth and ord, a level of the tree a step, however deep."""
    text = spark.read.text(path).where(F.trim("value") != "")
    body = F.coalesce(F.get_json_object("value", "$.topology"), F.col("value"))
    d = save(text.select(F.from_json(body, SERVICE).alias("s")).select("s.*"), "documents")
    tops = d.select(F.col("id").alias("service_id"), F.explode(F.array(F.col("endpoints"), F.col("functions"))).alias("items"))
    level = tops.withColumn("parent_id", F.lit(None).cast("string"))
    out, depth = None, 0
    while True:
        parsed = level.select("service_id", "parent_id", F.posexplode(F.from_json("items", "array<string>")).alias("ord", "item"))
        parsed = parsed.select("service_id", "parent_id", F.col("ord").cast("long").alias("ord"), F.from_json("item", NODE).alias("n"))
        rows = parsed.select("service_id", "parent_id", F.lit(depth).alias("depth"), "ord", "n.id", "n.type", "n.name", "n.kind", "n.line", F.col("n.endLine").alias("end_line"), "n.metadata", "n.raw", "n.children")
        rows = save(rows, f"read_{depth}")
        out = rows if out is None else out.unionByName(rows)
        level = rows.where("children is not null and children <> '[]'").select("service_id", F.col("id").alias("parent_id"), F.col("children").alias("items"))
        if level.isEmpty():
            break
        depth += 1
    return d.select("id", "name", "code", "kind"), out.drop("children")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, name, n): endpoints and functions of each service, tables of each database, topics of each broker, findings of each level, and how many there are of each."""
    one = lambda df, what, name: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    parts = [tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), F.lit(None).cast("string").alias("name"), "n") for t in tables]
    for t, c in (("endpoints", "service_id"), ("functions", "service_id"), ("tables", "database_id"), ("topics", "broker_id"), ("diagnostics", "level")):
        if t in tables and c in tables[t].columns:
            parts.append(one(tables[t], f"{t} of", F.col(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_text(counts: DataFrame) -> str:
    """Lines of summary(); one for each service, database, broker and level."""
    rows = counts.orderBy("what", F.col("name").asc_nulls_first()).collect()
    return "\n".join(f"{r.what}{' ' + r.name if r.name is not None else ''}: {r.n}" for r in rows)


def flatten(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A property graph: nodes(id, labels, props) of all tables, and edges(source, target, kind): CONTAINS by parents and owners, RESOLVES of calls, and those of the edges table."""
    labels = {"services": "Service", "endpoints": "Endpoint", "functions": "Function", "databases": "Database", "brokers": "Broker", "tables": "Table", "screens": "Screen", "components": "Component"}
    nodes, edges = [], []

    def props(df: DataFrame) -> Column:
        flat = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "integer", "long", "double", "boolean") and f.name != "id"]
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in flat])
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    for t, label in labels.items():
        if t in tables:
            nodes.append(tables[t].select("id", F.array(F.lit(label)).alias("labels"), props(tables[t]).alias("props")))
            owner = next((c for c in ("service_id", "database_id", "screen_id") if c in tables[t].columns), None)
            if owner:
                edges.append(tables[t].where(F.col(owner).isNotNull()).select(F.col(owner).alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("kind")))
    if "nodes" in tables:
        n = tables["nodes"]
        nodes.append(n.select("id", F.array(F.lit("CodeNode"), F.concat(F.upper(F.left("type", F.lit(1))), F.substring("type", 2, 100))).alias("labels"), props(n).alias("props")))
        edges.append(n.where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("kind")))
        if "resolved_to" in n.columns:
            edges.append(n.where("resolved_to is not null").select(F.col("id").alias("source"), F.col("resolved_to").alias("target"), F.lit("RESOLVES").alias("kind")))
    if "edges" in tables:
        edges.append(tables["edges"].select("source", "target", F.upper("kind").alias("kind")))
    join = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(join(parts[1:]))
    return join(nodes), join(edges).distinct()


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON table; an empty one where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_stamped(df: DataFrame, path: str) -> None:
    """Write a table as JSON, with the time in `updatedAt`."""
    df.withColumn("updatedAt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).write.mode("overwrite").json(path)


def write_pending(pending: DataFrame, topology: str) -> str:
    """Calls that wait for a decision, next to a topology."""
    path = topology.rstrip("/") + ".pending-merges"
    pending.write.mode("overwrite").json(path)
    return path


def read_pending(spark: SparkSession, topology: str, schema: StructType | str) -> DataFrame:
    """What write_pending() wrote; an error where there is none."""
    return spark.read.schema(schema).json(topology.rstrip("/") + ".pending-merges")
