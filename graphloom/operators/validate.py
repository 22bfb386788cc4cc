"""Validation of a topology's tables: rules as data, one pass a table, and joins for what spans tables.

Tables (columns that a rule needs; others may be there):

services(id, name, code, kind), endpoints(id, service_id, method, path, file),
functions(id, service_id, name, kind), nodes(id, service_id, type, parent_id,
kind, database_id, operation, method, path, event_name, level, branches),
databases and brokers(id, name, engine, alias), tables(id), storages(id),
screens(id, name, file), components(id), edges(source, target, kind, ord,
operation, topic). A table that is left out is empty. Empty text counts as missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree

#: HTTP methods, kinds of functions, levels of logs, kinds of telemetry, frontend kinds of services.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]
FUNCTION_KINDS = ["declaration", "expression", "arrow", "method", "constructor", "getter", "setter"]
LOG_LEVELS = ["trace", "debug", "info", "warn", "error", "fatal", "log"]
TELEMETRY_KINDS = ["span", "metric", "trace", "event", "baggage", "context"]
FRONTEND_KINDS = ["frontend", "microfrontend", "mobile"]

FOUND = "level string, rule string, check string, node string, message string"


def missing(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def unexpected(c: str, allowed: list[str]) -> Column:
    return ~missing(c) & ~F.col(c).isin(allowed)


@dataclass
class Rule:
    """check: number of the rule; what: the message, with {id} and {value}; field: the name it is filed under; only: the node type it is for; value: a column shown."""

    check: str
    table: str
    level: str
    field: str
    what: str
    when: Column | None = None
    value: str | None = None
    only: str | None = None
    needs_id: bool = True


def _needs(check: str, table: str, label: str, *fields: tuple[str, str, str]) -> list[Rule]:
    """Rules that fields(column, field name, level) aren't missing; without an id there is no more to say."""
    out = [Rule(check, table, "error", "id", f"{label} missing id", missing("id"), needs_id=False)]
    return out + [Rule(check, table, level, name, f'{label} "{{id}}" missing {name.rpartition(".")[2]}', missing(c)) for c, name, level in fields]


def rules() -> list[Rule]:
    resource = [("name", "name", "warning"), ("engine", "metadata.engine", "error"), ("alias", "metadata.connectionAlias", "error")]
    code = lambda check, kind, label, c, name: Rule(check, "nodes", "warning", f"metadata.{name}", f'{label} "{{id}}" missing {name}', missing(c), only=kind)
    odd = lambda check, kind, label, c, name, ok: Rule(check, "nodes", "warning", f"metadata.{name}", f'{label} "{{id}}" has invalid {name} "{{value}}"', unexpected(c, ok), c, only=kind)
    return [
        *_needs("VL-1", "databases", "DatabaseNode", *resource),
        *_needs("VL-2", "brokers", "BrokerNode", *resource),
        *_needs("VL-3", "screens", "ScreenNode", ("name", "name", "warning"), ("file", "metadata.filePath", "warning")),
        *_needs("VL-4", "services", "ServiceNode", ("name", "name", "error"), ("code", "code", "warning")),
        *_needs("VL-6", "endpoints", "EndpointNode", ("method", "metadata.method", "error"), ("path", "metadata.path", "error"), ("file", "location.file", "warning")),
        Rule("VL-6", "endpoints", "error", "metadata.method", 'EndpointNode "{id}" has invalid method "{value}"', unexpected("method", METHODS), "method"),
        *_needs("VL-7", "functions", "FunctionNode", ("name", "name", "warning")),
        Rule("VL-7", "functions", "warning", "metadata.kind", 'FunctionNode "{id}" has unexpected kind "{value}"', unexpected("kind", FUNCTION_KINDS), "kind"),
        Rule("VL-8", "nodes", "error", "id", 'CodeNode of type "{value}" missing id', missing("id"), "type", needs_id=False),
        code("VL-9", "dbProcess", "DbProcessNode", "database_id", "databaseId"),
        code("VL-9", "dbProcess", "DbProcessNode", "operation", "operation"),
        code("VL-10", "externalCall", "ExternalCallNode", "method", "method"),
        code("VL-10", "externalCall", "ExternalCallNode", "path", "path"),
        code("VL-11", "event", "EventNode", "event_name", "eventName"),
        odd("VL-12", "log", "LogNode", "level", "level", LOG_LEVELS),
        odd("VL-13", "telemetry", "TelemetryNode", "kind", "kind", TELEMETRY_KINDS),
        code("VL-14", "flowControl", "FlowControlNode", "kind", "kind"),
    ]


def fields(tables: dict[str, DataFrame]) -> DataFrame:
    """VL-1 to VL-14 but VL-5: each table is read once; its rules are entries of an array, of which those that hold become rows."""
    out = None
    for name in dict.fromkeys(r.table for r in rules()):
        if name not in tables:
            continue
        found = []
        for r in (r for r in rules() if r.table == name):
            holds = r.when if r.only is None else (F.col("type") == r.only) & r.when
            if r.needs_id:
                holds = holds & ~missing("id")
            text = F.lit(r.what)
            for mark, c in (("{id}", "id"), ("{value}", r.value)):
                if mark in r.what:
                    text = F.replace(text, F.lit(mark), F.coalesce(F.col(c), F.lit("")))
            found.append(F.when(holds, F.struct(F.lit(r.level).alias("level"), F.lit(r.field).alias("rule"), F.lit(r.check).alias("check"), F.when(~missing("id"), F.col("id")).alias("node"), text.alias("message"))))
        rows = tables[name].select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _row(df: DataFrame, check: str, level: str, node: Column, message: Column, field: str | None = None) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(field).cast("string").alias("rule"), F.lit(check).alias("check"), node.alias("node"), message.alias("message"))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def frontends(services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """VL-5: frontend services with endpoints."""
    n = endpoints.groupBy(F.col("service_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    bad = services.where(F.col("kind").isin(FRONTEND_KINDS)).join(n, "id")
    return _row(bad, "VL-5", "warning", F.col("id"), text('frontend ServiceNode "', F.col("name"), '" has ', F.col("n").cast("string"), " endpoint(s)"), "endpoints")


def node_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that an edge may name: services, endpoints, functions, code nodes, databases, tables, brokers, storages, screens, components; not columns."""
    names = ["services", "endpoints", "functions", "nodes", "databases", "tables", "brokers", "storages", "screens", "components"]
    parts = [tables[t].select("id") for t in names if t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def edge_rules(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """VL-15 to VL-20. Edges without an end are told once and nothing more is said of them. Repeats of an edge are counted before they are told, so a hot edge isn't sorted in one task."""
    s, t, kind = F.col("source"), F.col("target"), F.col("kind")
    arrow = text(s, " →[", kind, "]→ ", t)
    no_source = missing("source")
    no_target = ~no_source & missing("target")
    whole = ~no_source & ~missing("target")
    entry = lambda holds, check, level, field, message: F.when(holds, F.struct(F.lit(level).alias("level"), F.lit(field).cast("string").alias("rule"), F.lit(check).alias("check"), F.when(whole, s).alias("node"), message.alias("message")))
    one = F.array_compact(
        F.array(
            entry(no_source, "VL-15", "error", "source", F.lit("Edge missing source")),
            entry(no_target, "VL-15", "error", "target", F.lit("Edge missing target")),
            entry(whole & missing("kind"), "VL-15", "error", None, text("Edge ", s, " → ", t, " missing kind")),
            entry(whole & (s == t), "VL-16", "warning", None, text('Self-loop edge on node "', s, '"')),
            entry(whole & kind.isin("reads_from", "writes_to") & missing("operation"), "VL-19", "info", "metadata.operation", text("Edge ", arrow, " missing metadata.operation")),
            entry(whole & kind.isin("publishes_to", "consumes_from") & missing("topic"), "VL-20", "info", "metadata.topic", text("Edge ", arrow, " missing metadata.topic")),
        )
    )
    out = edges.select(F.explode(one).alias("f")).select("f.*")
    good = edges.where(whole)
    known = ids.select("id")
    for end in ("source", "target"):
        lost = good.join(known.withColumnRenamed("id", end), end, "left_anti")
        out = out.unionByName(_row(lost, "VL-17", "warning", s, text(f'Edge {end} "', F.col(end), '" not found in topology node index'), end))
    repeats = good.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = repeats.withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    return out.unionByName(_row(repeats, "VL-18", "info", s, text("Duplicate edge: ", arrow)))


def stubs(endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """VL-21: endpoints that no edge leaves."""
    lost = endpoints.where(~missing("id")).join(edges.select(F.col("source").alias("id")), "id", "left_anti")
    return _row(lost, "VL-21", "info", F.col("id"), text('EndpointNode "', F.col("id"), '" (', F.col("method"), " ", F.col("path"), ") has no outgoing edges"))


def flow_rules(endpoints: DataFrame, nodes: DataFrame, save) -> DataFrame:
    """VL-22 to VL-24, on the nodes below endpoints."""
    rooted = tree.roots(nodes.select("id", "parent_id", "type", "kind", "branches").unionByName(endpoints.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit("endpoint").alias("type"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("branches"))), save)
    rooted = save(rooted.where("depth > 0").join(endpoints.select(F.col("id").alias("root_id"), "method", "path"), "root_id"), "below_endpoints")
    # leaves are nodes without children that aren't flow; an endpoint with leaves, none of which ends the flow
    ends = F.col("type").isin("return", "throw").cast("int")
    open_ = tree.leaves(rooted, F.col("type") == "flowControl").groupBy("root_id", "method", "path").agg(F.max(ends).alias("ends")).where("ends = 0")
    out = _row(open_, "VL-22", "warning", F.col("root_id"), text('EndpointNode "', F.col("root_id"), '" (', F.col("method"), " ", F.col("path"), ") has no return or throw nodes"))
    flow = rooted.where("type = 'flowControl'")
    parents = rooted.select(F.col("parent_id").alias("id")).distinct()
    # branches: how many are listed; null: no list at all, which passes
    hollow = flow.where("branches = 0").join(parents, "id", "left_anti")
    out = out.unionByName(_row(hollow, "VL-23", "info", F.col("id"), text('FlowControlNode "', F.col("id"), '" (', F.col("kind"), ') in endpoint "', F.col("root_id"), '" has no children or branches')))
    caught = flow.where("kind = 'catch'").select(F.col("parent_id").alias("at")).distinct()
    tries = flow.where("kind = 'try'")
    lone = tries.join(caught, F.col("parent_id") == F.col("at"), "left_anti").join(caught, F.col("id") == F.col("at"), "left_anti")
    return out.unionByName(_row(lone, "VL-24", "info", F.col("id"), text('Try block "', F.col("id"), '" in "', F.col("root_id"), '" has no corresponding catch')))


def short_names(functions: DataFrame) -> DataFrame:
    """VL-25, second half (the first is VL-21): functions with names of at most two characters."""
    short = functions.where(F.length("name") <= 2)
    return _row(short, "VL-25", "warning", F.col("id"), text('FunctionNode "', F.col("id"), '" has a very short name "', F.col("name"), '"'), "name")


def validate(tables: dict[str, DataFrame], save) -> DataFrame:
    """All findings: (level, rule, check, node, message)."""
    out = fields(tables)
    services, endpoints = tables["services"], tables["endpoints"]
    out = out.unionByName(frontends(services, endpoints))
    out = out.unionByName(edge_rules(tables["edges"], node_ids(tables)))
    out = out.unionByName(stubs(endpoints, tables["edges"]))
    if "nodes" in tables:
        out = out.unionByName(flow_rules(endpoints, tables["nodes"], save))
    return out.unionByName(short_names(tables["functions"])) if "functions" in tables else out
