"""A source repository as a property graph: scan, parse, nest, derive edges, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import kebab
from graphloom.operators import edges as E
from graphloom.operators import enrich, errors, links, nest, resolve, resources, tree, validate
from graphloom.saved import Saved
from graphloom.sources import parse, scan


def nodes(spark: SparkSession, root: str, skip_tests: bool = True) -> DataFrame:
    """Node rows of a repository, each file in its services."""
    return nodes_of(scan.read_files(spark, root), skip_tests)


def nodes_of(files: DataFrame, skip_tests: bool = True, frontend: bool = True, types: list[str] | None = None) -> DataFrame:
    """Node rows of files(path, size, content), or of these only those of the given types."""
    placed = scan.assign(scan.source_files(files, skip_tests, frontend=frontend), scan.boundaries(files))
    return parse.with_ids(parse.parse(placed, types))


#: Columns that a position has room for, all that a number of columns can be: positions are line * COLUMNS + column.
COLUMNS = 1 << 31


#: Types of nodes that nothing holds.
FREE = ["function", "endpoint", "table", "column", "diagnostic"]


def containers(all_nodes: DataFrame, types: list[str]) -> DataFrame:
    """(node_id, container): the uid of a node, and uid and id of the smallest node of the types whose lines hold its line; functions before endpoints, then in order."""
    key = ["service", "path"]
    rank = (F.col("type") == "endpoint").cast("long") * F.lit(1 << 40)
    outer = all_nodes.where(F.col("type").isin(types)).select(*key, F.struct("uid", "id").alias("container_id"), F.col("line").cast("long").alias("low"), F.col("end_line").cast("long").alias("high"), (rank + F.col("ord")).alias("ord"))
    inner = all_nodes.where(~F.col("type").isin(FREE))
    return nest.smallest_span(inner.select(*key, F.col("uid").alias("node_id"), F.col("line").alias("at")), outer, key, "at", once=True).select("node_id", F.col("container_id").alias("container"))


def with_uid(all_nodes: DataFrame) -> DataFrame:
    """Nodes with a key of their own: ids are short hashes, which two nodes of a line or service may share."""
    return all_nodes.withColumn("uid", F.concat_ws("|", "service", "path", F.col("ord").cast("string")))


def nested(all_nodes: DataFrame) -> DataFrame:
    """nodes with parent_id: the smallest function or endpoint of the file around a node, or the smallest flow node in it that starts before and ends no earlier.

    Nodes that nothing holds are kept, with a null parent; topology() leaves them
    out, but module data. Functions and endpoints have no parent.
    """
    n = with_uid(all_nodes)
    held = containers(n, ["function", "endpoint"])
    key = ["service", "path"]
    at = F.col("line").cast("long") * COLUMNS + F.least(F.col("col"), F.lit(COLUMNS - 2))
    flow = n.where("type = 'flowControl'").select(*key, F.struct("uid", "id").alias("container_id"), (at + 1).alias("low"), (F.col("end_line").cast("long") * COLUMNS + COLUMNS - 1).alias("high"), "ord")
    inner = n.where(~F.col("type").isin(FREE)).select(*key, F.col("uid").alias("node_id"), at.alias("at"))
    inside = nest.smallest_span(inner, flow, key, "at", once=True).select("node_id", F.col("container_id").alias("flow"))
    # a flow node counts if it is in the same function: a function may lie between
    flows = n.where("type = 'flowControl'").select(F.col("uid").alias("node_id"))
    around = held.join(flows, "node_id", "left_semi").select(F.col("node_id").alias("flow_id"), F.col("container.uid").alias("flow_in"))
    inside = inside.withColumn("flow_id", F.col("flow.uid")).join(around, "flow_id").select("node_id", F.col("flow.id").alias("flow_id"), "flow_in")
    own = held.join(inside, "node_id", "left")
    parent = own.select(F.col("node_id").alias("uid"), F.when(F.col("flow_in") == F.col("container.uid"), F.col("flow_id")).otherwise(F.col("container.id")).alias("parent_id"))
    return n.join(parent, "uid", "left")


def owners(all_nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(service, path, ord, fn_id): the innermost function around each node, or around each of the rows `of` (service, path, ord, line), some of the nodes.

    One sort of these and the functions by file and line; what is found is the function's id itself, so no join follows.
    """
    key = ["service", "path"]
    if of is None:
        of = all_nodes.where("type not in ('function', 'endpoint', 'table', 'column', 'diagnostic')")
    f = all_nodes.where("type = 'function'").select(*key, F.col("id").alias("container_id"), F.col("line").cast("long").alias("low"), F.col("end_line").cast("long").alias("high"), "ord")
    at = of.select(*key, F.struct(*key, "ord").alias("node_id"), "line")
    return nest.smallest_span(at, f, key, "line", once=True).select("node_id.*", F.col("container_id").alias("fn_id"))


def _called(all_nodes: DataFrame) -> DataFrame:
    """Calls (id, service, path, ord, line, bare, by_name, by_method) that may have a callee: their names, or the last parts of long ones, are functions' (by_name, by_method: these functions' ids), or bare is the name of a method of their own class."""
    f = all_nodes.where("type = 'function'").select("id", "name", F.col("line").alias("ord"), F.substring_index("name", ".", -1).alias("method"))
    calls = all_nodes.where("type = 'call'").select("id", "service", "path", "ord", "line", F.col("name").alias("callee"))
    calls = calls.withColumn("method", F.when(F.size(F.split("callee", r"\.")) >= 3, F.substring_index("callee", ".", -1)))
    calls = calls.withColumn("bare", F.when(F.col("callee").rlike(r"^(this|self)\.\w+$"), F.regexp_replace("callee", r"^(this|self)\.", "")))
    named = resolve.last_wins(f, "name").select(F.col("name").alias("callee"), F.col("id").alias("by_name"))
    tails = resolve.first_wins(f, "method").select("method", F.col("id").alias("by_method"))
    found = calls.join(named, "callee", "left").join(tails, "method", "left")
    return found.where("by_name is not null or by_method is not null or bare is not null").drop("callee", "method")


def _resolved(all_nodes: DataFrame, calls: DataFrame, own: DataFrame) -> DataFrame:
    """(id, source, resolved_to) of _called() calls and their owners."""
    f = all_nodes.where("type = 'function'").select("id", "name", F.col("line").alias("ord"))
    found = calls.join(own, ["service", "path", "ord"]).select("id", F.col("fn_id").alias("source"), "bare", "by_name", "by_method")
    # few calls name a method of their own class: the class is only looked up for these
    inside = found.where("bare is not null").join(f.select(F.col("id").alias("source"), F.regexp_extract("name", r"^(.*)\.", 1).alias("own")), "source")
    members = resolve.last_wins(f, "name").select(F.col("name").alias("member"), F.col("id").alias("by_member"))
    inside = inside.withColumn("member", F.concat("own", F.lit("."), "bare")).join(members, "member", "left")
    known = found.where("bare is null").select("id", "source", F.coalesce("by_name", "by_method").alias("resolved_to"))
    return known.unionByName(inside.select("id", "source", F.coalesce("by_name", "by_member", "by_method").alias("resolved_to"))).where("resolved_to is not null")


def resolved_calls(all_nodes: DataFrame) -> DataFrame:
    """(id, source, resolved_to) of calls inside functions whose callee is known: by whole name (the last of equal names), then this.m and self.m in the own class, then by method name (the first).

    Names are looked up first: most calls are of no function here, and needn't be placed.
    """
    calls = Saved(all_nodes.sparkSession).save(_called(all_nodes), "called")
    return _resolved(all_nodes, calls, owners(all_nodes, calls))


def _call_edges(resolved: DataFrame) -> DataFrame:
    found = resolved.where("resolved_to <> source")
    return E.dedup(found.select("source", F.col("resolved_to").alias("target"), F.lit("calls").alias("kind"), F.lit(0).alias("ord"))).drop("ord")


def call_edges(all_nodes: DataFrame) -> DataFrame:
    """calls edges from functions to other functions, once each."""
    return _call_edges(resolved_calls(all_nodes))


def handlers(all_nodes: DataFrame) -> DataFrame:
    """(id, handler): the function of the service that each endpoint is served by."""
    return links.endpoint_handlers(all_nodes.where("type = 'endpoint'"), all_nodes.where("type = 'function'"))


WRITES = ["create", "createMany", "update", "updateMany", "upsert", "delete", "deleteMany"]


def edge_facts(all_nodes: DataFrame) -> DataFrame:
    """(source, target, kind, operation, topic) of edges to databases and topics: the sorted distinct operations, and the topic."""
    db = all_nodes.where("type = 'dbProcess'")
    db = db.join(owners(all_nodes, db), ["service", "path", "ord"])
    db = db.groupBy(F.col("fn_id").alias("source"), F.concat(F.lit("database:"), "service").alias("target"), F.when(F.col("kind").isin(WRITES), "writes_to").otherwise("reads_from").alias("kind"))
    db = db.agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("operation")).withColumn("operation", F.when(F.col("operation") != "", F.col("operation")))
    ev = all_nodes.where("type = 'event'")
    service, topic, out = F.concat(F.lit("service:"), "service"), F.concat(F.lit("topic:"), "name"), F.col("kind") == "publish"
    ev = ev.select(F.when(out, service).otherwise(topic).alias("source"), F.when(out, topic).otherwise(service).alias("target"), F.when(out, "publishes_to").otherwise("consumes_from").alias("kind"), F.lit(None).cast("string").alias("operation"), F.col("name").alias("topic")).distinct()
    return db.withColumn("topic", F.lit(None).cast("string")).unionByName(ev)


def derived_edges(all_nodes: DataFrame) -> DataFrame:
    """calls, endpoint handlers, database reads and writes, and events, without repeats."""
    calls = Saved(all_nodes.sparkSession).save(_called(all_nodes), "called")
    db = all_nodes.where("type = 'dbProcess'").select("service", "path", "ord", "line", "kind")
    # calls and database operations are placed in functions at once; nodes of a file have different ord
    place = ["service", "path", "ord"]
    own = owners(all_nodes, calls.select(*place, "line").unionByName(db.select(*place, "line")))
    called = _call_edges(_resolved(all_nodes, calls, own))
    handled = handlers(all_nodes).select(F.col("id").alias("source"), F.col("handler").alias("target"), F.lit("calls").alias("kind"))
    writes = F.col("kind").isin(WRITES)
    used = db.join(own, place).select(F.col("fn_id").alias("source"), F.concat(F.lit("database:"), "service").alias("target"), F.when(writes, "writes_to").otherwise("reads_from").alias("kind"))
    ev = all_nodes.where("type = 'event'").select(F.col("service"), F.concat(F.lit("topic:"), "name").alias("topic"), F.col("kind").alias("role"))
    events = ev.select(F.when(F.col("role") == "publish", F.concat(F.lit("service:"), "service")).otherwise(F.col("topic")).alias("source"), F.when(F.col("role") == "publish", F.col("topic")).otherwise(F.concat(F.lit("service:"), "service")).alias("target"), F.when(F.col("role") == "publish", "publishes_to").otherwise("consumes_from").alias("kind"))
    return called.unionByName(handled).unionByName(used).unionByName(events).distinct()


#: Types of nodes that derived_edges() reads.
EDGE_TYPES = ["function", "endpoint", "call", "dbProcess", "event"]


def diagnostics(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, level, node): endpoints without a handler, functions that nothing calls, short names, files that couldn't be read."""
    fn, ep = all_nodes.where("type = 'function'"), all_nodes.where("type = 'endpoint'")
    entry = F.coalesce(F.col("meta")["decorators"], F.lit("")) != ""
    called = edges.where("kind = 'calls'").select(F.col("target").alias("id"))
    rule = lambda df, name, level: df.select(F.lit(name).alias("rule"), F.lit(level).alias("level"), F.col("id").alias("node"))
    out = rule(ep.join(edges.select(F.col("source").alias("id")), "id", "left_anti"), "endpoint.no_edge", "info")
    out = out.unionByName(rule(fn.where("kind <> 'constructor'").where(~entry).join(called, "id", "left_anti"), "function.unused", "warning"))
    out = out.unionByName(rule(fn.where(F.length(F.substring_index("name", ".", -1)) <= 2), "function.short_name", "warning"))
    return out.unionByName(rule(all_nodes.where("type = 'diagnostic'"), "file.unreadable", "warning"))


def cross_service(all_nodes: DataFrame) -> DataFrame:
    """External calls with the best endpoint of each other service that has their method and path, and its confidence."""
    from graphloom.functions.text import normalize_http_path

    calls = all_nodes.where("type = 'externalCall'").select(F.col("id").alias("call_id"), "service", F.col("kind").alias("method"), normalize_http_path(F.col("meta")["path"]).alias("path"), F.col("meta")["baseUrl"].alias("base"))
    n = lambda p: F.size(F.regexp_extract_all(p, F.lit(":param"), F.lit(0)))
    ends = all_nodes.where("type = 'endpoint'").select("id", "service", F.col("kind").alias("method"), normalize_http_path(F.col("meta")["path"]).alias("path"))
    groups = resolve.candidate_groups(calls.withColumn("n_params", n(F.col("path"))), ends.withColumn("n_params", n(F.col("path"))), F.col("base").contains(F.substring_index("target_service", "/", -1)))
    return groups.withColumnRenamed("best", "confidence")


def brokers_of(all_nodes: DataFrame) -> DataFrame:
    """(id, name, engine, alias) of the topics of events."""
    return all_nodes.where("type = 'event'").select(F.concat(F.lit("topic:"), "name").alias("id"), "name", F.lit("unknown").alias("engine"), F.col("name").alias("alias")).distinct()


#: Types of nodes that dependencies() reads.
DEPENDENCY_TYPES = ["dbProcess", "event", "externalCall", "endpoint"]


def dependencies(all_nodes: DataFrame) -> DataFrame:
    """(service, target, target_kind, call_kind, critical): databases and topics that services use, and services whose endpoints they call."""
    service = F.concat(F.lit("service:"), "service").alias("service")
    used = F.when(F.col("type") == "dbProcess", F.concat(F.lit("database:"), "service")).alias("database_id")
    uses = all_nodes.where("type in ('dbProcess', 'event')").select(service, "type", used, F.when(F.col("type") == "event", F.col("name")).alias("channel")).distinct()
    none = uses.select("service", F.lit(None).cast("string").alias("target")).where("false")
    calls = cross_service(all_nodes).where(F.col("confidence") >= resolve.CERTAIN).select(service, F.concat(F.lit("service:"), "target_service").alias("target")).distinct()
    known = resources.dependencies(uses, brokers_of(all_nodes).select("id", "alias"), none)
    return known.unionByName(calls.select("service", "target", F.lit("service").alias("target_kind"), F.lit("sync").alias("call_kind"), F.lit(True).alias("critical")))


def summary(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.groupBy("service", "type").agg(F.count(F.lit(1)).alias("n"))


def structural_edges(all_nodes: DataFrame) -> DataFrame:
    """imports and extends edges from the data nodes of files, with `service:` in front of services."""
    files = all_nodes.groupBy("service", "path").agg(F.min("ord").alias("ord")).select(F.col("path").alias("file"), F.col("service"), "ord")
    named = lambda c: F.concat(F.lit("service:"), c)
    modules = all_nodes.where("type = 'data' and kind = 'import'").select("service", F.coalesce(F.col("meta")["module"], F.regexp_extract("name", r"[\"']([^\"']+)[\"']", 1)).alias("module"))
    into = links.imports(modules.select(named(F.col("service")).alias("service"), "module"), files.select("file", named(F.col("service")).alias("service"), "ord"))
    f = all_nodes.where("type = 'function'").select("id", "kind", F.regexp_extract("name", r"^(.*)\.", 1).alias("class_name"), F.col("ord"))
    text = lambda k: F.when(F.coalesce(F.col("meta")[k], F.lit("")) != "", F.col("meta")[k])
    data = all_nodes.where("type = 'data' and kind <> 'import'").select("id", "name", F.split_part(text("extends"), F.lit(","), F.lit(1)).alias("super_class"), F.split(text("implements"), r"\s*,\s*").alias("implements"), "ord")
    return into.unionByName(links.inherits(data, f)).select("source", "target", "kind").distinct()


def topology(spark: SparkSession, root: str, save, skip_tests: bool = True, frontend: bool = True) -> dict[str, DataFrame]:
    """All tables of a repository, as operators.validate takes them, with `tree` (nodes by parent and depth), `diagnostics`, `error_paths` and `progress`."""
    return topology_of(scan.read_files(spark, root), save, root.rstrip("/").rpartition("/")[2], skip_tests, frontend)


def topology_of(files: DataFrame, save, title: str = "repository", skip_tests: bool = True, frontend: bool = True) -> dict[str, DataFrame]:
    """topology() of files(path, size, content); title: the name of a service that is the whole repository."""
    n = save(nested(save(nodes_of(files, skip_tests, frontend), "parsed")), "nodes")
    found = scan.boundaries(files)
    name = F.when(F.col("root") == "", F.lit(title)).otherwise(F.substring_index("root", "/", -1))
    ends = n.where("type = 'endpoint'").groupBy(F.col("service").alias("root")).agg(F.count(F.lit(1)).alias("endpoints"))
    stack = save(scan.stacks(files, found).select(F.col("service").alias("root"), "framework", "hints"), "stacks")
    s = found.join(ends, "root", "left").join(stack.drop("hints"), "root", "left")
    kind = enrich.service_kind(F.coalesce("framework", F.lit("unknown")), F.coalesce("endpoints", F.lit(0)), F.lit(0), F.lit(0))
    services = save(s.select(F.concat(F.lit("service:"), "root").alias("id"), name.alias("name"), kebab(name).alias("code"), kind.alias("kind"), "framework"), "services")
    meta = lambda k: F.col("meta")[k]
    service_id = F.concat(F.lit("service:"), "service").alias("service_id")
    endpoints = n.where("type = 'endpoint'").select("id", service_id, "name", F.col("kind").alias("method"), meta("path").alias("path"), F.col("path").alias("file"), "line", "end_line", "ord")
    kinds = F.when(F.col("kind") == "function", "declaration").otherwise(F.col("kind"))
    functions = n.where("type = 'function'").select("id", service_id, "name", kinds.alias("kind"), F.col("path").alias("file"), "line", "end_line", "ord")
    inner = n.where("type not in ('function', 'endpoint', 'diagnostic', 'data', 'table', 'column', 'screen', 'component') and parent_id is not null")
    handler = save(handlers(n), "handlers")
    inner = save(links.with_bodies(inner, handler, save), "inner")
    endpoints = endpoints.join(handler.withColumnRenamed("handler", "handler_fn_id"), "id", "left")
    # how many nodes hang below a node of flow control
    below = inner.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("branches"))
    used = F.when(F.col("type") == "dbProcess", F.concat(F.lit("database:"), "service"))
    code = inner.select("id", service_id, "type", "parent_id", "name", "kind", used.alias("database_id"), meta("operation").alias("operation"), F.when(F.col("type") == "externalCall", F.col("kind")).alias("method"), meta("path").alias("path"), F.when(F.col("type") == "event", F.col("name")).alias("event_name"), F.when(F.col("type") == "log", F.col("kind")).alias("level"), F.col("path").alias("file"), "line", "ord", meta("status").cast("int").alias("status"))
    code = code.withColumn("kind", F.when(F.col("type").isin("log", "event", "externalCall", "dbProcess"), F.lit(None)).otherwise(F.col("kind")))
    code = code.join(below, "id", "left").withColumn("branches", F.when(F.col("type") == "flowControl", F.coalesce("branches", F.lit(0))))
    code = code.join(resolved_calls(n).select("id", "resolved_to"), "id", "left")
    # the engine that a service's manifests name, if it is one
    named = F.filter("hints", lambda h: h["kind"] == "database")
    engine = stack.select(F.concat(F.lit("service:"), "root").alias("id"), F.when(F.size(named) == 1, named[0]["engine"]).alias("engine"))
    engines = services.join(engine, "id", "left").select(F.concat(F.lit("database:"), F.substring("id", 9, 1 << 20)).alias("id"), "name", F.coalesce("engine", F.lit("unknown")).alias("engine"), F.col("code").alias("alias"))
    databases = engines.join(code.select(F.col("database_id").alias("id")).distinct(), "id", "left_semi")
    brokers = brokers_of(n)
    e = derived_edges(n).unionByName(structural_edges(n)).distinct()
    edges = save(e.join(edge_facts(n), ["source", "target", "kind"], "left"), "edges")
    out = {"services": services, "endpoints": save(endpoints, "endpoints"), "functions": save(functions, "functions"), "nodes": save(code, "code"), "edges": edges, "databases": databases, "brokers": brokers}
    out["diagnostics"] = validate.validate(out, save).unionByName(diagnostics(n, edges).where("rule in ('function.unused', 'file.unreadable')").select("level", "rule", F.lit(None).cast("string").alias("check"), "node", F.col("rule").alias("message")))
    out["error_paths"] = errors.error_paths(n.where("type in ('throw', 'flowControl')").select("service", F.col("path").alias("file"), "line", "ord", "id", "type", "kind", "name", meta("status").cast("int").alias("status")))
    out["progress"] = enrich.progress(n)
    out["screens"] = n.where("type = 'screen'").select("id", service_id, "name", F.col("path").alias("file"), meta("route").alias("route"), F.split(meta("references"), ",").alias("references"))
    out["components"] = n.where("type = 'component'").select("id", service_id, "name", "kind", "ord")
    out["screen_components"] = links.components(out["screens"], out["components"])
    facts = n.where("type in ('table', 'column')")
    flag = lambda k: F.coalesce(meta(k) == "true", F.lit(False)).alias
    place = F.concat_ws("|", "path", F.lpad(F.col("ord").cast("string"), 9, "0")).alias("ord")
    t = facts.where("type = 'table'").select("id", F.concat(F.lit("database:"), "service").alias("alias"), "name", meta("entity").alias("entity_name"), flag("hasTimestamps")("has_timestamps"), flag("hasSoftDelete")("has_soft_delete"), place)
    first = t.groupBy("alias", F.lower("name").alias("key")).agg(F.min_by("id", "ord").alias("id"))
    tables = save(resources.merge_tables(t).join(first, ["alias", "key"]), "tables")
    out["tables"] = tables.select("id", F.col("alias").alias("database_id"), "name", "entity_name", "has_timestamps", "has_soft_delete")
    owner = t.select("alias", F.col("entity_name").alias("entity"), F.lower("name").alias("table")).distinct()
    c = facts.where("type = 'column'").select(F.concat(F.lit("database:"), "service").alias("alias"), meta("entity").alias("entity"), "name", F.col("kind").alias("type"), (meta("primaryKey") == "true").alias("primary_key"), F.lit("declared").alias("source_kind"), place)
    merged = resources.merge_columns(c.join(owner, ["alias", "entity"]))
    out["columns"] = merged.join(tables.select("alias", "key", F.col("id").alias("table_id")), ["alias", "key"]).select("table_id", "name", "type", "primary_key")
    out["dependencies"] = save(dependencies(n), "dependencies")
    top = n.where("type in ('endpoint', 'function')").select("id", F.lit(None).cast("string").alias("parent_id"), service_id, "ord", "type", "name", "kind", "line", "end_line", F.col("meta").alias("metadata"))
    rest = inner.select("id", "parent_id", service_id, "ord", "type", "name", "kind", "line", "end_line", F.col("meta").alias("metadata"))
    both = top.unionByName(rest)
    out["tree"] = save(tree.roots(both, save).where("depth is not null").drop("root_id"), "tree")
    return out
