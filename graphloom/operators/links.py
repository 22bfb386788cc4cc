"""Structural edges: dependencies, imports, constructors, inheritance, resolved calls, components of screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree
from .resolve import last_wins

#: Types that no constructor has, in lower case.
PRIMITIVES = ["string", "number", "boolean", "any", "unknown", "void", "never", "null", "undefined", "object", "symbol", "bigint"]
EXTENSION = r"\.(ts|js|tsx|jsx)$"


def _edge(df: DataFrame, source: Column, target: Column, label: str, /, **meta: Column) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(source.alias("source"), target.alias("target"), F.lit(label).alias("kind"), (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("meta"))


def depends_on(dependencies: DataFrame) -> DataFrame:
    """An edge for each of dependencies(service, target, call_kind, protocol, critical)."""
    return _edge(dependencies, F.col("service"), F.col("target"), "depends_on", kind=F.col("call_kind"), protocol=F.col("protocol"), critical=F.col("critical"))


def suffixes(path: Column) -> Column:
    """All ends of a path without extension that start at a folder or file name."""
    parts = F.split(F.regexp_replace(path, EXTENSION, ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))


def imports(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of modules(service, module): a relative one, cut of leading ./ and ../ and its extension, goes to the service of the first of files(file, service, ord) that ends with it, whole names only; others, and those that no file matches, to the module itself.

    Files are exploded to their ends, so that it is a join on equal values.
    """
    m = modules.where(F.coalesce("module", F.lit("")) != "").select("service", "module").distinct()
    end = F.regexp_replace(F.regexp_replace("module", r"^(\.{1,2}/)+", ""), EXTENSION, "")
    ends = files.select(F.explode(suffixes(F.col("file"))).alias("end"), "service", "ord")
    first = ends.groupBy("end").agg(F.min(F.struct("ord", "service")).alias("f")).select("end", F.col("f.service").alias("target"))
    hit = m.withColumn("end", F.when(F.col("module").startswith("."), end)).join(first, "end", "left")
    return _edge(hit, F.col("service"), F.coalesce("target", "module"), "imports", modulePath=F.col("module"))


def constructors(functions: DataFrame) -> DataFrame:
    """(class_name, id) of functions(id, kind, class_name, ord): the last constructor of each class."""
    return last_wins(functions.where("kind = 'constructor' and class_name is not null"), "class_name")


def injected(functions: DataFrame) -> DataFrame:
    """Edges between constructors: from functions(id, kind, class_name, ord, params array<struct<name, type>>) to the constructor of a parameter's base type (what precedes its generics), but itself."""
    p = functions.where("kind = 'constructor'").select("id", F.explode("params").alias("p"))
    p = p.withColumn("base", F.regexp_extract("p.type", r"^([A-Z][a-zA-Z0-9]*)", 1)).where((F.col("base") != "") & ~F.lower("base").isin(PRIMITIVES))
    hit = p.join(constructors(functions).select(F.col("class_name").alias("base"), F.col("id").alias("target")), "base").where("id <> target")
    return _edge(hit, F.col("id"), F.col("target"), "depends_on", paramName=F.col("p.name"), typeName=F.col("base"))


def inherits(data: DataFrame, functions: DataFrame) -> DataFrame:
    """`extends` edges of data(id, name, super_class, implements array, ord) to the last data of that name, else the constructor of such a class; `uses` edges to the interfaces."""
    named = last_wins(data, "name").select(F.col("name").alias("wanted"), F.col("id").alias("data_id"))
    built = constructors(functions).select(F.col("class_name").alias("wanted"), F.col("id").alias("built_id"))
    up = data.where("super_class is not null").select("id", F.col("super_class").alias("wanted")).join(named, "wanted", "left").join(built, "wanted", "left")
    up = up.withColumn("target", F.coalesce("data_id", "built_id")).where("target is not null")
    faces = data.select("id", F.explode("implements").alias("wanted")).join(named, "wanted")
    return _edge(up, F.col("id"), F.col("target"), "extends").unionByName(_edge(faces, F.col("id"), F.col("data_id"), "uses"))


def resolved_calls(calls: DataFrame) -> DataFrame:
    """`resolves_to` edges of external calls(id, container_id, status, endpoint_id, confidence, reason, target_service) that are resolved, from their container, else the call."""
    hit = calls.where("status = 'resolved' and endpoint_id is not null")
    return _edge(hit, F.coalesce("container_id", "id"), F.col("endpoint_id"), "resolves_to", confidence=F.col("confidence"), reason=F.col("reason"), targetServiceId=F.col("target_service"))


def components(screens: DataFrame, found: DataFrame) -> DataFrame:
    """(screen, component): screens(id, references array) with the first of found(id, name, ord) of each name that isn't attached to an earlier place of the screen already."""
    first = found.groupBy("name").agg(F.min(F.struct("ord", "id")).alias("f")).select("name", F.col("f.id").alias("component"))
    refs = screens.select(F.col("id").alias("screen"), F.explode("references").alias("name"))
    return refs.distinct().join(first, "name").select("screen", "component").distinct()


def caller_service(containers: DataFrame) -> DataFrame:
    """(file, service): the first service that has a function or endpoint in a file, of containers(file, service, ord)."""
    return containers.groupBy("file").agg(F.min(F.struct("ord", "service")).alias("f")).select("file", F.col("f.service").alias("service"))


def neighbours(edges: DataFrame, things: DataFrame) -> DataFrame:
    """(source, id, name, kind): services and databases, things(id, name), that each source has an edge to."""
    return edges.select("source", F.col("target").alias("id"), "kind").distinct().join(things.select("id", "name"), "id").select("source", "id", "name", "kind")


def drawn_dependencies(services: DataFrame, dependencies: DataFrame, databases: DataFrame, brokers: DataFrame) -> DataFrame:
    """(service, target, target_kind) of dependencies(service, target), as database, else broker. A service without any has one row with a null target, which stands for all resources: they aren't listed for each service."""
    kinds = databases.select(F.col("id").alias("target"), F.lit("database").alias("target_kind")).unionByName(brokers.select(F.col("id").alias("target"), F.lit("broker").alias("target_kind")))
    first = kinds.groupBy("target").agg(F.max("target_kind").alias("target_kind"))  # a database before a broker, by name
    hit = dependencies.select("service", "target").distinct().join(first, "target")
    return services.select(F.col("id").alias("service")).join(hit, "service", "left").select("service", "target", "target_kind")


def handlers_of(routes: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, handler): of routes(id, resolved_to, arguments array) what they are resolved to, else the first of functions(id, name, ord) that the last dotted argument ends in, by its last part."""
    dotted = F.filter("arguments", lambda a: a.contains("."))
    last = F.substring_index(F.element_at(dotted, -1), ".", -1)
    r = routes.withColumn("tail", F.when(F.col("resolved_to").isNull() & (F.size(dotted) > 0), last))
    f = functions.groupBy(F.substring_index("name", ".", -1).alias("tail")).agg(F.min(F.struct("ord", "id"))["id"].alias("f_id"))
    return r.join(f, "tail", "left").select("id", F.coalesce("resolved_to", "f_id").alias("handler"))


def endpoint_handlers(endpoints: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, handler): for endpoints(id, service, name) the first of functions(id, service, name, path, ord) of the service that has the endpoint's name or ends in its last part; endpoints without one have no row."""
    tail = F.substring_index("name", ".", -1).alias("tail")
    f = functions.groupBy("service", tail).agg(F.min(F.struct("path", "ord", "id"))["id"].alias("handler"))
    return endpoints.select("id", "service", tail).join(f, ["service", "tail"]).select("id", "handler")


#: Children that make an endpoint's body one of its own.
BODY = ["flowControl", "return", "throw", "dbProcess", "externalCall"]


def with_bodies(inner: DataFrame, handlers: DataFrame, save) -> DataFrame:
    """inner(id, parent_id, type, ...), nodes below endpoints and functions: an endpoint of handlers(id, handler) without a body of its own gets copies of all that is below its handler, in place of what it has. Copies have the endpoint's id before their own."""
    own = inner.where(F.col("type").isin(BODY)).select(F.col("parent_id").alias("id"))
    bare = save(handlers.join(own, "id", "left_anti"), "bare")
    tops = inner.select(F.col("parent_id").alias("id")).distinct().join(inner.select("id"), "id", "left_anti").withColumn("parent_id", F.lit(None).cast("string"))
    roots = save(tree.roots(inner.select("id", "parent_id").unionByName(tops), save).where("parent_id is not null").select("id", "root_id"), "roots")
    body = inner.join(roots, "id").join(bare.select(F.col("id").alias("_endpoint"), F.col("handler").alias("root_id")), "root_id")
    named = lambda c: F.concat("_endpoint", F.lit("/"), c)
    copies = body.withColumn("parent_id", F.when(F.col("parent_id") == F.col("root_id"), F.col("_endpoint")).otherwise(named(F.col("parent_id")))).withColumn("id", named(F.col("id"))).select(*inner.columns)
    # an endpoint whose handler has nothing below keeps what it has
    filled = body.select(F.col("_endpoint").alias("root_id")).distinct()
    kept = inner.join(roots.join(filled, "root_id", "left_semi").select("id"), "id", "left_anti")
    return kept.select(*inner.columns).unionByName(copies)


def owner_of(endpoints: DataFrame, services: DataFrame) -> DataFrame:
    """(id, service, name): the service of each endpoint."""
    return endpoints.select("id", F.col("service_id").alias("service")).join(services.select(F.col("id").alias("service"), "name"), "service").select("id", "service", "name")
