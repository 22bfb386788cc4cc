"""Databases, brokers and dependencies of services: merging what several files say, hints, and ecosystems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import first_per


def merge_tables(tables: DataFrame) -> DataFrame:
    """(alias, key, name, entity_name, has_timestamps, has_soft_delete) of tables(alias, name, entity_name, has_timestamps, has_soft_delete, ord): one row for each alias and name in any case. The first name and the first entity name stay; flags hold if one does."""
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct("ord", c)))[c].alias(c)
    flag = lambda c: F.coalesce(F.max(c), F.lit(False)).alias(c)
    return tables.groupBy("alias", F.lower("name").alias("key")).agg(first("name"), first("entity_name"), flag("has_timestamps"), flag("has_soft_delete"))


def merge_columns(columns: DataFrame) -> DataFrame:
    """columns(alias, table, name, source_kind, ord, ...): one row for each alias, table in any case, and column: the first that isn't inferred, else the first."""
    rows = columns.withColumn("key", F.lower("table")).withColumn("_weak", (F.col("source_kind") == "inferred").cast("int"))
    return first_per(rows, ["alias", "key", "name"], ["_weak", "ord"]).drop("_weak")


def merge_topics(uses: DataFrame) -> DataFrame:
    """(alias, topic, role, service): uses(alias, topic, role, service) without repeats. One row a member, so that no list grows with its topic."""
    return uses.select("alias", "topic", "role", "service").distinct()


def topic_lists(members: DataFrame) -> DataFrame:
    """(alias, topic, producers, consumers): the lists of merge_topics(), sorted, for output."""
    role = lambda r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("service"))))
    return members.groupBy("alias", "topic").agg(role("produce").alias("producers"), role("consume").alias("consumers"))


def with_hints(found: DataFrame, hints: DataFrame) -> DataFrame:
    """found(alias, engine, category) and those hints(alias, engine, category) whose alias isn't there, one of each."""
    more = hints.dropDuplicates(["alias"]).join(found.select("alias"), "alias", "left_anti")
    return found.unionByName(more.select(*found.columns))


def dependencies(nodes: DataFrame, brokers: DataFrame, known: DataFrame) -> DataFrame:
    """New rows (service, target, target_kind, call_kind, critical): databases that a service's nodes(service, type, database_id, channel) use, brokers(id, alias) of its events' channels, but what is known(service, target)."""
    db = nodes.where("type = 'dbProcess' and database_id is not null").select("service", F.col("database_id").alias("target"), F.lit("database").alias("target_kind"), F.lit("sync").alias("call_kind"), F.lit(True).alias("critical"))
    ev = nodes.where("type = 'event' and channel is not null").select("service", F.col("channel").alias("alias")).distinct().join(brokers.select("alias", F.col("id").alias("target")), "alias")
    ev = ev.select("service", "target", F.lit("broker").alias("target_kind"), F.lit("async").alias("call_kind"), F.lit(False).alias("critical"))
    return db.distinct().unionByName(ev.distinct()).join(known.select("service", "target"), ["service", "target"], "left_anti")


def resolved_dependencies(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(service, target, via): of resolved calls(service, id, endpoint_id) with endpoints(id, service): each pair of services with the calls between them, sorted; no service depends on itself."""
    hit = calls.join(endpoints.select(F.col("id").alias("endpoint_id"), F.col("service").alias("target")), "endpoint_id").where("service <> target")
    return hit.groupBy("service", "target").agg(F.array_sort(F.collect_set("id")).alias("via"))


def used_columns(operations: DataFrame) -> DataFrame:
    """(service, column_id): distinct columns of operations(service, column_ids)."""
    return operations.select("service", F.explode("column_ids").alias("column_id")).distinct()


def link_columns(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """(op_id, target, kind): fields(op_id, table_id, field) to columns(id, table_id, name) of the same name in any case; an operation of which no field is a column is linked with its table.

    Fields and columns are made distinct before they meet, and what has no column is
    told by names alone: links themselves, which may be many more than both, aren't
    shuffled, but those of columns that have several names or tables.
    """
    f = fields.select("op_id", "table_id", F.lower("field").alias("key")).distinct()
    c = columns.select("table_id", F.lower("name").alias("key"), F.col("id").alias("column_id")).where("table_id is not null and key is not null and column_id is not null").distinct()
    often = c.groupBy("column_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("column_id")
    link = lambda some: f.join(some, ["table_id", "key"]).select("op_id", F.col("column_id").alias("target"), F.lit("column").alias("kind"))
    names = c.select("table_id", "key").distinct().withColumn("_is", F.lit(True))
    # tables of an operation, and whether a field of any of them is a column
    known = f.join(names, ["table_id", "key"], "left").groupBy("op_id", "table_id").agg(F.bool_or(F.col("_is").isNotNull()).alias("_is"))
    some = known.where("_is").select("op_id")
    none = known.where("not _is").join(some, "op_id", "left_anti").select("op_id", F.col("table_id").alias("target"), F.lit("table").alias("kind"))
    return link(c.join(often, "column_id", "left_anti")).unionByName(link(c.join(often, "column_id", "left_semi")).distinct()).unionByName(none)


def column_nodes(columns: DataFrame) -> DataFrame:
    """columns(table_id, name, type, nullable, unique, primary_key, ref_table, ref_column) as nodes: ids, defaults, and the foreign key as text."""
    fk = F.when(F.col("ref_table").isNotNull(), F.concat("ref_table", F.lit("."), F.coalesce("ref_column", F.lit("id"))))
    yes = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return columns.select(F.concat(F.lit("column:"), F.left(F.sha1(F.concat_ws(":", "table_id", "name")), F.lit(8))).alias("id"), "table_id", "name", F.coalesce("type", F.lit("unknown")).alias("type"), yes("nullable", True), yes("unique", False), yes("primary_key", False), fk.alias("foreign_key"))


def ecosystem(services: DataFrame, databases: DataFrame, endpoints: DataFrame, dependencies_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An ecosystem's services(id, name, endpoint_count), databases(id, name, engine, connection_count) and edges(source, target, kind), from topologies' tables. Databases are counted by the services that depend on them."""
    n = endpoints.groupBy(F.col("service_id").alias("id")).agg(F.count(F.lit(1)).alias("endpoint_count"))
    s = services.join(n, "id", "left").select("id", "name", F.coalesce("endpoint_count", F.lit(0)).cast("long").alias("endpoint_count"))
    d = dependencies_.where("target_kind = 'database'").groupBy(F.col("target").alias("id")).agg(F.countDistinct("service").alias("connection_count"))
    db = databases.join(d, "id", "left").select("id", "name", "engine", F.coalesce("connection_count", F.lit(0)).cast("long").alias("connection_count"))
    return s, db, dependencies_.select(F.col("service").alias("source"), "target", F.col("target_kind").alias("kind")).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new hasn't."""
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and of new those whose keys old hasn't, one of each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def remove_service(services: DataFrame, databases: DataFrame, edges: DataFrame, id_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays without a service: databases(id, file) whose file contains its id go, and edges that touch it."""
    return services.where(F.col("id") != id_), databases.where(~F.coalesce(F.col("file").contains(id_), F.lit(False))), edges.where((F.col("source") != id_) & (F.col("target") != id_))
