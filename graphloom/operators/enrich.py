"""What is worked out beside a graph: types, shapes, kinds, filters of views, and hooks for models that judge or describe.

A model is a function from a DataFrame to a DataFrame; the defaults here are
plain rules, so that all runs without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tree

Model = Callable[[DataFrame], DataFrame]

#: Types that aren't looked up; ranks of log levels; node kinds that a flow view leaves out.
PRIMITIVES = ["string", "number", "boolean", "any", "void", "null", "undefined", "unknown", "never", "object", "Date"]
LEVEL_RANK = {"trace": 0, "debug": 1, "info": 2, "log": 2, "warn": 3, "error": 4, "fatal": 5}
UNSEEN = ["log", "telemetry", "event", "data"]


def base_type(name: Column) -> Column:
    """A type's name without one generic around it, `?` and `[]`; null for primitives."""
    bare = F.regexp_replace(name, r"(\[\]|\?|\s)", "")
    inner = F.regexp_extract(bare, r"^\w+<(.+)>$", 1)
    out = F.when(inner != "", inner).otherwise(bare)
    return F.when(~out.isin(PRIMITIVES) & (out != ""), out)


def type_fields(types: DataFrame, index: DataFrame, levels: int = 3) -> DataFrame:
    """(id, path, type): fields of the types of types(id, type), and of their fields' types, to `levels` levels; index(name, field, type, ord), of which the last of equal (name, field) counts. A type isn't opened again below itself."""
    last = index.groupBy("name", "field").agg(F.max(F.struct("ord", "type"))["type"].alias("f_type"))
    level = types.select("id", F.lit("").alias("path"), base_type(F.col("type")).alias("name"), F.array().cast("array<string>").alias("seen"))
    out = None
    for _ in range(levels):
        hit = level.where(F.col("name").isNotNull() & ~F.array_contains("seen", F.col("name"))).join(last, "name")
        hit = hit.select("id", F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "field").alias("path"), "f_type", F.array_append("seen", F.col("name")).alias("seen"))
        rows = hit.select("id", "path", F.col("f_type").alias("type"))
        out = rows if out is None else out.unionByName(rows)
        level = hit.select("id", "path", base_type(F.col("f_type")).alias("name"), "seen")
    return out


def return_shape(text: Column) -> Column:
    """Keys of an object literal's text, one a line or after commas: `key: value` or `key`; words of the language aren't keys."""
    inner = F.regexp_extract(text, r"(?s)\{(.*)\}", 1)
    parts = F.transform(F.split(inner, r"[,\n]"), lambda p: F.regexp_extract(F.trim(p), r"^[\"']?([A-Za-z_$][\w$]*)[\"']?\s*(?::|$)", 1))
    return F.array_distinct(F.filter(parts, lambda k: (k != "") & ~k.isin("return", "const", "let", "var", "if", "else", "new", "await", "async", "function")))


#: Words that are no field of a returned object.
RESERVED = ["return", "true", "false", "null", "undefined", "new", "this"]


def return_fields(returns: DataFrame, variables: DataFrame) -> DataFrame:
    """(fn_id, position, name, type): fields of the object that each function returns, in order, from returns(fn_id, ord, value) and local variables(fn_id, ord, name, type).

    Of a function's returns the first whose text is an object with fields counts. A
    line `name: value` or `name` is a field, the first of equal names; its type is
    that of the local variable of its name, the last of equal ones, else `unknown`.
    """
    whole = returns.where(F.ltrim("value").startswith("{") & F.col("value").contains("}"))
    line = whole.select("fn_id", "ord", F.posexplode(F.split("value", "\n")).alias("position", "line"))
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s*,$", "")
    line = line.withColumn("name", F.regexp_extract(bare, r"^(\w+)\s*(?::|$)", 1)).where((F.col("name") != "") & ~F.col("name").isin(RESERVED))
    first = line.groupBy("fn_id").agg(F.min("ord").alias("ord"))
    fields = line.join(first, ["fn_id", "ord"]).groupBy("fn_id", "name").agg(F.min("position").alias("position"))
    known = variables.where(F.coalesce("type", F.lit("")) != "").groupBy("fn_id", "name").agg(F.max_by("type", "ord").alias("type"))
    return fields.join(known, ["fn_id", "name"], "left").select("fn_id", "position", "name", F.coalesce("type", F.lit("unknown")).alias("type"))


def protocol(framework: Column) -> Column:
    return F.when(framework.rlike("(?i)graphql|apollo"), "graphql").when(framework.rlike("(?i)grpc"), "grpc").otherwise("rest")


def service_kind(framework: Column, endpoints: Column, screens: Column, consumers: Column) -> Column:
    """frontend with screens and no endpoints; worker with consumers and no endpoints; else backend."""
    ui = framework.rlike("(?i)react|vue|angular|svelte|next") | (screens > 0)
    return F.when(ui & (endpoints == 0), "frontend").when((consumers > 0) & (endpoints == 0), "worker").otherwise("backend")


def is_global(scope: Column) -> Column:
    return F.coalesce(scope.isin("module", "global"), F.lit(False))


def shown(nodes: DataFrame) -> DataFrame:
    """What a flow view shows."""
    return nodes.where(~F.col("type").isin(UNSEEN))


def at_least(logs: DataFrame, level: str) -> DataFrame:
    """Logs of a level or above."""
    rank = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    return logs.where(F.element_at(rank, F.col("level")) >= LEVEL_RANK[level])


def screens_of(screens: DataFrame, service: str) -> DataFrame:
    """Screens of a service, and those of none."""
    return screens.where(F.col("service_id").isNull() | (F.col("service_id") == service))


def enrichable(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions that aren't constructors and have children."""
    return functions.where(F.coalesce("kind", F.lit("")) != "constructor").join(nodes.select(F.col("parent_id").alias("id")), "id", "left_semi")


def waiting(calls: DataFrame, status: str = "pending_review") -> DataFrame:
    return calls.where(F.col("status") == status)


def progress(nodes: DataFrame) -> DataFrame:
    """One row: files, endpoints, functions, database operations, events, external calls."""
    n = lambda t: F.count(F.when(F.col("type") == t, 1))
    return nodes.agg(F.countDistinct("service", "path").alias("files"), *[n(t).alias(c) for t, c in (("endpoint", "endpoints"), ("function", "functions"), ("dbProcess", "db_operations"), ("event", "events"), ("externalCall", "external_calls"))])


def io_counts(nodes: DataFrame) -> DataFrame:
    """(service, db_calls, external_calls)."""
    return nodes.groupBy("service").agg(F.count(F.when(F.col("type") == "dbProcess", 1)).alias("db_calls"), F.count(F.when(F.col("type") == "externalCall", 1)).alias("external_calls"))


def mean_score(scores: DataFrame) -> DataFrame:
    """One row: the rounded mean of scores(score); 100 without any."""
    return scores.agg(F.coalesce(F.round(F.avg("score")), F.lit(100.0)).cast("long").alias("score"))


def has_io(below: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, db_operations, external_calls, has_io) of every ancestor of below(ancestor, id)."""
    x = below.join(nodes.select("id", "type"), "id").groupBy(F.col("ancestor").alias("id"))
    out = x.agg(F.count(F.when(F.col("type") == "dbProcess", 1)).alias("db_operations"), F.count(F.when(F.col("type") == "externalCall", 1)).alias("external_calls"))
    return out.withColumn("has_io", (F.col("db_operations") > 0) | (F.col("external_calls") > 0))


def logs_and_telemetry(nodes: DataFrame) -> DataFrame:
    """One row a node, however its parents share it."""
    return nodes.where("type in ('log', 'telemetry')").dropDuplicates(["id"])


def flow_text(nodes: DataFrame, save, most: int = 30) -> DataFrame:
    """(root, text): the first `most` nodes below each root in pre-order, indented by depth. nodes(id, parent_id, ord, type, name)."""
    p = tree.tour(nodes, save).where(F.col("position").between(1, most))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "type", F.lit(" "), F.coalesce("name", F.lit("")))
    p = p.withColumnRenamed("root_id", "root").withColumnRenamed("position", "_n")
    return p.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def batches(rows: DataFrame, key: str, order: list[str], size: int = 8) -> DataFrame:
    """rows with `batch`: every `size` of a key, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def describe(items: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, description) of items(id, text): what the model says, or the first sentence of the text."""
    if model is not None:
        return model(items)
    return items.select("id", F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([^.!?\n]*[.!?]?)", 1).alias("description"))


def judge(flows: DataFrame, model: Model | None = None) -> DataFrame:
    """(root, score) of flows(root, text): what the model says, within 0 to 100; without one, 100 less 25 for a flow without a return or throw."""
    from graphloom.functions.text import clamp_score

    if model is not None:
        return model(flows).select("root", clamp_score(F.col("score")).alias("score"))
    return flows.select("root", (F.lit(100.0) - F.when(F.col("text").rlike(r"(?m)^\s*(return|throw)\b"), 0.0).otherwise(25.0)).alias("score"))
