"""Where errors go: the catch after each throw, handlers of all errors, and what an endpoint answers and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import closure, nest

def error_paths(nodes: DataFrame, nearest: bool = False) -> DataFrame:
    """(node, error_class, file, handled, handler, status) of every throw of nodes(service, file, line, ord, id, type, kind, name, status)."""
    keys = ["service", "file"]
    throws = nodes.where("type = 'throw'").select(*keys, F.col("line").alias("at"), F.col("id").alias("throw_id"))
    catches = nodes.where("type = 'flowControl' and kind = 'catch'").select(*keys, F.col("line").alias("at"), "ord", F.col("id").alias("catch_id"))
    found = nest.handlers(throws.dropDuplicates(["throw_id"]), catches, keys, nearest)
    own = nodes.where("type = 'throw'").select(F.col("id").alias("throw_id"), F.col("name").alias("error_class"), "file", "status").dropDuplicates(["throw_id"])
    out = own.join(found, "throw_id", "left")
    return out.select(F.col("throw_id").alias("node"), "error_class", "file", F.col("catch_id").isNotNull().alias("handled"), F.col("catch_id").alias("handler"), "status")


def global_handlers(functions: DataFrame) -> DataFrame:
    """(node, status) of functions(id, decorators array, params array, raw) that handle all errors: by their decorators, or four parameters of which the first is an error."""
    decorated = F.exists("decorators", lambda d: d.rlike("(?i)ExceptionFilter|Catch"))
    middleware = (F.size("params") == 4) & F.get("params", F.lit(0)).rlike("(?i)^err")
    status = F.regexp_extract(F.coalesce("raw", F.lit("")), r"status\((\d{3})\)", 1)
    return functions.where(F.coalesce(decorated, F.lit(False)) | F.coalesce(middleware, F.lit(False))).select(F.col("id").alias("node"), F.when(status != "", status.cast("int")).otherwise(F.lit(500)).alias("status"))


def reached(endpoints: DataFrame, calls: DataFrame, save, most: int | None = None) -> DataFrame:
    """(endpoint, node, depth): what endpoints(id) reach by calls(source, target), themselves too."""
    return closure.reach(endpoints.select("id"), calls.select("source", "target").distinct(), save, most).select(F.col("root").alias("endpoint"), "node", "depth")


def responses(reach: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(endpoint, status, outcome, type): of outcomes(owner, id, type, status, ord) in what an endpoint reaches, the first of each status, nearest first; by status. A return without status is 200, a throw 500."""
    status = F.coalesce(F.col("status"), F.when(F.col("type") == "return", 200).otherwise(500))
    hit = reach.join(outcomes.where("type in ('return', 'throw')").withColumnRenamed("owner", "node"), "node")
    first = hit.groupBy("endpoint", status.alias("status")).agg(F.min(F.struct("depth", "ord", "id", "type")).alias("f"))
    return first.select("endpoint", "status", F.col("f.id").alias("outcome"), F.col("f.type").alias("type"))


def uses(reach: DataFrame, operations: DataFrame) -> DataFrame:
    """(endpoint, table, operations): of operations(owner, table, operation) in what an endpoint reaches, each table's distinct operations, sorted."""
    hit = reach.join(operations.withColumnRenamed("owner", "node"), "node").select("endpoint", "table", "operation").distinct()
    return hit.groupBy("endpoint", "table").agg(F.array_sort(F.collect_set("operation")).alias("operations"))  # operations are few kinds


def unresolved(reach: DataFrame, calls: DataFrame) -> DataFrame:
    """(endpoint, callee): calls(owner, callee, resolved_to) without a target, with a dot, not on `this`."""
    lost = calls.where(F.col("resolved_to").isNull() & F.col("callee").contains(".") & ~F.col("callee").startswith("this."))
    return reach.join(lost.withColumnRenamed("owner", "node"), "node").select("endpoint", "callee").distinct()


def coverage(endpoints: DataFrame, functions: DataFrame, children: DataFrame) -> DataFrame:
    """One row of counters. endpoints(id, service_id), functions(id, service_id, decorators), children(parent_id, type, level): direct children only. All endpoints of a service that has a decorated span or trace count as traced."""
    traced = functions.where(F.exists("decorators", lambda d: d.rlike("(?i)span|trace"))).select("service_id").distinct().withColumn("traced", F.lit(1))
    e = endpoints.join(traced, "service_id", "left").agg(F.count(F.lit(1)).alias("endpoints_total"), F.count("traced").alias("endpoints_with_tracing"))
    own = children.join(functions.select(F.col("id").alias("parent_id")), "parent_id")
    count = lambda c: F.count(F.when(c, 1))
    rest = own.agg(count(F.col("type") == "dbProcess").alias("db_queries_total"), F.lit(0).cast("long").alias("db_queries_with_spans"), count(F.col("type") == "throw").alias("errors_total"), count((F.col("type") == "log") & (F.col("level") == "error")).alias("errors_with_logging"))
    return e.crossJoin(rest)  # one row each


#: Kinds of flow control that branch.
DECISIONS = ["if", "else_if", "switch", "case", "for", "for_of", "for_in", "while", "do_while", "catch", "ternary", "nullish_coalescing"]


def metrics(functions: DataFrame, below: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lines, cyclomatic, performs_io, throws_unhandled) of functions(id, line, end_line). below(ancestor, id): all pairs. nodes(id, parent_id, type, kind, line, end_line, awaited).

    throws_unhandled: an awaited call outside every try that is the function's own child.
    """
    inside = below.select(F.col("ancestor").alias("fn"), "id").join(nodes, "id")
    decides = (F.col("type") == "flowControl") & F.col("kind").isin(DECISIONS)
    awaits = (F.col("type") == "call") & F.coalesce(F.col("awaited"), F.lit(False))
    n = inside.groupBy("fn").agg(F.count(F.when(decides, 1)).alias("n"), F.max(awaits).alias("io"))
    tries = nodes.where("type = 'flowControl' and kind = 'try'").select(F.col("parent_id").alias("fn2"), F.col("line").alias("low"), F.coalesce("end_line", "line").alias("high"))
    bare = inside.where(awaits).join(tries, (F.col("fn") == F.col("fn2")) & F.col("line").between(F.col("low"), F.col("high")), "left_anti").select("fn").distinct().withColumn("bare", F.lit(True))
    f = functions.select("id", (F.coalesce("end_line", "line") - F.col("line")).alias("lines"))
    out = f.join(n, F.col("id") == F.col("fn"), "left").drop("fn").join(bare, F.col("id") == F.col("fn"), "left")
    no = F.lit(False)
    return out.select("id", "lines", (F.coalesce("n", F.lit(0)) + 1).alias("cyclomatic"), F.coalesce("io", no).alias("performs_io"), F.coalesce("bare", no).alias("throws_unhandled"))
