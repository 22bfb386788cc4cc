"""Catalogue queries on graph tables: operators over the stand-in topology, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import enrich, errors, links, resources, scc, tree, validate
from graphloom.plans import stand_in as S
from graphloom.plans.catalogue import STEPS, query, supplier_steps
from graphloom.saved import Saved
from graphloom.sinks import topology

FIELD_SQL = f"""
WITH {S.SQL}, found AS (
  SELECT 'VL-1' AS "check", 'error' AS level, 'metadata.engine' AS rule, id AS node FROM databases WHERE engine IS NULL
  UNION ALL SELECT 'VL-1', 'error', 'metadata.connectionAlias', id FROM databases WHERE alias IS NULL
  UNION ALL SELECT 'VL-2', 'error', 'id', NULL FROM brokers WHERE id IS NULL
  UNION ALL SELECT 'VL-2', 'warning', 'name', id FROM brokers WHERE name IS NULL AND id IS NOT NULL
  UNION ALL SELECT 'VL-3', 'warning', 'name', id FROM screens WHERE name IS NULL
  UNION ALL SELECT 'VL-3', 'warning', 'metadata.filePath', id FROM screens WHERE file IS NULL
  UNION ALL SELECT 'VL-4', 'error', 'name', id FROM services WHERE name IS NULL
  UNION ALL SELECT 'VL-4', 'warning', 'code', id FROM services WHERE code IS NULL
  UNION ALL SELECT 'VL-6', 'error', 'metadata.method', id FROM endpoints WHERE method IS NULL
  UNION ALL SELECT 'VL-6', 'error', 'metadata.method', id FROM endpoints WHERE method = 'FETCH'
  UNION ALL SELECT 'VL-6', 'error', 'metadata.path', id FROM endpoints WHERE path IS NULL
  UNION ALL SELECT 'VL-7', 'warning', 'metadata.kind', id FROM functions WHERE kind = 'lambda'
  UNION ALL SELECT 'VL-9', 'warning', 'metadata.databaseId', id FROM nodes WHERE type = 'dbProcess' AND database_id IS NULL
  UNION ALL SELECT 'VL-9', 'warning', 'metadata.operation', id FROM nodes WHERE type = 'dbProcess' AND operation IS NULL
  UNION ALL SELECT 'VL-10', 'warning', 'metadata.method', id FROM nodes WHERE type = 'externalCall' AND method IS NULL
  UNION ALL SELECT 'VL-10', 'warning', 'metadata.path', id FROM nodes WHERE type = 'externalCall' AND path IS NULL
  UNION ALL SELECT 'VL-11', 'warning', 'metadata.eventName', id FROM nodes WHERE type = 'event' AND event_name IS NULL
  UNION ALL SELECT 'VL-12', 'warning', 'metadata.level', id FROM nodes WHERE type = 'log' AND level = 'loud'
  UNION ALL SELECT 'VL-14', 'warning', 'metadata.kind', id FROM nodes WHERE type = 'flowControl' AND kind IS NULL
)
SELECT * FROM found
"""


@query(FIELD_SQL)
def validate_fields(spark, d):
    """VL-1 to VL-14 over the stand-in topology."""
    return validate.fields(S.topology(spark, d)).drop("message")


EDGE_SQL = f"""
WITH {S.SQL}, known AS (SELECT id FROM services UNION SELECT id FROM endpoints UNION SELECT id FROM functions UNION SELECT id FROM nodes UNION SELECT id FROM databases UNION SELECT id FROM brokers UNION SELECT id FROM screens),
good AS (SELECT * FROM edges WHERE source IS NOT NULL AND target IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind) AS nth FROM good),
found AS (
  SELECT 'VL-15' AS "check", 'error' AS level, 'target' AS rule, NULL AS node FROM edges WHERE target IS NULL
  UNION ALL SELECT 'VL-15', 'error', NULL, source FROM good WHERE kind IS NULL
  UNION ALL SELECT 'VL-16', 'warning', NULL, source FROM good WHERE source = target
  UNION ALL SELECT 'VL-17', 'warning', 'source', source FROM good WHERE NOT EXISTS (SELECT 1 FROM known WHERE id = source)
  UNION ALL SELECT 'VL-17', 'warning', 'target', source FROM good WHERE NOT EXISTS (SELECT 1 FROM known WHERE id = target)
  UNION ALL SELECT 'VL-18', 'info', NULL, source FROM numbered WHERE nth > 1
  UNION ALL SELECT 'VL-19', 'info', 'metadata.operation', source FROM good WHERE kind = 'reads_from' AND operation IS NULL
  UNION ALL SELECT 'VL-20', 'info', 'metadata.topic', source FROM good WHERE kind = 'publishes_to' AND topic IS NULL
)
SELECT "check", level, rule, node, count(*) AS n FROM found GROUP BY ALL
"""


@query(EDGE_SQL)
def validate_edges(spark, d):
    """VL-15 to VL-20, counted by source."""
    t = S.saved(spark, d, "nodes", "edges")
    found = validate.edge_rules(t["edges"], validate.node_ids(t))
    return found.groupBy("check", "level", "rule", "node").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.SQL} SELECT e.id AS node FROM endpoints e WHERE NOT EXISTS (SELECT 1 FROM edges WHERE source = e.id)")
def validate_stubs(spark, d):
    """VL-21."""
    t = S.topology(spark, d)
    return validate.stubs(t["endpoints"], t["edges"]).select("node")


@query(f"WITH {S.SQL} SELECT s.id AS node, count(*) AS n FROM services s JOIN endpoints e ON e.service_id = s.id WHERE s.kind = 'frontend' GROUP BY 1")
def validate_frontends(spark, d):
    """VL-5."""
    t = S.topology(spark, d)
    found = validate.frontends(t["services"], t["endpoints"])
    return found.select("node", F.regexp_extract("message", r"has (\d+) endpoint", 1).cast("long").alias("n"))


BELOW = """, below AS (SELECT n.*, CASE WHEN n.parent_id LIKE 'endpoint:%' THEN n.parent_id ELSE p.parent_id END AS root_id
  FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id)"""
FLOW_SQL = f"""
WITH {S.SQL} {BELOW}, leaf AS (SELECT * FROM below b WHERE type <> 'flowControl' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = b.id))
SELECT 'VL-22' AS "check", root_id AS node, count(*) AS n FROM (SELECT root_id FROM leaf GROUP BY 1 HAVING count(*) FILTER (WHERE type IN ('return', 'throw')) = 0) GROUP BY ALL
UNION ALL SELECT 'VL-23', id, 1 FROM below b WHERE type = 'flowControl' AND branches = 0 AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = b.id)
UNION ALL SELECT 'VL-24', id, 1 FROM below b WHERE type = 'flowControl' AND kind = 'try'
  AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.kind = 'catch' AND (c.parent_id = b.parent_id OR c.parent_id = b.id))
"""


@query(FLOW_SQL)
def validate_flow(spark, d):
    """VL-22 to VL-24."""
    t = S.saved(spark, d, "nodes")
    found = validate.flow_rules(t["endpoints"], t["nodes"], Saved(spark).save)
    return found.groupBy("check", "node").agg(F.count(F.lit(1)).alias("n"))


ROOT_SQL = f"""
WITH {S.SQL} {BELOW}
SELECT id, root_id, CASE WHEN parent_id = root_id THEN 1 ELSE 2 END AS depth FROM below
"""


@query(ROOT_SQL)
def subtree_roots(spark, d):
    """GR-1: the endpoint above every code node, and how far."""
    t = S.saved(spark, d, "nodes")
    every = t["nodes"].select("id", "parent_id").unionByName(t["endpoints"].select("id", F.lit(None).cast("string").alias("parent_id")))
    return tree.roots(every, Saved(spark).save).where("parent_id is not null").select("id", "root_id", "depth")


@query(f"WITH {S.SQL} {BELOW} SELECT root_id AS ancestor, id, CASE WHEN parent_id = root_id THEN 1 ELSE 2 END AS depth FROM below UNION ALL SELECT parent_id, id, 1 FROM below WHERE parent_id <> root_id")
def subtree_pairs(spark, d):
    """GR-1: all pairs of a node and one below it."""
    return tree.descendants(S.nodes(spark, d).select("id", "parent_id"), Saved(spark).save)


def _error_paths(spark, d, nearest):
    n = S.nodes(spark, d)
    n = n.select("id", "file", "type", "kind", "status", F.lit("s").alias("service"), F.lit("Error").alias("name"), (8 - F.col("ord")).alias("line"), F.col("ord").alias("ord"))
    return errors.error_paths(n, nearest).select("node", "status", "handler", "handled")


TURNED = ", turned AS (SELECT id, file, type, kind, status, 8 - ord AS line, ord FROM nodes)"
ERRORS = """
WITH {s} {t}, h AS (SELECT t.id AS node, t.status, c.id AS handler, row_number() OVER (PARTITION BY t.id ORDER BY {o} NULLS LAST) AS n
  FROM turned t LEFT JOIN turned c ON t.file = c.file AND c.type = 'flowControl' AND c.kind = 'catch' AND c.line > t.line WHERE t.type = 'throw')
SELECT node, status, handler, handler IS NOT NULL AS handled FROM h WHERE n = 1
"""


@query(ERRORS.format(s=S.SQL, t=TURNED, o="c.line"))
def error_paths_nearest(spark, d):
    """AG-22 with the nearest later catch of the file; positions are turned round, so that catches follow throws."""
    return _error_paths(spark, d, True)


@query(ERRORS.format(s=S.SQL, t=TURNED, o="c.ord"))
def error_paths_first(spark, d):
    """AG-22 with the first catch in collection order."""
    return _error_paths(spark, d, False)


CALLS = "calls AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls' AND target LIKE 'function:%')"


def _reached(spark, d):
    t = S.saved(spark, d, "nodes")
    calls = t["edges"].where("kind = 'calls' and target like 'function:%'").select("source", "target")
    return errors.reached(t["endpoints"], calls, Saved(spark).save), t["nodes"]


RESPONSE_SQL = f"""
WITH {S.SQL}, {CALLS}, reach AS (SELECT id AS endpoint, id AS node, 0 AS depth FROM endpoints UNION ALL SELECT source, target, 1 FROM calls),
outcomes AS (SELECT CASE WHEN parent_id LIKE 'endpoint:%' THEN parent_id ELSE 'function:' || (ord * 3) END AS owner, id, type, CASE WHEN type = 'throw' THEN status END AS status, ord
  FROM nodes WHERE type IN ('return', 'throw')),
hit AS (SELECT endpoint, coalesce(status, CASE type WHEN 'return' THEN 200 ELSE 500 END) AS status, depth, ord, id, type FROM reach JOIN outcomes ON owner = node),
r AS (SELECT *, row_number() OVER (PARTITION BY endpoint, status ORDER BY depth, ord, id) AS n FROM hit)
SELECT endpoint, status, id AS outcome, type FROM r WHERE n = 1
"""


@query(RESPONSE_SQL)
def endpoint_responses(spark, d):
    """AG-18, SO-3: what endpoints answer, following resolved calls. Outcomes of inner nodes stand for those of functions."""
    reach, nodes = _reached(spark, d)
    owner = F.when(F.col("parent_id").startswith("endpoint:"), F.col("parent_id")).otherwise(F.concat(F.lit("function:"), (F.col("ord") * 3).cast("string")))
    outcomes = nodes.where("type in ('return', 'throw')").select(owner.alias("owner"), "id", "type", F.when(F.col("type") == "throw", F.col("status")).alias("status"), "ord")
    return errors.responses(reach, outcomes)


USE_SQL = f"""
WITH {S.SQL}, {CALLS}, reach AS (SELECT id AS endpoint, id AS node FROM endpoints UNION SELECT source, target FROM calls),
ops AS (SELECT CASE WHEN parent_id LIKE 'endpoint:%' THEN parent_id ELSE 'function:' || (ord * 3) END AS owner, 't' || status AS "table", coalesce(operation, 'raw') AS operation FROM nodes WHERE type = 'dbProcess')
SELECT endpoint, "table", string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations FROM reach JOIN ops ON owner = node GROUP BY 1, 2
"""


@query(USE_SQL)
def endpoint_tables(spark, d):
    """AG-19: tables and operations that endpoints use, following calls."""
    reach, nodes = _reached(spark, d)
    owner = F.when(F.col("parent_id").startswith("endpoint:"), F.col("parent_id")).otherwise(F.concat(F.lit("function:"), (F.col("ord") * 3).cast("string")))
    ops = nodes.where("type = 'dbProcess'").select(owner.alias("owner"), F.concat(F.lit("t"), F.col("status").cast("string")).alias("table"), F.coalesce("operation", F.lit("raw")).alias("operation"))
    return errors.uses(reach, ops).withColumn("operations", F.array_join("operations", ","))


COVER_SQL = f"""
WITH {S.SQL}, f AS (SELECT id, service_id, CASE WHEN kind = 'constructor' THEN 'Span' ELSE 'Get' END AS mark FROM functions),
own AS (SELECT n.type, n.level FROM (SELECT 'function:' || ord AS parent_id, type, level FROM nodes) n JOIN f ON f.id = n.parent_id)
SELECT (SELECT count(*) FROM endpoints) AS endpoints_total,
  (SELECT count(*) FROM endpoints WHERE service_id IN (SELECT service_id FROM f WHERE mark = 'Span')) AS endpoints_with_tracing,
  (SELECT count(*) FROM own WHERE type = 'dbProcess') AS db_queries_total, CAST(0 AS BIGINT) AS db_queries_with_spans,
  (SELECT count(*) FROM own WHERE type = 'throw') AS errors_total, (SELECT count(*) FROM own WHERE type = 'log' AND level = 'error') AS errors_with_logging
"""


@query(COVER_SQL)
def coverage_counters(spark, d):
    """AG-9: constructors stand for traced functions, nodes by their line for children of the first functions."""
    t = S.topology(spark, d)
    f = t["functions"].select("id", "service_id", F.array(F.when(F.col("kind") == "constructor", "Span").otherwise("Get")).alias("decorators"))
    children = t["nodes"].select(F.concat(F.lit("function:"), F.col("ord").cast("string")).alias("parent_id"), "type", "level")
    return errors.coverage(t["endpoints"], f, children)


METRIC_SQL = f"""
WITH {S.SQL} {BELOW}, b AS (SELECT *, type = 'call' AND status = 400 AS awaited FROM below),
tries AS (SELECT parent_id AS fn, ord AS low, ord + 1 AS high FROM b WHERE type = 'flowControl' AND kind = 'try'),
bare AS (SELECT DISTINCT root_id FROM b WHERE awaited AND NOT EXISTS (SELECT 1 FROM tries WHERE fn = root_id AND b.ord BETWEEN low AND high))
SELECT e.id, 5 AS lines, 1 + count(*) FILTER (WHERE b.type = 'flowControl' AND b.kind IN ('if', 'catch')) AS cyclomatic, coalesce(bool_or(b.awaited), false) AS performs_io,
  e.id IN (SELECT root_id FROM bare) AS throws_unhandled FROM endpoints e LEFT JOIN b ON b.root_id = e.id GROUP BY e.id
"""


@query(METRIC_SQL)
def function_metrics(spark, d):
    """AG-5, AG-6, JN-20 with all nodes below: endpoints stand for functions."""
    t = S.saved(spark, d, "nodes")
    below = tree.descendants(t["nodes"].select("id", "parent_id"), Saved(spark).save)
    nodes = t["nodes"].select("id", "parent_id", "type", "kind", F.col("ord").alias("line"), (F.col("ord") + 1).alias("end_line"), ((F.col("type") == "call") & (F.col("status") == 400)).alias("awaited"))
    f = t["endpoints"].select("id", F.lit(10).alias("line"), F.lit(15).alias("end_line"))
    return errors.metrics(f, below, nodes)


MERGE_SQL = """
WITH t AS (SELECT p_brand AS alias, p_type AS name, CASE WHEN p_size > 40 THEN p_name END AS entity_name, p_size > 45 AS has_timestamps, p_retailprice > 1900 AS has_soft_delete, p_partkey AS ord FROM part)
SELECT alias, lower(name) AS key, arg_min(name, ord) AS name, arg_min(entity_name, ord) FILTER (WHERE entity_name <> '') AS entity_name, bool_or(has_timestamps) AS has_timestamps,
  bool_or(has_soft_delete) AS has_soft_delete FROM t GROUP BY 1, 2
"""


@query(MERGE_SQL)
def merge_tables(spark, d):
    """AG-1, AG-2: brands stand for connections, types for tables."""
    t = S._read(spark, d, "part").select(F.col("p_brand").alias("alias"), F.col("p_type").alias("name"), F.when(F.col("p_size") > 40, F.col("p_name")).alias("entity_name"), (F.col("p_size") > 45).alias("has_timestamps"), (F.col("p_retailprice") > 1900).alias("has_soft_delete"), F.col("p_partkey").alias("ord"))
    return resources.merge_tables(t)


COLUMN_SQL = """
WITH c AS (SELECT p_brand AS alias, p_type AS "table", 'c' || (p_size % 9) AS name, CASE WHEN p_size < 30 THEN 'inferred' ELSE 'declared' END AS source_kind, p_partkey AS ord FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY alias, lower("table"), name ORDER BY source_kind = 'inferred', ord) AS n FROM c)
SELECT alias, lower("table") AS key, name, source_kind, ord FROM r WHERE n = 1
"""


@query(COLUMN_SQL)
def merge_columns(spark, d):
    """AG-2: columns that are declared win over those that are inferred."""
    p = S._read(spark, d, "part")
    c = p.select(F.col("p_brand").alias("alias"), F.col("p_type").alias("table"), F.concat(F.lit("c"), (F.col("p_size") % 9).cast("string")).alias("name"), F.when(F.col("p_size") < 30, "inferred").otherwise("declared").alias("source_kind"), F.col("p_partkey").alias("ord"))
    return resources.merge_columns(c).select("alias", "key", "name", "source_kind", "ord")


DEPENDENCY_SQL = f"""
WITH {S.SQL} {BELOW}, n AS (SELECT e.service_id AS service, b.type, b.database_id, CASE WHEN b.status = 400 THEN 'africa' END AS channel FROM below b JOIN endpoints e ON e.id = b.root_id),
known AS (SELECT id AS service, 'database:1' AS target FROM services)
SELECT DISTINCT service, database_id AS target, 'database' AS target_kind, 'sync' AS call_kind, true AS critical FROM n WHERE type = 'dbProcess' AND database_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.service = n.service AND k.target = n.database_id)
UNION ALL SELECT DISTINCT service, b.id, 'broker', 'async', false FROM n JOIN brokers b ON n.channel = b.alias WHERE type = 'event' AND b.id IS NOT NULL
"""


@query(DEPENDENCY_SQL)
def service_dependencies(spark, d):
    """JN-5, JN-6, JN-27 over all nodes below endpoints."""
    t = S.saved(spark, d, "nodes")
    every = t["nodes"].select("id", "parent_id").unionByName(t["endpoints"].select("id", F.lit(None).cast("string").alias("parent_id")))
    root = tree.roots(every, Saved(spark).save).select("id", "root_id")
    n = t["nodes"].join(root, "id").join(t["endpoints"].select(F.col("id").alias("root_id"), F.col("service_id").alias("service")), "root_id")
    n = n.select("service", "type", "database_id", F.when(F.col("status") == 400, "africa").alias("channel"))
    return resources.dependencies(n, t["brokers"].where("id is not null").select("id", "alias"), t["services"].select(F.col("id").alias("service"), F.lit("database:1").alias("target")))


IMPORT_SQL = f"""
WITH {S.SQL}, files AS (SELECT 'a/' || lower(c_mktsegment) || '/f' || (c_custkey // 3) || '.ts' AS file, 'service:' || c_nationkey AS service, c_custkey AS ord FROM customer),
modules AS (SELECT DISTINCT 'service:' || s_nationkey AS service, CASE WHEN s_acctbal > 8000 THEN 'lodash' WHEN s_acctbal > 4000 THEN '../building/f' || s_suppkey || '.ts' ELSE './f' || s_suppkey END AS module FROM supplier),
wanted AS (SELECT *, regexp_replace(regexp_replace(module, '^(\\.{{1,2}}/)+', ''), '\\.(ts|js|tsx|jsx)$', '') AS tail FROM modules),
hit AS (SELECT w.service, w.module, f.service AS target, row_number() OVER (PARTITION BY w.service, w.module ORDER BY f.ord NULLS LAST) AS n
  FROM wanted w LEFT JOIN files f ON w.module LIKE '.%' AND (regexp_replace(f.file, '\\.ts$', '') = tail OR ends_with(regexp_replace(f.file, '\\.ts$', ''), '/' || tail)))
SELECT service AS source, coalesce(target, module) AS target, 'imports' AS kind, module FROM hit WHERE n = 1
"""


@query(IMPORT_SQL)
def import_edges(spark, d):
    """JN-8: customers stand for files, suppliers for what imports them; whole names at the end of a path count."""
    c, s = S._read(spark, d, "customer"), S._read(spark, d, "supplier")
    files = c.select(F.concat(F.lit("a/"), F.lower("c_mktsegment"), F.lit("/f"), F.expr("c_custkey div 3").cast("string"), F.lit(".ts")).alias("file"), S.tag("service:", "c_nationkey").alias("service"), F.col("c_custkey").alias("ord"))
    key = F.col("s_suppkey").cast("string")
    module = F.when(F.col("s_acctbal") > 8000, "lodash").when(F.col("s_acctbal") > 4000, F.concat(F.lit("../building/f"), key, F.lit(".ts"))).otherwise(F.concat(F.lit("./f"), key))
    return links.imports(s.select(S.tag("service:", "s_nationkey").alias("service"), module.alias("module")), files).select("source", "target", "kind", F.element_at("meta", "modulePath").alias("module"))


INJECT_SQL = f"""
WITH {S.SQL}, c AS (SELECT * FROM functions WHERE kind = 'constructor'), last AS (SELECT class_name, arg_max(id, ord) AS id FROM c GROUP BY 1),
p AS (SELECT id, class_name AS base, 'self' AS param FROM c UNION ALL SELECT id, 'Class18', 'other' FROM c)
SELECT p.id AS source, last.id AS target, 'depends_on' AS kind, param FROM p JOIN last ON last.class_name = base WHERE p.id <> last.id
"""


@query(INJECT_SQL)
def injected_edges(spark, d):
    """JN-9: constructors take one of their own class and one of Class18, in generics."""
    f = S.functions(spark, d)
    one = lambda name, kind: F.struct(F.lit(name).alias("name"), kind.alias("type"))
    params = F.array(one("self", F.concat("class_name", F.lit("<User>"))), one("other", F.lit("Class18")), one("n", F.lit("number")))
    return links.injected(f.withColumn("params", params)).select("source", "target", "kind", F.element_at("meta", "paramName").alias("param"))


INHERIT_SQL = f"""
WITH {S.SQL}, data AS (SELECT 'data:' || p_partkey AS id, p_brand AS name, CASE WHEN p_size > 45 THEN 'Class' || (p_partkey % 20) WHEN p_size > 40 THEN 'Brand#' || (p_partkey % 60) END AS up,
  CASE WHEN p_size < 3 THEN 'Brand#' || (p_partkey % 60) END AS face, p_partkey AS ord FROM part),
named AS (SELECT name, arg_max(id, ord) AS id FROM data GROUP BY 1), built AS (SELECT class_name, arg_max(id, ord) AS id FROM functions WHERE kind = 'constructor' GROUP BY 1)
SELECT d.id AS source, coalesce(n.id, b.id) AS target, 'extends' AS kind FROM data d LEFT JOIN named n ON n.name = d.up LEFT JOIN built b ON b.class_name = d.up WHERE coalesce(n.id, b.id) IS NOT NULL
UNION ALL SELECT d.id, n.id, 'uses' FROM data d JOIN named n ON n.name = d.face
"""


@query(INHERIT_SQL)
def inherit_edges(spark, d):
    """JN-12: parts stand for classes; some extend others, some constructors' classes, some implement others."""
    p = S._read(spark, d, "part")
    key = (F.col("p_partkey") % 60).cast("string")
    up = F.when(F.col("p_size") > 45, F.concat(F.lit("Class"), (F.col("p_partkey") % 20).cast("string"))).when(F.col("p_size") > 40, F.concat(F.lit("Brand#"), key))
    data = p.select(S.tag("data:", "p_partkey").alias("id"), F.col("p_brand").alias("name"), up.alias("super_class"), F.when(F.col("p_size") < 3, F.array(F.concat(F.lit("Brand#"), key))).alias("implements"), F.col("p_partkey").alias("ord"))
    return links.inherits(data, S.functions(spark, d)).drop("meta")


FLAT_SQL = f"""
WITH {S.SQL}
SELECT source, target, kind FROM (
  SELECT service_id AS source, id AS target, 'CONTAINS' AS kind FROM endpoints UNION SELECT service_id, id, 'CONTAINS' FROM functions
  UNION SELECT parent_id, id, 'CONTAINS' FROM nodes UNION SELECT source, target, upper(kind) FROM edges)
"""


@query(FLAT_SQL)
def property_graph(spark, d):
    """SNK-5, GR-2 on the stand-in tables."""
    return topology.flatten(S.topology(spark, d))[1]


SUMMARY_SQL = f"""
WITH {S.SQL}
SELECT 'services' AS what, NULL AS name, count(*) AS n FROM services UNION ALL SELECT 'endpoints', NULL, count(*) FROM endpoints UNION ALL SELECT 'functions', NULL, count(*) FROM functions
UNION ALL SELECT 'nodes', NULL, count(*) FROM nodes UNION ALL SELECT 'edges', NULL, count(*) FROM edges UNION ALL SELECT 'databases', NULL, count(*) FROM databases
UNION ALL SELECT 'brokers', NULL, count(*) FROM brokers UNION ALL SELECT 'screens', NULL, count(*) FROM screens
UNION ALL SELECT 'endpoints of', service_id, count(*) FROM endpoints GROUP BY 2 UNION ALL SELECT 'functions of', service_id, count(*) FROM functions GROUP BY 2
"""


@query(SUMMARY_SQL)
def topology_summary(spark, d):
    """SNK-3, AG-11 on the stand-in tables."""
    return topology.summary(S.topology(spark, d))


ECO_SQL = f"""
WITH {S.SQL}, deps AS (SELECT DISTINCT e.service_id AS service, n.database_id AS target FROM nodes n JOIN endpoints e ON n.parent_id = e.id WHERE n.type = 'dbProcess' AND n.database_id IS NOT NULL)
SELECT id, name, engine, (SELECT count(DISTINCT service) FROM deps WHERE target = d.id) AS connection_count FROM databases d
"""


@query(ECO_SQL)
def ecosystem_databases(spark, d):
    """AG-13: connections of each database."""
    t = S.topology(spark, d)
    n = t["nodes"].where("type = 'dbProcess'").join(t["endpoints"].select(F.col("id").alias("parent_id"), F.col("service_id").alias("service")), "parent_id")
    deps = n.where("database_id is not null").select("service", F.col("database_id").alias("target"), F.lit("database").alias("target_kind"))
    return resources.ecosystem(t["services"], t["databases"], t["endpoints"], deps)[1]


@query(f"WITH {S.SQL} SELECT id, CASE engine WHEN 'postgresql' THEN 'sql' ELSE 'nosql' END AS category, 26 + 2 * (SELECT count(*) FROM functions WHERE service_id = 'service:' || replace(d.id, 'database:', '')) AS size FROM databases d")
def resource_sizes(spark, d):
    """SF-14, SF-24."""
    t = S.topology(spark, d)
    n = t["functions"].groupBy(F.replace("service_id", F.lit("service:"), F.lit("database:")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return t["databases"].join(n, "id", "left").select("id", X.database_category(F.coalesce("engine", F.lit(""))).alias("category"), (F.lit(26) + 2 * F.coalesce("n", F.lit(0))).alias("size"))


@query(f"WITH {S.SQL} SELECT count(DISTINCT file) AS files, count(*) FILTER (WHERE type = 'endpoint') AS endpoints, count(*) FILTER (WHERE type = 'function') AS functions, count(*) FILTER (WHERE type = 'dbProcess') AS db_operations, count(*) FILTER (WHERE type = 'event') AS events, count(*) FILTER (WHERE type = 'externalCall') AS external_calls FROM nodes")
def progress_counts(spark, d):
    """AG-12."""
    return enrich.progress(S.nodes(spark, d).select(F.lit("s").alias("service"), F.col("file").alias("path"), "type"))


@query(f"WITH {S.SQL} {BELOW} SELECT root_id AS id, count(*) FILTER (WHERE type = 'dbProcess') AS db_operations, count(*) FILTER (WHERE type = 'externalCall') AS external_calls, count(*) FILTER (WHERE type IN ('dbProcess', 'externalCall')) > 0 AS has_io FROM below GROUP BY 1")
def endpoint_io(spark, d):
    """AG-23, AG-20: operations and external calls in the tree of each endpoint."""
    n = S.saved(spark, d, "nodes")["nodes"]
    below = tree.descendants(n.select("id", "parent_id"), Saved(spark).save).where(F.col("ancestor").startswith("endpoint:"))
    return enrich.has_io(below, n)


@query(f"WITH {S.SQL} SELECT id, level FROM nodes WHERE type = 'log' AND level IN ('info', 'log', 'warn', 'error', 'fatal')")
def logs_at_least(spark, d):
    """PF-8, AG-10."""
    return enrich.at_least(S.nodes(spark, d).where("type = 'log'").select("id", "level"), "info")


TEXT_SQL = f"""
WITH {S.SQL} {BELOW}, placed AS (SELECT b.*, CASE WHEN b.parent_id = b.root_id THEN [struct_pack(o := b.ord, i := b.id)] ELSE [struct_pack(o := p.ord, i := p.id), struct_pack(o := b.ord, i := b.id)] END AS pos
  FROM below b LEFT JOIN nodes p ON p.id = b.parent_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY pos) AS n FROM placed)
SELECT root_id AS root, string_agg(CASE WHEN len(pos) = 2 THEN '  ' ELSE '' END || type || ' ' || coalesce(kind, ''), chr(10) ORDER BY n) AS text FROM numbered WHERE n <= 30 GROUP BY 1
"""


@query(TEXT_SQL)
def flow_texts(spark, d):
    """GR-7, UD-4, TK-2: the first 30 nodes of each endpoint in pre-order."""
    t = S.saved(spark, d, "nodes")
    rows = t["nodes"].select("id", "parent_id", "ord", "type", F.col("kind").alias("name"))
    tops = t["endpoints"].select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ord"), F.lit("endpoint").alias("type"), F.lit(None).cast("string").alias("name"))
    return enrich.flow_text(rows.unionByName(tops), Saved(spark).save)


RESOLVED_SQL = """
WITH c AS (SELECT 'call:' || l_orderkey || '.' || l_linenumber AS id, 'customer:' || o_custkey AS service, 'e:' || l_suppkey AS endpoint_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'),
e AS (SELECT 'e:' || s_suppkey AS id, 'nation:' || s_nationkey AS service FROM supplier)
SELECT c.service, e.service AS target, string_agg(DISTINCT c.id, ',' ORDER BY c.id) AS via FROM c JOIN e ON c.endpoint_id = e.id WHERE c.service <> e.service GROUP BY 1, 2
"""


@query(RESOLVED_SQL)
def resolved_dependencies(spark, d):
    """JN-26: lines that are done stand for resolved calls of their customers, suppliers for endpoints of their nations."""
    line = S._read(spark, d, "lineitem").where("l_linestatus = 'F'").join(S._read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    key = F.concat(F.lit("call:"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    calls = line.select(key.alias("id"), S.tag("customer:", "o_custkey").alias("service"), S.tag("e:", "l_suppkey").alias("endpoint_id"))
    ends = S._read(spark, d, "supplier").select(S.tag("e:", "s_suppkey").alias("id"), S.tag("nation:", "s_nationkey").alias("service"))
    return resources.resolved_dependencies(calls, ends).withColumn("via", F.array_join("via", ","))


# Orders in a customer's sequence: a step leads from each order to the next, and back again if both have one priority. Runs
# of equal priority are then the strongly connected components, and an order reaches its run and all later ones.
RUN_SQL = """
steps AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority <> lag(o_orderpriority) OVER w AS fresh, o_orderstatus = 'P' AS throws,
    CASE WHEN o_totalprice > 100000 THEN CAST(floor(o_totalprice / 4000) AS BIGINT) END AS status, row_number() OVER w AS n
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
runs AS (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY cust ORDER BY n), 0) AS run FROM steps)
"""


def order_steps(spark, d):
    """(edges between orders, orders with whether they throw and their status)."""
    o = S._read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    step = o.select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(w).alias("target"), (F.col("o_orderpriority") == F.lead("o_orderpriority").over(w)).alias("both")).where("target is not null")
    edges = step.select("source", "target").unionByName(step.where("both").select(F.col("target").alias("source"), F.col("source").alias("target")))
    status = F.when(F.col("o_totalprice") > 100000, F.floor(F.col("o_totalprice") / 4000))
    return edges, o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("throws"), status.alias("status"))


@query(f"WITH {RUN_SQL} SELECT id AS node, min(id) OVER (PARTITION BY cust, run) AS part FROM runs")
def strong_components(spark, d):
    """GR-3: components of a graph that has very many."""
    edges, nodes = order_steps(spark, d)
    return scc.strong(nodes.select("id"), edges, Saved(spark).save)


@query(f"""
WITH {RUN_SQL} SELECT a.id, coalesce(bool_or(b.throws), false) AS can_throw, coalesce(string_agg(DISTINCT b.status, ',' ORDER BY b.status), '') AS statuses
FROM runs a JOIN runs b ON a.cust = b.cust AND b.run >= a.run GROUP BY 1
""")
def later_statuses(spark, d):
    """GR-3, GR-4, GR-5: whether anything that an order reaches throws, and the statuses of all it reaches."""
    edges, nodes = order_steps(spark, d)
    return scc.statuses(nodes, edges, Saved(spark).save).withColumn("statuses", F.array_join(F.col("statuses").cast("array<string>"), ","))


@query(f"""
WITH RECURSIVE {STEPS}, r(root, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.root, e.target FROM r JOIN e ON r.node = e.source)
SELECT root AS id, bool_or(s_acctbal < 0) AS can_throw, coalesce(string_agg(DISTINCT s_nationkey, ',' ORDER BY s_nationkey) FILTER (s_acctbal < 0), '') AS statuses FROM r JOIN supplier ON node = s_suppkey GROUP BY 1
""")
def reach_statuses(spark, d):
    """GR-4: the statuses themselves, of every supplier along the steps of all lines; nations of suppliers in debt stand for statuses."""
    bad = F.col("s_acctbal") < 0
    nodes = S._read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), bad.alias("throws"), F.when(bad, F.col("s_nationkey")).alias("status"))
    folder = Saved(spark)
    edges = folder.save(supplier_steps(S._read(spark, d, "lineitem")), "steps")
    return scc.statuses(nodes, edges, folder.save).withColumn("statuses", F.array_join(F.col("statuses").cast("array<string>"), ","))


# A forest of numbers: customers, their orders by date, and the orders' lines.
FOREST_SQL = """
lines AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
tree AS (SELECT 'c' || c_custkey AS id, NULL AS parent_id, c_custkey AS a, -1 AS b, -1 AS c, 'customer' AS flag FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_custkey, o_orderkey, -1, 'order' FROM orders
  UNION ALL SELECT 'o' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, o_custkey, l_orderkey, l_linenumber, flag FROM lines JOIN orders ON l_orderkey = o_orderkey),
numbered AS (SELECT *, row_number() OVER (ORDER BY a, b, c) - 1 AS pre FROM tree),
ranges AS (SELECT id, CASE WHEN b < 0 THEN 0 WHEN c < 0 THEN 1 ELSE 2 END AS depth, pre,
  CASE WHEN c >= 0 THEN pre WHEN b >= 0 THEN max(pre) OVER (PARTITION BY a, b) ELSE max(pre) OVER (PARTITION BY a) END AS last,
  CASE WHEN c >= 0 THEN (flag = 'R')::INT WHEN b >= 0 THEN sum((flag = 'R')::INT) OVER (PARTITION BY a, b) ELSE sum((flag = 'R')::INT) OVER (PARTITION BY a) END AS total FROM numbered)
SELECT id, depth, pre, last, CAST(total AS BIGINT) AS total_decides FROM ranges
"""


@query(f"WITH {FOREST_SQL}")
def subtree_ranges(spark, d):
    """GR-1, SO-1, AG-5: numbers in pre-order and sums over what is below, for customers, orders and lines."""
    c, o = S._read(spark, d, "customer"), S._read(spark, d, "orders")
    line = S._read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    none = F.lit(0).cast("int").alias("decides")
    rows = c.select(S.tag("c", "c_custkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("c_custkey").alias("ord"), none)
    rows = rows.unionByName(o.select(S.tag("o", "o_orderkey").alias("id"), S.tag("c", "o_custkey").alias("parent_id"), F.col("o_orderkey").alias("ord"), none))
    key = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    rows = rows.unionByName(line.select(F.concat(key, F.lit("."), F.col("l_linenumber").cast("string")).alias("id"), key.alias("parent_id"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("flag") == "R").cast("int").alias("decides")))
    return tree.numbers(rows, Saved(spark).save, ["decides"]).select("id", "depth", "pre", "last", "total_decides")
