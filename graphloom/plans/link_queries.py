"""Catalogue queries on links, texts and resources over the given tables, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import bodies, enrich, errors, links, resolve, resources, tree, validate
from graphloom.plans import stand_in as S
from graphloom.plans.catalogue import query
from graphloom.saved import Saved
from graphloom.sinks import catalog, documents


def _read(spark, d, name):
    return S._read(spark, d, name)


URLS = "u AS (SELECT page_id, url || '/${id}//x/${n}?q=' || page_id AS u, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)"


@query(rf"""
WITH {URLS} SELECT page_id, replace(regexp_replace(u, '\$\{{[^}}]+\}}', ':param', 'g'), '//', '/') AS url,
  split_part(regexp_replace(u, '\$\{{[^}}]+\}}', ':param', 'g'), '?', 1) AS path,
  '/' || array_to_string(list_filter([regexp_replace('/api/', '^/+|/+$', '', 'g'), regexp_replace(p, '^/+|/+$', '', 'g')], lambda x: x <> ''), '/') AS joined FROM u
""")
def clean_urls(spark, d):
    """SF-2, SF-3, SF-5."""
    u = F.concat("url", F.lit("/${id}//x/${n}?q="), F.col("page_id").cast("string"))
    return _read(spark, d, "pages").select("page_id", X.normalize_url(u).alias("url"), X.clean_path(u).alias("path"), X.join_http_paths(F.lit("/api/"), X.url_path(F.col("url")), F.lit(None).cast("string")).alias("joined"))


@query(r"""
SELECT p_partkey, regexp_replace(p_name || '.*(' || p_brand || ')?[' || p_size || ']{2}$\', '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS pattern FROM part
""")
def escaped_patterns(spark, d):
    """SF-10."""
    text = F.concat("p_name", F.lit(".*("), "p_brand", F.lit(")?["), F.col("p_size").cast("string"), F.lit("]{2}$\\"))
    return _read(spark, d, "part").select("p_partkey", X.escape_regex(text).alias("pattern"))


@query("""
WITH a AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'userId: u, ' WHEN 'assistant' THEN 'requestId, span_id, trace_id ' ELSE 'spanId correlationId ' END || left(text, 20) AS args FROM conversations)
SELECT conv_id, turn, regexp_matches(args, 'trace[Ii]d|traceID|trace_id|spanId') AS trace_id, regexp_matches(args, 'user[Ii]d|userId|user_id') AS user_id,
  regexp_matches(args, 'req[Ii]d|request[Ii]d|correlationId') AS request_id FROM a
""")
def log_flags(spark, d):
    """SF-13."""
    args = F.concat(F.when(F.col("role") == "user", "userId: u, ").when(F.col("role") == "assistant", "requestId, span_id, trace_id ").otherwise("spanId correlationId "), F.left("text", F.lit(20)))
    return _read(spark, d, "conversations").select("conv_id", "turn", X.log_ids(args).alias("f")).select("conv_id", "turn", "f.*")


@query("""
WITH f AS (SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'Apollo-server' WHEN contains(p_type, 'BRASS') THEN 'gRPC' WHEN contains(p_type, 'TIN') THEN 'react' ELSE 'gin' END AS framework,
  CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS endpoints, CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END AS screens, CASE WHEN p_size < 10 THEN 1 ELSE 0 END AS consumers FROM part)
SELECT p_partkey, CASE framework WHEN 'Apollo-server' THEN 'graphql' WHEN 'gRPC' THEN 'grpc' ELSE 'rest' END AS protocol,
  CASE WHEN (framework = 'react' OR screens > 0) AND endpoints = 0 THEN 'frontend' WHEN consumers > 0 AND endpoints = 0 THEN 'worker' ELSE 'backend' END AS kind FROM f
""")
def service_kinds(spark, d):
    """SF-16."""
    t = F.col("p_type")
    framework = F.when(t.contains("STEEL"), "Apollo-server").when(t.contains("BRASS"), "gRPC").when(t.contains("TIN"), "react").otherwise("gin")
    n = lambda c: F.when(c, 1).otherwise(0)
    kind = enrich.service_kind(framework, F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0), n(F.col("p_retailprice") > 1500), n(F.col("p_size") < 10))
    return _read(spark, d, "part").select("p_partkey", enrich.protocol(framework).alias("protocol"), kind.alias("kind"))


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'Promise<' || split_part(p_type, ' ', 1) || '[]>' WHEN p_size > 30 THEN split_part(p_type, ' ', 2) || '?' WHEN p_size > 20 THEN 'string[]' WHEN p_size > 10 THEN 'Array<number>' ELSE '' END AS t FROM part)
SELECT p_partkey, CASE WHEN t LIKE 'Promise<%' THEN regexp_extract(t, '<(\\w+)', 1) WHEN t LIKE '%?' THEN nullif(replace(t, '?', ''), '') END AS type FROM t
""".replace("\\\\", "\\"))
def base_types(spark, d):
    """SF-18: names of types without one generic, `?` and `[]`; primitives have none."""
    a, b, size = F.split_part("p_type", F.lit(" "), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(2)), F.col("p_size")
    t = F.when(size > 40, F.concat(F.lit("Promise<"), a, F.lit("[]>"))).when(size > 30, F.concat(b, F.lit("?"))).when(size > 20, "string[]").when(size > 10, "Array<number>").otherwise("")
    return _read(spark, d, "part").select("p_partkey", enrich.base_type(t).alias("type"))


@query(r"""
WITH t AS (SELECT event_id, 'answer: ' || CASE WHEN value > 75 THEN '[' || props || ', 1]' WHEN value > 50 THEN left(props, 3) ELSE props END || ' done' AS t FROM events),
f AS (SELECT event_id, regexp_extract(t, '(?s)(\{.*\}|\[.*\])', 1) AS found FROM t)
SELECT event_id, CASE WHEN found <> '' AND json_valid(found) THEN found END AS found FROM f
""")
def json_in_text(spark, d):
    """SF-19."""
    body = F.when(F.col("value") > 75, F.concat(F.lit("["), "props", F.lit(", 1]"))).when(F.col("value") > 50, F.left("props", F.lit(3))).otherwise(F.col("props"))
    return _read(spark, d, "events").select("event_id", X.json_in(F.concat(F.lit("answer: "), body, F.lit(" done"))).alias("found"))


SCORES = "s AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal / 50 END AS raw FROM customer)"


@query(f"WITH {SCORES} SELECT id, CAST(greatest(0.0, least(100.0, coalesce(raw, 50.0))) AS DOUBLE) AS score FROM s")
def clamped_scores(spark, d):
    """SF-20."""
    raw = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") / 50)
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.clamp_score(raw).alias("score"))


@query("SELECT CAST(coalesce(round(avg(floor(l_quantity))), 100) AS BIGINT) AS score FROM lineitem")
def mean_score(spark, d):
    """AG-16: quantities stand for scores."""
    return enrich.mean_score(_read(spark, d, "lineitem").select(F.floor("l_quantity").alias("score")))


@query("""
WITH t AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'Long' ELSE 'Source ' || source END AS title, lang, n_chars FROM documents)
SELECT doc_id, title, 'in ' || lang || chr(10) || n_chars AS body FROM t UNION ALL SELECT doc_id, 'Last', 'x' FROM t
""")
def markdown_sections(spark, d):
    """SF-21: text before the first heading goes, and of equal titles the last stays."""
    title = F.when(F.col("n_chars") > 3000, "Long").otherwise(F.concat(F.lit("Source "), "source"))
    text = F.concat(F.lit("intro\n## Last\nnot this\n## "), title, F.lit("\nin "), "lang", F.lit("\n"), F.col("n_chars").cast("string"), F.lit("\n\n## Last \nx\n"))
    return _read(spark, d, "documents").select("doc_id", F.explode(X.sections(text)).alias("title", "body"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_stamps(spark, d):
    """SF-25."""
    return _read(spark, d, "orders").select("o_orderkey", X.date_stamp(F.col("o_orderdate")).alias("day"))


CALL_LINES = """
calls AS (SELECT 'call:' || l_orderkey || '.' || l_linenumber || '.' || l_suppkey || '.' || l_partkey AS id, CASE WHEN l_tax < 0.04 THEN 'function:' || l_suppkey END AS container_id,
  CASE WHEN l_returnflag = 'N' THEN 'pending_review' WHEN l_returnflag = 'R' THEN 'resolved' ELSE 'unresolvable' END AS status,
  CASE WHEN l_returnflag = 'R' AND l_discount > 0.01 THEN 'endpoint:' || l_partkey END AS endpoint_id, l_discount AS confidence, l_orderkey, l_linenumber FROM lineitem)
"""


def _calls(spark, d):
    part = lambda c: F.col(c).cast("string")
    key = F.concat(F.lit("call:"), F.concat_ws(".", part("l_orderkey"), part("l_linenumber"), part("l_suppkey"), part("l_partkey")))
    status = F.when(F.col("l_returnflag") == "N", "pending_review").when(F.col("l_returnflag") == "R", "resolved").otherwise("unresolvable")
    to = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.01), S.tag("endpoint:", "l_partkey"))
    return _read(spark, d, "lineitem").select(key.alias("id"), F.when(F.col("l_tax") < 0.04, S.tag("function:", "l_suppkey")).alias("container_id"), status.alias("status"), to.alias("endpoint_id"), F.col("l_discount").alias("confidence"), F.lit("path").alias("reason"), F.lit("s").alias("target_service"), "l_orderkey")


@query(f"WITH {CALL_LINES} SELECT coalesce(container_id, id) AS source, endpoint_id AS target, 'resolves_to' AS kind, 'path' AS reason FROM calls WHERE status = 'resolved' AND endpoint_id IS NOT NULL")
def resolved_call_edges(spark, d):
    """JN-13, RS-3."""
    return links.resolved_calls(_calls(spark, d)).select("source", "target", "kind", F.element_at("meta", "reason").alias("reason"))


@query(f"""
WITH {CALL_LINES}, decisions AS (SELECT 'call:' || l_orderkey || '.' || l_linenumber || '.' || l_suppkey || '.' || l_partkey AS id,
  max(CASE WHEN l_quantity > 40 THEN 'unresolvable' WHEN l_quantity > 20 THEN 'endpoint:' || l_suppkey END) AS decision FROM lineitem GROUP BY 1)
SELECT c.id, CASE WHEN status = 'pending_review' AND decision = 'unresolvable' THEN 'unresolvable' WHEN status = 'pending_review' AND decision IS NOT NULL THEN 'resolved' ELSE status END AS status,
  CASE WHEN status = 'pending_review' AND decision <> 'unresolvable' THEN decision ELSE endpoint_id END AS endpoint_id FROM calls c JOIN decisions d ON c.id = d.id
""")
def decided_calls(spark, d):
    """JN-25: quantities decide; small ones leave a call as it is."""
    line = _read(spark, d, "lineitem")
    part = lambda c: F.col(c).cast("string")
    key = F.concat(F.lit("call:"), F.concat_ws(".", part("l_orderkey"), part("l_linenumber"), part("l_suppkey"), part("l_partkey")))
    said = F.when(F.col("l_quantity") > 40, "unresolvable").when(F.col("l_quantity") > 20, S.tag("endpoint:", "l_suppkey"))
    decisions = line.groupBy(key.alias("call_id")).agg(F.max(said).alias("decision"))  # one of each call, some lines being repeated
    return catalog.decide(_calls(spark, d), decisions).select("id", "status", "endpoint_id")


@query("""
WITH c AS (SELECT 'src/' || o_orderpriority || '/' || (o_orderkey // 50) AS file, o_custkey AS service, o_orderkey AS ord FROM orders)
SELECT file, arg_min(service, ord) AS service FROM c GROUP BY 1
""")
def caller_services(spark, d):
    """JN-15: orders stand for functions, fifty in a row of one priority for a file."""
    file = F.concat(F.lit("src/"), "o_orderpriority", F.lit("/"), F.expr("o_orderkey div 50").cast("string"))
    return links.caller_service(_read(spark, d, "orders").select(file.alias("file"), F.col("o_custkey").alias("service"), F.col("o_orderkey").alias("ord")))


FIELD_SQL = """
WITH c AS (SELECT 'column:' || p_partkey AS id, p_brand AS table_id, 'C' || p_size AS name FROM part),
f AS (SELECT o_orderkey AS op_id, 'Brand#' || (1 + o_custkey % 5) || (1 + o_orderkey % 5) AS table_id, 'c' || CAST(floor(o_totalprice / 1000) AS BIGINT) AS field FROM orders
  UNION ALL SELECT o_orderkey, 'Brand#' || (1 + o_custkey % 5) || (1 + o_orderkey % 5), 'nothing' FROM orders),
hit AS (SELECT f.*, c.id AS column_id FROM f LEFT JOIN c ON c.table_id = f.table_id AND lower(c.name) = lower(f.field))
SELECT DISTINCT op_id, column_id AS target, 'column' AS kind FROM hit WHERE column_id IS NOT NULL
UNION ALL SELECT op_id, any_value(table_id), 'table' FROM hit GROUP BY 1 HAVING count(column_id) = 0
"""


@query(FIELD_SQL)
def linked_columns(spark, d):
    """JN-19: prices of orders name columns, parts are columns of their brands."""
    columns = _read(spark, d, "part").select(S.tag("column:", "p_partkey").alias("id"), F.col("p_brand").alias("table_id"), S.tag("C", "p_size").alias("name"))
    o = _read(spark, d, "orders")
    t = F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 5).cast("string"), (1 + F.col("o_orderkey") % 5).cast("string")).alias("table_id")
    op = F.col("o_orderkey").alias("op_id")
    fields = o.select(op, t, F.concat(F.lit("c"), F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("field")).unionByName(o.select(op, t, F.lit("nothing").alias("field")))
    return resources.link_columns(fields, columns)


@query("SELECT DISTINCT o_custkey AS service, 'column:' || unnest([l_partkey, l_suppkey]) AS column_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def columns_used(spark, d):
    """AG-24: lines stand for operations, each with two columns."""
    line = _read(spark, d, "lineitem").join(_read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return resources.used_columns(line.select(F.col("o_custkey").alias("service"), F.array(S.tag("column:", "l_partkey"), S.tag("column:", "l_suppkey")).alias("column_ids")))


@query("""
WITH c AS (SELECT p_brand AS table_id, 'c' || p_partkey AS name, CASE WHEN p_size > 10 THEN p_type END AS type, CASE WHEN p_size > 20 THEN false END AS nullable, CASE WHEN p_size > 30 THEN true END AS "unique",
  CASE WHEN p_size > 40 THEN true END AS primary_key, CASE WHEN p_size < 5 THEN p_name END AS ref_table, CASE WHEN p_size < 3 THEN 'key' END AS ref_column FROM part)
SELECT 'column:' || left(sha1(table_id || ':' || name), 8) AS id, table_id, name, coalesce(type, 'unknown') AS type, coalesce(nullable, true) AS nullable, coalesce("unique", false) AS "unique",
  coalesce(primary_key, false) AS primary_key, ref_table || '.' || coalesce(ref_column, 'id') AS foreign_key FROM c
""")
def column_rows(spark, d):
    """AG-25."""
    size = F.col("p_size")
    c = _read(spark, d, "part").select(F.col("p_brand").alias("table_id"), S.tag("c", "p_partkey").alias("name"), F.when(size > 10, F.col("p_type")).alias("type"), F.when(size > 20, False).alias("nullable"), F.when(size > 30, True).alias("unique"), F.when(size > 40, True).alias("primary_key"), F.when(size < 5, F.col("p_name")).alias("ref_table"), F.when(size < 3, "key").alias("ref_column"))
    return resources.column_nodes(c)


@query(f"""
WITH {S.SQL}, things AS (SELECT id, name FROM databases UNION ALL SELECT id, name FROM services),
e AS (SELECT 'service:' || c_nationkey AS source, 'database:' || (c_custkey % 5) AS target, 'uses' AS kind FROM customer UNION ALL SELECT 'service:' || s_nationkey, 'service:' || (s_suppkey % 25), 'calls' FROM supplier)
SELECT DISTINCT e.source, t.id, t.name, e.kind FROM e JOIN things t ON e.target = t.id
""")
def neighbour_links(spark, d):
    """JN-28."""
    t = S.topology(spark, d)
    things = t["databases"].select("id", "name").unionByName(t["services"].select("id", "name"))
    c, s = _read(spark, d, "customer"), _read(spark, d, "supplier")
    e = c.select(S.tag("service:", "c_nationkey").alias("source"), F.concat(F.lit("database:"), (F.col("c_custkey") % 5).cast("string")).alias("target"), F.lit("uses").alias("kind"))
    e = e.unionByName(s.select(S.tag("service:", "s_nationkey").alias("source"), F.concat(F.lit("service:"), (F.col("s_suppkey") % 25).cast("string")).alias("target"), F.lit("calls").alias("kind")))
    return links.neighbours(e, things)


@query("""
WITH deps AS (SELECT DISTINCT 'c' || c_custkey AS service, CASE WHEN c_acctbal > 5000 THEN 'r' || (c_custkey % 9) WHEN c_acctbal > 0 THEN 'r' || (c_custkey % 5) END AS target FROM customer),
kinds AS (SELECT 'r' || r_regionkey AS target, CASE WHEN r_regionkey < 4 THEN 'database' ELSE 'broker' END AS target_kind FROM region),
hit AS (SELECT d.service, d.target, k.target_kind FROM deps d JOIN kinds k ON d.target = k.target)
SELECT 'c' || c_custkey AS service, hit.target, hit.target_kind FROM customer LEFT JOIN hit ON hit.service = 'c' || c_custkey
""")
def drawn_links(spark, d):
    """JN-29: regions are resources, two of them both database and broker."""
    c, r = _read(spark, d, "customer"), _read(spark, d, "region")
    to = F.when(F.col("c_acctbal") > 5000, F.col("c_custkey") % 9).when(F.col("c_acctbal") > 0, F.col("c_custkey") % 5)
    deps = c.select(S.tag("c", "c_custkey").alias("service"), F.concat(F.lit("r"), to.cast("string")).alias("target"))
    ids = r.select(S.tag("r", "r_regionkey").alias("id"), "r_regionkey")
    return links.drawn_dependencies(c.select(S.tag("c", "c_custkey").alias("id")), deps, ids.where("r_regionkey < 4").select("id"), ids.where("r_regionkey > 1").select("id"))


@query("""
WITH f AS (SELECT 'f' || s_suppkey AS id, 'Class' || s_nationkey || '.m' || (s_suppkey % 40) AS name, s_suppkey AS ord FROM supplier),
tails AS (SELECT split_part(name, '.', 2) AS tail, arg_min(id, ord) AS f_id FROM f GROUP BY 1),
r AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'f' || p_size END AS resolved_to, CASE WHEN p_size > 10 THEN 'm' || (p_partkey % 60) END AS tail FROM part)
SELECT r.id, coalesce(resolved_to, f_id) AS handler FROM r LEFT JOIN tails t ON r.resolved_to IS NULL AND r.tail = t.tail
""")
def route_handlers(spark, d):
    """JN-30: the last dotted argument names the handler; some routes have none."""
    f = _read(spark, d, "supplier").select(S.tag("f", "s_suppkey").alias("id"), F.concat(F.lit("Class"), F.col("s_nationkey").cast("string"), F.lit(".m"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.col("s_suppkey").alias("ord"))
    dotted = F.concat(F.lit("controller.m"), (F.col("p_partkey") % 60).cast("string"))
    arguments = F.when(F.col("p_size") > 10, F.array(F.lit("auth"), F.lit("x.first"), dotted)).otherwise(F.array(F.lit("auth")))
    return links.handlers_of(_read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, S.tag("f", "p_size")).alias("resolved_to"), arguments.alias("arguments")), f)


@query(f"WITH {S.SQL} SELECT e.id, e.service_id AS service, s.name FROM endpoints e JOIN services s ON e.service_id = s.id")
def endpoint_owners(spark, d):
    """JN-31."""
    t = S.topology(spark, d)
    return links.owner_of(t["endpoints"], t["services"])


BOTH_SQL = """
WITH p AS (SELECT page_id AS id, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS service, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/[0-9]+', '/:param') AS path,
  length(html) > 2000 AS new, CASE WHEN length(html) % 3 = 0 THEN 'resolved' WHEN length(html) % 3 = 1 THEN 'pending_review' ELSE 'unresolvable' END AS status FROM pages)
SELECT c.id, e.service AS target_service, count(*) AS n FROM p c JOIN p e ON c.path = e.path AND c.service <> e.service
WHERE (c.new AND NOT e.new) OR (NOT c.new AND c.status <> 'resolved' AND e.new) GROUP BY 1, 2
"""


@query(BOTH_SQL)
def both_ways(spark, d):
    """RS-5: long pages are new, short ones are stored; calls look for endpoints on the other side."""
    size = F.length("html")
    status = F.when(size % 3 == 0, "resolved").when(size % 3 == 1, "pending_review").otherwise("unresolvable")
    p = _read(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1).alias("service"), F.regexp_replace(X.url_path(F.col("url")), "/[0-9]+", "/:param").alias("path"), F.lit("GET").alias("method"), F.lit(0).alias("n_params"), (size > 2000).alias("new"), status.alias("status"))
    new, old = p.where("new").drop("new"), p.where("not new").drop("new")
    return resolve.both_ways(new, old, old, new, F.lit(False)).select("id", "target_service", "n")


@query(f"WITH {S.SQL} SELECT id, type FROM nodes WHERE type NOT IN ('log', 'telemetry', 'event', 'data')")
def shown_nodes(spark, d):
    """PF-7."""
    return enrich.shown(S.nodes(spark, d)).select("id", "type")


@query(f"WITH {S.SQL} SELECT id, kind FROM functions f WHERE kind <> 'constructor' AND id IN (SELECT 'function:' || l_suppkey FROM lineitem WHERE l_quantity > 49)")
def functions_to_describe(spark, d):
    """PF-5: functions that aren't constructors and have children; lines of large quantities are children of their suppliers."""
    child = _read(spark, d, "lineitem").where("l_quantity > 49").select(S.tag("function:", "l_suppkey").alias("parent_id"))
    return enrich.enrichable(S.functions(spark, d), child).select("id", "kind")


@query("""
WITH f AS (SELECT 'f' || s_suppkey AS id, CASE WHEN s_acctbal > 8000 THEN 'AllExceptionFilter' WHEN s_acctbal > 7000 THEN 'Catch' ELSE 'Get' END AS mark, CASE WHEN s_acctbal < 0 THEN 4 ELSE 3 END AS n,
  CASE WHEN s_nationkey < 12 THEN 'res.status(' || (400 + s_nationkey) || ')' ELSE 'next()' END AS raw FROM supplier)
SELECT id AS node, CASE WHEN raw LIKE 'res.%' THEN CAST(regexp_extract(raw, '\\d+') AS INTEGER) ELSE 500 END AS status FROM f WHERE mark <> 'Get' OR n = 4
""".replace("\\\\", "\\"))
def global_handlers(spark, d):
    """PF-6: functions that handle all errors, by decorators or four parameters."""
    bal = F.col("s_acctbal")
    mark = F.when(bal > 8000, "AllExceptionFilter").when(bal > 7000, "Catch").otherwise("Get")
    params = F.when(bal < 0, F.array(*[F.lit(x) for x in ("err", "req", "res", "next")])).otherwise(F.array(*[F.lit(x) for x in ("err", "req", "res")]))
    raw = F.when(F.col("s_nationkey") < 12, F.concat(F.lit("res.status("), (400 + F.col("s_nationkey")).cast("string"), F.lit(")"))).otherwise("next()")
    return errors.global_handlers(_read(spark, d, "supplier").select(S.tag("f", "s_suppkey").alias("id"), F.array(mark).alias("decorators"), params.alias("params"), raw.alias("raw")))


@query("""
WITH p AS (SELECT page_id, '/x/:a' || (page_id % 7) || '/{b_' || (page_id % 3) || '}/<int:c' || (page_id % 2) || '>/<d>/end' AS p FROM pages)
SELECT page_id, 'a' || (page_id % 7) || ',b_' || (page_id % 3) || ',c' || (page_id % 2) || ',d' AS params FROM p
""")
def path_params_all(spark, d):
    """SF-6: `:x`, `{x}`, `<t:x>` and `<x>`, in order."""
    n = lambda k: (F.col("page_id") % k).cast("string")
    path = F.concat(F.lit("/x/:a"), n(7), F.lit("/{b_"), n(3), F.lit("}/<int:c"), n(2), F.lit(">/<d>/end"))
    return _read(spark, d, "pages").select("page_id", F.array_join(X.path_params(path), ",").alias("params"))


@query("""
SELECT doc_id, array_to_string([left(trim(regexp_replace(regexp_replace(x, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g')), 40) FOR x IN [text, lang || chr(10) || source, ' ' || doc_id || ' ']], '|') AS prompts FROM documents
""".replace("\\\\", "\\"))
def sanitize_texts(spark, d):
    """SF-9: the array form."""
    items = F.array("text", F.concat("lang", F.lit("\n"), "source"), F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ")))
    return _read(spark, d, "documents").select("doc_id", F.array_join(X.sanitize_all(items, 40), "|").alias("prompts"))


@query("""
WITH n AS (SELECT CASE WHEN value <= 90 THEN 'n' || event_id END AS id, CASE event_type WHEN 'view' THEN 'telemetry' ELSE 'data' END AS type, CASE WHEN value < 30 THEN 'span' WHEN value < 60 THEN 'metric' ELSE 'odd' END AS kind FROM events)
SELECT 'VL-8' AS "check", 'error' AS level, 'id' AS rule, NULL AS node FROM n WHERE id IS NULL
UNION ALL SELECT 'VL-13', 'warning', 'metadata.kind', id FROM n WHERE id IS NOT NULL AND type = 'telemetry' AND kind = 'odd'
UNION ALL SELECT 'VL-25', 'warning', 'name', 's' || s_suppkey FROM supplier WHERE s_nationkey % 5 < 2
""")
def validate_ids(spark, d):
    """VL-8, VL-13, VL-25: nodes without ids, telemetry of unknown kinds, functions with short names."""
    value = F.col("value")
    kind = F.when(value < 30, "span").when(value < 60, "metric").otherwise("odd")
    n = _read(spark, d, "events").select(F.when(value <= 90, S.tag("n", "event_id")).alias("id"), F.when(F.col("event_type") == "view", "telemetry").otherwise("data").alias("type"), kind.alias("kind"))
    for c in ("database_id", "operation", "method", "path", "event_name", "level"):
        n = n.withColumn(c, F.lit(None).cast("string"))
    f = _read(spark, d, "supplier").select(S.tag("s", "s_suppkey").alias("id"), F.left("s_name", (1 + F.col("s_nationkey") % 5)).alias("name"))
    return validate.fields({"nodes": n}).unionByName(validate.short_names(f)).drop("message")


@query(f"""
WITH {S.SQL}, r AS (SELECT o_custkey, string_agg(DISTINCT '| ' || st || ' | ' || ty || ' |', chr(10) ORDER BY '| ' || st || ' | ' || ty || ' |') AS t
  FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS st, CASE o_orderstatus WHEN 'F' THEN 'return' ELSE 'throw' END AS ty FROM orders) GROUP BY 1)
SELECT id, '# ' || coalesce(method, '?') || ' ' || coalesce(path, '?')
  || CASE WHEN path IS NOT NULL THEN chr(10) || chr(10) || '## Parameters' || chr(10) || chr(10) || '| Name | In |' || chr(10) || '|---|---|' || chr(10) || '| key | path |' || chr(10) || '| page | query |' ELSE '' END
  || coalesce(chr(10) || chr(10) || '## Responses' || chr(10) || chr(10) || '| Status | By |' || chr(10) || '|---|---|' || chr(10) || t, '')
  || CASE WHEN ord % 2 = 0 THEN chr(10) || chr(10) || '## Flow' || chr(10) || chr(10) || '```' || chr(10) || 'return ' || name || chr(10) || '```' ELSE '' END AS markdown
FROM endpoints e LEFT JOIN r ON r.o_custkey = e.ord
""")
def endpoint_documents(spark, d):
    """AG-26, SNK-11: pages of endpoints with parameters, answers and flow; orders stand for answers."""
    e = S.endpoints(spark, d)
    o = _read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 404).otherwise(500)
    answers = o.select(S.tag("endpoint:", "o_custkey").alias("endpoint"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", "return").otherwise("throw").alias("type")).distinct()
    none = e.where("false").select(F.col("id").alias("endpoint"), F.lit("").alias("table"), F.array(F.lit("")).alias("operations"))
    both = F.array(F.struct(F.lit(0).alias("ord"), F.lit("key").alias("name"), F.lit("path").alias("place")), F.struct(F.lit(1).alias("ord"), F.lit("page").alias("name"), F.lit("query").alias("place")))
    given = e.where("path is not null").select(F.col("id").alias("endpoint"), F.explode(both).alias("p")).select("endpoint", "p.*")
    flows = e.where("ord % 2 = 0").select(F.col("id").alias("root"), F.concat(F.lit("return "), "name").alias("text"))
    return documents.endpoint_pages(e, answers, none, given, flows)


LOOP_SQL = """
l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS state, min(l_tax) AS tax, min(l_discount) AS discount FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey AS parent, l_linenumber AS ord, CASE WHEN flag = 'R' AND tax < 0.05 THEN 'flowControl' WHEN tax > 0.07 THEN 'return' WHEN tax > 0.06 THEN 'throw' WHEN discount > 0.08 THEN 'log' ELSE 'call' END AS type,
  CASE WHEN state = 'F' THEN 'for_of' ELSE 'if' END AS kind, discount < 0.03 AS resolved FROM l),
s AS (SELECT *, (type = 'flowControl' AND kind = 'for_of') AS loop FROM n WHERE type <> 'log'),
b AS (SELECT *, loop OR type IN ('return', 'throw') OR (type = 'call' AND resolved) AS bound FROM s)
"""


@query(f"""
WITH {LOOP_SQL}, body AS (SELECT h.parent, h.ord AS header, x.ord FROM b h JOIN b x ON h.parent = x.parent AND x.ord < h.ord AND NOT x.bound WHERE h.loop
  AND NOT EXISTS (SELECT 1 FROM b m WHERE m.parent = h.parent AND m.ord > x.ord AND m.ord < h.ord AND m.bound))
SELECT parent || '.' || header AS header, parent || '.' || ord AS id, CAST(row_number() OVER (PARTITION BY parent, header ORDER BY ord) AS INTEGER) AS position FROM body
""")
def loop_bodies(spark, d):
    """WN-2: lines of an order are siblings; loops take what is before them, back to a loop, return, throw or resolved call."""
    line = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_tax", "l_discount")])
    tax, off = F.col("l_tax"), F.col("l_discount")
    kind = F.when((F.col("l_returnflag") == "R") & (tax < 0.05), "flowControl").when(tax > 0.07, "return").when(tax > 0.06, "throw").when(off > 0.08, "log").otherwise("call")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    n = line.select(key.alias("id"), F.col("l_orderkey").cast("string").alias("parent_id"), F.col("l_linenumber").alias("ord"), kind.alias("type"), F.when(F.col("l_linestatus") == "F", "for_of").otherwise("if").alias("kind"), F.when(off < 0.03, F.lit("f")).alias("resolved_to"))
    return bodies.loop_bodies(n)


@query("""
SELECT l_partkey AS part, arg_max(l_suppkey, (l_discount, -l_orderkey * 10 - l_linenumber, l_suppkey)) AS supplier, max(l_discount) AS confidence FROM lineitem GROUP BY 1
""")
def best_candidates(spark, d):
    """AG-15: of each part the line of the highest discount, the first of equal ones."""
    line = _read(spark, d, "lineitem")
    # lines that are repeated differ in their supplier at most, of which the largest is taken
    c = line.groupBy(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_discount").alias("confidence")).agg(F.max("l_suppkey").alias("supplier"))
    return bodies.best(c, "part").select("part", "supplier", "confidence")


@query("""
SELECT 'p' || p_partkey AS id, p_name AS name FROM part WHERE p_size < 20 AND p_retailprice < 1800
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 45)
""")
def unused_variables(spark, d):
    """JN-24: small parts are local data, dear ones are in no function; lines of many returned pieces use them."""
    p = _read(spark, d, "part")
    data = p.select(S.tag("p", "p_partkey").alias("id"), S.tag("f", "p_partkey").alias("parent_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") < 20, "local").otherwise("module").alias("scope"))
    line = _read(spark, d, "lineitem").where("l_quantity > 45")
    uses = line.select(S.tag("p", "l_partkey").alias("source"), F.when(F.col("l_returnflag") == "A", "uses").otherwise("calls").alias("kind"))
    return bodies.unused_locals(data, p.where("p_retailprice < 1800").select(S.tag("f", "p_partkey").alias("id")), uses)


@query(f"""
WITH {S.SQL}, below AS (SELECT n.*, CASE WHEN n.parent_id LIKE 'endpoint:%' THEN n.parent_id ELSE p.parent_id END AS root_id FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id)
SELECT e.service_id AS service, count(*) FILTER (WHERE type = 'dbProcess') AS db_calls, count(*) FILTER (WHERE type = 'externalCall') AS external_calls FROM below b JOIN endpoints e ON e.id = b.root_id GROUP BY 1
""")
def service_io(spark, d):
    """AG-20: operations and external calls in the trees of each service."""
    t = S.saved(spark, d, "nodes")
    every = t["nodes"].select("id", "parent_id").unionByName(t["endpoints"].select("id", F.lit(None).cast("string").alias("parent_id")))
    root = tree.roots(every, Saved(spark).save).select("id", "root_id")
    own = t["nodes"].select("id", "type").join(root, "id").join(t["endpoints"].select(F.col("id").alias("root_id"), F.col("service_id").alias("service")), "root_id")
    return enrich.io_counts(own)


@query("""
WITH f AS (SELECT s_suppkey, '/src/' || (['Utils', 'helper', 'shared', 'Common', 'lib', 'utility', 'core'])[s_nationkey % 7 + 1] || '/f' || s_suppkey || '.ts' AS path FROM supplier)
SELECT s_suppkey, regexp_matches(path, '(?i)/(utils?|helpers?|shared|common|lib)/') AS utility FROM f
""")
def utility_paths(spark, d):
    """PF-3."""
    folders = F.array(*[F.lit(x) for x in ("Utils", "helper", "shared", "Common", "lib", "utility", "core")])
    path = F.concat(F.lit("/src/"), F.get(folders, F.col("s_nationkey") % 7), F.lit("/f"), F.col("s_suppkey").cast("string"), F.lit(".ts"))
    return _read(spark, d, "supplier").select("s_suppkey", bodies.is_utility(path).alias("utility"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, arg_min(flag, l_linenumber) AS flag, arg_min(supp, l_linenumber) AS supp FROM l WHERE flag <> 'N' GROUP BY 1),
fields AS (SELECT l_orderkey AS fn_id, 1 AS position, 'supp' || (supp % 5) AS name FROM f UNION ALL SELECT l_orderkey, 2, 'flag' || flag FROM f)
SELECT fn_id, position, name, CASE WHEN name = 'supp' || (o_custkey % 5) THEN 'Type' || o_orderstatus ELSE 'unknown' END AS type FROM fields JOIN orders ON fn_id = o_orderkey
""")
def return_fields(spark, d):
    """SF-17: lines are returns of their orders, some of objects; an order has one typed variable."""
    line = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_suppkey").alias("supp"))
    text = F.concat(F.lit("{\n  supp"), (F.col("supp") % 5).cast("string"), F.lit(": row.supp,\n  flag"), "flag", F.lit(",\n  return: 1,\n  a + b\n}"))
    returns = line.select(F.col("l_orderkey").alias("fn_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("flag") == "N", "{ open").otherwise(text).alias("value"))
    o = _read(spark, d, "orders")
    variables = o.select(F.col("o_orderkey").alias("fn_id"), F.lit(1).alias("ord"), F.concat(F.lit("supp"), (F.col("o_custkey") % 5).cast("string")).alias("name"), F.concat(F.lit("Type"), "o_orderstatus").alias("type"))
    return enrich.return_fields(returns, variables)
