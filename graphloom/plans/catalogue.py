"""The query catalogue: graph operators over the given tables, each with its DuckDB counterpart.

The tables hold no source code, so they stand for graphs: customers are calling
functions, suppliers are called ones, nations services, order lines calls,
event types topics, users files, and pages endpoints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import closure, edges, nest, resolve
from graphloom.saved import Saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tag(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def call_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A call from the order's customer to each line's supplier, by their numbers; the return flag is its kind."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def named(e: DataFrame) -> DataFrame:
    """Numbers as ids, once what is shuffled has been."""
    return e.withColumns({"source": tag("c", "source"), "target": tag("s", "target")})


EDGES = "edges AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Customers by their numbers and suppliers by negative ones, as in called()."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.concat(F.col("c_mktsegment"), F.lit("@"), F.col("c_nationkey").cast("string")).alias("cls"))
    s = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_nationkey").alias("nation"), F.concat(F.lit("Supplier"), (F.col("s_suppkey") % 7).cast("string"), F.lit("@"), F.col("s_nationkey").cast("string")).alias("cls"))
    return c.unionByName(s)


def called(spark: SparkSession, d: str) -> DataFrame:
    return call_numbers(spark, d).select("source", (-F.col("target") - 1).alias("target"))


FUNCTIONS = "functions AS (SELECT 'c' || c_custkey AS id, c_nationkey AS nation, c_mktsegment || '@' || c_nationkey AS cls FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey, 'Supplier' || (s_suppkey % 7) || '@' || s_nationkey FROM supplier)"


def timed(spark: SparkSession, d: str) -> DataFrame:
    """events with their time in microseconds."""
    return table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


TIMED = "timed AS (SELECT *, epoch_us(ts) AS t FROM events)"


@query(f"WITH {EDGES} SELECT source, target, kind, min(ord) AS ord FROM edges GROUP BY 1, 2, 3")
def edge_dedup(spark, d):
    return named(edges.dedup(call_numbers(spark, d)))


@query(f"WITH {EDGES}, n AS (SELECT 's' || s_suppkey AS id FROM supplier), g AS (SELECT n.id, count(e.target) AS degree FROM n LEFT JOIN edges e ON e.target = n.id GROUP BY 1) SELECT id, degree, max(degree) OVER () AS max_degree FROM g")
def in_degree(spark, d):
    return edges.in_degree(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), call_numbers(spark, d)).withColumn("id", tag("s", "id"))


@query(f"WITH {EDGES} SELECT CASE kind WHEN 'A' THEN 'async' WHEN 'R' THEN 'data' ELSE 'sync' END AS class, count(*) AS n FROM edges GROUP BY 1")
def eco_links_class(spark, d):
    kind = F.when(F.col("kind") == "A", "async").when(F.col("kind") == "R", "data").otherwise("sync")
    return call_numbers(spark, d).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


COUPLING = """, p AS (SELECT DISTINCT a.{g} AS s_grp, a.cls AS s_cls, b.{g} AS t_grp, b.cls AS t_cls FROM edges e JOIN functions a ON e.source = a.id JOIN functions b ON e.target = b.id),
x AS (SELECT * FROM p WHERE {w}), o AS (SELECT s_grp AS g, count(DISTINCT t_cls) AS ce FROM x GROUP BY 1), i AS (SELECT t_grp AS g, count(DISTINCT s_cls) AS ca FROM x GROUP BY 1), f AS (SELECT DISTINCT {g} AS g FROM functions)
SELECT f.g AS {n}, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.0::DOUBLE ELSE floor(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) * 100 + 0.5) / 100 END AS instability FROM f LEFT JOIN o ON f.g = o.g LEFT JOIN i ON f.g = i.g"""


@query(f"WITH {EDGES}, {FUNCTIONS}" + COUPLING.format(g="nation", w="s_grp <> t_grp", n="service"))
def service_coupling(spark, d):
    return edges.coupling(called(spark, d), functions(spark, d).withColumnRenamed("nation", "grp"), "service", False)


@query(f"WITH {EDGES}, {FUNCTIONS}" + COUPLING.format(g="cls", w="s_cls <> t_cls", n="class"))
def class_coupling(spark, d):
    return edges.coupling(called(spark, d), functions(spark, d).select("id", F.col("cls").alias("grp"), "cls"), "class", True)


@query("SELECT 'p' || p_partkey AS id, CASE WHEN regexp_matches(p_type, '(?i)(steel|tin)') THEN 'info' ELSE 'warning' END AS level FROM part WHERE NOT regexp_matches(p_brand, '[13]$') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A' AND l_tax > 0.07))")
def unused_functions(spark, d):
    parts = table(spark, d, "part").select(tag("p", "p_partkey").alias("id"), "p_type", "p_brand")
    # a line is a call if its flag and tax say so, as an edge's kind would
    calls = F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.07))
    called = table(spark, d, "lineitem").groupBy("l_partkey").agg(calls.alias("called")).where("called").select(tag("p", "l_partkey").alias("target"))
    return edges.unused(parts, called, F.col("p_brand").rlike("[13]$"), F.col("p_type").rlike("(?i)(steel|tin)"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_locals(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {EDGES} SELECT DISTINCT source, target, kind FROM edges WHERE source NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_edges(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return named(edges.dangling(call_numbers(spark, d), known, "source").select("source", "target", "kind").distinct())


NATIONS = "e AS (SELECT c_nationkey AS source, s_nationkey AS target, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def nation_edges(spark, d):
    """Calls between nations: joins are on numbers, and only what is needed is read."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("kind"))
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    caller = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    called = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target"))
    j = line.join(order.join(caller, "o_custkey"), "l_orderkey").join(called, "l_suppkey")
    return j.select("source", "target", "kind", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query(f"WITH {NATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY ord) AS nth FROM e) SELECT CASE WHEN source = target THEN 'self_loop' ELSE 'duplicate' END AS rule, kind, count(*) AS n FROM r WHERE source = target OR nth > 1 GROUP BY 1, 2")
def self_loops_dups(spark, d):
    # a first edge is no repeat; counts need no window: rows less distinct keys
    e = nation_edges(spark, d).groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))
    loop = F.col("source") == F.col("target")
    n = F.sum(F.when(loop, F.col("n")).otherwise(F.col("n") - 1))
    return e.groupBy(F.when(loop, "self_loop").otherwise("duplicate").alias("rule"), "kind").agg(n.alias("n")).where("n > 0")


RULES = [
    ("endpoint.method", "error", "events", "event_id", "event_type NOT IN ('view', 'click', 'signup', 'purchase')"),
    ("endpoint.value", "warning", "events", "event_id", "value IS NULL OR value < 0"),
    ("database.size", "warning", "part", "p_partkey", "p_size > 45"),
    ("database.name", "error", "part", "p_partkey", "p_name IS NULL OR length(p_name) < 5"),
    ("function.balance", "info", "customer", "c_custkey", "c_acctbal < 0"),
]


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, '{level}' AS level, CAST({key} AS BIGINT) AS node FROM {t} WHERE {cond}" for rule, level, t, key, cond in RULES))
def schema_rules(spark, d):
    out = None
    for rule, level, t, key, cond in RULES:
        found = table(spark, d, t).where(cond).select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.col(key).cast("long").alias("node"))
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT level, count(*) AS n, count(DISTINCT rule) AS rules FROM (" + ORACLES["schema_rules"] + ") GROUP BY 1")
def validation_summary(spark, d):
    return schema_rules(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule").alias("rules"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def stub_endpoints(spark, d):
    # orders of one status stand for edges that leave an endpoint
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT conv_id, arg_max(role, turn) AS last_role, count(*) AS turns FROM conversations GROUP BY 1 HAVING arg_max(role, turn) <> 'assistant'")
def termination_check(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("turns"))
    return last.where("last_role <> 'assistant'").select("conv_id", "last_role", "turns")


SPANS = f"{TIMED}, i AS (SELECT user_id, event_id AS container_id, event_type, t AS low, lead(t, 3) OVER (PARTITION BY user_id ORDER BY t, event_id) AS high FROM timed), c AS (SELECT user_id, container_id, low, high FROM i WHERE event_type IN ('view', 'signup') AND high IS NOT NULL)"


def spans(spark, d):
    e = timed(spark, d).select("user_id", "event_id", "event_type", "t")
    high = F.lead("t", 3).over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return e.withColumn("high", high).where("event_type in ('view', 'signup') and high is not null").select("user_id", F.col("event_id").alias("container_id"), F.col("t").alias("low"), "high", F.col("event_id").alias("ord"))


@query(f"WITH {SPANS}, h AS (SELECT e.event_id AS node_id, c.container_id, high - low AS span, row_number() OVER (PARTITION BY e.event_id ORDER BY high - low, container_id) AS rn FROM timed e JOIN c ON e.user_id = c.user_id AND e.t BETWEEN low AND high WHERE e.event_type = 'error') SELECT node_id, container_id, span FROM h WHERE rn = 1")
def nest_smallest_span(spark, d):
    errors = timed(spark, d).where("event_type = 'error'").select("user_id", F.col("event_id").alias("node_id"), "t")
    return nest.smallest_span(errors, spans(spark, d), "user_id", "t")


@query(f"WITH {SPANS}, h AS (SELECT a.container_id AS id, b.container_id AS parent_id, row_number() OVER (PARTITION BY a.container_id ORDER BY b.high - b.low, b.container_id) AS rn FROM c a JOIN c b ON a.user_id = b.user_id AND b.low < a.low AND b.high >= a.high) SELECT c.container_id AS id, h.parent_id FROM c LEFT JOIN h ON c.container_id = h.id AND rn = 1")
def flow_forest(spark, d):
    return nest.forest(spans(spark, d).select("user_id", F.col("container_id").alias("id"), "low", "high"), "user_id")


@query("SELECT l_orderkey AS parent, l_linenumber AS line, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS position FROM lineitem")
def sorted_children(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("line"), "l_shipdate", "l_partkey", "l_suppkey")
    return nest.positions(rows, "parent", ["l_shipdate", "line", "l_partkey", "l_suppkey"]).select("parent", "line", "position")


@query(f"WITH {SPANS} SELECT event_id FROM timed e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND e.t BETWEEN low AND high)")
def unhandled_awaits(spark, d):
    return nest.outside(timed(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", "t"), spans(spark, d), "user_id", "t").select("event_id")


HANDLERS = f"WITH {TIMED}, h AS (SELECT a.event_id AS throw_id, b.event_id AS catch_id, row_number() OVER (PARTITION BY a.event_id ORDER BY {{order}}) AS rn FROM timed a JOIN timed b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.t > a.t WHERE a.event_type = 'error') SELECT e.event_id AS throw_id, h.catch_id FROM timed e LEFT JOIN h ON e.event_id = h.throw_id AND rn = 1 WHERE e.event_type = 'error'"


def flows(spark, d, nearest):
    e = timed(spark, d)
    throws = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("throw_id"), F.col("t").alias("at"))
    return nest.handlers(throws, e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("catch_id"), F.col("t").alias("at"), F.col("event_id").alias("ord")), "user_id", nearest)


@query(HANDLERS.format(order="b.event_id"))
def error_flow_first(spark, d):
    return flows(spark, d, False)


@query(HANDLERS.format(order="b.t, b.event_id"))
def error_flow_nearest(spark, d):
    return flows(spark, d, True)


@query("SELECT count(*) AS endpoints_total, count(*) FILTER (event_type = 'error') AS throws_total, count(*) FILTER (event_type = 'purchase') AS db_total, count(*) FILTER (value > 50) AS with_logs, count(DISTINCT user_id) AS services, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS traced_services, 0 AS db_with_spans, 0 AS screens FROM events")
def coverage(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    return e.agg(F.count(F.lit(1)).alias("endpoints_total"), F.count_if(kind == "error").alias("throws_total"), F.count_if(kind == "purchase").alias("db_total"), F.count_if(F.col("value") > 50).alias("with_logs"), F.countDistinct("user_id").alias("services"), F.countDistinct(F.when(kind == "signup", F.col("user_id"))).alias("traced_services"), F.lit(0).alias("db_with_spans"), F.lit(0).alias("screens"))


@query("SELECT n_name AS service, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS endpoints, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS functions FROM nation")
def summary_counts(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("endpoints"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("functions"))
    n = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select(F.col("n_name").alias("service"), F.coalesce("endpoints", F.lit(0)).cast("long").alias("endpoints"), F.coalesce("functions", F.lit(0)).cast("long").alias("functions"))


@query("""WITH f AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS kind FROM part WHERE p_size > 25), a AS (SELECT name, max(id) AS id FROM f GROUP BY 1), b AS (SELECT brand, kind, min(id) AS id FROM f GROUP BY 1, 2), c AS (SELECT kind, min(id) AS id FROM f GROUP BY 1)
SELECT p_partkey AS call_id, coalesce(a.id, b.id, c.id) AS resolved_to, CASE WHEN a.id IS NOT NULL THEN 'name' WHEN b.id IS NOT NULL THEN 'class' WHEN c.id IS NOT NULL THEN 'method' ELSE 'none' END AS strategy
FROM part LEFT JOIN a ON p_name = a.name LEFT JOIN b ON p_brand = b.brand AND p_type = b.kind LEFT JOIN c ON p_type = c.kind""")
def call_resolution(spark, d):
    part = table(spark, d, "part")
    f = part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat_ws("|", "p_brand", "p_type").alias("member"), F.col("p_type").alias("method"))
    calls = part.select(F.col("p_partkey").alias("call_id"), F.col("p_name").alias("c_name"), F.concat_ws("|", "p_brand", "p_type").alias("c_member"), F.col("p_type").alias("c_method"))
    found = resolve.by_priority(calls, [(resolve.last_wins(f, "name"), "c_name", "name", "name"), (resolve.first_wins(f, "member"), "c_member", "member", "class"), (resolve.first_wins(f, "method"), "c_method", "method", "method")])
    return found.select("call_id", "resolved_to", "strategy")


@query("WITH f AS (SELECT string_split(p_name, ' ')[-1] AS last, min(p_partkey) AS id FROM part WHERE p_size < 10 GROUP BY 1) SELECT p_partkey AS endpoint_id, f.id AS handler_fn_id FROM part LEFT JOIN f ON string_split(p_name, ' ')[-1] = f.last")
def handler_link(spark, d):
    part = table(spark, d, "part").withColumn("last", F.substring_index("p_name", " ", -1))
    first = part.where("p_size < 10").groupBy("last").agg(F.min("p_partkey").alias("handler_fn_id"))
    return part.join(first, "last", "left").select(F.col("p_partkey").alias("endpoint_id"), "handler_fn_id")


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), f AS (SELECT string_split(path, '/')[-1] AS stem, min(page_id) AS id FROM p GROUP BY 1) SELECT page_id, f.id AS owner FROM p JOIN f ON string_split(path, '/')[-1] = f.stem")
def import_suffix(spark, d):
    # a suffix of whole segments is an equal last segment: a hash join, where a test of every pair would be quadratic
    p = table(spark, d, "pages").select("page_id", F.substring_index(X.url_path(F.col("url")), "/", -1).alias("stem"))
    owner = p.groupBy("stem").agg(F.min("page_id").alias("owner"))
    return p.join(owner, "stem").select("page_id", "owner")


@query("WITH k AS (SELECT p_brand AS cls, max(p_partkey) AS id FROM part GROUP BY 1) SELECT p_partkey AS source, k.id AS target FROM part JOIN k ON p_brand = k.cls WHERE p_partkey <> k.id")
def ctor_last_wins(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    ctor = resolve.last_wins(part.select(F.col("p_brand").alias("cls"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord")), "cls")
    return part.join(ctor, F.col("p_brand") == F.col("cls")).where("p_partkey <> id").select(F.col("p_partkey").alias("source"), F.col("id").alias("target"))


TOPICS = "m AS (SELECT event_type AS topic, list_sort(list(DISTINCT user_id) FILTER (value > 50)) AS producers, list_sort(list(DISTINCT user_id) FILTER (value <= 50)) AS consumers FROM events GROUP BY 1)"


def topic_users(spark, d, which: str) -> DataFrame:
    """(topic, user_id) once each, of the events where `which` holds."""
    return table(spark, d, "events").where(which).where("user_id is not null").select(F.col("event_type").alias("topic"), "user_id").distinct()


@query(f"WITH {TOPICS} SELECT topic, array_to_string(producers, ',') AS producers, array_to_string(consumers, ',') AS consumers FROM m")
def topic_merge(spark, d):
    """A topic's producers and consumers as lists, for output; topic_edges has them as rows."""
    who = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("user_id")))).cast("array<string>"), ",")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(who(F.col("value") > 50).alias("producers"), who(F.col("value") <= 50).alias("consumers"))


@query(f"WITH {TOPICS} SELECT 'u' || unnest(producers) AS source, 'broker' AS target, 'publishes_to' AS kind, topic FROM m UNION ALL SELECT 'broker', 'u' || unnest(consumers), 'consumes_from', topic FROM m")
def topic_edges(spark, d):
    """From distinct rows and not from lists, which grow with their topic."""
    user, broker = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("broker")
    out = topic_users(spark, d, "value > 50").select(user.alias("source"), broker.alias("target"), F.lit("publishes_to").alias("kind"), "topic")
    return out.unionByName(topic_users(spark, d, "value <= 50").select(broker.alias("source"), user.alias("target"), F.lit("consumes_from").alias("kind"), "topic"))


@query("SELECT p_brand AS alias, lower(p_type) AS name, arg_min(p_name, p_partkey) AS entity, bool_or(p_size > 40) AS has_timestamps, count(*) AS merged FROM part GROUP BY 1, 2")
def table_merge(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("alias"), F.lower("p_type").alias("name")).agg(F.min_by("p_name", "p_partkey").alias("entity"), F.bool_or(F.col("p_size") > 40).alias("has_timestamps"), F.count(F.lit(1)).alias("merged"))


@query("SELECT DISTINCT p_brand AS alias, 'found' AS origin FROM part WHERE p_size > 45 UNION ALL SELECT DISTINCT p_brand, 'hint' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)")
def hint_insert_absent(spark, d):
    part = table(spark, d, "part")
    found = part.where("p_size > 45").select(F.col("p_brand").alias("alias")).distinct()
    hints = part.select(F.col("p_brand").alias("alias")).distinct().join(found, "alias", "left_anti")
    return found.withColumn("origin", F.lit("found")).unionByName(hints.withColumn("origin", F.lit("hint")))


PATH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({p}, '\\{{[^}}]+\\}}', ':param', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', ':param', 'g'), '/+', '/', 'g'), '/$', '', 'g')"


@query("WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/[0-9]+', '/{id}', 'g') AS path, url FROM pages) SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS origin, CASE WHEN " + PATH.format(p="path") + " = '' THEN '/' ELSE " + PATH.format(p="path") + " END AS path FROM p")
def normalize_path(spark, d):
    path = F.regexp_replace(X.url_path(F.col("url")), "/[0-9]+", "/{id}")
    return table(spark, d, "pages").select("page_id", X.origin(F.col("url")).alias("origin"), X.normalize_http_path(path).alias("path"))


@query("SELECT page_id, array_to_string(regexp_extract_all('/x/:a' || (page_id % 7) || '/:b_' || (page_id % 3) || '/c', ':([A-Za-z_][A-Za-z0-9_]*)', 1), ',') AS params FROM pages")
def path_params(spark, d):
    path = F.concat(F.lit("/x/:a"), (F.col("page_id") % 7).cast("string"), F.lit("/:b_"), (F.col("page_id") % 3).cast("string"), F.lit("/c"))
    return table(spark, d, "pages").select("page_id", F.array_join(X.path_params(path), ",").alias("params"))


@query("SELECT s_suppkey, 'function:' || left(sha1(s_nationkey || ':' || s_name || ':' || coalesce(nullif(s_suppkey % 3, 0)::VARCHAR, '')), 8) AS id FROM supplier")
def make_id(spark, d):
    line = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 3)
    return table(spark, d, "supplier").select("s_suppkey", X.make_id("function", F.col("s_nationkey"), F.col("s_name"), line).alias("id"))


@query("SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g')) AS kebab, regexp_replace(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS snake, array_to_string(list_transform(regexp_split_to_array(p_name, '[^A-Za-z0-9]+'), lambda w: upper(left(w, 1)) || substring(w, 2)), '') AS pascal FROM part")
def case_convert(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.kebab(n).alias("kebab"), X.snake(n).alias("snake"), X.pascal(n).alias("pascal"))


@query("SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g')), 300) AS prompt FROM documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sanitize(F.col("text")).alias("prompt"))


@query("SELECT event_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN '[redacted]' ELSE left(props, 500) END AS value FROM events")
def redact_context(spark, d):
    key = F.when(F.col("event_id") % 2 == 0, F.lit("apiKey")).otherwise(F.lit("props"))
    m = X.redact(F.create_map(key, F.col("props")))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.element_at(F.map_values(m), 1).alias("value"))


LOG_SQL = r"""
SELECT conv_id, turn, CASE
    WHEN role = 'user' AND regexp_matches(lower(text), 'auth|unauthorized|forbidden') THEN 'security'
    WHEN role = 'user' THEN 'error'
    WHEN regexp_matches(lower(text), 'request|incoming|received|req') THEN 'request'
    WHEN regexp_matches(lower(text), 'response|respond|reply|res') THEN 'response'
    WHEN regexp_matches(lower(text), 'error|exception|fail|crash') THEN 'error'
    WHEN regexp_matches(lower(text), 'performance|duration|latency|took|elapsed|ms') THEN 'performance'
    WHEN regexp_matches(lower(text), 'auth|login|logout|token|jwt|session|permission|role') THEN 'security'
    WHEN regexp_matches(lower(text), 'start|stop|ready|boot|shutdown|connect|disconnect') THEN 'lifecycle'
    WHEN regexp_matches(lower(text), 'metric|trace|span|otel') THEN 'performance'
    ELSE 'general' END AS category
FROM conversations
"""


@query(LOG_SQL)
def log_category(spark, d):
    """Turns of users stand for messages of level error, others for info."""
    level = F.when(F.col("role") == "user", "error").otherwise("info")
    return table(spark, d, "conversations").select("conv_id", "turn", X.log_category(F.col("text"), level).alias("category"))


STATUS_SQL = """
WITH n AS (
  SELECT event_id, (['BadRequestException', 'ValidationError', 'UnauthorizedException', 'HttpException', 'ForbiddenException', 'NotFoundError',
    'ConflictException', 'UnprocessableEntityException', 'AuthenticationError', 'AuthorizationError', 'InternalServerErrorException',
    'NotImplementedException', 'ServiceUnavailableException', 'NotFoundException', 'TimeoutError'])[event_id % 15 + 1] AS name
  FROM events WHERE event_type = 'error'
)
SELECT event_id, CASE
    WHEN name IN ('BadRequestException', 'ValidationError', 'HttpException') THEN 400
    WHEN name IN ('UnauthorizedException', 'AuthenticationError') THEN 401
    WHEN name IN ('ForbiddenException', 'AuthorizationError') THEN 403
    WHEN name IN ('NotFoundException', 'NotFoundError') THEN 404
    WHEN name = 'ConflictException' THEN 409 WHEN name = 'UnprocessableEntityException' THEN 422
    WHEN name = 'InternalServerErrorException' THEN 500 WHEN name = 'NotImplementedException' THEN 501
    WHEN name = 'ServiceUnavailableException' THEN 503 END AS status
FROM n
"""
ERRORS = ["BadRequestException", "ValidationError", "UnauthorizedException", "HttpException", "ForbiddenException", "NotFoundError", "ConflictException", "UnprocessableEntityException", "AuthenticationError", "AuthorizationError", "InternalServerErrorException", "NotImplementedException", "ServiceUnavailableException", "NotFoundException", "TimeoutError"]


@query(STATUS_SQL)
def http_status_map(spark, d):
    """Error events stand for throws of classes in turn."""
    name = F.get(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % len(ERRORS)).cast("int"))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", X.error_status(name).alias("status"))


#: Marks of frameworks, tried in this order, and of databases, all of which count.
FRAMEWORKS = [("nest", "STEEL"), ("express", "BRASS"), ("fastify", "TIN")]
HINTS = [("postgres", "LARGE"), ("mongo", "SMALL"), ("redis", "PROMO"), ("mysql", "STANDARD")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_type, '{m}') THEN '{f}'" for f, m in FRAMEWORKS) + " ELSE 'unknown' END AS framework, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(p_type, '{m}') THEN '{h}' END" for h, m in HINTS) + "], lambda x: x IS NOT NULL), ',') AS hints FROM part")
def stack_detect(spark, d):
    first = F
    for name, mark in FRAMEWORKS:
        first = first.when(F.col("p_type").contains(mark), name)
    every = F.array_compact(F.array(*[F.when(F.col("p_type").contains(m), F.lit(h)) for h, m in HINTS]))
    return table(spark, d, "part").select("p_partkey", first.otherwise("unknown").alias("framework"), F.array_join(every, ",").alias("hints"))


SQLS = "CASE o_orderkey % 4 WHEN 0 THEN 'SELECT * FROM ' WHEN 1 THEN 'insert into \"' WHEN 2 THEN 'UPDATE ' ELSE 'delete from `' END || o_orderstatus || '_' || (o_orderkey % 9) || ' WHERE x = 1'"


@query(f"WITH s AS (SELECT o_orderkey, {SQLS} AS sql FROM orders) SELECT o_orderkey, CASE lower(regexp_extract(sql, '^\\s*([A-Za-z]+)', 1)) WHEN 'select' THEN 'findMany' WHEN 'insert' THEN 'create' WHEN 'update' THEN 'update' WHEN 'delete' THEN 'delete' ELSE 'raw' END AS operation, lower(regexp_extract(sql, '(?i)(?:FROM|INTO|UPDATE|JOIN)\\s+[\"`]?([A-Za-z0-9_]+)', 1)) AS tbl FROM s")
def raw_sql_sniff(spark, d):
    op, tbl = X.sniff_sql(F.col("sql"))
    return table(spark, d, "orders").withColumn("sql", F.expr(SQLS)).select("o_orderkey", op.alias("operation"), tbl.alias("tbl"))


@query("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS fields, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_shape(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("fields"), F.get_json_object("props", "$.k").cast("long").alias("k"))


CANDIDATES = "p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS service, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/[0-9]+', '/:param', 'g') AS path, page_id % 3 AS n_params, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, html FROM pages), found AS (SELECT c.page_id AS call_id, e.page_id AS endpoint_id, least(100, 60 + CASE WHEN c.n_params = e.n_params THEN 20 ELSE 0 END + CASE WHEN contains(c.html, e.service) THEN 20 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM p c JOIN p e ON c.method = e.method AND c.path = e.path AND c.service <> e.service)"


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1).alias("service"), F.regexp_replace(X.url_path(F.col("url")), "/[0-9]+", "/:param").alias("path"), (F.col("page_id") % 3).alias("n_params"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"), "html")


def page_groups(spark, d):
    """Every page is a call, and an endpoint for the pages of other hosts."""
    p = pages(spark, d)
    named = F.col("html").contains(F.col("target_service"))
    return p, resolve.candidate_groups(p.withColumnRenamed("page_id", "id"), p.withColumnRenamed("page_id", "id"), named)


@query(f"WITH {CANDIDATES}, s AS (SELECT call_id, confidence, service FROM found JOIN p ON endpoint_id = page_id) SELECT call_id, service AS target_service, count(*) AS n, max(confidence) AS best FROM s GROUP BY 1, 2")
def resolve_candidates(spark, d):
    """JN-14: candidates of each call by service, counted; pairs of calls and endpoints aren't listed."""
    return page_groups(spark, d)[1].select(F.col("id").alias("call_id"), "target_service", "n", "best")


@query(f"WITH {CANDIDATES}, n AS (SELECT call_id, count(*) AS n, max(confidence) AS best FROM found GROUP BY 1) SELECT p.page_id AS call_id, coalesce(n, 0) AS n_candidates, CASE WHEN n IS NULL THEN 'unresolvable' WHEN n = 1 AND best >= 0.95 THEN 'resolved' ELSE 'pending_review' END AS status FROM p LEFT JOIN n ON p.page_id = n.call_id")
def resolve_status(spark, d):
    """RS-2 without an oracle."""
    p, groups = page_groups(spark, d)
    calls = p.select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("endpoint_id"))
    return resolve.resolution(calls, groups).select(F.col("id").alias("call_id"), "n_candidates", "status")


@query("SELECT d.doc_id AS call_id, CASE WHEN l.toxic = 1 THEN 'unresolvable' WHEN l.quality = 1 THEN 'resolved' WHEN l.quality = 0 THEN 'skipped' ELSE 'pending_review' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def apply_decisions(spark, d):
    s = F.when(F.col("toxic") == 1, "unresolvable").when(F.col("quality") == 1, "resolved").when(F.col("quality") == 0, "skipped").otherwise("pending_review")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("call_id"), s.alias("status"))


@query(f"WITH {NATIONS} SELECT source AS service, target, count(DISTINCT kind) AS kinds, array_to_string(list_sort(list(DISTINCT kind)), ',') AS via FROM e WHERE source <> target GROUP BY 1, 2")
def resolved_deps(spark, d):
    via = nation_edges(spark, d).where("source <> target").groupBy(F.col("source").alias("service"), "target").agg(F.array_sort(F.collect_set("kind")).alias("via"))
    return via.select("service", "target", F.size("via").cast("long").alias("kinds"), F.array_join("via", ",").alias("via"))


@query("SELECT c_custkey AS id, c_name AS name, count(*) OVER () AS total FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING' ORDER BY id LIMIT 20 OFFSET 10")
def topology_list(spark, d):
    hit = table(spark, d, "customer").where(F.lower("c_name").contains("1") & (F.col("c_mktsegment") == "BUILDING")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("id").offset(10).limit(20).crossJoin(F.broadcast(total))  # one row


@query("SELECT o_custkey AS key, max(o_orderkey) AS stored, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def eco_upsert(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("stored"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


@query(f"WITH {NATIONS} SELECT 'service' AS part, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'database', count(*) FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'edge', count(*) FROM e WHERE source <> 3 AND target <> 3")
def eco_delete(spark, d):
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return count(table(spark, d, "nation").where("n_nationkey <> 3"), "service").unionByName(count(table(spark, d, "customer").where("c_nationkey <> 3"), "database")).unionByName(count(nation_edges(spark, d).where("source <> 3 and target <> 3"), "edge"))


STEPS = "g AS (SELECT DISTINCT l_suppkey AS source, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS target FROM lineitem), e AS (SELECT source, target FROM g WHERE target IS NOT NULL AND source <> target)"


def supplier_steps(lines: DataFrame) -> DataFrame:
    """An edge from a line's supplier to that of the order's next line, among the lines given."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    return lines.select(F.col("l_suppkey").alias("source"), F.lead("l_suppkey").over(w).alias("target")).where("target is not null and source <> target").distinct()


@query(f"WITH RECURSIVE {STEPS}, r(root, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.root, e.target FROM r JOIN e ON r.node = e.source) SELECT root, bool_or(s_acctbal < 0) AS can_throw, count(*) AS reached, count(DISTINCT s_nationkey) FILTER (s_acctbal < 0) AS statuses FROM r JOIN supplier ON node = s_suppkey GROUP BY 1")
def reach_can_throw(spark, d):
    """GR-3, GR-4 from every supplier, over the steps of every line: the dense part of the graph is merged first."""
    return reached(table(spark, d, "supplier"), supplier_steps(table(spark, d, "lineitem")), Saved(spark).save)


def reached(s: DataFrame, steps: DataFrame, save) -> DataFrame:
    """(root, can_throw, reached, statuses) of every supplier."""
    steps, bad = save(steps, "edges"), F.col("s_acctbal") < 0
    knot, between = closure.contract(steps, save)
    s = s.join(knot, F.col("s_suppkey") == F.col("node"), "left").select("s_suppkey", F.coalesce("part", "s_suppkey").alias("part"), bad.alias("bad"), F.when(bad, F.col("s_nationkey")).alias("status"))
    s = save(s, "suppliers")
    near = closure.reach(s.select(F.col("part").alias("id")).distinct(), between, save)
    facts = s.groupBy("part", "bad", "status").agg(F.count(F.lit(1)).alias("n"))
    found = near.join(facts, F.col("node") == F.col("part")).groupBy("root").agg(F.bool_or("bad").alias("can_throw"), F.sum("n").alias("reached"), F.countDistinct("status").alias("statuses"))
    return s.join(found, F.col("part") == F.col("root")).select(F.col("s_suppkey").alias("root"), "can_throw", "reached", "statuses")


@query(f"WITH {STEPS}, a AS (SELECT source AS root, target AS node FROM e), b AS (SELECT DISTINCT a.root, e.target AS node FROM a JOIN e ON a.node = e.source WHERE e.target <> a.root AND (a.root, e.target) NOT IN (SELECT root, node FROM a)), u AS (SELECT root, node, 1 AS depth FROM a UNION ALL SELECT root, node, 2 FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS line FROM u) SELECT root, node, depth, CAST(line AS INTEGER) AS line FROM k WHERE line <= 30")
def flow_summary(spark, d):
    """GR-6, TK-2 over the steps of every line."""
    folder = Saved(spark)
    return summary(folder.save(supplier_steps(table(spark, d, "lineitem")), "edges"), folder.save)


def summary(e: DataFrame, save, lines: int = 30) -> DataFrame:
    """The first `lines` nodes of each root by depth, up to 2; depth 2 counts only for roots with fewer nodes at depth 1, so only these are followed."""
    few = e.groupBy(F.col("source").alias("id")).count().where(F.col("count") < lines).select("id")
    far = closure.reach(few, e, save, most=2).where("depth = 2")
    near = e.select(F.col("source").alias("root"), F.col("target").alias("node"), F.lit(1).alias("depth")).unionByName(far)
    return resolve.top(near, "root", ["depth", "node"], lines).select("root", "node", "depth", F.col("rank").alias("line"))


@query(f"WITH {TIMED}, k AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS rn FROM timed) SELECT user_id, event_type, event_id FROM k WHERE rn = 1")
def responses_first(spark, d):
    best = timed(spark, d).groupBy("user_id", "event_type").agg(F.min(F.struct("t", "event_id")).alias("b"))
    return best.select("user_id", "event_type", F.col("b.event_id").alias("event_id"))


@query("SELECT DISTINCT user_id, event_type, value > 50 AS high FROM events")
def outcomes_distinct(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", (F.col("value") > 50).alias("high")).distinct()


@query(f"WITH {TIMED}, g AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM timed) SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS body FROM g GROUP BY 1, 2")
def loop_groups(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    g = timed(spark, d).withColumn("grp", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w))
    return g.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("body"))


@query("WITH f AS (SELECT conv_id, min(turn) AS stop FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, c.turn, c.role FROM conversations c LEFT JOIN f ON c.conv_id = f.conv_id WHERE stop IS NULL OR c.turn <= stop")
def truncate_at_return(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    stop = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("stop"))
    return c.join(stop, "conv_id", "left").where("stop is null or turn <= stop").select("conv_id", "turn", "role")


GRID = "g AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


def grid(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", "p_brand", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


@query(f"WITH {GRID}, c AS (SELECT *, ceil(n / greatest(1, least(4, ceil(n / 24.0)))) AS per_col FROM g) SELECT p_partkey, CAST(floor(i / per_col) AS INTEGER) AS col, CAST(i % per_col AS INTEGER) AS row FROM c")
def grid_layout(spark, d):
    per = F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(F.col("n") / 24.0))))
    return grid(spark, d).select("p_partkey", F.floor(F.col("i") / per).cast("int").alias("col"), (F.col("i") % per).cast("int").alias("row"))


@query(f"WITH {GRID} SELECT p_brand, p_partkey FROM g WHERE i = floor(n / 2)")
def median_rep(spark, d):
    return grid(spark, d).where(F.col("i") == F.floor(F.col("n") / 2)).select("p_brand", "p_partkey")


@query("WITH s AS (SELECT l_partkey AS part, l_suppkey AS supplier, count(*) AS score FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, supplier) AS rank FROM s) SELECT part, supplier, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def topk_candidates(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("score"))
    return resolve.top(s, "part", [F.desc("score"), "supplier"], 3)


@query("SELECT p_partkey, p_brand, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 8) AS INTEGER) AS batch FROM part")
def batches(spark, d):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_brand", F.floor((n - 1) / 8).cast("int").alias("batch"))


@query("SELECT 'n' || c_nationkey AS source, 'c' || c_custkey AS target, 'CONTAINS' AS kind, 'customer' AS label FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CONTAINS', 'order' FROM orders UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '.' || l_linenumber, 'CONTAINS', 'line' FROM lineitem")
def flatten_graph(spark, d):
    row = lambda df, a, b, label: df.select(a.alias("source"), b.alias("target"), F.lit("CONTAINS").alias("kind"), F.lit(label).alias("label"))
    c = row(table(spark, d, "customer"), tag("n", "c_nationkey"), tag("c", "c_custkey"), "customer")
    o = row(table(spark, d, "orders"), tag("c", "o_custkey"), tag("o", "o_orderkey"), "order")
    line = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return c.unionByName(o).unionByName(row(table(spark, d, "lineitem"), tag("o", "l_orderkey"), line, "line"))
