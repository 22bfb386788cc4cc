"""Endpoints and services as Markdown, and graphs as draw.io files: one text a document, put together by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table(header: list[str], rows: Column) -> Column:
    """A Markdown table of an array of arrays of text; pipes are escaped."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    head = F.lit("| " + " | ".join(header) + " |\n|" + "---|" * len(header))
    return F.concat_ws("\n", head, F.array_join(F.transform(rows, line), "\n"))


def endpoint_pages(endpoints: DataFrame, responses: DataFrame, uses: DataFrame, parameters: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """(id, markdown) of endpoints(id, method, path), with parameters(endpoint, ord, name, place) in order, responses(endpoint, status, type) by status, uses(endpoint, table, operations) by table, and the text of flows(root, text)."""
    r = responses.groupBy(F.col("endpoint").alias("id")).agg(F.array_sort(F.collect_list(F.struct("status", "type"))).alias("r"))
    u = uses.groupBy(F.col("endpoint").alias("id")).agg(F.array_sort(F.collect_list(F.struct("table", "operations"))).alias("u"))
    x = endpoints.join(r, "id", "left").join(u, "id", "left")
    none = F.array().cast("array<struct<ord:int,name:string,place:string>>")
    p = parameters.groupBy(F.col("endpoint").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "name", "place"))).alias("p")) if parameters is not None else None
    x = x.join(p, "id", "left") if p is not None else x.withColumn("p", none)
    x = x.join(flows.select(F.col("root").alias("id"), F.col("text").alias("flow")), "id", "left") if flows is not None else x.withColumn("flow", F.lit(None).cast("string"))
    given = F.transform("p", lambda s: F.array(s["name"], s["place"]))
    flow = F.when(F.coalesce("flow", F.lit("")) != "", F.concat(F.lit("\n## Flow\n\n```\n"), "flow", F.lit("\n```")))
    answers = F.transform("r", lambda s: F.array(s["status"].cast("string"), s["type"]))
    tables = F.transform("u", lambda s: F.array(s["table"], F.array_join(s["operations"], ", ")))
    title = F.concat(F.lit("# "), F.coalesce("method", F.lit("?")), F.lit(" "), F.coalesce("path", F.lit("?")))
    part = lambda name, header, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n## {name}\n\n"), table(header, rows)))
    return x.select("id", F.concat_ws("\n", title, part("Parameters", ["Name", "In"], given), part("Responses", ["Status", "By"], answers), part("Data", ["Table", "Operations"], tables), flow).alias("markdown"))


def service_pages(services: DataFrame, endpoints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(id, markdown) of services(id, name, kind), with endpoints(service_id, method, path) and dependencies(service, target, target_kind)."""
    e = endpoints.groupBy(F.col("service_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "method"))).alias("e"))
    d = dependencies.groupBy(F.col("service").alias("id")).agg(F.array_sort(F.collect_set(F.struct("target", "target_kind"))).alias("d"))
    x = services.join(e, "id", "left").join(d, "id", "left")
    part = lambda name, header, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n## {name}\n\n"), table(header, rows)))
    ends = F.transform("e", lambda s: F.array(s["method"], s["path"]))
    deps = F.transform("d", lambda s: F.array(s["target"], s["target_kind"]))
    return x.select("id", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("name", "id")), part("Endpoints", ["Method", "Path"], ends), part("Dependencies", ["On", "Kind"], deps)).alias("markdown"))


def grid(nodes: DataFrame, group: str, order: list[str], per_column: int = 24, most: int = 4) -> DataFrame:
    """nodes with row and col: columns of a group are as many as its nodes need, within 1 and `most`, filled one after the other."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    columns = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(n / per_column)))
    deep = F.ceil(n / columns)
    i = F.row_number().over(w.orderBy(*order)) - 1
    return nodes.withColumn("col", F.floor(i / deep).cast("int")).withColumn("row", (i % deep).cast("int"))


def drawio(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, xml): nodes(group, id, label, row, col) as boxes and edges(group, source, target) as arrows."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    box = F.format_string('<mxCell id="%s" value="%s" style="rounded=1" vertex="1" parent="1"><mxGeometry x="%d" y="%d" width="160" height="40" as="geometry"/></mxCell>', esc(F.col("id")), esc(F.col("label")), F.col("col") * 200, F.col("row") * 60)
    arrow = F.format_string('<mxCell id="%s" edge="1" parent="1" source="%s" target="%s"><mxGeometry relative="1" as="geometry"/></mxCell>', F.concat(F.lit("e:"), F.left(F.sha1(F.concat_ws(":", "source", "target")), F.lit(8))), esc(F.col("source")), esc(F.col("target")))
    cells = nodes.select(group, F.lit(0).alias("_o"), "id", box.alias("_c")).unionByName(edges.select(group, F.lit(1).alias("_o"), F.concat("source", "target").alias("id"), arrow.alias("_c")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "id", "_c"))), lambda c: c["_c"]), "")
    head = F.lit('<mxfile><diagram name="graph"><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>')
    return cells.groupBy(group).agg(F.concat(head, body, F.lit("</root></mxGraphModel></diagram></mxfile>")).alias("xml"))
