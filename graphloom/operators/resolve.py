"""Resolution: call targets by priority, cross-service candidates, confidence and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_priority(calls: DataFrame, targets: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """calls with resolved_to and strategy: of (table, call column, table key, name) the first that knows the call. Tables have one row a key."""
    out, found, names = calls, [], []
    for k, (table, column, key, name) in enumerate(targets):
        t = table.select(F.col(key).alias(f"_k{k}"), F.col("id").alias(f"_r{k}"))
        out = out.join(t, F.col(column) == F.col(f"_k{k}"), "left")
        found.append(F.col(f"_r{k}"))
        names.append(F.when(F.col(f"_r{k}").isNotNull(), F.lit(name)))
    return out.withColumn("resolved_to", F.coalesce(*found)).withColumn("strategy", F.coalesce(*names, F.lit("none"))).select(*calls.columns, "resolved_to", "strategy")


def last_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """(key, id) of the largest order, like a map that later entries overwrite."""
    return df.groupBy(key).agg(F.max(F.struct(order, "id")).alias("b")).select(key, F.col("b.id").alias("id"))


def first_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return df.groupBy(key).agg(F.min(F.struct(order, "id")).alias("b")).select(key, F.col("b.id").alias("id"))


#: A single candidate of this confidence is taken; parts of a confidence in hundredths.
CERTAIN, BASE, SAME_PARAMS, NAMED = 0.95, 60, 20, 20


def candidate_groups(calls: DataFrame, endpoints: DataFrame, named: Column) -> DataFrame:
    """(calls' columns, target_service, n, best, endpoint_id): for each call of calls(method, path, service, n_params, ...) and other service with endpoints(id, service, method, path, n_params) of its method and path: how many these are, the best confidence and the first endpoint of it. `named` may use calls' columns and target_service.

    Endpoints are counted by service and number of parameters before the join, so a
    path that everyone has, like `/`, gives a row for each call and service, not for
    each pair of a call and an endpoint.
    """
    groups = endpoints.groupBy("method", "path", F.col("service").alias("target_service"), F.col("n_params").alias("e_params")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first"))
    groups = groups.groupBy("method", "path", "target_service").agg(F.sum("k").alias("n"), F.min("first").alias("first"), F.map_from_entries(F.collect_list(F.struct("e_params", "first"))).alias("by_params"))
    hit = calls.join(groups, ["method", "path"]).where("service <> target_service")
    same = F.element_at("by_params", F.col("n_params"))
    score = F.lit(BASE) + F.when(same.isNotNull(), SAME_PARAMS).otherwise(0) + F.when(named, NAMED).otherwise(0)
    own = [c for c in calls.columns if c != "endpoint_id"]
    return hit.select(*own, "target_service", "n", (F.least(F.lit(100), score) / 100.0).alias("best"), F.coalesce(same, F.col("first")).alias("endpoint_id"))


def resolution(calls: DataFrame, groups: DataFrame, oracle: DataFrame | None = None, certain: float = CERTAIN) -> DataFrame:
    """(id, n_candidates, status, endpoint_id, confidence) of every call: what is resolved stays; no candidate is unresolvable; one of at least `certain` is resolved; else what oracle(id, endpoint_id, sure) says if it is sure, and if not it waits."""
    one = groups.groupBy("id").agg(F.sum("n").alias("n"), F.max(F.struct("best", "endpoint_id")).alias("b"))
    x = calls.select("id", F.col("status").alias("was"), F.col("endpoint_id").alias("had")).join(one, "id", "left")
    if oracle is None:
        x = x.withColumn("told", F.lit(None).cast("string"))
    else:
        x = x.join(oracle.where("sure").select("id", F.col("endpoint_id").alias("told")), "id", "left")
    done = F.col("was") == "resolved"
    alone = (F.col("n") == 1) & (F.col("b.best") >= certain)
    status = F.when(done, "resolved").when(F.col("n").isNull(), "unresolvable").when(alone | F.col("told").isNotNull(), "resolved").otherwise("pending_review")
    endpoint = F.when(done, F.col("had")).when(F.col("n").isNotNull(), F.when(alone, F.col("b.endpoint_id")).otherwise(F.col("told")))
    return x.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), status.alias("status"), endpoint.alias("endpoint_id"), F.col("b.best").alias("confidence"))


def pending(calls: DataFrame, decided: DataFrame, groups: DataFrame, most: int = 20) -> DataFrame:
    """(id, service, method, path, candidates): of calls that wait the best `most` candidates, best first."""
    wait = decided.where("status = 'pending_review'").select("id")
    g = groups.join(wait, "id", "left_semi")
    g = top(g, "id", [F.desc("best"), "target_service"], most)
    lists = g.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("endpoint_id", "target_service", F.col("best").alias("confidence")).alias("c")))), lambda x: x["c"]).alias("candidates"))
    return calls.select("id", "service", "method", "path").join(lists, "id")


def both_ways(new: DataFrame, old_endpoints: DataFrame, old_calls: DataFrame, new_endpoints: DataFrame, named: Column) -> DataFrame:
    """Candidates of new calls among stored endpoints, and of stored calls that wait among new endpoints."""
    one = candidate_groups(new, old_endpoints, named)
    two = candidate_groups(old_calls.where("status in ('pending_review', 'unresolvable')").select(*new.columns), new_endpoints, named)
    return one.unionByName(two)


def candidates(calls: DataFrame, endpoints: DataFrame, bonus: Column) -> DataFrame:
    """Endpoints of other services with the call's method and path, with a confidence of 0.6, 0.2 for as many parameters and 0.2 for `bonus`: all pairs, for where these are wanted; candidate_groups() counts them."""
    e = endpoints.select(F.col("id").alias("endpoint_id"), F.col("service").alias("target_service"), "method", "path", F.col("n_params").alias("e_params"))
    hit = calls.join(e, ["method", "path"]).where("service <> target_service")
    score = F.lit(60) + F.when(F.col("n_params") == F.col("e_params"), 20).otherwise(0) + F.when(bonus, 20).otherwise(0)
    return hit.withColumn("confidence", F.least(F.lit(100), score) / 100.0)


def top(found: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
