"""A catalog of stored topologies, sessions of pending decisions, and what queries ask of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page, minutes that a session lasts.
PAGE, SESSION = 20, 30
STORED = "id string, name string, source string, tags array<string>, created_at timestamp, updated_at timestamp, path string"


def find(stored: DataFrame, name: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Those of stored(id, name, tags, ...) whose name contains a text, in any case, and that have all tags."""
    out = stored
    if name:
        out = out.where(F.lower("name").contains(name.lower()))
    if tags:
        out = out.where(F.size(F.array_except(F.lit(tags), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return out


def page(rows: DataFrame, order: list[str], limit: int = PAGE, offset: int = 0) -> tuple[DataFrame, int]:
    """(the rows of a page, how many there are in all)."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def get(stored: DataFrame, id_: str) -> DataFrame:
    """The stored row of an id; a Store reads its bucket alone for it."""
    return stored.where(F.col("id") == id_)


def save(stored: DataFrame, row: DataFrame) -> DataFrame:
    """stored with a row; one of the same id keeps the time it was made and gets a new time of change."""
    was = stored.select("id", F.col("created_at").alias("_made"))
    now = row.join(was, "id", "left").withColumn("created_at", F.coalesce("_made", "created_at", F.current_timestamp())).withColumn("updated_at", F.current_timestamp()).select(*stored.columns)
    return stored.join(row.select("id"), "id", "left_anti").select(*stored.columns).unionByName(now)


def update(stored: DataFrame, id_: str, name: str | None = None, tags: list[str] | None = None) -> DataFrame:
    me = F.col("id") == id_
    out = stored.withColumn("updated_at", F.when(me, F.current_timestamp()).otherwise(F.col("updated_at")))
    if name is not None:
        out = out.withColumn("name", F.when(me, F.lit(name)).otherwise(F.col("name")))
    if tags is not None:
        out = out.withColumn("tags", F.when(me, F.lit(tags).cast("array<string>")).otherwise(F.col("tags")))
    return out


def delete(stored: DataFrame, id_: str) -> DataFrame:
    return stored.where(F.col("id") != id_)


def open_sessions(sessions: DataFrame, now=None, minutes: int = SESSION) -> DataFrame:
    """Sessions(id, created_at, ...) that haven't expired."""
    at = F.current_timestamp() if now is None else F.lit(now)
    return sessions.where(F.col("created_at") > at - F.expr(f"interval {minutes} minutes"))


def decide(calls: DataFrame, decisions: DataFrame) -> DataFrame:
    """calls(id, status, endpoint_id, ...) with decisions(call_id, decision): `unresolvable`, the id of an endpoint, or null, which leaves a call as it is. Only calls that wait are changed."""
    d = decisions.where("decision is not null").select(F.col("call_id").alias("id"), "decision")
    hit = calls.join(d, "id", "left")
    mine = (F.col("status") == "pending_review") & F.col("decision").isNotNull()
    gone = F.col("decision") == "unresolvable"
    status = F.when(mine, F.when(gone, "unresolvable").otherwise("resolved")).otherwise(F.col("status"))
    endpoint = F.when(mine & ~gone, F.col("decision")).otherwise(F.col("endpoint_id"))
    return hit.withColumns({"status": status, "endpoint_id": endpoint}).select(*calls.columns)
