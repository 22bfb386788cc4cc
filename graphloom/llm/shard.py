"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 to n-1 in a global order. A keyed Feistel network with
cycle walking permutes these numbers; number p goes to shard p mod shards, slot
p div shards. So shard sizes differ by at most one row, slots have no gaps, and
anyone who knows n and the key can compute a row's place, or invert it, with
no table. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, ranked

ROUNDS = 6
#: Walks that one expression holds. Each leaves the range with a chance below 1/sqrt(n), and for n < 4096 this many always suffice; a row that would need more raises an error.
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a: the domain of the network is barely larger than n, so few numbers walk."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, key: int, rounds: int = ROUNDS) -> Column:
    """One pass of the unbalanced network over pairs (left < a, right < b), a bijection of 0..a*b-1.

    Each round adds a keyed hash of one half to the other, modulo that half's
    size, in turn; undoing the additions in reverse order inverts it.
    """
    a, b = sides(n)
    pair = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    mix = lambda half, i: F.xxhash64(half, i, F.lit(key))

    def turn(p: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(p["l"] + F.pmod(mix(p["r"], i), F.lit(a)), F.lit(a))).otherwise(p["l"])
        right = F.when(i % 2 == 1, F.pmod(p["r"] + F.pmod(mix(p["l"], i), F.lit(b)), F.lit(b))).otherwise(p["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pair, turn, lambda p: p["l"] * F.lit(b) + p["r"])


def permute(x: Column, n: int, key: int) -> Column:
    """The place of number x among 0..n-1: network passes until the value is below n (cycle walking)."""
    start = feistel(x, n, key)
    a, b = sides(n)
    if a * b == n:
        return start
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, key)))
    out = F.when(start < n, start).otherwise(walked)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk too long; choose another key")).cast("long"))


def shard(docs: DataFrame, ws: Workspace, *, shards: int = 24, key: int = 20240229) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, row_number) for every row of docs; shard counts differ by at most one.

    Rows are numbered in (doc_id, text_crc32, size) order, so the result
    depends on neither partitioning nor file order. size is the text's UTF-8
    bytes plus 8; a null text has none, and crc32 0. Repeated rows get places
    each on their own; a null doc_id comes last; an empty table gives an empty
    result. Of very long texts only size and crc32 are moved. Other columns of docs
    are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, counts = ranked(ws, rows, ["doc_id", "text_crc32", "size"], name="shard_ranks")
    n = counts.agg(F.sum("group_rows")).first()[0] or 0
    place = permute(F.col("rank"), max(1, n), key)
    out = rows.withColumn("_to", place)
    return out.select("doc_id", "size", "text_crc32", F.pmod("_to", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_to") / F.lit(shards)).cast("long").alias("slot"), F.col("rank").alias("row_number"))
