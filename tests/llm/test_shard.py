"""A bijection with gapless slots, against a plain Feistel network."""

import math
import struct
import zlib

import pytest
import xxhash
from graphloom.llm import shard as S
from graphloom.llm.workspace import Workspace
from pyspark.sql import functions as F


def run(spark, rows, **kw):
    d = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, shard int, size string").repartition(5)
    return S.shard(d, Workspace(spark, "t"), **kw).collect()


def plain(x, n, key, rounds=6):
    """The network with whole numbers and a hash of bytes, walking until the value is below n."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def mix(half, i):
        h = 42
        for kind, v in (("<q", half), ("<i", i), ("<i", key)):
            h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    while True:
        left, right = x // b, x % b
        for i in range(rounds):
            if i % 2 == 0:
                left = (left + mix(right, i) % a) % a
            else:
                right = (right + mix(left, i) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [2, 5, 101, 1000])
def test_against_plain_network(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", S.permute(F.col("id"), n, 20240229).alias("p")).collect()}
    assert got == {x: plain(x, n, 20240229) for x in range(n)}


def test_places_follow_from_numbers(spark):
    out = run(spark, [(i, f"t{i}") for i in range(137)], shards=5)
    for r in out:
        to = plain(r.row_number, 137, 20240229)
        assert (r.shard, r.slot) == (to % 5, to // 5) and r.row_number == r.doc_id


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4099])
def test_permutation(spark, n):
    out = [r.p for r in spark.range(n).select(S.permute(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(out) == list(range(n))
    if n > 50:
        assert out != sorted(out)
        assert out != [r.p for r in spark.range(n).select(S.permute(F.col("id"), n, 6).alias("p")).collect()]


def test_documents(spark):
    rows = [(i, f"text {i % 90} é" * (i % 4)) for i in range(500)] + [(1000, None), (1001, ""), (1001, ""), (None, "x"), (2, "another text of the id")]
    out = run(spark, rows)
    assert len(out) == len(rows)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    key = lambda r: repr(r)
    assert sorted(out, key=key) == sorted(run(spark, rows[::-1]), key=key)
    crc = {(r.doc_id, r.text_crc32, r.size) for r in out}
    assert crc == {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows}


def test_small(spark):
    assert run(spark, []) == []
    assert [(r.shard, r.slot) for r in run(spark, [(1, "a")])] == [(0, 0)]
    few = run(spark, [(i, "x" * 100_000) for i in range(5)])
    assert sorted((r.shard, r.slot) for r in few) == [(i, 0) for i in range(5)]
