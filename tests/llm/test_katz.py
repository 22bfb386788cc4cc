"""Against a plain implementation, with dictionaries."""

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphloom.llm import katz
from graphloom.llm.workspace import Workspace
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
END, START = "</s>", "<s>"


K = 5


def good_turing(counts):
    """Katz's discounts d(r), r = 1..K, written out from his paper; absolute discounting where they aren't between 0 and 1."""
    n = Counter(counts)
    out = {}
    if all(n[r] for r in range(1, K + 2)):
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            star = (r + 1) * n[r + 1] / n[r]
            out[r] = (star / r - common) / (1 - common) if common < 1 else -1
    if not out or not all(0 < d < 1 for d in out.values()):
        b = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        out = {r: (r - b) / r for r in range(1, K + 1)}
    return out


class Plain:
    def __init__(self, train):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for text in train:
            w = WORD.findall((text or "").translate(LOWER)) + [END]
            self.uni.update(w)
            for a, b in zip([START, *w], w):
                self.bi[a][b] += 1
        self.total = sum(self.uni.values())
        self.d1 = good_turing(self.uni.values())
        self.d2 = good_turing(c for x in self.bi.values() for c in x.values())
        # what the discounts take from seen words is the unknown word's
        self.left = sum(c * (1 - self.d1.get(c, 1.0)) for c in self.uni.values()) / self.total if self.total else 0.0

    @functools.cache
    def word(self, w):
        c = self.uni[w]
        if self.left <= 0:
            return (c + 1) / (self.total + len(self.uni) + 1)
        return self.d1.get(c, 1.0) * c / self.total if c else self.left

    def d(self, r):
        return self.d2.get(r, 1.0)

    @functools.cache
    def weight(self, v):
        n = sum(self.bi[v].values())
        return (1 - sum(self.d(c) * c for c in self.bi[v].values()) / (n + 1)) / (1 - sum(self.word(w) for w in self.bi[v]))

    def p(self, v, w):
        if v not in self.bi:
            return self.word(w)
        n, c = sum(self.bi[v].values()), self.bi[v][w]
        return self.d(c) * c / (n + 1) if c else self.weight(v) * self.word(w)

    def score(self, text):
        w = WORD.findall((text or "").translate(LOWER)) + [END]
        base = sum(math.log10((self.uni[x] + 1) / (self.total + len(self.uni) + 1)) for x in w)
        return len(w), sum(self.uni[x] > 0 for x in w), base, sum(math.log10(self.p(a, b)) for a, b in zip([START, *w], w))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, held string, n_tokens int").repartition(3)
    out = katz.score(d, Workspace(spark, "t"), F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2).collect()
    m = Plain([t for i, t in rows if not held(i)])
    want = sorted([(i, held(i), *m.score(t)[:2], m.total, *m.score(t)[2:]) for i, t in rows], key=repr)
    got = sorted([tuple(r) for r in out], key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-5) and g[6] == pytest.approx(w[6], abs=1e-5)
    return m, out


def test_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, "The"), (902, "The"), (None, "no id"), (903, "zzz " * 50 + "the of"), (904, "of " * 30000)]
    m, out = check(spark, rows)
    # distributions sum up to 1: over the vocabulary and the unknown word
    for v in [START, "the", "of", "zzz", END + "?", next(iter(m.uni))]:
        assert sum(m.p(v, w) for w in [*m.uni, "<unk>"]) == pytest.approx(1)
    held_rows = [r for r in out if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_hot_contexts(spark):
    rows = [(i, "hot " + " ".join(f"hot w{(i * k) % 97}" for k in range(60)) + " hot word" * 40) for i in range(60)]
    check(spark, rows)


def test_more_buckets_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET", 500)
    check(spark, [(i, " ".join(f"w{(i * k) % 89}" for k in range(40))) for i in range(60)])


def test_small(spark):
    check(spark, [(1, "a b a b c"), (2, "a b"), (3, None), (4, "B c d")])
    check(spark, [(i, "only held out words") for i in range(40) if held(i)])
    assert katz.score(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark, "t"), F.lit(False)).collect() == []


def test_pack():
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([1.5, -2.0]), np.array([7], np.uint16)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
