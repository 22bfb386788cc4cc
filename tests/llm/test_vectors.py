"""Yinyang codes against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from graphloom.llm import registry
from graphloom.llm import vectors as V
from graphloom.llm.workspace import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows(key, vector, label) to (key, code, error, label_error, codebooks)."""
    kept = [(k, [math.floor(scale * x) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda x, p: tuple(x[p * (len(x) // parts) : (p + 1) * (len(x) // parts)])
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    nearest = lambda x, p: min((dist(cut(x, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for _, x, _ in kept:
                by.setdefault(nearest(x, p)[1], []).append(cut(x, p))
            for i, xs in by.items():
                books[p][i] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, total = [], {}
    for k, x, lab in kept:
        best = [nearest(x, p) for p in range(parts)]
        e = sum(d for d, _ in best)
        total[lab] = total.get(lab, 0) + e
        out.append((k, "".join(f"{i:02x}" for _, i in best), e, lab))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((k, c, e, total[lab]) for k, c, e, lab in out), key=repr), digest


def run(spark, rows, **more):
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, key string, n int").repartition(3)
    out = V.quantise(d, Workspace(spark, "t"), **more)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.codes.collect()), key=repr), out.digest(), out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=40), st.integers(1, 12), st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=3, max_size=3))
def test_bounds_never_change_an_answer(points, k, moves):
    """Few places, so many ties; entries move at random between rounds."""
    x = np.array(points, np.int64)
    book = V.Codebook(x[:k], V.cluster(x[:k], 3))
    own, d, low = V.first(x, book)
    for move in moves:
        book = book.moved(book.entries + np.array(move) * (np.arange(len(book.entries)) % 3)[:, None])
        own, d, low, _ = V.again(x, book, own, low)
        full = V.distances(x, book.entries)
        assert (own == full.argmin(1)).all() and (d == full.min(1)).all()
        full = full.astype(np.float64)
        full[np.arange(len(x)), own] = np.inf
        for g, entries in enumerate(book.groups):
            assert (low[:, g] <= np.sqrt(full[:, entries].min(1))).all()


def test_large_distances_are_exact():
    x = np.array([[V.LARGEST - 1, -V.LARGEST + 1]], np.int64)
    c = np.array([[-V.LARGEST + 1, V.LARGEST - 1], [V.LARGEST - 1, -V.LARGEST + 2]], np.int64)
    assert V.distances(x, c).tolist() == [[2 * (2 * V.LARGEST - 2) ** 2, 1]]


def test_equals_plain_rounds(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.3, 0.7]) + r.choice([0, 0, 1e-3]) for _ in range(8)], r.choice([0, 1, 2, None])) for i in range(300)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[7][1], 2), (-4, [9.0] * 8, None)]
    bad = [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * 8, 0), (1003, [float("inf")] + [0.0] * 7, 0)]
    got, digest, out = run(spark, rows + bad, entries=20)
    assert (got, digest) == brute(rows + bad, entries=20)
    assert out.scanned[0] == 1 and all(0 < s < 0.9 for s in out.scanned[1:])


def test_few_rows_and_none(spark):
    rows = [(2, [0.5] * 4, 1), (1, [0.25, 0.0, -0.1, 1.0], None), (1, [0.25, 0.0, -0.1, 0.5], None)]
    assert run(spark, rows)[:2] == brute(rows)
    assert run(spark, [])[:2] == ([], hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, None, 1)])[0] == []
    assert [r[:3] for r in run(spark, [(1, [], 1), (2, [], 1)])[0]] == [(1, "00000000", 0), (2, "00000000", 0)]


def test_errors(spark):
    for rows, words in (([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], "components"), ([(1, [1.0] * 5, 0)], "equal parts"), ([(1, [1e30] * 4, 0)], "component of")):
        with pytest.raises(Exception, match=words):
            run(spark, rows)


def test_query(spark):
    q = registry.op13_yinyang_codes(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in sorted(rows)], np.int64)
    books = [c.copy() for c in np.split(x[:256], 4, axis=1)]
    for _ in range(4):
        for p, part in enumerate(np.split(x, 4, axis=1)):
            at = ((part[:, None] - books[p][None]) ** 2).sum(2).argmin(1)
            for i in np.unique(at):
                books[p][i] = part[at == i].sum(0) // (at == i).sum()
    d = [((part[:, None] - books[p][None]) ** 2).sum(2) for p, part in enumerate(np.split(x, 4, axis=1))]
    code = ["".join(f"{m.argmin():02x}" for m in ds) for ds in zip(*d)]
    error = sum(m.min(1) for m in d).tolist()
    label = [r[2] for r in sorted(rows)]
    total = {v: sum(e for e, u in zip(error, label) if u == v) for v in set(label)}
    digest = hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist())).encode()).hexdigest()
    assert sorted(tuple(r) for r in q) == sorted((r[0], c, e, total[r[2]], digest) for r, c, e in zip(sorted(rows), code, error))
