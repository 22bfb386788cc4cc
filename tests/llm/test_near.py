"""Classes and link counts against all pairs."""

import random
import re

from graphloom.llm import near as M
from graphloom.llm.components import components
from graphloom.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def grams(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, similar=0.8):
    sets = [grams(t) for _, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similar * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = lambda ids: min((x for x in ids if x is not None), default=None)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(top(i), []).append(i)
    return sorted([(rows[i][0], low([rows[j][0] for j in classes[top(i)]]), len(classes[top(i)]), links[i]) for i in range(len(rows))], key=repr)


def run(spark, rows, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, md5 string, row long").repartition(3)
    out = M.join(d, Workspace(spark, "t"), **kw).collect()
    kept = [r for r in out if r.keep]
    assert len(kept) == len({(r.class_id, r.class_size) if r.class_size > 1 else id(r) for r in out})
    return sorted([(r.doc_id, r.class_id, r.class_size, r.n_links) for r in out], key=repr)


def rows_of(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w).capitalize())
    rows += [None, "", " \n", "a", "A", "a b c d", "x " * 400, "x " * 401, rows[5], rows[5], "é " * 9]
    return [(i, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = rows_of()
    rows += [rows[7], (None, "only here with no id at all"), (None, "only here with no id at all")]
    assert run(spark, rows) == brute(rows)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr(M, "COLUMNS", 16)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 1, 1, 0)]


def test_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[3] for r in got)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = {i: top(i) for a, b in pairs for i in (a, b) if a != b}
    got = components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_recall_of_bands():
    for s in (0.8, 0.9):
        bands = M.plan(s)
        assert 1 - (1 - s**M.ROWS) ** bands >= M.RECALL
