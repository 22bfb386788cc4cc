"""Against brute force over all windows."""

import random
import re

from graphloom.llm import licenses as X
from graphloom.llm.workspace import Workspace


def split(t):
    return [w for w in re.split(X.SEPARATORS, (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]


def grams(w):
    return {tuple(w[i : i + X.N]) for i in range(len(w) - X.N + 1)}


def brute(rows, texts=X.TEMPLATES):
    out = []
    for doc, text in rows:
        w = split(text)
        for name, parts in texts.items():
            for k, t in enumerate(parts):
                g = grams(split(t))
                s = len(split(t)) - X.N + 1
                step, last = X.stride(s), max(0, len(w) - X.N + 1 - s)
                best = None
                if len(w) >= X.N:
                    for i in sorted({*range(0, last + 1, step), last}):
                        a, b = max(0, i - step), min(i + s + X.N - 1 + step, len(w))
                        share = len(g & grams(w[a:b])) / len(g)
                        if share >= X.CONTAINED and (best is None or share > best[0]):
                            best = (round(share, 9), a, b - a)
                if best:
                    out.append((doc, name, k, best[0]))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, row long")
    return sorted([tuple(r)[:4] for r in X.scan(d, Workspace(spark, "t"), **kw).collect()], key=repr)


def test_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, rows)
    assert got == brute(rows) and len({r[1] for r in got}) >= 3


def test_planted(spark):
    rng = random.Random(5)
    noise = lambda n: [rng.choice(["alpha", "beta", "gamma", "the", "of", "this", "license"]) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, "short one"), (4, "the " * 20000), (None, X.TEMPLATES["MIT"][0])]
    for i, parts in enumerate(X.TEMPLATES.values()):
        for t in parts:
            w = t.upper().split()
            rows.append((10 + i, " ".join([*noise(rng.randrange(60)), *w, *noise(rng.randrange(60))])))
            w[len(w) // 2] = "changed"
            rows.append((40 + i, " ".join([*noise(30), *w, *noise(3)])))
    rows += [rows[-2], rows[-2]]
    got, want = run(spark, rows), brute(rows)
    exact = [r for r in want if r[3] == 1.0]
    assert all(r in got for r in exact)
    assert all(r in want for r in got) and len(got) >= 0.99 * len(want)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, "some text of more than five words")], texts={}) == []
