"""Base columns and scores against brute force; the ratio's verdicts on trusted and junk text."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from graphloom.llm import quality as Q
from graphloom.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


def plain_features(text):
    """Hashed runs of 4 bytes; digits are 0 and white space is one kind."""
    raw = [0x30 if 0x30 <= b <= 0x39 else 0x20 if b == 0x20 or 9 <= b <= 13 else b for b in (text or "").encode()]
    out = []
    for i in range(len(raw) - 3):
        h = raw[i]
        for b in raw[i + 1 : i + 4]:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        out.append(h >> 16)
    return out


def test_scores(spark):
    rows = [(r.doc_id, r.text[:3000]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "no id at all"), (9000, None), (9001, ""), (9002, "abc"), (9003, "12 34\t56\n78"), (rows[3][0], rows[3][1])]
    trusted = {i for i, _ in rows if i is not None and i % 3 == 0}
    all_, good = Counter(), Counter()
    for i, t in rows:
        f = Counter(plain_features(t))
        all_ += f
        if i in trusted:
            good += f
    size, n, m = 1 << 16, sum(all_.values()), sum(good.values())
    p = lambda k: (all_[k] + 1) / (n + size)
    ratio = lambda k: np.log((good[k] + size * p(k)) / (m + size)) - np.log(p(k))
    want = sorted((repr(i), round(sum(map(ratio, f)) / len(f), 6) if (f := plain_features(t)) else 0.0) for i, t in rows)
    got = rate(spark, rows, trusted, threshold=-0.1)
    have = sorted((repr(r.doc_id), r.score) for r in got)
    assert [a for a, _ in have] == [a for a, _ in want]
    assert all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(have, want))
    assert all(r.kept == (not r.base_failed and r.score >= -0.1) for r in got)


def rate(spark, rows, trusted=(), **kw):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words long, feature string")
    t = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    return Q.assess(d, t, Workspace(spark, "t"), **kw).collect()


def test_base_columns(spark):
    texts = [None, "", " \n\t", "a b\na b\n\na b", "é#é <ü> a|b\r\nx\nx\n", "w1 w2 w3 w4 w5 " * 3, "one " * 40, "x" * 200_000, "\n" * 50, "a\x0bb\x0cc\x1cd\x85e", "w1 w2 w3 w4 w5", "q r s t u v\nv q r s t u", "same line\nsame line ", "ẞß 漢字 a b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, texts[3])]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = rate(spark, rows)
    key = lambda x: repr(x)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)
    assert not any(r.kept and r.base_failed for r in got)
    assert rate(spark, []) == []


def test_ratio(spark):
    good = "the quick brown fox jumps over the lazy dog and runs into the green field behind N old houses"
    bad = "buy ### now *** cheap $$$ pills &&& click %%% here ||| win <<< cash >>> free N offers today"
    rows = [(i, good.replace("N", str(i))) for i in range(200)] + [(1000 + i, bad.replace("N", str(i))) for i in range(200)]
    kept = {r.doc_id for r in rate(spark, rows, trusted=range(100), threshold=-0.12, size=4096) if r.kept}
    assert kept == set(range(200))
    again = {r.doc_id: r.score for r in rate(spark, rows[::-1], trusted=range(100))}
    assert again == {r.doc_id: r.score for r in rate(spark, rows, trusted=range(100))}


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    train = [i for i, q in labels.items() if q == 1 and i % 3]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {r.doc_id: r for r in Q.assess(docs, spark.createDataFrame([(i,) for i in train], "doc_id long"), Workspace(spark, "t"), threshold=-0.12).collect()}
    good = [out[i] for i, q in labels.items() if q == 1 and i % 3 == 0]
    junk = [out[i] for i, q in labels.items() if q == 0]
    assert sum(r.kept or r.base_failed for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in junk) <= 0.12 * len(junk)


def test_every_trusted_document_counts(spark):
    # more than were once sent to executors; the last ones alone have their words
    rows = [(i, f"good text {i % 50}" if i < 20_000 else f"late words {i} zq") for i in range(21_000)] + [(30_000 + i, f"noise ## {i}") for i in range(500)] + [(None, "good text x"), (20_500, "again qz"), (20_500, None)]
    f, doc = Q.features(pa.array([t for _, t in rows], pa.string()), 4096)
    ok = np.array([i is not None and i < 21_000 for i, _ in rows])
    ratio = Q.fit(np.bincount(f, minlength=4096).astype(float), np.bincount(f[ok[doc]], minlength=4096).astype(float))
    n = np.bincount(doc, minlength=len(rows))
    want = sorted(zip([-1 if i is None else i for i, _ in rows], np.round(np.bincount(doc, weights=ratio[f], minlength=len(rows)) / np.maximum(1, n), 9)))
    for block in (Q.BLOCK, 4_000):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in rate(spark, rows, range(21_000), size=4096, block=block))
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=2e-9)
