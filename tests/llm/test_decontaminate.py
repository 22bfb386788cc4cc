"""Against brute force over the small tables."""

import re

import pytest
from graphloom.llm import decontaminate as D
from graphloom.llm.workspace import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    phrases = {}
    for item, text in items:
        w = split(text)
        if w:
            m = min(n, len(w))
            for i in range(len(w) - m + 1):
                phrases.setdefault(tuple(w[i : i + m]), set()).add(str(item) if item is not None else "")
    lengths = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if of := phrases.get(tuple(w[i : i + m])):
                    found |= of
                    hit |= set(range(i, i + m))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "extra", 3) for x in docs], "doc_id long, text string, items string, n_words int")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = D.decontaminate(d, i, Workspace(spark, "t"), **kw).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows], key=repr)


PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_small(spark):
    items = [(1, PHRASE + " lambda"), (2, "Short one"), (3, None), (4, ""), (4, "x y"), (None, "lone wolf")]
    docs = [
        (1, "so " + PHRASE.upper().replace(" ", ", ") + " Lambda! and more " + PHRASE),
        (2, PHRASE[:-6]),  # nine words
        (3, None), (4, ""), (5, "a short, one x y"), (5, "a short, one x y"), (None, "lone-wolf"), (7, "iota kappa " + " ".join(["pad"] * 5000) + " " + PHRASE),
        (8, "alpha beta gamma delta epsilon"), (9, "zeta eta theta iota kappa"),  # no phrase crosses documents
    ]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == [(a, b, 0, []) for a, b, _, _ in brute(docs, items)]
    assert run(spark, [], items) == []


def test_blocks_agree(spark, monkeypatch):
    items = [(1, PHRASE + " lambda mu nu"), (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, "x y")]
    docs = [(1, PHRASE + " lambda mu x y"), (1, PHRASE), (2, "none of it")]
    monkeypatch.setattr(D, "BLOCK_WORDS", 5)
    monkeypatch.setattr(D.in_blocks, "__defaults__", (5,))
    assert run(spark, docs, items) == brute(docs, items)


def test_near(spark):
    items = [(1, "one two three four five")]
    d = spark.createDataFrame([(1, "five x four x three two one"), (2, "one two three four"), (3, "one " + "x " * 20 + "two three four five")], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: list(r.near_items) for r in D.decontaminate(d, i, Workspace(spark, "t"), reach=8).collect()}
    assert out == {1: ["1"], 2: [], 3: []}


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert any(x[2] for x in got)


@pytest.mark.parametrize("text", ["the " * 3000, "x" * 300_000, "é" * 20])
def test_odd_texts(spark, text):
    items = [(1, "the " * 12), (2, "x" * 300_000)]
    docs = [(1, text)]
    assert run(spark, docs, items) == brute(docs, items)
