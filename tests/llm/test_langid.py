"""Held-out accuracy, exact marginals, code-switched text and odd rows."""

import zlib

import numpy as np
from graphloom.llm import langid as L


def model_of(spark, d="/root/testdata/sf0.01"):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{d}/documents.parquet")
    train = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 0
    return docs, L.fit(L.sample(docs, train=train))


def test_held_out(spark):
    docs, model = model_of(spark)
    rows = L.label(docs, model, pass_on=["doc_id", "lang", "text"]).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == docs.count() and all(0 <= r.lang_score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    # code-switched text: the words go to the languages they come from
    a = next(r for r in held if r.lang == "en" and len(r.text.split()) > 60).text.split()[:60]
    b = next(r for r in held if r.lang == "fr" and len(r.text.split()) > 60).text.split()[:40]
    d = spark.createDataFrame([(1, " ".join(a + b))], "doc_id long, text string")
    got = L.label(d, model, pass_on=["doc_id"]).first()
    share = dict(zip(model.languages, got.words_by_language))
    total = sum(got.words_by_language)
    assert got.lang_pred == "en" and 0.45 < share["en"] / total < 0.7 and share["fr"] / total > 0.3


def test_marginals_are_exact(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    rng = np.random.default_rng(0)
    moves = rng.random((3, 3)) + 0.1
    counts = np.array([0, 1, 4, 5, 13, 0, 8])
    e = rng.random((counts.sum(), 3)) + 0.01
    got, at = L.marginals(e, counts, moves), 0
    for n in counts:
        paths = np.zeros((n, 3))
        a = np.full(3, 1 / 3)
        alpha, beta = [], [np.ones(3)]
        for x in e[at : at + n]:
            a = (a @ moves) * x
            alpha.append(a)
        for x in e[at : at + n][::-1][:-1]:
            beta.append(moves @ (x * beta[-1]))
        if n:
            paths = np.array(alpha) * np.array(beta[::-1])
            paths /= paths.sum(1, keepdims=True)
            assert np.allclose(got[at : at + n], paths)
        at += n


def test_odd_rows(spark):
    _, model = model_of(spark, "/root/testdata/sf0.001")
    rows = [(1, None), (2, ""), (3, "123 - !!"), (4, "— …"), (5, "the and of " * 30000), (5, "the"), (None, "漢字"), (6, "x" * 100_000)]
    d = spark.createDataFrame([(*r, "kept", 1.5) for r in rows], "doc_id long, text string, lang_x string, score double")
    out = L.label(d, model, pass_on=["doc_id", "lang_x", "text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages and 0 < r.lang_score <= 1
    assert L.label(d.limit(0), model, pass_on=["doc_id"]).count() == 0
    assert L.fit([]) is None and L.fit([(None, "en"), ("12", "de")]) is None
    assert {r.lang_pred for r in L.label(d, None, pass_on=["doc_id"]).collect()} == {"und"}


def test_no_language_is_left_out(spark, monkeypatch):
    mark = lambda i: chr(97 + i % 70 // 7) + chr(107 + i % 7) + chr(97 + i % 70 // 7)
    d = spark.createDataFrame([(i, f"wort{mark(i)} {mark(i)}satz teil {mark(i)}", f"l{i % 70:02}") for i in range(1400)], "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "IN_ALL", 500)
    some = L.sample(d)
    assert {y for _, y in some} == {f"l{k:02}" for k in range(70)}
    monkeypatch.setattr(L, "AT_ONCE", 20_000)  # a few sequences at once
    model = L.fit(some, rounds=30)
    got = L.label(d.limit(140), model, pass_on=["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_parts_are_learned_like_the_whole(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = L.sample(docs)
    one = L.fit(some, rounds=8)
    monkeypatch.setattr(L, "AT_ONCE", 4000)
    two = L.fit(some, rounds=8)
    assert np.allclose(one.weights, two.weights, atol=1e-4) and np.allclose(one.moves, two.moves, atol=1e-6)


def test_unlearned_text_is_neither_clear_nor_familiar(spark):
    docs, model = model_of(spark)
    rows = [(1, "это просто русский текст который никто не учил и не знает " * 3), (2, "qxzjk vwbpf ghqxz jkvwb pfghq xzjkv " * 9), (3, "漢字 かな 交じり 文 テスト です 日本語 " * 4)]
    out = L.label(spark.createDataFrame(rows, "doc_id long, text string"), model, pass_on=["doc_id"]).collect()
    assert all(r.lang_clear < 0.75 and r.lang_familiar < 0.9 for r in out)
    own = L.label(docs, model, pass_on=["doc_id"]).where("lang_pred <> 'und'").collect()
    assert np.mean([r.lang_clear >= 0.75 or r.lang_familiar >= 0.9 for r in own]) > 0.999


def test_clashing_names(spark):
    import pytest

    d = spark.createDataFrame([(1, "the text", "x")], "doc_id long, text string, lang_pred string")
    with pytest.raises(ValueError):
        L.label(d, None, pass_on=["doc_id", "lang_pred"])
