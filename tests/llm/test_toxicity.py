"""Held-out accuracy on the labelled table, a plain form of the score, and defined results of odd rows."""

import math
import re
import zlib

import numpy as np
import pytest
from graphloom.llm import toxicity as X


@pytest.fixture(scope="module")
def learned(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    learn = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    return docs, labels, learn, X.fit(X.sample(docs, labels.where(labels.doc_id.isin(learn))))


def test_held_out(spark, learned):
    docs, labels, learn, model = learned
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id not in set(learn)}
    out = {r.doc_id: r.score for r in X.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).collect()}
    toxic, plain = [out[i] for i, y in truth.items() if y], [out[i] for i, y in truth.items() if not y]
    assert all(0 <= s <= 1 for s in out.values())
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in plain) / len(toxic) / len(plain)
    recall, alarms = sum(s >= 0.5 for s in toxic) / len(toxic), sum(s >= 0.5 for s in plain) / len(plain)
    print("auc", auc, "recall", recall, "false alarms", alarms)
    assert auc > 0.93
    assert recall > 0.7
    assert alarms < 0.03


def test_odd_rows(spark):
    words = "red green blue stone water light field house tree river cloud wind".split()
    ordinary = [" ".join(words[(i * k) % 12] for k in range(1, 60)) for i in range(1, 150)]
    toxic = [o + " nastyword vileword awfulword" * 3 for o in ordinary[:50]]
    sample = [(t, 0) for t in ordinary] + [(t, 1) for t in toxic]
    for window in (1, 2):
        model = X.fit(sample, window)
        assert model is not None
        rows = [(1, None), (2, ""), (3, toxic[3] + " x"), (3, toxic[3] + " x"), (4, ordinary[5] * 2000), (None, "\x00 12 %")]
        d = spark.createDataFrame([(*r, "a", 0.5) for r in rows], "doc_id long, text string, keys string, score double")
        out = [(r.doc_id, r.score) for r in X.score(d, model).collect()]
        got = dict(out)
        assert len(out) == 6 and out.count((3, got[3])) == 2
        assert got[1] == got[2] < 0.5 and got[4] < got[3]
        assert X.score(d.limit(0), model).count() == 0
    assert X.fit([(t, 0) for t in ordinary]) is None
    assert X.fit([]) is None
    assert [r.score for r in X.score(d, None).collect()] == [0.0] * 6


def test_no_dilution(spark, learned):
    """Long ordinary texts stay ordinary, and a toxic text among ordinary ones is found."""
    docs, labels, learn, model = learned
    rows = docs.join(labels, "doc_id").where(~docs.doc_id.isin(learn)).orderBy("doc_id").select("text", "toxic").collect()
    toxic, plain = [r.text for r in rows if r.toxic][:60], [r.text for r in rows if not r.toxic]
    made = [(i, t + " " + " ".join(plain[(i * 20 + j) % len(plain)] for j in range(20))) for i, t in enumerate(toxic)]
    made += [(1000 + i, " ".join([t] * 200)) for i, t in enumerate(plain[:40])]
    made += [(2000 + i, " ".join(plain[i * 20 : i * 20 + 20])) for i in range(30)]
    out = {r.doc_id: r.score for r in X.score(spark.createDataFrame(made, "doc_id long, text string"), model).collect()}
    found = [np.mean([s >= 0.5 for i, s in out.items() if a <= i < a + 1000]) for a in (0, 1000, 2000)]
    print("toxic among 20", found[0], "ordinary x 200", found[1], "20 ordinary", found[2])
    assert found[0] >= 0.8 and found[1] <= 0.05 and found[2] <= 0.1


def plain_score(model, text):
    """The score of one text, window by window."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w.encode() for w in re.findall(r"[^\x00-\x60\x7B-\x7F]+", low)]
    k = model.window
    windows = [ws[i : i + k] for i in range(max(1, len(ws) - k + 1))] if ws else []
    framed = [X.FRAME + X.FRAME.join(w) for w in windows]
    a, b = X._compressor(model.ordinary), X._compressor(model.toxic)
    distance = {f: len(a.compress(f)) - len(b.compress(f)) for f in set(framed)}
    limits = lambda f: model.thresholds[:, min(X.LONGEST, len(f) - len(X.FRAME))]
    starts = list(range(0, max(1, len(framed) - X.STRETCH + X.STRETCH // 2), X.STRETCH // 2)) or [0]
    starts = sorted({min(s, max(0, len(framed) - X.STRETCH)) for s in starts})
    best = -math.inf
    for s in starts:
        some = framed[s : s + X.STRETCH]
        value = model.weights[-1]
        for j, e in enumerate(X.EPS):
            over = len({f for f in some if distance[f] >= limits(f)[j]})
            z = (over - e * len(some)) / math.sqrt(e * len(some) + 0.5)
            value += model.weights[j] * math.copysign(math.log1p(abs(z)), z)
        best = max(best, value)
    x = model.final[0] * best - model.final[1] * math.log(len(starts)) + model.final[2]
    return 1 / (1 + math.exp(-x))


def test_plain_form(spark, learned):
    docs, labels, learn, model = learned
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(120).collect()]
    rows += [(i + 10_000, " ".join(t or "" for _, t in rows[i : i + 9])) for i in range(0, 90, 9)] + [(20_000, None), (20_001, "idiot"), (20_002, "Moron SCUM \x01 é 12")]
    two = X.fit([(t, i % 7 == 0) for i, (_, t) in enumerate(rows)], window=2)
    for m in (model, two):
        assert m.weights[:-1].min() >= 0 and m.final[:-1].min() >= 0
        out = {r.doc_id: r.score for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
        for i, t in rows:
            assert out[i] == pytest.approx(plain_score(m, t), abs=1e-6)


def test_beats_word_list(learned):
    """Held out, the model is better than the best rule "at least n of the words that mark toxic texts"."""
    docs, labels, learn, model = learned
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.join(labels.select("doc_id"), "doc_id", "left_semi").collect()}
    split = {i: set(X._split(t or "")) for i, t in texts.items()}
    t_docs, p_docs = [split[i] for i in learn if truth[i] and i in split], [split[i] for i in learn if not truth[i] and i in split]
    count = lambda ds: X.Counter(w for d in ds for w in d)
    a, b = count(t_docs), count(p_docs)
    marks = {w for w, c in a.items() if c >= 3 and c / len(t_docs) > 8 * (b[w] + 0.5) / len(p_docs)}
    held = [i for i in split if i not in set(learn)]
    f1 = lambda got: 2 * sum(g and truth[i] for i, g in got.items()) / max(1, sum(map(bool, got.values())) + sum(truth[i] for i in got))
    rule = max(f1({i: len(split[i] & marks) >= n for i in held}) for n in (1, 2, 3, 4))
    mine = f1({i: plain_score(model, texts[i]) >= 0.5 for i in held})
    print("F1 of the model", mine, "of the word list", rule)
    assert mine > rule + 0.05


def test_other_endings(learned):
    """Held-out toxic texts whose marking words all have another ending are mostly still found, at 1% false alarms."""
    docs, labels, learn, model = learned
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.join(labels.select("doc_id"), "doc_id", "left_semi").collect()}
    split = {i: set(X._split(t)) for i, t in texts.items()}
    t_docs, p_docs = [split[i] for i in learn if truth[i] and i in split], [split[i] for i in learn if not truth[i] and i in split]
    a, b = (X.Counter(w for d in ds for w in d) for ds in (t_docs, p_docs))
    marks = {w.decode() for w, c in a.items() if c >= 3 and c / len(t_docs) > 8 * (b[w] + 0.5) / len(p_docs)}
    held = [i for i in split if i not in set(learn)]
    plain = sorted((plain_score(model, texts[i]) for i in held if not truth[i]), reverse=True)
    limit = plain[len(plain) // 100]
    change = lambda f, t: re.sub(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lambda m: f(m[0]) if m[0].lower() in marks else m[0], t)
    found = {n: np.mean([plain_score(model, change(f, texts[i])) > limit for i in held if truth[i]]) for n, f in (("as it is", lambda w: w), ("s", lambda w: w + "s"), ("shorter", lambda w: w[:-1]))}
    print(found)
    assert found["as it is"] >= 0.85 and found["s"] >= 0.6 and found["shorter"] >= 0.6
