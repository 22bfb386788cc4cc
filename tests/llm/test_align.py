"""Alignment against whole texts, tokenized and compared byte by byte."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from graphloom.llm import align as A
from graphloom.llm.workspace import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_t: dict = {}


def plain(text):
    """(ids of A, their bytes, ids of B, their bytes) of a whole text; None without tokens."""
    if not _t:
        t = Tokenizer.from_file(BYTES)
        t.encode_special_tokens = True
        _t.update(t=t, s=sentencepiece.SentencePieceProcessor(model_file=PIECES), at=A.byte_level())
    if not text:
        return None
    ids = _t["t"].encode(" " + text, add_special_tokens=False).ids
    a = [bytes(_t["at"][c] for c in _t["t"].id_to_token(i)) for i in ids]
    got = _t["s"].encode(text)
    b = []
    for i in got:
        p = _t["s"].id_to_piece(i)
        b.append(bytes([int(p[1:-1], 16)]) if _t["s"].is_byte(i) else p.replace("▁", " ").encode())
    return (ids, a, got, b) if b"".join(a) == b"".join(b) == (" " + text).encode() else None


def spans(tokens):
    at = 0
    for x in tokens:
        yield at, at + len(x)
        at += len(x)


def brute(texts):
    each = []
    for text in texts:
        x = plain(text)
        if x is None:
            each.append((0, 0, "", []))
            continue
        ids_a, a, ids_b, b = x
        sa, sb = list(spans(a)), list(spans(b))
        links = [(i, j) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if s < v and u < e] if len(sa) < 300 else fast(sa, sb)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        text = ";".join(joined(cuts, ids_a, sa, ids_b, sb))
        each.append((len(sa), len(sb), text, [(ids_a[i], ids_b[j]) for i, j in links]))
    count = Counter(p for x in each for p in x[3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(na, nb, g.count(";") + 1 if g else 0, len(p), sum(count[x] == top[x[1]] for x in p), sum(count[x] for x in p), g) for na, nb, g, p in each], count


def fast(sa, sb):
    out, j = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j][1] <= s:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < e:
            out.append((i, k))
            k += 1
    return out


def joined(cuts, ids_a, sa, ids_b, sb):
    i = j = 0
    for c in cuts:
        x, y = [], []
        while i < len(sa) and sa[i][1] <= c:
            x.append(str(ids_a[i]))
            i += 1
        while j < len(sb) and sb[j][1] <= c:
            y.append(str(ids_b[j]))
            j += 1
        yield ",".join(x) + "|" + ",".join(y)


TEXTS = st.lists(st.text(st.sampled_from("aBz'<|>. ,é×÷İ\x85\xa0\t\n09 　漢😀s▁") | st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_batches_equal_whole_texts(texts):
    got = A.batch(pa.array(texts, pa.string()), A.byte_coder(BYTES), A.piece_coder(PIECES))
    want, count = brute(texts)
    assert [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups"]) for x in got.docs.to_pylist()] == [(w[0], w[1], w[2], w[3], w[6]) for w in want]
    assert {(x["a"], x["b"]): x["n"] for x in got.pairs.to_pylist()} == count


@settings(max_examples=50, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_parts_equal_whole_texts(texts, most):
    old, A.PART = A.PART, most
    try:
        test_batches_equal_whole_texts.hypothesis.inner_test(texts)
    finally:
        A.PART = old


def test_memory_grows_with_parts(monkeypatch):
    """Neither a tokenizer nor DuckDB gets all distinct segments of a batch at once, and rows are handed on in runs."""
    import duckdb

    texts = [" ".join(f"w{i * 7919 + k:x}q" for k in range(2000)) for i in range(100)]
    most = {}

    def seen(what, n):
        most[what] = max(most.get(what, 0), n)

    def watched(name, coder):
        return A.Coder(lambda x: (seen(name, sum(map(len, x))), coder.encode(x))[1], coder.token)

    class Connection:
        def __init__(self, con):
            self.con = con

        def __getattr__(self, name):
            return getattr(self.con, name)

        def register(self, name, t):
            seen(name, t.num_rows)
            return self.con.register(name, t)

    connect = duckdb.connect
    monkeypatch.setattr(duckdb, "connect", lambda *a, **k: Connection(connect(*a, **k)))
    got = A.batch(pa.array(texts), watched("a", A.byte_coder(BYTES)), watched("b", A.piece_coder(PIECES)))
    assert sum(map(len, texts)) > 1_400_000
    assert max(most["a"], most["b"]) <= 300_000
    assert max(most["_a"], most["_b"]) <= 300_000
    monkeypatch.setattr(A, "BATCH", 200_000)
    runs = list(got.runs())
    assert [x for r in runs for x in range(*r)] == list(range(100)) and len(runs) > 10
    assert pa.concat_tables([got.rows(*r) for r in runs]).drop_columns("segs").to_pylist() == got.docs.to_pylist()


def run(spark, rows, **more):
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, a string, part int").repartition(3)
    out = A.align(d, Workspace(spark, "t"), lambda: A.byte_coder(BYTES), lambda: A.piece_coder(PIECES), keys=["doc_id"], **more)
    return sorted(map(tuple, out.docs.collect()), key=repr), {(r.a, r.b): (r.n, r.best) for r in out.pairs.collect()}


ODD = [(None, "no id"), (9000, None), (9001, ""), (9002, "same"), (9002, "same"), (9003, "a<|endoftext|>b <s> </s> don't"), (9004, "  two  spaces \n\n x "), (9005, "漢字 кириллица 😀👍 ﬁ Å"), (9006, "w" * 3000), (9007, "long words " * 4000), (9008, "<unk> ⁇ \x00 ▁x")]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(A, "BATCH", 1 << 16)
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs, pairs = run(spark, rows)
    want, count = brute([t for _, t in rows])
    assert docs == sorted([(d, *w) for (d, _), w in zip(rows, want)], key=repr)
    assert {k: n for k, (n, _) in pairs.items()} == count
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    assert all(best == (n == top[b]) for (_, b), (n, best) in pairs.items())


def test_empty(spark):
    assert run(spark, []) == ([], {})
    assert run(spark, [(1, None), (2, "")]) == ([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")], {})


def test_query(spark):
    from graphloom.llm import registry

    q = registry.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want, _ = brute([t for _, t in docs])
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r[n] for n in names) for r in q) == sorted((d, *w[:6], sha(w[6])) for (d, _), w in zip(docs, want))


def test_a_wrong_spelling_has_no_tokens():
    a, b = A.byte_coder(BYTES), A.piece_coder(PIECES)
    bad = A.Coder(lambda x: A._flat([[5] for _ in x]), b.token)
    got = A.batch(pa.array(["some text", None]), a, bad)
    assert got.docs.to_pylist() == [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": ""}] * 2 and got.pairs.num_rows == 0
