"""Each stage on its own input against brute force, and the whole pipeline."""

import corpus_pipeline as P
import pytest
from test_decontaminate import brute as leaks
from test_near import brute as classes
from test_tokenids import brute as ids

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    rows += [(9000, None, "en", None, None), (9001, "", None, "src1", 0), (9002, "12 34 !!", "en", "src2", 8), rows[3], rows[3], (None, "The of and to in that was for it with", "en", None, 37), rows[4][:1] + ("other text of the same id and the other one of it",) + rows[4][2:]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def same(df, rows):
    key = lambda r: repr(tuple(r))
    assert sorted(df.collect(), key=key) == sorted(rows, key=key)


def test_language(spark, docs):
    out = P.keep_language(spark, frame(spark, docs), D)
    got = {tuple(r) for r in out.collect()}
    assert got <= set(docs) and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {9000, 9001, 9002} & {r[0] for r in got}
    lost = [r for r in docs if r not in got and r[1] and any(c.isalpha() for c in r[1])]
    assert len(lost) <= 2


def test_near(spark, docs):
    got = [tuple(r) for r in P.keep_one_of_near(spark, frame(spark, docs), D).collect()]
    want = {}
    of = {}
    for r in classes([(i, x[1]) for i, x in enumerate(docs)]):
        of.setdefault(r[1], []).append(docs[r[0]])
    best = lambda rows: min(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = [best(rows) for rows in of.values()]
    assert len(got) == len(want) and {r[0] for r in got} == {r[0] for r in want}


def test_leaks(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = leaks([(i, x[1]) for i, x in enumerate(docs)], items)
    same(P.drop_leaks(spark, frame(spark, docs), D), [docs[r[0]] for r in clean if not r[2]])


def test_mix(spark, docs):
    from graphloom.llm import mix
    from graphloom.llm.workspace import Workspace

    got = [tuple(r) for r in P.mix_sources(spark, frame(spark, docs), D).collect()]
    assert set(got) <= set(docs)
    plan = mix.mix(frame(spark, docs), Workspace(spark, "t")).collect()
    taken = {}
    for r in got:
        taken[r[3]] = taken.get(r[3], 0) + len((r[1] or "").split())
    size, target = {r.source: r.source_size for r in plan}, {r.source: r.target for r in plan}
    longest = {}
    for r in plan:
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    for s, t in target.items():
        assert abs(taken.get(s, 0) - t) <= longest[s]
        assert t <= 2 * size[s] + 1e-6
    for r in set(got):
        assert got.count(r) <= 2 * docs.count(r)


def test_ids(spark, docs):
    assert sorted([tuple(r) for r in P.write_ids(spark, frame(spark, docs), D).collect()], key=repr) == ids([(r[0], r[1]) for r in docs])


def test_empty(spark):
    for _, stage in P.STAGES:
        assert stage(spark, frame(spark, []), D).count() == 0


def test_clashing_names(spark, docs):
    """Columns with any names pass through unchanged, and change no decision."""
    more = ["md5", "lang_pred", "lang_score", "words_by_language", "_text", "_key", "_rows", "_id", "row", "rows", "copies", "id", "n", "keep", "rank", "to_id", "hit_md5", "with.dot"]
    rows = [(*r, *(f"{c}{i}" for c in more)) for i, r in enumerate(dict.fromkeys(docs))]
    wide = spark.createDataFrame(rows, COLUMNS + "".join(f", `{c}` string" for c in more))
    slim = frame(spark, [r[:5] for r in rows])
    for name, stage in P.STAGES:
        a, b = stage(spark, wide, D), stage(spark, slim, D)
        if name == "token ids":
            same(a, b.collect())
            continue
        assert a.columns == wide.columns
        got = [tuple(r) for r in a.collect()]
        assert set(got) <= set(rows)
        assert sorted((r[:5] for r in got), key=repr) == sorted((tuple(r) for r in b.collect()), key=repr)


def test_language_drops_what_was_not_learned(spark, docs):
    odd = [(8000, "это просто русский текст который никто не учил и не знает " * 5, None, "src1", 9), (8001, "qxzjk vwbpf ghqxz jkvwb pfghq xzjkv " * 9, None, "src1", 9)]
    mixed = (8002, " ".join((a[1] or "")[:200] for a in docs[:8] if a[2]), None, "src1", 9)
    got = {r.doc_id for r in P.keep_language(spark, frame(spark, [*docs, *odd, mixed]), D).collect()}
    assert 8002 in got and not {8000, 8001} & got


def test_run(spark):
    out = P.run(spark, D)
    rows = out.orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert 0 < len({r.doc_id for r in rows}) < 200
