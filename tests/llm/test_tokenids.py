"""Exact round trips, and ids equal to those of whole texts."""

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from graphloom.llm import rangecoder as R
from graphloom.llm import tokenids
from graphloom.llm.workspace import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=400), st.integers(1, 4))
def test_any_ids_round_trip(ids, repeats):
    ids = np.array(ids * repeats, np.uint32)
    lengths, back = R.read_file(R.write_file(np.array([len(ids)]), ids, 300))
    assert (back == ids).all() and list(lengths) == [len(ids)]


def test_many_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "LEAST", 8)
    monkeypatch.setattr(R, "STREAMS", 4)
    monkeypatch.setattr(R, "GROUP", 5)
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50, 700), np.full(300, 7), np.tile([1, 2, 3, 4], 100), rng.integers(0, 49408, 333)]).astype(np.uint32)
    data = R.write_file(np.array([len(ids)]), ids, 49408)
    assert (R.read_file(data)[1] == ids).all()
    for at in (6, 20, 40, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises(ValueError, match="checksum"):
            R.read_file(bytes(bad))


def test_repetition_is_cheap():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(R.write_file(np.array([len(ids)]), ids, 49408)) < len(ids) / 4


def test_orders_beat_frequencies():
    """Ids that follow each other cost less than their entropy; ids that don't, hardly more."""
    rng = np.random.default_rng(5)
    n, kinds = 200_000, 300
    after = np.array([rng.permutation(kinds)[:2] for _ in range(kinds)])
    ids = np.zeros(n, np.uint32)
    pick, noise, any_id = rng.random(n) < 0.7, rng.random(n) < 0.2, rng.integers(0, kinds, n)
    for i in range(1, n):
        ids[i] = any_id[i] if noise[i] else after[ids[i - 1], int(pick[i])]
    bits = 8 * len(R.write_file(np.array([n]), ids, 1000)) / n
    best = 0.2 * np.log2(kinds) + 0.8 * (-0.7 * np.log2(0.7) - 0.3 * np.log2(0.3)) + 0.72  # which id, and whether noise
    assert best - 0.1 < bits < 1.25 * best
    flat = rng.integers(0, kinds, n).astype(np.uint32)
    assert 8 * len(R.write_file(np.array([n]), flat, 1000)) / n < 1.06 * np.log2(kinds)


def test_known_ids_are_narrowed_to_in_one_go(monkeypatch):
    """A step is one narrowing of all stretches, and one more only for ids that are new to a block."""
    whole, some = [], []
    narrow = R.Encoder.narrow
    monkeypatch.setattr(R.Encoder, "narrow", lambda self, lane, *a: (whole if isinstance(lane, slice) else some).append(1) or narrow(self, lane, *a))
    ids = np.random.default_rng(2).integers(0, 20, 1 << 16).astype(np.uint32)
    lengths, back = R.read_file(R.write_file(np.array([len(ids)]), ids, 20))
    assert (back == ids).all()
    assert len(whole) == len(ids) // R.STREAMS and len(some) <= 4


def test_stretches_of_any_size():
    """One stretch of a block is many times as long in words as the others, whose ids are foretold."""
    ids = np.zeros(1 << 16, np.uint32)
    ids[3000:4500] = np.random.default_rng(3).permutation(1 << 20)[:1500]
    assert (R.read_file(R.write_file(np.array([len(ids)]), ids, 1 << 20))[1] == ids).all()


def test_kept_pieces(monkeypatch):
    """Ids stay right while kept pieces grow in number, and after they are forgotten; different pieces have different keys."""
    monkeypatch.setattr(tokenids, "CACHE", 100_000)
    t = Tokenizer.from_file(PATH)
    kept = tokenids.Pieces(t, "</w>")
    rng = np.random.default_rng(4)
    for n in range(3):
        texts = [" ".join("".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(1, 24, 20_000)) for _ in range(3)]
        texts += ["1" * 50, "don't " + "x" * 7 + " " + "x" * 8 + " " + "x" * 16 + " " + "x" * 17]
        ids, counts = kept.encode(pa.array(texts))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        w = tokenids.pieces(pa.array(texts))[0]
        assert len(np.unique(tokenids.keys(w))) == len({w.word(i) for i in range(len(w))})


def test_no_pieces_without_the_file_saying_so():
    spec = json.loads(Tokenizer.from_file(PATH).to_str())
    assert tokenids.in_pieces(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "a"}]}, {"post_processor": {}}):
        assert not tokenids.in_pieces(spec | change)
    assert not tokenids.in_pieces(spec | {"model": spec["model"] | {"end_of_word_suffix": ""}})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBz'<|>. ,é×÷İßŒɐ́\x85\xa0\t\n09 漢😀s") | st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
def test_pieces_equal_whole_texts(texts):
    t = Tokenizer.from_file(PATH) if not _t else _t[0]
    _t[:] = [t]
    ids, n = tokenids.encoder(PATH)[0](pa.array(texts, pa.string()))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


_t: list = []


def run(spark, rows):
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, data string, part int").repartition(3)
    ws = Workspace(spark, "t")
    return tokenids.read(tokenids.write(d, ws, PATH), ws).collect()


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, 'quo"ted " 1'), (5002, "same id"), (5002, "same id"), (None, "no id"), (5003, "a<|endoftext|>b <|startoftext|> don't DON'T I'm"), (5004, "é e ́  x y　z \x1c Å"), (5005, "漢字 кириллица ΣΑΣ İ 😀👍 1234 12.5"), (5006, "w" * 30000), (-3, "first " * 9000)]
    assert sorted([tuple(r) for r in run(spark, rows)], key=repr) == brute(rows)
    assert run(spark, []) == []
