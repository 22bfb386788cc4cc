"""Archives: round trips, plain readers, and the contract against brute force and DuckDB."""

import hashlib
import io
import random
import struct
from collections import Counter

import duckdb
import pytest
import zstandard
from graphloom.llm import registry
from graphloom.llm import warc as W
from graphloom.llm.workspace import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st

HTML = "<html><head><title>{0}</title></head><body>" + "<p class='x'>some text of page {0}</p>" * 40 + "</body></html>"


def run(spark, rows, **more):
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, key string, n int").repartition(3)
    return W.write(d, Workspace(spark, "t"), **more)


def brute(rows, least=1000):
    out = []
    tops = {}
    for k, _, html in rows:
        p = (html or "").encode()
        tops.setdefault(p, []).append(k)
    left = {p: Counter([max(ks, key=lambda k: (k is not None, k or 0))]) for p, ks in tops.items()}
    for k, _, html in rows:
        p = (html or "").encode()
        top = next(iter(left[p].keys())) if left[p] else None
        first = len(p) < least or left[p].get(k, 0) > 0
        if len(p) >= least and first:
            left[p][k] -= 1
        out.append((k, len(p), hashlib.sha1(p).hexdigest(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def rows_of(archives):
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read(archives).collect()), key=repr)


ODD = [(None, "http://a/none", HTML.format(1)), (7, None, HTML.format(1)), (7, None, HTML.format(1)), (3, "http://a/b c\r\nX: y", HTML.format(1)), (4, "http://a/ü", None), (5, "", ""), (6, "u", "é" * 500), (8, "u", "é" * 499 + "x"), (9, "u", "é" * 500), (10, "v", "short"), (11, "v", "short"), (-2, "w", "\x00\r\n\r\nWARC/1.1\r\n" * 100), (12, "long", "ab" * 1_000_000)]


def test_records(spark):
    rows = ODD + [(100 + i, f"http://x/{i}", HTML.format(i % 37)) for i in range(300)]
    got = run(spark, rows)
    assert rows_of(got) == brute(rows)
    back = {(r.key, r.url, r.payload_digest): r for r in W.read(got, payload=True).where("record_type = 'response'").collect()}
    for k, u, html in rows:
        p = (html or "").encode()
        hit = [r for (key, _, d), r in back.items() if d == hashlib.sha1(p).hexdigest()]
        assert hit and bytes(hit[0].payload) == p
    ids = [(r.record_id, r.refers_to_id) for r in W.read(got).collect()]
    assert len({i for i, _ in ids}) == len(rows) and {r for _, r in ids if r} <= {i for i, _ in ids}


def test_hot_copies_and_repeats(spark, monkeypatch):
    """A third of all rows are one page, another third copies of one payload."""
    monkeypatch.setattr(W, "REPEATS", 16)
    rows = [(1, "u", HTML.format(0))] * 400 + [(1000 + i, "u", HTML.format(1)) for i in range(400)] + [(5000 + i, "u", HTML.format(i)) for i in range(2, 400)]
    assert rows_of(run(spark, rows)) == brute(rows)


def test_empty(spark):
    got = run(spark, [])
    assert got.count() == 0 and W.read(got).collect() == []


def test_any_stream_reader_reads_an_archive():
    """One pass over concatenated frames with the embedded dictionary gives all records in order."""
    rows = [W.record(i, f"http://x/{i}", HTML.format(i).encode(), len(HTML.format(i)), hashlib.sha1(HTML.format(i).encode()).hexdigest(), None, None, 0) for i in range(200)]
    data = W.pack(rows)
    magic, n = struct.unpack_from("<II", data)
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
    assert magic == 0x184D2A5D and struct.unpack_from("<I", known.as_bytes())[0] == W.DICT
    d = zstandard.ZstdDecompressor(dict_data=known)
    assert d.stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True).read() == b"".join(rows)
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in rows)
    assert len(data) < alone / 2
    bad = bytearray(data)
    bad[-2] ^= 1
    with pytest.raises(zstandard.ZstdError):
        list(W.unpack(bytes(bad)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=30), st.integers(1, 60))
def test_any_records_round_trip(rows, times):
    assert list(W.unpack(W.pack(rows * times))) == rows * times


def test_large_frames():
    r = random.Random(1)
    rows = [r.randbytes(1_000_000), b"a" * 3_000_000, b"", b"x" * 200 + r.randbytes(140_000)]
    assert list(W.unpack(W.pack(rows))) == rows


def test_a_wrong_payload_raises():
    raw = W.record(1, "u", b"body", 4, hashlib.sha1(b"body").hexdigest(), None, None, 0)
    assert W.parse(raw)["payload"] == b"body"
    for bad in (raw.replace(b"body", b"bodx"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/0.9")):
        with pytest.raises(ValueError):
            W.parse(bad)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = registry.op11_warc_dictionary(spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = con.sql(registry.ORACLES["op11_warc_dictionary"])
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
