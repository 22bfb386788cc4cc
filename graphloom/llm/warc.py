"""WARC archives with one Zstandard dictionary each, and back.

An archive is one row of a table: a skippable frame with the dictionary, then one
frame a record, as the WARC/Zstandard convention has it, so that any record can be
read alone. The dictionary is trained on all records of its archive. Spark's writer
commits such rows as a whole, on any file system that it knows.

Of pages with equal payloads one is a response; the others revisit it and carry no
payload, so their records are made from digests alone: payloads are shuffled once,
after tasks have reduced them to one a digest, and no group of copies meets in a task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, with_keyed

#: Bytes of records in an archive, at least (the last of a task has fewer); largest dictionary; share of an archive's records that a dictionary may be as large as.
ARCHIVE, DICTIONARY, SHARE = 16 << 20, 112_640, 50
#: Repeats of a revisit that one row is expanded into at once.
REPEATS = 1 << 12

# Magic numbers of frames and dictionaries, the skippable one that holds a dictionary, the profile of revisits.
FRAME, DICT, SKIPPABLE = 0xFD2FB528, 0xEC30A437, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, ws: Workspace, key: str, url: str, payload: str, least: int) -> DataFrame:
    """(key, url, body, size, digest, top_key, top_url, copy): a row for each record; body is null for revisits of (top_key, top_url), copy tells equal rows apart."""
    empty = F.unhex(F.lit(""))
    body = F.coalesce(F.col(payload).cast("string").cast("binary"), empty)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long"))
    sha1 = F.sha1("body").alias("digest")
    nothing = [F.lit(None).cast(rows.schema["key"].dataType).alias("top_key"), F.lit(None).cast("string").alias("top_url")]
    small = rows.where(F.col("size") < least).select("key", "url", "body", "size", sha1, *nothing, F.monotonically_increasing_id().alias("copy"))
    # equal payloads are those of equal SHA-256 and size: SHA-1 has known collisions
    big = rows.where(F.col("size") >= least).withColumn("same", F.unhex(F.sha2("body", 256)))
    found = big.groupBy("same", "size").agg(F.max_by(F.struct("key", "url", "body"), F.struct("key", "url")).alias("r"))
    response = found.select("r.key", "r.url", "r.body", "size", F.sha1("r.body").alias("digest"), *nothing, F.lit(0).cast("long").alias("copy"))
    names = ws.write(big.select("same", "size", sha1, "key", "url").groupBy("same", "size", "digest", "key", "url").agg(F.count(F.lit(1)).alias("times")), "names")
    tops = names.groupBy("same").agg(F.max(F.struct("key", "url")).alias("top"), F.sum("times").alias("n")).where("n > 1")
    total = names.agg(F.sum("times")).first()[0] or 0
    named = with_keyed(ws, names, tops, "same", total).where("top is not null")
    is_top = F.col("key").eqNullSafe(F.col("top.key")) & F.col("url").eqNullSafe(F.col("top.url"))
    again = named.withColumn("left", F.col("times") - F.when(is_top, 1).otherwise(0)).where("left > 0")
    # however often one row comes, no array is longer than REPEATS
    again = again.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("left") - 1, F.lit(REPEATS)))).withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + REPEATS, F.col("left")) - 1)))
    revisit = again.select("key", "url", F.lit(None).cast("binary").alias("body"), "size", "digest", F.col("top.key").alias("top_key"), F.col("top.url").alias("top_url"), (F.col("copy") + 1).alias("copy"))
    return small.unionByName(response).unionByName(revisit)


def name(key, url: str | None, digest: str, copy: int) -> str:
    """The id of a record, the same on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((key, url, digest, copy)))}>"


def record(key, url, body, size: int, digest: str, top_key, top_url, copy: int) -> bytes:
    """One WARC record: a response, or a revisit if there is no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (body or b"")
    text = lambda x: quote(str(x), safe=";/?:@&=+$,#%-_.!~*'()[]|")
    head = [("WARC-Type", "response" if body is not None else "revisit"), ("WARC-Record-ID", name(key, url, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", text(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if key is not None:
        head.append(("Page-ID", quote(str(key), safe="")))
    if body is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(top_key, top_url, digest, 0))]
        if top_url is not None:
            head.append(("WARC-Refers-To-Target-URI", text(top_url)))
        if top_key is not None:
            head.append(("Refers-To-Page-ID", quote(str(top_key), safe="")))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def pack(rows: list[bytes], level: int = 3) -> bytes:
    """The archive of some records. Without enough to learn from, its dictionary frame is left out."""
    import zstandard as Z

    size = min(DICTIONARY, sum(map(len, rows)) // SHARE)
    trained = None
    if len(rows) >= 8 and size >= 1024:
        try:
            trained = Z.train_dictionary(size, rows, k=64, d=8, f=20, accel=4, level=level)
        except Z.ZstdError:  # records too short or too few to learn from
            trained = None
    out = []
    if trained:
        trained.precompute_compress(level=level)
        inside = Z.ZstdCompressor(level=19).compress(trained.as_bytes())
        out += [struct.pack("<II", SKIPPABLE, len(inside)), inside]
    c = Z.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True) if trained else Z.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    return b"".join(out + [c.compress(r) for r in rows])


def frame_size(data: memoryview) -> int:
    """Bytes of the frame that data starts with, from the headers of its blocks."""
    import zstandard as Z

    head = bytes(data[:32])
    at = Z.frame_header_size(head)
    last = False
    while not last:
        b = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = b & 1, b >> 1 & 3, b >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + (4 if Z.get_frame_parameters(head).has_checksum else 0)


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    import zstandard as Z

    view, at, known = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", view, 4)[0]
        inside, at = bytes(view[8 : 8 + n]), 8 + n
        if struct.unpack_from("<I", inside)[0] == FRAME:
            inside = Z.ZstdDecompressor().decompress(inside)
        known = Z.ZstdCompressionDict(inside)
    d = Z.ZstdDecompressor(dict_data=known) if known else Z.ZstdDecompressor()
    while at < len(view):
        n = frame_size(view[at:])
        yield d.decompress(view[at : at + n])
        at += n


def parse(raw: bytes) -> dict:
    """Fields of one record: its headers, and of its block the payload's size and, for a response, the payload. Raises an error if they don't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines)
    size = int(h["Content-Length"])
    if first != "WARC/1.1" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a damaged record")
    http, _, body = rest[:size].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = h["WARC-Type"] == "response"
    if response and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("a payload that doesn't have its digest")
    text = lambda k: unquote(h[k]) if k in h else None
    return {"id": h["WARC-Record-ID"], "key": text("Page-ID"), "url": h.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": text("Refers-To-Page-ID"), "refers_to_id": h.get("WARC-Refers-To"), "payload": body if response else None}


def write(pages: DataFrame, ws: Workspace, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, level: int = 3, table: str = "archives") -> DataFrame:
    """Archive every row of pages: a table (part, seq, n_records, raw_bytes, data) with one archive a row.

    A null payload is empty. Of rows with equal payloads of at least `least` bytes
    that with the largest (key, url) is the response (nulls are least) and the others
    revisit it, equal rows too; smaller payloads are responses each. A very long
    payload is in an archive of its own or the last of one. A null key or url has no
    header. An empty table gives no archives. Other columns aren't read.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_records", T.LongType()), T.StructField("raw_bytes", T.LongType()), T.StructField("data", T.BinaryType())])
    cols = ["key", "url", "body", "size", "digest", "top_key", "top_url", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.taskcontext import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, to_arrow_schema(schema)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = [part, seq, len(held), size, pack(held, level)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)

        for batch in batches:
            # a row at a time, so that no batch of payloads is there twice
            for row in zip(*[batch.column(c) for c in cols]):
                held.append(record(*[v.as_py() for v in row]))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return ws.write(records(pages, ws, key, url, payload, least).select(*cols).mapInArrow(run, schema), table)


def read(archives: DataFrame, key_type: T.DataType | str = "long", payload: bool = False) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id) of every record, from archives alone; with its payload if asked for (null for revisits). A damaged archive raises an error."""
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "id", "refers_to_id", *(["payload"] if payload else [])]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "payload_bytes" else T.BinaryType() if n == "payload" else T.StringType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for data in batch.column("data"):
                rows, size = [], 0
                for raw in unpack(data.as_py()):
                    rows.append(parse(raw))
                    size += len(raw) if payload else 0
                    if len(rows) == 2000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=out)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=out)

    got = archives.select("data").mapInArrow(run, schema)
    return got.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type)).withColumnRenamed("id", "record_id")
