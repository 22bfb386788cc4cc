"""Token ids of documents as files of range-coded blocks, and back.

A file is one row of a table: the image that rangecoder.write_file() makes, and
the ids of its documents. Spark's writer commits such rows as a whole, on any
file system that it knows, and a retried task writes the same ones. Files hold
whole documents, in ascending doc_id order within a part and from part to part.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rangecoder import BLOCK, GROUP, read_file, write_file
from .tokens import Words, _table, mix64, slices, text_buffer
from .workspace import Workspace, buckets

#: Pieces whose ids a Python worker keeps, about 50 bytes each, and pieces that are encoded in one call.
CACHE, CALL = 4_000_000, 2000
#: Bits of the number of ids of a piece.
_N = 31
_open: dict[str, tuple] = {}

#: Classes of bytes. Letters are ASCII letters and those of U+00C0 to U+027F, which two bytes make; of what is odd, words are taken whole.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[ord("'"), ord("<")]] = _ODD
_CLASS, _LOWER = _CLASS.tobytes(), _table(set(), lower=True).tobytes()


def pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The pieces of every text, and whether each is an odd word.

    A piece is a run of letters, one digit, or a run of other printable ASCII; a
    word (between ASCII white space) with anything else in it is one piece, so
    that nothing has to be known of it: apostrophes (contractions), "<" (added
    tokens), control characters, characters beyond Latin letters.
    """
    raw, offsets = text_buffer(texts)
    data = raw.tobytes()
    kind = np.frombuffer(bytearray(data.translate(_CLASS)), np.uint8)
    text = np.frombuffer(bytearray(data.translate(_LOWER)), np.uint8)
    # times and division signs are no letters, and a small dotted I is two characters
    lead = np.flatnonzero((raw[:-1] == 0xC3) | (raw[:-1] == 0xC4))
    two = raw[lead].astype(np.uint16) << 8 | raw[lead + 1]
    kind[lead[(two == 0xC397) | (two == 0xC3B7) | (two == 0xC4B0)]] = _ODD
    solid = kind != _SPACE
    new = np.ones(len(kind) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        edge = np.ones(len(kind) + 1, bool)  # words start and end, and white space in between
        np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
        edge[offsets] = True
        edge = np.flatnonzero(edge)
        word = np.unique(np.searchsorted(edge, odd, side="right"))
        start, end = edge[word - 1], edge[word]
        inside = _spans(start, end - start)
        text[inside] = raw[inside]
        kind[inside] = _ODD
        new[inside] = False
        new[start] = new[end] = True
    new[:-1] |= kind == _DIGIT
    new[offsets] = True
    starts = np.flatnonzero(solid & new[:-1])
    ends = np.flatnonzero(solid & new[1:]) + 1
    at = np.searchsorted(starts, offsets)
    return Words(raw, text, starts, ends, np.diff(at), offsets), kind[starts] == _ODD


def keys(w: Words) -> np.ndarray:
    """A number of each piece, not 0: up to 7 bytes are their own, others are hashed."""
    size = w.ends - w.starts
    padded = np.zeros(len(w.text) + 16, np.uint8)
    padded[: len(w.text)] = w.text
    # 8 bytes from any place
    eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    key = eight[w.starts]
    short = size < 8
    key &= _BELOW.take(size, mode="clip")
    key |= np.where(short, size, 0).astype(np.uint64) << np.uint64(56)
    key = mix64(key)
    for n, which in ((16, (size > 7) & (size <= 16)), (size.max(initial=0), size > 16)):
        which = np.flatnonzero(which)
        if n == 16:
            # two overlapping runs of 8
            k = mix64(key[which] + size[which].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            key[which] = mix64(k ^ eight[w.ends[which] - 8] * np.uint64(0x9E6C63D0876A9A35))
        else:
            key[which] = [xxhash.xxh3_64_intdigest(w.text[a:b].tobytes()) for a, b in zip(w.starts[which].tolist(), w.ends[which].tolist())]
    return np.maximum(key, np.uint64(1))


#: Masks of the first 0 to 8 bytes.
_BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def in_pieces(spec: dict) -> bool:
    """Whether a tokenizer file encodes pieces() each on their own, and the last id of each ends in the model's suffix: NFC, white space, lower case; letters, single digits, other runs; BPE."""
    n, p, m = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in n.get("normalizers", [])]
    splits = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in p.get("pretokenizers", [])]
    return (
        steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
        and splits == [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and (m.get("type"), bool(m.get("end_of_word_suffix")), m.get("dropout"), spec.get("post_processor")) == ("BPE", True, None, None)
        and all("<" in t["content"] for t in spec.get("added_tokens", []))
    )


class Pieces:
    """Ids of pieces, for one tokenizer: those seen before are kept, in a hash table with open addresses."""

    def __init__(self, tokenizer, suffix: str):
        self.t = tokenizer
        self.ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for x, i in tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.ids, self.n_ids, self.kinds = np.zeros(1 << 16, np.uint32), 0, 0
        self.key, self.value = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or the free place where it may go."""
        mask = len(self.key) - 1
        at = (key & np.uint64(mask)).view(np.int64)
        found = self.key.take(at)
        todo = np.flatnonzero((found != key) & (found != 0))
        while len(todo):
            at[todo] = there = at[todo] + 1 & mask
            found = self.key[there]
            todo = todo[(found != key[todo]) & (found != 0)]
        return at

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Add different keys that the table lacks."""
        self.kinds += len(key)
        if 2 * self.kinds > len(self.key):
            old = np.flatnonzero(self.key)
            key, value = np.concatenate([self.key[old], key]), np.concatenate([self.value[old], value])
            room = 1 << int(4 * self.kinds - 1).bit_length()
            self.key, self.value = np.zeros(room, np.uint64), np.zeros(room, np.int64)
        while len(key):
            at = self.find(key)
            self.key[at] = key  # of several keys for one free place the last one gets it
            mine = self.key[at] == key
            self.value[at[mine]] = value[mine]
            key, value = key[~mine], value[~mine]

    def spell(self, w: Words, which: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of some pieces."""
        text = lambda j: w.text[w.starts[j] : w.ends[j]].tobytes().decode()
        ids: list[np.ndarray] = []
        n = np.zeros(len(which), np.int64)
        plain = np.flatnonzero(~odd[which])
        alone = np.flatnonzero(odd[which]).tolist()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(plain), CALL):
            some = plain[at : at + CALL]
            start, size = w.starts[which[some]], w.ends[which[some]] - w.starts[which[some]] + 1
            joined = w.text[np.minimum(_spans(start, size), len(w.text) - 1)]
            joined[np.cumsum(size) - 1] = 0x20
            x = np.array(self.t.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[x]) + 1
            if len(stop) == len(some) and stop[-1] == len(x):
                kept.append((some, x))
                n[some] = np.diff(stop, prepend=0)
            else:  # not one piece each after all
                alone += some.tolist()
        if alone:
            x = [e.ids for e in self.t.encode_batch_fast([text(which[i]) for i in alone], add_special_tokens=False)]
            n[alone] = [len(e) for e in x]
            kept.append((np.array(alone), np.array([i for e in x for i in e], np.uint32)))
        out = np.zeros(int(n.sum()), np.uint32)
        start = np.cumsum(n) - n
        for some, x in kept:
            out[_spans(start[some], n[some])] = x
        return out, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w, odd = pieces(texts)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        key = keys(w)
        if self.kinds > CACHE:
            self.clear()
        at = self.find(key)
        missing = np.flatnonzero(self.key[at] == 0)
        if len(missing):
            kinds, one = np.unique(key[missing], return_index=True)
            ids, n = self.spell(w, missing[one], odd)
            start, self.n_ids = self.n_ids, self.n_ids + len(ids)
            if self.n_ids > len(self.ids):
                self.ids = np.concatenate([self.ids[:start], np.zeros(2 * self.n_ids - start, np.uint32)])
            self.ids[start : self.n_ids] = ids
            self.put(kinds, (start + np.cumsum(n) - n << _N) + n)
            at = self.find(key)
        value = self.value.take(at)
        n = value & (1 << _N) - 1
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.ids.take(_spans(value >> _N, n)), np.diff(upto[w.first()])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def encoder(path: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], int]:
    """(a function from texts to (ids, ids of each text), vocabulary size) of a tokenizers file.

    If the file says that pieces() are encoded each on their own, each is encoded
    once and its ids are kept; otherwise texts are encoded as they are.
    """
    if path not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        spec = json.loads(t.to_str())

        def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            x = [e.ids for e in t.encode_batch_fast([v or "" for v in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for e in x for i in e], np.uint32), np.array([len(e) for e in x], np.int64)

        _open[path] = (Pieces(t, spec["model"]["end_of_word_suffix"]).encode if in_pieces(spec) else whole, t.get_vocab_size())
    return _open[path]


def write(docs: DataFrame, ws: Workspace, tokenizer: str, *, end: int = 1, name: str = "files") -> DataFrame:
    """Encode every whole text and write files: a table (part, seq, doc_ids, n_ids, data).

    Rows of one doc_id are ordered by their text, equal rows are written each;
    null ids come last. A null or empty text has no ids but the end id, which
    closes every document. A very long text is encoded whole, in the file that
    its document starts in. An empty table gives an empty table. Other columns,
    whatever their names, are not read.
    """
    nb = buckets(ws.spark)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode, size = encoder(tokenizer)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            data = write_file(n, np.concatenate(ids), size)
            rows = [[part], [seq], [pa.concat_arrays(names).to_pylist()], [int(n.sum())], [data]]
            from pyspark.sql.pandas.types import to_arrow_schema

            s = to_arrow_schema(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, s)], schema=s)

        for batch in batches:
            for x in slices(batch, most=2 << 20):
                found, n = encode(x.column("text"))
                closed = np.insert(found, np.cumsum(n), end).astype(np.uint32)
                ids.append(closed)
                lengths.append(n + 1)
                names.append(x.column("doc_id"))
                held += len(closed)
                if held >= BLOCK * GROUP:
                    yield flush()
                    ids, lengths, names, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last()]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(nb, *order).sortWithinPartitions(*order, F.coalesce("text", F.lit("")))
    return ws.write(rows.mapInArrow(run, schema), name)


def read(files: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files alone: one row for each row that was written.

    A damaged file raises an error; no files give no rows. Documents of equal
    doc_id, nulls too, have the places that write() gave them.
    """
    fields = [T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("doc_id", files.schema["doc_ids"].dataType.elementType), T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, ids = read_file(batch.column("data")[row].as_py())
                n = lengths.astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(n)])
                data = ids.astype("<u4")
                crc = np.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])], np.int64)
                m = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, batch.column("part")[row].as_py(), np.int32)), pa.array(np.full(m, batch.column("seq")[row].as_py(), np.int32)), batch.column("doc_ids")[row].values, pa.array(edge[:-1]), pa.array(n), pa.array(crc)], names=[f.name for f in fields])

    out = files.select("part", "seq", "doc_ids", "data").mapInArrow(run, T.StructType(fields))
    # ids before each file: of earlier parts, and of earlier files of its part
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ws.write(sizes.withColumn("files_before", inside).join(parts, "part").select("part", "seq", (F.col("before") + F.col("files_before")).alias("base")), "bases")
    return out.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
