"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings of every training token. It is split by documents
into segments of a few megabytes of text, one row each: the sorted terms of the
segment, how often each occurs, and where. A query phrase is answered in every
segment on its own, from its rarest term there: that term's postings, less its
offset in the phrase, are the candidate starts, and the postings of the next
rarest terms, less their offsets, are intersected with them one after the other
until none is left or all terms agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import ALNUM_LOWER, slices, words
from .workspace import Workspace

#: Positions between two documents of a segment; no phrase or span is longer.
GAP = 64
#: Candidates that one step of an intersection holds.
STEP = 1 << 20
#: Words of test items that are sent to the executors at once, 16 bytes each; more are asked in blocks.
BLOCK_WORDS = 2_000_000


def build_index(docs: DataFrame, ws: Workspace, keys: list[str], table=ALNUM_LOWER, name: str = "index") -> DataFrame:
    """Index every document: rows (segment: keys, n_words, terms, freqs, postings), written in the shared folder.

    keys are the columns that name a document. Null texts have no words.
    """
    fields = {f.name: f for f in docs.schema}
    schema = T.StructType([T.StructField(k, T.ArrayType(fields[k].dataType)) for k in keys] + [T.StructField(c, T.BinaryType()) for c in ("n_words", "terms", "freqs", "postings")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), table)
                h = w.hashes()
                at = np.arange(len(h)) + GAP * w.doc()
                order = np.argsort(h, kind="stable")
                terms, freqs = np.unique(h[order], return_counts=True)
                at = at[order].astype(np.uint32)
                start = np.concatenate([[0], np.cumsum(freqs)[:-1]]) if len(freqs) else np.zeros(0, int)
                gaps = np.diff(at, prepend=np.uint32(0))  # wraps at a term's first posting, which is kept whole
                gaps[start] = at[start]
                cols = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in keys]
                blobs = [w.counts.astype(np.uint32), terms, freqs.astype(np.uint32), gaps]
                cols += [pa.array([x.tobytes()], pa.binary()) for x in blobs]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "n_words", "terms", "freqs", "postings"])

    built = docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(build, schema)
    return ws.write(built.withColumn("segment", F.monotonically_increasing_id()), name)


class Segment:
    """One segment of the index, opened."""

    def __init__(self, n_words: bytes, terms: bytes, freqs: bytes, postings: bytes):
        self.n_words = np.frombuffer(n_words, np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]) + GAP * np.arange(len(self.n_words)) if len(self.n_words) else np.zeros(0, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.freqs = np.frombuffer(freqs, np.uint32).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.freqs)])
        term = np.repeat(np.arange(len(self.terms), dtype=np.uint64), self.freqs)
        gaps = np.frombuffer(postings, np.uint32).astype(np.uint64)
        run = np.cumsum(gaps)
        base = np.concatenate([[np.uint64(0)], run])[self.start[:-1]] if len(self.terms) else run
        #: (term << 32 | position), sorted
        self.keys = (term << np.uint64(32)) | (run - np.repeat(base, self.freqs))

    def __len__(self) -> int:
        return int(self.first[-1] + self.n_words[-1]) if len(self.first) else 0

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this segment; -1 if it isn't here."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term is at each position."""
        want = (term.astype(np.uint64) << np.uint64(32)) | position.astype(np.uint64)
        return (position >= 0) & (self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want)

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term is anywhere from low to high."""
        t = term.astype(np.uint64) << np.uint64(32)
        at = np.searchsorted(self.keys, t | np.maximum(low, 0).astype(np.uint64))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= (t | high.astype(np.uint64)))

    def candidates(self, phrases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For phrases (rows of term numbers, all in this segment), blocks of (phrase, order of its terms from the rarest, its terms in that order, postings of the rarest, phrase of each posting)."""
        order = np.argsort(self.freqs[phrases], axis=1, kind="stable")
        ranked = np.take_along_axis(phrases, order, 1)
        n = self.freqs[ranked[:, 0]]
        upto = np.cumsum(n)
        a = 0
        while a < len(phrases):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, side="right")))
            m = n[a:b]
            of = np.repeat(np.arange(a, b), m)
            inside = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(m)[:-1]]), m)
            at = (self.keys[self.start[ranked[of, 0]] + inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield order, ranked, of, at
            a = b

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence."""
        out = []
        for order, ranked, of, at in self.candidates(phrases):
            start = at - order[of, 0]
            keep = start >= 0
            of, start = of[keep], start[keep]
            for k in range(1, phrases.shape[1]):
                keep = self.has(ranked[of, k], start + order[of, k])
                of, start = of[keep], start[keep]
            out.append((of, start))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))

    def close(self, phrases: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest term) where all other terms are within reach words of it, in any order."""
        out = []
        for _, ranked, of, at in self.candidates(phrases):
            for k in range(1, phrases.shape[1]):
                keep = self.near(ranked[of, k], at - reach, at + reach)
                of, at = of[keep], at[keep]
            out.append((of, at))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


@dataclass
class Queries:
    """Phrases of one length, and the items that each belongs to."""

    phrases: np.ndarray  # uint64 [n, length]
    of: np.ndarray  # phrase of each (phrase, item)
    item: np.ndarray  # its item, a place in names


def windows(items: list[tuple[str, str | None]], window: int, table=ALNUM_LOWER) -> tuple[list[str], list[Queries]]:
    """All windows of `window` words of the items; a shorter item is one window."""
    names = sorted({a for a, _ in items})
    place = {a: i for i, a in enumerate(names)}
    w = words(pa.array([b for _, b in items], pa.string()), table)
    h, first = w.hashes(), w.first()
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, (a, _) in enumerate(items):
        x = h[first[i] : first[i + 1]]
        if len(x):
            n = min(window, len(x))
            by_length.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(x, n), np.full(len(x) - n + 1, place[a])))
    out = []
    for n in sorted(by_length):
        rows, item = (np.concatenate(x) for x in zip(*by_length[n]))
        phrases, of = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of.reshape(-1), item]), axis=1)
        out.append(Queries(phrases, pairs[0], pairs[1]))
    return names, out


def matches(index: DataFrame, items: DataFrame, keys: list[str], *, window: int = 10, reach: int | None = None) -> DataFrame:
    """Ask every window of all items in every segment: (keys, n_words, n_hit, items, near_items) for every document.

    n_hit counts the words inside any exact occurrence of a window, items are the
    ids (as strings, sorted) of the items with occurring windows, and near_items
    those of items of which a window's terms all occur within `reach` words of
    its rarest, in any order (null without reach). Items are asked in blocks of at most
    BLOCK_WORDS words; what blocks find is put together by document, so no more
    than that is sent to the executors at once. Null item texts have no windows; a null id is "".
    """
    spark = index.sparkSession
    key_fields = [T.StructField(k, index.schema[k].dataType.elementType) for k in keys]
    schema = T.StructType([*key_fields, T.StructField("segment", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("near_items", T.ArrayType(T.StringType()))])
    ids = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))

    def ask(names, queries):
        sent = spark.sparkContext.broadcast((names, queries))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, queries = sent.value
            asked = [(q, *np.unique(q.phrases, return_inverse=True)) for q in queries]
            for batch in batches:
                for row in range(batch.num_rows):
                    seg = Segment(*(batch.column(c)[row].as_py() for c in ("n_words", "terms", "freqs", "postings")))
                    docs = len(seg.n_words)
                    spans: list[np.ndarray] = []
                    hit_pairs, near_pairs = [], []
                    for q, vocabulary, where in asked:
                        if not len(seg):
                            continue
                        here = seg.find(vocabulary)[where.reshape(q.phrases.shape)]
                        live = np.flatnonzero((here >= 0).all(1))
                        if not len(live):
                            continue
                        n = q.phrases.shape[1]
                        of, start = seg.exact(here[live])
                        spans.append(np.stack([start, start + n]))
                        hit_pairs.append(pair_up(q, live[of], seg, start))
                        if reach is not None:
                            of, at = seg.close(here[live], reach)
                            near_pairs.append(pair_up(q, live[of], seg, at))
                    hits, near = lists(hit_pairs, docs, names), lists(near_pairs, docs, names) if reach is not None else [None] * docs
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k)[row].values for k in keys), pa.array(np.full(docs, batch.column("segment")[row].as_py())), pa.array(np.arange(docs)), pa.array(seg.n_words), merged(spans, seg), pa.array(hits, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                        names=schema.names,
                    )

        return index.mapInArrow(search, schema)

    found = [ask(*windows(block, window)) for block in in_blocks(ids)]
    if len(found) == 1:
        return found[0]
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    put = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    near = put("near_items") if reach is not None else F.lit(None).cast("array<string>").alias("near_items")
    return both.groupBy("segment", "place", *keys, "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), put("items"), near)


def in_blocks(ids: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most `most` words (an item of more is a block), of which one is held at a time; at least one block."""
    block: list[tuple[str, str | None]] = []
    room = most
    for r in ids.toLocalIterator():
        n = len(r.text or "") // 2 + 1  # no text has more words
        if n > room and block:
            yield block
            block, room = [], most
        block.append((r.item_id, r.text))
        room -= n
    yield block


def pair_up(q: Queries, phrase: np.ndarray, seg: Segment, at: np.ndarray) -> np.ndarray:
    """Distinct (document, item) of found phrases."""
    doc = np.searchsorted(seg.first, at, side="right") - 1
    pairs = np.unique(np.stack([doc, phrase]), axis=1) if len(doc) else np.zeros((2, 0), int)
    a, b = np.searchsorted(q.of, pairs[1]), np.searchsorted(q.of, pairs[1], side="right")
    doc = np.repeat(pairs[0], b - a)
    item = q.item[np.repeat(a, b - a) + np.arange(len(doc)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
    return np.stack([doc, item])


def lists(pairs: list[np.ndarray], docs: int, names: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(docs)]
    if pairs:
        for doc, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
            out[doc].append(names[item])
    return out


def merged(spans: list[np.ndarray], seg: Segment) -> pa.Array:
    """Per document a flat list of the starts and ends (in words of the document) of its hit passages, overlapping ones made one."""
    docs = len(seg.n_words)
    flat: list[list[int]] = [[] for _ in range(docs)]
    if spans:
        both = np.concatenate(spans, axis=1)
        both = both[:, np.argsort(both[0], kind="stable")]
        if both.shape[1]:
            top = np.maximum.accumulate(both[1])
            new = np.concatenate([[True], both[0][1:] > top[:-1]])
            starts = both[0][new]
            ends = top[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(top) - 1]])]
            doc = np.searchsorted(seg.first, starts, side="right") - 1
            for d, a, b in zip(doc, starts - seg.first[doc], ends - seg.first[doc]):
                flat[d] += [int(a), int(b)]
    return pa.array(flat, pa.list_(pa.int64()))


def decontaminate(docs: DataFrame, items: DataFrame, ws: Workspace, *, keys: list[str] | None = None, window: int = 10, reach: int | None = 12) -> DataFrame:
    """(keys, n_words, n_hit, spans, items, near_items) for every document.

    Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z
    lower-cased. Null and empty texts have no words and no hits; repeated rows
    are answered each; an empty table on either side gives no rows, or no hits.
    A very long text is indexed and searched whole. Of items of equal words each
    is found. Columns of docs other than text and keys are not read.
    """
    keys = keys or ["doc_id"]
    index = build_index(docs, ws, keys)
    found = matches(index, items, keys, window=window, reach=reach)
    # spans of different blocks may overlap: sort them as pairs and count each word once
    pairs = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("spans") - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i < F.size("spans"))), lambda i: F.struct(F.element_at("spans", i + 1).alias("a"), F.element_at("spans", i + 2).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    count = F.aggregate("spans", start, lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(s["upto"], p["a"]))).alias("n"), F.greatest(s["upto"], p["b"]).alias("upto")), lambda s: s["n"])
    return found.withColumn("spans", pairs).withColumn("n_hit", count).select(*keys, "n_words", "n_hit", "spans", "items", "near_items")
