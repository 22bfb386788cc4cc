"""Quality rules: a hashed n-gram log-likelihood ratio of trusted target text against the raw corpus.

Runs of NGRAM bytes are hashed into `size` features; texts of any number have
about the same runs, so that features keep their meaning as a corpus grows, and
runs of symbols, shouting and broken text stand out. Two multinomials are
counted over whole tables, one over trusted documents, one over all. A
document's score is the sum over its features of log(p_target / p_raw),
divided by their number; a document is kept if the score is at or above a
threshold. Besides that there are plain base rules of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import SPACED, Words, slices, text_buffer, words
from .workspace import Workspace

#: Features; the counts of one table are this many numbers, whatever its size.
SIZE = 1 << 16
NGRAM = 4
#: Trusted ids that are sent to executors at a time, about; 8 bytes each.
BLOCK = 4_000_000
SYMBOLS = b"#*$%&|<>"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = 0x30
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0x20


def features(texts: pa.Array, size: int = SIZE, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of all runs of n bytes of each document; digits count as one, and so do kinds of white space."""
    raw, offsets = text_buffer(texts)
    if len(raw) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[raw].astype(np.uint32)
    m = len(x) - n + 1
    h = x[:m].copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h ^= x[k : k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(33 - size.bit_length())
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:m] == doc[n - 1 :]
    return h[whole].astype(np.int64), doc[:m][whole]


def count_features(docs: DataFrame, ids: np.ndarray, size: int = SIZE) -> DataFrame:
    """(feature, raw, target): how often each feature occurs in all of docs(text, id_hash), and where id_hash is among the sorted ids.

    A task adds up its share before the shuffle and sends at most `size` rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        known = sent.value
        for batch in batches:
            for part in slices(batch):
                f, doc = features(part.column("text"), size)
                raw += np.bincount(f, minlength=size)
                if len(known):
                    h = part.column("id_hash")
                    has = np.asarray(h.is_valid().to_numpy(zero_copy_only=False), bool)
                    h = h.fill_null(0).to_numpy(zero_copy_only=False)
                    trusted = has & (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                    target += np.bincount(f[trusted[doc]], minlength=size)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["feature", "raw", "target"])

    out = docs.select("text", "id_hash").mapInArrow(count, "feature int, raw long, target long")
    return out.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def count_all(docs: DataFrame, trusted: DataFrame, ws: Workspace, size: int = SIZE, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each feature over all of docs, and over all rows whose doc_id is in trusted(doc_id); `size` numbers a block come to the driver.

    Trusted ids are sent to the executors in blocks of about `block`, so that no
    text is shuffled. The first block is counted together with all of docs, the
    others on the rows of their block. An id is known by its 64-bit hash, which
    is one to one for whole numbers.
    """
    h = F.xxhash64(F.col("doc_id"))  # of one type on both sides
    ids = trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("doc_id is not null")
    ids = ws.write(ids.select(h.alias("id_hash")).distinct(), "trusted")
    blocks = max(1, -(-ids.count() // block))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.when(F.col("doc_id").isNotNull(), h).alias("id_hash"))
    raw, target = np.zeros(size), np.zeros(size)
    for k in range(blocks):
        mine = F.pmod("id_hash", F.lit(blocks)) == k
        known = np.sort(ids.where(mine).toArrow().column("id_hash").to_numpy())  # about `block` numbers
        for r in count_features(rows.where(mine) if k else rows, known, size).collect():  # at most `size` rows
            if k == 0:
                raw[r.feature] = r.raw
            target[r.feature] += r.target
    return raw, target


def fit(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each feature. Both are smoothed by as many features dealt as in the raw corpus: without target text every ratio is 0."""
    size = len(raw)
    p = (raw + 1) / (raw.sum() + size)
    q = (target + size * p) / (target.sum() + size)
    return np.log(q) - np.log(p)


def repeats(w: Words, n: int = 5) -> np.ndarray:
    """Per document, its words that are inside any run of n words which is found twice or more in it."""
    h, doc = w.hashes(), w.doc()
    if len(h) < n:
        return np.zeros(len(w.counts), np.int64)
    m = len(h) - n + 1
    run = h[:m].copy()
    for k in range(1, n):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        run ^= run >> np.uint64(29)
    whole = np.flatnonzero(doc[:m] == doc[n - 1 :])
    # equal runs of a document stand together
    key = (run[whole] ^ (doc[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = whole[order[twice]]
    mark = np.zeros(len(h) + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    return np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=len(w.counts))


def duplicate_lines(part: pa.Array) -> np.ndarray:
    """Per document, its \\n-split lines that have a word and equal an earlier line."""
    text, offsets = text_buffer(part)
    docs = len(offsets) - 1
    if not len(text):
        return np.zeros(docs, np.int64)
    cut = np.unique(np.concatenate([np.flatnonzero(text == 10) + 1, offsets[:-1], [len(text)]]))
    starts = cut[:-1]
    starts = starts[starts < len(text)]
    ends = np.append(starts[1:], len(text))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # drop the line feed, where there is one
    ends = ends - (text[ends - 1] == 10)
    # a line is the text between two cuts: hash all bytes, spaces too
    lines = Words(text, text, starts, np.maximum(starts, ends), np.bincount(doc, minlength=docs), offsets)
    h = lines.hashes()
    solid = SPACED[text] != 32
    upto = np.concatenate([[0], np.cumsum(solid)])
    wordy = upto[lines.ends] > upto[starts]
    h, doc = h[wordy], doc[wordy]
    key = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)[0].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    return np.bincount(doc, minlength=docs) - np.bincount(key, minlength=docs)


def per_document(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between edges."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[edges[1:]] - upto[edges[:-1]]


def rate(docs: DataFrame, log_ratio: np.ndarray, *, keys: list[str] | None = None, threshold: float, size: int = SIZE) -> DataFrame:
    """(keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every document.

    base_failed: fewer than 10 words, or more than a fifth of the words inside
    repeated runs of 5. score is 0 for a text without words. kept: the base rules
    hold and score >= threshold, so a score at the threshold passes; there is no
    chance in it. Null is an empty text; a very long text is rated whole; repeated
    rows are rated each; an empty table gives no rows; other columns aren't read.
    """
    keys = keys or ["doc_id"]
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            for part in slices(batch):
                exact = words(part.column("text"), SPACED)
                n = exact.counts
                chars = per_document((exact.text != 32) & ((exact.text & 0xC0) != 0x80), exact.offsets)
                symbols = per_document(symbol[exact.raw], exact.offsets)
                again = repeats(exact)
                f, doc = features(part.column("text"), size)
                total = np.bincount(doc, weights=ratio[f], minlength=len(n))
                score = np.round(total / np.maximum(1, np.bincount(doc, minlength=len(n))), 9)
                failed = (n < 10) | (100 * again > 20 * n)
                cols = [pa.array(x.astype(np.int64)) for x in (n, chars, symbols, duplicate_lines(part.column("text")), again)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *cols, pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=schema.names)

    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def assess(docs: DataFrame, trusted: DataFrame, ws: Workspace, *, threshold: float = -0.5, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Fit on all of docs, with all rows whose doc_id is in trusted(doc_id) as the target, and rate all of docs."""
    return rate(docs, fit(*count_all(docs, trusted, ws, size, block)), threshold=threshold, size=size)
