"""Words of Arrow text columns as 64-bit hashes, with numpy only.

A word's hash depends on its bytes alone, so it is the same on every executor.
Different words share a hash with a chance of about 2^-64 a pair: 3 in a hundred
that any two of a billion words do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = 32


def _table(separators: set[int], lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = _SPACE
    return t


#: Words are runs of anything but ASCII white space; A-Z stays, or becomes a-z.
SPACED = _table({0x20, *range(0x09, 0x0E)}, lower=False)
SPACED_LOWER = _table({0x20, *range(0x09, 0x0E)}, lower=True)
#: Words are runs of ASCII letters and digits and all other characters beyond ASCII; A-Z becomes a-z.
ALNUM_LOWER = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)

#: A random odd multiplier and random values of the 256 bytes.
_P = np.uint64(0x9E6C63D0876A9A35)
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG = 40


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """The words of a run of documents, in order."""

    raw: np.ndarray  # uint8, the texts as they are
    text: np.ndarray  # uint8, separators are spaces
    starts: np.ndarray  # byte where each word starts
    ends: np.ndarray
    counts: np.ndarray  # words of each document
    offsets: np.ndarray  # bytes where documents start, and the end

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """The document (its place in the run) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def first(self) -> np.ndarray:
        """The place of each document's first word, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        """A uint64 of each word."""
        size = self.ends - self.starts
        h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(np.minimum(size, _LONG + 1).astype(np.uint8), kind="stable")
        by_size = size[order]
        most = int(min(by_size[-1], _LONG)) if len(by_size) else 0
        out, at = h[order], self.starts[order]
        for k in range(most):
            a = np.searchsorted(by_size, k, side="right")
            x = out[a:]
            x *= _P
            x += _BYTE[self.text[at[a:] + k]]
        h[order] = out
        h = mix64(h)
        for i in np.flatnonzero(size > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(self.text[self.starts[i] : self.ends[i]].tobytes())
        return h

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, table: np.ndarray) -> Words:
    """Split every text of a column into words."""
    raw, offsets = text_buffer(texts)
    text = table[raw]
    solid = text != _SPACE
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True  # a word ends where its document ends
    before = np.concatenate([[False], solid[:-1]]) if len(text) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(text) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    at = np.searchsorted(starts, offsets)
    return Words(raw, text, starts, ends, np.diff(at), offsets)


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text; one row with more is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    size = np.asarray(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy(), dtype=np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one sequence (len - n + 1 of them); order matters."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        out ^= out >> np.uint64(29)
    return mix64(out)
