"""Compression-distance classification of toxic text with two zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text. Every window (a
run of `window` words of a text, each after delimiter bytes) is compressed with
both, and the difference of the two lengths is its distance: it is high where
the toxic dictionary knows more of the window than the ordinary one. A window has
no delimiter at its end, so a word with another ending still matches up to it. For every
window length, thresholds are calibrated on ordinary text, one for each of the
rates EPS at which its windows exceed them; lengths with few windows take in
those of the nearest lengths.

A text is read in overlapping stretches of STRETCH windows, so that a toxic part
isn't thinned out by what surrounds it. A stretch's features are its distinct
windows above each threshold, less the number expected, in standard deviations:
a window that is repeated tells nothing new. Weights are never negative. The
best stretch makes the score, calibrated for the number of stretches: the more
there are, the higher the best of an ordinary text is.

The toxic dictionary is trained on those windows of toxic texts that have a word
which is much more frequent in toxic than in ordinary texts; without that
selection both dictionaries would fill up with the words that all texts share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as Z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import _table, slices, words

#: Words are runs of ASCII letters and characters beyond ASCII; A-Z becomes a-z.
LETTERS_LOWER = _table({*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)
FRAME = bytes(range(1, 7))
LEVEL = 12
ORDINARY_BYTES, TOXIC_BYTES = 32768, 4096
#: Labelled documents to learn from, at most; they are taken by a hash of their id.
SAMPLE = 4000
EPS = (0.01, 0.003, 0.001)
#: Longer windows share a threshold; windows that a threshold is calibrated on, at least.
LONGEST, LEAST = 24, 2000
#: Windows of a stretch; the next starts half of them later, and the last ends with the text.
STRETCH = 256
#: Distances that a Python worker keeps.
CACHE = 400_000


def _compressor(dictionary: bytes) -> Z.ZstdCompressor:
    p = Z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, format=Z.FORMAT_ZSTD1_MAGICLESS)
    d = Z.ZstdCompressionDict(dictionary)
    d.precompute_compress(compression_params=p)
    return Z.ZstdCompressor(dict_data=d, compression_params=p)


def _split(text: str) -> list[bytes]:
    w = words(pa.array([text], pa.string()), LETTERS_LOWER)
    return [w.text[a:b].tobytes() for a, b in zip(w.starts, w.ends)]


def _windows(ws: list[bytes], n: int) -> list[bytes]:
    return [FRAME + FRAME.join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([FRAME + FRAME.join(ws)] if ws else [])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: np.ndarray  # [len(EPS), LONGEST + 1]
    weights: np.ndarray  # of a stretch's features, and a constant
    final: np.ndarray  # of the best stretch, of minus the logarithm of the stretches, and a constant
    window: int = 1

    def best(self, s: Stretches) -> np.ndarray:
        """Each document's best stretch, before the last calibration."""
        return np.maximum.reduceat(features(s.above, s.n) @ self.weights[:-1] + self.weights[-1], s.first) if len(s.first) else np.zeros(0)

    def scores(self, s: Stretches) -> np.ndarray:
        x = np.column_stack([self.best(s), -np.log(s.many)])
        return 1 / (1 + np.exp(-np.clip(x @ self.final[:-1] + self.final[-1], -30, 30)))


def features(above: np.ndarray, n: np.ndarray) -> np.ndarray:
    """above: [stretches, len(EPS)] distinct windows above each threshold; n: windows."""
    e = np.asarray(EPS)
    x = (above - e * n[:, None]) / np.sqrt(e * n[:, None] + 0.5)
    return np.sign(x) * np.log1p(np.abs(x))


class Stretches:
    """The stretches of a run of documents: windows of each, and distinct windows above each threshold."""

    def __init__(self, windows: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray, level: np.ndarray):
        """windows: of each document; the rest of windows above a threshold: document, place in it, what names the window, and how many thresholds it reaches."""
        half = STRETCH // 2
        self.many = np.maximum(1, -(-(windows - STRETCH) // half) + 1)
        self.first = np.cumsum(self.many) - self.many
        self.n = np.repeat(np.minimum(windows, STRETCH), self.many)
        at, last = place // half, self.many[doc] - 1
        i = np.stack([at - 1, np.minimum(at, last), last])
        start = np.where(i == last, np.maximum(0, windows[doc] - STRETCH), i * half)
        inside = (i >= 0) & (start <= place) & (place < start + STRETCH)
        row = np.where(inside, self.first[doc] + i, -1).reshape(-1)
        # distinct windows of each stretch
        keys, levels = np.tile(key, 3), np.tile(level, 3)
        order = np.lexsort((keys, row))
        row, keys, levels = row[order], keys[order], levels[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
        new &= row >= 0
        total = int(self.many.sum())
        self.above = np.column_stack([np.bincount(row[new & (levels > j)], minlength=total) for j in range(len(EPS))]).astype(float)


class Meter:
    """Distances of windows; knows those it saw before."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = _compressor(ordinary), _compressor(toxic)

    def distance(self, window: bytes) -> int:
        return len(self.a.compress(window)) - len(self.b.compress(window))

    def above(self, window: bytes, thresholds: np.ndarray) -> int:
        """How many of the (falling) thresholds the window reaches. Its length with the ordinary dictionary, at most its size and 5 bytes, is taken only where that may matter."""
        toxic = len(self.b.compress(window))
        if len(window) + 5 - toxic < thresholds.min():
            return 0
        return int((len(self.a.compress(window)) - toxic >= thresholds).sum())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, none negative, and a constant, by Newton's method; the most negative weight is taken out until there is none."""
    use = list(range(x.shape[1]))
    while True:
        z = np.column_stack([x[:, use], np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + ridge * np.append(w[:-1], 0)
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.diag(np.append(np.ones(len(w) - 1), 1e-6))
            step = np.linalg.solve(h, g)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        if not use or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*use, -1]] = w
            return out
        del use[int(w[:-1].argmin())]


def _dictionary(size: int, windows: list[bytes]) -> bytes:
    """A trained dictionary; of too few windows to train on, the windows themselves."""
    try:
        return Z.train_dictionary(size, windows).as_bytes()
    except Z.ZstdError:
        return b"".join(dict.fromkeys(windows))[-size:]


def fit(sample: list[tuple[str | None, int]], window: int = 1, seed: int = 0) -> Model | None:
    """Learn from (text, toxic 0 or 1); None if one class has no words."""
    rng = np.random.default_rng(seed)
    texts = [(_split(t or ""), int(y)) for t, y in sample]
    toxic, plain = [w for w, y in texts if y == 1 and w], [w for w, y in texts if y == 0 and w]
    if not toxic or not plain:
        return None
    in_toxic, in_plain = Counter(w for d in toxic for w in set(d)), Counter(w for d in plain for w in set(d))
    marks = {w for w, c in in_toxic.items() if c >= 3 and c / len(toxic) > 8 * (in_plain[w] + 0.5) / len(plain)}
    ordinary = [w for d in plain for w in _windows(d, window)]
    seen: Counter[bytes] = Counter()
    train = []
    for w in ordinary:  # a window counts 20 times at most
        seen[w] += 1
        if seen[w] <= 20:
            train.append(w)
    train = [train[i] for i in rng.permutation(len(train))[:100_000]]
    marked = [FRAME + FRAME.join(d[i : i + window]) for d in toxic for i in range(max(1, len(d) - window + 1)) if marks.intersection(d[i : i + window])]
    a, b = _dictionary(ORDINARY_BYTES, train), _dictionary(TOXIC_BYTES, marked or [w for d in toxic for w in _windows(d, window)])
    meter = Meter(a, b)
    known = {w: meter.distance(w) for w in {w for d, _ in texts for w in _windows(d, window)}}
    length = lambda w: min(LONGEST, max(0, len(w) - len(FRAME)))
    th = _thresholds(np.array([length(w) for w in ordinary]), np.array([known[w] for w in ordinary]))
    number = {w: i for i, w in enumerate(known)}
    level = np.array([int((known[w] >= th[:, length(w)]).sum()) for w in number])
    rows = [np.array([number[w] for w in _windows(d, window)], int) for d, _ in texts]
    n = np.array([len(r) for r in rows])
    key = np.concatenate(rows)
    doc, place = np.repeat(np.arange(len(n)), n), np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
    hit = level[key] > 0
    s = Stretches(n, doc[hit], place[hit], key[hit], level[key[hit]])
    y = np.array([y for _, y in texts], float)
    # weights are learned on each document's best stretch; at first all are
    x, of = features(s.above, s.n), np.repeat(np.arange(len(y)), s.many)
    w = _logistic(x, y[of])
    for _ in range(3):
        value = x @ w[:-1] + w[-1]
        best = np.lexsort((-value, of))[s.first]
        w = _logistic(x[best], y)
    value = np.maximum.reduceat(x @ w[:-1] + w[-1], s.first)
    # the best of many stretches: every text alone, and as many of each class among others that are ordinary
    good, bad = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    many, tops, truth = [s.many], [value], [y]
    for k in (3, 10, 30):
        some = np.concatenate([bad, good[rng.integers(0, len(good), len(bad))]])
        others = good[rng.integers(0, len(good), (len(some), k))]
        many.append(s.many[some] + s.many[others].sum(1))
        tops.append(np.maximum(value[some], value[others].max(1)))
        truth.append(y[some])
    final = _logistic(np.column_stack([np.concatenate(tops), -np.log(np.concatenate(many))]), np.concatenate(truth))
    return Model(a, b, th, w, final, window)


def _thresholds(size: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """For each rate and window length, the least distance that no more than this part of ordinary windows of about this length reach."""
    out = np.zeros((len(EPS), LONGEST + 1), int)
    count = np.bincount(size, minlength=LONGEST + 1)
    for s in range(LONGEST + 1):
        reach = 0
        while count[max(0, s - reach) : s + reach + 1].sum() < min(LEAST, len(size)):
            reach += 1
        d = np.sort(distance[np.abs(size - s) <= reach])[::-1]
        out[:, s] = [d[int(e * len(d))] + 1 for e in EPS]
    return out


_known: dict[tuple, dict[int, int]] = {}


def score(docs: DataFrame, model: Model | None, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_windows, n_above, score) for every row of docs; all of each text is read.

    score is from 0 to 1, higher: likelier toxic. Null and empty texts have no
    windows and get the score of none; without a model it is 0. Of stretches
    that are equally good any gives the same score. A long text has more
    stretches, but no more of a part that it repeats. Repeated rows are scored
    each; an empty table gives no rows; other columns aren't read.
    """
    keys = keys or ["doc_id"]
    text = "text" if "text" not in keys else "_".join(keys)
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("n_windows", T.LongType()), T.StructField("n_above", T.LongType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        meter = Meter(m.ordinary, m.toxic) if m else None
        cache = _known.setdefault((m.ordinary, m.toxic, m.thresholds.tobytes(), m.window), {}) if m else {}
        for batch in batches:
            for part in slices(batch, text):
                many = part.num_rows
                n, above, total = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many)
                if m:
                    w = words(part.column(text), LETTERS_LOWER)
                    k = m.window
                    first = w.first()
                    h = w.hashes()
                    doc = w.doc()
                    # windows start at every word that has k - 1 more of its document after it, or at the first of a shorter one
                    last = np.maximum(first[:-1], first[1:] - k)[doc] if len(h) else np.zeros(0, int)
                    at = np.flatnonzero(np.arange(len(h)) <= last)
                    key = h[at].copy()
                    end = np.minimum(at + k, first[1:][doc[at]]) if len(at) else at
                    for j in range(1, k):
                        more = at + j < end
                        key[more] = key[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + j]
                    coded = pa.array(key).dictionary_encode()
                    kinds, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                    one = np.zeros(len(kinds), np.int64)
                    one[place] = np.arange(len(place))
                    found = np.zeros(len(kinds), np.int8)
                    if len(cache) > CACHE:
                        cache.clear()
                    for i, (x, y) in enumerate(zip(kinds.tolist(), one.tolist())):
                        v = cache.get(x)
                        if v is None:
                            window = FRAME + FRAME.join(w.text[w.starts[j] : w.ends[j]].tobytes() for j in range(at[y], end[y]))
                            v = cache[x] = meter.above(window, m.thresholds[:, min(LONGEST, len(window) - len(FRAME))])
                        found[i] = v
                    level = found[place]
                    n = np.bincount(doc[at], minlength=many)
                    above = np.bincount(doc[at][level == len(EPS)], minlength=many)
                    hit = np.flatnonzero(level)
                    inside = at[hit] - first[doc[at[hit]]]
                    total = m.scores(Stretches(n, doc[at[hit]], inside, key[hit], level[hit]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(n.astype(np.int64)), pa.array(above.astype(np.int64)), pa.array(np.round(total, 9))], names=schema.names)

    return docs.select(*keys, F.col("text").cast("string").alias(text)).mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, *, train: F.Column | None = None, most: int = SAMPLE) -> list[tuple[str | None, int]]:
    """At most `most` labelled texts, by a hash of doc_id, from rows where `train` (on doc_id) holds.

    Classes have their share in the labels, but the rarer one an eighth at least,
    if it has as many rows. Ids with several labels are toxic if one is; of an id's different
    texts one is taken, and equal rows count once. Nulls are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if train is not None:
        rows = rows.where(train)
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    sizes = {r.is_toxic: r["count"] for r in rows.groupBy("is_toxic").count().collect()}
    rare = min(sizes, key=lambda y: (sizes[y], y), default=None)
    k = max(most * sizes[rare] // sum(sizes.values()), most // 8) if sizes else 0
    share = {y: min(k, sizes[rare]) if y == rare and len(sizes) > 1 else most - min(k, sizes[rare]) * (len(sizes) > 1) for y in sizes}
    parts = [rows.where(F.col("is_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in share.items()]
    if not parts:
        return []
    picked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # `most` rows
    got = texts.groupBy("doc_id", "is_toxic").agg(F.min("text").alias("text")).orderBy("doc_id").limit(most).collect()
    return [(r.text, int(r.is_toxic)) for r in got]
