"""Language of the words of code-switched text by a linear-chain conditional random field.

A word's features are itself (lexicon), its first and last bytes (affixes) and
all its short runs of bytes (n-grams), hashed into FEATURES weights a language;
transitions between the languages of neighbouring words are learned with them,
by maximum likelihood on sequences that switch language. Forward-backward gives
each word its probability of each language. A document's language has the
largest sum of these, and its score is their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import _table, slices, words

#: Words are runs of ASCII letters and characters beyond ASCII; A-Z becomes a-z.
LETTERS_LOWER = _table({*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)
FEATURES = 1 << 16
AFFIX, GRAM = 5, 4
#: Documents of each language to learn from, about; they are taken by a hash of their id. Beyond IN_ALL documents each language has fewer, but LEAST.
PER_LANGUAGE, IN_ALL, LEAST = 300, 15_000, 20
#: Words times languages that are learned from at once, and the least weight of a feature that counts as known.
AT_ONCE, KNOWN = 4_000_000, 0.02
#: Words of a training sequence, and of a stretch of one language in it.
SEQUENCE, STRETCH = 36, 12
#: Words of a block of the forward-backward pass; blocks of all documents go in step.
BLOCK = 256
#: Bytes of text that are labelled at a time, about.
AT_A_TIME = 1 << 20
UND = "und"


def word_features(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of words given by their bytes and hashes."""
    size = ends - starts
    out_f, out_w = [], []

    def add(h: np.ndarray, kind: int, word: np.ndarray) -> None:
        h = (h ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out_f.append((h >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32))
        out_w.append(word)

    every = np.arange(len(size))
    add(lexicon.copy(), 1, every)
    for k in range(1, AFFIX + 1):
        has = np.flatnonzero(size >= k)
        if not len(has):
            break
        front, back = np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)
        for j in range(k):
            front = (front << np.uint64(8)) | text[starts[has] + j].astype(np.uint64)
            back = (back << np.uint64(8)) | text[ends[has] - k + j].astype(np.uint64)
        add(front, 16 + k, has)
        add(back, 32 + k, has)
    for k in range(2, GRAM + 1):
        runs = np.maximum(0, size - k + 1)
        word = np.repeat(every, runs)
        at = np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(starts, runs)
        h = np.zeros(len(word), np.uint64)
        for j in range(k):
            h = (h << np.uint64(8)) | text[at + j].astype(np.uint64)
        add(h, 48 + k, word)
    return np.concatenate(out_f), np.concatenate(out_w)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [FEATURES, languages], float32
    moves: np.ndarray  # [languages, languages], exp of the transition weights

    def emissions(self, f: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """[n, languages] scores of n words: the sum of their features' weights over the root of their number."""
        count = np.bincount(w, minlength=n)
        out = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(w, weights=self.weights[f, k], minlength=n)
        return out / np.sqrt(np.maximum(1, count))[:, None]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).sum(1).reshape((-1, *[1] * (x.ndim - 1)))


def marginals(e: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """[words, languages] probabilities, from exp(emissions) of the words of consecutive documents.

    Documents are cut into blocks. Each block's product of transitions and
    emissions is taken with all other blocks in step, a document's blocks are
    chained by these, and the messages inside blocks follow in step again: exact,
    and no slower for a long document.
    """
    n, k = e.shape
    blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = (np.cumsum(counts) - counts)[doc] + nth * BLOCK
    size = np.minimum(BLOCK, counts[doc] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(BLOCK)]  # blocks of more than t words
    product = np.repeat(np.eye(k)[None], len(size), 0)
    for t in range(BLOCK):
        a = live[t]
        if not a:
            break
        product[:a] = _normal((product[:a] @ moves) * e[first[:a] + t][:, None, :])
    # chain the blocks of each document, forward and backward
    into, after = np.full((len(size), k), 1.0 / k), np.full((len(size), k), 1.0 / k)
    start = np.cumsum(blocks) - blocks
    for r in range(1, int(blocks.max(initial=0))):
        d = np.flatnonzero(blocks > r)
        here, before = place[start[d] + r], place[start[d] + r - 1]
        into[here] = _normal((into[before][:, None, :] @ product[before])[:, 0])
        d = np.flatnonzero(blocks > r)
        here, later = place[start[d] + blocks[d] - 1 - r], place[start[d] + blocks[d] - r]
        after[here] = _normal((product[later] @ after[later][:, :, None])[:, :, 0])
    out = np.empty((n, k))
    v = into
    for t in range(BLOCK):
        a = live[t]
        if not a:
            break
        at = first[:a] + t
        v[:a] = _normal((v[:a] @ moves) * e[at])
        out[at] = v[:a]
    v = after
    for t in range(BLOCK - 1, -1, -1):
        a = live[t]
        if not a:
            continue
        at = first[:a] + t
        out[at] *= v[:a]
        v[:a] = _normal((v[:a] * e[at]) @ moves.T)
    return out / out.sum(1, keepdims=True)


def fit(sample: list[tuple[str | None, str]], *, rounds: int = 80, seed: int = 0) -> Model | None:
    """Learn from (text, language). Windows of a text, spread over all of it, are put in a row with those of other texts, so that sequences switch language. None without a word."""
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in sample})
    if not languages:
        return None
    w = words(pa.array([t for t, _ in sample], pa.string()), LETTERS_LOWER)
    h, first = w.hashes(), w.first()
    stretches: dict[int, list[np.ndarray]] = {}
    for i, (_, y) in enumerate(sample):
        n = int(w.counts[i])
        for a in np.unique(np.linspace(0, max(0, n - STRETCH), 6).astype(int)):
            size = min(n - a, int(rng.integers(3, STRETCH + 1)))
            if size > 0:
                stretches.setdefault(languages.index(y), []).append(np.arange(first[i] + a, first[i] + a + size))
    if not stretches:
        return None
    # languages in equal parts, in random order, cut into sequences of equal length
    most = max(len(x) for x in stretches.values())
    picks = [(y, x[j]) for y, x in stretches.items() for j in rng.integers(0, len(x), min(most, 3 * len(x)))]
    rng.shuffle(picks)
    at, label = np.concatenate([x for _, x in picks]), np.concatenate([np.full(len(x), y) for y, x in picks])
    m = max(1, len(at) // SEQUENCE)
    length = min(SEQUENCE, len(at))
    at, label = at[: m * length].reshape(m, length), label[: m * length].reshape(m, length)
    unique, where, inverse = np.unique(h[at], return_index=True, return_inverse=True)
    inverse = inverse.reshape(at.shape)
    at1 = at.reshape(-1)[where]
    f, of = word_features(w.text, w.starts[at1], w.ends[at1], unique)
    k, n = len(languages), len(unique)
    root = 1 / np.sqrt(np.bincount(of, minlength=n))
    theta, moves = np.zeros((FEATURES, k)), np.zeros((k, k))
    gold = np.zeros((n, k))
    np.add.at(gold, (inverse.reshape(-1), label.reshape(-1)), 1)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (label[:, :-1].reshape(-1), label[:, 1:].reshape(-1)), 1)
    m1, v1, m2, v2 = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(moves), np.zeros_like(moves)
    scale = 1.0 / label.size
    at_once = max(1, AT_ONCE // (length * k))
    for step in range(1, rounds + 1):
        em = np.column_stack([np.bincount(of, weights=theta[f, c], minlength=n) for c in range(k)]) * root[:, None]
        own = np.exp(em - em.max(1, keepdims=True))
        p = np.exp(moves)
        expect, pair = np.zeros((n, k)), np.zeros((k, k))
        for first_of in range(0, m, at_once):
            some = inverse[first_of : first_of + at_once]
            e, many = own[some], len(some)
            a = np.empty((length, many, k))
            v = np.full((many, k), 1.0 / k)
            for t in range(length):
                v = _normal((v @ p) * e[:, t])
                a[t] = v
            b = np.ones((many, k))
            post = np.empty((many, length, k))
            for t in range(length - 1, -1, -1):
                post[:, t] = _normal(a[t] * b)
                if t:
                    x = e[:, t] * b
                    # expected moves: of each sequence a matrix that sums up to 1
                    whole = ((a[t - 1] @ p) * x).sum(1, keepdims=True)
                    pair += p * (a[t - 1].T @ (x / whole))
                    b = _normal(x @ p.T)
            for c in range(k):
                expect[:, c] += np.bincount(some.reshape(-1), weights=post[:, :, c].reshape(-1), minlength=n)
        g_word = (expect - gold) * root[:, None] * scale
        g = np.column_stack([np.bincount(f, weights=g_word[of, c], minlength=FEATURES) for c in range(k)]) + 1e-7 * theta
        g2 = (pair - gold_moves) * scale + 1e-5 * moves
        for x, y, m_, v_, rate in ((theta, g, m1, v1, 0.15), (moves, g2, m2, v2, 0.1)):  # Adam
            m_ += 0.1 * (y - m_)
            v_ += 0.01 * (y * y - v_)
            x -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.99**step)) + 1e-10)
    return Model(languages, theta.astype(np.float32), np.exp(moves - moves.max()))


def label(docs: DataFrame, model: Model | None, *, pass_on: list[str], inside: str | None = None) -> DataFrame:
    """The columns pass_on of every row of docs, with lang_pred, lang_score, words_by_language, lang_clear and lang_familiar.

    lang_pred is `und`, with scores of 0, for null and empty texts, texts without
    a letter, and without a model; of languages with equal sums it is the first
    by name. lang_score, from 0 to 1, is the mean probability of the document's
    language over its words; words_by_language has the expected number of words
    in each. Two means over the words say whether the text is in any learned
    language, be it one or several: lang_clear, the probability of the likeliest
    language of each word by itself, and lang_familiar, the share of its features
    that were learned. Whole texts are read, however long; repeated rows are
    labelled each; an empty table gives no rows. docs may have any columns; a
    column of pass_on with the name of one of these five is an error. inside: a
    struct column of pass_on whose field `text` is read, so that it travels once.
    """
    out = ["lang_pred", "lang_score", "words_by_language", "lang_clear", "lang_familiar"]
    if clash := set(out) & {c.lower() for c in pass_on}:
        raise ValueError(f"columns {sorted(clash)} are made here; pack yours into a struct")
    text = "_".join([*pass_on, "text"])  # no name of pass_on
    types = [T.StringType(), T.DoubleType(), T.ArrayType(T.DoubleType()), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*(docs.schema[c] for c in pass_on), *(T.StructField(c, t) for c, t in zip(out, types))])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 256 kB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = np.abs(m.weights).max(1) > KNOWN if m else None
        for batch in batches:
            if inside:
                batch = pa.RecordBatch.from_arrays([*batch.columns, batch.column(inside).field("text")], names=[*pass_on, text])
            for part in slices(batch, text, AT_A_TIME):
                names, scores, sums = [UND] * part.num_rows, np.zeros(part.num_rows), [[]] * part.num_rows
                clear, familiar = np.zeros(part.num_rows), np.zeros(part.num_rows)
                w = words(part.column(text), LETTERS_LOWER)
                if m and len(w):
                    unique, where, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
                    f, of = word_features(w.text, w.starts[where], w.ends[where], unique)
                    em = m.emissions(f, of, len(unique))
                    own = np.exp(em - em.max(1, keepdims=True))
                    p = marginals(own[inverse], w.counts, m.moves)
                    upto = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
                    first = w.first()
                    total = upto[first[1:]] - upto[first[:-1]]
                    best = total.argmax(1)
                    scores = np.clip(total[np.arange(len(best)), best] / np.maximum(1, w.counts), 0, 1)
                    plain = np.concatenate([[0], np.cumsum((w.text >= 97) & (w.text <= 122))])
                    has = plain[w.offsets[1:]] > plain[w.offsets[:-1]]
                    for i in np.flatnonzero(~has & (w.counts > 0)):  # characters beyond ASCII only: are there letters?
                        has[i] = any(c.isalpha() for c in part.column(text)[int(i)].as_py())
                    names = [m.languages[b] if h else UND for b, h in zip(best, has)]
                    scores = np.where(has, scores, 0.0)
                    mean = lambda x: np.where(has, np.diff(np.concatenate([[0], np.cumsum(x[inverse])])[first]) / np.maximum(1, w.counts), 0.0)  # noqa: B023, E731
                    clear = mean(1 / own.sum(1))
                    familiar = mean(np.bincount(of, weights=known[f], minlength=len(unique)) / np.bincount(of, minlength=len(unique)))
                    sums = [t if h else [] for t, h in zip(np.round(total, 6).tolist(), has)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in pass_on), pa.array(names, pa.string()), pa.array(np.round(scores, 9)), pa.array(sums, pa.list_(pa.float64())), pa.array(np.round(clear, 9)), pa.array(np.round(familiar, 9))], names=schema.names)

    return docs.select(*pass_on, *([] if inside else [F.col("text").cast("string").alias(text)])).mapInArrow(run, schema)


def sample(docs: DataFrame, *, train: Column | None = None, per_language: int = PER_LANGUAGE) -> list[tuple[str | None, str]]:
    """About per_language texts of each language, by a hash of doc_id, from rows where `train` holds and lang isn't null.

    No language is left out. Where there are more than IN_ALL / per_language, each
    has IN_ALL / languages documents, LEAST at least. Rows of equal doc_id, lang
    and text count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if train is not None:
        rows = rows.where(train)
    sizes = rows.groupBy("lang").count()  # one row a language
    kinds = sizes.count()
    if not kinds:
        return []
    each = min(per_language, max(LEAST, IN_ALL // kinds))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = rows.join(F.broadcast(sizes), "lang").where(chance < F.lit(float(each)) / F.col("count"))
    got = got.select("doc_id", "lang", F.col("text").cast("string").alias("text")).distinct()
    got = got.orderBy("doc_id", F.xxhash64("text", "lang")).limit(2 * each * kinds).collect()
    return [(r.text, r["lang"]) for r in got]
