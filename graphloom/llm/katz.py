"""Katz backoff over word pairs: counts, discounts, backoff weights and scores of whole corpora.

    P(w | v) = d(c(v w)) c(v w) / (c(v) + 1)     if the pair v w was seen
             = a(v) P(w)                         if not
    P(w)     = d1(c(w)) c(w) / N                 if the word was seen
             = what these leave                  for the one unknown word

d and d1 are Good-Turing discounts of counts up to K. a(v) makes the sum over
all words of the vocabulary and the unknown one exactly 1; the one count added
to c(v) sees to it that every context leaves some mass. A text is its words and
one end, and the first word's context is a start.

Tokens cross the network as numbers in compressed blocks, in four steps, and
every step's table is written in the shared folder:

1. chunks: documents are cut into chunks with a dictionary each; its entries are
   sent to vocabulary buckets by hash.
2. vocabulary: a bucket adds up counts and answers each chunk with the numbers
   and counts of its words. It keeps the unigram table.
3. A chunk sends its pairs to the bucket of their context; those of a hot context
   are spread by both words. Such a bucket has all that a pair needs: it adds up
   counts, keeps the bigram table, and answers with what each document gets from
   seen pairs, and which of its pairs are unseen.
4. With the discounts known, a bucket works out its backoff weights, keeps them as
   a table, and answers for unseen pairs too; chunks add all answers up.

Logarithms are summed as whole multiples of 1e-9, so that no order of summing matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .tokens import SPACED_LOWER, slices, words
from .workspace import Workspace, buckets

K = 5
#: Bytes of text that a chunk has, about.
CHUNK = 6 << 20
#: Hash of the end; words never hash to it (with a chance of 2^-64).
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Numbers of the unknown word, and of the start as a context.
UNKNOWN, START = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
UNIT = 1e9
#: Bytes of text for each bucket, at most, where the session's shuffle partitions are too few: what a task holds doesn't grow with the corpus.
BUCKET = 128 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, their bytes put in planes and compressed."""
    out = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.copy() if len(a) else np.zeros(0, np.uint8)
        blob = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        out += [a.dtype.str.encode().ljust(4), np.array([len(a), len(blob)], np.uint64).tobytes(), blob]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    for _ in range(n):
        kind = np.dtype(data[at : at + 4].decode().strip())
        size, length = (int(x) for x in np.frombuffer(data, np.uint64, 2, at + 4))
        raw = zstandard.ZstdDecompressor().decompress(data[at + 20 : at + 20 + length], max_output_size=max(1, size * kind.itemsize))
        planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, size) if size else np.zeros((kind.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 20 + length
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K, from n[r] = number of kinds seen r times, r = 1..K+1 (n[0] is not used).

    Katz's discounts where all are between 0 and 1; else absolute discounting.
    """
    n = np.asarray(n, float)
    d = np.ones(K + 1)
    if (n[1 : K + 2] > 0).all():
        r = np.arange(1, K + 1)
        rest = (K + 1) * n[K + 1] / n[1]
        good = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if rest < 1 else np.zeros(K)
        if ((good > 0) & (good < 1)).all():
            d[1:] = good
            return d
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d[1:] = (np.arange(1, K + 1) - cut) / np.arange(1, K + 1)
    return d


@dataclass
class Unigrams:
    """P(w) from a word's count."""

    total: int
    kinds: int
    d: np.ndarray
    unknown: float  # 0: add-one smoothing is used instead

    @classmethod
    def of(cls, total: int, kinds: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        kept = float(sum(d[r] * r * n[r] for r in range(1, K + 1)))
        plain = float(sum(r * n[r] for r in range(1, K + 1)))
        left = (plain - kept) / total if total else 0.0
        return cls(total, kinds, d, left)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        if self.unknown <= 0:
            return (c + 1) / (self.total + self.kinds + 1)
        return np.where(c > 0, self.d[np.minimum(c, K).astype(int) * (c <= K)] * c / self.total, self.unknown)


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(x) * UNIT).astype(np.int64)


def _table(columns: list[tuple], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[i] for r in columns], f.type) for i, f in enumerate(s)], schema=s)


def score(docs: DataFrame, ws: Workspace, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns from the rows where held_out is false or null, scores all. base_score
    is that of add-one unigrams. Null and empty texts are one token, the end;
    repeated rows count and are scored each; an empty table gives no rows;
    without training rows every token is the unknown word. A very long text is
    scored whole, its tokens dealt over chunks. Ties of words by hash can't be told
    apart (see tokens.py). Other columns aren't read.
    """
    spark = ws.spark
    text_bytes = docs.select(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    nb = max(buckets(spark), -(-text_bytes // BUCKET))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("number", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                w = words(part.column("text"), SPACED_LOWER)
                # each document's words, then its end
                first = w.first()
                n = w.counts + 1
                h = np.insert(w.hashes(), first[1:], END) if len(n) else w.hashes()
                held = np.asarray(part.column("held").to_numpy(zero_copy_only=False), bool)
                kinds, inverse = np.unique(h, return_inverse=True)
                seen = np.bincount(inverse[np.repeat(~held, n)], minlength=len(kinds))
                # the dictionary in the order of buckets
                to = (kinds >> np.uint64(32)) % np.uint64(nb)
                order = np.argsort(to, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                rows = [("chunk", -1, chunk, pack(place[inverse], n.astype(np.uint32), held.astype(np.uint8)), part.column("doc_id").to_pylist(), [int((~held).sum())])]
                kinds, seen, edge = kinds[order], seen[order].astype(np.uint32), np.searchsorted(to[order], np.arange(nb + 1))
                rows += [("word", b, chunk, pack(kinds[edge[b] : edge[b + 1]], seen[edge[b] : edge[b + 1]]), None, None) for b in range(nb) if edge[b + 1] > edge[b]]
                yield from _table(rows, schema).to_batches()
                chunk += 1

    texts = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    chunks = ws.write(texts.mapInArrow(cut, schema), "chunks", ["kind"])

    def count_words(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in table["data"]]
        h, c = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]).astype(np.int64)
        kinds, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, weights=c, minlength=len(kinds)).astype(np.int64)
        number = np.cumsum(total > 0) - 1  # seen words, in the order of their hashes
        bucket = table["bucket"][0].as_py()
        rows, at = [], 0
        for (k, _), chunk in zip(got, table["chunk"].to_pylist()):
            i = inverse[at : at + len(k)]
            at += len(k)
            rows.append(("answer", bucket, chunk, pack(np.where(total[i] > 0, number[i], UNKNOWN).astype(np.uint32), total[i]), None, None))
        some = total > 0
        rows.append(("unigrams", bucket, None, pack(kinds[some], total[some]), None, [int(total.sum()), int(some.sum()), *(int((total == r).sum()) for r in range(1, K + 2))]))
        return _table(rows, schema)

    vocabulary = ws.write(chunks.where("kind = 'word'").select(*schema.names).groupBy("bucket").applyInArrow(count_words, schema), "vocabulary", ["kind"])
    stats = vocabulary.where("kind = 'unigrams'").select("bucket", "number").collect()  # one row a bucket
    offset = np.zeros(nb + 1, np.int64)
    for r in stats:
        offset[r.bucket + 1] = r.number[1]
    offset = np.cumsum(offset)
    if offset[-1] >= START:
        raise ValueError(f"{offset[-1]} kinds of words are more than 32 bits can number")
    of_counts = np.sum([r.number[2:] for r in stats], axis=0) if stats else np.zeros(K + 1)
    uni = Unigrams.of(sum(r.number[0] for r in stats), int(offset[-1]), np.concatenate([[0], of_counts]))
    texts_seen = chunks.where("kind = 'chunk'").select(F.sum(F.element_at("number", 1))).first()[0] or 0
    # contexts with more than a bucket's half share of all tokens, 2 * nb at most: (number, count)
    limit = max(1000, uni.total // (2 * nb))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                _, c = unpack(x.as_py())
                at = np.flatnonzero(c > limit)
                yield pa.RecordBatch.from_arrays([pa.array(at + offset[b]), pa.array(c[at])], names=["id", "c"])

    hot = vocabulary.where("kind = 'unigrams'").select("bucket", "data").mapInArrow(frequent, "id long, c long").collect()
    hot_ids = np.array(sorted([r.id for r in hot] + ([int(START)] if texts_seen > limit else [])), np.uint32)

    def spread(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The bucket of each pair."""
        is_hot = np.isin(v, hot_ids)
        x = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(is_hot, w.astype(np.uint64) + np.uint64(1), np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(33)) % np.uint64(nb)).astype(np.uint16 if nb < 65536 else np.uint32)

    def pair_up(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        me = kinds.index("chunk")
        chunk = table["chunk"][0].as_py()
        place, n, held = unpack(table["data"][me].as_py())
        answers = sorted((b, i) for i, (k, b) in enumerate(zip(kinds, table["bucket"].to_pylist())) if k == "answer")
        ids, counts = [], []
        for b, i in answers:
            x, c = unpack(table["data"][i].as_py())
            ids.append(np.where(x == UNKNOWN, UNKNOWN, (x + offset[b]).astype(np.uint32)))
            counts.append(c)
        w, c = np.concatenate(ids)[place], np.concatenate(counts)[place]
        n = n.astype(np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        v = np.concatenate([[START], w[:-1]]).astype(np.uint32)
        v[np.cumsum(n) - n] = START if texts_seen else UNKNOWN
        p = fixed(np.log10(uni.p(c)))
        add = lambda x, m=None: np.bincount(doc if m is None else doc[m], weights=None if x is None else x, minlength=len(n))
        base = add_fixed(doc, fixed(np.log10((c + 1) / (uni.total + uni.kinds + 1))), len(n))
        # after an unknown word there is but the word's own probability
        free = v == UNKNOWN
        own = add_fixed(doc[free], p[free], len(n))
        rows = [("doc", chunk % nb, chunk, pack(n, add(None, c > 0).astype(np.int64), base, own, held), table["ids"][me].as_py(), None)]
        pair = np.flatnonzero(~free)
        pair = pair[np.argsort((v[pair].astype(np.uint64) << np.uint64(32)) | w[pair], kind="stable")]
        to = spread(v[pair], w[pair])
        order = np.argsort(to, kind="stable")
        pair, to = pair[order], to[order]
        edge = np.searchsorted(to, np.arange(nb + 1))
        learn = (held[doc] == 0).astype(np.uint32)
        for b in range(nb):
            q = pair[edge[b] : edge[b + 1]]
            if len(q):
                vq, wq = v[q], w[q]
                new = np.concatenate([[True], (vq[1:] != vq[:-1]) | (wq[1:] != wq[:-1])])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(q)))
                rows.append(("pair", b, chunk, pack(np.diff(vq[at], prepend=np.uint32(0)), wq[at], c[q][at].astype(np.uint64), times.astype(np.uint32), (doc[q] << np.uint32(1)) | learn[q]), None, None))
        return _table(rows, schema)

    both = chunks.where("kind = 'chunk'").select(*schema.names).unionByName(vocabulary.where("kind = 'answer'").select(*schema.names))
    pairs = both.groupBy("chunk").applyInArrow(pair_up, schema)

    def count_pairs(table: pa.Table) -> pa.Table:
        kinds, bucket = table["kind"].to_pylist(), table["bucket"][0].as_py()
        at = [i for i, k in enumerate(kinds) if k == "pair"]
        rows = [("doc", bucket, table["chunk"][i].as_py(), table["data"][i].as_py(), table["ids"][i].as_py(), None) for i, k in enumerate(kinds) if k == "doc"]
        if not at:
            return _table(rows, schema)
        got = [unpack(table["data"][i].as_py()) for i in at]
        chunk = [table["chunk"][i].as_py() for i in at]
        key = np.concatenate([(np.cumsum(g[0], dtype=np.uint64) & np.uint64(0xFFFFFFFF)) << np.uint64(32) | g[1] for g in got])
        c1 = np.concatenate([g[2] for g in got])
        learned = np.concatenate([np.add.reduceat(g[4] & 1, (np.cumsum(g[3]) - g[3]).astype(np.int64)) for g in got]).astype(np.int64)
        kinds_, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=learned, minlength=len(kinds_)).astype(np.int64)
        v, c1 = (kinds_ >> np.uint64(32)).astype(np.uint32), c1[first]
        # contexts: their counts, kinds of counts and the unigram mass of the words that followed them
        ctx, v_at = np.unique(v, return_inverse=True)
        total = np.bincount(v_at, weights=count, minlength=len(ctx)).astype(np.int64)
        for i in np.flatnonzero(np.isin(ctx, hot_ids)):
            total[i] = hot_count[int(ctx[i])]
        seen = count > 0
        low = np.stack([np.bincount(v_at[count == r], minlength=len(ctx)) for r in range(1, K + 1)]).astype(np.uint32)
        high = np.bincount(v_at[count > K], weights=count[count > K], minlength=len(ctx)).astype(np.int64)
        mass = np.bincount(v_at[seen], weights=uni.p(c1[seen].astype(np.int64)), minlength=len(ctx))
        log_seen = fixed(np.log10(np.maximum(1, count)) - np.log10(total[v_at] + 1))
        log_unigram = fixed(np.log10(uni.p(c1.astype(np.int64))))
        rows.append(("context", bucket, None, pack(ctx, total, *low, high, mass), None, [int((count == r).sum()) for r in range(1, K + 2)]))
        some = np.flatnonzero(seen)
        rows.append(("bigrams", bucket, None, pack(np.diff(v[some], prepend=np.uint32(0)), (kinds_[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32), count[some].astype(np.uint64)), None, None))
        start = 0
        for g, ch in zip(got, chunk):
            of = np.repeat(inverse[start : start + len(g[1])], g[3])
            start += len(g[1])
            doc = g[4] >> 1
            m = int(doc.max()) + 1
            s = seen[of]
            sums = add_fixed(doc[s], log_seen[of[s]], m)
            by = [np.bincount(doc[count[of] == r], minlength=m) for r in range(1, K + 1)]
            u = ~s
            unigram = add_fixed(doc[u], log_unigram[of[u]], m)
            touched = np.flatnonzero(np.bincount(doc, minlength=m))
            # unseen pairs by context, to be weighted when the backoff weights are known
            rows.append(("part", bucket, ch, pack(touched.astype(np.uint32), (sums + unigram)[touched], *(x[touched].astype(np.uint16 if len(doc) < 65536 else np.uint32) for x in by), doc[u], v_at[of[u]].astype(np.uint32)), None, None))
        return _table(rows, schema)

    hot_count = {r.id: r.c for r in hot} | {int(START): texts_seen}
    counted = ws.write(pairs.groupBy("bucket").applyInArrow(count_pairs, schema), "counted", ["kind"])
    ws.drop("chunks")
    contexts = counted.where("kind = 'context'")
    n2 = np.zeros(K + 2)
    sums = contexts.select(*[F.sum(F.element_at("number", r)).alias(f"n{r}") for r in range(1, K + 2)]).first()
    n2[1:] = [x or 0 for x in sums]
    d2 = discounts(n2)

    # hot contexts are in many buckets: put their parts together (2 * nb + 1 rows at most)
    def parts_of_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("data"):
                ctx, total, *low, high, mass = unpack(x.as_py())
                at = np.flatnonzero(np.isin(ctx, hot_ids))
                yield pa.RecordBatch.from_arrays([pa.array(ctx[at].astype(np.int64)), pa.array(total[at]), *(pa.array(y[at].astype(np.int64)) for y in low), pa.array(high[at]), pa.array(mass[at])], names=["ctx", "total", *(f"l{r}" for r in range(1, K + 1)), "high", "mass"])

    ddl = "ctx long, total long, " + ", ".join(f"l{r} long" for r in range(1, K + 1)) + ", high long, mass double"
    hot_rows = contexts.select("data").mapInArrow(parts_of_hot, ddl).groupBy("ctx").agg(F.max("total").alias("total"), *(F.sum(f"l{r}").alias(f"l{r}") for r in range(1, K + 1)), F.sum("high").alias("high"), F.sum("mass").alias("mass")).collect() if len(hot_ids) else []

    def backoff(total, low, high, mass):
        """log10 a(v): what the discounted counts leave, over what the unigrams leave."""
        kept = sum(d2[r] * r * low[r - 1] for r in range(1, K + 1)) + high
        return fixed(np.log10((1 - kept / (total + 1)) / (1 - mass)))

    hot_weight = {r.ctx: int(backoff(np.float64(r.total), [getattr(r, f"l{i}") for i in range(1, K + 1)], r.high, r["mass"])) for r in hot_rows}
    log_d = fixed(np.log10(d2))

    def weigh(table: pa.Table) -> pa.Table:
        kinds, bucket = table["kind"].to_pylist(), table["bucket"][0].as_py()
        ctx, total, *low, high, mass = unpack(table["data"][kinds.index("context")].as_py())
        weight = backoff(total.astype(float), [x.astype(float) for x in low], high, mass)
        for i in np.flatnonzero(np.isin(ctx, hot_ids)):
            weight[i] = hot_weight[int(ctx[i])]
        rows = [("backoff", bucket, None, pack(ctx, weight), None, None)]
        for i, k in enumerate(kinds):
            if k == "part":
                touched, sums, *by, doc, v = unpack(table["data"][i].as_py())
                m = int(touched.max()) + 1
                extra = add_fixed(doc, weight[v], m)[touched] + sum(log_d[r] * by[r - 1].astype(np.int64) for r in range(1, K + 1))
                rows.append(("sum", bucket, table["chunk"][i].as_py(), pack(touched, sums + extra), None, None))
        return _table(rows, schema)

    weighed = ws.write(counted.where("kind in ('context', 'part')").select(*schema.names).groupBy("bucket").applyInArrow(weigh, schema), "weighed", ["kind"])

    result = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        me = kinds.index("doc")
        n, known, base, total, held = unpack(table["data"][me].as_py())
        total = total.copy()
        for i, k in enumerate(kinds):
            if k == "sum":
                at, x = unpack(table["data"][i].as_py())
                total[at] += x
        ids = table["ids"].combine_chunks()[me].values if isinstance(table["ids"], pa.ChunkedArray) else table["ids"][me].values
        return pa.table([ids, pa.array(held > 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), uni.total)), pa.array(base / UNIT), pa.array(total / UNIT)], names=result.names)

    ends = counted.where("kind = 'doc'").select(*schema.names).unionByName(weighed.where("kind = 'sum'").select(*schema.names))
    return ends.groupBy("chunk").applyInArrow(finish, result)


def add_fixed(place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Exact int64 sums of x by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, x)
    return out
