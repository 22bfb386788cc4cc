"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Every text gives a fingerprint of its words and BANDS band hashes of ROWS
   MinHash values each. Two texts of Jaccard similarity s share a band with the
   chance 1 - (1 - s^ROWS)^BANDS; plan() chooses bands for a target recall.
2. Texts with the same words are one class of copies, with one representative.
3. Representatives are shuffled on their band hashes. In a bucket, each is linked
   with the least one only, so a bucket of n makes n - 1 links; the connected
   components of these links hold all pairs that share a band.
4. A component is verified on full n-gram sets in tiles: its members are dealt
   into blocks, and each pair of blocks is compared in one task, which counts all
   links and gives out no more than a spanning forest of them. So no pair is
   lost, and no table of all pairs of a group is ever made.
5. Connected components of the verified forests are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tokens import SPACED_LOWER, ngrams, slices, words
from .workspace import Workspace

N = 5
SIMILAR = 0.8
ROWS = 5
RECALL = 0.9999
#: Members of a component that one block holds; a task compares two blocks.
BLOCK = 96
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096


def plan(similar: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of `rows` values so that texts of this similarity share one with a chance of `recall` at least."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similar**rows)))


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text; one n-gram of all words if there are fewer, none without words."""
    w = words(texts, SPACED_LOWER)
    h, first = w.hashes(), w.first()
    out = []
    for i in range(len(w.counts)):
        x = h[first[i] : first[i + 1]]
        out.append(np.unique(ngrams(x, min(n, len(x)))) if len(x) else np.zeros(0, np.uint64))
    return out


class Hasher:
    """Band hashes of sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """[sets, bands], int64; of no use for an empty set."""
        size = np.array([len(s) for s in sets])
        full = np.flatnonzero(size)
        out = np.zeros((len(sets), self.bands), np.uint64)
        if not len(full):
            return out.astype(np.int64)
        flat = np.concatenate([sets[i] for i in full])
        start = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        x = np.empty_like(flat)
        for band in range(self.bands):
            h = np.full(len(full), band + 1, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                np.bitwise_xor(flat, self.b[k], out=x)
                np.multiply(x, self.a[k], out=x)
                h = (h ^ np.minimum.reduceat(x, start)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out[full, band] = h
        return out.view(np.int64)


def sign(docs: DataFrame, ws: Workspace, *, n: int, bands: int, rows: int, name: str = "signed") -> DataFrame:
    """A table (doc_id, md5, words_id, bands, row): no text, no sets. words_id is null and bands are empty for a text without words."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("md5", T.StringType()), T.StructField("words_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bands, rows)
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), SPACED_LOWER)
                h, first = w.hashes(), w.first()
                ids, sets = [], []
                for i in range(len(w.counts)):
                    x = h[first[i] : first[i + 1]]
                    ids.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    sets.append(np.unique(ngrams(x, min(n, len(x)))) if len(x) else np.zeros(0, np.uint64))
                found = hasher(sets)
                filled = w.counts > 0
                at = np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(found[filled].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("md5"), pa.array(ids, pa.binary()), lists], names=schema.names)

    keyed = docs.select("doc_id", text_md5(), F.col("text").cast("string").alias("text"))
    return ws.write(keyed.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), name)


def text_md5():
    """Names a text, together with doc_id; null is an empty text."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("md5")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right]: the number of common elements of each pair of sets."""
    sets = [*left, *right]
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(flat):
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    renumber = np.cumsum(shared) - 1
    owner, column = owner[keep], renumber[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similar: float) -> np.ndarray:
    """Whether each pair's Jaccard similarity is at least `similar`."""
    both = overlaps(left, right)
    size = np.array([len(s) for s in left], np.float64)[:, None] + np.array([len(s) for s in right], np.float64)[None, :]
    return (both > 0) & (both >= similar * (size - both) - 1e-9)


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Those of the pairs that connect something new."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for a, b in pairs:
        x, y = top(int(a)), top(int(b))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def verify(members: DataFrame, *, n: int, similar: float) -> DataFrame:
    """Compare all pairs of each component of members(row, component, members, copies, text): rows (a, b, links), where b is null and links are documents linked with a, or b is the other end of a link."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    tiles = members.select("component", "row", "copies", "text", blocks.alias("blocks"), mine.alias("mine"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "row", "copies", "text")

    def compare(table: pa.Table) -> pa.Table:
        # rows that are the same in all columns may have come in twice
        table = table.combine_chunks()
        row = table["row"].to_numpy()
        _, first = np.unique(row, return_index=True)
        table, row = table.take(pa.array(first)), row[first]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        mine, copies = table["mine"].to_numpy(), table["copies"].to_numpy()
        sets = shingle_sets(table["text"], n)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        hit = linked([sets[k] for k in left], [sets[k] for k in right], similar) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
        if i == j:
            np.fill_diagonal(hit, False)
        links = np.zeros(len(row), np.int64)
        links[left] += hit @ copies[right]
        if i != j:
            links[right] += hit.T @ copies[left]
        x, y = np.nonzero(hit)
        tree = forest(np.stack([left[x], right[y]], 1), len(row))
        some = np.flatnonzero(links)
        a = [*row[some].tolist(), *(int(row[p]) for p, _ in tree)]
        b = [*([None] * len(some)), *(int(row[q]) for _, q in tree)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*links[some].tolist(), *([0] * len(tree))], pa.int64())})

    return tiles.groupBy("component", "i", "j").applyInArrow(compare, "a long, b long, links long")


def join(docs: DataFrame, ws: Workspace, *, n: int = N, similar: float = SIMILAR, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """(doc_id, md5, class_id, class_size, n_links, keep) for every row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than n words, but not none, is one n-gram. n_links counts the other rows
    whose n-gram sets have a Jaccard similarity of `similar` at least, copies
    included. A class is what links connect; class_id is its least doc_id, and
    keep marks one row of each class, the one of the least (doc_id, md5). Null
    and empty texts are linked with nothing, each a class of its own; repeated
    rows are copies; null ids come last. An empty table gives no rows. Very long
    texts are compared by all their n-grams. Other columns aren't read.
    """
    signed = sign(docs, ws, n=n, bands=plan(similar, rows, recall), rows=rows)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "md5", "row")
    texts = signed.where("words_id is not null").select("words_id", order.alias("o")).groupBy("words_id").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("copies"))
    reps = ws.write(texts.select("words_id", F.col("o.doc_id").alias("rep_id"), F.col("o.md5").alias("rep_md5"), F.col("o.row").alias("rep"), "copies"), "reps")
    # representatives on their band hashes
    banded = signed.select("row", F.explode("bands").alias("band")).join(reps.select(F.col("rep").alias("row")), "row", "left_semi")
    banded = ws.write(banded, "banded")
    hubs = banded.groupBy("band").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "hub")
    near = banded.join(hubs, "band").where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    found = ws.write(components(near, ws, "candidate"), "candidates")
    ws.drop("banded")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = reps.join(found.join(sizes, "component"), F.col("rep") == F.col("node")).select("rep_id", "rep_md5", F.col("rep").alias("row"), "component", "members", "copies")
    text = docs.select("doc_id", text_md5(), F.col("text").cast("string").alias("text"))
    members = text.join(members, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("md5") == F.col("rep_md5"))).select("row", "component", "members", "copies", "text")
    verified = ws.write(verify(members, n=n, similar=similar), "verified")
    classes = ws.write(components(verified.where("b is not null").select("a", "b"), ws, "class"), "classes")
    links = verified.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    # every representative with its class
    known = reps.join(classes, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
    known = known.select("words_id", "rep", "rep_id", "rep_md5", "copies", F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = ws.write(known, "known")
    best = F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "rep_md5", "rep")
    firsts = known.groupBy("class").agg(F.min(best).alias("f"), F.sum("copies").alias("class_size")).select("class", F.col("f.rep_id").alias("class_id"), F.col("f.rep").alias("kept_row"), "class_size")
    known = known.select("words_id", "class", "n_links").join(firsts, "class").drop("class")
    out = signed.select("doc_id", "md5", "words_id", "row").join(known, "words_id", "left")
    alone = F.col("words_id").isNull()
    return out.select("doc_id", "md5", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("row") == F.col("kept_row"))).alias("keep"))
