"""Product quantisation of vectors by Yinyang Lloyd, in whole numbers.

Every part of a vector has its own codebook. Codebook entries are clustered into
groups once; each vector keeps, for every part, one lower bound a group on its
distance to the group's entries other than its own. After a round a group's bound
shrinks by the largest drift of its entries, and only groups whose bound no longer
exceeds the distance to the vector's own entry are scanned. Bounds only choose what
to scan: every distance compared is a whole number, and a group is left out only if
all its entries are farther, so ties go to the lower index as in a plain Lloyd round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, with_keyed

#: Groups of codebook entries; largest component (a distance then fits 64 bits up to 128 components a part).
GROUPS, LARGEST = 16, 1 << 27
#: Relative slack of bounds, far above what square roots and additions round off.
SLACK = 1e-9


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, exact: float64 sums while all of them are whole numbers below 2^53, else int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def cluster(c: np.ndarray, most: int = GROUPS, rounds: int = 5) -> list[np.ndarray]:
    """Groups of a codebook's entries, each sorted; a few plain rounds, always the same."""
    t = max(1, min(most, len(c) // 4))
    centre = c[np.linspace(0, len(c) - 1, t).astype(int)].astype(np.float64)
    x = c.astype(np.float64)
    for _ in range(rounds):
        at = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.array([x[at == g].mean(0) if (at == g).any() else centre[g] for g in range(t)])
    return [g for g in (np.flatnonzero(at == k) for k in range(t)) if len(g)]


@dataclass(frozen=True)
class Codebook:
    """One part's entries, their groups, and how far the farthest entry of each group and each entry moved in the last round."""

    entries: np.ndarray
    groups: list[np.ndarray]
    drift: np.ndarray | None = None

    def moved(self, entries: np.ndarray) -> Codebook:
        far = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        return Codebook(entries, self.groups, np.array([far[g].max() for g in self.groups]))


def first(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its distance, lower bound a group) of vectors that have none yet."""
    d = distances(x, book.entries)
    own = d.argmin(1)  # the lowest index of the nearest
    best = d[np.arange(len(x)), own]
    d = d.astype(np.float64)
    d[np.arange(len(x)), own] = np.inf
    return own, best, _down(np.stack([np.sqrt(d[:, g].min(1)) for g in book.groups], 1))


def again(x: np.ndarray, book: Codebook, own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the last round's entry and bounds, and how many distances were computed."""
    n, t = low.shape
    old = ((x - book.entries[own]) ** 2).sum(1)
    low = low.astype(np.float64) - book.drift
    scan = low <= (np.sqrt(old.astype(np.float64)) * (1 + SLACK))[:, None]
    best, best_at = old.copy(), own.copy()
    least, second = np.full((n, t), np.inf), np.full((n, t), np.inf)
    least_at = np.full((n, t), -1)
    done = n
    for g, entries in enumerate(book.groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        d = distances(x[rows], book.entries[entries])
        done += d.size
        k = d.argmin(1)
        m = d[np.arange(len(rows)), k]
        least[rows, g], least_at[rows, g] = m, entries[k]
        if len(entries) > 1:
            d[np.arange(len(rows)), k] = np.iinfo(np.int64).max
            second[rows, g] = d.min(1)
        # equal distances go to the lower index
        better = (m < best[rows]) | ((m == best[rows]) & (entries[k] < best_at[rows]))
        best[rows[better]], best_at[rows[better]] = m[better], entries[k][better]
    # a scanned group's bound leaves out the entry chosen; the group left behind must cover the old one
    low = np.where(scan, np.sqrt(np.where(least_at == best_at[:, None], second, least)), low)
    group_of = np.zeros(len(book.entries), int)
    for g, entries in enumerate(book.groups):
        group_of[entries] = g
    left = np.flatnonzero((best_at != own) & ~scan[np.arange(n), group_of[own]])
    low[left, group_of[own[left]]] = np.minimum(low[left, group_of[own[left]]], np.sqrt(old[left].astype(np.float64)))
    return best_at, best, _down(low), done


def _down(low: np.ndarray) -> np.ndarray:
    """Bounds as float32, a little less than they are."""
    with np.errstate(over="ignore"):
        return np.nextafter((low * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


@dataclass(frozen=True)
class Coded:
    """codes: keys, label, code, error, label_error; codebooks: of each part its entries; scanned: of each round the share of all distances that were computed."""

    codes: DataFrame
    codebooks: list[np.ndarray]
    scanned: list[float]

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for c in self.codebooks for e in c for v in e.tolist()).encode()).hexdigest()


def whole(vectors: DataFrame, key: str, label: str, column: str, scale: int) -> DataFrame:
    """(key, label, x): vectors without a null or non-finite component, as floor(scale * component)."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & F.forall(v, finite)).select("key", "label", F.transform(v, lambda x: F.floor(x * scale)).alias("x"))


def quantise(vectors: DataFrame, ws: Workspace, *, key: str = "vec_id", label: str = "label", column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Coded:
    """Codes of all vectors after `rounds` rounds of Lloyd from the vectors of the least keys.

    Vectors that are null or have a null or non-finite component are left out.
    Rows of equal key come in the order of their components, null keys last;
    equal rows count each. Fewer vectors than entries make a smaller codebook; an
    empty table has no rows and empty codebooks. Vectors of no components have
    error 0. Null labels are one label. Vectors must have one length, a multiple of
    `parts`, and components below 2^27 in size, else an error is raised. Other
    columns are not read, whatever their names.
    """
    kept = whole(vectors, key, label, column, scale)
    order = [F.col("key").asc_nulls_last(), "x"]
    least = [r.x for r in kept.select("key", "x").orderBy(*order).limit(entries).collect()]  # `entries` rows
    if len({len(x) for x in least}) > 1:
        raise ValueError(f"vectors of {len(least[0])} components and others")
    start = np.array(least, np.int64) if least else np.zeros((0, parts), np.int64)
    width = start.shape[1]
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    books = [Codebook(c, cluster(c) if len(c) else []) for c in np.split(start, parts, axis=1)]
    at, seen, scanned = kept, 0, []
    for r in range(rounds + 1):
        now = ws.write(assign(at, books, width, final=r == rounds), f"round{r}", partition_by=["kind"])
        if r > 0:
            ws.drop(f"round{r - 1}")
        at = now.where("kind = 'vector'")
        sums = now.where("kind = 'sum'")
        work = sums.agg(F.sum(F.when(F.col("entry") < 0, F.col("n"))).alias("done"), F.sum(F.when((F.col("entry") >= 0) & (F.col("book") == 0), F.col("n"))).alias("rows")).first()
        seen = work["rows"] or 0
        scanned.append((work["done"] or 0) / max(1, seen * parts * len(start)))
        if r < rounds:
            books = step(sums, books)
    error = F.sum("error").cast("long")
    totals = at.groupBy("label").agg(error.alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = with_keyed(ws, at.select("key", "label", F.hex("code").alias("code"), "error"), totals, "label", seen)
    return Coded(out.select(F.col("key").alias(key), F.col("label").alias(label), F.lower("code").alias("code"), "error", "label_error"), [b.entries for b in books], scanned)


def step(sums: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """New codebooks: floors of means; entries without vectors stay. The driver gets one number a component of the codebooks."""
    total = sums.where("entry >= 0").select("book", "entry", "n", F.posexplode("total").alias("i", "v"))
    total = total.groupBy("book", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    new = [b.entries.copy() for b in books]
    for r in total.collect():
        new[r.book][r.entry, r.i] = int(r.v) // r.n
    return [b.moved(c) for b, c in zip(books, new)]


def assign(rows: DataFrame, books: list[Codebook], width: int, final: bool) -> DataFrame:
    """Rows of kind `vector` with their codes, error and bounds, and of kind `sum` with each task's sums by part and entry, written together so that both are committed once."""
    key, label = rows.schema["key"].dataType, rows.schema["label"].dataType
    fields = [("kind", T.StringType()), ("key", key), ("label", label), ("x", T.BinaryType()), ("code", T.BinaryType()), ("low", T.BinaryType()), ("error", T.LongType()), ("book", T.IntegerType()), ("entry", T.IntegerType()), ("n", T.LongType()), ("total", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    fresh = "code" not in rows.columns
    groups = [len(b.groups) for b in books]
    share = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        sums = [np.zeros((len(b.entries), share), np.int64) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        done = 0

        def record(n: int, /, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in out], schema=out)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _components(batch.column("x"), n, width, fresh)
            code, error, lows = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64), []
            if not fresh:
                was, bound = _fixed(batch.column("code"), n, np.uint8), np.split(_fixed(batch.column("low"), n, np.float32), np.cumsum(groups)[:-1], axis=1)
            for p, book in enumerate(books):
                part = x[:, p * share : (p + 1) * share]
                if fresh:
                    own, d, low = first(part, book)
                    done += n * len(book.entries)
                else:
                    own, d, low, some = again(part, book, was[:, p].astype(np.int64), bound[p])
                    done += some
                code[:, p] = own
                error += d
                lows.append(low)
                if not final:
                    by = np.argsort(own, kind="stable")
                    edge = np.flatnonzero(np.diff(own[by], prepend=-1))
                    sums[p][own[by][edge]] += np.add.reduceat(part[by], edge, axis=0) if share else 0
                counts[p] += np.bincount(own, minlength=len(book.entries))
            cols = {"kind": pa.repeat("vector", n), "key": batch.column("key"), "label": batch.column("label"), "code": _binary(code), "error": pa.array(error)}
            if not final:
                cols |= {"x": _binary(x.astype("<i4")), "low": _binary(np.concatenate(lows, axis=1))}
            yield record(n, **cols)
        for p, c in enumerate(counts):
            hit = np.flatnonzero(c)
            m = len(hit)
            if m:
                yield record(m, kind=pa.repeat("sum", m), book=pa.array(np.full(m, p, np.int32)), entry=pa.array(hit.astype(np.int32)), n=pa.array(c[hit]), total=pa.array(list(sums[p][hit]), pa.list_(pa.int64())))
        if done:  # not an entry: how many distances this task computed
            yield record(1, kind=pa.array(["sum"]), book=pa.array([0], pa.int32()), entry=pa.array([-1], pa.int32()), n=pa.array([done]), total=pa.array([[]], pa.list_(pa.int64())))

    return rows.select("key", "label", "x", *([] if fresh else ["code", "low"])).mapInArrow(run, schema)


def _components(column: pa.Array, n: int, width: int, fresh: bool) -> np.ndarray:
    """(n, width) whole numbers of a column of lists, or of the binary that assign() makes of them."""
    if not fresh:
        return _fixed(column, n, "<i4").astype(np.int64)
    size = np.diff(column.offsets.to_numpy())
    if (size != width).any():
        raise ValueError(f"vectors of {width} components and others of {size[size != width][0]}")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, width)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise ValueError(f"a component of {LARGEST} or more")
    return x


def _fixed(column: pa.Array, n: int, kind) -> np.ndarray:
    """Rows of equally many numbers each, from a binary column."""
    data = column.cast(pa.large_binary())
    edge = np.frombuffer(data.buffers()[1], np.int64, n + 1, data.offset * 8)
    raw = data.buffers()[2]
    return np.frombuffer(raw or b"", np.uint8)[edge[0] : edge[-1]].view(kind).reshape(n, -1) if edge[-1] > edge[0] else np.zeros((n, 0), kind)


def _binary(x: np.ndarray) -> pa.Array:
    """One binary value a row."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    edge = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(edge), pa.py_buffer(x.tobytes())]).cast(pa.binary())
