"""Alignment of the tokens of two tokenizers over the same bytes, with DuckDB on each Arrow partition.

Texts are cut where neither tokenizer joins what stands left and right of the
cut, so that each distinct segment of a batch is encoded once. In DuckDB, the
segments' tokens are tables of byte intervals; an ASOF join finds the token of B
in which a token of A starts, a range join those that start inside it, and window
sums number the groups between bytes at which tokens of both end. Every batch
counts its linked id pairs; Spark adds the counts up, and each batch gets the sums
of its own pairs back, so nothing that grows with the corpus is sent to all tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenids import _spans
from .tokens import slices, text_buffer
from .workspace import Workspace

#: Bytes of text in a batch; a longer text is a batch of its own.
BATCH = 8 << 20
#: Bytes of a batch's distinct segments that are encoded and joined at once; a longer segment is a part of its own.
PART = 256 << 10
#: Memory of one DuckDB connection; beyond it DuckDB spills to the task's own folder.
MEMORY = "300MB"
#: Segments that are joined for one call of a tokenizer.
CALL = 4000

#: Bytes next to a cut: printable ASCII, or characters of two bytes from U+00C0 on, none of which is white space.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True


@dataclass(frozen=True)
class Coder:
    """encode: segments to (all ids, how many each has); token: the bytes of each id."""

    encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    token: list[bytes]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.token], np.int64)

    @cached_property
    def spelling(self) -> np.ndarray:
        """The bytes of all ids in a line."""
        return np.frombuffer(b"".join(self.token), np.uint8)


_open: dict[str, Coder] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of Latin-1 for themselves, all others for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def byte_coder(path: str) -> Coder:
    """A byte-level BPE of the tokenizers library: a space goes before every text; special tokens in texts are plain text."""
    if path not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        at = byte_level()
        token = [b""] * t.get_vocab_size()
        for piece, i in t.get_vocab().items():
            token[i] = bytes(at[c] for c in piece) if all(c in at for c in piece) else piece.encode()
        size = np.array([len(x) for x in token], np.int64)
        ids = lambda x: np.array(t.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.int64)

        def encode(segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
            plain = np.fromiter(map(_plain, segs), bool, len(segs))
            alone, kept = np.flatnonzero(~plain).tolist(), []
            n = np.zeros(len(segs), np.int64)
            for at in np.split(np.flatnonzero(plain), range(CALL, int(plain.sum()), CALL)):
                # joined, such segments are cut where whole texts are
                some = [segs[i] for i in at]
                flat, stop = ids("".join(some)), np.cumsum([len(x.encode()) for x in some])
                end = np.cumsum(size[flat])
                last = np.searchsorted(end, stop)
                if len(end) and end[-1] == stop[-1] and (end[last] == stop).all():
                    kept.append((at, flat))
                    n[at] = np.diff(last + 1, prepend=0)
                else:
                    alone += at.tolist()
            each, n[alone] = _flat([e.ids for e in t.encode_batch_fast([segs[i] for i in alone], add_special_tokens=False)])
            kept.append((np.array(alone, np.int64), each))
            out, start = np.zeros(int(n.sum()), np.int64), np.cumsum(n) - n
            for at, flat in kept:
                out[_spans(start[at], n[at])] = flat
            return out, n

        _open[path] = Coder(encode, token)
    return _open[path]


def piece_coder(path: str) -> Coder:
    """A BPE of the sentencepiece library, which puts a space before every text itself: segments come with theirs, which is taken off."""
    if path not in _open:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = [s.id_to_piece(i) for i in range(s.get_piece_size())]
        token = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        _open[path] = Coder(lambda x: _flat(s.encode([v[1:] for v in x], num_threads=1)), token)
    return _open[path]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n


def _plain(seg: str) -> bool:
    """Whether a segment may stand between others: a space first, then no white space next to its ends."""
    return len(seg) > 1 and seg[0] == " " and not seg[1].isspace() and not seg[-1].isspace()


def segments(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the segments of space+text of every text, in order; how many each text has).

    A cut is before a space between two characters that are plain. A byte-level
    BPE splits there before it merges, and a piece BPE has no piece with a space
    after another character, so both encode the segments of a text each on their own.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    raw, offsets = text_buffer(spaced)
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 3:
        before = _PLAIN[raw[1:-2]] | (_TWO[raw[:-3]] & (raw[1:-2] >= 0x80) & (raw[1:-2] < 0xC0))
        after = _PLAIN[raw[3:]] | _TWO[raw[3:]]
        cut[2 : n - 1] = (raw[2:-1] == 0x20) & before & after
        first = offsets[:-1]
        cut[np.minimum(first + 1, n)] = False  # a text's first segment has the space put before it and what follows
    cut[offsets] = True
    at = np.flatnonzero(cut).astype(np.int64)
    data = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw)))
    return data.dictionary_encode(), np.diff(np.searchsorted(at, offsets))


def spelt(names: pa.Array, flat: np.ndarray, n: np.ndarray, coder: Coder) -> np.ndarray:
    """Whether the bytes of each segment's tokens are the segment."""
    raw, offsets = text_buffer(names)
    edge = np.concatenate([[0], np.cumsum(n)])
    size = coder.sizes
    ends = np.concatenate([[0], np.cumsum(size[flat])])[edge]
    table, start = coder.spelling, np.cumsum(size) - size
    if (np.diff(ends) == np.diff(offsets)).all():
        wrong = np.concatenate([[0], np.cumsum(table[_spans(start[flat], size[flat])] != raw)])[offsets]
        return np.diff(wrong) == 0
    return np.array([b"".join(coder.token[i] for i in flat[x:y]) == v.encode() for x, y, v in zip(edge[:-1], edge[1:], names.to_pylist())], bool)


def joined(text: pa.Array, n: np.ndarray, mark: str) -> pa.Array:
    """Runs of n texts each, joined by a mark."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), text.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(mark, pa.large_string()))


# Bytes of all segments stand in one line, in which segments and tokens are intervals [s, e); equal segments are there once.
_SQL = {
    "inner_b": "SELECT * FROM b ANTI JOIN a ON a.s = b.s",  # tokens of B that start where none of A does
    # first the token of B in which a token of A starts, then those that start inside it
    "links": """
        SELECT a.seg, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
        UNION ALL
        SELECT a.seg, a.id, b.id FROM a JOIN inner_b b ON b.s > a.s AND b.s < a.e
    """,
    "cuts": "SELECT a.e FROM a JOIN b ON a.e = b.e",
    "a_groups": "SELECT a.seg, a.s, a.id, coalesce(sum((c.e IS NOT NULL)::INT) OVER (ORDER BY a.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM a LEFT JOIN cuts c ON a.e = c.e",
    "b_groups": "SELECT b.seg, b.s, b.id, coalesce(sum((c.e IS NOT NULL)::INT) OVER (ORDER BY b.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM b LEFT JOIN cuts c ON b.e = c.e",
    "pairs": "SELECT a, b, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY a, b) - 1 AS no FROM links JOIN occurs USING (seg) GROUP BY a, b",
    "seg_pairs": "SELECT seg, no FROM links JOIN pairs USING (a, b)",
}


@dataclass(frozen=True)
class Batch:
    """counts: n_a, n_b, n_groups, n_links of each text; names: the groups of each segment; seg, edge: segments of all texts in order, and where each text's begin; pairs: a, b, n, no, one row a linked pair; links and nos: how many links each segment has, and the pairs' numbers."""

    counts: dict[str, np.ndarray]
    names: pa.Array
    seg: np.ndarray
    edge: np.ndarray
    pairs: pa.Table
    links: np.ndarray
    nos: np.ndarray

    def rows(self, x: int, y: int) -> pa.Table:
        """n_a, n_b, n_groups, n_links, groups, segs (little-endian 32-bit numbers) of the texts from x to y."""
        seg = self.seg[self.edge[x] : self.edge[y]]
        groups = joined(self.names.take(pa.array(seg)), np.diff(self.edge[x : y + 1]), ";")
        segs = [self.seg[s:e].tobytes() for s, e in zip(self.edge[x:y], self.edge[x + 1 : y + 1])]
        return pa.table({c: v[x:y] for c, v in self.counts.items()} | {"groups": groups, "segs": pa.array(segs, pa.binary())})

    @property
    def docs(self) -> pa.Table:
        return self.rows(0, len(self.edge) - 1).drop_columns("segs")

    def runs(self) -> Iterator[tuple[int, int]]:
        """Texts from x to y that have about BATCH bytes of groups."""
        size = np.concatenate([[0], np.cumsum(pc.binary_length(self.names).to_numpy()[self.seg] + 1)])[self.edge]
        x = 0
        while x < len(size) - 1:
            y = max(x + 1, int(np.searchsorted(size, size[x] + BATCH, side="right")) - 1)
            yield x, y
            x = y


def aligned(tables: dict[str, pa.Table]) -> tuple[pa.Table, pa.Table, dict[str, pa.Table]]:
    """(pairs, the segments' links as numbers of pairs, the groups of both) of a part: a, b have tokens, occurs how often a segment is there."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
    try:
        for name, t in tables.items():
            con.register(f"_{name}", t)
            con.execute(f"CREATE TEMP TABLE {name} AS SELECT * FROM _{name}")
        for name, sql in _SQL.items():
            con.execute(f"CREATE TEMP TABLE {name} AS {sql}")
        ask = lambda q: con.sql(q).to_arrow_table()
        return ask("SELECT a, b, n FROM pairs ORDER BY no"), ask("SELECT seg, no FROM seg_pairs ORDER BY seg"), {x: ask(f"SELECT id, g, seg FROM {x}_groups ORDER BY s") for x in "ab"}
    finally:
        con.close()


def batch(texts: pa.Array, a: Coder, b: Coder) -> Batch:
    """Align a run of texts. Its distinct segments are encoded and joined in parts, so that memory grows with a part and not with all of them."""
    texts = pc.fill_null(texts, "")
    with_text = pc.greater(pc.binary_length(texts), 0)
    where = np.flatnonzero(with_text.to_numpy(zero_copy_only=False))
    coded, n = segments(texts.filter(with_text))
    seg = coded.indices.to_numpy()
    parts = [x.column("text").combine_chunks() for x in slices(pa.table({"text": coded.dictionary}), most=PART)]
    # a text has tokens only if those of both tokenizers spell it
    coded_as: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    good = [np.ones(0, bool)]
    for names in parts:
        words = names.to_pylist()
        coded_as.append({})
        good.append(np.ones(len(words), bool))
        for name, coder in (("a", a), ("b", b)):
            flat, m = coder.encode(words)
            good[-1] &= spelt(names, flat, m, coder)
            coded_as[-1][name] = flat.astype(np.int32), m.astype(np.int32)
        del words
    good = np.concatenate(good)
    doc = np.repeat(where, n)
    lost = np.zeros(len(texts), bool)
    lost[doc[~good[seg]]] = True
    doc, seg = doc[~lost[doc]], seg[~lost[doc]]
    occurs = np.bincount(seg, minlength=len(good))
    count = {c: [np.zeros(0, np.int64)] for c in ("n_a", "n_b", "n_groups", "n_links")}
    text, pairs, nos = [pa.array([], pa.large_string())], [], [np.zeros(0, np.int32)]
    first = at = 0  # of this part's segments, of its pairs
    for names, tokens in zip(parts, coded_as):
        k = len(names)
        often = occurs[first : first + k]
        first += k
        used = np.flatnonzero(often)
        tables = {"occurs": pa.table({"seg": used, "n": often[used]})}
        for name, coder in (("a", a), ("b", b)):
            flat, m = tokens.pop(name)
            of, size = np.repeat(np.arange(k), m), coder.sizes
            flat, of = flat[often[of] > 0], of[often[of] > 0]
            end = np.cumsum(size[flat])
            tables[name] = pa.table({"seg": of, "id": flat, "s": end - size[flat], "e": end})
        own, links, groups = aligned(tables)
        pairs.append(own)
        nos.append((links.column("no").to_numpy() + at).astype(np.int32))
        at += own.num_rows
        # groups are numbered along the line of segments, so those of a segment are a run
        g = groups["a"].column("g").to_numpy()
        in_group = {x: np.bincount(t.column("g").to_numpy(), minlength=int(g.max(initial=-1)) + 1) for x, t in groups.items()}
        both = [joined(t.column("id").combine_chunks().cast(pa.large_string()), in_group[x], ",") for x, t in groups.items()]
        seg_of = np.zeros(len(in_group["a"]), np.int64)
        seg_of[g] = groups["a"].column("seg").to_numpy()
        many = {f"n_{x}": t.column("seg").to_numpy() for x, t in groups.items()} | {"n_groups": seg_of, "n_links": links.column("seg").to_numpy()}
        for c, x in many.items():
            count[c].append(np.bincount(x, minlength=k))
        text.append(joined(pc.binary_join_element_wise(*both, pa.scalar("|", pa.large_string())), count["n_groups"][-1], ";"))
    count = {c: np.concatenate(x) for c, x in count.items()}
    merged, no = summed(pairs)
    edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[seg])])[edge])
    return Batch({c: total(x) for c, x in count.items()}, pa.concat_arrays(text), seg.astype("<i4"), edge, merged, count["n_links"], no[np.concatenate(nos)])


def summed(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
    """(a, b, n, no: the pairs of all parts, numbered; the number of each part's pairs, in order)."""
    t = pa.concat_tables(parts) if parts else pa.table({x: pa.array([], pa.int64()) for x in "abn"})
    found, no = np.unique(t.column("a").to_numpy().astype(np.int64) << 32 | t.column("b").to_numpy(), return_inverse=True)
    n = np.zeros(len(found), np.int64)
    np.add.at(n, no, t.column("n").to_numpy())
    return pa.table({"a": found >> 32, "b": found & 0xFFFFFFFF, "n": n, "no": np.arange(len(found))}), no.astype(np.int32)


@dataclass(frozen=True)
class Alignment:
    """docs: the columns kept, n_a, n_b, n_groups, n_links, n_best, count_sum, groups; pairs: a, b, n, best."""

    docs: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, ws: Workspace, coder_a: Callable[[], Coder], coder_b: Callable[[], Coder], *, keys: list[str], groups: Callable[[DataFrame], DataFrame] | None = None) -> Alignment:
    """Align every whole text; coder_a and coder_b open the tokenizers in a task.

    A null or empty text, and one that either tokenizer doesn't spell, has no
    tokens: counts of 0 and the text '' as groups. Equal rows are aligned each. A
    very long text is a batch of its own. An empty table gives empty tables.
    `n_best` counts links whose pair's count is the highest of its id of B, ties
    included. Only `keys` and `text` are read, whatever other columns there are.
    groups, if given, replaces the column `groups` before it is written (by a digest).
    """
    key_fields = [T.StructField(f"k{i}", docs.schema[k].dataType) for i, k in enumerate(keys)]
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), *key_fields, *map(long, ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups", T.StringType()), T.StructField("segs", T.BinaryType()), *map(long, ("no", "a", "b", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.taskcontext import TaskContext

        out = to_arrow_schema(schema)
        part, seq = TaskContext.get().partitionId(), 0
        a, b = coder_a(), coder_b()

        def rows(kind: str, n: int, /, **x) -> pa.RecordBatch:
            some = {"kind": pa.repeat(kind, n), "part": pa.repeat(part, n), "seq": pa.repeat(seq, n)} | x
            cols = [some[f.name].cast(f.type) if f.name in some else pa.nulls(n, f.type) for f in out]
            return pa.RecordBatch.from_arrays(cols, schema=out)

        for t in gathered(batches):
            x = batch(t.column("text").combine_chunks(), a, b)
            for start, end in x.runs():
                some = x.rows(start, end)
                yield rows("doc", end - start, **{c: some.column(c).combine_chunks() for c in some.column_names}, **{f.name: t.column(f.name).slice(start, end - start).combine_chunks() for f in key_fields})
            yield rows("pair", x.pairs.num_rows, **{c: x.pairs.column(c).combine_chunks() for c in ("a", "b", "n", "no")})
            yield rows("link", 2, segs=pa.array([v.astype("<i4").tobytes() for v in (x.links, x.nos)], pa.binary()), no=pa.array([0, 1]))
            seq += 1
            pa.default_memory_pool().release_unused()  # else a worker, which lives on, keeps it

    text = F.col("text").cast("string").alias("text")
    done = docs.select(*[F.col(f"`{k}`").alias(f.name) for k, f in zip(keys, key_fields)], text).mapInArrow(run, schema)
    done = ws.write(groups(done) if groups else done, "batches", partition_by=["kind"])
    pairs = done.where("kind = 'pair'")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    scored = ws.write(counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    looked = pairs.select("part", "seq", "no", "a", "b").join(scored, ["a", "b"]).select("part", "seq", "no", "n", "best")
    own = ws.read("batches", done.schema).where("kind <> 'pair'").drop("a", "b", "n")
    final = T.StructType([*key_fields, *map(long, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), own.schema["groups"]])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        is_link = pc.equal(left.column("kind"), "link")
        d, k = left.filter(pc.invert(is_link)), left.filter(is_link).sort_by("no")
        right = right.sort_by("no")
        count, no = (np.frombuffer(x.as_py(), "<i4") for x in k.column("segs"))
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        total = []
        for values in (right.column("best").cast(pa.int64()).to_numpy(), right.column("n").to_numpy()):
            of_seg = np.diff(np.concatenate([[0], np.cumsum(values[no])])[upto])  # of each segment
            data = d.column("segs").combine_chunks()
            segs, edge = np.frombuffer(data.buffers()[2] or b"", "<i4"), np.frombuffer(data.buffers()[1], "<i4", len(data) + 1, data.offset * 4).astype(np.int64) // 4
            run_of = np.concatenate([[0], np.cumsum(of_seg[segs[edge[0] : edge[-1]]])])
            total.append(np.diff(run_of[edge - edge[0]]))
        cols = [d.column(f.name) for f in final if f.name not in ("n_best", "count_sum")]
        cols[-1:] = [pa.array(total[0]), pa.array(total[1]), cols[-1]]
        return pa.table([c.cast(f.type) for c, f in zip(cols, to_arrow_schema(final))], schema=to_arrow_schema(final))

    # a batch is one group, of at most BATCH bytes or one text
    out = own.groupBy("part", "seq").cogroup(looked.groupBy("part", "seq")).applyInArrow(score, final)
    return Alignment(out.select(*[F.col(f.name).alias(k) for k, f in zip(keys, key_fields)], *[f.name for f in final][len(keys) :]), scored)


def gathered(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with about BATCH bytes of text each."""
    most = most or BATCH
    held: list[pa.RecordBatch] = []
    size = 0
    for x in batches:
        for s in slices(x, most=most):
            n = pc.sum(pc.binary_length(s.column("text"))).as_py() or 0
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(s)
            size += n
    if held:
        yield pa.Table.from_batches(held)
