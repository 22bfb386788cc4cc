"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r from 0 to `cap`. The rates shall meet token
constraints: sum(size * r) over a source is its target; and, as nearly as
possible, the mix keeps the corpus's shares of languages and of size classes,
which weighing sources alone would shift. Among such rates entropy balancing
takes those nearest to 1 in the relative entropy sum(size * (r log r - r + 1)).
The convex dual has a multiplier lam for each source and mu for each margin:

    r_i = min(cap, exp(lam_s(i) + mu_lang(i) + mu_class(i)))
    sum over source s of size * r = target_s
    sum over margin j of size * r = share_j * all targets - RIDGE * all targets * mu_j

The last term is a ridge of the dual: margins may contradict sources or the cap
(a language that one source has alone), and with it there always is exactly one
solution, which misses such margins by a little. report() tells by how much.

Documents of a source, language and size class have equal rates, so they are
added up to cells once. For given mu each source's lam is found on the executors,
one row a source; Newton's steps in mu take gradient and Hessian as aggregates
over all cells, and the driver solves a system of as many equations as there are
margins, MARGINS and the size classes at most. Documents are then rounded into
whole copies, in the order of their size.

All of it is DataFrame operations; there is no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, ranked

#: Words are runs of anything but these (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
#: Languages with a margin of their own, those of most words; all others and null share one.
MARGINS = 12
#: A multiplier of 1 lets a margin miss its target by this part of all targets.
RIDGE = 1e-3
#: Steps of Newton's method at most, the largest step, and the part of all targets by which margins may be off at the end; halvings of the range of a source's multiplier.
STEPS, STEP, CLOSE, HALVINGS = 40, 1.0, 1e-10, 60
#: Rates are whole multiples of 1 / UNIT.
UNIT = 10**9


def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; null: 0. Counted without building the words."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # squeeze runs of separators to one, keep the separators alone, and add one for the word that no separator ends
    flat = F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")
    flat = F.trim(flat)
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" ")))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): share of all sizes, dealt by weight, each target at most cap times its source's size.

    sizes has a row a source: source, source_size. Sources in code point order,
    null last, take the weights in turn. What a capped source can't take is
    dealt again by weight until none is above. That is water filling: targets
    are min(cap * size, weight * level), and the level is where they sum up. The
    two windows see one row a source, never documents.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    x = sizes.withColumn("_weight", F.element_at(w, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("_top", F.col("source_size") * F.lit(float(cap)))
    # sources fill up in the order of top / weight
    fill = Window.orderBy((F.col("_top") / F.col("_weight")).asc(), F.col("source").isNull(), F.col("source"))
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("_goal", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    # the level, if just the sources before this one were full
    x = x.withColumn("_level", (F.col("_goal") - F.coalesce(F.sum("_top").over(done), F.lit(0.0))) / F.sum("_weight").over(rest))
    x = x.withColumn("_holds", F.col("_weight") * F.col("_level") <= F.col("_top"))
    # once a level holds, later ones hold too; the first that holds is the level
    x = x.withColumn("_nth", F.row_number().over(fill))
    x = x.withColumn("_first", F.min(F.when(F.col("_holds"), F.struct("_nth", F.col("_level").alias("v")))).over(all_rows))
    target = F.when(F.col("_first").isNull(), F.col("_top")).otherwise(F.least(F.col("_top"), F.col("_weight") * F.col("_first.v")))
    return x.select("source", F.col("source_size").cast("long").alias("source_size"), F.round(target, 6).alias("target"))


def size_class(size: Column) -> Column:
    """Half the number of binary digits, rounded up: sizes of a class are within four times of each other."""
    return F.floor((F.length(F.bin(size)) + 1) / 2).cast("int")


def tilted(mu: Sequence[float], cell: Column) -> Column:
    """The sum of a cell's multipliers; margins count from 0."""
    m = F.array(*[F.lit(float(x)) for x in mu])
    return F.element_at(m, cell["a"] + 1) + F.element_at(m, cell["b"] + 1)


def rates(sources: DataFrame, mu: Sequence[float], cap: float) -> DataFrame:
    """sources(source, source_size, target, cells) with `lam`, and cells with their `x` (multipliers of margins) and rate `r`."""
    x = sources.withColumn("cells", F.transform("cells", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["n"].alias("n"), c["mass"].alias("mass"), tilted(mu, c).alias("x"))))
    top = F.lit(float(cap))
    total = lambda lam: F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["mass"] * F.least(top, F.exp(lam + c["x"])))
    mass = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["mass"])
    high = F.log(top) - F.array_min(F.transform("cells", lambda c: c["x"]))
    low = F.log(F.col("target") / mass) - F.array_max(F.transform("cells", lambda c: c["x"]))
    middle = lambda s: (s["low"] + s["high"]) / 2
    halve = lambda s, _: F.struct(F.when(total(middle(s)) < F.col("target"), middle(s)).otherwise(s["low"]).alias("low"), F.when(total(middle(s)) < F.col("target"), s["high"]).otherwise(middle(s)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(low.alias("low"), high.alias("high")), halve, lambda s: s["high"])
    # no words: any rate will do; no target: none; a target that only the cap reaches: all at the cap
    lam = F.when((mass > 0) & (F.col("target") > 0), F.when(F.col("target") >= mass * top, high).otherwise(found))
    x = x.withColumn("lam", lam)
    return x.withColumn("cells", F.transform("cells", lambda c: c.withField("r", F.when(F.col("lam").isNull(), F.lit(0.0)).otherwise(F.least(top, F.exp(F.col("lam") + c["x"]))))))


def solve(sources: DataFrame, margins: int, cap: float) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """(mu, a report of (margin, wanted, reached)) by Newton's method; every step adds up all cells, on the executors."""
    e = sources.select(F.explode("cells").alias("c"))
    share = np.zeros(margins)
    for r in e.select(F.explode(F.array("c.a", "c.b")).alias("j"), "c.mass").groupBy("j").agg(F.sum("mass").alias("m")).collect():
        share[r.j] = r.m
    total, words = (x or 0.0 for x in sources.agg(F.sum("target"), F.sum("source_size")).first())
    wanted = share / max(1, words) * total
    mu = np.zeros(margins)
    reached = wanted.copy()
    if not total:
        return mu, []
    for step in range(STEPS + 1):
        w = rates(sources, mu, cap)
        # of every cell its words, and those that move with lam and mu, as it is below the cap
        mass = lambda c: c["mass"] * c["r"]
        cell = lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), mass(c).alias("w"), F.when(c["r"] < cap, mass(c)).otherwise(0.0).alias("free"))
        w = w.select(F.transform("cells", cell).alias("cells"))
        item = lambda what, j, k, x, v: F.struct(F.lit(what).alias("what"), j.alias("j"), k.alias("k"), x.alias("w"), v.alias("v"))
        one = lambda name: F.transform("cells", lambda c: item("g", c[name], F.lit(0), c["w"], c["free"]))
        pair = F.transform("cells", lambda c: item("p", c["a"], c["b"], F.lit(0.0), c["free"]))
        # less, for each source, the product of its margins' free words over all its free words
        held = lambda k: F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.when((c["a"] == k) | (c["b"] == k), c["free"]).otherwise(0.0))
        w = w.withColumn("h", F.filter(F.array(*[F.struct(F.lit(k).alias("j"), held(k).alias("h")) for k in range(margins)]), lambda c: c["h"] > 0))
        w = w.withColumn("all", F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["free"]))
        outer = F.flatten(F.transform("h", lambda p: F.transform("h", lambda q: item("o", p["j"], q["j"], F.lit(0.0), p["h"] * q["h"] / F.col("all")))))
        rows = w.select(F.explode(F.concat(one("a"), one("b"), pair, outer)).alias("i")).select("i.*")
        got = rows.groupBy("what", "j", "k").agg(F.sum("w").alias("w"), F.sum("v").alias("v")).collect()  # pairs of margins
        reached, hess = np.zeros(margins), np.eye(margins) * RIDGE * total
        for r in got:
            if r.what == "g":
                reached[r.j] = r.w
                hess[r.j, r.j] += r.v
            elif r.what == "p":
                hess[r.j, r.k] += r.v
                hess[r.k, r.j] += r.v
            else:
                hess[r.j, r.k] -= r.v
        gradient = reached - wanted + RIDGE * total * mu
        if np.abs(gradient).max() < CLOSE * total or step == STEPS:
            break
        move = np.linalg.solve(hess, gradient)
        mu = mu - move * min(1.0, STEP / np.abs(move).max())
    return np.round(mu, 9), [(j, float(wanted[j]), float(reached[j])) for j in range(margins)]


def report(ws: Workspace) -> DataFrame:
    """(margin, wanted, reached) of the last mix() in this workspace: words of each language and size class, wanted and by the rates."""
    return ws.read("mix_margins", "margin string, wanted double, reached double")


def mix(docs: DataFrame, ws: Workspace, *, keys: Sequence[str] = ("doc_id",), weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(keys, size, source_size, target, taken, source, rate, copies) for every row of docs.

    Reads keys (which name a row), text, source and, if there is one, lang. A
    source's documents, ordered by size and keys, are rounded systematically: with R
    the sum of the rates before a document and r its own, it gets floor(R + r + 1/2) -
    floor(R + 1/2) copies. So any run of documents has within one copy of its share,
    and the source's words come within its longest document of the target. Nobody
    gets more than ceil(r) copies. The order is global, so reruns agree; a hot source
    spans many partitions.

    Null or empty texts have size 0; null sources are one source, the last; equal
    rows get copies each on their own, which of them more is open; a very long text
    is counted whole; an empty table gives an empty result. Other columns of docs
    are not read.
    """
    if clash := {"source", "size", "cell", "rank", "lang", "before"} & set(keys):
        raise ValueError(f"keys may not be named {sorted(clash)}")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*keys, F.col("source").cast("string").alias("source"), lang.alias("lang"), word_count(F.col("text")).alias("size"))
    rows = ws.write(rows, "mix_sizes")
    most = rows.where("lang is not null").groupBy("lang").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "lang").limit(MARGINS).collect()
    names = sorted(r.lang for r in most)
    a = F.coalesce(*[F.when(F.col("lang") == n, F.lit(k)) for k, n in enumerate(names)], F.lit(len(names)))
    b = size_class(F.col("size"))
    top = rows.agg(F.max(b)).first()[0] or 0
    cell = F.struct("source", b.alias("b"), a.alias("a")).alias("cell")
    cells = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass")).select("cell.*", "n", "mass")
    cells = cells.select("source", "a", (F.col("b") + len(names) + 1).cast("int").alias("b"), "n", F.col("mass").cast("double").alias("mass"))
    sizes = cells.groupBy("source").agg(F.sum("mass").cast("long").alias("source_size"), F.array_sort(F.collect_list(F.struct("b", "a", "n", "mass"))).alias("cells"))
    goal = targets(sizes.select("source", "source_size"), weights, share, cap)
    sizes = ws.write(goal.join(sizes.select(F.col("source").alias("_s"), "cells"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix_sources")
    margins = len(names) + 1 + top + 1
    mu, told = solve(sizes, margins, cap)
    label = [*names, "other languages", *(f"size class {k}" for k in range(top + 1))]
    ws.write(ws.spark.createDataFrame([(label[j], x, y) for j, x, y in told], "margin string, wanted double, reached double"), "mix_margins")
    # whole units, so that the last bits of exp() decide nothing
    units = F.least(F.lit(int(cap * UNIT)), F.round(F.col("c.r") * UNIT)).cast("long")
    done = rates(sizes, mu, cap).select("source", F.explode("cells").alias("c"))
    done = done.select(F.struct("source", (F.col("c.b") - len(names) - 1).cast("int").alias("b"), F.col("c.a").alias("a")).alias("_cell"), units.alias("_units"))
    done = ws.write(done, "mix_rates")
    rated = rows.select(*keys, "source", "size", cell).join(done, F.col("cell").eqNullSafe(F.col("_cell"))).select(*keys, "source", "size", "_units")
    ranks, _ = ranked(ws, rated, ["size", *keys], "source", "mix_ranks", weight="_units", modulus=UNIT)
    goal = sizes.select(F.col("source").alias("_source"), "source_size", "target")
    out = ranks.join(goal, F.col("source").eqNullSafe(F.col("_source")), "left")
    copies = F.expr(f"(before + _units + {UNIT // 2}) div {UNIT} - (before + {UNIT // 2}) div {UNIT}").cast("long")
    out = out.withColumn("copies", copies)
    return out.select(*keys, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", (F.col("_units") / UNIT).alias("rate"), "copies")
