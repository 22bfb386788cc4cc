"""Trees of nodes by parent: roots, pre-order numbers and subtree sums, descendants, leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.saved import drop

#: Levels of nodes with children that numbers() goes through one by one; deeper forests are walked as a list.
LEVELS = 12


def roots(nodes: DataFrame, save, most: int = 40) -> DataFrame:
    """nodes(id, parent_id, ...) with root_id and depth: the node above that has no parent, or whose parent is no node.

    Each round doubles the distance that every node has looked up, so a tree of
    depth n takes log2(n) rounds of one join on equal keys. save(df, name) writes a
    table and returns it read back. Nodes of a cycle have no root and keep null.
    """
    own = nodes.select("id", F.col("parent_id").alias("up")).dropDuplicates(["id"])
    known = own.select(F.col("id").alias("up"))
    # a parent that is no node counts as none
    up = own.join(known.withColumn("_is", F.lit(True)), "up", "left").select("id", F.when(F.col("_is"), F.col("up")).alias("up"))
    at = save(up.select("id", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("up").isNull().alias("done")), "up_0")
    for k in range(1, most):
        if at.where("not done").isEmpty():
            break
        above = at.select(F.col("id").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        step = at.where("not done").join(above, "top").select("id", F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        at = save(at.where("done").unionByName(step), f"up_{k}")
    found = at.select("id", F.when(F.col("done"), F.col("top")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))
    return nodes.join(found, "id", "left")


def descendants(nodes: DataFrame, save) -> DataFrame:
    """(ancestor, id, depth) of all pairs of a node and a node below it, one level of the tree a round, however deep.

    These are as many rows as the nodes' depths add up to: tour() answers most
    questions with one row a node.
    """
    edge = nodes.where("parent_id is not null").select(F.col("parent_id").alias("ancestor"), "id")
    out = level = save(edge.withColumn("depth", F.lit(1)), "below_1")
    depth = 1
    while not level.isEmpty():
        depth += 1
        # on a cycle, a node's walk ends where it would meet the node again
        step = level.select("ancestor", F.col("id").alias("_p")).join(edge.select(F.col("ancestor").alias("_p"), "id"), "_p").where("ancestor <> id")
        level = save(step.select("ancestor", "id", F.lit(depth).alias("depth")), f"below_{depth}")
        out = out.unionByName(level)
    return out


def leaves(nodes: DataFrame, never: Column) -> DataFrame:
    """Nodes without children, but those where `never` holds."""
    return nodes.where(~never).join(nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")), "id", "left_anti")


def tour(nodes: DataFrame, save, sums: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """nodes(id, parent_id, ord, ...) with the columns of numbers()."""
    return nodes.join(numbers(nodes, save, sums, levels), "id", "left")


def numbers(nodes: DataFrame, save, sums: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """(id, root_id, depth, pre, last, position, total_...) of nodes(id, parent_id, ord, ...); total_x for each column x of sums: its total over the node and all below it.

    pre numbers the nodes of the forest from 0: roots by (ord, id), each followed by
    its tree, children by (ord, id) too. What is below a node has the numbers from
    pre + 1 to last; position is pre less the root's. A parent that is no node counts
    as none; nodes of a cycle, and below it, have nulls. Ids must be distinct and not
    null, else an error is raised. Summed columns are whole numbers, null counts 0.

    All nodes are sorted once by (parent, ord, id) over range partitions: a node's
    children are neighbours, and no task gets all of them. Sizes and sums then go up,
    and numbers down, the levels of nodes that have children, one small join a level;
    every node takes part in few joins, however many levels there are. Forests of
    more than `levels` such levels are walked as a list, by _walk().
    """
    spark = nodes.sparkSession
    values = [f"_s_{c}" for c in sums]
    own = save(nodes.select("id", "parent_id", "ord", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(f"_s_{c}") for c in sums]), "tour_own")
    ends = own.select("id", F.lit(1).alias("is")).unionByName(own.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("is", F.lit(0)))
    odd = save(ends.groupBy("id").agg(F.sum("is").alias("n")).where("n <> 1 or id is null"), "tour_odd")
    if not odd.where("n > 1 or id is null").isEmpty():
        raise ValueError("ids that are null or repeated")
    kin = own
    if not odd.isEmpty():  # parents that are no nodes
        kin = own.join(odd.select(F.col("id").alias("parent_id"), F.lit(True).alias("_gone")), "parent_id", "left").withColumn("parent_id", F.when(F.col("_gone").isNull(), F.col("parent_id"))).drop("_gone")
    order = [F.col("parent_id").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("id").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = save(kin.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("ord").withColumn("_at", F.monotonically_increasing_id()), "tour_sorted")
    drop(save, own, odd)
    # a dense number: the place in the partition and the rows of those before; one row a partition here
    part = F.shiftright("_at", 33)
    size = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("_roots"))
    size = save(size, "tour_sizes")
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    total, roots_ = size.agg(F.sum("_n"), F.sum("_roots")).first()
    rows = placed.join(F.broadcast(before), part == F.col("_part")).withColumn("v", F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")).drop("_at", "_part", "_before")
    # nodes with children: where these begin and end, and their sums
    kids = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.min("v").alias("_first"), F.max("v").alias("_last"), *[F.sum(c).alias(f"_kids{c}") for c in values])
    inner = save(rows.join(kids, "id"), "tour_inner")
    mixed = inner.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("_mixed", F.lit(True))
    up = inner.select("id", F.col("v").alias("pv"), F.col("_first").alias("_from")).join(mixed, "id", "left").withColumnRenamed("id", "parent_id")
    # all nodes with their parent's number; _mixed: that some of its children have children
    linked = save(rows.join(up, "parent_id", "left").select("id", "v", "pv", "_from", F.coalesce("_mixed", F.lit(False)).alias("_mixed"), *values), "tour_linked")
    drop(save, placed)
    kin = save(inner.drop("parent_id").join(inner.select(F.col("id").alias("parent_id"), F.col("v").alias("pv")).join(inner.select("v", "parent_id"), "parent_id").select("v", "pv"), "v", "left"), "tour_kin")
    drop(save, inner)
    level = save(kin.where("pv is null").withColumn("root_id", F.col("id")).withColumn("depth", F.lit(0)).drop("id"), "tour_level")
    down = []
    while not level.isEmpty() and len(down) <= levels:
        down.append(level)
        above = level.select(F.col("v").alias("pv"), "root_id", (F.col("depth") + 1).alias("depth"))
        level = save(kin.drop("id").join(above, "pv"), "tour_level")
    if len(down) > levels:
        drop(save, level, *down)
        found = _walk(linked, kin, total or 0, roots_ or 0, values, save)
        drop(save, linked, kin)
        return found
    drop(save, kin, level)
    sized, below = [], None
    for level in reversed(down):
        plain = [(F.col("_last") - F.col("_first") + 1).alias("_own"), *[(F.col(c) + F.col(f"_kids{c}")).alias(f"_t{c}") for c in values]]
        x = level.select("v", "pv", "root_id", "depth", *values, *plain)
        if below is not None:
            more = below.groupBy(F.col("pv").alias("v")).agg(F.sum("below").alias("_more"), *[F.sum(F.col(f"_t{c}") - F.col(c)).alias(f"_more{c}") for c in values])
            x = x.join(more, "v", "left")
            add = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0).cast("long"))).alias(c)
            x = x.select("v", "pv", "root_id", "depth", *values, add("_own", "_more"), *[add(f"_t{c}", f"_more{c}") for c in values])
        below = save(x.withColumnRenamed("_own", "below"), "tour_sized")
        sized.insert(0, below)
    drop(save, *down)
    # where a child stands below its parent: its place, and what is below earlier children; these are only summed where there are any
    base = linked.where("pv is null or _mixed").select("v", "pv", "_from")
    every = None
    for x in sized:
        every = x.select("v", "below") if every is None else every.unionByName(x.select("v", "below"))
    if every is None:
        every = linked.where("false").select("v", F.col("v").alias("below"))
    told = base.join(every, "v", "left").withColumn("below", F.coalesce("below", F.lit(0).cast("long")))
    told = save(told.repartitionByRange(parts, "v").sortWithinPartitions("v").withColumn("_at", F.monotonically_increasing_id()), "tour_base")
    loads = save(told.groupBy(part.alias("_part")).agg(F.sum("below").alias("_load")), "tour_loads")
    loads = loads.select("_part", (F.sum("_load").over(Window.orderBy("_part")) - F.col("_load")).alias("_loads"))
    here = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told_ = told.withColumn("_part", part).withColumn("_sum", F.sum("below").over(here) - F.col("below")).join(F.broadcast(loads), "_part").withColumn("_sum", F.col("_sum") + F.col("_loads"))
    summed = save(told_.select("v", "pv", "_from", F.col("_sum").alias("e")), "tour_summed")
    drop(save, told)
    least = summed.where("pv is not null").groupBy("pv").agg(F.min("e").alias("_least"))
    rel = summed.join(least, "pv", "left").select("v", F.when(F.col("pv").isNull(), F.col("v") + F.col("e")).otherwise(F.col("v") - F.col("_from") + 1 + F.col("e") - F.col("_least")).alias("rel"))
    rel = save(rel, "tour_rel")
    drop(save, summed)
    # numbers of nodes with children, from the roots down
    info, above = None, None
    for x in sized:
        x = x.join(rel, "v")
        if above is None:
            x = x.select("v", "root_id", "depth", F.col("rel").alias("pre"), F.col("rel").alias("_top"), "below", *[f"_t{c}" for c in values])
        else:
            x = x.join(above, "pv").select("v", "root_id", "depth", (F.col("_pre") + F.col("rel")).alias("pre"), "_top", "below", *[f"_t{c}" for c in values])
        x = save(x, "tour_info")
        above = x.select(F.col("v").alias("pv"), F.col("pre").alias("_pre"), "_top")
        info = x if info is None else info.unionByName(x)
    drop(save, *sized)
    if info is None:
        info = linked.where("false").select("v", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.col("v").alias("pre"), F.col("v").alias("_top"), F.col("v").alias("below"), *[F.col(c).alias(f"_t{c}") for c in values])
    info = save(info, "tour_infos")
    out = info.select("v", "root_id", "depth", "pre", "_top", (F.col("pre") + F.col("below")).alias("last"), *[F.col(f"_t{c}").alias(f"total_{c[3:]}") for c in values])
    inner_ = linked.select("id", "v").join(out, "v").select("id", "root_id", "depth", "pre", "last", (F.col("pre") - F.col("_top")).alias("position"), *[f"total_{c}" for c in sums])
    # nodes without children: of roots, of parents with other such nodes alone, and of the rest; those of cycles have nulls
    leaf = linked.join(info.select("v"), "v", "left_anti")
    near = leaf.where("pv is not null and not _mixed").withColumn("rel", F.col("v") - F.col("_from") + 1).unionByName(leaf.where("pv is null or _mixed").join(rel, "v", "left"))
    above = info.select(F.col("v").alias("pv"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), F.col("pre").alias("_pre"), "_top")
    near = near.join(above, "pv", "left")
    root, known = F.col("pv").isNull(), F.col("pv").isNull() | F.col("_pre").isNotNull()
    pre = F.when(root, F.col("rel")).otherwise(F.col("_pre") + F.col("rel"))
    leaves_ = near.select("id", F.when(root, F.col("id")).otherwise(F.col("_root")).alias("root_id"), F.when(root, 0).otherwise(F.col("_depth") + 1).alias("depth"), pre.alias("pre"), pre.alias("last"), F.when(root, F.lit(0).cast("long")).otherwise(pre - F.col("_top")).alias("position"), *[F.when(known, F.col(c)).alias(f"total_{c[3:]}") for c in values])
    return inner_.unionByName(leaves_)


def _walk(rows: DataFrame, inner: DataFrame, total: int, roots_: int, values: list[str], save) -> DataFrame:
    """numbers() of rows(id, v, pv, values) and inner(v, _first, _last), however deep.

    The walk round the forest is a linked list with an element where it enters a node
    and one where it leaves an inner node. Each round lets every element look twice as
    far, so a list of n elements takes log2(n) rounds of one join on distinct numbers,
    however deep or wide trees are. A round's table replaces that of the round before.
    """
    inner = inner.select("v", "_first", "_last")
    above = inner.select(F.col("_last").alias("v"), (F.col("v") * 2 + 1).alias("_up"))
    # where the walk goes on after a node: to the next sibling, or out of the parent
    out = F.when(F.col("v") == roots_ - 1, F.lit(None)).otherwise(F.coalesce("_up", F.col("v") * 2 + 2))
    x = rows.join(inner, "v", "left").join(above, "v", "left").withColumn("_out", out)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    is_inner = F.col("_first").isNotNull()
    is_root = F.col("pv").isNull().cast("long")
    enter = x.select((F.col("v") * 2).alias("e"), F.when(is_inner, F.col("_first") * 2).otherwise(F.col("_out")).alias("next"), one.alias("n"), is_inner.cast("long").alias("open"), is_root.alias("tops"), *values)
    leave = x.where(is_inner).select((F.col("v") * 2 + 1).alias("e"), F.col("_out").alias("next"), zero.alias("n"), F.lit(-1).cast("long").alias("open"), zero.alias("tops"), *[zero.alias(c) for c in values])
    at = save(enter.unionByName(leave), "tour_0")
    add = ["n", "open", "tops", *values]
    for k in range(1, (2 * total).bit_length() + 1):
        far = at.select(F.col("e").alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in add])
        # sums go round and round on a cycle, which never ends: they may be of any size, and are left out below
        plus = [F.try_add(F.col(c), F.coalesce(f"_{c}", zero)).alias(c) for c in add]
        old, at = at, save(at.join(far, "next", "left").select("e", F.col("_next").alias("next"), *plus), f"tour_{k}")
        drop(save, old)
    at = at.where("next is null")
    first = at.where("e = 0").select("n").first()
    counted = first.n if first else 0
    on, off = F.col("e") % 2 == 0, F.col("e") % 2 == 1
    pick = lambda c, which: F.max(F.when(which, F.col(c)))
    ends = at.groupBy(F.floor(F.col("e") / 2).alias("v")).agg(*[pick(c, on).alias(c) for c in add], *[pick(c, off).alias(f"_{c}") for c in ("n", *values)])
    got = rows.select("id", "v", *[F.col(c).alias(f"{c}_own") for c in values]).join(ends, "v", "left")
    pre = F.lit(counted) - F.col("n")
    got = got.select("id", (F.lit(roots_) - F.col("tops") - F.when(F.col("open") == 0, 0).otherwise(1)).alias("_root"), (-F.col("open")).cast("int").alias("depth"), pre.alias("pre"), F.coalesce(pre + F.col("n") - F.col("_n") - 1, pre).alias("last"), *[F.when(F.col("n").isNotNull(), F.coalesce(F.col(c) - F.col(f"_{c}"), F.col(f"{c}_own"))).alias(f"total_{c[3:]}") for c in values])
    got = save(got, "tour_found")
    tops = got.where("depth = 0").select("_root", F.col("id").alias("root_id"), F.col("pre").alias("_pre"))
    return got.join(tops, "_root", "left").withColumn("position", F.col("pre") - F.col("_pre")).select("id", "root_id", "depth", "pre", "last", "position", *[f"total_{c[3:]}" for c in values])
