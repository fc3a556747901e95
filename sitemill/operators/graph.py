"""Redirect chains, trees, dependency order and reachability.

Loops run as DataFrame joins. Chains and closures double their reach every round, so the number
of rounds is the logarithm of the length; each round is written and read again (cut_lineage). Rows that
are finished leave the join, so a popular end address is joined once and not carried along."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sitemill import constants as K
from sitemill.operators.ordered import next_marked, range_chunks, running_sum
from sitemill.session import cut_lineage, scratch_folder


def _has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


# ------------------------------------------------------------------ chains of single out-edges

def walk_chains(edges: DataFrame, max_hops: int = K.MAX_HOPS) -> DataFrame:
    """edges(src, dst) with one edge per src -> (src, chain): the addresses visited after src.

    A chain ends at an address without an edge, and never grows beyond 2 * (max_hops + 1)
    entries, so the arrays stay small whatever the graph looks like."""
    rounds = 0
    while (1 << rounds) <= max_hops + 1:
        rounds += 1
    step = edges.select("src", F.array("dst").alias("chain"), F.lit(True).alias("open"))
    step = cut_lineage(step)
    for _ in range(rounds):
        ahead = step.select(F.col("src").alias("end"), F.col("chain").alias("more"), F.col("open").alias("more_open"))
        active = step.where("open").withColumn("end", F.element_at("chain", -1))
        grown = active.join(ahead, "end", "left").select(
            "src",
            F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.concat("chain", "more")).alias("chain"),
            F.coalesce("more_open", F.lit(False)).alias("open"),
        )
        step = cut_lineage(step.where("not open").unionByName(grown))
        if not _has_rows(step.where("open")):
            break
    return step.select("src", "chain")


def chain_outcome(src: Column, chain: Column, max_hops: int = K.MAX_HOPS) -> Column:
    """struct(final, hops, cycle) of a visited chain: final is null for loops and long chains."""
    path = F.concat(F.array(src), chain)
    distinct = F.size(F.array_distinct(path))
    too_long = (F.size(chain) > max_hops) | (distinct < F.size(path))
    return F.struct(
        F.when(~too_long, F.element_at(path, -1)).alias("final"),
        F.when(~too_long, F.size(chain)).alias("hops"),
        too_long.alias("cycle"),
    )


def chain_ends(edges: DataFrame) -> DataFrame:
    """edges(src, dst) with one edge per src -> (src, final, hops, cycle): where each chain ends and after how many
    steps, however long it is; a chain that runs into a loop has no end.

    Only (src, position, steps) is carried. Reach doubles per round and chains that ended leave, so what is still
    open once the reach has passed the number of nodes runs in a loop."""
    step = cut_lineage(edges.select("src", F.col("dst").alias("at"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("open")))
    reach, nodes = 1, step.count()
    while reach <= nodes and _has_rows(step.where("open")):
        ahead = step.select(F.col("src").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("open").alias("more_open"))
        grown = step.where("open").join(ahead, "at", "left").select(
            "src", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("more_open", F.lit(False)).alias("open"),
        )
        step = cut_lineage(step.where("not open").unionByName(grown))
        reach *= 2
    return step.select("src", F.when(~F.col("open"), F.col("at")).alias("final"), F.when(~F.col("open"), F.col("hops")).alias("hops"), F.col("open").alias("cycle"))


def chain_walks(edges: DataFrame) -> DataFrame:
    """edges(src, dst) with one edge per src -> (src, end, hops, loop): where each chain ends and after how many steps,
    however long it is. A chain that runs into a loop ends at the first address it meets again."""
    edges = cut_lineage(edges.select("src", "dst"))
    on_loop = cut_lineage(cycle_members(edges).select(F.col("node").alias("src")))
    straight = chain_ends(edges.join(on_loop, "src", "left_anti")).select("src", F.col("final").alias("end"), "hops")
    if not _has_rows(on_loop):
        return straight.withColumn("loop", F.lit(False))
    # every member learns the smallest address of its loop
    step = cut_lineage(edges.join(on_loop, "src", "left_semi").select("src", F.col("dst").alias("at"), F.least("src", "dst").alias("least")))
    reach, nodes = 1, step.count()
    while reach < nodes:
        ahead = step.select(F.col("src").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        step = cut_lineage(step.join(ahead, "at").select("src", F.col("next").alias("at"), F.least("least", "other").alias("least")))
        reach *= 2
    sizes = step.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    members = cut_lineage(step.join(sizes, "least").select(F.col("src").alias("end"), "size"))
    walked = straight.join(members, "end", "left").select("src", "end", (F.col("hops") + F.coalesce("size", F.lit(0))).alias("hops"), F.col("size").isNotNull().alias("loop"))
    return walked.unionByName(members.select(F.col("end").alias("src"), "end", F.col("size").alias("hops"), F.lit(True).alias("loop")))


def redirect_closure(edges: DataFrame, live: DataFrame | None = None, max_hops: int = K.MAX_HOPS) -> DataFrame:
    """edges(src, dst), live(route) -> (src, final, hops, cycle, too_long). Live addresses are never followed. Loops
    have no final; a chain over max_hops has one and is marked too_long."""
    hops = edges if live is None else edges.join(live.select(F.col("route").alias("src")), "src", "left_anti")
    return chain_ends(hops).withColumn("too_long", F.coalesce(F.col("hops") > max_hops, F.lit(False)))


def conflicting_targets(edges: DataFrame) -> DataFrame:
    """Sources with more than one distinct target."""
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("targets")).where("targets > 1")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle of a graph with one edge per src.

    After n or more steps only nodes on cycles are still reached, and every such node is. Paths
    double per round and rows that fall off the graph leave, so loop-free data ends early."""
    step = cut_lineage(edges.select("src", F.col("dst").alias("at")))
    reach, nodes = 1, step.count()
    while reach < nodes and _has_rows(step):
        ahead = step.select(F.col("src").alias("at"), F.col("at").alias("next"))
        step = cut_lineage(step.join(ahead, "at").select("src", F.col("next").alias("at")))
        reach *= 2
    # one more step keeps only nodes whose last position still has an edge
    return step.select(F.col("at").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_semi")


# ------------------------------------------------------------------ trees

def tree_labels(nodes: DataFrame, order: Column | None = None) -> DataFrame:
    """nodes(id, parent_id, ...) -> (id, root, depth, enter, leave): the places at which a walk of the root's tree enters and leaves
    each node, so a subtree is the range enter..leave of its root and has (leave - enter + 1) / 2 nodes.

    Euler tour and list ranking: every node has two elements, on the way in and on the way out; each points to the
    next element of the walk (first child, next sibling, or the parent's way out), children by order, then id. Pointers
    double per round with the steps and the change of depth they pass, so a chain of n nodes takes log2(2n) rounds. A node
    without a parent, or with a missing one or itself, is a root. Nodes of a component that holds a cycle have null labels."""
    own = nodes.select("id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")).alias("parent_id"), (F.lit(0) if order is None else order).alias("_order")).dropDuplicates(["id"])
    known = own.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    own = own.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("_known"), F.col("parent_id"))).drop("_known")
    own = range_chunks(own, [F.col("parent_id"), F.col("_order"), F.col("id")])
    kids = own.where("parent_id is not null")
    after = next_marked(kids, ["parent_id"], "chunk", [F.struct("_order", "id")], F.lit(True), F.col("id"), "_next").select("id", "_next")
    first = kids.groupBy(F.col("parent_id").alias("id")).agg(F.min_by("id", F.struct("_order", "id")).alias("_first"))
    walk = own.join(after, "id", "left").join(first, "id", "left")
    way_in = F.struct(F.col("id"), F.lit(False).alias("out"), F.coalesce("_first", "id").alias("to"), F.col("_first").isNull().alias("to_out"))
    way_out = F.struct(F.col("id"), F.lit(True).alias("out"), F.coalesce("_next", "parent_id").alias("to"), F.col("_next").isNull().alias("to_out"))
    steps = walk.select(F.explode(F.array(way_in, way_out)).alias("e")).select("e.*")
    up = F.when(F.col("to_out"), 1).otherwise(-1).cast("long")
    # the way out of a root points nowhere
    step = cut_lineage(steps.where("to is not null").select("id", "out", "to", "to_out", F.lit(1).cast("long").alias("steps"), up.alias("up"), F.lit(True).alias("open")))
    reach, most = 1, step.count()
    while reach <= 2 * most and _has_rows(step.where("open")):
        # finished rows stay in the table: they lead to their root in one step
        ahead = step.select(F.col("id").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("_to"), F.col("to_out").alias("_to_out"), F.col("steps").alias("_steps"), F.col("up").alias("_up"), F.col("open").alias("_open"))
        grown = step.where("open").join(ahead, ["to", "to_out"], "left").select(
            "id", "out", F.coalesce("_to", "to").alias("to"), F.coalesce("_to_out", "to_out").alias("to_out"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            (F.col("up") + F.coalesce("_up", F.lit(0))).alias("up"), F.coalesce("_open", F.lit(False)).alias("open"),
        )
        step = cut_lineage(step.where("not open").unionByName(grown))
        reach *= 2
    alone = walk.where("parent_id is null").select("id", F.lit(True).alias("out"), F.col("id").alias("to"), F.lit(True).alias("to_out"), F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("up"))
    ends = alone.unionByName(step.where("not open").drop("open"))
    sides = ends.groupBy("id").agg(F.min("to").alias("root"), F.max(F.when(~F.col("out"), F.col("steps"))).alias("_in"), F.max(F.when(F.col("out"), F.col("steps"))).alias("_out"), F.max(F.when(~F.col("out"), F.col("up") - 1)).alias("depth"))
    length = sides.where("id = root").select("root", F.col("_in").alias("_length"))
    labels = sides.join(length, "root").select("id", "root", "depth", (F.col("_length") - F.col("_in")).alias("enter"), (F.col("_length") - F.col("_out")).alias("leave"))
    return cut_lineage(own.select("id").join(labels, "id", "left"))


#: Blocks of a walk: powers of this many places, up to the largest one; no key of the range join has more rows than that.
_RADIX, _LEVELS = 16, 4


def _of_level(k: int) -> Callable[[Column], Column]:
    return lambda number: F.struct(F.lit(k).alias("level"), number.alias("block"))


def _blocks(low: Column, high: Column) -> Column:
    """The blocks (level, number) that exactly fill the places low..high."""
    levels = []
    for k in range(_LEVELS + 1):
        size = _RADIX**k
        a, b = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        inner, outer = (F.ceil(a / _RADIX) * _RADIX).cast("long"), (F.floor(b / _RADIX) * _RADIX).cast("long")
        whole = F.lit(k == _LEVELS) | (inner > outer)  # no larger block inside
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        numbers = F.when(whole, run(a, b)).otherwise(F.concat(run(a, inner), run(outer, b)))
        levels.append(F.transform(numbers, _of_level(k)))
    return F.flatten(F.array(*levels))


def within_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(root, at, ...), ranges(root, low, high, ...) -> every pair of a point and a range of its root that holds it, once.

    Ranges are divided into aligned blocks, points name the block they are in at each level, and blocks meet by
    equality; a range has few blocks besides one for every 65,536 places, and no block has more points than that."""
    left = points.withColumn("_at", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("at") / _RADIX**k).cast("long").alias("block")) for k in range(_LEVELS + 1)))))
    left = left.select("*", F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block")).drop("_at")
    right = ranges.withColumn("_in", F.explode(_blocks(F.col("low"), F.col("high")))).select("*", F.col("_in.level").alias("_level"), F.col("_in.block").alias("_block")).drop("_in")
    return left.join(right, ["root", "_level", "_block"]).drop("_level", "_block")


def ancestors_of(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """labels (tree_labels), asked(id) -> (id, ancestor, depth) of the asked nodes; depth 1 is the parent."""
    points = labels.join(asked.select("id").distinct(), "id", "left_semi").where("enter is not null").select("root", F.col("enter").alias("at"), "id", F.col("depth").alias("_own"))
    ranges = labels.where("leave > enter + 1").select("root", (F.col("enter") + 1).alias("low"), (F.col("leave") - 1).alias("high"), F.col("id").alias("ancestor"), F.col("depth").alias("_top"))
    return within_ranges(points, ranges).select("id", "ancestor", (F.col("_own") - F.col("_top")).cast("int").alias("depth"))


def members_of(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """labels (tree_labels), asked(id) -> (id, member): the asked nodes with themselves and all below them."""
    points = labels.where("enter is not null").select("root", F.col("enter").alias("at"), F.col("id").alias("member"))
    ranges = labels.join(asked.select("id").distinct(), "id", "left_semi").where("enter is not null").select("root", F.col("enter").alias("low"), F.col("leave").alias("high"), "id")
    return within_ranges(points, ranges).select("id", "member")


def subtree_totals(labels: DataFrame, values: DataFrame) -> DataFrame:
    """labels (tree_labels), values(id, value) -> (id, total): the sum of the values of each node and all below it, from sums
    along the walk, without any pair of a node and its ancestor. Nodes without labels have no total."""
    each = values.groupBy("id").agg(F.sum("value").alias("value"))
    rows = labels.where("enter is not null").join(each, "id", "left").select("id", "root", "enter", "leave", F.coalesce("value", F.lit(0)).alias("value"))
    places = rows.select("root", "id", "value", F.explode(F.array(F.struct(F.col("enter").alias("at"), F.lit(False).alias("out")), F.struct(F.col("leave").alias("at"), F.lit(True).alias("out")))).alias("p"))
    places = places.select("root", "id", F.col("p.at").alias("at"), F.col("p.out").alias("out"), F.when(F.col("p.out"), 0).otherwise(F.col("value")).alias("counted"), "value")
    summed = running_sum(range_chunks(places, [F.col("root"), F.col("at"), F.col("out")]), ["root"], "chunk", [F.col("at"), F.col("out")], F.col("counted"), "sum")
    # what was counted up to the way out, less what was counted before the way in
    before = F.sum(F.when(F.col("out"), F.col("sum")).otherwise(F.col("value") - F.col("sum")))
    return summed.groupBy("id").agg(before.alias("total"))


def tree_order(nodes: DataFrame, order: Column) -> DataFrame:
    """nodes(id, parent_id, ...) -> (id, depth, position): the tree as a menu shows it, each node before its children and siblings by
    order, then id; position counts from 1 within a root's tree. Nodes on or below a cycle have nulls."""
    labels = tree_labels(nodes, order)
    # of enter places up to one's own, depth are still open and the rest have been left again
    return labels.select("id", "root", "depth", ((F.col("enter") + F.col("depth")) / 2 + 1).cast("long").alias("position"))


def _cyclic_ancestors(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes of components that hold a cycle, which is walked once: reach doubles per round."""
    pairs = nodes.where("parent_id <> id").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth"))
    pairs = cut_lineage(pairs)
    known = pairs.count()
    while known:
        upper = pairs.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        longer = pairs.join(upper, "ancestor").where("top <> id").select(
            "id", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")
        )
        pairs = cut_lineage(pairs.unionByName(longer).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        total = pairs.count()
        if total == known:
            break
        known = total
    return pairs


def tree_ancestors(nodes: DataFrame) -> DataFrame:
    """nodes(id, parent_id) -> (id, ancestor, depth): depth 1 is the parent. A missing parent ends
    the walk, a cycle is walked once. Pairs are made once, by a join of ranges of labels."""
    labels = tree_labels(nodes)
    pairs = ancestors_of(labels, labels)
    odd = labels.where("enter is null").select("id")
    if _has_rows(odd):
        pairs = pairs.unionByName(_cyclic_ancestors(nodes.join(odd, "id", "left_semi")))
    return pairs


def tree_subtree(nodes: DataFrame) -> DataFrame:
    """(id, member): every node with itself and all its descendants."""
    own = nodes.select("id", F.col("id").alias("member"))
    below = tree_ancestors(nodes).select(F.col("ancestor").alias("id"), F.col("id").alias("member"))
    return own.unionByName(below)


def tree_roots(nodes: DataFrame) -> DataFrame:
    """Nodes without a parent, or whose parent is missing."""
    ids = nodes.select(F.col("id").alias("parent_id"))
    return nodes.join(ids, "parent_id", "left_anti")


def repair_parent_cycles(nodes: DataFrame) -> DataFrame:
    """Members of a parent cycle lose their parent; other nodes are unchanged. Adds was_cyclic."""
    edges = nodes.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    members = cycle_members(edges).select(F.col("node").alias("id"), F.lit(True).alias("was_cyclic"))
    fixed = nodes.join(members, "id", "left").withColumn("was_cyclic", F.coalesce("was_cyclic", F.lit(False)))
    return fixed.withColumn("parent_id", F.when(~F.col("was_cyclic"), F.col("parent_id")))


# ------------------------------------------------------------------ general graphs

def _through_chains(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """single(id, needs, floor, distance), one row per id: level(id) = max(floor, level(needs) + distance).
    -> (rows that point to the end of their chain, rows whose chain runs into a cycle). Pointers double per round."""
    step = cut_lineage(single.select("id", "needs", "floor", "distance", F.lit(True).alias("open")))
    reach, nodes = 1, step.count()
    while reach <= nodes and _has_rows(step.where("open")):
        ahead = step.select(F.col("id").alias("needs"), F.col("needs").alias("_to"), F.col("floor").alias("_floor"), F.col("distance").alias("_more"), F.col("open").alias("_open"))
        grown = step.where("open").join(ahead, "needs", "left").select(
            "id", F.coalesce("_to", "needs").alias("needs"), F.greatest(F.col("floor"), F.col("_floor") + F.col("distance")).alias("floor"),
            (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance"), F.coalesce("_open", F.lit(False)).alias("open"),
        )
        step = cut_lineage(step.where("not open").unionByName(grown))
        reach *= 2
    return step.where("not open").drop("open"), step.where("open").drop("open")


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(id, needs) -> (id, level); level is null for members and dependents of a
    cycle and of ids that are no nodes. Level 0 needs nothing; any other node is one above the highest of its needs.

    Two moves take turns on one table of open needs. Peeling: a need whose level is known turns into a floor, and a node without other
    needs has its level. Contraction: a node with one open need is max(floor, level of the need + distance), and such rules
    compose, so pointers double along chains, those who need a node inside a chain need its end instead, and the chain's
    own levels are filled in last. Long chains thus take the logarithm of their length, and what costs rounds are nodes
    with several open needs behind one another; finished nodes leave the table."""
    rows = edges.select("id", "needs", F.lit(0).alias("floor"), F.lit(1).alias("distance")).distinct()
    levels = nodes.select("id").distinct().join(edges.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("level"))
    levels, chains = cut_lineage(levels), []
    while True:
        # peel: a known need becomes a row without a need, whose floor counts
        known = levels.select(F.col("id").alias("needs"), "level")
        met = rows.join(known, "needs", "left").select("id", F.when(F.col("level").isNull(), F.col("needs")).alias("needs"), F.greatest("floor", F.col("level") + F.col("distance")).alias("floor"), "distance")
        each = met.groupBy("id").agg(F.count("needs").alias("open"), F.max("floor").alias("floor"), F.min("needs").alias("needs"), F.max(F.when(F.col("needs").isNotNull(), F.col("distance"))).alias("distance"))
        each = cut_lineage(each)
        sizes = {row["open"]: row["count"] for row in each.groupBy(F.least("open", F.lit(2)).alias("open")).count().collect()}
        if not sizes.get(0) and not sizes.get(1):
            break
        moved = None
        if sizes.get(1):
            ended, _ = _through_chains(each.where("open = 1").select("id", "needs", "floor", "distance"))
            chains.append(ended)
            moved = ended.select(F.col("id").alias("needs"), F.col("needs").alias("_end"), F.col("floor").alias("_floor"), F.col("distance").alias("_more"))
        fresh = each.where("open = 0").select("id", F.col("floor").alias("level"))
        levels = cut_lineage(levels.unionByName(fresh)) if sizes.get(0) else levels
        if not sizes.get(2):
            break
        rows = met.join(each.where("open > 1").select("id"), "id", "left_semi")
        if moved is not None:
            # nodes on cycles and behind them keep a need that never gets a level
            rows = rows.join(moved, "needs", "left").select(
                "id", F.coalesce("_end", "needs").alias("needs"), F.greatest(F.col("floor"), F.col("_floor") + F.col("distance")).alias("floor"), (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance"),
            )
        rows = cut_lineage(rows.groupBy("id", "needs").agg(F.max("floor").alias("floor"), F.max("distance").alias("distance")))
    for ended in reversed(chains):
        inner = ended.join(levels.withColumnRenamed("id", "needs"), "needs").select("id", F.greatest(F.col("floor"), F.col("level") + F.col("distance")).alias("level"))
        levels = cut_lineage(levels.unionByName(inner))
    return nodes.select("id").distinct().join(levels, "id", "left")


#: Links in a block of reachable, about.
BLOCK_LINKS = 1_000_000


def reachable(links: DataFrame, seeds: DataFrame, block_links: int = BLOCK_LINKS) -> DataFrame:
    """links(src, dst), seeds(node) -> (node, steps): breadth-first.

    Links are laid out once in blocks by a hash of their source, visited nodes by the same hash of themselves. A round shuffles
    the newest nodes only, and reads the blocks that they are in, of links and of visited nodes; a small frontier so reads a small
    part. Blocks of visited nodes are rewritten as one from time to time."""
    spark = links.sparkSession
    folder = scratch_folder(spark, "reachable")
    block = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")

    def write(df: DataFrame, name: str, by: str) -> str:
        path = f"{folder}/{name}"
        df.withColumn("block", block(by)).repartition("block").write.partitionBy("block").parquet(path)
        return path

    links = cut_lineage(links.select("src", "dst").where("src is not null and dst is not null").distinct())
    blocks = max(1, math.ceil(links.count() / block_links))
    link_schema = f"src {dict(links.dtypes)['src']}, dst {dict(links.dtypes)['dst']}, block int"
    laid = write(links, "links", "src")
    fresh = seeds.select(F.col("node").cast(dict(links.dtypes)["dst"]).alias("node")).where("node is not null").distinct().withColumn("steps", F.lit(0))
    seen_schema = f"node {dict(links.dtypes)['dst']}, steps int, block int"
    visited = [write(fresh, "round=0", "node")]
    steps = 0
    while True:
        newest = spark.read.schema(seen_schema).parquet(visited[-1])
        places = [row["block"] for row in newest.select("block").distinct().collect()]  # at most one row a block
        if not places:
            break
        steps += 1
        ahead = spark.read.schema(link_schema).parquet(laid).where(F.col("block").isin(places))
        found = cut_lineage(ahead.join(newest.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
        wanted = [row["block"] for row in found.select(block("node").alias("block")).distinct().collect()]
        if not wanted:
            break
        known = None
        for path in visited:
            part = spark.read.schema(seen_schema).parquet(path).where(F.col("block").isin(wanted)).select("node")
            known = part if known is None else known.unionByName(part)
        visited.append(write(found.join(known, "node", "left_anti").withColumn("steps", F.lit(steps)), f"round={steps}", "node"))
        if len(visited) > 16:
            kept = visited.pop()
            visited = [write(_union(spark, visited, seen_schema), f"folded={steps}", "node"), kept]
    return _union(spark, visited, seen_schema)


def _union(spark, paths: list[str], schema: str) -> DataFrame:
    rows = None
    for path in paths:
        part = spark.read.schema(schema).parquet(path).select("node", "steps")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def cascade_drop(dropped: DataFrame, needs: DataFrame) -> DataFrame:
    """dropped(id), needs(id, needs_id) -> every id that is dropped or depends on a dropped one,
    with its round (0 for the first drops)."""
    links = needs.select(F.col("needs_id").alias("src"), F.col("id").alias("dst"))
    return reachable(links, dropped.select(F.col("id").alias("node"))).select(F.col("node").alias("id"), F.col("steps").alias("round"))


def chain_members(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """pointers(node, next) with at most one next per node, starts(node) -> every node on the chains
    from the starts. Marks and pointers double each round."""
    jump = cut_lineage(pointers.where("next is not null").select("node", "next"))
    marked = cut_lineage(starts.select("node").distinct())
    while _has_rows(jump):
        fresh = marked.join(jump, "node").select(F.col("next").alias("node")).join(marked, "node", "left_anti").distinct()
        fresh = cut_lineage(fresh)
        if not _has_rows(fresh):
            break
        marked = marked.unionByName(fresh)
        ahead = jump.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jump = cut_lineage(jump.join(ahead, "next").select("node", F.col("far").alias("next")))
    return marked
