"""Parent links to hierarchies (problem 5).

Peeling leaves exposes cycles: in a graph where every node has one parent,
what remains after taking off leaves again and again lies on a cycle. The
peeling goes by doubling: the image of the 2^k-th parent is the graph after 2^k
layers of leaves are gone, so the number of rounds is the logarithm of the
depth. Trees become Euler tours (down to a node, up from it), whose positions
come from parallel list ranking with random splitters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, is_empty
from .sweep import balanced_next, column

#: Lists of at most this many elements are ranked in one task.
LOCAL_RANK_ROWS = 1 << 18
#: One element in so many is a splitter.
SPLIT_EVERY = 16
#: Places of a tree's depth-first order that are one block of `descendants`.
PLACES = 1024


def parent_links(df: DataFrame, node: str = "g_id", parent: str = "parent") -> DataFrame:
    """(node, parent) with each node once and a null parent for roots.

    Null, 0 and -1 mean no parent; so does a parent that is not a node. Rows
    with a null node are ignored. A node listed with several parents keeps the
    smallest.
    """
    p = F.when(~F.col(parent).isin(0, -1), F.col(parent).cast("bigint"))
    rows = df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("bigint").alias("node")).agg(F.min(p).alias("p"))
    known = rows.select(F.col("node").alias("parent"))
    return rows.join(known, F.col("p") == F.col("parent"), "left").select("node", "parent")


def _climb(links: DataFrame, scratch: Scratch, with_paths: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Every node's root, depth (and path), and the nodes whose line of parents never ends.

    Returns (trees: node, root, depth[, path]; endless: node, cycle_id or None).
    """
    start = links.select(
        "node",
        F.col("parent").alias("up"),
        F.when(F.col("parent").isNull(), F.col("node")).alias("root"),
        F.col("parent").isNotNull().cast("bigint").alias("steps"),
        F.col("node").alias("low"),
        *([F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>")).alias("path")] if with_paths else []),
    )
    now = scratch.put(start)
    before = (-1, -1, -1)
    while True:
        open_ = now.where(F.col("up").isNotNull())
        # ids may be as large as a long: their sum is a decimal
        n, image, lows = open_.agg(F.count("*"), F.count_distinct("up"), F.sum(F.col("low").cast("decimal(20,0)"))).first()
        # Nothing reached a root in this round: along a finite line of parents
        # every depth occurs, so all open nodes are endless. An image that no
        # longer shrinks is the cycles; minima that no longer change are theirs.
        if n == 0 or (n, image, lows) == before:
            break
        before = (n, image, lows)
        far = now.select(
            F.col("node").alias("up"),
            F.col("up").alias("up2"),
            F.col("root").alias("root2"),
            F.col("steps").alias("steps2"),
            F.col("low").alias("low2"),
            *([F.col("path").alias("path2")] if with_paths else []),
        )
        # an open pointer to a finished node takes that node's root
        moved = open_.drop("root").join(far, "up").select(
            "node",
            F.col("up2").alias("up"),
            F.col("root2").alias("root"),
            (F.col("steps") + F.col("steps2")).alias("steps"),
            F.least("low", "low2").alias("low"),
            *([F.concat("path", "path2").alias("path")] if with_paths else []),
        )
        then = scratch.put(moved.unionByName(now.where(F.col("up").isNull())))
        scratch.drop(now)
        now = then
    trees = now.where(F.col("up").isNull()).select("node", "root", F.col("steps").alias("depth"), *(["path"] if with_paths else []))
    if n == 0:
        return trees, None
    endless = now.where(F.col("up").isNotNull()).select("node", "up")
    cycles = now.where(F.col("up").isNotNull()).select(F.col("node").alias("up"), F.col("low").alias("cycle_id"))
    return trees, endless.join(cycles, "up").select("node", "cycle_id")


def endless_nodes(df: DataFrame, node: str = "g_id", parent: str = "parent") -> DataFrame:
    """(node, cycle_<node>): nodes on a cycle of parent links or leading into one.

    cycle_<node> is the smallest node of that cycle. A node that is its own
    parent is a cycle of one. See `parent_links` for nulls and repeats.
    """
    spark = df.sparkSession
    _, endless = _climb(parent_links(df, node, parent), Scratch(spark, "cycles"))
    if endless is None:
        endless = spark.createDataFrame([], "node bigint, cycle_id bigint")
    return endless.select(F.col("node").alias(node), F.col("cycle_id").alias(f"cycle_{node}"))


def _euler_tour(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, side, next_node, next_side): side 0 goes down to a node, 1 up from it.

    `trees` has (node, parent) with a null parent for roots. Siblings follow in
    order of their ids.
    """
    kids = trees.where(F.col("parent").isNotNull())
    sibling = balanced_next(kids, ["parent"], ["node"], ["node"], scratch).select("node", F.col("next_node").alias("sibling"))
    eldest = kids.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("eldest"))
    one = trees.join(eldest, "node", "left").join(sibling, "node", "left")
    down = F.struct(
        F.lit(0).alias("side"),
        F.coalesce("eldest", "node").alias("next_node"),
        F.when(F.col("eldest").isNull(), 1).otherwise(0).alias("next_side"),
    )
    up = F.struct(
        F.lit(1).alias("side"),
        F.coalesce("sibling", "parent").alias("next_node"),
        F.when(F.col("sibling").isNotNull(), 0).when(F.col("parent").isNotNull(), 1).alias("next_side"),
    )
    return one.select("node", F.inline(F.array(down, up)))


def _rank_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pointer jumping over whole lists within one task."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    node, side, nxt, nxt_side, ahead, balance, tail = (column(t, c) for c in ("node", "side", "next_node", "next_side", "ahead", "balance", "tail"))
    last = np.asarray(t.column(2).is_null())
    ix = pd.MultiIndex.from_arrays([node, side])
    to = np.where(last, np.arange(len(node)), ix.get_indexer(pd.MultiIndex.from_arrays([nxt, nxt_side])))
    end_ahead, end_balance = np.where(last, ahead, 0), np.where(last, balance, 0)
    ahead, balance = np.where(last, 0, ahead), np.where(last, 0, balance)
    while True:
        far = to[to]
        ahead, balance = ahead + ahead[to], balance + balance[to]
        if (far == to).all():
            break
        to = far
    cols = [node, side, ahead + end_ahead[to], balance + end_balance[to], tail[to]]
    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["node", "side", "ahead", "balance", "tail"])


_RANKED = ["node", "side", "ahead", "balance", "tail"]


def rank_lists(elements: DataFrame, scratch: Scratch, local_rows: int = LOCAL_RANK_ROWS, level: int = 0) -> DataFrame:
    """(node, side, ahead, balance, tail) of linked lists.

    Elements are (node, side, next_node, next_side, ahead, balance, tail):
    `ahead` is the distance to the next element, `balance` the weight from this
    one up to it. An element without a next one has both up to the list's end,
    itself included, and the end's node as `tail`. In the result all have.
    """
    if elements.count() <= local_rows:
        return scratch.put(elements.coalesce(1).mapInArrow(_rank_locally, "node bigint, side int, ahead bigint, balance bigint, tail bigint"))
    # another choice on each level, or the splitters of one would all be splitters of the next
    is_split = lambda n, s: F.pmod(F.xxhash64(n, s, F.lit(level)), F.lit(SPLIT_EVERY)) == 0
    last = F.col("next_node").isNull()
    # Walk to the next splitter (or the end) from every element.
    now = scratch.put(elements.withColumns({"split": is_split("node", "side") & ~last, "stop": last | is_split("next_node", "next_side")}))
    while True:
        walking = now.where(~F.col("stop"))
        if is_empty(walking):
            break
        far = now.select(
            F.col("node").alias("next_node"), F.col("side").alias("next_side"), F.col("next_node").alias("n2"), F.col("next_side").alias("s2"),
            F.col("ahead").alias("a2"), F.col("balance").alias("b2"), F.col("stop").alias("stop2"),
        )
        # whoever has come to a list's end stays before it
        end = F.col("n2").isNull()
        moved = walking.join(far, ["next_node", "next_side"]).select(
            "node", "side", F.coalesce("n2", "next_node").alias("next_node"), F.coalesce("s2", "next_side").alias("next_side"),
            F.when(end, F.col("ahead")).otherwise(F.col("ahead") + F.col("a2")).alias("ahead"),
            F.when(end, F.col("balance")).otherwise(F.col("balance") + F.col("b2")).alias("balance"), "tail", "split", F.col("stop2").alias("stop"),
        )
        then = scratch.put(moved.unionByName(now.where("stop")))
        scratch.drop(now)
        now = then

    def onward(known: DataFrame) -> DataFrame:
        return known.select(F.col("node").alias("next_node"), F.col("side").alias("next_side"), F.col("ahead").alias("a2"), F.col("balance").alias("b2"), F.col("tail").alias("t2"))

    to_next = lambda rows, known: rows.join(onward(known), ["next_node", "next_side"], "left")
    added = ["node", "side", "next_node", "next_side", "split", (F.col("ahead") + F.coalesce("a2", F.lit(0))).alias("ahead"), (F.col("balance") + F.coalesce("b2", F.lit(0))).alias("balance"), F.col("t2").alias("tail")]
    ends = now.where(last)
    # Elements before an end are done; splitters among them are the ends of the shorter lists.
    near = scratch.put(to_next(now.where(~last), ends).select(*added))
    done = near.where("tail is not null")
    inner = near.where("split and tail is null").select("node", "side", "next_node", "next_side", "ahead", "balance", "tail")
    # Only splitters that others lead to go on, so each level has an eighth of the elements at most.
    aim = inner.select(F.col("next_node").alias("node"), F.col("next_side").alias("side")).distinct()
    none = lambda t: F.lit(None).cast(t)
    stops = done.where("split").join(aim, ["node", "side"], "left_semi").select("node", "side", none("bigint").alias("next_node"), none("int").alias("next_side"), "ahead", "balance", "tail")
    ranked = rank_lists(scratch.put(inner.unionByName(stops)), scratch, local_rows, level + 1)
    short = ranked.join(inner.select("node", "side"), ["node", "side"], "left_semi").select(*_RANKED)
    known = short.unionByName(done.where("split").select(*_RANKED))
    rest = to_next(near.where("not split and tail is null").drop("tail"), known).select(*added).select(*_RANKED)
    return scratch.put(ends.select(*_RANKED).unionByName(done.select(*_RANKED)).unionByName(short).unionByName(rest))


def hierarchy(df: DataFrame, node: str = "g_id", parent: str = "parent", local_rows: int = LOCAL_RANK_ROWS) -> DataFrame:
    """Each node of the trees with root, depth, entry, exit and descendant count.

    Positions count within the node's tree, from 0 at its root: u is an
    ancestor of v, or v itself, if they have one root and
    entry(u) <= entry(v) < exit(u). Endless nodes (see `endless_nodes`) belong
    to no tree and are left out. Lists of at most local_rows elements are
    ranked in one task; the result is the same whatever it is.
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.put(parent_links(df, node, parent))
    _, endless = _climb(links, scratch)
    trees = links if endless is None else links.join(endless, "node", "left_anti")
    tour = _euler_tour(trees, scratch)
    last = F.col("next_node").isNull()
    elements = tour.select(
        "node", "side", "next_node", "next_side",
        F.when(last, 0).otherwise(1).cast("bigint").alias("ahead"),
        F.when(F.col("side") == 0, 1).otherwise(-1).cast("bigint").alias("balance"),
        F.when(last, F.col("node")).alias("tail"),
    )
    ranked = rank_lists(scratch.put(elements), scratch, local_rows)
    one = ranked.groupBy("node").agg(
        F.max(F.when(F.col("side") == 0, F.col("ahead"))).alias("d"),
        F.max(F.when(F.col("side") == 1, F.col("ahead"))).alias("u"),
        F.max(F.when(F.col("side") == 0, -F.col("balance"))).alias("depth"),
        F.max("tail").alias("root"),
    )
    length = one.where("node = root").select("root", (F.col("d") + 1).alias("len"))
    return one.join(length, "root").select(
        F.col("node").alias(node),
        "root",
        "depth",
        (F.col("len") - 1 - F.col("d")).alias("entry"),
        (F.col("len") - F.col("u")).alias("exit"),
        F.expr("(d - u - 1) div 2").alias("n_descendants"),
    )


def _placed(tree: DataFrame, node: str, prefix: str) -> DataFrame:
    """Nodes with their place in depth-first order: a subtree is a stretch of it."""
    at = (F.col("entry") + F.col("depth")) / 2
    return tree.select(F.col("root").alias("_root"), F.col(node).alias(f"{prefix}node"), F.col("depth").alias(f"{prefix}depth"), at.cast("bigint").alias(f"{prefix}at"), F.col("n_descendants").alias(f"{prefix}n"))


def descendants(tree: DataFrame, of: DataFrame, node: str = "g_id") -> DataFrame:
    """(node, descendant, distance) of the nodes listed in `of`, from the intervals of `hierarchy`.

    A subtree is a stretch of the tree's depth-first order. Stretches are cut
    into blocks of places and meet the nodes of their blocks, so that neither
    one large tree nor one large subtree becomes one task's burden. Nodes that
    are not in the tree have none.
    """
    a = _placed(tree.join(of.select(node).distinct(), node, "left_semi"), node, "a_").where("a_n > 0")
    a = a.withColumn("_block", F.explode(F.expr(f"sequence((a_at + 1) div {PLACES}, (a_at + a_n) div {PLACES})")))
    b = _placed(tree, node, "b_").withColumn("_block", F.expr(f"b_at div {PLACES}"))
    pairs = a.join(b, ["_root", "_block"]).where("b_at > a_at and b_at <= a_at + a_n")
    return pairs.select(F.col("a_node").alias(node), F.col("b_node").alias("descendant"), (F.col("b_depth") - F.col("a_depth")).alias("distance"))


def ancestors(tree: DataFrame, of: DataFrame, node: str = "g_id") -> DataFrame:
    """(node, ancestor, distance) of the nodes listed in `of`, from the intervals of `hierarchy`.

    Each subtree's stretch is cut into blocks whose width is a power of two and
    which begin at a multiple of it, at most two of a width. A node lies in one
    block of each width, so it meets each ancestor once and nothing else: work
    grows with the tree's size times its logarithm, and with the result.
    """
    a = _placed(tree, node, "a_").where("a_n > 0")
    a = a.withColumn("_level", F.explode(F.expr("sequence(0, cast(floor(log2(a_n)) as int))")))
    # the stretch [at + 1, at + n + 1) in units of the width, from inside
    a = a.withColumns({"_lo": F.expr("shiftright(a_at + shiftleft(1L, _level), _level)"), "_hi": F.expr("shiftright(a_at + a_n + 1, _level)")}).where("_lo < _hi")
    a = a.withColumn("_block", F.explode(F.expr("filter(array(if(_lo % 2 = 1, _lo, null), if(_hi % 2 = 1, _hi - 1, null)), x -> x is not null)")))
    b = _placed(tree.join(of.select(node).distinct(), node, "left_semi"), node, "b_").where("b_at > 0")
    b = b.withColumn("_level", F.explode(F.expr("sequence(0, cast(floor(log2(b_at)) as int))"))).withColumn("_block", F.expr("shiftright(b_at, _level)"))
    pairs = a.join(b, ["_root", "_level", "_block"])
    return pairs.select(F.col("b_node").alias(node), F.col("a_node").alias("ancestor"), (F.col("b_depth") - F.col("a_depth")).alias("distance"))


def paths(df: DataFrame, node: str = "g_id", parent: str = "parent") -> DataFrame:
    """(node, root, depth, path) of each node of the trees; path leads from the root to the node.

    The result holds depth + 1 ids a node; for trees so deep that this is too
    much, the intervals of `hierarchy` tell ancestors and descendants.
    """
    trees, _ = _climb(parent_links(df, node, parent), Scratch(df.sparkSession, "paths"), with_paths=True)
    return trees.select(F.col("node").alias(node), "root", "depth", F.concat(F.reverse("path"), F.array("node")).alias("path"))
