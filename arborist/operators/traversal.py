"""Walks over many code graphs at once: one hop of every walk is one join.

All take edges (graph_id, src, tgt, ...) and keep ``graph_id`` in every key, so graphs never mix and a hop shuffles by graph
and node. What a hop finds is written and read again, which ends the lineage; each node is reached once a
walk, so a walk holds at most the nodes of its graph. Edges with a null end lead nowhere; an empty table of starts gives no rows.
Graphs that fit a task are walked whole by one (``localgraphs``), with the same result; the joins are for larger ones.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborist.storage import materialise

from . import localgraphs as L

#: Hops that a walk up or down takes, and that a footprint takes, and nodes that it meets.
MAX_HOPS, FOOTPRINT_HOPS, FOOTPRINT_NODES = 12, 10, 500
#: A label is shared that is in so many of a graph's footprints, in percent and in number.
SHARED_PERCENT, LEAST_FOOTPRINTS = 50, 3


class Walks(NamedTuple):
    """What many roots reach, 64 roots of a graph to a row: ``bits`` has one bit a root.

    blocks: graph_id, block, roots (at most 64, the first has the lowest bit). steps: graph_id, node, next. found: graph_id, block, node, depth, bits of the
    roots that reach the node at that depth and no sooner. reached: graph_id, block, node, bits of all that reach it.
    """

    blocks: DataFrame
    steps: DataFrame
    found: DataFrame
    reached: DataFrame


def walks(starts: DataFrame, edges: DataFrame, hops: int) -> Walks:
    """All that each root (graph_id, root) reaches within ``hops``, in blocks of 64 roots."""
    # written once, since every hop reads them
    step = materialise(edges.select("graph_id", F.col("src").alias("node"), F.col("tgt").alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct())
    at = F.row_number().over(Window.partitionBy("graph_id").orderBy("root")) - 1
    roots = materialise(starts.select("graph_id", "root").where("root IS NOT NULL").distinct().withColumn("at", at).select("graph_id", "root", F.expr("at DIV 64 AS block"), F.expr("CAST(at % 64 AS INT) AS bit")))
    blocks = roots.groupBy("graph_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "root"))), lambda r: r["root"]).alias("roots"))
    key = ["graph_id", "block", "node"]
    # seen: the bits up to this hop; bits: those that it added
    bit = F.expr("shiftleft(1L, bit)")
    state = materialise(roots.select("graph_id", "block", F.col("root").alias("node"), bit.alias("seen"), bit.alias("bits")))
    found = state.where("bits <> 0").select(*key, F.lit(0).alias("depth"), "bits")
    frontier, none = found, F.lit(0).cast("long")
    for depth in range(1, hops + 1):
        met = frontier.join(step, ["graph_id", "node"]).groupBy("graph_id", "block", F.col("next").alias("node")).agg(F.bit_or("bits").alias("bits"))
        both = met.select(*key, none.alias("seen"), "bits").unionByName(state.select(*key, "seen", none.alias("bits")))
        both = both.groupBy(*key).agg(F.bit_or("seen").alias("old"), F.bit_or("bits").alias("met"))
        state = materialise(both.select(*key, F.expr("old | met AS seen"), F.expr("met & ~old AS bits")))
        frontier = state.where("bits <> 0").select(*key, F.lit(depth).alias("depth"), "bits")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return Walks(blocks, step, found, state.select(*key, F.col("seen").alias("bits")))


def _first_with(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Each bit of a group's rows stays with the first row that has it."""
    before = F.bit_or("bits").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).withColumn("bits", F.expr("bits & ~before")).where("bits <> 0").drop("before")


def with_parents(w: Walks) -> DataFrame:
    """graph_id, block, node, depth, parent, bits: the smallest node one hop nearer to each root; the root has none."""
    nearer = w.found.join(w.steps, ["graph_id", "node"]).select("graph_id", "block", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("bits").alias("there"))
    key = ["graph_id", "block", "node", "depth"]
    via = w.found.where("depth > 0").join(nearer, key).select(*key, "parent", F.expr("bits & there AS bits")).where("bits <> 0")
    return w.found.where("depth = 0").select(*key, F.lit(None).cast("string").alias("parent"), "bits").unionByName(_first_with(via, key, "parent"))


def by_root(rows: DataFrame, w: Walks) -> DataFrame:
    """Rows of blocks as rows of roots: ``root`` in place of ``block`` and ``bits``."""
    own = F.filter("roots", lambda r, i: F.call_function("getbit", F.col("bits"), i) == 1)
    return rows.join(w.blocks, ["graph_id", "block"]).withColumn("root", F.explode(own)).drop("block", "bits", "roots")


def _whole_or_joined(local, joined, starts: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``local`` of the graphs that a task takes whole, ``joined`` (starts, edges, labels) of the others."""
    texts = [(starts, "root"), (edges, "src"), (edges, "tgt"), *([] if labels is None else [(labels, "node"), (labels, "label")])]
    if not L.by_names(*texts):
        return joined(starts, edges, labels)
    small, large = L.split(materialise(L.rows_of(edges, starts, labels)), L.ROWS)
    out = local(small)
    if large is None:
        return out
    of = lambda kind, a, b: large.where(F.col("kind") == kind).select("graph_id", F.col("a").alias(a), F.col("b").alias(b))
    return out.unionByName(joined(of(L.ROOT, "root", "b").drop("b"), of(L.STEP, "src", "tgt"), None if labels is None else of(L.LABEL, "node", "label")))


def reach(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """graph_id, root, node, depth, parent: all that each root reaches within ``hops``, at its least depth.

    ``starts`` are (graph_id, root). The parent is the smallest node one hop nearer; the root has none. Roots walk in blocks; only the result has a
    row for each root and node.
    """

    def joined(starts, edges, _):
        w = walks(starts, edges, hops)
        return by_root(with_parents(w), w).select("graph_id", "root", "node", "depth", "parent")

    return _whole_or_joined(lambda rows: L.tree(rows, hops), joined, starts, edges)


def budgeted_reach(starts: DataFrame, edges: DataFrame, hops: int = FOOTPRINT_HOPS, budget: int = FOOTPRINT_NODES) -> DataFrame:
    """graph_id, root, node, depth, pos: what each root (graph_id, root) visits breadth first until ``budget`` nodes have been met.

    edges: graph_id, src, tgt, ord. A node's edges are met in the order of ``ord``, nulls first, then of the target; a node is met once, by the first
    edge to it. The nodes are visited in the order in which they were met (``pos``, from 0), and none is as soon as ``budget`` nodes or more have been
    met, so the last one visited may still meet any number. At ``hops`` a node is visited, but meets none.

    A hop is one join and one grouping, as in ``reach``; the order within it is a window over what a root has met anew. Roots that have used up their budget
    leave the frontier, so it holds less than ``budget`` nodes a root.
    """
    step = materialise(edges.where("src IS NOT NULL AND tgt IS NOT NULL").groupBy("graph_id", F.col("src").alias("node"), F.col("tgt").alias("next")).agg(F.min(F.struct("ord")).alias("o")))
    walk = ["graph_id", "root"]
    # known: how many nodes the root had met when the hop began
    frontier = materialise(starts.where("root IS NOT NULL").select(*walk, F.col("root").alias("node"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("known")).distinct().where(F.col("known") < budget))
    met, visited = frontier.select(*walk, "node"), None
    for depth in range(hops + 1):
        if depth == hops:
            polled = frontier
        else:
            found = frontier.join(step, ["graph_id", "node"]).groupBy(*walk, F.col("next").alias("node")).agg(F.min(F.struct("pos", "o")).alias("via"), F.max("known").alias("known"))
            found = found.join(met, [*walk, "node"], "left_anti").withColumn("by", F.col("via.pos"))
            key = Window.partitionBy(*walk)
            # before: what nodes visited earlier in this hop have met
            ranked = found.withColumn("before", F.rank().over(key.orderBy("by")) - 1).withColumn("at", F.row_number().over(key.orderBy("by", "via.o", "node")) - 1)
            ranked = materialise(ranked.where(F.col("known") + F.col("before") < budget).select(*walk, "node", "by", (F.col("known") + F.col("at")).alias("pos"), "known"))
            of_parent = ranked.groupBy(*walk, F.col("by").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
            earlier = F.coalesce(F.sum("n").over(key.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            polled = frontier.join(of_parent, [*walk, "pos"], "left").withColumn("earlier", earlier).where(F.col("known") + F.col("earlier") < budget)
        polled = polled.select(*walk, "node", F.lit(depth).alias("depth"), "pos")
        visited = polled if visited is None else visited.unionByName(polled)
        if depth == hops or ranked.isEmpty():
            break
        met = met.unionByName(ranked.select(*walk, "node"))
        total = ranked.groupBy(*walk).agg((F.max("known") + F.count(F.lit(1))).alias("total")).where(F.col("total") < budget)
        frontier = materialise(ranked.join(total, walk).select(*walk, "node", "pos", F.col("total").alias("known")))
    return visited


def upstream_root(starts: DataFrame, calls: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """graph_id, start, root, depth: one caller up a hop, the first by ``ord`` then id, until none or one met before."""
    first = F.row_number().over(Window.partitionBy("graph_id", "tgt").orderBy("ord", "src"))
    up = materialise(calls.where("src IS NOT NULL AND tgt IS NOT NULL").withColumn("rn", first).where("rn = 1").select("graph_id", F.col("tgt").alias("root"), F.col("src").alias("next")))
    walk = materialise(starts.select("graph_id", F.col("id").alias("start"), F.col("id").alias("root"), F.array("id").alias("path")).where("start IS NOT NULL").distinct())
    ended = []
    for hop in range(hops):
        going = walk.join(up, ["graph_id", "root"], "left").withColumn("over", F.expr("next IS NULL OR array_contains(path, next)"))
        going = materialise(going)
        ended.append(going.where("over").select("graph_id", "start", "root", F.lit(hop).alias("depth")))
        walk = going.where("NOT over").select("graph_id", "start", F.col("next").alias("root"), F.array_append("path", F.col("next")).alias("path"))
        if walk.isEmpty():
            break
    out = walk.select("graph_id", "start", "root", (F.size("path") - 1).alias("depth"))
    for part in ended:
        out = out.unionByName(part)
    return out


def path_to(tree: DataFrame, goals: DataFrame) -> DataFrame:
    """graph_id, root, goal, depth, node: the steps back from each goal (graph_id, root, node) along the parents of a ``reach``."""
    at = goals.select("graph_id", "root", F.col("node").alias("goal"), "node").join(tree, ["graph_id", "root", "node"])
    at = materialise(at.select("graph_id", "root", "goal", "depth", "node", "parent"))
    out = at
    while not (at := at.where("parent IS NOT NULL")).isEmpty():
        back = at.select("graph_id", "root", "goal", F.col("parent").alias("node")).join(tree, ["graph_id", "root", "node"])
        at = materialise(back.select("graph_id", "root", "goal", "depth", "node", "parent"))
        out = out.unionByName(at)
    return out.drop("parent")


def default_path(tree: DataFrame) -> DataFrame:
    """graph_id, root, depth, node: of each root of a ``reach`` the way that takes the smallest child at every step, down to a leaf."""
    child = materialise(tree.where("parent IS NOT NULL").groupBy("graph_id", "root", F.col("parent").alias("node")).agg(F.min("node").alias("next")))
    at = materialise(tree.where("depth = 0").select("graph_id", "root", "depth", "node"))
    out = at
    while not at.isEmpty():
        at = materialise(at.join(child, ["graph_id", "root", "node"]).select("graph_id", "root", (F.col("depth") + 1).alias("depth"), F.col("next").alias("node")))
        out = out.unionByName(at)
    return out


def default_paths(starts: DataFrame, edges: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """The ``default_path`` of the ``reach`` from ``starts``, walked in blocks of roots without a row for each root and node."""
    return _whole_or_joined(lambda rows: L.first_children(rows, hops), lambda starts, edges, _: _joined_paths(starts, edges, hops), starts, edges)


def _joined_paths(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    w = walks(starts, edges, hops)
    tree = materialise(with_parents(w))
    at = tree.where("depth = 0").select("graph_id", "block", "depth", "node", "bits")
    out = at
    for depth in range(1, hops + 1):
        child = tree.where(F.col("depth") == depth).select("graph_id", "block", F.col("parent").alias("node"), F.col("node").alias("next"), F.col("bits").alias("there"))
        on = at.join(child, ["graph_id", "block", "node"]).select("graph_id", "block", "node", "next", F.expr("bits & there AS bits")).where("bits <> 0")
        on = _first_with(on, ["graph_id", "block", "node"], "next").groupBy("graph_id", "block", F.col("next").alias("node")).agg(F.bit_or("bits").alias("bits"))
        at = materialise(on.select("graph_id", "block", F.lit(depth).alias("depth"), "node", "bits"))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return by_root(out, w).select("graph_id", "root", "depth", "node")


def footprint_labels(endpoints: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = FOOTPRINT_HOPS, budget: int | None = None) -> DataFrame:
    """graph_id, endpoint, label: files, and ``DB:`` tables, that each endpoint (graph_id, root) reaches, or visits within a ``budget``."""
    label = F.when(F.col("type") == "DB_TABLE", F.concat(F.lit("DB:"), "name")).otherwise(F.col("file_path"))
    named = nodes.select("graph_id", F.col("id").alias("node"), label.alias("label")).where("label IS NOT NULL")
    if budget is not None:
        found = budgeted_reach(endpoints, edges, hops, budget).join(named, ["graph_id", "node"])
        return found.select("graph_id", F.col("root").alias("endpoint"), "label").distinct()

    def joined(starts, edges, named):
        w = walks(starts, edges, hops)
        found = w.reached.join(named, ["graph_id", "node"]).groupBy("graph_id", "block", "label").agg(F.bit_or("bits").alias("bits"))
        return by_root(found, w).select("graph_id", F.col("root").alias("endpoint"), "label")

    return _whole_or_joined(lambda rows: L.reached_labels(rows, hops), joined, endpoints, edges, named)


def shared_labels(labels: DataFrame, percent: int = SHARED_PERCENT, least: int = LEAST_FOOTPRINTS) -> DataFrame:
    """graph_id, label, n of labels in at least ``percent`` of the graph's footprints and in ``least``."""
    total = labels.groupBy("graph_id").agg(F.count_distinct("endpoint").alias("total"))
    n = labels.groupBy("graph_id", "label").agg(F.count_distinct("endpoint").alias("n"))
    return n.join(total, "graph_id").where(F.col("n") >= F.greatest(F.ceil(F.col("total") * percent / 100), F.lit(least))).select("graph_id", "label", "n")
