"""Walks and clusters of small graphs, many at once in one task, by numbers and bits.

A graph of at most ``ROWS`` rows is taken whole by one task, together with others up to about ``BUCKET`` rows: one shuffle in all, where hop by hop
each would be two. Larger graphs are left to the joins of ``traversal`` and ``modules``, which give the same rows. A node is a number, in the order of graph
and then of the bytes of its name; the roots of a graph walk 64 at a time, one bit each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arborist.storage import materialise

#: Rows of a graph that one task takes whole, at most; rows of several graphs that a task takes together, about; rows of labels of a graph that are clustered in one task.
ROWS, BUCKET, LABEL_ROWS = 200_000, 20_000, 4_000
#: Words of 64 bits that become rows at once.
WORDS = 8192
#: Kinds of rows: a step from a to b, a root a, a node a with a label b.
STEP, ROOT, LABEL = 0, 1, 2


def rows_of(steps: DataFrame, roots: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """graph_id, kind, a, b: steps (graph_id, src, tgt), roots (graph_id, root) and labels (graph_id, node, label), without those that lack an end."""
    shape = lambda df, kind, a, b: df.select("graph_id", F.lit(kind).cast("tinyint").alias("kind"), F.col(a).alias("a"), (F.lit(None).cast("string") if b is None else F.col(b)).alias("b"))
    out = shape(steps, STEP, "src", "tgt").where("b IS NOT NULL").unionByName(shape(roots, ROOT, "root", None))
    if labels is not None:
        out = out.unionByName(shape(labels, LABEL, "node", "label").where("b IS NOT NULL"))
    return out.where("graph_id IS NOT NULL AND a IS NOT NULL")


def split(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of graphs of at most ``most`` rows, with their ``bucket``, and those of larger graphs, None where there is none."""
    sizes = rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    large = None
    if (largest or 0) > most:
        over = materialise(sizes.where(F.col("n") > most).select("graph_id"))
        rows, large = rows.join(over, "graph_id", "left_anti"), rows.join(over, "graph_id", "left_semi")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("graph_id"), F.lit(max(1, (total or 0) // BUCKET)))), large


def by_names(*columns: tuple[DataFrame, str]) -> bool:
    """Whether all these columns are text, whose order the numbers of nodes follow."""
    return all(isinstance(df.schema[name].dataType, StringType) for df, name in columns)


class Bucket:
    """Graphs of one task as numbers; see the module."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        whole = lambda column: pa.concat_arrays(column.chunks)
        graph = whole(t["graph_id"]).dictionary_encode()
        names = pa.concat_arrays([*t["a"].chunks, *t["b"].chunks]).dictionary_encode()
        order = pc.sort_indices(names.dictionary).to_numpy()
        self.n = max(1, len(order))
        rank = np.zeros(self.n + 1, np.int64)  # the last is that of null
        rank[order] = np.arange(len(order))
        at = rank[pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)]
        g, kind = graph.indices.to_numpy().astype(np.int64), whole(t["kind"]).to_numpy()
        self.graphs, self.sorted_names = graph.dictionary, names.dictionary.take(pa.array(order))
        a, b = g * self.n + at[: len(g)], g * self.n + at[len(g) :]
        step, root, label = (kind == k for k in (STEP, ROOT, LABEL))
        self.nodes = np.unique(np.concatenate([a[step], b[step], a[root]]))
        self.graph = self.nodes // self.n
        number = lambda x: np.searchsorted(self.nodes, x)
        # by target, then by source, each pair once
        size = max(1, len(self.nodes))
        pairs = np.unique(number(b[step]) * size + number(a[step]))
        self.src, self.tgt = pairs % size, pairs // size
        self.roots = np.unique(number(a[root]))
        self.first = np.searchsorted(self.graph[self.roots], np.arange(len(self.graphs) + 1))
        known = label & np.isin(a, self.nodes)
        self.labels, of = np.unique(b[known], return_inverse=True)
        by = np.argsort(of, kind="stable")
        self.label_at, self.labelled = np.searchsorted(of[by], np.arange(len(self.labels))), number(a[known])[by]

    def names(self, nodes: np.ndarray, keys: np.ndarray | None = None) -> pa.Array:
        return self.sorted_names.take(pa.array((self.nodes if keys is None else keys)[nodes] % self.n))

    def graph_ids(self, graphs: np.ndarray) -> pa.Array:
        return self.graphs.take(pa.array(graphs))

    def blocks(self) -> Iterator[Block]:
        at = np.arange(len(self.roots)) - self.first[self.graph[self.roots]]
        for k in range(int(at.max()) // 64 + 1 if len(at) else 0):
            yield Block(self, k, np.flatnonzero(at // 64 == k))


class Block:
    """The walks of at most 64 roots of each graph. ``own`` are their places among all roots, ``seen`` each node's bits of the roots that reach it."""

    def __init__(self, bucket: Bucket, k: int, own: np.ndarray):
        self.bucket, self.k, self.own = bucket, k, own
        self.start = bucket.roots[own]
        of = bucket.graph[self.start]
        self.bits = np.left_shift(np.uint64(1), (own - bucket.first[of] - 64 * k).astype(np.uint64))
        self.seen = np.zeros(len(bucket.nodes), np.uint64)
        self.seen[self.start] = self.bits
        here = np.zeros(len(bucket.graphs), bool)
        here[of] = True
        self.edges = np.flatnonzero(here[bucket.graph[bucket.src]])

    def hops(self, hops: int, parents: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """depth, sources, targets and bits of the roots that reach the target by that step, at that depth and no sooner; of several sources the smallest."""
        src, tgt = self.bucket.src[self.edges], self.bucket.tgt[self.edges]
        fresh = self.seen.copy()
        for depth in range(1, hops + 1):
            bits = fresh[src] & ~self.seen[tgt]
            live = np.flatnonzero(bits)
            if not len(live):
                return
            s, t, bits = src[live], tgt[live], bits[live]
            begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            fresh = np.zeros_like(self.seen)
            fresh[t[begins]] = np.bitwise_or.reduceat(bits, begins)
            self.seen |= fresh
            if parents:
                bits = bits & ~_before(bits, begins)
                left = np.flatnonzero(bits)
                yield depth, s[left], t[left], bits[left]

    def rows(self, bits: np.ndarray, graphs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place among the words, place among all roots) of each bit of the words."""
        for i in range(0, len(bits), WORDS):
            word, bit = np.nonzero(np.unpackbits(bits[i : i + WORDS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            word += i
            yield word, self.bucket.first[graphs[word]] + 64 * self.k + bit


def _before(bits: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The bits of all earlier words of the same run."""
    at = np.arange(len(bits)) - np.repeat(begins, np.diff(np.append(begins, len(bits))))
    out, k = np.where(at > 0, np.roll(bits, 1), np.uint64(0)), 1
    while k <= at.max():
        later = np.flatnonzero(at >= k)
        before = out.copy()
        before[later] |= out[later - k]
        out, k = before, 2 * k
    return out


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _tree(hops: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bucket(batches)

        def made(roots, nodes, depth, parents):
            return _batch(graph_id=b.graph_ids(b.graph[nodes]), root=b.names(b.roots[roots]), node=b.names(nodes), depth=pa.array(np.full(len(nodes), depth, np.int32)), parent=pa.nulls(len(nodes), pa.string()) if parents is None else b.names(parents))

        for block in b.blocks():
            yield made(block.own, block.start, 0, None)
            for depth, s, t, bits in block.hops(hops):
                for word, root in block.rows(bits, b.graph[t]):
                    yield made(root, t[word], depth, s[word])

    return run


def _first_children(hops: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bucket(batches)

        def made(roots, nodes, depth):
            return _batch(graph_id=b.graph_ids(b.graph[nodes]), root=b.names(b.roots[roots]), depth=pa.array(np.full(len(nodes), depth, np.int32)), node=b.names(nodes))

        for block in b.blocks():
            yield made(block.own, block.start, 0)
            # the roots whose way stands at a node
            standing = np.zeros(len(b.nodes), np.uint64)
            standing[block.start] = block.bits
            for depth, s, t, bits in block.hops(hops):
                bits = bits & standing[s]
                following = np.full(len(b.roots), len(b.nodes))
                for word, root in block.rows(bits, b.graph[t]):
                    np.minimum.at(following, root, t[word])
                gone = block.own[following[block.own] < len(b.nodes)]
                if not len(gone):
                    break
                standing = np.zeros(len(b.nodes), np.uint64)
                np.bitwise_or.at(standing, following[gone], block.bits[np.searchsorted(block.own, gone)])
                yield made(gone, following[gone], depth)

    return run


def _reached_labels(hops: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bucket(batches)
        of = b.labels // b.n
        for block in b.blocks() if len(b.labels) else ():
            for _ in block.hops(hops, parents=False):
                pass
            bits = np.bitwise_or.reduceat(block.seen[b.labelled], b.label_at)
            for word, root in block.rows(bits, of):
                yield _batch(graph_id=b.graph_ids(of[word]), endpoint=b.names(b.roots[root]), label=b.names(word, b.labels))

    return run


def _clusters(percent: int, least_common: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        graph, endpoint, label = (pa.concat_arrays(t[c].chunks).dictionary_encode() for c in ("graph_id", "endpoint", "label"))
        by_name = pc.sort_indices(endpoint.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        g, e, x = graph.indices.to_numpy(), rank[endpoint.indices.to_numpy()], pc.fill_null(label.indices, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(g, kind="stable")
        ends = np.searchsorted(g[order], np.arange(len(graph.dictionary) + 1))
        of_graph, of_endpoint, of_cluster, of_rare, n_rare = [], [], [], [], []
        for k in range(len(graph.dictionary)):
            rows = order[ends[k] : ends[k + 1]]
            own, i = np.unique(e[rows], return_inverse=True)
            some = x[rows] >= 0
            names, j = np.unique(x[rows][some], return_inverse=True)
            held = np.zeros((len(own), len(names)), np.float32)
            held[i[some], j] = 1
            n = held.sum(0)
            few = np.flatnonzero(n < max(-(-len(own) * percent // 100), least_common))
            held = held[:, few]
            a, b = np.nonzero(held @ held.T >= least)
            at = np.arange(len(own))
            while True:
                near = at.copy()
                np.minimum.at(near, a, at[b])
                near = near[near]
                if (near == at).all():
                    break
                at = near
            of_graph.append(np.full(len(own), k))
            of_endpoint.append(own)
            of_cluster.append(own[at])
            # the labels that an endpoint is told by, with null where it has that
            bare = np.zeros(len(own), bool)
            bare[i[~some]] = True
            with_null = np.column_stack([held > 0, bare])
            of_rare.append(np.append(names[few], -1)[np.nonzero(with_null)[1]])
            n_rare.append(with_null.sum(1))
        rare = np.concatenate(of_rare)
        rare = label.dictionary.take(pa.array(rare, pa.int64(), mask=rare < 0))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.concatenate(n_rare)]), pa.int32()), rare)
        names = endpoint.dictionary.take(pa.array(by_name))
        yield _batch(graph_id=graph.dictionary.take(pa.array(np.concatenate(of_graph))), endpoint=names.take(pa.array(np.concatenate(of_endpoint))), cluster=names.take(pa.array(np.concatenate(of_cluster))), rare=lists)

    return run


def _grouped(rows: DataFrame, run, columns: str) -> DataFrame:
    return rows.groupBy("bucket").applyInArrow(run, f"graph_id {rows.schema['graph_id'].dataType.simpleString()}, {columns}")


def tree(rows: DataFrame, hops: int) -> DataFrame:
    """``traversal.reach`` of bucketed rows."""
    return _grouped(rows, _tree(hops), "root string, node string, depth int, parent string")


def first_children(rows: DataFrame, hops: int) -> DataFrame:
    """``traversal.default_paths`` of bucketed rows."""
    return _grouped(rows, _first_children(hops), "root string, depth int, node string")


def reached_labels(rows: DataFrame, hops: int) -> DataFrame:
    """``traversal.footprint_labels`` of bucketed rows."""
    return _grouped(rows, _reached_labels(hops), "endpoint string, label string")


def clusters(labels: DataFrame, percent: int, least_common: int, least: int) -> DataFrame:
    """``modules.told_clusters`` of bucketed labels (graph_id, endpoint, label)."""
    return _grouped(labels, _clusters(percent, least_common, least), "endpoint string, cluster string, rare array<string>")
