"""Graphs that a task takes whole give what the joins give, in a few jobs."""

import random

import pytest

from arborist.operators import localgraphs as L
from arborist.operators import modules as M
from arborist.operators import traversal as T

EDGES = "graph_id long, src string, tgt string"


def drawn(spark, seed=5):
    """Three graphs with ids in common, one with more than 64 roots; ends that are null, names beyond ASCII, nodes with two labels and none."""
    draw = random.Random(seed)
    name = lambda g: draw.choice(["n", "é", "N", "\U0001f600", "￮"]) + str(draw.randrange(30 if g < 3 else 90))
    edges = [(g, name(g), name(g)) for g in (1, 2, 3) for _ in range(80 if g < 3 else 300)] + [(1, None, "n1"), (1, "n1", None), (None, "n1", "n2")]
    roots = [(g, name(g)) for g in (1, 2, 3) for _ in range(15 if g < 3 else 200)] + [(1, "absent"), (2, None), (None, "n1")]
    labels = [(g, a, f"l{draw.randrange(9)}") for g, a, _ in edges for _ in range(draw.randrange(3))] + [(1, "n1", None), (1, None, "l1")]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, "graph_id long, root string"), spark.createDataFrame(labels, "graph_id long, node string, label string")


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_whole_graphs_give_what_joins_give(spark, monkeypatch):
    edges, roots, labels = drawn(spark)
    nodes = labels.selectExpr("graph_id", "node AS id", "'FILE' AS type", "'x' AS name", "label AS file_path")
    runs = {"reach": lambda: T.reach(roots, edges, 4), "paths": lambda: T.default_paths(roots, edges, 6), "labels": lambda: T.footprint_labels(roots, nodes, edges, 2)}
    for name, run in runs.items():
        monkeypatch.setattr(L, "ROWS", 200_000)
        whole = rows(run())
        monkeypatch.setattr(L, "ROWS", 0)
        assert whole == rows(run()) and whole, name
    # the larger graph by joins, the others whole, in a bucket each
    monkeypatch.setattr(L, "ROWS", 200)
    monkeypatch.setattr(L, "BUCKET", 50)
    assert rows(runs["labels"]()) == whole


def test_whole_graphs_are_clustered_as_by_joins(spark, monkeypatch):
    draw = random.Random(7)
    held = [(g, f"e{draw.randrange(40)}", f"l{draw.randrange(60)}") for g in (1, 2, 3) for _ in range(110 if g < 3 else 60)]
    held += [(g, f"e{i}", "all") for g in (1, 2) for i in range(25)] + [(1, "e1", None), (1, "alone", None), (1, None, "l1"), (None, "e1", "l1"), (None, "e2", "l1")]
    labels = spark.createDataFrame(held, "graph_id long, endpoint string, label string")
    whole = rows(M.clusters(labels))
    assert len({r for r in whole if "alone" in r}) == 1
    for most in (100, 0):
        monkeypatch.setattr(L, "LABEL_ROWS", most)
        assert rows(M.clusters(labels)) == whole
    assert M.clusters(labels.limit(0)).isEmpty()
    # modules by the labels that come with the clusters, by joins and whole, are those by all labels
    nodes = spark.createDataFrame([(g, f"e{i}", f"GET:/api/{'abc'[i % 3]}/v1") for g in (1, 2, 3) for i in range(40)], "graph_id long, id string, name string")
    want = rows(M.candidate_modules(M.clusters(labels), labels, nodes))
    for most in (0, 4000):
        monkeypatch.setattr(L, "LABEL_ROWS", most)
        assert rows(M.candidate_modules(M.told_clusters(labels), labels, nodes)) == want and want


@pytest.mark.parametrize("name", ["reach", "default_paths"])
def test_a_walk_takes_few_jobs_whatever_its_length(spark, name):
    """A hop of joins is several jobs; a chain of twelve took more than forty."""
    edges = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)], EDGES)
    starts = spark.createDataFrame([(1, "n00")], "graph_id long, root string")
    sc = spark.sparkContext
    sc.setJobGroup(f"jobs of {name}", "")
    try:
        assert len(getattr(T, name)(starts, edges, 12).collect()) == 13
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup(f"jobs of {name}")) <= 12


def test_clusters_take_few_jobs_whatever_the_way_between_endpoints(spark):
    labels = spark.createDataFrame([(1, f"e{i:02d}", f"l{k}") for i in range(12) for k in range(2 * i, 2 * i + 4)], "graph_id long, endpoint string, label string")
    sc = spark.sparkContext
    sc.setJobGroup("jobs of clusters", "")
    try:
        assert {r.cluster for r in M.clusters(labels).collect()} == {"e00"}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("jobs of clusters")) <= 12
