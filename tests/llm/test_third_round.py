"""Components with few tasks, near-duplicates compared at once."""

import random

import numpy as np
from pyspark.sql import functions as F

from arborist.llm import jaccard, neardup, substring
from arborist.llm.common import components


def tasks_of(spark, f):
    """What f returns and how many tasks it took."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds}
    return out, sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))


def test_components_take_few_tasks(spark):
    rng = random.Random(5)
    rows = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(250)]
    rows += [(900, k) for k in range(500, 560)] + [(k, 901) for k in range(500, 560)] + [(k, 901) for k in range(500, 560)] + [(7, 7), (None, 3), (3, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found, tasks = tasks_of(spark, lambda: components(edges).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in parent)
    assert tasks < 1000, tasks


def test_sets_are_compared_with_all_pivots_at_once():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (0, 1, 3, 30, 60, 90, 60, 90, 200)]
    held = neardup.Pivots(sets)
    for a in sets:
        both = [len(np.intersect1d(a, b)) for b in sets]
        assert held.linked(a) == [k for k, b in enumerate(sets) if both[k] and 100 * both[k] >= 75 * len(np.union1d(a, b))]
    assert neardup.Pivots([sets[0]]).linked(sets[3]) == []


def test_empty_texts_of_repeated_ids_link_nothing(spark):
    """Each id has a text of its own and a text without words; the texts share a fifth of their words."""
    common = [f"c{k}" for k in range(40)]
    rows = [(i, " ".join([*common, *(f"w{i}x{k}" for k in range(4))])) for i in (1, 2, 3)] + [(i, " ") for i in (1, 2, 3)]
    rows += [(i, " ".join([*common[:20], *(f"v{i}x{k}" for k in range(24))])) for i in (4, 5, 6)] + [(i, " ") for i in (4, 5, 6)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_only_texts_that_lose_something_are_joined(spark, monkeypatch):
    rng, own = random.Random(3), lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = own(150)
    rows = [(k, own(6000)) for k in range(40)] + [(100, passage + own(50)), (101, own(60) + passage), (102, None), (102, "x"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    kind, joined = type(docs), []
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a, **b: (joined.append(self.count()), join(self, *a, **b))[1])
    out = substring.remove_repeats(docs).drop("kept").collect()
    lost = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in out}
    assert len(out) == len(rows) and {k: x for k, x in lost.items() if x[0]} == {(100, 200): (150, 1), (101, 210): (150, 1)}
    assert sum(joined) < 10, joined



def test_groups_of_long_texts_are_not_taken_together(spark):
    """A hundred pairs of texts of 200 KB: 40 MB, far fewer than PART texts."""
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 20_000).alias("text"))
    assert jaccard._buckets(texts) == 4
    assert jaccard._buckets(texts.limit(0)) == 1
    assert jaccard._buckets(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("short").alias("text"))) == 5
