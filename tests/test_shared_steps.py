"""Steps that many queries share: what is broadcast, looked at and built."""

import os
import re

from arborist.operators import rules
from arborist.plans import report_queries
from arborist.plans import testgraph as G

from .test_rules import files, graph

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_broadcast_no_nodes_and_repeat_no_expressions(spark):
    text = plan(G.edge_plan(spark, SF_DIR))
    assert "BroadcastHashJoin" not in text
    # sizes of the whole table are the one thing that is broadcast; the rows' expressions aren't part of its condition
    (nested,) = re.findall(r"BroadcastNestedLoopJoin.*", text)
    assert len(nested) < 500
    ends = rules.with_ends(G.edges(spark, SF_DIR), G.nodes(spark, SF_DIR))
    assert "BroadcastHashJoin" not in plan(ends)


def test_only_the_ends_of_imports_are_classified(spark, monkeypatch):
    seen, real = [], rules.classified
    monkeypatch.setattr(rules, "classified", lambda nodes: (seen.append(nodes.count()), real(nodes))[1])
    functions = [(f"M{i}", "FUNCTION", f"f{i}", "src/domain/user/A.java", "Java") for i in range(5)]
    n, e = graph(spark, files("src/domain/user/A.java", "src/infrastructure/B.java", "src/domain/user/C.java") + functions, [("IMPORT", "F0", "F1"), ("FUNCTION_CALL", "M0", "M1")])
    assert [w["node_ids"] for w in rules.domain_imports_infra(n, e).collect()] == [["F0", "F1"]]
    assert seen == [2]


def test_asynchronous_calls_meet_the_called_method_first(spark):
    n, e = graph(spark, [(f"M{i}", "FUNCTION", f"f{i}", "src/A.java" if i < 3 else "src/B.java", "Java") for i in range(4)], [("FUNCTION_CALL", a, b) for a, b in (("M0", "M1"), ("M0", "M2"), ("M3", "M1"))])
    n = n.withColumn("is_async", n.id == "M1")
    found = rules.async_self_call(n, e)
    last, first = [line for line in plan(found).splitlines() if "SortMergeJoin" in line]
    assert "src" in last and "tgt" in first and "src" not in first
    assert [w["node_ids"] for w in found.collect()] == [["M0", "M1"]]


def test_features_are_found_once_a_path(spark):
    n, _ = graph(spark, [(f"F{i}", "FILE", "x", f"src/features/{'ab'[i % 2]}/x.ts", "TypeScript") for i in range(6)], [("IMPORT", "F0", "F1")])
    gate = rules.feature_gate(n)
    # the expressions stand above the grouping by path
    lines = plan(gate).splitlines()
    assert max(i for i, line in enumerate(lines) if "features/" in line) < min(i for i, line in enumerate(lines) if re.search(r"keys=\[graph_id#\d+L, file_path#\d+\]", line))
    assert [r.graph_id for r in gate.collect()] == [1]


def test_a_query_of_nodes_builds_no_edges(spark, monkeypatch):
    monkeypatch.setattr(G, "edges", lambda *_: 1 / 0)
    for name in ("s9_incremental_parse", "g1_node_diff", "g3_diff_summary", "g8_node_search", "g40_node_counts"):
        assert name in report_queries.queries() and report_queries.queries()[name](spark, SF_DIR).columns
