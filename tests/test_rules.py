"""Small positive and negative cases of the structural rules."""

import random

from pyspark.sql import functions as F

from arborist.operators import findings, rules

NODE = "graph_id long, id string, type string, name string, file_path string, language string, ord long"
EDGE = "graph_id long, edge_identifier string, type string, src string, tgt string, ord long"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(1, *x, i) for i, x in enumerate(nodes)], NODE)
    flags = ["is_async", "is_transactional", "is_interface", "is_framework_interface", "is_framework_annotated", "referenced_as_value", "is_test", "is_bean"]
    n = n.withColumns({f: F.lit(False) for f in flags}).withColumn("merged_def_count", F.lit(1)).withColumn("comment", F.lit(None).cast("string"))
    e = spark.createDataFrame([(1, f"{t}:{a}>{b}", t, a, b, i) for i, (t, a, b) in enumerate(edges)], EDGE)
    return n, e.withColumns({f: F.lit(False) for f in ("same_file", "is_interface_impl", "is_lazy")})


def files(*paths):
    return [(f"F{i}", "FILE", p.rsplit("/", 1)[-1].split(".")[0], p, "Java") for i, p in enumerate(paths)]


def test_two_file_cycle_and_diamond(spark):
    n, e = graph(spark, files("src/a.java", "src/b.java", "src/c.java"), [("IMPORT", "F0", "F1"), ("IMPORT", "F1", "F0"), ("IMPORT", "F1", "F2")])
    (w,) = rules.cyclic_import(n, e).collect()
    assert w["node_ids"] == ["F0", "F1"] and len(w["edge_ids"]) == 2
    n, e = graph(spark, files(*(f"src/{x}.java" for x in "abcd")), [("IMPORT", "F0", "F1"), ("IMPORT", "F0", "F2"), ("IMPORT", "F1", "F3"), ("IMPORT", "F2", "F3")])
    assert rules.cyclic_import(n, e).isEmpty()


def test_fan_out_boundary(spark):
    funcs = [(f"M{i}", "FUNCTION", f"f{i}", f"src/x{i}.java", "Java") for i in range(9)]
    for calls, expected in ((7, 0), (8, 1)):
        n, e = graph(spark, funcs, [("FUNCTION_CALL", "M0", f"M{i + 1}") for i in range(calls)])
        assert rules.high_fan_out(n, e).count() == expected


def test_domain_imports_infra_needs_a_leading_slash(spark):
    n, e = graph(spark, files("src/domain/user/A.java", "src/infrastructure/B.java", "domain/user/C.java"), [("IMPORT", "F0", "F1"), ("IMPORT", "F2", "F1")])
    assert [w["node_ids"] for w in rules.domain_imports_infra(n, e).collect()] == [["F0", "F1"]]


def test_service_chain_needs_two_hops(spark):
    paths = files("services/a/x/A.java", "services/b/x/B.java", "services/c/x/C.java")
    n, e = graph(spark, paths, [("SERVICE_CALL", "F0", "F1")])
    assert rules.service_call_chain(n, e).isEmpty()
    n, e = graph(spark, paths, [("SERVICE_CALL", "F0", "F1"), ("SERVICE_CALL", "F1", "F2")])
    (w,) = rules.service_call_chain(n, e).collect()
    assert (w["node_ids"], w["edge_ids"], w["message"]) == (["F0", "F1", "F2"], ["SERVICE_CALL:F0>F1", "SERVICE_CALL:F1>F2"], "Service chain: a -> b -> c")
    assert rules.service_call_chain(n, e, min_hops=9).isEmpty()


def test_delete_is_covered_by_transactional_caller(spark):
    funcs = [("M0", "FUNCTION", "deleteByUserId", "src/infrastructure/persistence/R.java", "Java"), ("M1", "FUNCTION", "go", "src/application/S.java", "Java")]
    n, e = graph(spark, funcs, [("FUNCTION_CALL", "M1", "M0")])
    assert rules.missing_transactional_delete(n, e).count() == 1
    assert rules.missing_transactional_delete(n.withColumn("is_transactional", F.col("id") == "M1"), e).isEmpty()


def test_dead_code_summary_replaces_details(spark):
    funcs = [(f"M{i}", "FUNCTION", f"alpha{i}", f"src/plain/x{i}.java", "Java") for i in range(40)]
    n, e = graph(spark, funcs, [("FUNCTION_CALL", "M0", "M1")])
    (w,) = rules.dead_code(n, e).collect()
    assert w["message"] == "Functions without calls: 98% (39/40)" and w["node_ids"] == []
    n, e = graph(spark, funcs[:20], [("FUNCTION_CALL", "M0", "M1")])
    assert rules.dead_code(n, e).count() == 19


def test_intent_drift_reports_a_pair_once_and_in_its_project(spark):
    modules = spark.createDataFrame([(7, "a", 1, "src/a/**"), (7, "b", 2, "src/b/**")], "project_id long, module string, ord int, glob string")
    declared = spark.createDataFrame([(7, "a", "b", None)], "project_id long, source string, target string, edge_type string")
    n, e = graph(spark, files("src/a/A.java", "src/b/B.java"), [("IMPORT", "F0", "F1"), ("IMPORT", "F0", "F1"), ("IMPORT", "F1", "F0")])
    for project, found in ((7, 1), (8, 0)):
        assert rules.intent_drift(n, e, modules, declared, spark.createDataFrame([(1, project)], "graph_id long, project_id long")).count() == found


def test_cycles_against_a_recursive_search(spark):
    r = random.Random(4)
    for _ in range(4):
        k = r.randint(5, 14)
        pairs = sorted({(r.randrange(k), r.randrange(k)) for _ in range(2 * k)})
        n, e = graph(spark, files(*(f"src/{i:02}.java" for i in range(k))), [("IMPORT", f"F{a}", f"F{b}") for a, b in pairs])
        want, seen, path = [], set(), []

        def visit(a):
            seen.add(a)
            path.append(a)
            for b in [y for x, y in pairs if x == a]:
                if b in path:
                    want.append([f"F{x}" for x in path[path.index(b) :]])
                elif b not in seen:
                    visit(b)
            path.pop()

        for a in range(k):
            if a not in seen and any(a in p for p in pairs):
                visit(a)
        assert sorted(w["node_ids"] for w in rules.cyclic_import(n, e).collect()) == sorted(want)


def test_themes_route_rules(spark):
    n, e = graph(spark, files("src/domain/A.java", "src/application/order/B.java", "src/infrastructure/persistence/C.java", "src/interfaces/D.java"), [("IMPORT", "F3", "F2")])
    policy = lambda p: spark.createDataFrame([(1, p)], "graph_id long, policy string")
    types = lambda p: {w["type"] for w in rules.detect(n, e, policy(p)).collect()}
    assert "DB_LAYER_BYPASS" in types("AUTO") and "DB_LAYER_BYPASS" not in types("LAYERED") and "INTERFACES_IMPORTS_INFRA" in types("LAYERED")


def test_forced_policies_and_generic_graphs(spark):
    """A declared policy runs its rules on a graph of another shape; a graph of no architecture is GENERIC."""
    policy = lambda p: spark.createDataFrame([(1, p)], "graph_id long, policy string")
    kinds = lambda n, e, p: {w["type"] for w in rules.detect(n, e, policy(p)).collect()}
    theme = lambda n, e, p="AUTO": rules.themes(n, e, policy(p)).first()
    ddd = files("src/domain/A.java", "src/application/order/B.java", "src/infrastructure/persistence/C.java", "src/repository/UserRepository.java", "src/controller/UserController.java")
    n, e = graph(spark, ddd, [("IMPORT", "F3", "F4")])
    assert theme(n, e)["theme"] == "DDD" and "LAYERED_REVERSE_DEPENDENCY" not in kinds(n, e, "AUTO") and "LAYERED_REVERSE_DEPENDENCY" in kinds(n, e, "LAYERED")
    n, e = graph(spark, files("src/api/A.java", "src/infra/persistence/B.java"), [("IMPORT", "F0", "F1")])
    assert "DB_LAYER_BYPASS" in kinds(n, e, "DDD") and "DB_LAYER_BYPASS" not in kinds(n, e, "AUTO")
    n, e = graph(spark, files("src/x/A.java", "src/y/B.java"), [("IMPORT", "F0", "F1")])
    t = theme(n, e)
    assert (t["theme"], t["rule_types"], t["has_services"], t["self_declared"]) == ("GENERIC", [], False, False)
    assert theme(n, e, "LAYERED")["theme"] == "LAYERED" and theme(n, e, "LAYERED")["self_declared"]
    n, e = graph(spark, files("a/A.java", "b/B.java"), [("SERVICE_CALL", "F0", "F1")])
    assert theme(n, e)["rule_types"] == rules.SERVICE_RULE_TYPES


def test_detect_runs_the_rules_with_inputs_of_their_own(spark):
    n, e = graph(spark, files("src/a/A.java", "src/b/B.java"), [("IMPORT", "F0", "F1")])
    tables = spark.createDataFrame([(1, "T", "t", False, [("code", True)])], "graph_id long, id string, name string, converter_migration_done boolean, columns array<struct<column_name: string, has_converter: boolean>>")
    modules = spark.createDataFrame([(7, "a", 0, "src/a/**"), (7, "b", 1, "src/b/**")], "project_id long, module string, ord int, glob string")
    forbidden = spark.createDataFrame([(7, "a", "b", None)], "project_id long, source string, target string, edge_type string")
    projects = spark.createDataFrame([(1, 7)], "graph_id long, project_id long")
    assert {w["type"] for w in rules.detect(n, e, None, tables, (modules, forbidden, projects)).collect()} == {"MISSING_CONVERTER_MIGRATION", "INTENT_DRIFT"}


def test_longest_paths_against_a_full_search():
    import random

    def full(out, node, passed):
        steps = [full(out, v, passed | {v}) for v in out[node] if v not in passed]
        longest = min(steps, key=lambda p: (-len(p), ">".join(p).encode()), default=[])
        return [node, *longest]

    for seed in range(300):
        r = random.Random(seed)
        names = r.sample(["a", "a-b", "b", "bé", "c", "c>", "d", "e", "f"], r.randint(1, 8))
        out = {n: sorted({r.choice(names) for _ in range(r.randint(0, 3))} - {n}) for n in names}
        assert rules.longest_paths(out) == {n: full(out, n, {n}) for n in names}, seed
    line = {f"s{k:04}": [f"s{k + 1:04}"] if k < 2999 else [] for k in range(3000)}
    assert len(rules.longest_paths(line)["s0000"]) == 3000


def test_fingerprints_and_gate_are_stable(spark):
    w = spark.createDataFrame([(1, "X", "HIGH", ["a"], "m"), (1, "Y", "LOW", ["b"], None)], "graph_id long, type string, severity string, node_ids array<string>, message string")
    assert findings.fingerprint(w).collect() == findings.fingerprint(w).collect()
    (g,) = findings.gate_state(w).collect()
    assert (g["state"], g["high_count"], g["low_dropped"]) == ("failure", 1, 1)


def test_all_rules_give_one_shape_on_an_empty_graph(spark):
    n, e = graph(spark, files("src/a.java"), [("IMPORT", "F0", "F0")])
    for name, rule in rules.GRAPH_RULES.items():
        assert rule(n.limit(0), e.limit(0)).columns == ["graph_id", "type", "severity", "node_ids", "edge_ids", "message"], name
