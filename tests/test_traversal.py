"""Walks, streams and sources on small cases."""

import datetime

from pyspark.sql import functions as F

from arborist.operators import modules as M
from arborist.operators import traces
from arborist.operators import traversal as T
from arborist.sources import files as S
from arborist.sources import store
from arborist.streaming import limits as L

EDGES = "graph_id long, src string, tgt string, ord long"


def test_reach_is_least_depth_and_stays_in_its_graph(spark):
    e = spark.createDataFrame([(1, "a", "b", 0), (1, "a", "c", 1), (1, "b", "d", 2), (1, "c", "d", 3), (1, "d", "a", 4), (2, "d", "x", 5), (1, None, "z", 6)], EDGES)
    roots = spark.createDataFrame([(1, "a"), (1, "a")], "graph_id long, root string")
    tree = T.reach(roots, e, 12)
    assert {(r.node, r.depth, r.parent) for r in tree.collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")}
    assert tree.count() == 4 and T.reach(roots, e, 1).count() == 3 and T.reach(roots.limit(0), e, 3).isEmpty()
    steps = T.path_to(tree, spark.createDataFrame([(1, "a", "d")], "graph_id long, root string, node string"))
    assert [r.node for r in steps.orderBy("depth").collect()] == ["a", "b", "d"]


def test_upstream_root_takes_the_first_caller_and_stops_at_a_cycle(spark):
    e = spark.createDataFrame([(1, "b", "a", 5), (1, "c", "a", 2), (1, "d", "c", 0), (1, "y", "x", 0), (1, "x", "y", 1)], EDGES)
    starts = spark.createDataFrame([(1, "a"), (1, "x"), (1, "d")], "graph_id long, id string")
    assert {(r.start, r.root, r.depth) for r in T.upstream_root(starts, e).collect()} == {("a", "d", 2), ("x", "y", 1), ("d", "d", 0)}
    assert {(r.start, r.root) for r in T.upstream_root(starts, e, 1).collect()} == {("a", "c"), ("x", "y"), ("d", "d")}


def test_default_path_takes_the_smallest_child(spark):
    e = spark.createDataFrame([(1, "a", "c", 0), (1, "a", "b", 1), (1, "b", "d", 2), (1, "c", "e", 3), (1, "e", "f", 3)], EDGES)
    tree = T.reach(spark.createDataFrame([(1, "a"), (1, "z")], "graph_id long, root string"), e, 12)
    assert [(r.root, r.node) for r in T.default_path(tree).orderBy("root", "depth").collect()] == [("a", "a"), ("a", "b"), ("a", "d"), ("z", "z")]
    assert T.default_path(tree.limit(0)).isEmpty()


NODES = "graph_id long, id string, type string, file_path string, ord long"
TRACED = "graph_id long, edge_identifier string, type string, src string, tgt string, ord long"


def traced(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.edge_identifier, r.pos)):
        out.setdefault(r.edge_identifier, []).append((r.pos, r.node, r.others))
    return out


def test_traces(spark):
    nodes = spark.createDataFrame([(1, "ui", "FILE", "ui.ts", 0), (1, "ctl", "FILE", "ctl.java", 1), (1, "repo", "FILE", "repo.java", 2), (1, "t", "DB_TABLE", None, 3)] + [(1, i, "FUNCTION", p, k) for k, (i, p) in enumerate({"c1": "ctl.java", "c2": "ctl.java", "s": "s.java", "r": "repo.java"}.items())], NODES)
    calls = [(1, "c>s", "FUNCTION_CALL", "c1", "s", 5), (1, "d>s", "FUNCTION_CALL", "c2", "s", 6), (1, "s>r", "FUNCTION_CALL", "s", "r", 7), (2, "x>y", "FUNCTION_CALL", "x", "y", 0), (2, "y>x", "FUNCTION_CALL", "y", "x", 1), (2, "n", "FUNCTION_CALL", None, "x", 0)]
    e = spark.createDataFrame(calls + [(1, "api", "API_CALL", "ui", "ctl", 8), (1, "db", "DB_READ", "repo", "t", 9)], TRACED)
    found = traced(traces.trace_calls(nodes, e))
    assert found["s>r"] == [(-2, "ui", 0), (-1, "c1", 1), (0, "s", 0), (1, "r", 0), (2, "t", 0)]
    assert found["c>s"] == [(-1, "ui", 0), (0, "c1", 0), (1, "s", 0), (2, "r", 0), (3, "t", 0)]
    assert found["x>y"] == [(0, "x", 0), (1, "y", 0)] and "n" not in found
    assert traced(traces.trace_tables(nodes, e)) == {"db": [(-4, "ui", 0), (-3, "c1", 1), (-2, "s", 0), (-1, "r", 0), (0, "repo", 0), (1, "t", 0)]}
    assert traced(traces.trace_requests(nodes, e)) == {"api": [(0, "ui", 0), (1, "ctl", 0), (2, "c1", 0), (3, "s", 0), (4, "r", 0), (5, "t", 0)]}
    assert traces.trace_tables(nodes, e.limit(0)).isEmpty() and traces.trace_calls(nodes.limit(0), e).count() > 0


def test_trace_along_one_type(spark):
    e = spark.createDataFrame([(1, "i1", "IMPORT", "a", "b", 3), (1, "i2", "IMPORT", "b", "c", 2), (1, "i3", "IMPORT", "b", "d", 1), (1, "i4", "IMPORT", "d", "a", 4), (1, "f1", "FIELD_DEPENDENCY", "c", "a", 0), (1, "o", "FUNCTION_CALL", "c", "a", 0)], TRACED)
    found = traced(traces.trace_same_type(e, ["IMPORT", "FIELD_DEPENDENCY"]))
    assert found["i1"] == [(-2, "b", 0), (-1, "d", 0), (0, "a", 0), (1, "b", 0), (2, "d", 1), (3, "a", 0)]
    assert found["f1"] == [(0, "c", 0), (1, "a", 0)] and "o" not in found
    assert found["i2"][-1] == (1, "c", 0)


def test_domains_come_from_folders_then_from_names(spark):
    paths = {"x/domain/order/A.java": "order", "x/domain/Donation/B.java": "donation", "x/pages/payment/C.tsx": "payment", "x/domain/userAccount/D.java": "useraccount", "x/domain/user/E.java": "user",
             "x/web/OrdersController.java": "order", "x/web/DonatePage.tsx": "donation", "x/web/pay.ts": "payment", "x/web/UserAccountService.java": "useraccount", "x/web/CreateUserModal.tsx": "user", "x/web/Thing.java": "common", "x/domain/impl/F.java": "common"}
    nodes = spark.createDataFrame([(1, p, "FILE", p, 0) for p in paths] + [(1, "n", "FILE", None, 0), (2, "o", "FILE", "x/web/OrdersController.java", 0)], NODES)
    found = {(r.graph_id, r.file_path): r.domain for r in M.domains(nodes).collect()}
    assert found == {(1, p): d for p, d in paths.items()} | {(2, "x/web/OrdersController.java"): "common"}


def test_footprints_and_what_they_share(spark):
    nodes = spark.createDataFrame([(1, f"e{i}", "API_ENDPOINT", "GET", f"c{i}.java") for i in range(4)] + [(1, "t", "DB_TABLE", "users", None)], "graph_id long, id string, type string, name string, file_path string")
    e = spark.createDataFrame([(1, f"e{i}", "t", i) for i in range(3)], EDGES)
    labels = T.footprint_labels(nodes.where("type = 'API_ENDPOINT'").selectExpr("graph_id", "id AS root"), nodes, e)
    assert labels.count() == 7
    assert [(r.label, r.n) for r in T.shared_labels(labels).collect()] == [("DB:users", 3)]


def test_scan_skips_folders_and_large_files_and_names_languages(spark, tmp_path):
    for path, size in {"src/a.PY": 3, "node_modules/x.ts": 3, "b.min.js": 3, "deploy/compose.yml": 3, "k8s/other.yml": 3, "big.java": 99, "x.docset/y.go": 3}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * size)
    found = S.scan_sources(spark, f"file://{tmp_path}", max_bytes=50)
    assert {(r.file_path, r.language, r.content) for r in found.collect()} == {("src/a.PY", "Python", "xxx"), ("deploy/compose.yml", "DockerCompose", "xxx")}


def test_trips_are_counted_by_window(spark, tmp_path):
    events = spark.range(7).selectExpr("'login' AS category", "timestamp_seconds(CASE WHEN id < 4 THEN id ELSE id + 8 END) AS ts")
    want = [(0, 4), (10, 3)]
    assert sorted((r.start.second, r.n) for r in L.trips(events, "10 seconds").collect()) == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = L.trips(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "10 seconds")
    q = stream.writeStream.format("memory").queryName("trips").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.start.second, r.n) for r in spark.table("trips").collect()) == want


def _stream(spark, rows, schema, tmp_path, step):
    """What a stream gives that reads the rows in files of three, one a batch."""
    folder = tmp_path / "in"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = step(source).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and not q.exception()
    return {r["event_id"]: r for r in spark.table("out").collect()}


def test_rate_limits_as_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", i, at(s)) for i, s in enumerate((0, 10, 20, 61, 70, 80, 2000))] + [("b", 10 + i, at(i)) for i in range(3)]
    got = _stream(spark, rows, "key string, event_id long, ts timestamp", tmp_path, lambda s: L.rate_limit(s, 2, 60.0))
    assert [got[i]["allowed"] for i in (0, 1, 2, 3, 4, 5, 6, 10, 11, 12)] == [True, True, False, True, True, False, True, True, True, False]


def test_connections_as_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    acts = ["disconnect", "connect", "connect", "connect", "disconnect", "connect"]
    got = _stream(spark, [("a", i, at(i), x) for i, x in enumerate(acts)], "key string, event_id long, ts timestamp, action string", tmp_path, lambda s: L.connections(s, 2))
    assert [(got[i]["open_n"], got[i]["allowed"]) for i in range(6)] == [(0, True), (1, True), (2, True), (2, False), (1, True), (2, True)]


def test_notifications_fan_out(spark):
    e = spark.createDataFrame([(1, "like", 5, 5), (2, "like", 5, 6), (3, "digest", None, None), (4, "follow", 5, 5)], "event_id long, kind string, actor long, owner long")
    told = L.fan_out(e, spark.createDataFrame([(8,), (9,)], "recipient long"))
    assert sorted((r.event_id, r.recipient) for r in told.collect()) == [(2, 6), (3, 8), (3, 9), (4, 5)]


def test_graphs_are_stored_replaced_and_read_by_partition(spark, tmp_path):
    n = spark.createDataFrame([(1, "a"), (2, "b")], "graph_id long, id string")
    folder = f"file://{tmp_path}/g"
    store.write_graph(n, n, folder)
    store.write_graph(n.where("graph_id = 2").withColumn("id", F.lit("c")), n.where("graph_id = 2"), folder)
    assert sorted(tuple(r) for r in store.read_graph(spark, folder)[0].select("graph_id", "id").collect()) == [(1, "a"), (2, "c")]
    assert [r.id for r in store.read_graph(spark, folder, 1)[0].collect()] == ["a"]
    cache = spark.createDataFrame([(1, "f", "h", 1, "old")], "project_id long, file_path string, content_hash string, analyzer_version int, json string")
    fresh = spark.createDataFrame([(1, "f", "h", 1, "new"), (1, "f", "k", 1, "new")], cache.schema)
    assert sorted(r.json for r in store.merge_cache(cache, fresh).collect()) == ["new", "old"]


def test_changed_files_of_a_folder_are_followed(spark, tmp_path):
    seen = []
    (tmp_path / "src").mkdir()
    for name in ("a.py", "b.min.js", "c.java"):
        (tmp_path / "src" / name).write_text("x")
        store.watch(spark, f"file://{tmp_path}/src", str(tmp_path / "c"), lambda df, i: seen.extend(r.file_path for r in df.collect())).awaitTermination(60)
    assert seen == ["a.py", "c.java"]


def test_modules_of_endpoints(spark):
    names = {f"e{i}": f"GET:/api/{'orders' if i < 3 else 'users'}/{i}" for i in range(6)}
    nodes = spark.createDataFrame([(1, k, "API_ENDPOINT", v, None) for k, v in names.items()], "graph_id long, id string, type string, name string, file_path string")
    held = {"e0": "all o1 o2", "e1": "all o1 o2 x", "e2": "all x", "e3": "all u1 u2", "e4": "all u1 u2", "e5": "all"}
    labels = spark.createDataFrame([(1, e, x) for e, own in held.items() for x in own.split()], "graph_id long, endpoint string, label string")
    c = M.clusters(labels)
    assert {r.endpoint: r.cluster for r in c.collect()} == {"e0": "e0", "e1": "e0", "e2": "e2", "e3": "e3", "e4": "e3", "e5": "e5"}
    assert M.candidate_modules(c, labels, nodes).where("cluster = 'e3'").collect()[0]["name"] == "users"


def test_budgeted_walks_are_those_of_a_queue(spark):
    import random

    draw = random.Random(3)
    for nodes, budget, hops in ((6, 4, 2), (30, 12, 3), (30, 500, 10), (12, 1, 3)):
        edges = [(g, f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}", draw.choice([None, 1, 2, 3])) for g in (1, 2) for _ in range(nodes * 3)] + [(1, None, "n1", 1), (1, "n1", None, 1)]
        out = {}
        for g, a, b, o in edges:
            if a is not None and b is not None:
                best = out.setdefault((g, a), {})
                best[b] = min(best.get(b, 9), -1 if o is None else o)
        want = set()
        for g in (1, 2):
            for root in ("n0", "n1", "n5", "absent"):
                queue, depth, i = [root], {root: 0}, 0
                while i < len(queue) < budget:
                    node = queue[i]
                    want.add((g, root, node, depth[node], i))
                    for _, b in sorted((o, b) for b, o in out.get((g, node), {}).items()) if depth[node] < hops else ():
                        if b not in depth:
                            depth[b] = depth[node] + 1
                            queue.append(b)
                    i += 1
        starts = spark.createDataFrame([(g, r) for g in (1, 2) for r in ("n0", "n1", "n5", "absent", "n0", None)], "graph_id long, root string")
        found = T.budgeted_reach(starts, spark.createDataFrame(edges, "graph_id long, src string, tgt string, ord long"), hops, budget)
        assert {tuple(r) for r in found.select("graph_id", "root", "node", "depth", "pos").collect()} == want
    assert T.budgeted_reach(starts.limit(0), spark.createDataFrame(edges, "graph_id long, src string, tgt string, ord long")).isEmpty()


def test_many_roots_walk_in_blocks(spark):
    """150 roots that reach the same nodes are three rows a node, not 150; each keeps its own depths, parents and paths."""
    edges = [(1, f"r{i:03d}", f"n{i % 3}") for i in range(150)] + [(1, "n0", "n1"), (1, "n1", "n2"), (1, "n2", "n0"), (1, "n2", "z"), (1, "n1", "y"), (1, "y", "z")]
    e = spark.createDataFrame(edges, "graph_id long, src string, tgt string")
    starts = spark.createDataFrame([(1, f"r{i:03d}") for i in range(150)], "graph_id long, root string")
    steps, want = {}, set()
    for _, s, t in edges:
        steps.setdefault(s, set()).add(t)
    for root in (f"r{i:03d}" for i in range(150)):
        level, seen, depth = {root: None}, {}, 0
        while level:
            seen |= level
            want |= {(root, n, depth, p) for n, p in level.items()}
            found = {}
            for n in sorted(level):
                for t in steps.get(n, ()):
                    if t not in seen:
                        found.setdefault(t, n)
            level, depth = found, depth + 1
    tree = T.reach(starts, e, 12)
    assert {(r.root, r.node, r.depth, r.parent) for r in tree.collect()} == want and tree.count() == len(want)
    w = T.walks(starts, e, 12)
    assert w.reached.where("node = 'z'").count() == 3 and w.found.where("node = 'z'").count() <= 9
    rows = lambda df: sorted((r.root, r.depth, r.node) for r in df.collect())
    assert rows(T.default_paths(starts, e)) == rows(T.default_path(tree))
    assert T.default_paths(starts.limit(0), e).isEmpty()


def test_ways_of_nodes_are_found_once(spark):
    """Calls to or from a function share its way; each ends where it meets the call's other end, in a ring, at a leaf or after 15 steps."""
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "a"), ("self", "self"), ("x", "self")]
    line = [(f"l{i:02d}", f"l{i + 1:02d}") for i in range(20)]
    pairs = ring + line
    e = spark.createDataFrame([(1, f"{s}>{t}", "FUNCTION_CALL", s, t, i) for i, (s, t) in enumerate(pairs)], "graph_id long, edge_identifier string, type string, src string, tgt string, ord long")
    n = spark.createDataFrame([(1, x, "FUNCTION", f"{x}.py", 0) for x in {x for p in pairs for x in p}], "graph_id long, id string, type string, file_path string, ord long")
    want = set()
    for src, tgt in pairs:
        for at, own, other, sign in ((src, 1, 0, -1), (tgt, 0, 1, 1)):
            seen, pos = {src, tgt}, 0 if sign < 0 else 1
            want.add((f"{src}>{tgt}", pos, at))
            for _ in range(traces.MAX_STEPS):
                near = [p[other] for p in pairs if p[own] == at]
                if not near or near[0] in seen:
                    break
                at, pos = near[0], pos + sign
                seen.add(at)
                want.add((f"{src}>{tgt}", pos, at))
    got = [(r.edge_identifier, r.pos, r.node) for r in traces.trace_calls(n, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    steps = traces.first_steps(e, "src", "tgt")
    found = {r["at"]: ([s.node for s in r.steps], r.leaf) for r in traces.ways(steps).collect()}
    assert found["a"] == (["b", "c", "a"], False) and found["self"] == (["self"], False) and found["l10"] == ([f"l{i}" for i in range(11, 21)], True)
    assert len(found["l01"][0]) == 15 and not found["l01"][1] and not found["l05"][1] and found["l06"][1] and len(found) == steps.count()
    starts = spark.createDataFrame([(1, "w", "x", []), (1, "v", "a", ["c"]), (1, "u", "none", [])], "graph_id long, walk string, at string, seen array<string>")
    assert {r.walk: ([s.node for s in r.steps], r["at"], r.leaf) for r in traces.follow(starts, steps).collect()} == {"w": (["a", "b", "c"], "c", False), "v": (["b"], "b", False), "u": ([], "none", True)}
