"""Versions, summaries and feeds on small cases."""

from pyspark.sql import functions as F

from arborist.operators import feeds
from arborist.operators import summaries as S

NODES = "graph_id long, id string, type string, name string, file_path string, ord long, comment string"
EDGES = "graph_id long, edge_identifier string, type string, src string, tgt string"


def rows(found, *columns):
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def edges(spark, *parts, type="FUNCTION_CALL"):
    return spark.createDataFrame([(g, f"{s}>{t}", type, s, t) for g, s, t in parts], EDGES)


def test_versions_with_null_and_repeated_keys(spark):
    v = lambda *keys: spark.createDataFrame([(k, "FILE") for k in keys], "id string, type string")
    diff = S.node_diff(v("a", "b", "b", None), v("b", "c", None), ["id", "type"])
    assert rows(diff, "id", "status") == sorted([("a", "REMOVED"), ("b", "UNCHANGED"), ("c", "ADDED"), (None, "UNCHANGED")], key=str)
    assert rows(S.diff_summary(diff), "status", "n") == [("ADDED", 1), ("REMOVED", 1), ("UNCHANGED", 2)]
    e = lambda *r: spark.createDataFrame(list(r), "edge_identifier string, src_name string, tgt_name string")
    found = S.edge_diff(e(("x", "old", "t"), ("y", "s", "t")), e(("x", "zzz", "t"), ("z", None, "t")))
    assert rows(found, "edge_identifier", "src_name", "status") == [("x", "old", "UNCHANGED"), ("y", "s", "REMOVED"), ("z", None, "ADDED")]
    assert S.edge_diff(e(("x", "s", "t")).limit(0), e(("x", "s", "t")).limit(0)).isEmpty()


def test_hubs_and_budget_stay_in_their_graph(spark):
    calls = [(1, f"c{i}", "h") for i in range(3)] + [(1, "h", f"d{i}") for i in range(4)] + [(2, "h", "c0"), (1, None, "h")]
    e = edges(spark, *calls)
    assert rows(S.top_hubs(e), "graph_id", "id", "fan_in", "fan_out", "rn") == [(1, "h", 3, 4, 1)]
    n = spark.createDataFrame([(1, "h", "FUNCTION", "h", "a", 0, None), (2, "h", "FUNCTION", "h", "a", 0, None), (1, "f", "FILE", "f", "a", 0, None)], NODES)
    assert rows(S.node_budget(n, e), "graph_id", "id", "visible") == [(1, "f", True), (1, "h", True), (2, "h", False)]
    assert rows(S.undocumented_hot(n, e), "graph_id", "id", "n") == [(1, "h", 4)]
    assert S.top_hubs(e.limit(0)).isEmpty()


def test_search_counts_and_entry_points(spark):
    n = spark.createDataFrame([(1, "a", "FUNCTION", "getUser", "x", 0, None), (1, "b", "FUNCTION", None, "x", 1, "the USER"), (1, "c", "FUNCTION", "z", "y", 2, None), (1, "e", "API_ENDPOINT", "GET", "y", 9, None)], NODES)
    assert rows(S.search(n, "user"), "id") == [("a",), ("b",)] and S.search(n, "user", 1).count() == 1
    assert rows(S.node_counts(n), "files", "functions", "db_tables", "endpoints") == [(0, 3, 0, 1)]
    ends = S.with_ends(n, edges(spark, (1, "a", "c"), (1, "a", "b"), (1, "a", "gone")))
    assert ends.count() == 2
    assert [(r.id, r.pos) for r in S.entry_points(n, ends).orderBy("pos").collect()] == [("e", 1), ("a", 2), ("b", 3)]
    assert rows(S.file_calls(ends), "src_path", "tgt_path", "n", "first_caller") == [("x", "y", 1, "getUser")]
    assert rows(S.callers_callees(ends), "id", "side", "other", "file") == [("a", "callee", "c", "y"), ("c", "caller", "a", "x")]
    states = S.typed_edges(n, edges(spark, (1, "a", "b"), (1, "a", "gone"), (1, "a", "a"), (1, "a", "e")))
    assert rows(states, "edge_identifier", "state") == [("a>b", "ok"), ("a>e", "mismatch"), ("a>gone", "dangling")]


def test_samples_tables_and_precision(spark):
    e = edges(spark, *[(1, "a", f"t{i}") for i in range(40)], type="DB_READ")
    assert S.edge_sample(e).count() == 30 and rows(S.edge_sample(e), "edge_identifier") == rows(S.edge_sample(e.repartition(7)), "edge_identifier")
    both = edges(spark, (1, "a", "t0"), type="DB_WRITE").unionByName(e)
    assert rows(S.table_access(both).where("tgt < 't10'"), "tgt", "r", "w", "d") == [("t0", 1, 1, 0), ("t1", 1, 0, 0)]
    made = edges(spark, (1, "a", "t"), type="DB_CREATE").unionByName(edges(spark, (1, "a", "t"), type="DB_UPDATE"))
    assert rows(S.table_access(made), "r", "w", "c", "u", "d") == [(0, 0, 1, 1, 0)]
    (_, n, rate, low, high), = rows(S.audit_precision(e.select("type", F.lit(False).alias("phantom"))), "type", "n", "rate", "low", "high")
    assert (n, rate) == (40, 0) and 0 <= low < 1e-12 and abs(high - 3.8416 / 43.8416) < 1e-9
    n = spark.createDataFrame([(1, f"f{i:02}", "FUNCTION", "f", "p", i, None) for i in range(60)] + [(1, "t", "DB_TABLE", "t", None, 0, None)], NODES)
    assert rows(S.summary_edges(n, edges(spark, (1, "f00", "t"), (1, "f00", "f49"), (1, "f00", "f50"))), "edge_identifier") == [("f00>f49",), ("f00>t",)]


def test_newest_expired_and_upsert(spark):
    v = spark.createDataFrame([("p", i, i == 9) for i in range(10)] + [("q", 20, False)], "project string, version long, pinned boolean")
    newest = [F.col("version").desc()]
    assert rows(feeds.newest(v, ["project"], newest), "project", "version", "rn") == [("p", 9, 1), ("q", 20, 1)]
    refs = spark.createDataFrame([(8,), (0,)], "version long")
    assert [x[0] for x in rows(feeds.expired(v, refs, "version", ["project"], newest), "version")] == [1, 2, 3, 4]
    t = lambda *r: spark.createDataFrame(list(r), "day long, n long")
    assert rows(feeds.upsert(t((1, 5), (2, 6), (None, 7)), t((2, 1), (3, None)), ["day"]), "day", "n") == sorted([(1, 5), (2, 1), (3, None), (None, 7)], key=str)


def test_anomalies_feed_and_threads(spark):
    runs = spark.createDataFrame([("a", i == 0) for i in range(5)] + [("b", i == 0) for i in range(6)] + [("c", True)] * 4, "who string, bad boolean")
    assert rows(feeds.failure_anomalies(runs, "who", F.col("bad")), "who", "n", "failed") == [("a", 5, 1)]
    days = spark.createDataFrame([("k", 1, 10), ("k", 2, 15), ("k", 3, 16), ("k", 5, 99), ("l", 1, 9), ("l", 2, 90)], "k string, day long, n long")
    assert rows(feeds.daily_changes(days, ["k"]), "k", "day", "prev") == [("k", 2, 10)]
    posts, marks = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(2,), (2,), (3,), (None,)], "id long")
    assert rows(feeds.feed_by_count(posts, marks, "id", [F.col("id")], 2), "rn", "id", "n") == [(1, 2, 2), (2, 3, 1)]
    m = spark.createDataFrame([(1, 7, 8, 10), (2, 8, 7, 20), (3, 7, 7, 30), (4, None, 7, 5)], "message long, sender long, receiver long, at long")
    assert rows(feeds.threads(m), "one", "two", "message", "pos") == [(7, 8, 1, 2), (7, 8, 2, 1)]
