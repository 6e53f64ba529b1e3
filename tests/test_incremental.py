"""Graphs refreshed after changes, folders followed by manifest, stores that rewrite buckets, limits with late rows."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from arborist.extract import graph as B
from arborist.sources import store
from arborist.sources.files import language_of
from arborist.streaming import limits as L

FILES = "graph_id long, file_path string, content string"


def tree(spark, rows):
    return spark.createDataFrame(rows, FILES).withColumn("language", F.coalesce(language_of(F.col("file_path")), F.lit("?")))


def shape(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_refreshed_graph_equals_a_full_build(spark, tmp_path):
    method = lambda name, *calls: "  public void " + name + "(int a) { " + " ".join(f"{c}(1);" for c in calls) + " }\n"
    before = {
        "p/A.java": "import p.B;\nclass A extends Base {\n" + method("go", "shared", "solo", "inherited") + "}", "p/B.java": "class B {\n" + method("shared") + "}", "p/Base.java": "class Base {\n" + method("inherited") + "}",
        "q/C.java": "class C {\n" + method("solo") + "}", "w/x.ts": "import { y } from './y';\nfetch('/api/one');", "w/y.ts": "app.get('/api/one', serve);\nfunction serve(a) { }", "m/User.java": "@Entity\nclass User {\n  private Long id;\n}",
        "m/UserRepository.java": "interface UserRepository extends JpaRepository<User, Long> {\n  User findById(int a);\n}",
    }
    # a second definition makes a call ambiguous, a file goes, a class moves below another, a table is renamed
    after = {k: v for k, v in before.items() if k != "w/y.ts"} | {"q/D.java": "class D {\n" + method("solo") + "}", "p/Base.java": "class Base extends Root {\n}", "p/Root.java": "class Root {\n" + method("inherited") + "}", "m/User.java": '@Entity\n@Table(name = "people")\nclass User {\n}', "w/z.ts": "app.get('/api/one', serve);\nfunction serve(a) { }"}
    other = [(2, "a/One.java", "class One {\n" + method("only") + "}")]
    old = B.Facts(tree(spark, [(1, k, v) for k, v in before.items()] + other))
    B.save_facts(old, str(tmp_path / "facts"))
    changed = [(1, k, v) for k, v in after.items() if before.get(k) != v] + [(1, k, None) for k in before if k not in after]
    f, n, e = B.refresh_graphs(B.load_facts(spark, str(tmp_path / "facts")), tree(spark, changed))
    full = B.Facts(tree(spark, [(1, k, v) for k, v in after.items()]))
    assert shape(n) == shape(B.nodes(full)) and shape(e) == shape(B.edges(full)) and n.where("graph_id <> 1").isEmpty()
    assert {r.file_path for r in f.paths.collect()} == {*after, "a/One.java"}
    assert shape(e) != shape(B.edges(B.of_graphs(old, tree(spark, changed))))


def test_changed_and_deleted_files_are_seen(spark, tmp_path):
    src, state, seen = tmp_path / "src", str(tmp_path / "state"), []
    (src / "sub").mkdir(parents=True)
    write = lambda name, text: (src / name).write_text(text)
    poll = lambda: (seen.clear(), store.poll(spark, f"file://{src}", state, lambda df: seen.extend((r.file_path, r.status, r.content) for r in df.collect())), sorted(seen, key=str))[1:]
    write("a.java", "one")
    write("sub/b.py", "two")
    write("c.bin", "not read")
    assert poll() == (2, [("a.java", "added", "one"), ("sub/b.py", "added", "two")])
    assert poll() == (0, [])
    write("a.java", "one more")
    os.remove(src / "sub/b.py")
    write("d.go", "new")
    assert poll() == (3, [("a.java", "changed", "one more"), ("d.go", "added", "new"), ("sub/b.py", "deleted", None)])
    os.utime(src / "a.java", (2_000_000_000, 2_000_000_000))  # touched only
    assert poll() == (0, [])
    write("sub/b.py", "back")
    with pytest.raises(ZeroDivisionError):
        store.poll(spark, f"file://{src}", state, lambda df: 1 / 0)
    assert poll() == (1, [("sub/b.py", "added", "back")])  # what failed comes again


def test_stores_rewrite_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, n long, flag boolean")
    read = lambda: sorted((r.k, r.v, r.n, r.flag) for r in store.read_store(spark, folder).collect())
    store.merge_store(spark, folder, rows(*[(i, "old", i, False) for i in range(40)]), ["k"])
    stamp = lambda: {p: os.stat(p).st_mtime_ns for d, _, names in os.walk(folder) for p in (os.path.join(d, x) for x in names) if "part-" in p}
    files = stamp()
    store.merge_store(spark, folder, rows((3, "new", 0, True), (99, "new", 0, True)), ["k"])
    assert read()[3] == (3, "old", 3, False) and read()[-1] == (99, "new", 0, True)
    assert len(set(files) - set(stamp())) <= 4  # two buckets
    store.merge_store(spark, folder, rows((3, "new", 0, True)), ["k"], replace=True)
    assert read()[3] == (3, "new", 0, True) and len(read()) == 41
    store.expire_store(spark, folder, ["k"], F.col("n") < 20)
    assert [r[0] for r in read()] == list(range(20, 40))
    store.mark_all(spark, folder, ["k"], rows((21, "", 0, False), (22, "", 0, False)), "flag")
    assert [r[0] for r in read() if r[3]] == [21, 22]
    pins = str(tmp_path / "pins")
    store.merge_store(spark, pins, spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", True)], "project long, graph string, pinned boolean"), ["project", "graph"])
    store.merge_store(spark, pins + "2", store.read_store(spark, pins), ["project"], replace=True)
    both = str(tmp_path / "slots")
    store.change_store(spark, both, ["project"], store.read_store(spark, pins), lambda _: store.read_store(spark, pins))
    store.take_slot(spark, both, ["project"], spark.createDataFrame([(1, "b")], "project long, graph string"), "pinned")
    assert sorted((r.project, r.graph, r.pinned) for r in store.read_store(spark, both).collect()) == [(1, "a", False), (1, "b", True), (2, "c", True)]


def at(s):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)


def stream(spark, batches, schema, tmp_path, build):
    """The rows of a stream whose micro-batches are the given lists."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    q = build(source).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("found").collect()


def test_late_requests_count_in_their_own_window(spark, tmp_path):
    batches = [[("a", 1, at(0)), ("a", 2, at(10)), ("a", 3, at(70))], [("a", 4, at(20)), ("a", 5, at(30)), ("a", 6, at(80)), ("a", 7, at(90)), ("b", 8, at(5))], [("a", 9, at(1000)), ("b", 10, at(1001))]]
    got = {r.event_id: r.allowed for r in stream(spark, batches, "key string, event_id long, ts timestamp", tmp_path, lambda s: L.rate_limit(s, 2, 60.0))}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True, 9: True, 10: True}


def test_request_rules(spark):
    rows = [(1, "POST", "/api/analyses", "x, 9.9.9.9 ", "1.1.1.1"), (2, "GET", "/api/analyses", None, "1.1.1.1"), (3, "POST", "/api/community/posts/7/like", "", "2.2.2.2"), (4, "POST", "/api/community/posts/7/8/like", None, "2.2.2.2"), (5, "PUT", "/api/users/me/ai-key/priority", None, "3.3.3.3"), (6, "DELETE", "/api/users/me/ai-key/4", None, "3.3.3.3")]
    got = {r.event_id: (r.key, r.limit, r.window_s) for r in L.routed(spark.createDataFrame(rows, "event_id long, method string, path string, forwarded string, remote string")).collect()}
    assert got == {1: ("9.9.9.9:analysis", 1, 180.0), 3: ("2.2.2.2:post-like", 60, 60.0), 5: ("3.3.3.3:ai-key-write", 10, 60.0), 6: ("3.3.3.3:ai-key-write", 10, 60.0)}
    assert len(L.REQUEST_RULES) == 26


def test_connections_in_spans_equal_one_after_the_other(spark):
    r = random.Random(3)
    acts = [r.choice(["connect", "connect", "connect", "disconnect", "ping"]) for _ in range(300)]
    rows = [(k, i + 1000 * k, at(60 * i), a) for k in (1, 2) for i, a in enumerate(acts[k * 20 :])]
    got = {x.event_id: (x.open_n, x.allowed) for x in L.connections_batch(spark.createDataFrame(rows, "key long, event_id long, ts timestamp, action string"), 5, "20 minutes").collect()}
    want, n = {}, {1: 0, 2: 0}
    for k, i, _, a in rows:
        ok = a != "connect" or n[k] < 5
        n[k] += (a == "connect" and ok) - (a == "disconnect" and n[k] > 0)
        want[i] = (n[k], ok)
    assert got == want and not all(ok for _, ok in got.values())


def test_activity_changes_add_up(spark, tmp_path):
    day = 86400
    rows = [[(at(0), 1), (at(5), 2), (at(day), 1)], [(at(day + 1), 3), (at(9), 1), (at(3 * day), 2)], [(at(3 * day), 4), (at(3 * day + 5), 1)]]
    got = stream(spark, rows, "ts timestamp, user_id long", tmp_path, L.activity_changes)
    total = {}
    for r in got:
        total[r.day] = total.get(r.day, 0) + r.change
    batch = spark.createDataFrame([x for b in rows for x in b], "ts timestamp, user_id long")
    assert {d: n for d, n in total.items() if n} == {r.day: r.n for r in L.daily_active(batch).collect()}


def test_send_guard(spark, tmp_path):
    rows = [("s", i, at(i / 100)) for i in range(60)]
    got = stream(spark, [rows], "key string, event_id long, ts timestamp", tmp_path, L.send_guard)
    assert sum(r.allowed for r in got) == 40 and all(r.allowed == (r.event_id < 40) for r in got)
