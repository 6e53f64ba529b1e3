"""Merge gates, digests and visibility on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from arborist.operators import digest, gates
from arborist.operators import summaries as S
from arborist.sources.files import language_of

PULLS = "project_id long, pull_id long, graph_id long, truncated boolean, scoped boolean"
LOCATED = "graph_id long, type string, severity string, fingerprint string, file string"
CHANGED, ANALYSED, SWITCHES, HIDDEN = "project_id long, pull_id long, file string", "graph_id long, file string", "project_id long, architecture boolean, experimental boolean", "project_id long, fingerprint string"


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def rows(found, *columns):
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def reviewed(spark, located, pulls, changed, analysed=(), switches=(), hidden=()):
    make = lambda r, s: spark.createDataFrame(list(r), s)
    return gates.review(make(located, LOCATED), make(pulls, PULLS), make(changed, CHANGED), make(analysed, ANALYSED), make(switches, SWITCHES), make(hidden, HIDDEN))


def test_gate_by_type_sets_and_switches(spark):
    located = [(1, t, "HIGH", t, "a.java") for t in ("CYCLIC_IMPORT", "INTERFACES_IMPORTS_INFRA", "ASYNC_SELF_CALL")] + [(1, "DEAD_CODE", "LOW", "d", "a.java"), (1, "HIGH_FAN_OUT", "MEDIUM", "m", "a.java"), (1, None, None, "n", "a.java")]
    pulls = [(p, 1, 1, False, True) for p in (1, 2, 3, 4)]
    found = reviewed(spark, located, pulls, [(p, 1, "a.java") for p in (1, 2, 3, 4)] * 2, switches=[(2, False, False), (3, True, True), (4, None, None)])
    # correctness always blocks, architecture unless it is off, experimental where it is on; null switches are as none
    assert rows(found, "project_id", "high_count", "warning_count", "low_dropped") == [(1, 2, 5, 1), (2, 1, 5, 1), (3, 3, 5, 1), (4, 2, 5, 1)]
    only = reviewed(spark, [(1, "CYCLIC_IMPORT", "HIGH", "c", "a.java")], pulls[1:2], [(2, 1, "a.java")], switches=[(2, False, False)])
    assert rows(only, "state", "high_count", "warning_count") == [("success", 0, 1)]


def test_scope_suppression_and_pulls_without_warnings(spark):
    located = [(1, "CYCLIC_IMPORT", "HIGH", "x", "a.java"), (1, "CYCLIC_IMPORT", "HIGH", "y", "b.java"), (1, "CYCLIC_IMPORT", "HIGH", "z", None)]
    pulls = [(1, 1, 1, False, True), (1, 2, 1, False, False), (1, 3, 9, False, True), (2, 1, 1, False, True)]
    found = reviewed(spark, located, pulls, [(1, 1, "a.java"), (2, 1, "b.java"), (2, 1, "a.java")], hidden=[(2, "x"), (2, "x")])
    columns = ["project_id", "pull_id", "state", "high_count", "warning_count", "out_of_scope"]
    # changed files unknown: all are in scope; another project's suppressions don't count; no warnings: success
    assert rows(found, *columns) == [(1, 1, "failure", 1, 1, 2), (1, 2, "failure", 3, 3, 0), (1, 3, "success", 0, 0, 0), (2, 1, "failure", 1, 1, 1)]
    assert reviewed(spark, located, [], []).isEmpty()


def test_unanalysed_files_of_truncated_analyses(spark):
    pulls = [(1, 1, 1, True, True), (1, 2, 1, False, True), (1, 3, 1, True, False), (1, 4, 2, True, True)]
    changed = [(1, p, f) for p in (1, 2, 3, 4) for f in ("a.java", "b.java", "b.java", "README.md", None)]
    found = reviewed(spark, [], pulls, changed, analysed=[(1, "a.java"), (2, "a.java"), (2, "b.java")])
    assert rows(found, "pull_id", "unanalysed", "state") == [(1, 1, "success"), (2, 0, "success"), (3, 0, "success"), (4, 0, "success")]
    text = {r["pull_id"]: r["description"] for r in gates.description(found).collect()}
    assert text[1].endswith("(partial analysis: 1 changed files left out)") and text[2] == "No structural violations (HIGH)"
    assert rows(gates.log_rows(found, F.lit("2024-01-05")), "pull_id", "state", "created_at")[0] == (1, "success", at(5))


def test_from_sources_to_gate(spark):
    def files(graph_id, imported):
        text = {
            "src/main/java/shop/domain/order/Order.java": f"package shop.domain.order;\nimport {imported};\nclass Order {{ void total() {{ }} }}",
            "src/main/java/shop/infrastructure/db/Store.java": "package shop.infrastructure.db;\nclass Store { void save() { } }",
            "src/main/java/shop/domain/order/Price.java": "package shop.domain.order;\nclass Price { void sum() { } }",
        }
        return [(graph_id, path, content) for path, content in text.items()]

    source = spark.createDataFrame(files(1, "shop.infrastructure.db.Store") + files(2, "shop.domain.order.Price"), "graph_id long, file_path string, content string")
    source = source.withColumn("language", language_of(F.col("file_path")))
    pulls = spark.createDataFrame([(1, 1, 1, False, True), (1, 2, 2, False, True), (2, 3, 1, False, True), (1, 4, 1, False, True)], PULLS)
    order, price = "src/main/java/shop/domain/order/Order.java", "src/main/java/shop/domain/order/Price.java"
    changed = spark.createDataFrame([(1, 1, order), (1, 2, order), (2, 3, order), (1, 4, price)], CHANGED)
    none, off = spark.createDataFrame([], HIDDEN), spark.createDataFrame([(2, False, False)], SWITCHES)
    located, found = gates.review_sources(source, pulls, changed, off, none)
    assert rows(located.where("severity = 'HIGH'"), "graph_id", "type", "file") == [(1, "DOMAIN_IMPORTS_INFRA", order)]
    assert rows(found, "pull_id", "state", "high_count") == [(1, "failure", 1), (2, "success", 0), (3, "success", 0), (4, "success", 0)]


def test_reports_and_audit(spark):
    schema = "project_id long, fingerprint string, reporter_id long, reported_at long, reason string"
    stored = spark.createDataFrame([(1, "a", 5, 1, None), (1, "b", None, 1, None)], schema)
    reports = spark.createDataFrame([(1, "a", 5, 9, "again"), (1, "a", 6, 9, "late"), (1, "a", 6, 3, "z"), (1, "a", 6, 3, "first"), (1, "b", None, 4, "x"), (2, "a", 5, 4, None)], schema)
    assert rows(gates.new_reports(stored, reports), "project_id", "reporter_id", "reported_at", "reason") == [(1, 6, 3, "first"), (2, 5, 4, None)]
    rule = lambda *r: spark.createDataFrame(list(r), "project_id long, type string, source string, target string")
    found = gates.rule_audit(rule((1, "A", "x", None), (1, "B", "x", "y")), rule((1, "A", "x", None), (1, "A", "x", ""), (2, "B", "x", "y")))
    assert rows(found, "project_id", "op", "type", "target") == [(1, "ADD", "A", ""), (1, "REMOVE", "B", "y"), (2, "ADD", "B", "y")]
    assert gates.rule_audit(rule((1, "A", "x", None)), rule((1, "A", "x", None))).isEmpty()


def test_lost_stale_and_changed(spark):
    pulls = spark.createDataFrame([("r", i, s, t) for i, (s, t) in enumerate([("a", at(2, 11, 50)), ("b", at(2, 11, 50, 1)), ("c", at(1, 12)), ("d", at(1, 11, 59, 59)), ("e", at(2)), ("f", at(2)), (None, at(2))])], "repo string, number long, head_sha string, updated_at timestamp")
    statuses = spark.createDataFrame([("r", "e", "failure"), ("r", "f", "error"), ("q", "a", "success"), ("r", "c", "pending")], "repo string, head_sha string, state string")
    # ten minutes and a day are in, errors and other repositories' states don't count
    assert rows(gates.lost_reviews(pulls, statuses, F.lit("2024-01-02 12:00:00")), "number") == [(0,), (2,), (5,), (6,)]
    runs = spark.createDataFrame([(1, "RUNNING", at(1, 11, 40)), (2, "RUNNING", at(1, 11, 39, 59)), (3, "PENDING", at(1)), (4, "RUNNING", None), (5, "DONE", at(1)), (6, None, at(1))], "id long, status string, started_at timestamp")
    now = F.lit("2024-01-01 12:00:00")
    assert rows(gates.settle_stale(runs, now), "id", "status") == [(1, "RUNNING"), (2, "FAILED"), (3, "PENDING"), (4, "RUNNING"), (5, "DONE"), (6, None)]
    assert rows(gates.settle_restart(runs), "id", "status") == [(1, "FAILED"), (2, "FAILED"), (3, "FAILED"), (4, "FAILED"), (5, "DONE"), (6, None)]
    heads = spark.createDataFrame([(1, "m", None, "s1"), (1, "m", "api", "s1"), (2, "m", None, "s2"), (3, "m", None, None), (4, "m", None, "s1"), (5, "m", None, "s1")], "project_id long, branch string, scope string, commit_sha string")
    done = spark.createDataFrame([(1, "m", None, 1, 1, "DONE", "s1"), (2, "m", None, 1, 1, "DONE", "s2"), (2, "m", None, 2, 2, "FAILED", "s2"), (3, "m", None, 1, 1, "DONE", None), (4, "m", None, 1, 1, "DONE", "s0"), (5, "m", None, 1, 1, "FAILED", "s0"), (5, "m", None, 1, 2, "DONE", "s1")], "project_id long, branch string, scope string, created_at long, id long, status string, commit_sha string")
    # the scope is part of the key, the newest run decides, an unknown commit is always analysed
    assert rows(gates.needs_analysis(heads, done), "project_id", "scope", "last_sha") == [(1, "api", None), (2, None, "s2"), (3, None, None), (4, None, "s0")]


def test_gate_metrics(spark):
    log = lambda *r: spark.createDataFrame([(p, s, h, at(*t)) for p, s, h, t in r], "project_id long, state string, high_count long, created_at timestamp")
    other = spark.createDataFrame([(1, at(30)), (1, at(30)), (2, at(20))], "project_id long, created_at timestamp")
    reports = lambda *kinds: spark.createDataFrame([(k, at(30)) for k in kinds], "type string, created_at timestamp")
    now = F.lit("2024-01-31 12:00:00")
    full = log((1, "failure", 3, (30,)), (1, "failure", 5, (1, 11)), (2, "success", 0, (2,)))
    assert [tuple(r) for r in gates.gate_metrics(full, other, other, reports("CYCLIC_IMPORT", "HIGH_FAN_OUT"), now).collect()] == [(2, 1, 2, 2, 3, 1, 67)]
    # more reports than occurrences is 0, no occurrences at all is 100
    assert gates.gate_metrics(full, other, other, reports(*["INTENT_DRIFT"] * 4), now).first()["unreported_percent"] == 0
    assert tuple(gates.gate_metrics(full.limit(0), other.limit(0), other.limit(0), reports("INTENT_DRIFT"), now).first()) == (0, 0, 0, 0, 0, 1, 100)


def test_days_in_a_zone(spark):
    users = spark.createDataFrame([(at(1, 14, 59, 59), at(3, 15)), (at(1, 15), None)], "created_at timestamp, last_active_at timestamp")
    none = spark.createDataFrame([], "created_at timestamp, status string, confirmed_at timestamp, amount long")
    pay = spark.createDataFrame([(at(1), "CONFIRMED", 5), (at(1), "CONFIRMED", None), (at(1), "OPEN", 9), (None, "CONFIRMED", 7)], "confirmed_at timestamp_ntz, status string, amount long")
    runs = spark.createDataFrame([(at(1), "FAILED"), (at(1), "DONE"), (at(1), None)], "created_at timestamp, status string")
    found = digest.daily_metrics(users, none, runs, pay, none)
    days = {r["day"].day: tuple(r)[1:] for r in found.collect()}
    assert days == {1: (1, 0, 0, 3, 1, 2, 5, 0), 2: (1, 0, 0, 0, 0, 0, 0, 0), 4: (0, 1, 0, 0, 0, 0, 0, 0)}
    assert rows(digest.latest_two(found), "day", "rn") == [(dt.date(2024, 1, 2), 2), (dt.date(2024, 1, 4), 1)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        instants = spark.sql("SELECT TIMESTAMP '2024-01-01 15:00:00Z' AS t")
        assert instants.select(digest.day_of(instants, "t").alias("d")).first()["d"] == dt.date(2024, 1, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    sizes = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "name string, bytes long")
    assert rows(digest.largest(sizes), "rn", "name") == [(1, "c"), (2, "a"), (3, "b")]


def test_anomalies(spark):
    day = lambda d: dt.date(2024, 1, d)
    metrics = spark.createDataFrame([(day(1), 10, 5, 1), (day(2), 15, 4, 4), (day(4), 40, 10, 0), (day(5), 9, 14, 2), (day(6), 30, 14, 0)], "day date, active_users long, analyses long, failed_analyses long")
    gauges = spark.createDataFrame([(day(1), 10, 400 << 20), (day(2), 9, (400 << 20) - 1), (day(9), 11, None)], "day date, open_requests long, bytes long")
    trips = spark.createDataFrame([(day(1), "b", 20), (day(1), "a", 19), (day(1), "a", 1), (day(1), "c", 19)], "day date, category string, n long")
    found = digest.anomalies(metrics, gauges, trips)
    assert [tuple(r) for r in found.orderBy("day", "pos").collect()] == [
        (day(1), 1, "FAILURE_RATE", "analyses", 20, 5), (day(1), 2, "BACKLOG", "requests", 10, None), (day(1), 3, "SIZE", "database", 400, None), (day(1), 4, "TRIPS", "a", 20, None), (day(1), 5, "TRIPS", "b", 20, None),
        (day(2), 1, "DAY_CHANGE", "active_users", 50, 10), (day(5), 1, "DAY_CHANGE", "active_users", -77, 40), (day(9), 1, "BACKLOG", "requests", 11, None),
    ]
    assert digest.anomalies(metrics.limit(0), gauges.limit(0), trips.limit(0)).isEmpty()


def test_visibility(spark):
    layout = [(1, "layer-section-domain", None), (1, "layer-section-ui", None), (1, "g", "layer-section-domain"), (1, "f", "g"), (1, "m", "f"), (1, "deep", "m"), (1, "h", "layer-section-ui"), (1, "k", "h"), (1, "free", None), (2, "layer-section-domain", None), (2, "g", "layer-section-domain"), (2, "lost", "layer-section-x")]
    nodes = spark.createDataFrame([(*x, was) for was in (True, False) for x in layout if (x[1] in "fkdeepfreelost") == was], "graph_id long, id string, parent_id string, hidden boolean")
    found = S.layer_visibility(nodes, spark.createDataFrame([(1, "domain"), (1, "domain"), (2, "ui")], "graph_id long, layer string"))
    got = {(r["graph_id"], r["id"]): (r["hidden"], r["opaque"]) for r in found.collect()}
    assert got == {
        (1, "layer-section-domain"): (False, True), (1, "layer-section-ui"): (False, False), (1, "g"): (True, None), (1, "f"): (True, None), (1, "m"): (True, None), (1, "deep"): (True, None),
        (1, "h"): (False, None), (1, "k"): (False, None), (1, "free"): (True, None), (2, "layer-section-domain"): (False, False), (2, "g"): (False, None), (2, "lost"): (True, None),
    }
    edges = spark.createDataFrame([("IMPORT", True), ("IMPORT", None), ("DB_UPDATE", None), ("API_CALL", None), ("SERVICE_CALL", None), (None, True)], "type string, broken boolean")
    seen = lambda shown: [r["visible"] for r in S.edge_visibility(edges, shown).collect()]
    assert seen({"imports", "api"}) == [False, True, False, True, True, True] and seen({"broken", "database"}) == [True, False, True, False, True, True]
