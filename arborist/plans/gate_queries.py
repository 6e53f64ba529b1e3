"""Queries of merge gates, their reports and metrics, of daily digests and of what a view of a graph shows.

Customers stand for pull requests, events for analyses, requests and logs, orders for projects and posts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.operators import digest, findings, gates
from arborist.operators import summaries as S

from . import testgraph as G
from .rule_queries import _ALL, _warnings

NOW = "2024-01-20 12:00:00"
SWITCHES = [(1, False, True), (2, None, True)]
SHOWN = {"imports", "calls", "database"}


def _read(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names]


def _now():
    return F.lit(NOW).cast("timestamp")


def _pulls(spark, sf_dir):
    """Pull requests, their changed files and the files that were analysed; some changed files are gone, some aren't source."""
    n, (customers,) = G.nodes(spark, sf_dir), _read(spark, sf_dir, "customer")
    graphs = n.agg((F.max("graph_id") + 1).alias("ng"))
    pulls = customers.crossJoin(F.broadcast(graphs)).selectExpr("c_custkey AS pull_id", "c_custkey % ng AS graph_id", "c_custkey % 3 = 0 AS truncated", "c_custkey % 7 <> 0 AS scoped").selectExpr("graph_id % 3 AS project_id", "*")
    files = n.where("type = 'FILE'").select("graph_id", F.col("file_path").alias("file"), "ord")
    changed = pulls.join(files, "graph_id").where("(ord + pull_id) % 4 = 0").select("project_id", "pull_id", "file")
    other = lambda text: pulls.selectExpr("project_id", "pull_id", f"concat('src/', pull_id % 2, '{text}') AS file")
    changed = changed.unionByName(other("/Gone.java")).unionByName(other("/README.md"))
    return pulls, changed, files.where("ord % 5 <> 0").select("graph_id", "file")


def w10_pull_reviews(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    pulls, changed, analysed = _pulls(spark, sf_dir)
    settings = spark.createDataFrame(SWITCHES, "project_id long, architecture boolean, experimental boolean")
    suppressed = w.where("graph_id % 4 = 1 AND type = 'DOMAIN_IMPORTS_INFRA'").selectExpr("graph_id % 3 AS project_id", "fingerprint")
    return gates.review(findings.locate(w, n), pulls, changed, analysed, settings, suppressed)


def w12_unanalysed_files(spark, sf_dir):
    return gates.unanalysed(*_pulls(spark, sf_dir))


def w16_new_reports(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    rows = lines.selectExpr("l_suppkey % 5 AS project_id", "CAST(l_partkey % 50 AS STRING) AS fingerprint", "CASE WHEN l_suppkey % 20 <> 7 THEN l_suppkey % 20 END AS reporter_id", "l_shipdate AS reported_at", "l_orderkey", "l_linenumber", "l_quantity")
    return gates.new_reports(rows.where("l_quantity > 48"), rows.where("l_quantity <= 48").drop("l_quantity"))


def w17_rule_changes(spark, sf_dir):
    (lines,) = _read(spark, sf_dir, "lineitem")
    listed = lambda where: lines.where(where).selectExpr("l_suppkey % 7 AS project_id", "l_returnflag AS type", "CAST(l_partkey AS STRING) AS source", "CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS target").distinct()
    return gates.rule_audit(listed("l_quantity < 30"), listed("l_quantity > 20"))


def a4_a5_gate_metrics(spark, sf_dir):
    events, orders, labels = _read(spark, sf_dir, "events", "orders", "labels")
    log = events.where("event_type = 'error'").selectExpr("user_id AS project_id", "CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END AS state", "CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS high_count", "ts AS created_at")
    analyses = events.where("event_type = 'view'").selectExpr("user_id AS project_id", "ts AS created_at")
    reports = labels.where("toxic = 1").select(F.when(F.col("doc_id") % 2 == 0, "CYCLIC_IMPORT").otherwise("HIGH_FAN_OUT").alias("type"), F.lit("2024-01-10").cast("timestamp").alias("created_at"))
    return gates.gate_metrics(log, analyses, events.where("event_type = 'click'").selectExpr("ts AS created_at"), reports, _now())


def _metrics(spark, sf_dir):
    events, orders = _read(spark, sf_dir, "events", "orders")
    users = events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_active_at"))
    projects = orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("created_at"))
    analyses = events.where("event_type = 'view' AND user_id % 3 = 0").selectExpr("ts AS created_at", "CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'DONE' END AS status")
    payments = events.where("event_type = 'purchase'").selectExpr("ts AS confirmed_at", "CASE WHEN event_id % 5 = 0 THEN 'OPEN' ELSE 'CONFIRMED' END AS status", "event_id % 100 AS amount")
    return digest.daily_metrics(users, projects, analyses, payments, events.where("event_type = 'error'").selectExpr("ts AS created_at"))


def a6_a8_anomalies(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    days = events.select(digest.day_of(events, "ts").alias("day"), "event_type", "event_id", "user_id")
    gauges = days.groupBy("day").agg(F.count_if(F.col("user_id") == 3).alias("open_requests"), (F.count("*") * (1 << 20)).alias("bytes"))
    return digest.anomalies(_metrics(spark, sf_dir), gauges, days.groupBy("day", F.col("event_type").alias("category"), (F.col("event_id") % 3).alias("third")).agg(F.count_if(F.col("user_id") % 2 == 0).alias("n")))


def j15_heads(spark, sf_dir):
    (orders,) = _read(spark, sf_dir, "orders")
    rows = orders.selectExpr("o_custkey AS project_id", "o_orderstatus AS branch", "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 AS STRING) END AS scope", "o_orderdate AS created_at", "o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'DONE' END AS status", "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 4 + o_orderkey % 2 AS STRING) END AS commit_sha")
    heads = rows.groupBy("project_id", "branch", "scope").agg(F.max(F.when(F.col("id") % 7 != 0, F.col("commit_sha"))).alias("commit_sha"))
    return gates.needs_analysis(heads, rows.where("id % 4 <> 0"))


def _analyses(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    return events.selectExpr("event_id", "CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'PENDING' ELSE 'DONE' END AS status", "CASE WHEN event_id % 9 <> 0 THEN ts END AS started_at")


def j20_lost_reviews(spark, sf_dir):
    (events,) = _read(spark, sf_dir, "events")
    pulls = events.selectExpr("user_id AS repo", "event_id AS number", "CAST(event_id AS STRING) AS head_sha", "ts AS updated_at")
    statuses = events.where("event_id % 3 <> 0").selectExpr("user_id AS repo", "CAST(event_id AS STRING) AS head_sha", "CASE event_id % 3 WHEN 1 THEN 'success' ELSE CASE WHEN event_id % 2 = 0 THEN 'failure' ELSE 'error' END END AS state")
    return gates.lost_reviews(pulls, statuses, _now()).select("repo", "number")


def g9_layers(spark, sf_dir):
    n = G.nodes(spark, sf_dir).where("type IN ('FILE', 'FUNCTION')").select("graph_id", "id", "type", "file_path", "ord")
    layer, folder = F.element_at(F.split("file_path", "/"), 2), F.regexp_extract("file_path", "^(.*)/", 1)
    files = n.where("type = 'FILE'").withColumns({"layer": layer, "folder": folder})
    shape = lambda rows, id_, parent: rows.select("graph_id", id_.alias("id"), parent.cast("string").alias("parent_id"))
    section = F.concat(F.lit(S.SECTION), F.col("layer"))
    layout = shape(files.select("graph_id", "layer").distinct(), section, F.lit(None)).unionByName(shape(files.select("graph_id", "layer", "folder").distinct(), F.col("folder"), section))
    layout = layout.unionByName(shape(files, F.col("id"), F.col("folder")))
    functions = n.where("type = 'FUNCTION'").join(files.select("graph_id", "file_path", F.col("id").alias("file")), ["graph_id", "file_path"])
    layout = layout.unionByName(shape(functions, F.col("id"), F.when(F.col("ord") % 10 != 0, F.col("file")))).withColumn("hidden", F.crc32(F.col("id")) % 2 == 0)
    opaque = files.where("layer IN ('main', 'app', 'order') AND graph_id % 2 = 0").select("graph_id", "layer")
    return S.layer_visibility(layout, opaque).where(~F.startswith("id", F.lit("M")) | F.col("parent_id").isNotNull()).select("graph_id", "id", "hidden", "opaque")


def g9_switches(spark, sf_dir):
    e = G.edges(spark, sf_dir).withColumn("broken", F.when(F.col("ord") % 5 != 0, F.col("ord") % 2 == 0))
    return S.edge_visibility(e, SHOWN).select("edge_identifier", "visible")


_PULLS = """, pu AS (SELECT c_custkey AS pull_id, c_custkey % ng AS graph_id, c_custkey % ng % 3 AS project_id, c_custkey % 3 = 0 AS cut, c_custkey % 7 <> 0 AS scoped FROM {customer}, (SELECT MAX(graph_id) + 1 AS ng FROM nodes)),
ch AS (SELECT pull_id, file_path AS file FROM pu JOIN nodes USING (graph_id) WHERE type = 'FILE' AND (ord + pull_id) % 4 = 0 UNION ALL SELECT pull_id, 'src/' || pull_id % 2 || '/Gone.java' FROM pu UNION ALL SELECT pull_id, 'src/' || pull_id % 2 || '/README.md' FROM pu),
ua AS (SELECT pu.project_id, pu.pull_id, COUNT(*) AS unanalysed FROM pu JOIN ch USING (pull_id) WHERE cut AND scoped AND regexp_matches(file, '[.](java|kt|py|tsx?)$')
  AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.type = 'FILE' AND n.ord % 5 <> 0 AND n.graph_id = pu.graph_id AND n.file_path = ch.file) GROUP BY 1, 2)"""
_DAY = "CAST({0} + INTERVAL 9 HOUR AS DATE)"
_METRICS = f"""WITH m0 AS (
  SELECT {_DAY.format("MIN(ts)")} AS day, 1 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, 0 AS f, 0 AS g, 0 AS h FROM events GROUP BY user_id UNION ALL SELECT {_DAY.format("MAX(ts)")}, 0, 1, 0, 0, 0, 0, 0, 0 FROM events GROUP BY user_id
  UNION ALL SELECT {_DAY.format("o_orderdate")}, 0, 0, 1, 0, 0, 0, 0, 0 FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT {_DAY.format("ts")}, 0, 0, 0, 1, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END, 0, 0, 0 FROM events WHERE event_type = 'view' AND user_id % 3 = 0
  UNION ALL SELECT {_DAY.format("ts")}, 0, 0, 0, 0, 0, 1, event_id % 100, 0 FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 0
  UNION ALL SELECT {_DAY.format("ts")}, 0, 0, 0, 0, 0, 0, 0, 1 FROM events WHERE event_type = 'error'),
m AS (SELECT day, CAST(SUM(a) AS BIGINT) AS new_users, CAST(SUM(b) AS BIGINT) AS active_users, CAST(SUM(c) AS BIGINT) AS new_projects, CAST(SUM(d) AS BIGINT) AS analyses, CAST(SUM(e) AS BIGINT) AS failed_analyses, CAST(SUM(f) AS BIGINT) AS payments, CAST(SUM(g) AS BIGINT) AS amount, CAST(SUM(h) AS BIGINT) AS new_feedback FROM m0 GROUP BY 1)"""

_GRAPH_SQL = {
    "w10_pull_reviews": _ALL + _PULLS + """, sw AS (SELECT w.*, file_path AS nope FROM wf w JOIN nodes n ON n.graph_id = w.graph_id AND n.id = string_split(w.node_ids, ',')[1]),
hit AS (SELECT pu.pull_id, w.type, w.severity, NOT scoped OR EXISTS (SELECT 1 FROM ch WHERE ch.pull_id = pu.pull_id AND ch.file = w.file) AS inside,
  w.severity = 'HIGH' AND CASE WHEN w.type = 'INTERFACES_IMPORTS_INFRA' THEN project_id IN (1, 2) WHEN w.type IN ('DOMAIN_IMPORTS_INFRA', 'CROSS_FEATURE_IMPORT') THEN project_id <> 1 ELSE TRUE END AS blocks
  FROM pu JOIN sw w ON w.graph_id = pu.graph_id WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.graph_id % 4 = 1 AND x.type = 'DOMAIN_IMPORTS_INFRA' AND x.graph_id % 3 = project_id AND x.fingerprint = w.fingerprint)),
n AS (SELECT pull_id, COUNT(*) FILTER (WHERE inside AND blocks) AS hi, COUNT(*) FILTER (WHERE inside AND severity <> 'LOW') AS wc, COUNT(*) FILTER (WHERE inside AND severity = 'LOW') AS lo, COUNT(*) FILTER (WHERE NOT inside) AS outside FROM hit GROUP BY 1)
SELECT pu.project_id, pu.pull_id, graph_id, CASE WHEN hi > 0 THEN 'failure' ELSE 'success' END AS state, COALESCE(hi, 0) AS high_count, COALESCE(wc, 0) AS warning_count, COALESCE(lo, 0) AS low_dropped, COALESCE(outside, 0) AS out_of_scope, COALESCE(unanalysed, 0) AS unanalysed
FROM pu LEFT JOIN n USING (pull_id) LEFT JOIN ua USING (pull_id)""",
    "w12_unanalysed_files": _PULLS + " SELECT * FROM ua",
    "g9_switches": " SELECT edge_identifier, CASE WHEN type = 'IMPORT' THEN ord % 5 = 0 OR ord % 2 = 1 ELSE type NOT IN ('INSTANTIATION', 'API_CALL') END AS visible FROM edges",
}
_LAYERS = """, fi AS (SELECT graph_id, id, file_path, string_split(file_path, '/')[2] AS layer, regexp_extract(file_path, '^(.*)/', 1) AS folder FROM nodes WHERE type = 'FILE'),
st AS (SELECT *, layer IN ('main', 'app', 'order') AND graph_id % 2 = 0 AS opaque FROM fi)
SELECT DISTINCT graph_id, 'layer-section-' || layer AS id, FALSE AS hidden, opaque FROM st UNION ALL SELECT DISTINCT graph_id, folder, opaque, NULL FROM st UNION ALL SELECT graph_id, id, opaque, NULL FROM st
UNION ALL SELECT n.graph_id, n.id, st.opaque, NULL FROM nodes n JOIN st ON st.graph_id = n.graph_id AND st.file_path = n.file_path WHERE n.type = 'FUNCTION' AND n.ord % 10 <> 0"""

_REPORTS = "r AS (SELECT l_suppkey % 5 AS project_id, CAST(l_partkey % 50 AS VARCHAR) AS fingerprint, CASE WHEN l_suppkey % 20 <> 7 THEN l_suppkey % 20 END AS reporter_id, l_shipdate AS reported_at, l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)"
_LISTED = "SELECT DISTINCT l_suppkey % 7 AS project_id, l_returnflag AS type, CAST(l_partkey AS VARCHAR) AS source, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS target FROM lineitem WHERE l_quantity"
_TABLE_SQL = {
    "w16_new_reports": f"WITH {_REPORTS}, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, fingerprint, reporter_id ORDER BY reported_at, l_orderkey, l_linenumber) AS rn FROM r WHERE q <= 48) SELECT project_id, fingerprint, reporter_id, reported_at, l_orderkey, l_linenumber FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.q > 48 AND r.project_id = f.project_id AND r.fingerprint = f.fingerprint AND r.reporter_id IS NOT DISTINCT FROM f.reporter_id)",
    "w17_rule_changes": f"SELECT project_id, 'ADD' AS op, type, source, target FROM ({_LISTED} > 20 EXCEPT {_LISTED} < 30) UNION ALL SELECT project_id, 'REMOVE', type, source, target FROM ({_LISTED} < 30 EXCEPT {_LISTED} > 20)",
    "a4_a5_gate_metrics": f"""WITH t AS (SELECT TIMESTAMP '{NOW}' AS now), g AS (SELECT COUNT(DISTINCT CASE WHEN ts >= now - INTERVAL 30 DAY THEN user_id END) AS gated_projects, COUNT(*) FILTER (WHERE event_id % 3 = 0) AS blocked, CAST(COALESCE(SUM(CASE WHEN event_id % 3 = 0 AND ts >= now - INTERVAL 30 DAY THEN event_id % 4 ELSE 0 END), 0) AS BIGINT) AS high_count FROM events, t WHERE event_type = 'error'),
o AS (SELECT COUNT(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS analysed_projects, COUNT(*) FILTER (WHERE event_type = 'click') AS posts FROM events, t WHERE ts >= now - INTERVAL 7 DAY), r AS (SELECT COUNT(*) AS reports FROM labels WHERE toxic = 1 AND doc_id % 2 = 0)
SELECT gated_projects, analysed_projects, posts, blocked, high_count, reports, CASE WHEN high_count = 0 THEN 100 ELSE LEAST(100, CAST(FLOOR(GREATEST(0, high_count - reports) * 100.0 / high_count + 0.5) AS INT)) END AS unreported_percent FROM g, o, r""",
    "a1_metrics_by_day": _METRICS + " SELECT * FROM m",
    "a9_latest_days": _METRICS + " SELECT day, analyses, rn FROM (SELECT day, analyses, ROW_NUMBER() OVER (ORDER BY day DESC) AS rn FROM m) WHERE rn <= 2",
    "a6_a8_anomalies": _METRICS + f""", d AS (SELECT {_DAY.format("ts")} AS day, * EXCLUDE (ts) FROM events), g AS (SELECT day, COUNT(*) FILTER (WHERE user_id = 3) AS o, COUNT(*) AS mb FROM d GROUP BY 1),
p AS (SELECT m.*, b.active_users AS u0, b.analyses AS a0 FROM m LEFT JOIN m b ON b.day = m.day - 1),
x AS (SELECT day, 0 AS k, 'FAILURE_RATE' AS kind, 'analyses' AS subject, CAST(FLOOR(failed_analyses * 100.0 / analyses + 0.5) AS BIGINT) AS value, analyses AS base FROM p WHERE analyses >= 5 AND failed_analyses >= 0.2 * analyses
  UNION ALL SELECT day, 1, 'DAY_CHANGE', 'active_users', CAST(FLOOR((active_users - u0) * 100.0 / u0 + 0.5) AS BIGINT), u0 FROM p WHERE u0 >= 10 AND ABS(active_users - u0) >= 0.5 * u0
  UNION ALL SELECT day, 2, 'DAY_CHANGE', 'analyses', CAST(FLOOR((analyses - a0) * 100.0 / a0 + 0.5) AS BIGINT), a0 FROM p WHERE a0 >= 10 AND ABS(analyses - a0) >= 0.5 * a0
  UNION ALL SELECT day, 3, 'BACKLOG', 'requests', o, NULL FROM g WHERE o >= 10 UNION ALL SELECT day, 4, 'SIZE', 'database', mb, NULL FROM g WHERE mb >= 400
  UNION ALL SELECT day, 5, 'TRIPS', event_type, COUNT(*), NULL FROM d WHERE user_id % 2 = 0 GROUP BY 1, 4 HAVING COUNT(*) >= 20)
SELECT day, CAST(ROW_NUMBER() OVER (PARTITION BY day ORDER BY k, subject) AS INT) AS pos, kind, subject, value, base FROM x""",
    "j15_heads": """WITH r AS (SELECT o_custkey AS project_id, o_orderstatus AS branch, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 AS VARCHAR) END AS scope, o_orderdate AS t, o_orderkey AS id, o_orderkey % 5 <> 0 AS done, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 4 + o_orderkey % 2 AS VARCHAR) END AS sha FROM orders),
h AS (SELECT project_id, branch, scope, MAX(CASE WHEN id % 7 <> 0 THEN sha END) AS commit_sha FROM r GROUP BY 1, 2, 3), l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, branch, scope ORDER BY t DESC, id DESC) AS rn FROM r WHERE id % 4 <> 0)
SELECT h.project_id, h.branch, h.scope, commit_sha, l.sha AS last_sha FROM h LEFT JOIN l ON rn = 1 AND l.project_id = h.project_id AND l.branch = h.branch AND l.scope IS NOT DISTINCT FROM h.scope WHERE NOT COALESCE(done AND sha = commit_sha, FALSE)""",
    "j19_settled": f"SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 9 <> 0 AND TIMESTAMP '{NOW}' - ts > INTERVAL 20 MINUTE THEN 'FAILED' WHEN event_type = 'view' THEN 'RUNNING' WHEN event_type = 'click' THEN 'PENDING' ELSE 'DONE' END AS status FROM events",
    "j19_restarted": "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'FAILED' ELSE 'DONE' END AS status FROM events",
    "j20_lost_reviews": f"SELECT user_id AS repo, event_id AS number FROM events WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND (event_id % 3 = 0 OR (event_id % 3 = 2 AND event_id % 2 = 1))",
}


def queries() -> dict:
    return {
        "w10_pull_reviews": w10_pull_reviews, "w12_unanalysed_files": w12_unanalysed_files, "w16_new_reports": w16_new_reports, "w17_rule_changes": w17_rule_changes, "a4_a5_gate_metrics": a4_a5_gate_metrics,
        "a1_metrics_by_day": _metrics, "a9_latest_days": lambda spark, sf_dir: digest.latest_two(_metrics(spark, sf_dir)).select("day", "analyses", "rn"), "a6_a8_anomalies": a6_a8_anomalies, "j15_heads": j15_heads,
        "j19_settled": lambda spark, sf_dir: gates.settle_stale(_analyses(spark, sf_dir), _now()).select("event_id", "status"),
        "j19_restarted": lambda spark, sf_dir: gates.settle_restart(_analyses(spark, sf_dir)).select("event_id", "status"),
        "j20_lost_reviews": j20_lost_reviews, "g9_layers": g9_layers, "g9_switches": g9_switches,
    }


def oracle_sql() -> dict[str, str]:
    return {k: G.oracle(v) for k, v in (_GRAPH_SQL | {"g9_layers": _LAYERS}).items()} | _TABLE_SQL
