"""Queries over graphs (versions, traversals, summaries) and over operational tables (metrics, feeds, joins).

Those in ``_FUNCTIONS`` go through the operators and are checked against the SQL of their name. Each other one is one SQL
text in the part of the language that Spark and the checking engine share. ``nodes``, ``edges`` and ``ends`` are the derived code graphs; events, orders, customers and conversations stand for users,
posts, likes and messages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.operators import feeds
from arborist.operators import summaries as S
from arborist.sources import store
from arborist.streaming import limits

from . import testgraph as G

# Over nodes, edges and ends.
GRAPH = {
    "g1_node_diff": "SELECT COALESCE(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'UNCHANGED' END AS status FROM (SELECT * FROM nodes WHERE ord % 10 <> 0) a FULL OUTER JOIN (SELECT * FROM nodes WHERE ord % 10 <> 1) b ON a.id = b.id AND a.type = b.type AND a.name = b.name AND a.file_path = b.file_path",
    "g2_edge_diff": "SELECT COALESCE(a.edge_identifier, b.edge_identifier) AS edge_identifier, COALESCE(a.src_name, b.src_name) AS src_name, COALESCE(a.tgt_name, b.tgt_name) AS tgt_name, CASE WHEN a.edge_identifier IS NULL THEN 'ADDED' WHEN b.edge_identifier IS NULL THEN 'REMOVED' ELSE 'UNCHANGED' END AS status FROM (SELECT * FROM ends WHERE ord % 10 <> 0) a FULL OUTER JOIN (SELECT * FROM ends WHERE ord % 10 <> 1) b ON a.edge_identifier = b.edge_identifier",
    "g3_diff_summary": "SELECT CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'UNCHANGED' END AS status, COUNT(*) AS n FROM (SELECT id FROM nodes WHERE ord % 10 <> 0) a FULL OUTER JOIN (SELECT id FROM nodes WHERE ord % 10 <> 1) b ON a.id = b.id GROUP BY 1",
    "g7_complexity_hubs": "SELECT graph_id, id, fan_in, fan_out, rn FROM (SELECT i.graph_id, i.id, fan_in, fan_out, ROW_NUMBER() OVER (PARTITION BY i.graph_id ORDER BY CASE WHEN fan_in < fan_out THEN fan_in ELSE fan_out END DESC, i.id) AS rn FROM (SELECT graph_id, tgt AS id, COUNT(*) AS fan_in FROM edges WHERE type = 'FUNCTION_CALL' GROUP BY graph_id, tgt) i JOIN (SELECT graph_id, src AS id, COUNT(*) AS fan_out FROM edges WHERE type = 'FUNCTION_CALL' GROUP BY graph_id, src) o ON o.graph_id = i.graph_id AND o.id = i.id WHERE fan_in >= 3 AND fan_out >= 3) x WHERE rn <= 15",
    "g8_node_search": "SELECT id, name FROM nodes WHERE LOWER(name) LIKE '%user%' OR LOWER(COALESCE(comment, '')) LIKE '%user%' ORDER BY id LIMIT 10",
    "g9_edge_visibility": "SELECT edge_identifier, CASE WHEN type IN ('IMPORT', 'FUNCTION_CALL') THEN src_path NOT LIKE '%/test/%' AND tgt_path NOT LIKE '%/test/%' WHEN type LIKE 'DB%' THEN TRUE ELSE FALSE END AS visible FROM ends",
    "g10_node_budget": "SELECT n.id, n.type <> 'FUNCTION' OR h.id IS NOT NULL AS visible FROM nodes n LEFT JOIN (SELECT i.graph_id, i.id FROM (SELECT graph_id, tgt AS id, COUNT(*) AS fan_in FROM edges WHERE type = 'FUNCTION_CALL' GROUP BY graph_id, tgt) i JOIN (SELECT graph_id, src AS id, COUNT(*) AS fan_out FROM edges WHERE type = 'FUNCTION_CALL' GROUP BY graph_id, src) o ON o.graph_id = i.graph_id AND o.id = i.id WHERE fan_in >= 3 AND fan_out >= 3) h ON h.graph_id = n.graph_id AND h.id = n.id",
    "g25_context_subgraph": "SELECT e.edge_identifier FROM edges e JOIN (SELECT graph_id, id FROM (SELECT graph_id, id, type, ROW_NUMBER() OVER (PARTITION BY graph_id, CASE WHEN type IN ('FILE', 'FUNCTION') THEN 1 ELSE 0 END ORDER BY type, ord) AS rn FROM nodes) x WHERE rn <= 50 OR type IN ('DB_TABLE', 'API_ENDPOINT')) a ON a.graph_id = e.graph_id AND a.id = e.src JOIN (SELECT graph_id, id FROM (SELECT graph_id, id, type, ROW_NUMBER() OVER (PARTITION BY graph_id, CASE WHEN type IN ('FILE', 'FUNCTION') THEN 1 ELSE 0 END ORDER BY type, ord) AS rn FROM nodes) x WHERE rn <= 50 OR type IN ('DB_TABLE', 'API_ENDPOINT')) b ON b.graph_id = e.graph_id AND b.id = e.tgt",
    "g26_hidden_filter": "SELECT edge_identifier FROM ends WHERE src_path NOT LIKE '%/controller/%' AND tgt_path NOT LIKE '%/controller/%' AND src_name NOT LIKE '%Helper' AND tgt_name NOT LIKE '%Helper'",
    "g27_edge_sample": "SELECT type, edge_identifier, rn FROM (SELECT type, edge_identifier, ROW_NUMBER() OVER (PARTITION BY type ORDER BY MD5('42|' || edge_identifier), edge_identifier) AS rn FROM edges) x WHERE rn <= 30",
    "g28_audit_precision": "SELECT type, n, phantom, phantom / n AS rate, ROUND(GREATEST(0, (phantom / n + 1.9208 / n - 1.96 * SQRT((phantom / n * (1 - phantom / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n)), 12) AS low, ROUND(LEAST(1, (phantom / n + 1.9208 / n + 1.96 * SQRT((phantom / n * (1 - phantom / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n)), 12) AS high FROM (SELECT type, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN ord % 13 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS phantom FROM edges GROUP BY type) x",
    "g33_entry_points": "SELECT graph_id, id, pos FROM (SELECT n.graph_id, n.id, ROW_NUMBER() OVER (PARTITION BY n.graph_id ORDER BY CASE n.type WHEN 'API_ENDPOINT' THEN 0 ELSE 1 END, n.ord) AS pos FROM nodes n LEFT JOIN (SELECT DISTINCT graph_id, tgt FROM ends WHERE type = 'FUNCTION_CALL' AND src_path <> tgt_path) c ON c.graph_id = n.graph_id AND c.tgt = n.id WHERE n.type = 'API_ENDPOINT' OR (n.type = 'FUNCTION' AND c.tgt IS NULL)) x WHERE pos <= 15",
    "g34_file_calls": "SELECT graph_id, src_path, tgt_path, COUNT(*) AS n, MIN(src_name) AS first_caller FROM ends WHERE type = 'FUNCTION_CALL' AND src_path <> tgt_path GROUP BY graph_id, src_path, tgt_path",
    "g35_callers_callees": "SELECT src AS id, 'callee' AS side, tgt AS other, tgt_path AS file FROM ends WHERE type = 'FUNCTION_CALL' AND src_path <> tgt_path UNION ALL SELECT tgt, 'caller', src, src_path FROM ends WHERE type = 'FUNCTION_CALL' AND src_path <> tgt_path",
    "g36_table_access": "SELECT graph_id, tgt, src, MAX(CASE WHEN type = 'DB_READ' THEN 1 ELSE 0 END) AS r, MAX(CASE WHEN type = 'DB_WRITE' THEN 1 ELSE 0 END) AS w, MAX(CASE WHEN type = 'DB_CREATE' THEN 1 ELSE 0 END) AS c, MAX(CASE WHEN type = 'DB_UPDATE' THEN 1 ELSE 0 END) AS u, MAX(CASE WHEN type = 'DB_DELETE' THEN 1 ELSE 0 END) AS d FROM edges WHERE type LIKE 'DB%' GROUP BY graph_id, tgt, src",
    "g39_typed_edges": "SELECT e.edge_identifier, CASE WHEN s.id IS NULL OR t.id IS NULL THEN 'dangling' WHEN e.type = 'IMPORT' AND s.type = 'FILE' AND t.type = 'FILE' THEN 'ok' WHEN e.type = 'FUNCTION_CALL' AND s.type = 'FUNCTION' AND t.type = 'FUNCTION' THEN 'ok' WHEN e.type LIKE 'DB%' AND t.type = 'DB_TABLE' THEN 'ok' WHEN e.type IN ('API_CALL', 'SERVICE_CALL', 'FIELD_DEPENDENCY') AND s.type = 'FILE' THEN 'ok' ELSE 'mismatch' END AS state FROM edges e LEFT JOIN (SELECT * FROM nodes WHERE ord % 9 <> 0) s ON s.graph_id = e.graph_id AND s.id = e.src LEFT JOIN (SELECT * FROM nodes WHERE ord % 9 <> 0) t ON t.graph_id = e.graph_id AND t.id = e.tgt WHERE e.src <> e.tgt",
    "g40_node_counts": "SELECT graph_id, SUM(CASE WHEN type = 'FILE' THEN 1 ELSE 0 END) AS files, SUM(CASE WHEN type = 'FUNCTION' THEN 1 ELSE 0 END) AS functions, SUM(CASE WHEN type = 'DB_TABLE' THEN 1 ELSE 0 END) AS db_tables, SUM(CASE WHEN type = 'API_ENDPOINT' THEN 1 ELSE 0 END) AS endpoints FROM nodes GROUP BY graph_id",
    "g24_undocumented_hot": "SELECT graph_id, id, n, rn FROM (SELECT f.graph_id, f.id, c.n, ROW_NUMBER() OVER (PARTITION BY f.graph_id ORDER BY c.n DESC, f.id) AS rn FROM nodes f JOIN (SELECT graph_id, src, COUNT(*) AS n FROM edges WHERE type = 'FUNCTION_CALL' GROUP BY graph_id, src HAVING COUNT(*) > 3) c ON c.graph_id = f.graph_id AND c.src = f.id WHERE f.type = 'FUNCTION' AND f.comment IS NULL) x WHERE rn <= 15",
    "g15_path_enrichment": "SELECT e.edge_identifier, e.src_name || ' @ ' || e.src_path AS step, CASE WHEN e.src_path LIKE '%/domain/%' THEN 'domain' WHEN e.src_path LIKE '%/application/%' THEN 'application' WHEN e.src_path LIKE '%/infrastructure/%' THEN 'infrastructure' WHEN e.src_path LIKE '%/interfaces/%' THEN 'interfaces' ELSE 'other' END AS layer FROM ends e WHERE e.type = 'FUNCTION_CALL'",
    "g14_frontend_entry": "SELECT f.graph_id, f.id, a.src FROM nodes f JOIN (SELECT graph_id, tgt_path, MIN(src) AS src FROM ends WHERE type = 'API_CALL' GROUP BY graph_id, tgt_path) a ON a.graph_id = f.graph_id AND a.tgt_path = f.file_path WHERE f.type = 'FUNCTION'",
    "e19_edge_dedup": "SELECT graph_id, type, src, tgt, o FROM (SELECT graph_id, type, src, tgt, o, ROW_NUMBER() OVER (PARTITION BY graph_id, type, src, tgt ORDER BY o) AS rn FROM edge0) x WHERE rn = 1",
    "s15_graph_scan": "SELECT edge_identifier FROM edges WHERE graph_id = 1",
    "s14_graph_delete": "SELECT n.id FROM nodes n LEFT JOIN (SELECT DISTINCT graph_id FROM nodes WHERE graph_id % 4 = 0) d ON d.graph_id = n.graph_id WHERE d.graph_id IS NULL",
    "s6_tiered_selection": "SELECT graph_id, id, rn FROM (SELECT graph_id, id, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY CASE WHEN ord % 10 = 0 THEN 0 WHEN file_path LIKE '%/test/%' THEN 2 ELSE 1 END, file_path) AS rn FROM nodes WHERE type = 'FILE') x WHERE rn <= 500",
    "s7_round_robin": "SELECT graph_id, id, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY rn, ctx) AS pos FROM (SELECT n.graph_id, n.id, f.ctx, ROW_NUMBER() OVER (PARTITION BY n.graph_id, f.ctx ORDER BY n.file_path) AS rn FROM nodes n JOIN files f ON f.k = n.ord WHERE n.type = 'FILE') x",
    "s5_prefix_scope": "SELECT id FROM nodes WHERE type = 'FILE' AND (file_path = 'src/main' OR file_path LIKE 'src/main/%')",
    "s9_incremental_parse": "SELECT n.id, CASE WHEN c.id IS NULL THEN 'miss' ELSE 'hit' END AS state FROM nodes n LEFT JOIN (SELECT id, MD5(file_path) AS h FROM nodes WHERE ord % 3 <> 0) c ON c.id = n.id AND c.h = MD5(n.file_path) WHERE n.type = 'FILE'",
    "w12_unanalysed_changes": "SELECT n.graph_id, COUNT(*) AS n FROM nodes n LEFT JOIN (SELECT graph_id, id FROM nodes WHERE ord % 5 <> 0) a ON a.graph_id = n.graph_id AND a.id = n.id WHERE n.type = 'FILE' AND n.ord % 2 = 0 AND a.id IS NULL GROUP BY n.graph_id",
}

# Over the given tables.
TABLES = {
    "a1_daily_metrics": "SELECT CAST(ts AS DATE) AS day, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS new_users, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS payments, COUNT(*) AS total, COUNT(DISTINCT user_id) AS active FROM {events} GROUP BY 1",
    "a2_open_backlog": "SELECT COUNT(*) AS n FROM {orders} WHERE o_orderstatus = 'O'",
    "a3_largest_tables": "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10",
    "a4_gate_metrics": "SELECT COUNT(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN user_id END) AS d30, COUNT(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN user_id END) AS d7, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS blocked FROM {events}",
    "a5_fp_free_rate": "SELECT quality, CASE WHEN COUNT(*) = 0 THEN 100 ELSE CAST(FLOOR((COUNT(*) - SUM(toxic)) * 100.0 / COUNT(*) + 0.5) AS INT) END AS rate FROM {labels} GROUP BY 1",
    "a6_failure_anomaly": "SELECT user_id, COUNT(*) AS n, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM {events} GROUP BY 1 HAVING COUNT(*) >= 5 AND SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 5 >= COUNT(*)",
    "a7_day_over_day": "SELECT event_type, quarter, day, n, prev FROM (SELECT event_type, quarter, day, n, CASE WHEN LAG(day) OVER (PARTITION BY event_type, quarter ORDER BY day) = day - 1 THEN LAG(n) OVER (PARTITION BY event_type, quarter ORDER BY day) END AS prev FROM (SELECT event_type, FLOOR(HOUR(ts) / 6.0) AS quarter, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} GROUP BY 1, 2, 3) x) y WHERE prev >= 10 AND ABS(n - prev) * 100 >= 50 * prev",
    "a8_threshold_anomalies": "SELECT event_type, n FROM (SELECT event_type, COUNT(*) AS n FROM {events} GROUP BY 1) x WHERE n >= 20",
    "a9_latest_two": "SELECT day, n, rn FROM (SELECT day, n, ROW_NUMBER() OVER (ORDER BY day DESC) AS rn FROM (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} GROUP BY 1) x) y WHERE rn <= 2",
    "a10_snapshot_upsert": "SELECT COALESCE(b.day, a.day) AS day, COALESCE(b.n, a.n) AS n FROM (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} WHERE event_type = 'view' GROUP BY 1) a FULL OUTER JOIN (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) b ON a.day = b.day",
    "a11_trip_counter": "SELECT event_type, HOUR(ts) AS h, COUNT(*) AS n FROM {events} GROUP BY 1, 2",
    "a12_distinct_ids": "SELECT DISTINCT l_suppkey FROM {lineitem}",
    "a13_batch_counts": "SELECT o_orderkey, COALESCE(c, 0) AS likes FROM {orders} LEFT JOIN (SELECT l_orderkey, COUNT(*) AS c FROM {lineitem} GROUP BY 1) x ON l_orderkey = o_orderkey",
    "a14_seat_sum": "SELECT s_suppkey, COALESCE(q, 0) AS seats, COALESCE(q, 0) <= 30 AS ok FROM {supplier} LEFT JOIN (SELECT l_suppkey, SUM(l_linenumber) AS q FROM {lineitem} WHERE l_quantity > 45 GROUP BY 1) x ON l_suppkey = s_suppkey",
    "a15_max_priority": "SELECT o_custkey, MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS top FROM {orders} GROUP BY 1",
    "a16_follow_counts": "SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.n, 0) AS followers, COALESCE(b.n, 0) AS following FROM (SELECT l_suppkey AS k, COUNT(*) AS n FROM {lineitem} WHERE l_linenumber = 1 GROUP BY 1) a FULL OUTER JOIN (SELECT l_partkey AS k, COUNT(*) AS n FROM {lineitem} WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k",
    "a17_conditional_counts": "SELECT c_nationkey, SUM(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS private_n, SUM(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) AS members FROM {customer} GROUP BY 1",
    "a18_platform_totals": "SELECT u, p, a FROM (SELECT COUNT(*) AS u FROM {customer}) x CROSS JOIN (SELECT COUNT(*) AS p FROM {part}) y CROSS JOIN (SELECT COUNT(*) AS a FROM {orders}) z",
    "j1_feed_by_likes": "SELECT o_orderkey, rn FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY COALESCE(c, 0) DESC, o_orderdate DESC, o_orderkey) AS rn FROM {orders} LEFT JOIN (SELECT l_orderkey, COUNT(*) AS c FROM {lineitem} GROUP BY 1) x ON l_orderkey = o_orderkey) y WHERE rn <= 100",
    "j2_feed_paged": "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "j3_posts_with_graph": "SELECT o_orderkey FROM {orders} o WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 48)",
    "j4_text_search": "SELECT doc_id FROM {documents} WHERE LOWER(text) LIKE '%tion the%' OR LOWER(source) LIKE '%src1'",
    "j5_following_feed": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 3)",
    "j6_visible_posts": "SELECT o_orderkey FROM {orders} WHERE o_orderstatus <> 'P' OR o_custkey = 7",
    "j7_feed_assembly": "SELECT o_orderkey, COALESCE(n, 0) AS comments, COALESCE(c_name, 'unknown') AS author, o_custkey = 5 AS own, COALESCE(q, 0) > 40 AS has_graph FROM {orders} LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, MAX(l_quantity) AS q FROM {lineitem} GROUP BY 1) x ON l_orderkey = o_orderkey LEFT JOIN {customer} ON c_custkey = o_custkey",
    "j8_bookmarks": "SELECT b.l_partkey, p_name, rn FROM (SELECT l_partkey, ROW_NUMBER() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM {lineitem}) b JOIN {part} ON p_partkey = b.l_partkey WHERE rn <= 50",
    "j9_thread": "SELECT LEAST(a, b) AS one, GREATEST(a, b) AS two, o AS message, a AS sender, ROW_NUMBER() OVER (PARTITION BY LEAST(a, b), GREATEST(a, b) ORDER BY t DESC, o) AS pos FROM (SELECT o_orderkey AS o, o_custkey % 40 AS a, o_orderkey % 40 AS b, o_orderdate AS t FROM {orders}) m WHERE a <> b",
    "j10_inbox_latest": "SELECT conv_id, role, turn FROM (SELECT conv_id, role, turn, ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM {conversations}) x WHERE rn = 1",
    "j11_unread": "SELECT conv_id, SUM(CASE WHEN role = 'user' AND turn > 2 THEN 1 ELSE 0 END) AS unread FROM {conversations} GROUP BY 1",
    "j12_top_notifications": "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM {events}) x WHERE rn <= 30",
    "j13_rotation": "SELECT c_custkey FROM {customer} LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS d FROM {orders} GROUP BY 1) x ON o_custkey = c_custkey ORDER BY d ASC NULLS FIRST, c_custkey LIMIT 25",
    "j14_recent_featured": "SELECT c_custkey, d FROM {customer} JOIN (SELECT o_custkey, MAX(o_orderdate) AS d FROM {orders} GROUP BY 1) x ON o_custkey = c_custkey ORDER BY d DESC, c_custkey LIMIT 25",
    "j15_needs_reanalysis": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders} WHERE o_orderstatus = 'F') x ON o_custkey = c_custkey AND rn = 1 WHERE o_orderkey IS NULL OR o_orderkey % 2 = 0",
    "j16_url_match": "SELECT page_id, MIN(page_id) OVER (PARTITION BY REGEXP_REPLACE(LOWER(CASE WHEN page_id % 2 = 0 THEN u ELSE u || '.git' END), '[.]git$', '')) AS same_as FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN UPPER(REGEXP_REPLACE(url, '[?].*$', '')) ELSE REGEXP_REPLACE(url, '[0-9]*[?].*$', '') END AS u FROM {pages}) p",
    "j17_team_access": "SELECT DISTINCT o_orderkey FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey WHERE n_regionkey = 2",
    "j18_allocated_latest": "SELECT c_nationkey, c_custkey, o_orderkey FROM {customer} JOIN (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}) x ON o_custkey = c_custkey WHERE rn = 1",
    "j19_stale_analyses": "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15' THEN 'FAILED' ELSE event_type END AS status FROM {events}",
    "j20_lost_events": "SELECT event_id FROM {events} e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' AND event_type NOT IN ('purchase', 'error')",
    "j21_rank_backfill": "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS priority FROM {orders}",
    "j22_preset_default": "SELECT p_partkey, COALESCE(MAX(CASE WHEN l_linenumber = 7 THEN l_returnflag END), 'default') AS preset FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey GROUP BY 1",
    "j23_user_search": "SELECT c_custkey FROM {customer} WHERE LOWER(c_name) LIKE '%7%' ORDER BY c_custkey LIMIT 10",
    "j24_profile_lists": "SELECT o_custkey, o_orderkey FROM {orders} WHERE o_custkey = 11 OR o_orderstatus = 'P'",
    "j25_child_lists": "SELECT l_orderkey, l_partkey, pos FROM (SELECT l_orderkey, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM {lineitem}) x WHERE pos <= 3",
    "g4_latest_graph": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) x WHERE rn = 1",
    "g5_retention": "SELECT o_orderkey FROM (SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders} WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 49)) x WHERE rn > 3",
    "g6_pin_slot": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_orderstatus = 'P' THEN 2 ELSE o_orderkey % 5 END AS slot FROM {orders}",
    "k1_rate_limit": "SELECT event_id, rn <= 2 AS allowed FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id, event_type, bucket, win ORDER BY t, event_id) AS rn FROM (SELECT *, FLOOR((t - MIN(t) OVER (PARTITION BY user_id, event_type, bucket)) / 3600) AS win FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS bucket FROM (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) <= 86400 THEN 0 ELSE 1 END AS fresh FROM (SELECT event_id, user_id, event_type, CAST(EXTRACT(EPOCH FROM ts) AS BIGINT) AS t FROM {events}) a) b) c) d) e",
    "k5_notification_fanout": "SELECT e.event_id, s.n_nationkey AS recipient FROM {events} e JOIN {nation} s ON s.n_nationkey = e.user_id % 25 WHERE NOT (e.event_type IN ('click', 'view') AND e.user_id % 25 = e.event_id % 25)",
    "k6_daily_active": "SELECT CAST(last_ts AS DATE) AS day, COUNT(*) AS n FROM (SELECT user_id, MAX(ts) AS last_ts FROM {events} GROUP BY 1) x GROUP BY 1",
    "k4_concurrent": "SELECT event_id, run - LEAST(0, MIN(run) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS open_n FROM (SELECT event_id, user_id, ts, SUM(CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM {events}) x",
    "s8_content_hash": "SELECT page_id, SHA256(html) AS h FROM {pages}",
    "s10_insert_ignore": "SELECT doc_id, 'old' AS origin FROM {documents} WHERE doc_id % 3 = 0 UNION ALL SELECT d.doc_id, 'new' FROM {documents} d LEFT JOIN (SELECT doc_id FROM {documents} WHERE doc_id % 3 = 0) o ON o.doc_id = d.doc_id WHERE o.doc_id IS NULL",
    "s11_cache_ttl": "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-15'",
    "w10_gate_by_pr": "SELECT o_custkey, SUM(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) AS high_count, CASE WHEN SUM(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) > 0 THEN 'failure' ELSE 'success' END AS state FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1",
    "w16_fp_reports": "SELECT l_suppkey, l_partkey, MIN(l_orderkey) AS first_report FROM {lineitem} GROUP BY 1, 2",
    "w17_rule_audit": "SELECT k, 'REMOVE' AS op FROM (SELECT l_partkey AS k FROM {lineitem} WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_linenumber = 7 AND l_quantity > 25) a UNION ALL SELECT k, 'ADD' FROM (SELECT l_partkey AS k FROM {lineitem} WHERE l_linenumber = 7 AND l_quantity > 25 EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_linenumber = 1) b",
}
# Names that differ between the engines.
_DIALECT = {"SHA256(html)": "SHA2(html, 256)", "CAST(EXTRACT(EPOCH FROM ts) AS BIGINT)": "UNIX_SECONDS(CAST(ts AS TIMESTAMP))"}


def _spark_text(text: str) -> str:
    for duck, spark in _DIALECT.items():
        text = text.replace(duck, spark)
    return text


def _over_tables(text: str):
    return lambda spark, sf_dir: G.spark_sql(spark, sf_dir, _spark_text(text))


def _over_graph(text: str):
    def run(spark, sf_dir):
        n, e = G.nodes(spark, sf_dir), G.edges(spark, sf_dir)
        views = {"nodes": n, "edges": e}
        extra = ""
        if "ends" in text:
            extra = "WITH ends AS (SELECT e.*, a.name AS src_name, a.file_path AS src_path, b.name AS tgt_name, b.file_path AS tgt_path FROM {edges} e JOIN {nodes} a ON a.id = e.src AND a.graph_id = e.graph_id JOIN {nodes} b ON b.id = e.tgt AND b.graph_id = e.graph_id) "
        if " files " in text or " edge0)" in text:
            return G.spark_sql(spark, sf_dir, f"WITH {G.BASE} {text}")
        body = extra + _named(text)
        return spark.sql(body, **{k: v for k, v in views.items() if "{" + k + "}" in body})

    return run


def _named(text: str) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (nodes|edges)\b", r"\1 {\2}", text)


def _graph(f):
    return lambda spark, sf_dir: f(G.nodes(spark, sf_dir), G.edges(spark, sf_dir))


def _of_nodes(f):
    """A query of the nodes alone, for which no edges are built."""
    return lambda spark, sf_dir: f(G.nodes(spark, sf_dir))


def _table(f, *names):
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names))


def _latest():
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


def _old(rows):
    return rows.where("ord % 10 <> 0")


def _new(rows):
    return rows.where("ord % 10 <> 1")


def _edge_diff(n, e):
    ends = S.with_ends(n, e)
    return S.edge_diff(_old(ends), _new(ends))


def _expired(orders, lines):
    versions = orders.withColumn("pinned", F.col("o_orderstatus") == "P")
    return feeds.expired(versions, lines.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", ["o_custkey"], _latest()).select("o_orderkey")


def _changes(events):
    days = events.groupBy("event_type", F.floor(F.hour("ts") / 6).alias("quarter"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return feeds.daily_changes(days, ["event_type", "quarter"])


def _snapshots(events):
    days = lambda rows: rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return feeds.upsert(days(events.where("event_type = 'view'")), days(events.where("ts >= TIMESTAMP '2024-01-20'")), ["day"])


def _messages(orders):
    return feeds.threads(orders.selectExpr("o_orderkey AS message", "o_custkey % 40 AS sender", "o_orderkey % 40 AS receiver", "o_orderdate AS at"))


def _limited(events):
    requests = events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "ts")
    return limits.rate_limit_batch(requests, 2, 3600, 86400).select("event_id", "allowed")


#: Requests that events stand for.
_REQUESTS = {"click": ("POST", "/api/analyses"), "view": ("POST", "/api/cron/daily-digest"), "purchase": ("POST", "/api/admin/digest/run"), "error": ("POST", "/api/cron/refresh-featured"), "signup": ("GET", "/api/projects/7/graph")}


def _routed(events):
    part = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, v[i]) for k, v in _REQUESTS.items()], F.lit("/"))
    requests = events.select("event_id", "ts", part(0).alias("method"), part(1).alias("path"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("spoof, "), (F.col("user_id") % 4).cast("string"))).alias("forwarded"), (F.col("user_id") % 4).cast("string").alias("remote"))
    return limits.rate_limit_batch(limits.routed(requests)).select("event_id", "key", "allowed")


def _connected(events):
    action = F.when(F.col("event_type").isin("signup", "click", "view"), "connect").when(F.col("event_type") == "error", "disconnect").otherwise("ping")
    return limits.connections_batch(events.select((F.col("user_id") % 3).alias("key"), "event_id", "ts", action.alias("action")), 30, "1 day").select("event_id", "open_n", "allowed")


def _cache(n):
    files = n.where("type = 'FILE'").select(F.col("graph_id").alias("project_id"), "file_path", F.md5("file_path").alias("content_hash"), "id", "ord")
    return store.cache_state(files, files.where("ord % 3 <> 0").withColumn("analyzer_version", F.lit(10)), 10).select("id", "state")


_FUNCTIONS = {
    "k1_rate_limit": _table(_limited, "events"),
    "k1_request_rules": _table(_routed, "events"),
    "k4_connections": _table(_connected, "events"),
    "k6_daily_active": _table(lambda e: limits.daily_active(e), "events"),
    "s9_incremental_parse": _of_nodes(_cache),
    "g1_node_diff": _of_nodes(lambda n: S.node_diff(_old(n), _new(n), ["id", "type", "name", "file_path"]).select("id", "status")),
    "g2_edge_diff": _graph(_edge_diff),
    "g3_diff_summary": _of_nodes(lambda n: S.diff_summary(S.node_diff(_old(n), _new(n), ["id"]))),
    "g4_latest_graph": _table(lambda o: feeds.newest(o, ["o_custkey"], _latest()).select("o_custkey", "o_orderkey", "rn"), "orders"),
    "g5_retention": _table(_expired, "orders", "lineitem"),
    "g7_complexity_hubs": _graph(lambda n, e: S.top_hubs(e)),
    "g8_node_search": _of_nodes(lambda n: S.search(n, "user").select("id", "name")),
    "g10_node_budget": _graph(lambda n, e: S.node_budget(n, e).select("id", "visible")),
    "g24_undocumented_hot": _graph(lambda n, e: S.undocumented_hot(n, e)),
    "g25_context_subgraph": _graph(lambda n, e: S.summary_edges(n, e).select("edge_identifier")),
    "g27_edge_sample": _graph(lambda n, e: S.edge_sample(e)),
    "g28_audit_precision": _graph(lambda n, e: S.audit_precision(e.select("type", (F.col("ord") % 13 == 0).alias("phantom"))).withColumns({c: F.round(c, 12) for c in ("low", "high")})),
    "g33_entry_points": _graph(lambda n, e: S.entry_points(n, S.with_ends(n, e))),
    "g34_file_calls": _graph(lambda n, e: S.file_calls(S.with_ends(n, e))),
    "g35_callers_callees": _graph(lambda n, e: S.callers_callees(S.with_ends(n, e))),
    "g36_table_access": _graph(lambda n, e: S.table_access(e)),
    "g39_typed_edges": _graph(lambda n, e: S.typed_edges(n.where("ord % 9 <> 0"), e)),
    "g40_node_counts": _of_nodes(lambda n: S.node_counts(n)),
    "a6_failure_anomaly": _table(lambda e: feeds.failure_anomalies(e, "user_id", F.col("event_type") == "error"), "events"),
    "a7_day_over_day": _table(_changes, "events"),
    "a10_snapshot_upsert": _table(_snapshots, "events"),
    "j1_feed_by_likes": _table(lambda o, l: feeds.feed_by_count(o, l.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100).select("o_orderkey", "rn"), "orders", "lineitem"),
    "j9_thread": _table(_messages, "orders"),
    "j10_inbox_latest": _table(lambda c: feeds.newest(c, ["conv_id", "role"], [F.col("turn").desc()]).select("conv_id", "role", "turn"), "conversations"),
    "j12_top_notifications": _table(lambda e: feeds.newest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id")], 30).select("user_id", "event_id"), "events"),
    "j18_allocated_latest": _table(lambda o, c: feeds.newest(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_custkey", "o_orderkey"), "orders", "customer"),
    "j25_child_lists": _table(lambda l: feeds.newest(l, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3, "pos").select("l_orderkey", "l_partkey", "pos"), "lineitem"),
}


# SQL of queries that are functions alone.
_SQL = {
    # whole seconds count, as the query's documentation says: a cast would round them
    "k1_request_rules": """WITH r AS (SELECT event_id, CAST(FLOOR(EXTRACT(EPOCH FROM ts)) AS BIGINT) AS t, user_id % 4 AS a, CASE event_type WHEN 'click' THEN 'analysis' WHEN 'view' THEN 'cron-digest' WHEN 'purchase' THEN 'admin-digest-run' WHEN 'error' THEN 'cron-refresh' WHEN 'signup' THEN 'graph-read' END AS c FROM {events}),
q AS (SELECT *, a || ':' || c AS key, CASE c WHEN 'analysis' THEN 1 WHEN 'cron-refresh' THEN 2 WHEN 'graph-read' THEN 30 ELSE 5 END AS most, CASE c WHEN 'analysis' THEN 180 WHEN 'graph-read' THEN 60 ELSE 3600 END AS width FROM r WHERE c IS NOT NULL),
g AS (SELECT *, CASE WHEN t - LAG(t) OVER (PARTITION BY key ORDER BY t, event_id) <= 600 THEN 0 ELSE 1 END AS fresh FROM q), b AS (SELECT *, SUM(fresh) OVER (PARTITION BY key ORDER BY t, event_id) AS run FROM g),
w AS (SELECT *, (t - MIN(t) OVER (PARTITION BY key, run)) // width AS win FROM b) SELECT event_id, key, ROW_NUMBER() OVER (PARTITION BY key, run, win ORDER BY t, event_id) <= most AS allowed FROM w""",
    # one event after the other
    "k4_connections": """WITH RECURSIVE e AS (SELECT user_id % 3 AS k, event_id, ROW_NUMBER() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS i, CASE WHEN event_type IN ('signup', 'click', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS a FROM {events}),
s AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, TRUE AS ok FROM e GROUP BY k
  UNION ALL SELECT e.k, e.i, e.event_id, CASE WHEN a = 1 AND n < 30 THEN n + 1 WHEN a = -1 THEN GREATEST(0, n - 1) ELSE n END, a <> 1 OR n < 30 FROM s JOIN e ON e.k = s.k AND e.i = s.i + 1)
SELECT event_id, n AS open_n, ok AS allowed FROM s WHERE i > 0""",
}


def queries() -> dict:
    return {k: _over_graph(v) for k, v in GRAPH.items()} | {k: _over_tables(v) for k, v in TABLES.items()} | _FUNCTIONS


def oracle_sql() -> dict[str, str]:
    return {k: G.oracle(v) for k, v in GRAPH.items()} | {k: G.duck(v) for k, v in (TABLES | _SQL).items()}
