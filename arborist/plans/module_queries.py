"""Queries of groupings, candidate modules, maps and eligibility over the derived code graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborist.functions import paths as P
from arborist.operators import modules as M
from arborist.operators import traversal as T
from arborist.sources import files as S
from arborist.sources import store

from . import rule_queries as R
from . import source_queries, walk_queries
from . import testgraph as G


def _labels(spark, sf_dir):
    return G.once(spark, sf_dir, "footprints", lambda: walk_queries._footprints(spark, sf_dir))


def _shared(spark, sf_dir):
    return T.shared_labels(_labels(spark, sf_dir))


def _clusters(spark, sf_dir):
    return M.clusters(_labels(spark, sf_dir))


def _candidates(spark, sf_dir):
    return M.candidate_modules(M.told_clusters(_labels(spark, sf_dir)), _labels(spark, sf_dir), G.nodes(spark, sf_dir))


def _groups(spark, sf_dir):
    n = G.nodes(spark, sf_dir)
    return n.where("type = 'FILE'").join(M.common_prefix(n), "graph_id").select("graph_id", "id", M.layer_of(F.col("file_path")).alias("layer"), M.group_key(F.col("file_path"), F.col("prefix")).alias("grp"))


def _owners(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", r"//([^./]+)\.", 1)
    url = F.concat(F.lit("https://github.com/"), F.upper(host), F.lit("/repo"))
    return pages.select("page_id", M.owner_matches(url, F.when(F.col("page_id") % 3 == 0, host).when(F.col("page_id") % 3 == 1, F.lit("someone"))).alias("owned"))


def _eligible(spark, sf_dir):
    f = source_queries.sources(spark, sf_dir).select("graph_id", F.when(F.length("file_path") % 5 == 0, F.concat(F.lit("build/"), "file_path")).when(F.length("file_path") % 5 == 1, F.regexp_replace("file_path", r"\.([a-z]+)$", ".min.$1")).otherwise(F.col("file_path")).alias("file_path"), F.octet_length("content").alias("length"))
    return f.where((F.col("length") <= S.MAX_BYTES) & S.eligible(F.col("file_path"))).select("graph_id", "file_path")


def _codec(spark, sf_dir):
    f = source_queries._of(spark, sf_dir).columns.drop("line")
    return store.decode(store.encode(f, "graph_id", "file_path"), "field_name string, column_name string, java_type string, has_converter boolean", "graph_id", "file_path")


def _domains(spark, sf_dir):
    """Every third file is renamed after something that may be a domain of its graph."""
    return M.domains(G.nodes(spark, sf_dir).withColumn("file_path", F.expr(f"CASE WHEN type = 'FILE' THEN {_RENAMED} ELSE file_path END"))).where("NOT startswith(file_path, 'db/')")


_RENAMED = "REGEXP_REPLACE(file_path, '/F[0-9]*[02][A-Za-z]*([.][a-z]+)$', CASE ord % 5 WHEN 0 THEN '/OrdersController' WHEN 1 THEN '/CreateItemModal' WHEN 2 THEN '/user_cart' WHEN 3 THEN '/billing-run' ELSE '/Carts' END || '.x')"

QUERIES = {
    "g17_shared_labels": _shared, "g18_overlap_clusters": _clusters, "g19_candidate_modules": _candidates, "g20_structure_gate": lambda s, d: M.structure_gate(G.nodes(s, d)), "p12_layer_group": _groups,
    "p13_common_prefix": lambda s, d: M.common_prefix(G.nodes(s, d)), "p14_domain": _domains, "p15_owner_match": _owners, "g21_folder_map": lambda s, d: M.folder_map(G.nodes(s, d)), "g22_context_map": lambda s, d: M.context_map(G.nodes(s, d)),
    "g23_context_specs": lambda s, d: M.context_specs(G.nodes(s, d), G.edges(s, d)), "g38_layer_tab": lambda s, d: M.in_tab(G.nodes(s, d), "application").select("id"), "s3_s4_eligible": _eligible, "s12_fact_codec": _codec,
    "s16_markdown": lambda s, d: store.markdown(R._warnings(s, d)[0]).select("graph_id", F.sha2("report", 256).alias("digest")),
}

_SHARED = """, sh AS (SELECT graph_id, label, COUNT(DISTINCT endpoint) AS n FROM lb GROUP BY 1, 2), tt AS (SELECT graph_id, COUNT(DISTINCT endpoint) AS t FROM lb GROUP BY 1),
common AS (SELECT sh.graph_id, label, n FROM sh JOIN tt USING (graph_id) WHERE n >= GREATEST(CEIL(t * 0.5), 3))"""
_LB = walk_queries.SQL["g16_endpoint_footprint"]
_CLUSTER = """, rare AS (SELECT DISTINCT lb.* FROM lb WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.graph_id = lb.graph_id AND c.label = lb.label)),
lk AS (SELECT a.graph_id, a.endpoint AS x, b.endpoint AS y FROM rare a JOIN rare b ON a.graph_id = b.graph_id AND a.label = b.label AND a.endpoint <> b.endpoint GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2),
cw AS (SELECT DISTINCT graph_id, endpoint AS x, endpoint AS y FROM lb UNION SELECT cw.graph_id, cw.x, lk.y FROM cw JOIN lk ON lk.graph_id = cw.graph_id AND lk.x = cw.y),
cc AS (SELECT graph_id, x AS endpoint, MIN(y) AS cluster FROM cw GROUP BY 1, 2)"""
_at = _LB.rindex("SELECT DISTINCT w.graph_id")
_FOOT = _LB[:_at].rstrip() + ", lb AS (" + _LB[_at:] + ")"
_PLAIN = f"NOT {R._test('file_path', 'name')}"
_CTXMAP = f", {R.CONTEXTS}, pl AS (SELECT graph_id, file_path, COALESCE(fn_context, '(none)') AS context FROM nc WHERE type = 'FILE' AND {_PLAIN}), cx AS (SELECT graph_id, context, ROW_NUMBER() OVER (PARTITION BY graph_id, context ORDER BY file_path) AS pos, file_path FROM pl WHERE graph_id IN (SELECT graph_id FROM pl WHERE context <> '(none)'))"
_LAYERS = "('" + "', '".join(M.LAYERS) + "')"
_S = "string_split(file_path, '/')"
_PREFIX = """, f AS (SELECT graph_id, string_split(file_path, '/') AS s FROM nodes WHERE type = 'FILE'), c AS (SELECT graph_id, UNNEST(range(1, 6)) AS d FROM (SELECT DISTINCT graph_id FROM f)),
ok AS (SELECT c.graph_id, d, MIN(array_to_string(s[1:d], '/')) AS p FROM c JOIN f USING (graph_id) GROUP BY 1, 2 HAVING COUNT(DISTINCT array_to_string(s[1:d], '/')) = 1 AND MIN(len(s)) > d),
px AS (SELECT g.graph_id, COALESCE(arg_max(p, d) || '/', '') AS prefix FROM (SELECT DISTINCT graph_id FROM f) g LEFT JOIN ok USING (graph_id) GROUP BY 1)"""
_DOMAIN = _PREFIX + f""", pp AS (SELECT DISTINCT n.graph_id, file_path, string_split(substr(file_path, length(prefix) + 1), '/') AS s FROM (SELECT graph_id, CASE WHEN type = 'FILE' THEN {_RENAMED} ELSE file_path END AS file_path FROM nodes WHERE NOT starts_with(file_path, 'db/')) n JOIN px ON px.graph_id = n.graph_id),
parts AS (SELECT graph_id, file_path, len(s) AS n, UNNEST(s) AS part, generate_subscripts(s, 1) AS j FROM pp), lay AS (SELECT graph_id, file_path, MIN(j) AS nd FROM parts WHERE part IN {tuple(M.DOMAIN_LAYERS)} GROUP BY 1, 2),
fold AS (SELECT p.graph_id, p.file_path, arg_min(lower(part), j) AS folder FROM parts p JOIN lay l ON l.graph_id = p.graph_id AND l.file_path = p.file_path WHERE j > nd AND j < n AND length(part) > 1 AND lower(part) NOT IN {tuple(M.NO_DOMAIN)} GROUP BY 1, 2),
known AS (SELECT DISTINCT graph_id, folder FROM fold),
wd AS (SELECT graph_id, file_path, string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(s[-1], '[.][^.]+$', ''), '^(.+?)({"|".join(M.KINDS)})$', '\\1'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\s_-]+') AS w FROM pp ANTI JOIN fold USING (graph_id, file_path)),
nd AS (SELECT *, UNNEST(range(1, len(w) + 1)) AS i FROM wd), said AS (SELECT graph_id, file_path, 0 AS whole, -i AS rank, array_to_string(w[1:i], '') AS t FROM nd UNION ALL SELECT graph_id, file_path, 1, i, w[i] FROM nd),
forms AS (SELECT *, 0 AS form, t AS folder FROM said UNION ALL SELECT *, 1, t[:-2] FROM said WHERE t LIKE '%s' UNION ALL SELECT *, 2, t[:-3] FROM said WHERE t LIKE '%es'
  UNION ALL SELECT *, 3, CASE WHEN t LIKE '%e' THEN t[:-2] ELSE t END || 'ion' FROM said WHERE length(t) >= 3 UNION ALL SELECT *, 4, t || 'ment' FROM said WHERE length(t) >= 3),
hit AS (SELECT graph_id, file_path, folder FROM (SELECT f.graph_id, f.file_path, f.folder, ROW_NUMBER() OVER (PARTITION BY f.graph_id, f.file_path ORDER BY whole, rank, form) AS rn FROM forms f JOIN known k ON k.graph_id = f.graph_id AND k.folder = f.folder) x WHERE rn = 1)
SELECT p.graph_id, p.file_path, COALESCE(a.folder, h.folder, 'common') AS domain FROM pp p LEFT JOIN fold a ON a.graph_id = p.graph_id AND a.file_path = p.file_path LEFT JOIN hit h ON h.graph_id = p.graph_id AND h.file_path = p.file_path"""

SQL = {
    "p14_domain": G.oracle(_DOMAIN),
    "g17_shared_labels": _FOOT + _SHARED + " SELECT * FROM common",
    "g18_overlap_clusters": _FOOT + _SHARED + _CLUSTER + " SELECT * FROM cc",
    "g19_candidate_modules": _FOOT + _SHARED + _CLUSTER + """, many AS (SELECT graph_id FROM cc GROUP BY 1 HAVING COUNT(DISTINCT cluster) >= 2), c AS (SELECT * FROM cc WHERE graph_id IN (SELECT graph_id FROM many)),
pr AS (SELECT c.graph_id, cluster, part, COUNT(*) AS n FROM c JOIN nodes nn ON nn.graph_id = c.graph_id AND nn.id = c.endpoint, UNNEST(string_split(regexp_replace(nn.name, '^[^:]*:', ''), '/')) AS u(part) WHERE part <> '' AND lower(part) <> 'api' AND part NOT LIKE '{%' AND NOT regexp_matches(part, '^v[0-9]+$') GROUP BY 1, 2, 3),
nm AS (SELECT graph_id, cluster, part AS name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id, cluster ORDER BY n DESC, part) AS rn FROM pr) x WHERE rn = 1),
ow AS (SELECT DISTINCT c.graph_id, cluster, label FROM rare JOIN c ON c.graph_id = rare.graph_id AND c.endpoint = rare.endpoint), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id, cluster ORDER BY label) AS rn FROM ow),
fi AS (SELECT graph_id, cluster, COUNT(*) AS files, string_agg(label, chr(10) ORDER BY label) FILTER (WHERE rn <= 15) AS sample FROM rk GROUP BY 1, 2)
SELECT fi.graph_id, fi.cluster, name, endpoints, files, sample FROM fi JOIN (SELECT graph_id, cluster, COUNT(*) AS endpoints FROM c GROUP BY 1, 2) s ON s.graph_id = fi.graph_id AND s.cluster = fi.cluster LEFT JOIN nm ON nm.graph_id = fi.graph_id AND nm.cluster = fi.cluster""",
    "g20_structure_gate": G.oracle(f", {R.CONTEXTS}, k AS (SELECT graph_id, COUNT(DISTINCT fn_context) AS contexts, COUNT(DISTINCT {R._feature('file_path')}) AS features FROM nc GROUP BY 1) SELECT *, contexts >= 2 OR features >= 2 AS structured FROM k"),
    "p12_layer_group": G.oracle(_PREFIX + f""", k AS (SELECT nodes.graph_id, id, list_filter({_S}, lambda x: x IN {_LAYERS}) AS w, string_split(substr(file_path, length(prefix) + 1), '/') AS s FROM nodes JOIN px ON px.graph_id = nodes.graph_id WHERE type = 'FILE'),
k2 AS (SELECT *, list_filter(s, lambda x: x IN {_LAYERS}) AS l, list_filter(s[:-2], lambda x: x NOT IN ('src', 'lib', 'crates', 'packages', 'pkg')) AS d FROM k)
SELECT graph_id, id, COALESCE(w[1], 'root') AS layer, CASE WHEN len(l) > 0 THEN concat_ws('/', l[1], s[list_position(s, l[1]) + 1]) ELSE COALESCE(d[1], 'root') END AS grp FROM k2"""),
    "p13_common_prefix": G.oracle(_PREFIX + " SELECT * FROM px"),
    "p15_owner_match": "SELECT page_id, page_id % 3 = 0 AND regexp_extract(url, '//([^./]+)\\.', 1) <> '' AS owned FROM pages",
    "g21_folder_map": G.oracle(f""", o AS (SELECT * FROM nodes WHERE type IN ('FILE', 'FUNCTION') AND {_PLAIN}), fp AS (SELECT graph_id, {_S} AS s FROM o WHERE type = 'FILE'),
dd AS (SELECT DISTINCT graph_id, s[1:d] AS p FROM (SELECT *, UNNEST(range(1, len(s))) AS d FROM fp))
SELECT graph_id, len(p) AS depth, 'DIRECTORY' AS kind, p[-1] AS label, NULL AS comment, array_to_string(p, '/') AS sort_key FROM dd
UNION ALL SELECT graph_id, len({_S}) + CASE WHEN type = 'FUNCTION' THEN 1 ELSE 0 END, type, CASE WHEN type = 'FUNCTION' THEN name ELSE {_S}[-1] END, comment, CASE WHEN type = 'FUNCTION' THEN file_path || '/' || name ELSE file_path END FROM o"""),
    "g22_context_map": G.oracle(_CTXMAP + " SELECT * FROM cx"),
    "g23_context_specs": G.oracle(_CTXMAP + f""", bg AS (SELECT graph_id, context, COUNT(*) AS files, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY context) AS rn FROM cx WHERE context <> '(none)' GROUP BY 1, 2 HAVING COUNT(*) >= 2)
SELECT b.graph_id, b.context, b.files, bool_or(n.type = 'API_ENDPOINT') AS has_api, bool_or(EXISTS (SELECT 1 FROM edges e WHERE e.type LIKE 'DB%' AND e.graph_id = n.graph_id AND e.src = n.id)) AS has_db, COUNT(n.comment) AS comments
FROM bg b JOIN cx ON cx.graph_id = b.graph_id AND cx.context = b.context JOIN nodes n ON n.graph_id = cx.graph_id AND n.file_path = cx.file_path WHERE b.rn <= 10 GROUP BY 1, 2, 3"""),
    "g38_layer_tab": G.oracle(" SELECT id FROM nodes WHERE contains('/' || file_path || '/', '/application/')"),
    "s3_s4_eligible": G.oracle(" SELECT graph_id, file_path FROM nodes WHERE type = 'FILE' AND length(file_path) % 5 > 1"),
    "s12_fact_codec": source_queries.oracle_sql()["x12_entity_columns"],
    "s16_markdown": G.oracle(R._ALL + ", l AS (SELECT graph_id, type, COUNT(*) AS n, string_agg('- ' || message, chr(10) ORDER BY message) AS t FROM w GROUP BY 1, 2) SELECT graph_id, sha256(string_agg('## ' || type || ' (' || n || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY type)) AS digest FROM l GROUP BY 1"),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
