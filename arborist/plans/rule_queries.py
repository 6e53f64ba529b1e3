"""Queries of the structural rules and of what follows them, over the derived code graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.functions import paths as P
from arborist.operators import findings, rules

from . import testgraph as G

MODULES = [("domain", 1, "src/main/domain/**"), ("app", 2, "src/main/application/**"), ("infra", 3, "src/main/infrastructure/**"), ("any", 4, "src/main/**")]
#: Projects with declared modules, rules and ignored warnings; project 2 has none.
PROJECTS = (0, 1)
RULES = [("domain", "infra", "IMPORT"), ("infra", "app", ""), ("app", "infra", "FUNCTION_CALL"), ("any", "domain", "IMPORT")]


def _shape(w: DataFrame) -> DataFrame:
    return w.select("graph_id", "type", "severity", F.array_join("node_ids", ",").alias("node_ids"), "message")


def _rule(rule):
    return lambda spark, sf_dir: _shape(rule(G.nodes(spark, sf_dir), G.edges(spark, sf_dir)))


def _declared(spark, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([(p, *r) for p in PROJECTS for r in rows], f"project_id long, {columns}")


def _drift(spark, sf_dir):
    modules, declared = _declared(spark, MODULES, "module string, ord int, glob string"), _declared(spark, RULES, "source string, target string, edge_type string")
    return _shape(rules.intent_drift(G.nodes(spark, sf_dir), G.edges(spark, sf_dir), modules, declared, G.projects(spark, sf_dir)))


def _converters(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cols = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string"), F.when(F.col("l_quantity") > 1, "_encrypted").otherwise("")).alias("column_name"), (F.col("l_linenumber") == 7).alias("has_converter"))).alias("columns"))
    t = cols.select((F.col("k") % 7).alias("graph_id"), F.concat(F.lit("T"), "k").alias("id"), F.concat(F.lit("table_"), "k").alias("name"), (F.col("k") % 5 == 0).alias("converter_migration_done"), "columns")
    return _shape(rules.missing_converter_migration(t))


def _warnings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Warnings of five rules with fingerprints, found once an application, and the nodes."""
    n, e = G.nodes(spark, sf_dir), G.edges(spark, sf_dir)

    def build():
        out, ends = rules.high_fan_out(n, e).unionByName(rules.async_self_call(n, e)), rules.import_ends(n, e)
        for rule in (rules.domain_imports_infra, rules.interfaces_imports_infra, rules.cross_feature_import):
            out = out.unionByName(rule(n, e, ends))
        return findings.fingerprint(out)

    return G.once(spark, sf_dir, "warnings", build), n


def w_fingerprint(spark, sf_dir):
    return _warnings(spark, sf_dir)[0].select("graph_id", "type", F.array_join("node_ids", ",").alias("node_ids"), "fingerprint")


def w_located(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    return findings.locate(w, n).select("graph_id", "type", "message", "file", "line", "col", "end_col")


IGNORES = [("HIGH_FAN_OUT", "src/main/domain/**", "*"), ("*", "src/features/order/**", ""), ("", "", "src/main/infrastructure/persistence/user/**")]


def w_ignore(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    return findings.ignore(w, n, _declared(spark, IGNORES, "type string, source string, target string"), G.projects(spark, sf_dir)).select("graph_id", "type", "message")


def w_ignore_preview(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    kept = findings.ignore(w, n, _declared(spark, IGNORES, "type string, source string, target string"), G.projects(spark, sf_dir))
    return w.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy("type").agg(F.count(F.lit(1)).alias("k")), "type", "left").select("type", (F.col("n") - F.coalesce("k", F.lit(0))).alias("hidden"))


def w_suppression(spark, sf_dir):
    w, _ = _warnings(spark, sf_dir)
    hidden = w.where("graph_id % 3 = 0 AND type = 'HIGH_FAN_OUT'").select("graph_id", "fingerprint")
    return findings.suppression_split(w, hidden).groupBy("graph_id", "hidden").agg(F.count(F.lit(1)).alias("n"))


def w_scope_gate(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    changed = n.where("type = 'FILE' AND ord % 2 = 0").select("graph_id", F.col("file_path").alias("file"))
    return findings.gate_state(findings.diff_scope(findings.locate(w, n), changed))


def w_comment_groups(spark, sf_dir):
    return findings.severity_groups(_warnings(spark, sf_dir)[0])


def w_count_by_type(spark, sf_dir):
    return findings.count_by_type(_warnings(spark, sf_dir)[0])


def w_before_after(spark, sf_dir):
    w, _ = _warnings(spark, sf_dir)
    return findings.before_after(w.where("graph_id % 5 <> 0"), w.where("graph_id % 7 <> 0"))


def w_panel(spark, sf_dir):
    return findings.panel(_warnings(spark, sf_dir)[0])


def p_path_classes(spark, sf_dir):
    n = G.nodes(spark, sf_dir).where("type IN ('FILE', 'FUNCTION')")
    p, name = F.col("file_path"), F.col("name")
    return n.select("id", P.is_test_artifact(p, name).alias("test_artifact"), P.is_test_path(p).alias("test_path"), P.is_composition_root(p).alias("composition_root"), P.is_orchestrator(p, name).alias("orchestrator"), P.is_framework_call(name).alias("framework_call"), P.feature_of(p).alias("feature"), P.frontend_rank(p).alias("frontend_rank"), P.layer_rank(p).alias("layer_rank"), P.service_of(p).alias("service"))


def p_context(spark, sf_dir):
    return rules.with_contexts(G.nodes(spark, sf_dir).where("type = 'FILE'")).select("id", "app_context", "dom_context", "fn_context")


def p_ddd_gate(spark, sf_dir):
    return rules.ddd_gate(G.nodes(spark, sf_dir))


def p_module_of(spark, sf_dir):
    n = G.nodes(spark, sf_dir).where("type = 'FILE'")
    modules = rules.modules_of(n, _declared(spark, MODULES, "module string, ord int, glob string"), G.projects(spark, sf_dir))
    return n.join(modules, ["graph_id", "file_path"]).select("id", "module")


def p_themes(spark, sf_dir):
    n = G.nodes(spark, sf_dir)
    policies = n.select("graph_id").distinct().where("graph_id % 4 <> 0").selectExpr("graph_id", "CASE graph_id % 4 WHEN 1 THEN 'DDD' WHEN 2 THEN 'LAYERED' ELSE 'other' END AS policy")
    return rules.themes(n, G.edges(spark, sf_dir), policies).withColumn("rule_types", F.array_join("rule_types", ","))


def w_glob(spark, sf_dir):
    return G.nodes(spark, sf_dir).where("type = 'FILE'").select("id", findings.infer_glob("file_path").alias("glob"))


def w_order(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    return findings.in_order(findings.locate(w, n)).select("graph_id", "type", "file", "message", "pos")


def w_severity(spark, sf_dir):
    w, n = _warnings(spark, sf_dir)
    located = findings.locate(w, n)
    inside = findings.diff_scope(located, n.where("type = 'FILE' AND ord % 2 = 0").select("graph_id", F.col("file_path").alias("file")))
    both = located.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).join(findings.gate_state(inside), "graph_id", "left")
    low, kept = F.coalesce("low_dropped", F.lit(0)), F.coalesce("warning_count", F.lit(0))
    return both.select("graph_id", kept.alias("kept"), low.alias("low_dropped"), (F.col("n") - kept - low).alias("out_of_scope"))


def w_gate_log(spark, sf_dir):
    log = findings.gate_log(findings.gate_state(_warnings(spark, sf_dir)[0]), "2024-01-31 00:00:00")
    return log.select("graph_id", "state", "high_count", "warning_count", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def w_snippet(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", findings.snippet(F.regexp_replace("html", "><", ">\n<"), F.lit(4)).alias("snippet"))


def g_node_warnings(spark, sf_dir):
    return findings.of_node(_warnings(spark, sf_dir)[0])


# The same in SQL.
def _in(path: str, dirs: list[str]) -> str:
    return f"regexp_matches({path}, '{P.any_of(dirs)}')"


def _test(path: str, name: str) -> str:
    return f"(regexp_matches('/' || {path} || '/', '{P.TEST_DIR}') OR regexp_matches({path}, '{P.TEST_FILE}') OR starts_with({name}, 'test_'))"


def _root(path: str) -> str:
    return f"regexp_matches({path}, '{P.ROOT_FILE}')"


def _list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _framework(name: str) -> str:
    return f"(regexp_matches({name}, '^(get|set|is|on|handle)[A-Z]') OR (regexp_matches({name}, '^(find|count|existsBy|delete)') AND length({name}) > 6) OR (regexp_matches({name}, '^(save|update|toggle|mark|upgrade|downgrade)') AND length({name}) > 4) OR regexp_matches({name}, '^[A-Z]'))"


def _layer(path: str) -> str:
    stem = f"regexp_replace(regexp_extract({path}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"
    guarded = f"'/' || lower({path}) || '/'"
    dirs = " ".join(f"WHEN {_in(guarded, d)} THEN {r}" for r, d in P.LAYERED_DIRS.items())
    return f"(CASE WHEN regexp_matches({stem}, 'Controller$') THEN 0 WHEN regexp_matches({stem}, '(Repository|Dao|DAO|Mapper)$') THEN 2 WHEN regexp_matches({stem}, 'Service$') THEN 1 WHEN regexp_matches({stem}, '(Entity|Model|VO)$') THEN 3 {dirs} END)"


def _feature(path: str) -> str:
    return f"NULLIF(regexp_extract({path}, '(?:^|/)features/([^/]+)/', 1), '')"


def _rank(path: str) -> str:
    has = lambda d: f"regexp_matches({path}, '(^|/)({'|'.join(d)})/')"
    return f"(CASE WHEN {_feature(path)} IS NOT NULL THEN 1 WHEN {has(['app'])} THEN 0 WHEN {has(['entities'])} THEN 2 WHEN {has(['shared', *P.SHARED_DIRS])} THEN 3 END)"


def _service(path: str) -> str:
    s = f"string_split({path}, '/')"
    return f"(CASE WHEN len({s}) >= 2 AND lower({s}[1]) IN {_list(P.SERVICE_WRAPPERS)} THEN CASE WHEN len({s}) > 2 THEN {s}[2] END WHEN len({s}) >= 2 THEN {s}[1] END)"


def _after(path: str, dirs: list[str], nested: bool) -> str:
    out = []
    for d in dirs:
        seg = f"regexp_extract({path}, '^.*?/{d}/([^/]+)/', 1)"
        cond = f"{seg} <> '' AND {seg} NOT IN {_list(P.LAYER_TERMS)}"
        if nested:
            prefix = f"regexp_extract({path}, '^(.*?)/{d}/', 1) || '/'"
            cond += f" AND NOT {_in(prefix, P.APPLICATION_DIRS)}"
        out.append(f"CASE WHEN {cond} THEN {seg} END")
    return ", ".join(out)


def _before(path: str, dirs: list[str]) -> str:
    seg = [f"regexp_extract({path}, '(?:^|/)([^/]*)/{d}/', 1)" for d in dirs]
    return ", ".join(f"CASE WHEN {s} <> '' AND list_contains(contexts, {s}) THEN {s} END" for s in seg)


CONTEXTS = f"""
cf0 AS (SELECT graph_id, string_split(file_path, '/') AS s FROM nodes WHERE NOT {_test('file_path', 'name')}),
cf1 AS (SELECT graph_id, UNNEST(list_zip(s[:-2], s[2:])) AS z FROM cf0 WHERE len(s) > 1),
cf2 AS (SELECT graph_id, z[1] AS seg FROM cf1 WHERE z[1] <> '' AND z[1] NOT IN {_list(P.LAYER_TERMS)} AND z[2] IN {_list(P.BOUNDARY_LAYERS)} GROUP BY 1, 2 HAVING COUNT(DISTINCT z[2]) >= 2),
cf3 AS (SELECT graph_id, list(seg) AS contexts FROM cf2 GROUP BY 1 HAVING COUNT(*) >= 2),
nc0 AS (SELECT n.*, COALESCE(contexts, []) AS contexts FROM nodes n LEFT JOIN cf3 USING (graph_id)),
nc1 AS (SELECT *, COALESCE({_before('file_path', P.APPLICATION_DIRS)}, {_after('file_path', P.APPLICATION_DIRS, False)}) AS app_context,
  COALESCE({_before('file_path', P.CONTEXT_FIRST_DOMAIN_DIRS)}, {_after('file_path', P.DOMAIN_DIRS, True)}) AS dom_context FROM nc0),
nc AS (SELECT *, COALESCE(dom_context, app_context) AS fn_context FROM nc1)"""
DDD = f"ddd AS (SELECT graph_id FROM nodes GROUP BY 1 HAVING CAST(bool_or({_in('file_path', P.DOMAIN_DIRS)}) AS INT) + CAST(bool_or({_in('file_path', P.APPLICATION_DIRS)}) AS INT) + CAST(bool_or({_in('file_path', P.INFRA_DIRS)}) AS INT) >= 2)"
FEATURES = f"ft AS (SELECT graph_id FROM nodes GROUP BY 1 HAVING COUNT(DISTINCT {_feature('file_path')}) >= 2 AND bool_or(lower(language) IN {_list(rules.FRONTEND)}) AND NOT bool_or(regexp_matches(file_path, '(^|/)features/[^/]+/[^/]*[sS]lice\\.(ts|js|tsx|jsx)$')))"
IMP = f"imp AS (SELECT * FROM ends WHERE type = 'IMPORT' AND NOT {_test('src_path', 'src_name')})"


def _warn(kind: str, severity: str, ids: str, message: str, source: str) -> str:
    return f" SELECT graph_id, '{kind}' AS type, '{severity}' AS severity, {ids} AS node_ids, {message} AS message FROM {source}"


def _pair(kind: str, severity: str, text: str, source: str) -> str:
    return _warn(kind, severity, "src || ',' || tgt", f"'{text}: ' || src_path || '#' || src_name || ' -> ' || tgt_path || '#' || tgt_name", source)


DEAD = f""",
calls AS (SELECT DISTINCT graph_id, tgt FROM edges WHERE type = 'FUNCTION_CALL'), fn AS (SELECT *, COUNT(*) OVER (PARTITION BY graph_id, name) AS defs FROM nodes WHERE type = 'FUNCTION'),
called AS (SELECT DISTINCT f.graph_id, f.name FROM fn f JOIN calls c ON c.graph_id = f.graph_id AND c.tgt = f.id),
hit AS (SELECT f.graph_id, f.id, f.name, f.file_path FROM fn f LEFT JOIN called c ON c.graph_id = f.graph_id AND c.name = f.name WHERE NOT EXISTS (SELECT 1 FROM calls x WHERE x.graph_id = f.graph_id AND x.tgt = f.id)
  AND NOT (length(f.name) > 4 AND f.name LIKE '\\_\\_%\\_\\_' ESCAPE '\\') AND NOT {_test('f.file_path', 'f.name')} AND NOT (regexp_matches(f.file_path, '\\.(tsx|jsx)$') AND regexp_matches(f.name, '^[A-Z]'))
  AND NOT regexp_matches('/' || f.file_path, '/(interfaces|pages|components|hooks|utils|lib|application|infrastructure)/') AND f.name NOT IN {_list(P.FRAMEWORK_CALLS)} AND NOT {_framework('f.name')}
  AND NOT (((contains('/' || f.file_path, '/domain/') AND (regexp_matches(f.file_path, '(Repository|Port)\\.java$') OR contains(f.file_path, '/port/'))) OR defs >= 2) AND c.name IS NOT NULL)
  AND NOT f.is_async AND NOT f.is_framework_annotated AND NOT f.referenced_as_value),
tot AS (SELECT graph_id, COUNT(*) AS t FROM fn GROUP BY 1), gate AS (SELECT h.graph_id, COUNT(*) AS n, ANY_VALUE(t) AS t FROM hit h JOIN tot USING (graph_id) GROUP BY 1),
res AS (SELECT graph_id, id, 'Never called: ' || file_path || '#' || name AS m FROM hit JOIN gate USING (graph_id) WHERE NOT (t >= 30 AND n >= 10 AND n / t >= 0.04)
  UNION ALL SELECT graph_id, '', 'Functions without calls: ' || CAST(FLOOR(n / t * 100 + 0.5) AS INT) || '% (' || n || '/' || t || ')' FROM gate WHERE t >= 30 AND n >= 10 AND n / t >= 0.04)"""
_NOT_COVERED = f"NOT ({_in('tgt_path', P.INFRA_DIRS)} AND NOT contains(tgt_path, '/shared/') AND ({_in('src_path', P.DOMAIN_DIRS)} OR ({_in('src_path', P.INTERFACE_DIRS)} AND NOT {_root('src_path')})))"
_PLAIN = f"NOT regexp_matches(file_path, '/src/test/|/__tests__/|\\.test\\.|\\.spec\\.') AND NOT {_test('file_path', 'name')}"
LAYERED = f""", {DDD}, {FEATURES},
ln AS (SELECT graph_id, id, {_layer('file_path')} AS r FROM nodes WHERE type = 'FILE' AND {_PLAIN}),
lg AS (SELECT graph_id, bool_or(r = 1) AS svc FROM ln WHERE r IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT r) >= 2),
le AS (SELECT e.*, a.r AS sr, b.r AS tr, svc FROM ends e JOIN ln a ON a.graph_id = e.graph_id AND a.id = e.src JOIN ln b ON b.graph_id = e.graph_id AND b.id = e.tgt JOIN lg ON lg.graph_id = e.graph_id
  WHERE e.type = 'IMPORT' AND a.r IS NOT NULL AND b.r IS NOT NULL AND e.graph_id NOT IN (SELECT graph_id FROM ft) AND e.graph_id NOT IN (SELECT graph_id FROM ddd) AND {_NOT_COVERED})"""
CHAIN = f""",
sc AS (SELECT graph_id, {_service('src_path')} AS a, {_service('tgt_path')} AS b, ord, edge_identifier, src, tgt FROM ends WHERE type = 'SERVICE_CALL' AND NOT {_test('src_path', 'src_name')}),
se AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id, a, b ORDER BY ord, edge_identifier) AS rn FROM sc WHERE a <> b) WHERE rn = 1), free AS (SELECT DISTINCT graph_id, a FROM se x WHERE NOT EXISTS (SELECT 1 FROM se y WHERE y.graph_id = x.graph_id AND y.b = x.a)),
roots AS (SELECT * FROM free UNION (SELECT graph_id, a FROM se WHERE graph_id NOT IN (SELECT graph_id FROM free) UNION SELECT graph_id, b FROM se WHERE graph_id NOT IN (SELECT graph_id FROM free))),
walk AS (SELECT r.graph_id, [r.a] AS path, CAST([] AS VARCHAR[]) AS ids, '' AS last FROM roots r UNION ALL SELECT w.graph_id, list_append(w.path, e.b), list_append(w.ids, e.src), e.tgt FROM walk w JOIN se e ON e.graph_id = w.graph_id AND e.a = w.path[-1] WHERE NOT list_contains(w.path, e.b) AND len(w.path) <= 8),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id, path[1] ORDER BY len(path) DESC, array_to_string(path, '>')) AS rn FROM walk WHERE len(path) >= 3)"""
_DRIFT_GLOBS = [(m, o, "^" + g.replace("/**", "/.*") + "$") for m, o, g in MODULES]
DRIFT = f""",
mg AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _DRIFT_GLOBS)}) t(module, o, rx)), fm AS (SELECT file_path, arg_min(module, o) AS module FROM (SELECT DISTINCT file_path FROM nodes WHERE graph_id % 3 < 2) JOIN mg ON regexp_matches(file_path, rx) GROUP BY 1),
ru AS (SELECT DISTINCT s, t, CASE WHEN k = 'FUNCTION_CALL' THEN k ELSE 'IMPORT' END AS k FROM (VALUES {', '.join(str(x) for x in RULES)}) v(s, t, k)),
dr AS (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.graph_id, e.type, a.module, b.module, src_path, tgt_path ORDER BY e.ord, edge_identifier) AS rn FROM ends e JOIN fm a ON a.file_path = src_path JOIN fm b ON b.file_path = tgt_path JOIN ru ON ru.s = a.module AND ru.t = b.module AND ru.k = e.type)"""
SHARED = f""",
ac AS (SELECT *, {_service('src_path')} AS service FROM ends WHERE type IN {_list(rules.DB_ACCESS)} AND tgt_type = 'DB_TABLE' AND NOT {_test('src_path', 'src_name')}),
a1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id, tgt, service ORDER BY ord, edge_identifier) AS rn FROM ac WHERE service IS NOT NULL),
sh AS (SELECT graph_id, tgt, string_agg(src, ',' ORDER BY ord, edge_identifier) || ',' || tgt AS ids, 'Table shared by services: ' || ANY_VALUE(tgt_name) || ' by ' || string_agg(service, ', ' ORDER BY ord, edge_identifier) AS m FROM a1 WHERE rn = 1 GROUP BY graph_id, tgt HAVING COUNT(*) >= 2)"""
_FAN = f"(SELECT e.graph_id, e.src, COUNT(*) AS n FROM edges e WHERE e.type = 'FUNCTION_CALL' AND NOT e.same_file GROUP BY 1, 2 HAVING COUNT(*) > 7) c JOIN nodes f ON f.graph_id = c.graph_id AND f.id = c.src WHERE f.type = 'FUNCTION' AND NOT f.is_test AND f.name <> 'main' AND f.merged_def_count < 2 AND NOT {_test('f.file_path', 'f.name')} AND NOT (f.file_path LIKE '%Controller.java' OR (contains(f.file_path, '/application/') AND regexp_matches(f.file_path, '(ApplicationService|Facade)\\.java$')) OR f.name LIKE '%Inner')"
_R = {
    "r3": _warn("BROKEN_INTERFACE_CHAIN", "MEDIUM", "id", "'No implementation is linked to ' || file_path || '#' || name", f"nodes n WHERE type = 'FUNCTION' AND is_interface AND NOT is_framework_interface AND name NOT IN {_list(P.REPOSITORY_BASE)} AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.type = 'FUNCTION_CALL' AND e.is_interface_impl AND e.src = n.id AND e.graph_id = n.graph_id)"),
    "r4": _pair("ASYNC_SELF_CALL", "HIGH", "Asynchronous method called in its own class", "(SELECT e.* FROM ends e JOIN nodes t ON t.graph_id = e.graph_id AND t.id = e.tgt WHERE e.type = 'FUNCTION_CALL' AND t.is_async AND lower(tgt_language) IN ('java', 'kotlin') AND src_path = tgt_path)"),
    "r5": _warn("MISSING_TRANSACTIONAL_DELETE", "HIGH", "id", "'Derived delete outside a transaction: ' || file_path || '#' || name", f"nodes n WHERE type = 'FUNCTION' AND lower(language) IN ('java', 'kotlin') AND regexp_matches(name, '^(delete|remove)By[A-Z]') AND name NOT IN ('deleteById', 'removeById') AND NOT is_transactional AND NOT {_test('file_path', 'name')} AND {_in('file_path', P.INFRA_DIRS)} AND {_in('file_path', P.PERSISTENCE_DIRS)} AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.id = e.src WHERE e.type = 'FUNCTION_CALL' AND s.is_transactional AND e.tgt = n.id AND e.graph_id = n.graph_id)"),
    "r8": f" SELECT f.graph_id, 'HIGH_FAN_OUT' AS type, 'LOW' AS severity, f.id AS node_ids, 'Calls ' || n || ' functions: ' || f.file_path || '#' || f.name AS message FROM {_FAN}",
    "r9": f", {IMP}" + _pair("DOMAIN_IMPORTS_INFRA", "HIGH", "Domain imports infrastructure", f"imp WHERE {_in('src_path', P.DOMAIN_DIRS)} AND {_in('tgt_path', P.INFRA_DIRS)} AND NOT contains(tgt_path, '/shared/')"),
    "r10": f", {IMP}" + _pair("INTERFACES_IMPORTS_INFRA", "MEDIUM", "Interface layer imports infrastructure", f"imp WHERE {_in('src_path', P.INTERFACE_DIRS)} AND {_in('tgt_path', P.INFRA_DIRS)} AND NOT contains(tgt_path, '/shared/') AND NOT {_root('src_path')}"),
    "r14": f", {IMP}, {FEATURES}" + _pair("CROSS_FEATURE_IMPORT", "HIGH", "Feature imports feature", f"imp WHERE graph_id IN (SELECT graph_id FROM ft) AND {_feature('src_path')} <> {_feature('tgt_path')}"),
}
_ALL = f", {IMP}, {FEATURES}, w0 AS ({_R['r8']} UNION ALL" + " UNION ALL".join(_R[k].split(IMP)[-1].removeprefix(f", {FEATURES}") for k in ("r9", "r10", "r4", "r14")) + "), w AS (SELECT *, sha256(type || '|' || message) AS fingerprint FROM w0), wf AS (SELECT w.*, n.file_path AS file, n.line, n.col, n.end_col FROM w LEFT JOIN nodes n ON n.graph_id = w.graph_id AND n.id = string_split(w.node_ids, ',')[1])"
_IGN = "ig AS (SELECT w.*, EXISTS (SELECT 1 FROM nodes a, nodes b WHERE a.graph_id = w.graph_id AND a.id = string_split(w.node_ids, ',')[1] AND b.graph_id = w.graph_id AND b.id = string_split(w.node_ids, ',')[-1] AND w.graph_id % 3 < 2 AND ((w.type = 'HIGH_FAN_OUT' AND a.file_path LIKE 'src/main/domain/%') OR a.file_path LIKE 'src/features/order/%' OR b.file_path LIKE 'src/main/infrastructure/persistence/user/%')) AS gone FROM w)"

ORACLES = {
    "r3_broken_interface_chain": _R["r3"], "r4_async_self_call": _R["r4"], "r5_missing_transactional_delete": _R["r5"], "r8_high_fan_out": _R["r8"], "r9_domain_imports_infra": _R["r9"], "r10_interfaces_imports_infra": _R["r10"], "r14_cross_feature_import": _R["r14"],
    "r6_missing_converter_migration": ", t AS (SELECT l_suppkey AS k, bool_or(l_linenumber = 7 AND NOT l_quantity > 1) AS plain FROM {lineitem} GROUP BY 1) SELECT k % 7 AS graph_id, 'MISSING_CONVERTER_MIGRATION' AS type, 'MEDIUM' AS severity, 'T' || k AS node_ids, 'Converter without migration: table_' || k AS message FROM t WHERE plain AND k % 5 <> 0",
    "r7_dead_code": DEAD + _warn("DEAD_CODE", "LOW", "id", "m", "res"),
    "r11_db_layer_bypass": f", {IMP}, {DDD}" + _pair("DB_LAYER_BYPASS", "HIGH", "Upper layer imports persistence", f"imp WHERE graph_id IN (SELECT graph_id FROM ddd) AND NOT is_interface_impl AND {_in('src_path', P.UPPER_DIRS)} AND NOT {_root('src_path')} AND {_in('tgt_path', P.INFRA_DIRS)} AND {_in('tgt_path', P.PERSISTENCE_DIRS)} AND NOT regexp_matches(lower(tgt_path), '{P.ERROR_FILE}')"),
    "r12_cross_context_import": f", {DDD}, {CONTEXTS}, cg AS (SELECT graph_id FROM (SELECT graph_id, app_context AS c FROM nc WHERE NOT {_test('file_path', 'name')} UNION ALL SELECT graph_id, dom_context FROM nc WHERE NOT {_test('file_path', 'name')}) GROUP BY 1 HAVING COUNT(DISTINCT c) >= 2)" + _pair("CROSS_CONTEXT_IMPORT", "HIGH", "Import across contexts", f"(SELECT e.*, a.app_context AS ac, b.dom_context AS dc FROM ends e JOIN nc a ON a.graph_id = e.graph_id AND a.id = e.src JOIN nc b ON b.graph_id = e.graph_id AND b.id = e.tgt WHERE e.type = 'IMPORT') WHERE graph_id IN (SELECT graph_id FROM cg) AND graph_id IN (SELECT graph_id FROM ddd) AND ac <> dc AND NOT {_test('src_path', 'src_name')}"),
    "r13_cross_domain_call": f", {DDD}, {CONTEXTS}, am AS (SELECT graph_id, name FROM nc WHERE type = 'FUNCTION' AND NOT {_test('file_path', 'name')} AND fn_context IS NOT NULL GROUP BY 1, 2 HAVING COUNT(DISTINCT fn_context) >= 2)" + _pair("CROSS_DOMAIN_CALL", "MEDIUM", "Call across domains", f"(SELECT e.*, a.fn_context AS sc, b.fn_context AS tc FROM ends e JOIN nc a ON a.graph_id = e.graph_id AND a.id = e.src JOIN nc b ON b.graph_id = e.graph_id AND b.id = e.tgt WHERE e.type = 'FUNCTION_CALL') q WHERE graph_id IN (SELECT graph_id FROM ddd) AND sc <> tc AND NOT contains(src_path, '/infrastructure/') AND NOT regexp_matches(tgt_path, '/(infrastructure|shared|port|adapter)/') AND NOT {_test('src_path', 'src_name')} AND NOT {_test('tgt_path', 'tgt_name')} AND tgt_name NOT IN {_list(P.FRAMEWORK_CALLS + P.COLLECTION_CALLS)} AND NOT {_framework('tgt_name')} AND NOT EXISTS (SELECT 1 FROM am WHERE am.graph_id = q.graph_id AND am.name = q.tgt_name)"),
    "r15_feature_layer_violation": f", {IMP}, {FEATURES}" + _pair("FEATURE_LAYER_VIOLATION", "HIGH", "Import against the layer order", f"imp WHERE graph_id IN (SELECT graph_id FROM ft) AND {_rank('src_path')} > {_rank('tgt_path')}"),
    "r16_layered_reverse_dependency": LAYERED + _pair("LAYERED_REVERSE_DEPENDENCY", "HIGH", "Lower layer imports upper", "le WHERE sr > tr"),
    "r17_layered_bypass": LAYERED + _pair("LAYERED_BYPASS", "MEDIUM", "Controller imports repository", "le WHERE sr = 0 AND tr = 2 AND svc"),
    "r18_intent_drift": DRIFT + _pair("INTENT_DRIFT", "HIGH", "Forbidden dependency", "dr WHERE rn = 1"),
    "r19_shared_database_access": SHARED + _warn("SHARED_DATABASE_ACCESS", "MEDIUM", "ids", "m", "sh"),
    "r20_service_call_chain": CHAIN + _warn("SERVICE_CALL_CHAIN", "MEDIUM", "array_to_string(ids, ',') || ',' || last", "'Service chain: ' || array_to_string(path, ' -> ')", "best WHERE rn = 1"),
    "w1_fingerprint": _ALL + " SELECT graph_id, type, node_ids, fingerprint FROM w",
    "w2_located": _ALL + " SELECT graph_id, type, message, file, line, col, end_col FROM wf",
    "w3_ignore": _ALL + f", {_IGN} SELECT graph_id, type, message FROM ig WHERE NOT gone",
    "w4_ignore_preview": _ALL + f", {_IGN} SELECT type, COUNT(*) FILTER (WHERE gone) AS hidden FROM ig GROUP BY 1",
    "w7_suppression": _ALL + " SELECT graph_id, graph_id % 3 = 0 AND fingerprint IN (SELECT fingerprint FROM w x WHERE x.graph_id = w.graph_id AND x.type = 'HIGH_FAN_OUT') AS hidden, COUNT(*) AS n FROM w GROUP BY 1, 2",
    "w8_scope_gate": _ALL + ", s AS (SELECT * FROM wf WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.type = 'FILE' AND n.ord % 2 = 0 AND n.graph_id = wf.graph_id AND n.file_path = wf.file)) SELECT graph_id, COUNT(*) FILTER (WHERE severity = 'HIGH') AS high_count, COUNT(*) FILTER (WHERE severity <> 'LOW') AS warning_count, COUNT(*) FILTER (WHERE severity = 'LOW') AS low_dropped, CASE WHEN COUNT(*) FILTER (WHERE severity = 'HIGH') > 0 THEN 'failure' ELSE 'success' END AS state FROM s GROUP BY 1",
    "w13_comment_groups": _ALL + " SELECT graph_id, severity, COUNT(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM w GROUP BY 1, 2",
    "w14_count_by_type": _ALL + " SELECT type, COUNT(*) AS n FROM w GROUP BY 1",
    "w15_before_after": _ALL + ", k AS (SELECT DISTINCT graph_id, type || '|' || array_to_string(list_sort(string_split(node_ids, ',')), ',') AS key FROM w) SELECT graph_id, key, CASE WHEN graph_id % 5 <> 0 THEN 'gone' ELSE 'new' END AS change FROM k WHERE (graph_id % 5 <> 0) <> (graph_id % 7 <> 0)",
    "w19_panel": _ALL + ", g AS (SELECT graph_id, type, severity, COUNT(*) AS n FROM w GROUP BY 1, 2, 3) SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, type) AS INT) AS pos FROM g",
    "w5_glob_inference": " SELECT id, CASE WHEN regexp_extract(file_path, '^((?:.*?/)?(?:" + "|".join(dict.fromkeys([*P.DOMAIN_DIRS, *P.APPLICATION_DIRS, *P.INFRA_DIRS, *P.INTERFACE_DIRS])) + "))/', 1) <> '' THEN regexp_extract(file_path, '^((?:.*?/)?(?:" + "|".join(dict.fromkeys([*P.DOMAIN_DIRS, *P.APPLICATION_DIRS, *P.INFRA_DIRS, *P.INTERFACE_DIRS])) + "))/', 1) || '/**' ELSE regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/**' END AS glob FROM nodes WHERE type = 'FILE'",
    "w6_stable_order": _ALL + " SELECT graph_id, type, file, message, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY type, file, message) AS pos FROM wf",
    "w9_severity_counters": _ALL + ", s AS (SELECT *, EXISTS (SELECT 1 FROM nodes n WHERE n.type = 'FILE' AND n.ord % 2 = 0 AND n.graph_id = wf.graph_id AND n.file_path = wf.file) AS inside FROM wf) SELECT graph_id, COUNT(*) FILTER (WHERE inside AND severity <> 'LOW') AS kept, COUNT(*) FILTER (WHERE inside AND severity = 'LOW') AS low_dropped, COUNT(*) FILTER (WHERE NOT inside) AS out_of_scope FROM s GROUP BY 1",
    "w11_gate_log": _ALL + " SELECT graph_id, CASE WHEN bool_or(severity = 'HIGH') THEN 'failure' ELSE 'success' END AS state, COUNT(*) FILTER (WHERE severity = 'HIGH') AS high_count, COUNT(*) FILTER (WHERE severity <> 'LOW') AS warning_count, '2024-01-31' AS day FROM w GROUP BY 1",
    "g37_node_warnings": _ALL + " SELECT DISTINCT graph_id, UNNEST(string_split(node_ids, ',')) AS node, fingerprint, type FROM w",
    "p2_p3_themes": f"""{LAYERED}, sd AS (SELECT e.graph_id FROM ends e WHERE e.type IN {_list(rules.DB_ACCESS)} AND e.tgt_type = 'DB_TABLE' GROUP BY 1 HAVING COUNT(DISTINCT {_service('src_path')}) >= 2
  UNION SELECT graph_id FROM edges WHERE type = 'SERVICE_CALL'),
tg AS (SELECT DISTINCT graph_id FROM nodes), tp AS (SELECT graph_id, CASE graph_id % 4 WHEN 1 THEN 'DDD' WHEN 2 THEN 'LAYERED' ELSE 'AUTO' END AS policy, graph_id IN (SELECT graph_id FROM ddd) AS is_ddd,
  graph_id IN (SELECT graph_id FROM ft) AS has_features, graph_id IN (SELECT graph_id FROM lg) AS has_layers, graph_id IN (SELECT graph_id FROM sd) AS has_services FROM tg),
tt AS (SELECT *, CASE WHEN policy <> 'AUTO' THEN policy WHEN is_ddd THEN 'DDD' WHEN has_layers AND NOT has_features THEN 'LAYERED' ELSE 'GENERIC' END AS theme FROM tp)
SELECT graph_id, policy, theme, is_ddd, has_features, has_services, policy <> 'AUTO' AS self_declared, array_to_string(list_concat(
  CASE theme WHEN 'DDD' THEN ['DB_LAYER_BYPASS', 'CROSS_CONTEXT_IMPORT', 'CROSS_DOMAIN_CALL'] WHEN 'LAYERED' THEN ['LAYERED_REVERSE_DEPENDENCY', 'LAYERED_BYPASS'] ELSE [] END,
  CASE WHEN has_features THEN ['CROSS_FEATURE_IMPORT', 'FEATURE_LAYER_VIOLATION'] ELSE [] END, CASE WHEN has_services THEN ['SHARED_DATABASE_ACCESS', 'SERVICE_CALL_CHAIN'] ELSE [] END), ',') AS rule_types FROM tt""",
    "p1_ddd_gate": f", {DDD} SELECT DISTINCT graph_id, graph_id IN (SELECT graph_id FROM ddd) AS is_ddd FROM nodes",
    "p5_context": f", {CONTEXTS} SELECT id, app_context, dom_context, fn_context FROM nc WHERE type = 'FILE'",
    "p8_path_classes": f" SELECT id, {_test('file_path', 'name')} AS test_artifact, regexp_matches(file_path, '/src/test/|/__tests__/|\\.test\\.|\\.spec\\.') AS test_path, {_root('file_path')} AS composition_root, file_path LIKE '%Controller.java' OR (contains(file_path, '/application/') AND regexp_matches(file_path, '(ApplicationService|Facade)\\.java$')) OR name LIKE '%Inner' AS orchestrator, {_framework('name')} AS framework_call, {_feature('file_path')} AS feature, {_rank('file_path')} AS frontend_rank, {_layer('file_path')} AS layer_rank, {_service('file_path')} AS service FROM nodes WHERE type IN ('FILE', 'FUNCTION')",
    "p9_module_of": DRIFT + " SELECT id, module FROM nodes JOIN fm USING (file_path) WHERE type = 'FILE'",
}


PLAIN_ORACLES = {"w18_snippet": "WITH l AS (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS s FROM pages) SELECT page_id, CASE WHEN len(s) >= 4 THEN array_to_string(s[2:6], chr(10)) END AS snippet FROM l"}


def queries() -> dict:
    return {name: _rule(f) for name, f in rules.GRAPH_RULES.items()} | {
        "r6_missing_converter_migration": _converters, "r18_intent_drift": _drift, "w1_fingerprint": w_fingerprint, "w2_located": w_located, "w3_ignore": w_ignore, "w4_ignore_preview": w_ignore_preview,
        "w7_suppression": w_suppression, "w8_scope_gate": w_scope_gate, "w13_comment_groups": w_comment_groups, "w14_count_by_type": w_count_by_type, "w15_before_after": w_before_after, "w19_panel": w_panel,
        "p1_ddd_gate": p_ddd_gate, "p5_context": p_context, "p8_path_classes": p_path_classes, "p9_module_of": p_module_of, "p2_p3_themes": p_themes, "w5_glob_inference": w_glob, "w6_stable_order": w_order, "w9_severity_counters": w_severity, "w11_gate_log": w_gate_log, "w18_snippet": w_snippet,
        "g37_node_warnings": g_node_warnings,
    }


def oracle_sql() -> dict[str, str]:
    return {name: G.oracle(sql) for name, sql in ORACLES.items()} | PLAIN_ORACLES
