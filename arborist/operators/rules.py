"""The structural rules over code graphs: each maps (nodes, edges) of many graphs to warnings.

A warning is (graph_id, type, severity, node_ids, edge_ids, message); an edge's id is its ``edge_identifier``. Messages name the
paths, so that two warnings of a graph differ. Preconditions on a whole graph are computed as one row a graph and joined. Paths
are classified once a node (``classified``), before any join, and contexts once a path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.functions import paths as P
from arborist.storage import materialise

DB_ACCESS = ["DB_READ", "DB_WRITE", "DB_CREATE", "DB_UPDATE", "DB_DELETE"]
FRONTEND = ["typescript", "javascript", "tsx", "jsx"]


def with_ends(edges: DataFrame, nodes: DataFrame, *extra: str) -> DataFrame:
    """Edges with name, path, language (and ``extra`` columns) of both ends. Nodes aren't broadcast: by their packed files Spark takes them for fewer than they are."""
    cols = ["name", "file_path", "language", *extra]
    end = lambda side: nodes.select("graph_id", F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols]).hint("merge")
    return edges.join(end("src"), ["graph_id", "src"]).join(end("tgt"), ["graph_id", "tgt"])


def warning(df: DataFrame, kind: str, severity: str, node_ids: list[str], edge_ids: list[str], message: Column) -> DataFrame:
    ids = lambda names: F.array(*[F.col(n) for n in names]).cast("array<string>")
    return df.select("graph_id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), ids(node_ids).alias("node_ids"), ids(edge_ids).alias("edge_ids"), message.alias("message"))


def classified(nodes: DataFrame) -> DataFrame:
    """Nodes with what their paths and names say, one column a predicate; those that a rule doesn't read are never computed."""
    path, name = F.col("file_path"), F.coalesce("name", F.lit(""))
    return nodes.withColumns(
        {
            "test": P.is_test_artifact(path, name), "domain": P.in_layer(path, P.DOMAIN_DIRS), "infra": P.in_layer(path, P.INFRA_DIRS), "interface_dir": P.in_layer(path, P.INTERFACE_DIRS),
            "upper": P.in_layer(path, P.UPPER_DIRS), "persistence": P.in_layer(path, P.PERSISTENCE_DIRS), "in_shared": path.contains("/shared/"), "root_file": P.is_composition_root(path), "error_file": P.is_error_module(path),
            "feature": P.feature_of(path), "front_rank": P.frontend_rank(path), "service": P.service_of(path), "framework": P.is_framework_call(name) | name.isin(P.FRAMEWORK_CALLS + P.COLLECTION_CALLS),
        }
    )


def _named(side: str) -> Column:
    return F.concat(f"{side}_file_path", F.lit("#"), f"{side}_name")


def _pair(df: DataFrame, kind: str, severity: str, text: str) -> DataFrame:
    return warning(df, kind, severity, ["src", "tgt"], ["edge_identifier"], F.concat(F.lit(text + ": "), _named("src"), F.lit(" -> "), _named("tgt")))


def _single(df: DataFrame, kind: str, severity: str, text: str | Column) -> DataFrame:
    return warning(df, kind, severity, ["id"], [], F.concat(F.lit(text) if isinstance(text, str) else text, F.col("file_path"), F.lit("#"), F.col("name")))


def import_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that imports start or end at, written, so that no path of another node, as functions are, is classified."""
    ids = edges.where("type = 'IMPORT'").select("graph_id", F.explode(F.array("src", "tgt")).alias("id")).distinct()
    return materialise(nodes.join(ids.hint("merge"), ["graph_id", "id"], "left_semi"))


def _imports(nodes: DataFrame, edges: DataFrame, *flags: str, ends: DataFrame | None = None) -> DataFrame:
    """Imports with both ends' ``flags``, not from tests. ``ends``: ``import_ends``, where several rules read the same."""
    ends = import_ends(nodes, edges) if ends is None else ends
    return with_ends(edges.where("type = 'IMPORT'"), classified(ends), "test", *flags).where("NOT src_test")


def _dfs(kind: str):
    def cycles(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """One cycle for each back edge; starts and neighbours in order of path, then id."""
        rank = {}
        for a, pa, b, pb in zip(pdf["src"], pdf["src_file_path"], pdf["tgt"], pdf["tgt_file_path"]):
            rank[a], rank[b] = (pa, a), (pb, b)
        out: dict[str, set] = {}
        edge = {}
        for a, b, i in zip(pdf["src"], pdf["tgt"], pdf["edge_identifier"]):
            out.setdefault(a, set()).add(b)
            edge[a, b] = i
        found, seen = [], set()
        for start in sorted(rank, key=rank.get):
            if start in seen:
                continue
            seen.add(start)
            path, at = [start], {start: 0}
            todo = [iter(sorted(out.get(start, ()), key=rank.get))]
            while todo:
                step = next(todo[-1], None)
                if step is None:
                    todo.pop()
                    del at[path.pop()]
                elif step in at:
                    found.append(path[at[step] :])
                elif step not in seen:
                    seen.add(step)
                    at[step] = len(path)
                    path.append(step)
                    todo.append(iter(sorted(out.get(step, ()), key=rank.get)))
        rows = [(key[0], c, [edge[a, b] for a, b in zip(c, c[1:] + c[:1])], [rank[a][0] for a in c]) for c in found]
        return pd.DataFrame(rows, columns=["graph_id", "node_ids", "edge_ids", "paths"])

    return cycles


#: Rounds in which files that import nothing more are left out, before cycles are searched.
PEEL_ROUNDS = 4


def _peeled(e: DataFrame) -> DataFrame:
    """Edges without those into nodes that lead nowhere. A depth-first search turns back there, so its cycles stay the same."""
    e = materialise(e)
    for _ in range(PEEL_ROUNDS):
        left = e.join(e.select("graph_id", F.col("src").alias("tgt")).distinct(), ["graph_id", "tgt"], "left_semi").select(*e.columns)
        e = materialise(left)
    return e


def _cycles(e: DataFrame, kind: str, text: str) -> DataFrame:
    """Cycles of the edges ``e`` (with ends). A graph is one analysis of at most 500 files; what is left of one goes to one task."""
    e = _peeled(e.select("graph_id", "src", "tgt", "src_file_path", "tgt_file_path", "edge_identifier"))
    found = e.groupBy("graph_id").applyInPandas(_dfs(kind), "graph_id long, node_ids array<string>, edge_ids array<string>, paths array<string>")
    return found.select("graph_id", F.lit(kind).alias("type"), F.lit("HIGH").alias("severity"), "node_ids", "edge_ids", F.concat(F.lit(text + ": "), F.array_join("paths", " -> ")).alias("message"))


def cyclic_import(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    files = nodes.where((F.col("type") == "FILE") & ~P.is_test_path(F.col("file_path")))
    return _cycles(with_ends(edges.where("type = 'IMPORT'"), files), "CYCLIC_IMPORT", "Import cycle")


def circular_bean_dependency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    beans = nodes.where((F.col("type") == "FILE") & F.col("is_bean"))
    return _cycles(with_ends(edges.where("type = 'FIELD_DEPENDENCY' AND NOT is_lazy"), beans), "CIRCULAR_BEAN_DEPENDENCY", "Bean cycle")


def broken_interface_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    done = edges.where("type = 'FUNCTION_CALL' AND is_interface_impl").select("graph_id", F.col("src").alias("id"))
    n = nodes.where((F.col("type") == "FUNCTION") & F.col("is_interface") & ~F.col("is_framework_interface") & ~F.col("name").isin(P.REPOSITORY_BASE))
    return _single(n.join(done, ["graph_id", "id"], "left_anti"), "BROKEN_INTERFACE_CHAIN", "MEDIUM", "No implementation is linked to ")


def async_self_call(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    f = nodes.where("type = 'FUNCTION'")
    end = lambda rows, side: rows.select("graph_id", F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_file_path")).hint("merge")
    # calls meet what they call first: few of these are asynchronous, and only their calls go on to a caller
    called = f.where(F.col("is_async") & F.lower("language").isin("java", "kotlin") & (F.col("file_path") != ""))
    e = edges.where("type = 'FUNCTION_CALL'").select("graph_id", "src", "tgt", "edge_identifier").join(end(called, "tgt"), ["graph_id", "tgt"]).join(end(f, "src"), ["graph_id", "src"])
    e = e.where(F.col("src_file_path") == F.col("tgt_file_path"))
    return _pair(e, "ASYNC_SELF_CALL", "HIGH", "Asynchronous method called in its own class")


def missing_transactional_delete(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    f = nodes.where("type = 'FUNCTION'")
    callers = f.where("is_transactional").select("graph_id", F.col("id").alias("src"))
    covered = edges.where("type = 'FUNCTION_CALL'").join(callers, ["graph_id", "src"], "left_semi").select("graph_id", F.col("tgt").alias("id"))
    name, path = F.col("name"), F.col("file_path")
    f = f.where(F.lower("language").isin("java", "kotlin") & name.rlike("^(delete|remove)By[A-Z]") & ~name.isin("deleteById", "removeById") & ~F.col("is_transactional"))
    f = f.where(~P.is_test_artifact(path, name) & P.in_layer(path, P.INFRA_DIRS) & P.in_layer(path, P.PERSISTENCE_DIRS)).join(covered, ["graph_id", "id"], "left_anti")
    return _single(f, "MISSING_TRANSACTIONAL_DELETE", "HIGH", "Derived delete outside a transaction: ")


def missing_converter_migration(tables: DataFrame) -> DataFrame:
    """tables: graph_id, id, name, converter_migration_done, columns array<struct<column_name, has_converter>>."""
    conv = F.filter("columns", lambda c: c["has_converter"])
    bad = (F.size(conv) > 0) & ~F.coalesce("converter_migration_done", F.lit(False)) & ~F.forall(conv, lambda c: c["column_name"].endswith("_encrypted"))
    return warning(tables.where(bad), "MISSING_CONVERTER_MIGRATION", "MEDIUM", ["id"], [], F.concat(F.lit("Converter without migration: "), "name"))


def dead_code_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    f = nodes.where("type = 'FUNCTION'")
    calls = edges.where("type = 'FUNCTION_CALL'").select("graph_id", F.col("tgt").alias("id")).distinct()
    called = f.join(calls, ["graph_id", "id"], "left_semi").select("graph_id", "name").distinct().withColumn("called", F.lit(True))
    per_name = Window.partitionBy("graph_id", "name")
    f = f.withColumn("defs", F.count(F.lit(1)).over(per_name)).join(calls, ["graph_id", "id"], "left_anti").join(called, ["graph_id", "name"], "left")
    name, path = F.col("name"), F.col("file_path")
    seg, is_called = F.concat(F.lit("/"), path), F.coalesce("called", F.lit(False))
    out = (F.length(name) > 4) & name.startswith("__") & name.endswith("__")
    out |= P.is_test_artifact(path, name) | (path.rlike(r"\.(tsx|jsx)$") & name.rlike("^[A-Z]"))
    out |= seg.rlike("/(interfaces|pages|components|hooks|utils|lib|application|infrastructure)/") | name.isin(P.FRAMEWORK_CALLS) | P.is_framework_call(name)
    port = seg.contains("/domain/") & (path.rlike(r"(Repository|Port)\.java$") | seg.contains("/port/"))
    out |= (port | (F.col("defs") >= 2)) & is_called
    out |= F.col("is_async") | F.col("is_framework_annotated") | F.col("referenced_as_value")
    return f.where(~out).select("graph_id", "id", "name", "file_path")


def dead_code(nodes: DataFrame, edges: DataFrame, min_functions: int = 30, min_hits: int = 10, ratio: float = 0.04) -> DataFrame:
    """Functions that nothing calls; one summary instead where they are too many to be believed."""
    hits = dead_code_candidates(nodes, edges)
    total = nodes.where("type = 'FUNCTION'").groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    gate = hits.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).join(total, "graph_id")
    gate = gate.withColumn("gated", (F.col("total") >= min_functions) & (F.col("n") >= min_hits) & (F.col("n") / F.col("total") >= ratio))
    detail = _single(hits.join(gate.where("NOT gated").select("graph_id"), "graph_id", "left_semi"), "DEAD_CODE", "LOW", "Never called: ")
    pct = F.floor(F.col("n") / F.col("total") * 100 + 0.5).cast("int")
    summary = warning(gate.where("gated"), "DEAD_CODE", "LOW", [], [], F.concat(F.lit("Functions without calls: "), pct.cast("string"), F.lit("% ("), F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")")))
    return detail.unionByName(summary)


def high_fan_out(nodes: DataFrame, edges: DataFrame, threshold: int = 7) -> DataFrame:
    calls = edges.where("type = 'FUNCTION_CALL' AND NOT same_file").groupBy("graph_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
    name, path = F.col("name"), F.col("file_path")
    f = nodes.where("type = 'FUNCTION' AND NOT is_test AND name <> 'main' AND coalesce(merged_def_count, 1) < 2").select("graph_id", "id", "name", "file_path")
    # few functions call so many, and only their paths are looked at
    f = materialise(f.join(calls.hint("merge"), ["graph_id", "id"])).where(~P.is_test_artifact(path, name) & ~P.is_orchestrator(path, name))
    return _single(f, "HIGH_FAN_OUT", "LOW", F.concat(F.lit("Calls "), F.col("n").cast("string"), F.lit(" functions: ")))


def domain_imports_infra(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    e = _imports(nodes, edges, "domain", "infra", "in_shared", ends=ends).where("src_domain AND tgt_infra AND NOT tgt_in_shared")
    return _pair(e, "DOMAIN_IMPORTS_INFRA", "HIGH", "Domain imports infrastructure")


def interfaces_imports_infra(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    e = _imports(nodes, edges, "interface_dir", "infra", "in_shared", "root_file", ends=ends).where("src_interface_dir AND tgt_infra AND NOT tgt_in_shared AND NOT src_root_file")
    return _pair(e, "INTERFACES_IMPORTS_INFRA", "MEDIUM", "Interface layer imports infrastructure")


def ddd_gate(nodes: DataFrame) -> DataFrame:
    """graph_id, is_ddd: at least two of the domain, application and infrastructure layers are present."""
    path = F.col("file_path")
    has = [F.max(P.in_layer(path, d).cast("int")) for d in (P.DOMAIN_DIRS, P.APPLICATION_DIRS, P.INFRA_DIRS)]
    return nodes.groupBy("graph_id").agg((sum(has[1:], has[0]) >= 2).alias("is_ddd"))


def db_layer_bypass(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """In ``graphs`` (graph_id), else in those with the layers of domain-driven design."""
    nodes, edges = _in_ddd(nodes, edges, graphs)
    e = _imports(nodes, edges.where("NOT is_interface_impl"), "upper", "infra", "persistence", "root_file", "error_file")
    e = e.where("src_upper AND NOT src_root_file AND tgt_infra AND tgt_persistence AND NOT tgt_error_file")
    return _pair(e, "DB_LAYER_BYPASS", "HIGH", "Upper layer imports persistence")


def context_first(nodes: DataFrame) -> DataFrame:
    """graph_id, contexts: directories that precede two or more layer names, where a graph has two or more of them."""
    own = nodes.where(~P.is_test_artifact(F.col("file_path"), F.coalesce("name", F.lit(""))))
    seg = own.select("graph_id", F.split("file_path", "/").alias("s")).select("graph_id", F.explode(F.arrays_zip(F.expr("slice(s, 1, greatest(size(s) - 1, 0))").alias("seg"), F.expr("slice(s, 2, greatest(size(s) - 1, 0))").alias("following"))).alias("x")).select("graph_id", "x.*")
    seg = seg.where((F.col("seg") != "") & ~F.col("seg").isin(P.LAYER_TERMS) & F.col("following").isin(P.BOUNDARY_LAYERS))
    seg = seg.groupBy("graph_id", "seg").agg(F.countDistinct("following").alias("n")).where("n >= 2")
    return seg.groupBy("graph_id").agg(F.array_sort(F.collect_set("seg")).alias("contexts")).where(F.size("contexts") >= 2)


def contexts(nodes: DataFrame) -> DataFrame:
    """graph_id, file_path, app_context, dom_context, fn_context: once a path, written, so that no regular expression is laid into later joins."""
    paths = nodes.select("graph_id", "file_path").distinct().join(context_first(nodes), "graph_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    path = F.col("file_path")
    both = materialise(paths.select("graph_id", "file_path", P.application_context(path, F.col("contexts")).alias("app_context"), P.domain_context(path, F.col("contexts")).alias("dom_context")))
    return both.withColumn("fn_context", F.coalesce("dom_context", "app_context"))


def with_contexts(nodes: DataFrame) -> DataFrame:
    """Nodes with app_context, dom_context and fn_context."""
    return nodes.join(contexts(nodes), ["graph_id", "file_path"])


def _in_ddd(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of ``graphs``, else of the graphs with the layers of domain-driven design."""
    gate = materialise(ddd_gate(nodes).where("is_ddd").select("graph_id")) if graphs is None else graphs.select("graph_id")
    return nodes.join(gate, "graph_id", "left_semi"), edges.join(gate, "graph_id", "left_semi")


def cross_context_import(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """In ``graphs`` (graph_id), else in those with the layers of domain-driven design."""
    nodes, edges = _in_ddd(nodes, edges, graphs)
    n = classified(with_contexts(nodes))
    gate = n.where("NOT test").select("graph_id", F.explode(F.array("app_context", "dom_context")).alias("c")).where("c IS NOT NULL").groupBy("graph_id").agg(F.countDistinct("c").alias("n")).where("n >= 2")
    e = with_ends(edges.where("type = 'IMPORT'"), n, "test", "app_context", "dom_context").join(gate, "graph_id", "left_semi")
    return _pair(e.where("NOT src_test AND src_app_context <> tgt_dom_context"), "CROSS_CONTEXT_IMPORT", "HIGH", "Import across contexts")


def cross_domain_call(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """In ``graphs`` (graph_id), else in those with the layers of domain-driven design."""
    nodes, edges = _in_ddd(nodes, edges, graphs)
    n = classified(with_contexts(nodes)).withColumn("aside", F.col("file_path").rlike("/(infrastructure|shared|port|adapter)/"))
    shared = n.where("type = 'FUNCTION' AND NOT test AND fn_context IS NOT NULL").groupBy("graph_id", F.col("name").alias("tgt_name")).agg(F.countDistinct("fn_context").alias("n")).where("n >= 2")
    n = materialise(n.where("NOT test AND fn_context IS NOT NULL").select("graph_id", "id", "name", "file_path", "language", "fn_context", "aside", "framework"))
    e = with_ends(edges.where("type = 'FUNCTION_CALL'"), n, "fn_context", "aside", "framework")
    e = e.where("src_fn_context <> tgt_fn_context AND NOT tgt_aside AND NOT tgt_framework").where(~F.col("src_file_path").contains("/infrastructure/"))
    return _pair(e.join(shared, ["graph_id", "tgt_name"], "left_anti"), "CROSS_DOMAIN_CALL", "MEDIUM", "Call across domains")


def feature_gate(nodes: DataFrame) -> DataFrame:
    """Graphs with two or more features, a frontend language and no Redux-style layout."""
    path = F.col("file_path")
    # a path is looked at once, whatever the number of its nodes
    paths = nodes.groupBy("graph_id", "file_path").agg(F.max(F.lower("language").isin(FRONTEND)).alias("frontend"))
    g = paths.groupBy("graph_id").agg(F.countDistinct(P.feature_of(path)).alias("features"), F.max("frontend").alias("frontend"), F.max(path.rlike("(^|/)features/[^/]+/[^/]*[sS]lice\\.(ts|js|tsx|jsx)$")).alias("redux"))
    return g.where("features >= 2 AND frontend AND NOT redux").select("graph_id")


def cross_feature_import(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    e = _imports(nodes, edges, "feature", ends=ends).join(feature_gate(nodes), "graph_id", "left_semi").where("src_feature <> tgt_feature")
    return _pair(e, "CROSS_FEATURE_IMPORT", "HIGH", "Feature imports feature")


def feature_layer_violation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = _imports(nodes, edges, "front_rank").join(feature_gate(nodes), "graph_id", "left_semi").where("src_front_rank > tgt_front_rank")
    return _pair(e, "FEATURE_LAYER_VIOLATION", "HIGH", "Import against the layer order")


def _layer_files(nodes: DataFrame) -> DataFrame:
    """Classified files outside tests whose layer is known, with its ``rank``."""
    path = F.col("file_path")
    return classified(nodes.where("type = 'FILE'")).where(~P.is_test_path(path) & ~F.col("test")).withColumn("rank", P.layer_rank(path)).where("rank IS NOT NULL")


def _layered(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Imports between layers where a graph has two or more and no features: in ``graphs``, else in those without the layers of domain-driven design."""
    n = _layer_files(nodes)
    layers = n.groupBy("graph_id").agg(F.countDistinct("rank").alias("layers"), F.max((F.col("rank") == 1).cast("int")).alias("has_service")).where("layers >= 2")
    e = with_ends(edges.where("type = 'IMPORT'"), n, "rank", "infra", "in_shared", "domain", "interface_dir", "root_file").join(layers, "graph_id").join(feature_gate(nodes), "graph_id", "left_anti")
    e = e.join(ddd_gate(nodes).where("is_ddd"), "graph_id", "left_anti") if graphs is None else e.join(graphs.select("graph_id"), "graph_id", "left_semi")
    return e.where("NOT (tgt_infra AND NOT tgt_in_shared AND (src_domain OR (src_interface_dir AND NOT src_root_file)))")


def layered_reverse_dependency(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    return _pair(_layered(nodes, edges, graphs).where("src_rank > tgt_rank"), "LAYERED_REVERSE_DEPENDENCY", "HIGH", "Lower layer imports upper")


def layered_bypass(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    return _pair(_layered(nodes, edges, graphs).where("src_rank = 0 AND tgt_rank = 2 AND has_service = 1"), "LAYERED_BYPASS", "MEDIUM", "Controller imports repository")


def modules_of(nodes: DataFrame, modules: DataFrame, projects: DataFrame) -> DataFrame:
    """graph_id, file_path, module: the first declared module of the graph's project whose glob matches.

    modules: project_id, module, ord, glob; projects: graph_id, project_id. Globs are matched within a project, once a path.
    """
    files = nodes.select("graph_id", "file_path").distinct().join(projects.select("graph_id", "project_id"), "graph_id")
    globs = modules.select("project_id", "module", F.col("ord").alias("nth"), P.glob_to_regex(F.col("glob")).alias("rx"))
    return files.join(globs, "project_id").where("file_path RLIKE rx").groupBy("graph_id", "file_path").agg(F.min_by("module", "nth").alias("module"))


def intent_drift(nodes: DataFrame, edges: DataFrame, modules: DataFrame, rules: DataFrame, projects: DataFrame) -> DataFrame:
    """rules: project_id, source, target, edge_type (null or unknown: IMPORT). Each project's modules and rules hold for its own graphs."""
    n = nodes.join(materialise(modules_of(nodes, modules, projects)), ["graph_id", "file_path"])
    known = rules.select("project_id", F.col("source").alias("src_module"), F.col("target").alias("tgt_module"), F.when(F.col("edge_type") == "FUNCTION_CALL", F.col("edge_type")).otherwise("IMPORT").alias("type")).distinct()
    e = with_ends(edges.where("type IN ('IMPORT', 'FUNCTION_CALL')"), n, "module").join(projects.select("graph_id", "project_id"), "graph_id").join(known, ["project_id", "src_module", "tgt_module", "type"])
    first = Window.partitionBy("graph_id", "type", "src_module", "tgt_module", "src_file_path", "tgt_file_path").orderBy("ord", "edge_identifier")
    return _pair(e.withColumn("rn", F.row_number().over(first)).where("rn = 1"), "INTENT_DRIFT", "HIGH", "Forbidden dependency")


def shared_database_access(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables that two or more services read or write, with the first access of each service."""
    n = classified(nodes)
    users = n.where("NOT test AND service IS NOT NULL").select("graph_id", F.col("id").alias("src"), "service")
    tables = n.where("type = 'DB_TABLE'").select("graph_id", F.col("id").alias("tgt"), F.col("name").alias("tgt_name"))
    e = edges.where(F.col("type").isin(DB_ACCESS)).join(tables, ["graph_id", "tgt"]).join(users, ["graph_id", "src"])
    one = e.groupBy("graph_id", "tgt", "tgt_name", "service").agg(F.min(F.struct("ord", "edge_identifier", "src")).alias("first"))
    g = one.groupBy("graph_id", "tgt", "tgt_name").agg(F.array_sort(F.collect_list(F.struct("first.ord", "first.edge_identifier", "first.src", "service"))).alias("by")).where(F.size("by") >= 2)
    return g.select("graph_id", F.lit("SHARED_DATABASE_ACCESS").alias("type"), F.lit("MEDIUM").alias("severity"), F.concat("by.src", F.array("tgt")).alias("node_ids"), F.col("by.edge_identifier").alias("edge_ids"), F.concat(F.lit("Table shared by services: "), "tgt_name", F.lit(" by "), F.array_join("by.service", ", ")).alias("message"))


def _components_in_order(out: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components of a graph, each after those that it leads to."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, on, found = [], set(), []
    for start in sorted(out):
        todo = [(start, iter(out[start]))] if start not in number else []
        while todo:
            node, rest = todo[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                stack.append(node)
                on.add(node)
            step = next((v for v in rest if v not in number or v in on), None)
            if step is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    at = stack.index(node)
                    found.append(stack[at:])
                    on.difference_update(stack[at:])
                    del stack[at:]
            elif step not in number:
                todo.append((step, iter(out[step])))
            else:
                low[node] = min(low[node], number[step])
    return found


def longest_paths(out: dict[str, list[str]]) -> dict[str, list[str]]:
    """The longest simple path from each node, of equal ones the first by its names joined with ``>``.

    Nodes are taken component by component, after those that they lead to. A path never comes back to a component that it has left, so what it has
    passed matters inside a component alone: states are a node and the part of its own component that has been passed.
    """
    best: dict[str, tuple[int, bytes, list[str]]] = {}
    for component in _components_in_order(out):
        inside, known = set(component), {}

        def ahead(node: str, passed: frozenset) -> tuple[int, bytes, list[str]]:
            if (node, passed) not in known:
                steps = [ahead(v, passed | {v}) if v in inside else best[v] for v in out[node] if v not in passed]
                longest = min(steps, key=lambda s: (-s[0], s[1]), default=(0, b"", []))
                name = node.encode()
                known[node, passed] = (longest[0] + 1, name + b">" + longest[1] if longest[0] else name, [node, *longest[2]])
            return known[node, passed]

        best.update({node: ahead(node, frozenset([node])) for node in component})
    return {node: path for node, (_, _, path) in best.items()}


def _chains(min_hops: int):
    def chains(key, calls: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        first = {}
        for a, b, edge, src, tgt in zip(*(calls[c] for c in ("a", "b", "edge_identifier", "src", "tgt"))):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
            first[a, b] = (edge, src, tgt)
        called = {b for a in out for b in out[a]}
        paths = longest_paths(out)
        rows = []
        for start in sorted(out.keys() - called or out):
            path = paths[start]
            if len(path) > min_hops:
                hops = [first[x] for x in zip(path, path[1:])]
                rows.append((key[0], [h[1] for h in hops] + [hops[-1][2]], [h[0] for h in hops], path))
        return pd.DataFrame(rows, columns=["graph_id", "node_ids", "edge_ids", "path"])

    return chains


def service_call_chain(nodes: DataFrame, edges: DataFrame, min_hops: int = 2) -> DataFrame:
    """The longest chain of services from each service that none calls, else from each; ties by the services' names.

    Nodes are the callers' files of each hop's first call and the last callee's file, edges these calls. A graph's services, one row for each
    two that call, are one task; no list of all paths is made.
    """
    e = with_ends(edges.where("type = 'SERVICE_CALL'"), classified(nodes), "test", "service").where("NOT src_test AND src_service <> tgt_service")
    hop = F.min(F.struct("ord", "edge_identifier", "src", "tgt")).alias("call")
    e = e.groupBy("graph_id", F.col("src_service").alias("a"), F.col("tgt_service").alias("b")).agg(hop).select("graph_id", "a", "b", "call.edge_identifier", "call.src", "call.tgt")
    found = e.groupBy("graph_id").applyInPandas(_chains(min_hops), "graph_id long, node_ids array<string>, edge_ids array<string>, path array<string>")
    message = F.concat(F.lit("Service chain: "), F.array_join("path", " -> ")).alias("message")
    return found.select("graph_id", F.lit("SERVICE_CALL_CHAIN").alias("type"), F.lit("MEDIUM").alias("severity"), "node_ids", "edge_ids", message)


GRAPH_RULES = {
    "r1_cyclic_import": cyclic_import, "r2_circular_bean_dependency": circular_bean_dependency, "r3_broken_interface_chain": broken_interface_chain, "r4_async_self_call": async_self_call,
    "r5_missing_transactional_delete": missing_transactional_delete, "r7_dead_code": dead_code, "r8_high_fan_out": high_fan_out, "r9_domain_imports_infra": domain_imports_infra,
    "r10_interfaces_imports_infra": interfaces_imports_infra, "r11_db_layer_bypass": db_layer_bypass, "r12_cross_context_import": cross_context_import, "r13_cross_domain_call": cross_domain_call,
    "r14_cross_feature_import": cross_feature_import, "r15_feature_layer_violation": feature_layer_violation, "r16_layered_reverse_dependency": layered_reverse_dependency,
    "r17_layered_bypass": layered_bypass, "r19_shared_database_access": shared_database_access, "r20_service_call_chain": service_call_chain,
}


#: Rules of one architecture only; all others always run.
DDD_RULES = ["r11_db_layer_bypass", "r12_cross_context_import", "r13_cross_domain_call"]
LAYERED_RULES = ["r16_layered_reverse_dependency", "r17_layered_bypass"]
#: Types of warnings by architecture.
RULE_TYPES = {"DDD": ["DB_LAYER_BYPASS", "CROSS_CONTEXT_IMPORT", "CROSS_DOMAIN_CALL"], "LAYERED": ["LAYERED_REVERSE_DEPENDENCY", "LAYERED_BYPASS"], "GENERIC": []}
FEATURE_RULE_TYPES = ["CROSS_FEATURE_IMPORT", "FEATURE_LAYER_VIOLATION"]
SERVICE_RULE_TYPES = ["SHARED_DATABASE_ACCESS", "SERVICE_CALL_CHAIN"]


def service_gate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id of graphs with a call between services, or with two or more services that access tables."""
    owners = nodes.select("graph_id", F.col("id").alias("src"), P.service_of(F.col("file_path")).alias("service")).where("service IS NOT NULL")
    tables = nodes.where("type = 'DB_TABLE'").select("graph_id", F.col("id").alias("tgt"))
    access = edges.where(F.col("type").isin(DB_ACCESS)).join(tables, ["graph_id", "tgt"], "left_semi").join(owners, ["graph_id", "src"])
    many = access.groupBy("graph_id").agg(F.countDistinct("service").alias("n")).where("n >= 2").select("graph_id")
    return many.unionByName(edges.where("type = 'SERVICE_CALL'").select("graph_id")).distinct()


def themes(nodes: DataFrame, edges: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """graph_id, policy, theme, is_ddd, has_features, has_services, self_declared, rule_types: the architecture whose rules hold for each graph.

    policies: graph_id, policy (AUTO, DDD or LAYERED; missing or unknown: AUTO, by what the graph has: the layers of domain-driven design, else
    two or more layers without features, else GENERIC). ``rule_types`` are the theme's, those of features and of services where they are active.
    """
    active = lambda df, name: df.select("graph_id").distinct().withColumn(name, F.lit(True))
    layers = _layer_files(nodes).groupBy("graph_id").agg(F.countDistinct("rank").alias("n")).where("n >= 2")
    g = ddd_gate(nodes).join(active(feature_gate(nodes), "has_features"), "graph_id", "left").join(active(layers, "has_layers"), "graph_id", "left").join(active(service_gate(nodes, edges), "has_services"), "graph_id", "left")
    g = g.na.fill(False, ["has_features", "has_layers", "has_services"])
    g = g.join(policies, "graph_id", "left") if policies is not None else g.withColumn("policy", F.lit(None).cast("string"))
    g = g.withColumn("policy", F.when(F.col("policy").isin("DDD", "LAYERED"), F.col("policy")).otherwise("AUTO"))
    theme = F.when(F.col("policy") != "AUTO", F.col("policy")).when(F.col("is_ddd"), "DDD").when(F.col("has_layers") & ~F.col("has_features"), "LAYERED").otherwise("GENERIC")
    types = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    none = types([])
    own = F.coalesce(*[F.when(F.col("theme") == t, types(names)) for t, names in RULE_TYPES.items()])
    extra = F.concat(F.when(F.col("has_features"), types(FEATURE_RULE_TYPES)).otherwise(none), F.when(F.col("has_services"), types(SERVICE_RULE_TYPES)).otherwise(none))
    g = g.withColumn("theme", theme).withColumn("rule_types", F.concat(own, extra)).withColumn("self_declared", F.col("policy") != "AUTO")
    return g.select("graph_id", "policy", "theme", "is_ddd", "has_features", "has_services", "self_declared", "rule_types")


def detect(nodes: DataFrame, edges: DataFrame, policies: DataFrame | None = None, tables: DataFrame | None = None, intent: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """All rules at once; those of one architecture run on the graphs of that theme, whether it was found or declared.

    ``tables`` (see ``missing_converter_migration``) and ``intent`` (modules, rules and projects, see ``intent_drift``) add the rules that read them.
    """
    theme = materialise(themes(nodes, edges, policies).select("graph_id", "theme"))
    ddd, other = theme.where("theme = 'DDD'").select("graph_id"), theme.where("theme <> 'DDD'").select("graph_id")
    out = None
    for name, rule in GRAPH_RULES.items():
        found = rule(nodes, edges, ddd) if name in DDD_RULES else rule(nodes, edges, other) if name in LAYERED_RULES else rule(nodes, edges)
        out = found if out is None else out.unionByName(found)
    if tables is not None:
        out = out.unionByName(missing_converter_migration(tables))
    if intent is not None:
        out = out.unionByName(intent_drift(nodes, edges, *intent))
    return out
