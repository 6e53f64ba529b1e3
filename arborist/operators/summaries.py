"""Comparisons of graph versions, and what summarises, samples or filters the nodes and edges of many graphs at once.

Nodes and edges carry ``graph_id``, which is in every key. Null keys of a comparison equal each other; edges whose end is
null or missing have no neighbour. Ties are broken by id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Calls in and out that make a hub, hubs listed, calls out of a hot function, nodes of a summary, edges sampled of a type, results of a search, entry points listed.
HUB_DEGREE, HUBS, HOT_CALLS, SUMMARY_NODES, SAMPLE, FOUND, ENTRY_POINTS = 3, 15, 4, 50, 30, 10, 15
#: The normal quantile of the interval of a precision.
Z = 1.96


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("in_old", F.lit(1)).withColumn("in_new", F.lit(0)).unionByName(new.withColumn("in_old", F.lit(0)).withColumn("in_new", F.lit(1)))


def _status() -> Column:
    return F.when(F.max("in_old") == 0, "ADDED").when(F.max("in_new") == 0, "REMOVED").otherwise("UNCHANGED").alias("status")


def node_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, status: ADDED, REMOVED or UNCHANGED, once for each key of either version. One grouping, no join."""
    return _sides(old.select(*key), new.select(*key)).groupBy(*key).agg(_status())


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """edge_identifier, src_name, tgt_name, status; names are the old version's where it has the edge."""
    names = [F.coalesce(F.max(F.when(F.col("in_old") == 1, F.col(c))), F.max(c)).alias(c) for c in ("src_name", "tgt_name")]
    both = _sides(*(d.select("edge_identifier", "src_name", "tgt_name") for d in (old, new)))
    return both.groupBy("edge_identifier").agg(*names, _status())


def diff_summary(diff: DataFrame) -> DataFrame:
    """status, n."""
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the name and path of both ends; edges that lack one are left out."""
    for side in ("src", "tgt"):
        end = nodes.select("graph_id", F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_path"))
        edges = edges.join(end, ["graph_id", side])
    return edges


def _calls(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'FUNCTION_CALL' AND src IS NOT NULL AND tgt IS NOT NULL")


def _first(rows: DataFrame, n: int, by: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def hubs(edges: DataFrame, least: int = HUB_DEGREE) -> DataFrame:
    """graph_id, id, fan_in, fan_out of functions that are called and call at least so often."""
    c = _calls(edges)
    ends = c.select("graph_id", F.col("tgt").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(c.select("graph_id", F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("graph_id", "id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).where((F.col("fan_in") >= least) & (F.col("fan_out") >= least))


def top_hubs(edges: DataFrame, top: int = HUBS) -> DataFrame:
    """The hubs of each graph with the largest smaller degree, rn from 1."""
    return _first(hubs(edges), top, ["graph_id"], F.least("fan_in", "fan_out").desc(), F.col("id"))


def search(nodes: DataFrame, text: str, limit: int = FOUND) -> DataFrame:
    """The first nodes, by id, whose name or comment contains a text in any case."""
    has = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in ("name", "comment")]
    return nodes.where(has[0] | has[1]).orderBy("id").limit(limit)


def node_budget(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id, visible: all nodes but functions that are no hubs."""
    hub = hubs(edges).select("graph_id", "id", F.lit(True).alias("hub"))
    return nodes.select("graph_id", "id", "type").join(hub, ["graph_id", "id"], "left").select("graph_id", "id", ((F.col("type") != "FUNCTION") | F.col("hub").isNotNull()).alias("visible"))


def undocumented_hot(nodes: DataFrame, edges: DataFrame, top: int = HUBS) -> DataFrame:
    """graph_id, id, n, rn: functions without a comment that make the most calls."""
    n = _calls(edges).groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= HOT_CALLS)
    bare = nodes.where("type = 'FUNCTION' AND comment IS NULL").select("graph_id", "id")
    return _first(bare.join(n, ["graph_id", "id"]), top, ["graph_id"], F.col("n").desc(), F.col("id"))


def summary_edges(nodes: DataFrame, edges: DataFrame, most: int = SUMMARY_NODES) -> DataFrame:
    """Edges among all tables and endpoints and the first files and functions of each graph."""
    code = _first(nodes.where("type IN ('FILE', 'FUNCTION')"), most, ["graph_id"], F.col("type"), F.col("ord"), F.col("id"))
    kept = code.select("graph_id", "id").unionByName(nodes.where("type IN ('DB_TABLE', 'API_ENDPOINT')").select("graph_id", "id"))
    return edges.join(kept.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(kept.withColumnRenamed("id", "tgt"), ["graph_id", "tgt"], "left_semi")


def edge_sample(edges: DataFrame, seed: int = 42, most: int = SAMPLE) -> DataFrame:
    """type, edge_identifier, rn: some edges of each type, the same for the same seed."""
    return _first(edges.select("type", "edge_identifier"), most, ["type"], F.md5(F.concat(F.lit(f"{seed}|"), "edge_identifier")), F.col("edge_identifier"))


def audit_precision(audited: DataFrame) -> DataFrame:
    """type, n, phantom, rate, low, high: the share of ``phantom`` edges of each type with its Wilson interval."""
    n = audited.groupBy("type").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("phantom").cast("double")).alias("phantom"))
    p, k = F.col("rate"), F.col("n")
    mid, spread, scale = p + Z * Z / 2 / k, Z * F.sqrt((p * (1 - p) + Z * Z / 4 / k) / k), 1 + Z * Z / k
    return n.withColumn("rate", F.col("phantom") / k).withColumn("low", F.greatest(F.lit(0.0), (mid - spread) / scale)).withColumn("high", F.least(F.lit(1.0), (mid + spread) / scale))


def entry_points(nodes: DataFrame, ends: DataFrame, most: int = ENTRY_POINTS) -> DataFrame:
    """graph_id, id, pos: endpoints, then functions that no other file calls; the first of each graph."""
    called = ends.where("type = 'FUNCTION_CALL' AND src_path <> tgt_path").select("graph_id", F.col("tgt").alias("id"))
    found = nodes.where("type = 'FUNCTION'").join(called, ["graph_id", "id"], "left_anti").select("graph_id", "id", "ord", F.lit(1).alias("kind"))
    found = found.unionByName(nodes.where("type = 'API_ENDPOINT'").select("graph_id", "id", "ord", F.lit(0).alias("kind")))
    return _first(found, most, ["graph_id"], F.col("kind"), F.col("ord"), F.col("id"), name="pos").select("graph_id", "id", "pos")


def _between_files(ends: DataFrame) -> DataFrame:
    return ends.where("type = 'FUNCTION_CALL' AND src_path <> tgt_path")


def file_calls(ends: DataFrame) -> DataFrame:
    """graph_id, src_path, tgt_path, n, first_caller: the calls behind each pair of files."""
    return _between_files(ends).groupBy("graph_id", "src_path", "tgt_path").agg(F.count("*").alias("n"), F.min("src_name").alias("first_caller"))


def callers_callees(ends: DataFrame) -> DataFrame:
    """id, side, other, file: each function's callers and callees in other files."""
    return _between_files(ends).select(F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.lit("callee").alias("side"), F.col("tgt").alias("other"), F.col("tgt_path").alias("file")),
        F.struct(F.col("tgt").alias("id"), F.lit("caller").alias("side"), F.col("src").alias("other"), F.col("src_path").alias("file")),
    )))


def table_access(edges: DataFrame) -> DataFrame:
    """graph_id, tgt, src, r, w, c, u, d: whether a source reads, writes, creates, updates and deletes rows of a table."""
    kinds = [F.max((F.col("type") == t).cast("int")).alias(c) for c, t in (("r", "DB_READ"), ("w", "DB_WRITE"), ("c", "DB_CREATE"), ("u", "DB_UPDATE"), ("d", "DB_DELETE"))]
    return edges.where("type LIKE 'DB%'").groupBy("graph_id", "tgt", "src").agg(*kinds)


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_identifier, state: dangling where an end is missing, ok where both ends fit the type, else mismatch. Edges from a node to itself are left out."""
    out = edges.where("src <> tgt")
    for side in ("src", "tgt"):
        out = out.join(nodes.select("graph_id", F.col("id").alias(side), F.col("type").alias(f"{side}_type")), ["graph_id", side], "left")
    s, t, e = F.col("src_type"), F.col("tgt_type"), F.col("type")
    fits = ((e == "IMPORT") & (s == "FILE") & (t == "FILE")) | ((e == "FUNCTION_CALL") & (s == "FUNCTION") & (t == "FUNCTION"))
    fits = fits | (e.startswith("DB") & (t == "DB_TABLE")) | (e.isin("API_CALL", "SERVICE_CALL", "FIELD_DEPENDENCY") & (s == "FILE"))
    return out.select("edge_identifier", F.when(s.isNull() | t.isNull(), "dangling").when(fits, "ok").otherwise("mismatch").alias("state"))


def node_counts(nodes: DataFrame) -> DataFrame:
    """graph_id and its numbers of files, functions, tables and endpoints."""
    kinds = {"files": "FILE", "functions": "FUNCTION", "db_tables": "DB_TABLE", "endpoints": "API_ENDPOINT"}
    return nodes.groupBy("graph_id").agg(*(F.count_if(F.col("type") == t).alias(c) for c, t in kinds.items()))


SECTION = "layer-section-"


def edge_visibility(edges: DataFrame, shown: set[str]) -> DataFrame:
    """Adds ``visible``: whether an edge's switch is on in ``shown`` (imports, broken, calls, instances, database, api); edges of other types always are.

    ``broken`` (a column of edges, null: false) tells imports in a cycle, which have a switch of their own.
    """
    t, on = F.col("type"), lambda switch: F.lit(switch in shown)
    broken = F.coalesce(F.col("broken"), F.lit(False))
    visible = F.when((t == "IMPORT") & broken, on("broken")).when(t == "IMPORT", on("imports")).when(t == "FUNCTION_CALL", on("calls")).when(t == "INSTANTIATION", on("instances"))
    visible = visible.when(t.isin("DB_READ", "DB_WRITE", "DB_CREATE", "DB_UPDATE", "DB_DELETE"), on("database")).when(t == "API_CALL", on("api"))
    return edges.withColumn("visible", visible.otherwise(F.lit(True)))


def layer_visibility(layout: DataFrame, opaque: DataFrame) -> DataFrame:
    """layout (graph_id, id, parent_id, hidden) with ``hidden`` set anew by layer, and ``opaque`` of sections.

    Nodes named ``SECTION`` and a layer are sections; groups lie in sections, files in groups, functions in files. Everything up to three levels
    below a section is hidden if its (graph_id, layer) is in ``opaque`` and shown if it isn't, whatever it was before; sections are never
    hidden; nodes below no section, or deeper, stay as they are. The nearest section decides.
    """
    is_section = lambda c: F.coalesce(F.startswith(c, F.lit(SECTION)), F.lit(False))
    up = layout.where(~is_section(F.col("id")))
    parent = lambda i: up.select("graph_id", F.col("id").alias(f"p{i}"), F.col("parent_id").alias(f"p{i + 1}"))
    chain = layout.withColumn("p1", F.col("parent_id")).join(parent(1), ["graph_id", "p1"], "left").join(parent(2), ["graph_id", "p2"], "left")
    of = F.coalesce(*[F.when(is_section(F.col(p)), F.col(p)) for p in ("p1", "p2", "p3")])
    chain = chain.withColumn("section", F.when(is_section(F.col("id")), F.col("id")).otherwise(of))
    known = layout.where(is_section(F.col("id"))).select("graph_id", F.col("id").alias("section"), F.substring("id", len(SECTION) + 1, 1 << 30).alias("layer")).distinct()
    state = known.join(opaque.select("graph_id", "layer").distinct().withColumn("on", F.lit(True)), ["graph_id", "layer"], "left").select("graph_id", "section", F.coalesce("on", F.lit(False)).alias("on"))
    chain = chain.join(state, ["graph_id", "section"], "left")
    own = is_section(F.col("id"))
    return chain.select(*layout.drop("hidden").columns, F.when(own, False).otherwise(F.coalesce("on", "hidden")).alias("hidden"), F.when(own, F.col("on")).alias("opaque"))
