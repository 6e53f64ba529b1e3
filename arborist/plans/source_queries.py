"""Queries from source text to graph: the derived code graphs written out as source files, read back by extraction.

``sources`` renders each FILE node as a file of its language, with the functions, calls, imports, endpoints and table accesses
that the derived graph gives it, and with comments that hold code. The SQL states from the graph's tables what extraction has to find.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.extract import facts as X
from arborist.extract import graph as B
from arborist.storage import materialise

from . import testgraph as G


def _lines(df: DataFrame, keys: list[str], text, order: list[str], name: str) -> DataFrame:
    """The texts of a group's rows in order, a line each."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias(name))


def _by(java, kotlin, python, script):
    return F.when(F.col("language") == "Java", java).when(F.col("language") == "Kotlin", kotlin).when(F.col("language") == "Python", python).otherwise(script)


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = G.nodes(spark, sf_dir), G.edges(spark, sf_dir)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) if isinstance(p, str) else p for p in parts])
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    files = n.where("type = 'FILE'").select("graph_id", "id", "file_path", "language", "ord", stem.alias("stem"))
    # between files, and from files to tables: only these are read as ends
    tables = n.where("type = 'DB_TABLE'").select("graph_id", F.col("id").alias("tgt"), F.col("name").alias("tgt_name"))
    paths = files.select("graph_id", F.col("id").alias("tgt"), F.col("file_path").alias("tgt_path"))
    ends = lambda kinds, tgt: e.where(kinds).select("graph_id", "type", F.col("src").alias("id"), "tgt", "ord").join(files.select("graph_id", "id", "language"), ["graph_id", "id"]).join(tgt, ["graph_id", "tgt"])
    bare = F.regexp_replace("tgt_path", r"\.[^.]*$", "")
    dotted = F.replace(bare, F.lit("/"), F.lit("."))
    written = _by(text("import ", dotted, ";"), text("import ", dotted), text("from ", dotted, " import x"), text("import x from '", bare, "';"))
    imports = _lines(ends("type = 'IMPORT'", paths), ["graph_id", "id"], written, ["ord", "tgt"], "imports")
    access = F.when(F.col("type") == "DB_READ", text("SELECT * FROM ", "$tgt_name", " WHERE id = 1")).when(F.col("type") == "DB_WRITE", text("UPDATE ", "$tgt_name", " SET a = 1")).otherwise(text("DELETE FROM ", "$tgt_name", " WHERE id = 1"))
    q = text("q", F.col("ord").cast("string"))
    sql = _lines(ends("type LIKE 'DB%'", tables), ["graph_id", "id"], _by(text("    static String ", q, ' = "', access, '";'), text("    val ", q, ' = "', access, '"'), text(q, ' = "', access, '"'), text("const ", q, ' = "', access, '";')), ["ord", "tgt"], "queries")
    # calls of other services: by literal, by a field that holds the host, by a client of the language
    host, s = F.regexp_extract("tgt_path", "^services/([^/]+)/", 1), text("s", F.col("ord").cast("string"))
    # an order may call several files of other services: each has a field of its own name
    h = text("h", F.col("ord").cast("string"), "$tgt")
    field = text("    String ", h, ' = "http://', host, '/";\n    val ', s, " = client.uri(", h, ' + "x")')
    clients = _by(text("    Object ", s, ' = client.uri("http://', host, '/x");'), field, text(s, ' = requests.get(f"http://', host, '/x")'), text("const ", s, " = axios.get(`http://", host, "/x`);"))
    remote = _lines(ends("type = 'SERVICE_CALL'", paths), ["graph_id", "id"], clients, ["ord", "tgt"], "remote")
    # a call goes to its target for the name, then to its function, where the language is known
    called = n.where("type = 'FUNCTION'").select("graph_id", F.col("id").alias("tgt"), F.col("name").alias("callee"), stem.alias("target"))
    calls = e.where("type = 'FUNCTION_CALL'").select("graph_id", F.col("src").alias("id"), "tgt", "ord", "same_file").join(called, ["graph_id", "tgt"])
    calls = calls.groupBy("graph_id", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "tgt", "target", "callee", "same_file"))).alias("called"))
    fn = n.where("type = 'FUNCTION'").join(calls, ["graph_id", "id"], "left")
    call = lambda c: F.when(c["same_file"] & (F.col("language") == "Java"), F.concat(c["callee"], F.lit("(1)"))).otherwise(F.concat(c["target"], F.lit("."), c["callee"], F.lit("(2)")))
    stop = F.when(F.col("language").isin("Java", "TypeScript"), ";").otherwise("")
    fn = fn.withColumn("calls", F.array_join(F.transform("called", lambda c: F.concat(F.lit("        "), call(c), stop)), "\n"))
    body = F.coalesce("calls", F.lit("        pass"))
    plain = F.coalesce("calls", F.lit(""))
    said = lambda sign: F.when(F.col("comment").isNotNull(), text(sign, "$comment", "\n")).otherwise("")
    tag = lambda flag, t: F.when(F.col(flag), t).otherwise("")
    java = text(said("    // "), tag("is_async", "    @Async\n"), tag("is_transactional", "    @Transactional\n"), "    public void ", "$name", "(int a) {\n", plain, "\n    }")
    kotlin = text(said("    // "), tag("is_transactional", "    @Transactional\n"), "    fun ", "$name", "(a: Int) {\n", plain, "\n    }")
    python = text(said("# "), F.when(F.col("is_async"), "async ").otherwise(""), "def ", "$name", "(a):\n", body)
    script = text(said("// "), F.when(F.col("is_async"), "async ").otherwise(""), "function ", "$name", "(a) {\n", plain, "\n}")
    functions = _lines(fn, ["graph_id", "file_path"], _by(java, kotlin, python, script), ["ord"], "functions")
    point = n.where("type = 'API_ENDPOINT'").withColumn("url", F.regexp_replace("name", "^GET:", "")).withColumn("serve", text("serve", F.col("ord").cast("string")))
    serve = _by(text('    @GetMapping("', "$url", '")\n    public void ', "$serve", "(int a) {\n    }"), text('    @GetMapping("', "$url", '")\n    fun ', "$serve", "(a: Int) {\n    }"), text('@app.get("', "$url", '")\ndef ', "$serve", "(a):\n    pass"), text("app.get('", "$url", "', ", "$serve", ")\nfunction ", "$serve", "(a) {\n}"))
    points = _lines(point, ["graph_id", "file_path"], serve, ["ord"], "points")
    part = lambda c: F.coalesce(c, F.lit(""))
    f = files.join(imports, ["graph_id", "id"], "left").join(sql, ["graph_id", "id"], "left")
    f = f.join(remote, ["graph_id", "id"], "left").withColumn("queries", F.concat_ws("\n", "queries", "remote"))
    f = f.join(functions, ["graph_id", "file_path"], "left").join(points, ["graph_id", "file_path"], "left")
    hidden = "/* public void ghost(int a) { haunt(1); }\n import no.such; */\n"
    entity = F.when(F.col("ord") % 6 == 0, text('@Entity\n@Table(name = "tbl_', F.col("ord").cast("string"), '")\n')).otherwise("")
    fields = F.when(F.col("ord") % 6 == 0, '    private Long idKey;\n    @Column(name = "code_name")\n    @Convert(converter = X.class)\n    private String code;\n').otherwise("")
    classes = lambda word: text("// about ", "$stem", "\npackage a;\n", part("imports"), "\n", hidden, entity, word, "class ", "$stem", " {\n", fields, part("queries"), "\n", part("points"), "\n", part("functions"), "\n}\n")
    content = _by(classes("public "), classes(""), text("# about ", "$stem", "\nz = 1\n", part("imports"), "\n", part("queries"), "\n", part("points"), "\n", part("functions"), "\n# def ghost(): haunt(1)\n"), text("// about ", "$stem", "\nconst z = 1;\n", part("imports"), "\n", hidden, part("queries"), "\n", part("points"), "\n", part("functions"), "\n"))
    return f.select("graph_id", "file_path", "language", content.alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, file_path, language, content."""
    return G.once(spark, sf_dir, "sources", lambda: _build(spark, sf_dir))


@lru_cache(maxsize=4)
def _facts(app: str, sf_dir: str) -> B.Facts:
    spark = SparkSession.getActiveSession()
    return B.Facts(sources(spark, sf_dir))


def _of(spark: SparkSession, sf_dir: str) -> B.Facts:
    """The facts of the sources, whose tables are written once an application."""
    return _facts(spark.sparkContext.applicationId, sf_dir)


def _named(f: B.Facts, edges: DataFrame, src: str, tgt: str) -> DataFrame:
    """Edges between nodes of two types with paths and names in place of ids."""
    for side, kind in (("src", src), ("tgt", tgt)):
        n = B.node_names(f, (kind,))
        edges = edges.join(n.select("graph_id", F.col("id").alias(side), F.col("file_path").alias(f"{side}_path"), F.col("name").alias(f"{side}_name")), ["graph_id", side])
    return edges


def _over(extract, *columns):
    return lambda spark, sf_dir: extract(sources(spark, sf_dir)).select("graph_id", "file_path", *columns)


def _edges(build, src, tgt, *columns):
    def run(spark, sf_dir):
        f = _of(spark, sf_dir)
        return _named(f, build(f), src, tgt).select("graph_id", *columns)

    return run


def _nodes(kind, *columns):
    return lambda spark, sf_dir: B.nodes(_of(spark, sf_dir), (kind,)).select("graph_id", "file_path", *columns)


def _masked(spark, sf_dir):
    code = X.masked(sources(spark, sf_dir))
    return code.select("graph_id", "file_path", F.regexp_count("code", F.lit("ghost|haunt|about|no.such")).alias("in_comments"), F.regexp_count("code", F.lit("FROM table_|UPDATE table_")).cast("long").alias("in_strings"))


def _calls(spark, sf_dir):
    return X.calls(materialise(X.definitions(sources(spark, sf_dir)))).select("graph_id", "file_path", "caller", "target_class", "callee")


def _columns(spark, sf_dir):
    return X.entity_columns(sources(spark, sf_dir)).select("graph_id", "file_path", "field_name", "column_name", "java_type", "has_converter")


QUERIES = {
    "x1_comment_masking": _masked, "x2_file_comments": _over(X.file_comments, "comment"), "x3_function_comments": _over(X.function_comments, "name", "comment"),
    "x4_x6_functions": _over(X.functions, "name", "defs"), "x7_imports": _over(X.imports, "import"), "x8_calls": _calls,
    "x11_db_tables": _over(X.db_tables, "table_name", "class_name"), "x12_entity_columns": _columns, "x20_x21_endpoints": _over(X.endpoints, "mapping", "handler"), "x22_raw_sql": _over(X.raw_sql, "table_name", "is_write"),
    "x25_async_methods": _over(X.async_methods, "name"), "x26_transactional_methods": _over(X.transactional_methods, "name"),
    "n1_file_nodes": _nodes("FILE", "language", "comment"), "n2_function_nodes": _nodes("FUNCTION", "name", "comment", "is_async", "is_transactional", "merged_def_count"), "n3_n4_table_nodes": _nodes("DB_TABLE", "name"), "n5_endpoint_nodes": _nodes("API_ENDPOINT", "name"),
    "e1_e2_import_edges": _edges(B.import_edges, "FILE", "FILE", "src_path", "tgt_path"), "e4_e9_call_edges": lambda s, d: B.call_pairs(_of(s, d)),
    "e13_raw_sql_edges": _edges(B.sql_edges, "FILE", "DB_TABLE", "type", "src_path", "tgt_name"), "x17_service_calls": _over(X.service_calls, "kind", "value"),
    "e18_service_call_edges": _edges(B.service_edges, "FILE", "FILE", "src_path", "tgt_path"), "e16_endpoint_handlers": _edges(B.handler_edges, "API_ENDPOINT", "FUNCTION", "src_path", "src_name", "tgt_name"),
}

_EXT = "regexp_replace(regexp_extract({p}, '[^/]*$'), '\\.[^.]*$', '')"
_STEM, _TGT_STEM = _EXT.format(p="file_path"), _EXT.format(p="tgt_path")
_BARE = "regexp_replace(tgt_path, '\\.[^.]*$', '')"
# what the sources hold: functions, servers of endpoints, calls
_CTE = f""", fl AS (SELECT graph_id, file_path, language, ord, {_STEM} AS stem FROM nodes WHERE type = 'FILE'),
pt AS (SELECT n.graph_id, n.file_path, n.language, substr(n.name, 5) AS url, 'serve' || n.ord AS serve, n.ord FROM nodes n WHERE n.type = 'API_ENDPOINT'),
fd AS (SELECT graph_id, file_path, language, name, comment, is_async, is_transactional, ord FROM nodes WHERE type = 'FUNCTION' UNION ALL SELECT graph_id, file_path, language, serve, NULL, FALSE, FALSE, 1000000000 + ord FROM pt),
cl AS (SELECT e.*, {_TGT_STEM} AS tgt_stem, CASE WHEN src_language = 'Java' AND same_file THEN NULL ELSE {_TGT_STEM} END AS cls FROM ends e WHERE type = 'FUNCTION_CALL')"""
_DB = "SELECT graph_id, src_path AS file_path, tgt_name AS table_name, type <> 'DB_READ' AS is_write FROM ends WHERE type LIKE 'DB%'"
_MAPPING = "CASE WHEN language IN ('Java', 'Kotlin') THEN url ELSE 'GET:' || url END"
_NOTE = "SELECT graph_id, file_path, name, arg_min(comment, ord) AS comment FROM fd WHERE comment IS NOT NULL GROUP BY 1, 2, 3"
_ASYNC = "language IN ('Java', 'Python', 'TypeScript') AND is_async"
_TX = "language IN ('Java', 'Kotlin') AND is_transactional"
_HOST = "regexp_extract(tgt_path, '^services/([^/]+)/', 1)"
# the first directory, or the second behind a wrapper
_SERVICE = "regexp_extract(file_path, '^(?:(?:services|apps|packages|modules)/)?([^/]+)/', 1)"
_BODY = {
    "x1_comment_masking": f" SELECT f.graph_id, f.file_path, 0 AS in_comments, COUNT(d.table_name) AS in_strings FROM fl f LEFT JOIN (SELECT graph_id, src_path AS file_path, tgt_name AS table_name FROM ends WHERE type LIKE 'DB%') d USING (graph_id, file_path) GROUP BY 1, 2",
    "x2_file_comments": " SELECT graph_id, file_path, 'about ' || stem AS comment FROM fl",
    "x3_function_comments": f" {_NOTE}",
    "x4_x6_functions": " SELECT graph_id, file_path, name, COUNT(*) AS defs FROM fd GROUP BY 1, 2, 3",
    "x7_imports": f" SELECT graph_id, src_path AS file_path, CASE WHEN src_language = 'TypeScript' THEN {_BARE} ELSE replace({_BARE}, '/', '.') END AS import FROM ends WHERE type = 'IMPORT'",
    "x8_calls": " SELECT DISTINCT graph_id, src_path AS file_path, src_name AS caller, cls AS target_class, tgt_name AS callee FROM cl WHERE NOT (cls IS NULL AND src_name = tgt_name) UNION SELECT graph_id, src_path, src_name, NULL, tgt_name FROM cl WHERE src_name <> tgt_name",
    "x11_db_tables": " SELECT graph_id, file_path, 'tbl_' || ord AS table_name, stem AS class_name FROM fl WHERE language IN ('Java', 'Kotlin') AND ord % 6 = 0",
    "x12_entity_columns": " SELECT graph_id, file_path, c.* FROM fl, (VALUES ('idKey', 'id_key', 'Long', FALSE), ('code', 'code_name', 'String', TRUE)) c(field_name, column_name, java_type, has_converter) WHERE language IN ('Java', 'Kotlin') AND ord % 6 = 0",
    "x20_x21_endpoints": f" SELECT graph_id, file_path, {_MAPPING} AS mapping, arg_max(serve, ord) AS handler FROM pt GROUP BY 1, 2, 3",
    "x22_raw_sql": f" SELECT DISTINCT * FROM ({_DB})",
    "x25_async_methods": f" SELECT DISTINCT graph_id, file_path, name FROM fd WHERE {_ASYNC}",
    "x26_transactional_methods": f" SELECT DISTINCT graph_id, file_path, name FROM fd WHERE {_TX}",
    "n1_file_nodes": " SELECT graph_id, file_path, language, 'about ' || stem AS comment FROM fl",
    "n2_function_nodes": f", nt AS ({_NOTE}) SELECT f.graph_id, f.file_path, f.name, ANY_VALUE(nt.comment) AS comment, bool_or({_ASYNC}) AS is_async, bool_or({_TX}) AS is_transactional, CAST(COUNT(*) AS INT) AS merged_def_count FROM fd f LEFT JOIN nt USING (graph_id, file_path, name) GROUP BY 1, 2, 3",
    "n3_n4_table_nodes": f" SELECT graph_id, file_path, 'tbl_' || ord AS name FROM fl WHERE language IN ('Java', 'Kotlin') AND ord % 6 = 0 UNION ALL SELECT graph_id, MIN(file_path), table_name FROM ({_DB}) GROUP BY graph_id, table_name",
    "n5_endpoint_nodes": f" SELECT DISTINCT graph_id, file_path, {_MAPPING} AS name FROM pt",
    "e1_e2_import_edges": " SELECT DISTINCT graph_id, src_path, tgt_path FROM ends WHERE type = 'IMPORT'",
    # by class name; in the same file; else the only imported file that defines the name, else the only one at all
    "e4_e9_call_edges": f""", df AS (SELECT DISTINCT graph_id, file_path, name FROM fd), im AS (SELECT DISTINCT graph_id, src_path, tgt_path FROM ends WHERE type = 'IMPORT'),
bc AS (SELECT DISTINCT graph_id, src_path, src_language, src_name, tgt_name FROM cl WHERE src_name <> tgt_name),
bo AS (SELECT b.*, o.name IS NOT NULL AS own FROM bc b LEFT JOIN df o ON o.graph_id = b.graph_id AND o.file_path = b.src_path AND o.name = b.tgt_name),
cd AS (SELECT b.*, d.file_path AS t, i.tgt_path IS NOT NULL AS imp FROM bo b JOIN df d ON d.graph_id = b.graph_id AND d.name = b.tgt_name AND d.file_path <> b.src_path LEFT JOIN im i ON i.graph_id = b.graph_id AND i.src_path = b.src_path AND i.tgt_path = d.file_path WHERE NOT (src_language = 'Java' AND own)),
pk AS (SELECT graph_id, src_path, src_name, tgt_name, COUNT(*) FILTER (WHERE imp) AS ni, MIN(t) FILTER (WHERE imp) AS ti, COUNT(*) AS n, MIN(t) AS t FROM cd GROUP BY 1, 2, 3, 4),
al AS (SELECT graph_id, src_path, src_name, tgt_path, tgt_name, src_path = tgt_path AS same_file FROM cl WHERE cls IS NOT NULL AND NOT (src_path = tgt_path AND src_name = tgt_name)
  UNION SELECT graph_id, src_path, src_name, src_path, tgt_name, TRUE FROM bo WHERE own
  UNION SELECT graph_id, src_path, src_name, CASE WHEN ni = 1 THEN ti ELSE t END, tgt_name, FALSE FROM pk WHERE ni = 1 OR (n = 1 AND (tgt_name <> 'main' OR regexp_replace(src_path, '[^/]*$', '') = regexp_replace(t, '[^/]*$', ''))))
SELECT * FROM al""",
    "e13_raw_sql_edges": f" SELECT DISTINCT graph_id, CASE WHEN is_write THEN 'DB_WRITE' ELSE 'DB_READ' END AS type, file_path AS src_path, table_name AS tgt_name FROM ({_DB})",
    "x17_service_calls": f" SELECT DISTINCT graph_id, src_path AS file_path, 'host' AS kind, {_HOST} AS value FROM ends WHERE type = 'SERVICE_CALL'",
    "e18_service_call_edges": f""", sv AS (SELECT graph_id, service, MIN(file_path) AS rep FROM (SELECT graph_id, file_path, {_SERVICE} AS service FROM fl) WHERE service <> '' GROUP BY 1, 2),
sc AS (SELECT DISTINCT graph_id, src_path, {_HOST} AS host, {_SERVICE.replace('file_path', 'src_path')} AS own FROM ends WHERE type = 'SERVICE_CALL'),
sm AS (SELECT c.*, s.service, s.rep, ROW_NUMBER() OVER (PARTITION BY c.graph_id, c.src_path, c.host ORDER BY s.rep) AS rn FROM sc c JOIN sv s ON s.graph_id = c.graph_id AND contains(lower(s.service), lower(c.host)))
SELECT DISTINCT graph_id, src_path, rep AS tgt_path FROM sm WHERE rn = 1 AND rep <> src_path AND lower(own) <> lower(service)""",
    "e16_endpoint_handlers": f" SELECT graph_id, file_path AS src_path, {_MAPPING} AS src_name, arg_max(serve, ord) AS tgt_name FROM pt GROUP BY 1, 2, 3",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: G.oracle(_CTE + body) for name, body in _BODY.items()}
