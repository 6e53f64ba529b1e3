"""Code graphs derived from the given tables, in SQL that means the same in Spark and in the checking engine.

50 files (rows of ``part``) are one graph, so the number of graphs grows with the tables and their size
doesn't. ``nodes`` are files (part), functions (orders), tables (supplier) and endpoints (customer);
``edges`` come from ``lineitem`` and stay inside the source's graph.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from arborist.storage import shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BASE = """
size_of AS (SELECT COUNT(*) AS np, CAST(FLOOR((MAX(p_partkey) + 50) / 50.0) AS BIGINT) AS ng FROM {part}),
file0 AS (SELECT p_partkey AS k, CAST(FLOOR(p_partkey / 50.0) AS BIGINT) AS graph_id, p_size,
  CASE CAST(FLOOR(p_partkey / 5.0) AS BIGINT) % 8 WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'infrastructure/persistence' WHEN 3 THEN 'interfaces' WHEN 4 THEN 'service' WHEN 5 THEN 'controller' WHEN 6 THEN 'repository' ELSE 'model' END AS layer,
  CASE p_partkey % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'user' WHEN 2 THEN 'billing' WHEN 3 THEN 'item' ELSE 'cart' END AS ctx,
  CASE p_size % 7 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' WHEN 3 THEN 'Mapper' WHEN 4 THEN 'Model' WHEN 5 THEN 'Helper' ELSE 'Configuration' END AS suffix,
  CASE WHEN p_size % 11 = 0 THEN 'src/test/' ELSE 'src/main/' END AS root FROM {part}),
file1 AS (SELECT *, CASE graph_id % 5 WHEN 0 THEN root || layer || '/' || ctx || '/F' || k || suffix
    WHEN 1 THEN root || ctx || '/' || layer || '/F' || k || suffix
    WHEN 2 THEN 'services/' || ctx || '/' || layer || '/F' || k || suffix
    WHEN 4 THEN root || CASE k % 4 WHEN 0 THEN 'controller/' WHEN 1 THEN 'service/' WHEN 2 THEN 'repository/' ELSE 'model/' END || ctx || '/F' || k
    ELSE CASE k % 4 WHEN 0 THEN 'src/app/F' || k WHEN 1 THEN 'src/features/' || ctx || '/F' || k WHEN 2 THEN 'src/entities/F' || k ELSE 'src/shared/F' || k END END AS stem,
  CASE WHEN graph_id % 5 = 3 THEN 'TypeScript' WHEN k % 4 = 0 THEN 'Kotlin' WHEN k % 7 = 0 THEN 'Python' ELSE 'Java' END AS language FROM file0),
files AS (SELECT k, graph_id, stem || CASE language WHEN 'Java' THEN '.java' WHEN 'Kotlin' THEN '.kt' WHEN 'Python' THEN '.py' ELSE CASE WHEN p_size % 2 = 0 THEN '.tsx' ELSE '.ts' END END AS file_path, language, 'F' || k || suffix AS name, ctx, layer FROM file1),
func AS (SELECT o_orderkey AS k, f.k AS fk, f.graph_id, f.file_path, f.language,
  CASE o_orderkey % 16 WHEN 0 THEN 'process' WHEN 1 THEN 'validate' WHEN 2 THEN 'notifyUser' WHEN 3 THEN 'deleteByUserId' WHEN 4 THEN 'removeByOrderId' WHEN 5 THEN 'save' WHEN 6 THEN 'getTotal' WHEN 7 THEN 'computeTax'
    WHEN 8 THEN 'dispatch' WHEN 9 THEN 'mergeRows' WHEN 10 THEN 'main' WHEN 11 THEN 'handleEvent' WHEN 12 THEN 'renderInner' WHEN 13 THEN 'applyRule' WHEN 14 THEN 'sync' ELSE 'findById' END
    || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 397 AS STRING) END AS name
  FROM {orders} JOIN size_of ON TRUE JOIN files f ON f.k = o_orderkey % np),
nodes AS (
  SELECT graph_id, 'F' || k AS id, 'FILE' AS type, name, file_path, language, k AS ord, CAST(NULL AS STRING) AS comment, FALSE AS is_async, FALSE AS is_transactional, FALSE AS is_interface, FALSE AS is_framework_interface, FALSE AS is_framework_annotated, FALSE AS referenced_as_value, FALSE AS is_test, 1 AS merged_def_count, k % 3 = 0 AS is_bean, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS col, CAST(NULL AS BIGINT) AS end_col FROM files
  UNION ALL SELECT graph_id, 'M' || k, 'FUNCTION', name, file_path, language, k, CASE WHEN k % 5 = 0 THEN 'does ' || name END, k % 7 = 0, k % 11 = 0, k % 13 = 0, k % 26 = 0, k % 17 = 0, k % 19 = 0, k % 23 = 0, CASE WHEN k % 29 = 0 THEN 2 ELSE 1 END, FALSE, k % 200 + 1, k % 40, k % 40 + LENGTH(name) FROM func
  UNION ALL SELECT s_suppkey % ng, 'T' || s_suppkey, 'DB_TABLE', 'table_' || s_suppkey, 'db/table_' || s_suppkey, 'SQL', s_suppkey, CAST(NULL AS STRING), FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, 1, FALSE, NULL, NULL, NULL FROM {supplier} JOIN size_of ON TRUE
  UNION ALL SELECT f.graph_id, 'E' || c_custkey, 'API_ENDPOINT', 'GET:/api/' || f.ctx || '/' || c_custkey % 9, f.file_path, f.language, c_custkey, CAST(NULL AS STRING), FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, 1, FALSE, NULL, NULL, NULL FROM {customer} JOIN size_of ON TRUE JOIN files f ON f.k = c_custkey % np),
line AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity AS q, l_returnflag AS rf, l_orderkey % np AS fk, CAST(FLOOR((l_orderkey % np) / 50.0) AS BIGINT) AS graph_id, np, ng FROM {lineitem} JOIN size_of ON TRUE),
edge0 AS (
  SELECT graph_id, 'IMPORT' AS type, 'F' || fk AS src, 'F' || (graph_id * 50 + p % 50) AS tgt, o, FALSE AS same_file, FALSE AS is_interface_impl, FALSE AS is_lazy FROM line WHERE n = 1 AND q <= 10
  UNION ALL SELECT graph_id, 'FUNCTION_CALL', 'M' || o, 'M' || (graph_id * 50 + p % 50 + np * (s % 7)), o, fk = graph_id * 50 + p % 50, q > 48, FALSE FROM line WHERE n BETWEEN 2 AND 7
  UNION ALL SELECT graph_id, CASE rf WHEN 'R' THEN 'DB_READ' WHEN 'A' THEN 'DB_WRITE' ELSE 'DB_DELETE' END, 'F' || fk, 'T' || (graph_id + ng * (s % 3)), o, FALSE, FALSE, FALSE FROM line WHERE n = 1 AND q > 40
  UNION ALL SELECT graph_id, 'FIELD_DEPENDENCY', 'F' || fk, 'F' || (graph_id * 50 + p % 50), o, FALSE, FALSE, q > 38 FROM line WHERE n = 1 AND q > 30 AND q <= 40
  UNION ALL SELECT graph_id, 'API_CALL', 'F' || fk, 'F' || (graph_id * 50 + p % 50), o, FALSE, FALSE, FALSE FROM line WHERE n = 1 AND q > 20 AND q <= 24
  UNION ALL SELECT graph_id, 'SERVICE_CALL', 'F' || fk, 'F' || (graph_id * 50 + p % 50), o, FALSE, FALSE, FALSE FROM line WHERE n = 1 AND q > 24 AND q <= 26 AND graph_id % 5 = 2),
edges AS (SELECT e.graph_id, e.type || ':' || e.src || '>' || e.tgt AS edge_identifier, e.type, e.src, e.tgt, MIN(e.o) AS ord, MAX(CASE WHEN e.same_file THEN 1 ELSE 0 END) = 1 AS same_file, MAX(CASE WHEN e.is_interface_impl THEN 1 ELSE 0 END) = 1 AS is_interface_impl, MIN(CASE WHEN e.is_lazy THEN 1 ELSE 0 END) = 1 AS is_lazy
  FROM edge0 e JOIN nodes a ON a.id = e.src AND a.graph_id = e.graph_id JOIN nodes b ON b.id = e.tgt AND b.graph_id = e.graph_id WHERE e.src <> e.tgt GROUP BY e.graph_id, e.type, e.src, e.tgt),
ends AS (SELECT e.*, a.name AS src_name, a.file_path AS src_path, a.language AS src_language, a.type AS src_type, b.name AS tgt_name, b.file_path AS tgt_path, b.language AS tgt_language, b.type AS tgt_type
  FROM edges e JOIN nodes a ON a.id = e.src AND a.graph_id = e.graph_id JOIN nodes b ON b.id = e.tgt AND b.graph_id = e.graph_id)"""


def used(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used(text)})


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written to the shared folder when an application first asks for it; all later queries read the same."""
    path = f"{shared_dir(spark)}/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        build().write.mode("overwrite").parquet(path, compression="zstd")
    return spark.read.parquet(path)


def _kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return once(spark, sf_dir, name, lambda: spark_sql(spark, sf_dir, f"WITH {_merged(BASE)} SELECT * FROM {name}"))


def _merged(text: str) -> str:
    """``BASE`` for Spark, with files never broadcast: a row of ``part`` is a few packed bytes, and a file many times as long."""
    for select in ("SELECT o_orderkey AS k, f.k AS fk", "SELECT f.graph_id, 'E' || c_custkey"):
        text = text.replace(select, select.replace("SELECT", "SELECT /*+ MERGE(f) */"))
    return text


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, project_id: three projects that hold the graphs in turn."""
    return nodes(spark, sf_dir).select("graph_id").distinct().selectExpr("graph_id", "graph_id % 3 AS project_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "nodes")


#: The edges of ``BASE`` from the written nodes. Each line gives one edge at most, so lines are read once; nodes are numbers (four times the key, and
#: the type) from join to join, and an edge's rows meet where its source was looked up, before they go on to its target. The nodes are never broadcast:
#: their files pack so well that Spark takes a table of millions of rows for a small one. A line's edge
#: is a struct of its own, else Spark would repeat these expressions in conditions on them, in a method too long to be compiled.
EDGES = """
WITH size_of AS (SELECT COUNT(*) AS np, CAST(FLOOR((MAX(p_partkey) + 50) / 50.0) AS BIGINT) AS ng FROM {part}),
known AS (SELECT graph_id, 4 * CAST(substr(id, 2) AS BIGINT) + CASE left(id, 1) WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS node FROM {nodes} WHERE type <> 'API_ENDPOINT'),
line AS (SELECT l_orderkey AS o, l_suppkey AS s, l_linenumber AS n, l_quantity AS q, l_returnflag AS rf, np, ng, l_orderkey % np AS fk, l_partkey % 50 AS pk, (l_orderkey % np - pmod(l_orderkey % np, 50)) DIV 50 AS graph_id FROM {lineitem} JOIN size_of ON TRUE),
typed AS (SELECT *, CAST(CASE WHEN n BETWEEN 2 AND 7 THEN 1 WHEN COALESCE(n, 0) <> 1 THEN NULL WHEN q <= 10 THEN 0 WHEN q > 40 THEN CASE rf WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 4 END WHEN q > 30 AND q <= 40 THEN 5 WHEN q > 20 AND q <= 24 THEN 6 WHEN q > 24 AND q <= 26 AND graph_id % 5 = 2 THEN 7 END AS TINYINT) AS type FROM line),
edge0 AS (SELECT graph_id, e.type, e.src, e.tgt, o, e.flags FROM typed LATERAL VIEW inline(array(named_struct('type', type, 'src', CASE WHEN type = 1 THEN 4 * o + 1 ELSE 4 * fk END, 'tgt', CASE WHEN type = 1 THEN 4 * (graph_id * 50 + pk + np * (s % 7)) + 1 WHEN type IN (2, 3, 4) THEN 4 * (graph_id + ng * (s % 3)) + 2 ELSE 4 * (graph_id * 50 + pk) END,
  'flags', CAST(CASE WHEN type = 1 AND fk = graph_id * 50 + pk THEN 1 ELSE 0 END + CASE WHEN type = 1 AND q > 48 THEN 2 ELSE 0 END + CASE WHEN type = 5 AND q > 38 THEN 0 ELSE 4 END AS TINYINT)))) e WHERE e.type IS NOT NULL AND e.src <> e.tgt),
one AS (SELECT /*+ MERGE(a) */ graph_id, type, src, tgt, MIN(o) AS ord, bit_or(flags) AS flags FROM edge0 LEFT SEMI JOIN known a ON a.node = edge0.src AND a.graph_id = edge0.graph_id GROUP BY graph_id, type, src, tgt),
named AS (SELECT /*+ MERGE(b) */ *, element_at(array('IMPORT', 'FUNCTION_CALL', 'DB_READ', 'DB_WRITE', 'DB_DELETE', 'FIELD_DEPENDENCY', 'API_CALL', 'SERVICE_CALL'), type + 1) AS kind, substr('FMT', CAST((src & 3) + 1 AS INT), 1) || shiftright(src, 2) AS src_id, substr('FMT', CAST((tgt & 3) + 1 AS INT), 1) || shiftright(tgt, 2) AS tgt_id
  FROM one LEFT SEMI JOIN known b ON b.node = one.tgt AND b.graph_id = one.graph_id)
SELECT graph_id, kind || ':' || src_id || '>' || tgt_id AS edge_identifier, kind AS type, src_id AS src, tgt_id AS tgt, ord, flags & 1 = 1 AS same_file, flags & 2 = 2 AS is_interface_impl, flags & 4 = 0 AS is_lazy FROM named"""


def edge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(EDGES, part=read("part"), lineitem=read("lineitem"), nodes=nodes(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "edges", lambda: edge_plan(spark, sf_dir))


def oracle(body: str) -> str:
    """SQL over the derived nodes, edges and ends."""
    return duck(f"WITH RECURSIVE {BASE}{body if body.lstrip().startswith(',') else ' ' + body}")
