"""What happens to warnings after the rules: fingerprints, filters, gates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborist.functions import paths as P

SEVERITIES = ["HIGH", "MEDIUM", "LOW"]


def fingerprint(warnings: DataFrame) -> DataFrame:
    return warnings.withColumn("fingerprint", F.sha2(F.concat(F.coalesce("type", F.lit("")), F.lit("|"), F.coalesce("message", F.lit(""))), 256))


def locate(warnings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds file, line, col and end_col of the first node."""
    first = warnings.withColumn("id", F.get("node_ids", 0))
    return first.join(nodes.select("graph_id", "id", F.col("file_path").alias("file"), "line", "col", "end_col"), ["graph_id", "id"], "left").drop("id")


def ignore(warnings: DataFrame, nodes: DataFrame, rules: DataFrame, projects: DataFrame) -> DataFrame:
    """Drops warnings that a rule (project_id, type, source, target) of their project matches; blank or ``*`` matches all.

    ``projects`` (graph_id, project_id) says which rules meet a graph's warnings, so rules and warnings are joined by project.
    """
    rx = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "*"), F.lit(".*")).otherwise(P.glob_to_regex(c))
    r = rules.select("project_id", F.col("type").alias("r_type"), rx(F.col("source")).alias("r_from"), rx(F.col("target")).alias("r_to"))
    path = lambda i, name: nodes.select("graph_id", F.col("id").alias(f"n{i}"), F.col("file_path").alias(name))
    w = warnings.withColumns({"n0": F.get("node_ids", 0), "n1": F.coalesce(F.get("node_ids", 1), F.get("node_ids", 0))}).join(projects.select("graph_id", "project_id"), "graph_id", "left")
    w = w.join(path(0, "p_from"), ["graph_id", "n0"], "left").join(path(1, "p_to"), ["graph_id", "n1"], "left")
    hit = (w["project_id"] == r["project_id"]) & F.expr("(coalesce(r_type, '') IN ('', '*') OR r_type = type) AND coalesce(p_from, '') RLIKE r_from AND coalesce(p_to, '') RLIKE r_to")
    return w.join(r, hit, "left_anti").select(*warnings.columns)


def infer_glob(path: str) -> F.Column:
    """The widest glob of a path's layer: up to the first layer directory and all below it, else its folder."""
    layers = "|".join(dict.fromkeys([*P.DOMAIN_DIRS, *P.APPLICATION_DIRS, *P.INFRA_DIRS, *P.INTERFACE_DIRS]))
    layer = F.regexp_extract(path, f"^((?:.*?/)?(?:{layers}))/", 1)
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(layer != "", F.concat(layer, F.lit("/**"))).when(folder != "", F.concat(folder, F.lit("/**"))).otherwise(F.col(path))


def in_order(located: DataFrame) -> DataFrame:
    """graph_id, type, file, message, pos: each graph's warnings by type, file and message."""
    return located.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("type", "file", "message")))


def of_node(warnings: DataFrame) -> DataFrame:
    """graph_id, node, fingerprint, type: the warnings of every node that they name."""
    return warnings.select("graph_id", F.explode("node_ids").alias("node"), "fingerprint", "type").distinct()


def gate_log(gate: DataFrame, at: str) -> DataFrame:
    """A row of the gate's log for each graph: state, high_count, warning_count, created_at."""
    return gate.select("graph_id", "state", "high_count", "warning_count", F.lit(at).cast("timestamp").alias("created_at"))


def snippet(content: F.Column, line: F.Column, around: int = 2) -> F.Column:
    """The lines around line ``line`` (from 1) of a text; null outside it."""
    lines = F.split(content, "\n")
    first = F.greatest(F.lit(1), line - around)
    return F.when((line >= 1) & (line <= F.size(lines)), F.array_join(F.slice(lines, first, line + around - first + 1), "\n"))


def suppression_split(warnings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Adds ``hidden``: whether (graph_id, fingerprint) is suppressed."""
    s = suppressed.select("graph_id", "fingerprint").distinct().withColumn("hidden", F.lit(True))
    return warnings.join(s, ["graph_id", "fingerprint"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))


def diff_scope(warnings: DataFrame, changed: DataFrame | None) -> DataFrame:
    return warnings if changed is None else warnings.join(changed.select("graph_id", "file").distinct(), ["graph_id", "file"], "left_semi")


def gate_state(warnings: DataFrame, gating_types: list[str] | None = None) -> DataFrame:
    """graph_id, state, high_count, warning_count, low_dropped: failure where a HIGH warning of a gating type is left; LOW ones are only counted."""
    gating = F.col("severity") == "HIGH"
    if gating_types is not None:
        gating &= F.col("type").isin(gating_types)
    g = warnings.groupBy("graph_id").agg(F.count_if(gating).alias("high_count"), F.count_if(F.col("severity") != "LOW").alias("warning_count"), F.count_if(F.col("severity") == "LOW").alias("low_dropped"))
    return g.withColumn("state", F.when(F.col("high_count") > 0, "failure").otherwise("success"))


def severity_groups(warnings: DataFrame) -> DataFrame:
    """graph_id, severity, n, types: the sections of a review comment, other severities as OTHER."""
    s = F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("OTHER")
    return warnings.groupBy("graph_id", s.alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def count_by_type(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys (type + sorted nodes) that are gone or new."""
    key = lambda w: w.select("graph_id", F.concat_ws("|", "type", F.array_join(F.array_sort("node_ids"), ",")).alias("key")).distinct()
    b, a = key(before), key(after)
    return b.exceptAll(a).withColumn("change", F.lit("gone")).unionByName(a.exceptAll(b).withColumn("change", F.lit("new")))


def panel(warnings: DataFrame) -> DataFrame:
    """graph_id, type, severity, n, pos: groups by type, the gravest first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    g = warnings.groupBy("graph_id", "type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy(rank, "type")))
