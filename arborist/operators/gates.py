"""Merge gates of pull requests: what blocks a merge, what the log, the reports and the metrics say of it.

A pull request is a row of ``pulls``: project_id, pull_id, graph_id (the graph of its branch), truncated (whether the analysis left files out) and
scoped (whether its changed files are known; where they aren't, all warnings of the graph are in scope). Every pull request has a row in each
result, those without warnings as well. Warnings meet pull requests by graph, then changed files by key; counts are added up before the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborist.extract import graph
from arborist.sources.files import language_of
from arborist.storage import materialise

from . import findings, rules

# Types that a project can take out of its gate, types that it has to ask for, types whose false positives are counted.
ARCHITECTURE_TYPES = [
    "CYCLIC_IMPORT", "DB_LAYER_BYPASS", "CROSS_CONTEXT_IMPORT", "DOMAIN_IMPORTS_INFRA", "LAYERED_REVERSE_DEPENDENCY", "CROSS_FEATURE_IMPORT", "FEATURE_LAYER_VIOLATION", "INTENT_DRIFT",
]
EXPERIMENTAL_TYPES = ["INTERFACES_IMPORTS_INFRA"]
PROVEN_TYPES = [
    "CYCLIC_IMPORT", "DB_LAYER_BYPASS", "CROSS_CONTEXT_IMPORT", "CROSS_FEATURE_IMPORT", "FEATURE_LAYER_VIOLATION", "DOMAIN_IMPORTS_INFRA", "LAYERED_REVERSE_DEPENDENCY", "INTENT_DRIFT",
]

PULL = ["project_id", "pull_id"]


def gating(type_: Column, severity: Column, architecture: Column, experimental: Column) -> Column:
    """Whether a warning blocks a merge: a HIGH one, of the types that a project can switch only where they are on. Null types and severities don't."""
    switched = F.when(type_.isin(EXPERIMENTAL_TYPES), experimental).when(type_.isin(ARCHITECTURE_TYPES), architecture).otherwise(F.lit(True))
    return F.coalesce((severity == "HIGH") & switched, F.lit(False))


def unanalysed(pulls: DataFrame, changed: DataFrame, analysed: DataFrame) -> DataFrame:
    """project_id, pull_id, unanalysed: changed files in a known language that a truncated analysis left out; only pull requests that have some.

    changed: project_id, pull_id, file; analysed: graph_id, file. A file that is named twice counts once.
    """
    cut = pulls.where("truncated AND scoped").select(*PULL, "graph_id")
    files = changed.where(language_of(F.col("file")).isNotNull()).select(*PULL, "file").distinct().join(cut, PULL)
    return files.join(analysed.select("graph_id", "file"), ["graph_id", "file"], "left_anti").groupBy(*PULL).agg(F.count(F.lit(1)).alias("unanalysed"))


def review(located: DataFrame, pulls: DataFrame, changed: DataFrame, analysed: DataFrame, settings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """A row for each pull request: graph_id, state, high_count, warning_count, low_dropped, out_of_scope, unanalysed.

    located: warnings with ``fingerprint`` and ``file``; changed, analysed: see ``unanalysed``; settings: project_id, architecture, experimental (a
    project without a row, or a null switch: on and off); suppressed: project_id, fingerprint. Suppressed warnings are in no count. LOW ones never
    block. The number of files left out doesn't change the state. pulls must have a row for each (project_id, pull_id).
    """
    switches = settings.select("project_id", "architecture", "experimental")
    w = pulls.select(*PULL, "graph_id", "scoped").join(located.select("graph_id", "type", "severity", "fingerprint", "file"), "graph_id")
    w = w.join(suppressed.select("project_id", "fingerprint"), ["project_id", "fingerprint"], "left_anti")
    touched = changed.select(*PULL, "file").distinct().withColumn("touched", F.lit(True))
    w = w.join(touched, [*PULL, "file"], "left").withColumn("inside", ~F.col("scoped") | F.coalesce("touched", F.lit(False)))
    w = w.join(switches, "project_id", "left")
    low = F.coalesce(F.col("severity") == "LOW", F.lit(False))
    blocks = gating(F.col("type"), F.col("severity"), F.coalesce("architecture", F.lit(True)), F.coalesce("experimental", F.lit(False)))
    counts = w.groupBy(*PULL).agg(
        F.count_if(F.col("inside") & blocks).alias("high_count"), F.count_if(F.col("inside") & ~low).alias("warning_count"),
        F.count_if(F.col("inside") & low).alias("low_dropped"), F.count_if(~F.col("inside")).alias("out_of_scope"),
    )
    out = pulls.select(*PULL, "graph_id").join(counts, PULL, "left").join(unanalysed(pulls, changed, analysed), PULL, "left").na.fill(0)
    state = F.when(F.col("high_count") > 0, "failure").otherwise("success")
    return out.select(*PULL, "graph_id", state.alias("state"), "high_count", "warning_count", "low_dropped", "out_of_scope", "unanalysed")


def description(reviews: DataFrame) -> DataFrame:
    """Adds ``description``, the line of a commit's status: what blocks it and how many changed files weren't looked at."""
    found = F.when(F.col("high_count") > 0, F.concat(F.col("high_count").cast("string"), F.lit(" structural violations (HIGH) in changed files"))).otherwise("No structural violations (HIGH)")
    partly = F.when(F.col("unanalysed") > 0, F.concat(F.lit(" (partial analysis: "), F.col("unanalysed").cast("string"), F.lit(" changed files left out)"))).otherwise("")
    return reviews.withColumn("description", F.concat(found, partly))


def review_sources(
    files: DataFrame, pulls: DataFrame, changed: DataFrame, settings: DataFrame, suppressed: DataFrame,
    ignores: DataFrame | None = None, policies: DataFrame | None = None, intent: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """From source text to gates: (the located warnings, ``review``'s rows).

    files: graph_id, file_path, content, language. ignores: see ``findings.ignore``; policies: see ``rules.detect``; intent: modules and rules, see
    ``rules.intent_drift``. Projects are those of ``pulls``; a graph of several projects has the ignore rules and intents of the smallest.
    """
    f = graph.Facts(files)
    nodes, edges = materialise(graph.nodes(f)), materialise(graph.edges(f))
    projects = pulls.groupBy("graph_id").agg(F.min("project_id").alias("project_id"))
    warnings = rules.detect(nodes, edges, policies, None, (*intent, projects) if intent else None)
    if ignores is not None:
        warnings = findings.ignore(warnings, nodes, ignores, projects)
    located = materialise(findings.locate(findings.fingerprint(warnings), nodes))
    analysed = files.select("graph_id", F.col("file_path").alias("file"))
    return located, review(located, pulls, changed, analysed, settings, suppressed)


def log_rows(reviews: DataFrame, at: Column) -> DataFrame:
    """The rows that a gate's log gets from reviews: project_id, pull_id, state, high_count, warning_count, created_at."""
    return reviews.select(*PULL, "state", "high_count", "warning_count", at.cast("timestamp").alias("created_at"))


def new_reports(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports of false positives to be added: of each (project_id, fingerprint, reporter_id) the first by ``reported_at``, unless one is stored.

    Reports of one key and time are ordered by their other columns. Keys with a null are kept apart as equal keys are.
    """
    key = ["project_id", "fingerprint", "reporter_id"]
    rest = [c for c in reports.columns if c not in key and c != "reported_at"]
    first = reports.groupBy(*key).agg(F.min(F.struct("reported_at", *rest)).alias("r")).select(*key, "r.*").alias("a")
    known = stored.select(*key).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return first.join(known, same[0] & same[1] & same[2], "left_anti").select(*reports.columns)


def rule_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """project_id, op, type, source, target: ADD for each ignore rule of ``after`` that ``before`` hasn't, REMOVE the other way round; nulls are equal."""
    rule = ["project_id", "type", "source", "target"]

    def only(one: DataFrame, other: DataFrame, op: str) -> DataFrame:
        a, b = one.select(*rule).alias("a"), other.select(*rule).distinct().alias("b")
        same = F.lit(True)
        for c in rule:
            same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, same, "left_anti").select("project_id", F.lit(op).alias("op"), "type", "source", "target")

    return only(after, before, "ADD").unionByName(only(before, after, "REMOVE"))


def lost_reviews(pulls: DataFrame, statuses: DataFrame, now: Column, grace_seconds: int = 600, most_seconds: int = 86400) -> DataFrame:
    """Open pull requests (repo, number, head_sha, updated_at) last changed within [grace, most] seconds before ``now`` without a final status.

    statuses: repo, head_sha, state, one row a commit. A commit without a row, and any state but success and failure, is without a final status.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    due = pulls.where(age.between(grace_seconds * 1_000_000, most_seconds * 1_000_000))
    done = statuses.where(F.col("state").isin("success", "failure")).select("repo", "head_sha")
    return due.join(done, ["repo", "head_sha"], "left_anti").select(*pulls.columns)


def settle_stale(analyses: DataFrame, now: Column, most_seconds: int = 1200) -> DataFrame:
    """analyses (status, started_at, ...) with RUNNING ones begun more than ``most_seconds`` before ``now`` FAILED; those without a start stay."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return analyses.withColumn("status", F.when((F.col("status") == "RUNNING") & (age > most_seconds * 1_000_000), "FAILED").otherwise(F.col("status")))


def settle_restart(analyses: DataFrame) -> DataFrame:
    """analyses after a restart: what was PENDING or RUNNING has FAILED."""
    return analyses.withColumn("status", F.when(F.col("status").isin("PENDING", "RUNNING"), "FAILED").otherwise(F.col("status")))


def needs_analysis(heads: DataFrame, analyses: DataFrame) -> DataFrame:
    """heads (project_id, branch, scope, commit_sha) that have to be analysed, with ``last_sha``.

    A head is left out only where the newest analysis (by created_at, then id) of its project, branch and scope is DONE and of the same commit. A null scope
    is a scope; an unknown commit is always analysed.
    """
    key = ["project_id", "branch", "scope"]
    last = analyses.groupBy(*key).agg(F.max(F.struct("created_at", "id", "status", "commit_sha")).alias("l")).select(*key, F.col("l.status").alias("status"), F.col("l.commit_sha").alias("last_sha")).alias("b")
    same = F.lit(True)
    for c in key:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    unchanged = (F.col("status") == "DONE") & (F.col("a.commit_sha") == F.col("last_sha"))
    return heads.alias("a").join(last, same, "left").where(~F.coalesce(unchanged, F.lit(False))).select(*[F.col(f"a.{c}").alias(c) for c in heads.columns], "last_sha")


def gate_metrics(log: DataFrame, analyses: DataFrame, posts: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """One row: gated_projects (30 days), analysed_projects and posts (7 days), blocked (ever), high_count and reports (30 days), unreported_percent.

    The percentage is of HIGH occurrences that nobody has reported as false, from 0 to 100, and 100 where there is none. Only reports of ``PROVEN_TYPES`` count.
    Times are in ``created_at``; each table is one aggregate, of which one row is joined.
    """
    since = lambda days: F.col("created_at").cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(F.lit(days))
    distinct = lambda c, when: F.countDistinct(F.when(when, F.col(c)))
    gates = log.agg(distinct("project_id", since(30)).alias("gated_projects"), F.count_if(F.col("state") == "failure").alias("blocked"), F.coalesce(F.sum(F.when(since(30), F.col("high_count"))), F.lit(0)).alias("high_count"))
    one = gates.crossJoin(F.broadcast(analyses.agg(distinct("project_id", since(7)).alias("analysed_projects")))).crossJoin(F.broadcast(posts.agg(F.count_if(since(7)).alias("posts"))))
    one = one.crossJoin(F.broadcast(reports.agg(F.count_if(since(30) & F.col("type").isin(PROVEN_TYPES)).alias("reports"))))
    share = F.floor(F.greatest(F.lit(0), F.col("high_count") - F.col("reports")) * 100.0 / F.col("high_count") + 0.5).cast("int")
    percent = F.when(F.col("high_count") == 0, 100).otherwise(F.least(F.lit(100), share))
    return one.select("gated_projects", "analysed_projects", "posts", "blocked", "high_count", "reports", percent.alias("unreported_percent"))
