"""Groupings of a graph's files: layers, groups, contexts, and candidate modules of what endpoints reach.

All keep ``graph_id`` in every key. Rows come back as tables, in an order stated by a column, not as finished text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborist.functions import paths as P
from arborist.storage import materialise

from . import localgraphs, rules, traversal

# Directories that name a group, and that are passed over.
LAYERS = ["domain", "application", "infrastructure", "interfaces", "pages", "components", "hooks", "utils"]
WRAPPERS = ["src", "lib", "crates", "packages", "pkg"]
# Directories whose next part names a domain, and parts that name none.
DOMAIN_LAYERS = ["domain", "application", "infrastructure", "interfaces", "pages", "components", "hooks", "features", "modules", "views", "screens"]
NO_DOMAIN = [
    "impl", "dto", "entity", "vo", "config", "mapper", "exception", "exceptions", "constant", "constants", "enums", "persistence", "repository", "repositories",
    "com", "org", "net", "io", "co", "kr", "util", "utils", "helper", "helpers", "lib", "libs", "generated",
    "api", "rest", "web", "websocket", "ws", "controller", "controllers", "endpoint", "endpoints", "graphql", "v1", "v2", "handler", "handlers",
]
# Ends of file names that say what kind of part a file is.
KINDS = [
    "RestController", "Controller", "ServiceImpl", "Service", "RepositoryImpl", "Repository", "Configuration", "Config", "Entity", "Request", "Response",
    "Mapper", "Handler", "Facade", "Factory", "Provider", "Adapter", "Port", "Exception", "Listener", "Event", "Validator", "Filter", "Resolver",
    "Converter", "Manager", "Runner", "Scheduler", "Client", "Gateway", "Command", "Query", "Dto", "Vo", "Impl",
    "Page", "View", "Screen", "Modal", "Panel", "Section", "Card", "Banner", "Overlay", "Tour", "Layout", "Context", "Hook", "Form", "Header", "Footer",
]
#: Labels that two endpoints share to be one module; files listed of a module and of what modules share; contexts and files of a specification.
LEAST_SHARED, MODULE_SAMPLE, SHARED_SAMPLE, CONTEXTS, CONTEXT_FILES = 2, 15, 20, 10, 2


def layer_of(path: Column) -> Column:
    """The first layer among the parts of a path, else ``root``."""
    found = F.filter(F.split(path, "/"), lambda s: s.isin(LAYERS))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("root"))


def common_prefix(nodes: DataFrame) -> DataFrame:
    """graph_id, prefix: the longest run of directories that all files of a graph begin with, with a slash at its end.

    What the smallest and the largest path have in common all paths have.
    """
    ends = nodes.where("type = 'FILE'").groupBy("graph_id").agg(F.split(F.min("file_path"), "/").alias("a"), F.split(F.max("file_path"), "/").alias("b"))
    folders = F.least(F.size("a"), F.size("b")) - 1
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(folders, F.lit(1))), F.lit(0), lambda n, i: F.when((i <= folders) & (n == i - 1) & (F.get("a", i - 1) == F.get("b", i - 1)), i).otherwise(n))
    return ends.select("graph_id", F.when(same > 0, F.concat(F.array_join(F.slice("a", 1, same), "/"), F.lit("/"))).otherwise("").alias("prefix"))


def group_key(path: Column, prefix: Column) -> Column:
    """Behind the common prefix: the layer with its next part, else the first directory that isn't a wrapper, else ``root``."""
    parts = F.filter(F.split(F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path), "/"), lambda s: s != "")
    at = F.array_min(F.filter(F.transform(parts, lambda s, i: F.when(s.isin(LAYERS), i)), lambda i: i.isNotNull()))
    layer = F.concat_ws("/", F.get(parts, at), F.get(parts, at + 1))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    start = F.array_min(F.filter(F.transform(folders, lambda s, i: F.when(~s.isin(WRAPPERS), i)), lambda i: i.isNotNull()))
    return F.when(at.isNotNull(), layer).otherwise(F.coalesce(F.get(folders, start), F.lit("root")))


def folder_domain(path: Column, prefix: Column) -> Column:
    """Behind the common prefix and the first layer: the first directory, in lower case, that may name a domain; else null."""
    rel = F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)
    parts = F.filter(F.split(F.translate(rel, "\\", "/"), "/"), lambda s: s != "")
    at = F.array_min(F.filter(F.transform(parts, lambda s, i: F.when(s.isin(DOMAIN_LAYERS), i)), lambda i: i.isNotNull()))
    folders = F.filter(parts, lambda s, i: (i > at) & (i < F.size(parts) - 1) & ~F.lower(s).isin(NO_DOMAIN) & (F.length(s) > 1))
    return F.lower(F.get(folders, F.lit(0)))


def _name_words(path: Column) -> Column:
    """The words of a file's name, in lower case, without its extension and the kind at its end."""
    name = F.regexp_replace(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1), r"\.[^.]+$", "")
    stem = F.regexp_replace(name, f"(?s)^(.+?)({'|'.join(KINDS)})$", "$1")
    return F.filter(F.split(F.lower(F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1 $2")), r"[\s_-]+"), lambda s: s != "")


def _forms(word: Column) -> Column:
    """The names of a domain that a word may stand for, the likeliest first, null where a form doesn't apply: itself, its singular, its noun in -ion or -ment."""
    long = F.length(word) >= 3
    return F.array(
        word, F.when(word.endswith("s"), F.regexp_replace(word, "s$", "")), F.when(word.endswith("es"), F.regexp_replace(word, "es$", "")),
        F.when(long, F.concat(F.regexp_replace(word, "e$", ""), F.lit("ion"))), F.when(long, F.concat(word, F.lit("ment"))),
    )


def domains(nodes: DataFrame) -> DataFrame:
    """graph_id, file_path, domain of each path among the nodes.

    The domain is that of the path's folders, else the one of the graph's that the file's name speaks of: the longest run of
    words from its beginning that is one, else the first word that is; else ``common``. Paths that are null have no row.
    """
    paths = nodes.where("file_path IS NOT NULL").select("graph_id", "file_path").distinct()
    placed = paths.join(common_prefix(nodes), "graph_id", "left").select("graph_id", "file_path", folder_domain(F.col("file_path"), F.coalesce("prefix", F.lit(""))).alias("folder"))
    placed = materialise(placed)
    known = placed.where("folder IS NOT NULL").select("graph_id", F.col("folder").alias("domain")).distinct()
    words = placed.where("folder IS NULL").select("graph_id", "file_path", _name_words(F.col("file_path")).alias("words"))
    runs = F.transform("words", lambda w, i: F.struct((-i).alias("rank"), F.array_join(F.slice("words", 1, i + 1), "").alias("word")))
    single = F.transform("words", lambda w, i: F.struct((i + 1).alias("rank"), w.alias("word")))
    spoken = words.select("graph_id", "file_path", F.explode(F.concat(F.transform(runs, lambda r: F.struct(F.lit(0).alias("whole"), r["rank"].alias("rank"), r["word"].alias("word"))), F.transform(single, lambda r: F.struct(F.lit(1).alias("whole"), r["rank"].alias("rank"), r["word"].alias("word"))))).alias("s"))
    forms = spoken.select("graph_id", "file_path", "s.whole", "s.rank", F.posexplode(_forms(F.col("s.word"))).alias("form", "domain")).where("domain IS NOT NULL")
    named = forms.join(known, ["graph_id", "domain"]).groupBy("graph_id", "file_path").agg(F.min(F.struct("whole", "rank", "form", "domain")).getField("domain").alias("named"))
    return placed.join(named, ["graph_id", "file_path"], "left").select("graph_id", "file_path", F.coalesce("folder", "named", F.lit("common")).alias("domain"))


def owner_matches(url: Column, user: Column) -> Column:
    """Whether the owner in a repository's address is that user, in any case; false where either is missing."""
    owner = F.regexp_extract(url, r"github\.com[/:]([^/]+)/", 1)
    return F.coalesce((owner != "") & (F.lower(owner) == F.lower(user)), F.lit(False))


def in_tab(nodes: DataFrame, layer: str) -> DataFrame:
    """Nodes whose path holds a directory of that name."""
    return nodes.where(F.array_contains(F.split("file_path", "/"), layer))


def structure_gate(nodes: DataFrame) -> DataFrame:
    """graph_id, contexts, features, structured: whether a graph has two contexts or two features already."""
    c = rules.contexts(nodes).where("fn_context IS NOT NULL").groupBy("graph_id").agg(F.countDistinct("fn_context").alias("contexts"))
    f = nodes.groupBy("graph_id").agg(F.countDistinct(P.feature_of(F.col("file_path"))).alias("features"))
    g = f.join(c, "graph_id", "left").withColumn("contexts", F.coalesce("contexts", F.lit(0)))
    return g.select("graph_id", "contexts", "features", ((F.col("contexts") >= 2) | (F.col("features") >= 2)).alias("structured"))


def clusters(labels: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """graph_id, endpoint, cluster: endpoints linked by ``least`` or more labels that few endpoints have; the smallest names the cluster.

    Labels in half of a graph's footprints or more link nothing. Graphs of few labels are taken whole by a task; else what is left of a label joins few endpoints with each other.
    """
    return told_clusters(labels, least).drop("rare")


def told_clusters(labels: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``clusters`` with ``rare``, the labels of each endpoint that few endpoints have."""
    labels = labels.select("graph_id", "endpoint", "label")
    if not localgraphs.by_names((labels, "endpoint"), (labels, "label")):
        return _joined_clusters(labels, least)
    # what has no graph or endpoint is linked with nothing, and of no module
    alone = labels.where("graph_id IS NULL OR endpoint IS NULL").select("graph_id", "endpoint").distinct().select("graph_id", "endpoint", F.col("endpoint").alias("cluster"), F.lit(None).cast("array<string>").alias("rare"))
    small, large = localgraphs.split(materialise(labels.where("graph_id IS NOT NULL AND endpoint IS NOT NULL")), localgraphs.LABEL_ROWS)
    out = localgraphs.clusters(small, traversal.SHARED_PERCENT, traversal.LEAST_FOOTPRINTS, least).unionByName(alone)
    return materialise(out if large is None else out.unionByName(_joined_clusters(large, least)))


def _joined_clusters(labels: DataFrame, least: int) -> DataFrame:
    rare = materialise(labels.distinct().join(traversal.shared_labels(labels).select("graph_id", "label"), ["graph_id", "label"], "left_anti"))
    other = rare.select("graph_id", "label", F.col("endpoint").alias("with"))
    links = rare.join(other, ["graph_id", "label"]).where("endpoint <> with").groupBy("graph_id", "endpoint", "with").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    links = materialise(links.select("graph_id", "endpoint", "with"))
    at = materialise(labels.select("graph_id", "endpoint").distinct().withColumn("cluster", F.col("endpoint")))
    while True:
        seen = links.join(at.select("graph_id", F.col("endpoint").alias("with"), F.col("cluster").alias("near")), ["graph_id", "with"]).groupBy("graph_id", "endpoint").agg(F.min("near").alias("near"))
        following = at.join(seen, ["graph_id", "endpoint"], "left").select("graph_id", "endpoint", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"), (F.col("near") < F.col("cluster")).alias("moved"))
        following = materialise(following)
        at = following.drop("moved")
        if following.where("moved").isEmpty():
            # a list holds null as well, which collecting alone leaves out
            of = rare.groupBy("graph_id", "endpoint").agg(F.transform(F.collect_list(F.struct("label")), lambda s: s["label"]).alias("rare"))
            return at.join(of, ["graph_id", "endpoint"], "left")


def candidate_modules(clustered: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, cluster, name, endpoints, files, sample: modules of graphs with two clusters or more.

    The name is the most frequent part of the endpoints' paths; of equal ones the smallest. The sample is the first files by name. Where ``clustered`` has
    the ``rare`` labels (``told_clusters``), they are not sought again among ``labels``, and clusters without any, which are no modules, are left at once.
    """
    many = clustered.groupBy("graph_id").agg(F.countDistinct("cluster").alias("n")).where("n >= 2").select("graph_id")
    c = materialise(clustered.join(many, "graph_id", "left_semi"))
    if "rare" in c.columns:
        own = c.select("graph_id", "cluster", F.explode("rare").alias("label")).distinct()
        c = c.join(own.select("graph_id", "cluster").distinct(), ["graph_id", "cluster"], "left_semi").drop("rare")
    else:
        own = labels.join(traversal.shared_labels(labels).select("graph_id", "label"), ["graph_id", "label"], "left_anti").join(c, ["graph_id", "endpoint"]).select("graph_id", "cluster", "label").distinct()
    parts = c.join(nodes.select("graph_id", F.col("id").alias("endpoint"), "name"), ["graph_id", "endpoint"]).select("graph_id", "cluster", F.explode(F.split(F.regexp_replace("name", "^[^:]*:", ""), "/")).alias("part"))
    parts = parts.where("trim(part) <> '' AND NOT startswith(part, '{') AND lower(part) <> 'api' AND NOT part RLIKE '^v[0-9]+$'").groupBy("graph_id", "cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    names = parts.groupBy("graph_id", "cluster").agg(F.min_by("part", F.struct(-F.col("n"), F.col("part"))).alias("name"))
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("graph_id", "cluster").orderBy("label")))
    files = ranked.groupBy("graph_id", "cluster").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= MODULE_SAMPLE, F.col("label")))), "\n").alias("sample"))
    sizes = c.groupBy("graph_id", "cluster").agg(F.count(F.lit(1)).alias("endpoints"))
    return files.join(sizes, ["graph_id", "cluster"]).join(names, ["graph_id", "cluster"], "left").select("graph_id", "cluster", "name", "endpoints", "files", "sample")


def folder_map(nodes: DataFrame, summary: bool = False) -> DataFrame:
    """graph_id, depth, kind, label, comment, sort_key: directories, files and (unless ``summary``) functions, in the order of a tree."""
    own = nodes.where(F.col("type").isin(["FILE"] if summary else ["FILE", "FUNCTION"])).where(~P.is_test_artifact(F.col("file_path"), F.coalesce("name", F.lit(""))))
    parts = F.split("file_path", "/")
    folders = own.where("type = 'FILE'").select("graph_id", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.slice(parts, 1, n)))).alias("p")).distinct()
    out = folders.select("graph_id", F.size("p").alias("depth"), F.lit("DIRECTORY").alias("kind"), F.element_at("p", -1).alias("label"), F.lit(None).cast("string").alias("comment"), F.array_join("p", "/").alias("sort_key"))
    rows = own.select("graph_id", (F.size(parts) + F.when(F.col("type") == "FUNCTION", 1).otherwise(0)).alias("depth"), F.col("type").alias("kind"), F.when(F.col("type") == "FUNCTION", F.col("name")).otherwise(F.element_at(parts, -1)).alias("label"), "comment", F.when(F.col("type") == "FUNCTION", F.concat("file_path", F.lit("/"), "name")).otherwise(F.col("file_path")).alias("sort_key"))
    return out.unionByName(rows)


def context_map(nodes: DataFrame) -> DataFrame:
    """graph_id, context, pos, file_path: files by context, ``(none)`` for those without; graphs without any context give no rows."""
    files = nodes.where("type = 'FILE'").where(~P.is_test_artifact(F.col("file_path"), F.coalesce("name", F.lit(""))))
    placed = materialise(rules.with_contexts(files).select("graph_id", "file_path", F.coalesce("fn_context", F.lit("(none)")).alias("context")))
    some = placed.where("context <> '(none)'").select("graph_id").distinct()
    order = Window.partitionBy("graph_id", "context").orderBy("file_path")
    return placed.join(some, "graph_id", "left_semi").select("graph_id", "context", F.row_number().over(order).alias("pos"), "file_path")


def context_specs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, context, files, has_api, has_db, comments: the first contexts by name with two files or more, and what is said of them."""
    at = materialise(context_map(nodes).where("context <> '(none)'"))
    big = at.groupBy("graph_id", "context").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= CONTEXT_FILES)
    big = big.withColumn("rn", F.row_number().over(Window.partitionBy("graph_id").orderBy("context"))).where(F.col("rn") <= CONTEXTS)
    own = at.join(big.select("graph_id", "context"), ["graph_id", "context"], "left_semi").select("graph_id", "context", "file_path")
    inside = nodes.join(own, ["graph_id", "file_path"])
    db = edges.where(F.col("type").isin(rules.DB_ACCESS)).select("graph_id", F.col("src").alias("id")).distinct().withColumn("db", F.lit(True))
    told = inside.join(db, ["graph_id", "id"], "left").groupBy("graph_id", "context").agg(F.bool_or(F.col("type") == "API_ENDPOINT").alias("has_api"), F.bool_or(F.coalesce("db", F.lit(False))).alias("has_db"), F.count("comment").alias("comments"))
    return big.select("graph_id", "context", "files").join(told, ["graph_id", "context"])
