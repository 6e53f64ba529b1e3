"""Predicates and classifications of file paths and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory and method names that decide the rules' results.
DOMAIN_DIRS = ["domain", "domains", "core"]
APPLICATION_DIRS = ["application", "usecase", "usecases", "services"]
INFRA_DIRS = ["infrastructure", "infra", "persistence", "adapter", "adapters", "dao", "db"]
INTERFACE_DIRS = ["interfaces", "presentation", "controllers", "controller"]
UPPER_DIRS = ["interfaces", "presentation", "application", "usecase", "usecases", "api", "routes"]
PERSISTENCE_DIRS = ["persistence", "db", "repository", "repositories", "dao", "jpa", "jdbc", "mybatis", "mapper", "mappers", "orm", "datasource"]
SHARED_DIRS = ["components", "hooks", "lib", "utils", "types", "stores", "config", "providers", "assets"]
SERVICE_WRAPPERS = ["services", "apps", "packages", "modules"]
LAYER_TERMS = [
    "domain", "application", "infrastructure", "interfaces", "presentation", "adapter", "adapters", "port", "ports", "service", "services",
    "model", "models", "entity", "entities", "repository", "repositories", "controller", "controllers", "usecase", "usecases", "use_case",
    "in", "out", "web", "persistence", "api", "rest", "config", "common", "shared", "dto", "dtos", "mapper", "mappers", "util", "utils",
    "seedwork", "shared_kernel", "kernel",
]
BOUNDARY_LAYERS = [
    "application", "usecase", "usecases", "model", "models", "domain", "domains", "core", "infrastructure", "infra", "adapter", "adapters",
    "persistence", "web", "port", "ports", "interfaces", "presentation", "api", "dao",
]
CONTEXT_FIRST_DOMAIN_DIRS = ["domain", "domains", "core", "model", "models"]
LAYERED_DIRS = {
    0: ["controller", "controllers", "web", "rest", "api", "endpoint", "endpoints", "route", "routes"],
    2: ["repository", "repositories", "dao", "mapper", "mappers", "persistence"],
    1: ["service", "services", "usecase", "usecases", "business", "biz"],
    3: ["model", "models", "entity", "entities", "domain"],
}
REPOSITORY_BASE = ["save", "saveAll", "saveAndFlush", "findById", "findAll", "findAllById", "deleteById", "delete", "deleteAll", "deleteAllById", "existsById", "count", "flush"]
FRAMEWORK_CALLS = [
    "of", "newId", "create", "from", "build", "findById", "findAll", "findAllById", "save", "saveAll", "deleteById", "deleteAll", "existsById", "count",
    "convertToDatabaseColumn", "convertToEntityAttribute", "toString", "equals", "hashCode", "compareTo", "main", "run", "init", "destroy", "close",
    "handleException", "handleMethodArgumentNotValid", "handleNoHandlerFound", "configure", "userDetailsService", "passwordEncoder",
    "getApplicationContext", "contextLoads", "confirm", "touch", "apply", "activate", "deactivate", "enable", "disable", "reset",
    "defaultStyle", "empty", "none", "zero",
]
COLLECTION_CALLS = [
    "get", "set", "add", "addAll", "put", "putAll", "remove", "removeAll", "contains", "containsKey", "clear", "size", "isEmpty", "keySet", "values",
    "entrySet", "stream", "forEach", "orElse", "orElseGet", "orElseThrow", "ifPresent", "getOrDefault", "computeIfAbsent", "anyMatch", "allMatch",
    "noneMatch", "findFirst", "toList", "matches", "matcher",
]

TEST_FILE = r"((Test|Tests)\.(java|kt|swift)|\.(test|spec)\.(ts|tsx|js|jsx)|_test\.(go|py))$"
TEST_DIR = r"/(test|tests|__tests__)/"
ROOT_FILE = r"(LifeCycle|Lifecycle|Bootstrap|Configuration)(\.[^./]*)?$"
ERROR_FILE = r"(^|/)(error|errors|exception|exceptions)(\.[^./]*)?$"


def any_of(dirs: list[str]) -> str:
    return "/(" + "|".join(dirs) + ")/"


def in_layer(path: Column, dirs: list[str]) -> Column:
    """Whether a directory of the path, not the first one without a leading slash, is one of ``dirs``."""
    return path.rlike(any_of(dirs))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"/src/test/|/__tests__/|\.test\.|\.spec\.")


def is_test_artifact(path: Column, name: Column) -> Column:
    return F.concat(F.lit("/"), path, F.lit("/")).rlike(TEST_DIR) | path.rlike(TEST_FILE) | F.startswith(name, F.lit("test_"))


def is_error_module(path: Column) -> Column:
    return F.lower(path).rlike(ERROR_FILE)


def is_composition_root(path: Column) -> Column:
    return path.rlike(ROOT_FILE)


def is_orchestrator(path: Column, name: Column) -> Column:
    return path.endswith("Controller.java") | (path.contains("/application/") & path.rlike(r"(ApplicationService|Facade)\.java$")) | name.endswith("Inner")


def is_framework_call(name: Column) -> Column:
    """Accessor-like, handler-like and query-like names, and capitalised ones."""
    long_enough = F.length(name) > 6
    return (
        name.rlike("^(get|set)[A-Z]") | name.rlike("^(is|on)[A-Z]") | name.rlike("^handle[A-Z]")
        | (name.rlike("^(find|count|existsBy|delete)") & long_enough)
        | (name.rlike("^(save|update|toggle|mark|upgrade|downgrade)") & (F.length(name) > 4)) | name.rlike("^[A-Z]")
    )


def feature_of(path: Column) -> Column:
    found = F.regexp_extract(path, r"(?:^|/)features/([^/]+)/", 1)
    return F.when(found != "", found)


def frontend_rank(path: Column) -> Column:
    """0 app, 1 features, 2 entities, 3 shared, null elsewhere."""
    has = lambda dirs: path.rlike("(^|/)(" + "|".join(dirs) + ")/")
    return F.when(feature_of(path).isNotNull(), 1).when(has(["app"]), 0).when(has(["entities"]), 2).when(has(["shared"]) | has(SHARED_DIRS), 3)


def layer_rank(path: Column) -> Column:
    """Layered architecture: 0 Controller, 1 Service, 2 Repository, 3 Model, by class name, then by directory."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    guarded = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    out = F.when(stem.rlike("Controller$"), 0).when(stem.rlike("(Repository|Dao|DAO|Mapper)$"), 2).when(stem.rlike("Service$"), 1).when(stem.rlike("(Entity|Model|VO)$"), 3)
    for rank, dirs in LAYERED_DIRS.items():
        out = out.when(guarded.rlike(any_of(dirs)), rank)
    return out


def service_of(path: Column) -> Column:
    """The first directory, or the second behind a wrapper directory; null where no file follows."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    at = F.when(F.lower(parts[0]).isin(SERVICE_WRAPPERS), 1).otherwise(0)
    return F.when((F.size(parts) >= 2) & (at < F.size(parts) - 1), F.get(parts, at))


def after_layer(path: Column, dirs: list[str], not_nested: bool = False) -> Column:
    """The directory behind the first of ``dirs``, in their order, unless it is a layer term itself."""
    found = []
    for d in dirs:
        seg = F.regexp_extract(path, f"^.*?/{d}/([^/]+)/", 1)
        ok = (seg != "") & ~seg.isin(LAYER_TERMS)
        if not_nested:
            ok &= ~F.concat(F.regexp_extract(path, f"^(.*?)/{d}/", 1), F.lit("/")).rlike(any_of(APPLICATION_DIRS))
        found.append(F.when(ok, seg))
    return F.coalesce(*found)


def before_layer(path: Column, dirs: list[str], contexts: Column) -> Column:
    """The directory before one of ``dirs`` where it is among ``contexts``."""
    found = []
    for d in dirs:
        seg = F.regexp_extract(path, f"(?:^|/)([^/]*)/{d}/", 1)
        found.append(F.when((seg != "") & F.array_contains(contexts, seg), seg))
    return F.coalesce(*found)


def application_context(path: Column, contexts: Column) -> Column:
    return F.coalesce(before_layer(path, APPLICATION_DIRS, contexts), after_layer(path, APPLICATION_DIRS))


def domain_context(path: Column, contexts: Column) -> Column:
    return F.coalesce(before_layer(path, CONTEXT_FIRST_DOMAIN_DIRS, contexts), after_layer(path, DOMAIN_DIRS, True))


def function_context(path: Column, contexts: Column) -> Column:
    return F.coalesce(domain_context(path, contexts), application_context(path, contexts))


def glob_to_regex(glob: Column) -> Column:
    """``**`` any path, ``*`` within a directory, ``?`` one sign."""
    quoted = F.regexp_replace(glob, r"([.+()\[\]{}^$|\\])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(quoted, r"\*\*/?", "\u0001"), r"\*", "[^/]*")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(marked, "\u0001", ".*"), r"\?", "[^/]"), F.lit("$"))
