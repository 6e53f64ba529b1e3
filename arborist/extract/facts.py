"""Facts from source text: each function maps files (graph_id, file_path, language, content) to one long table.

All of it is column expressions: a regular expression a language, chosen by ``language``, and windows over the lines of a file.
``ord`` counts a file's matches from 0 in the order of the text. Definitions, calls, imports and annotations are read from
``code``, the text without comments (``masked``); comments, tables and endpoints from the text itself.

Cases: null content has no facts; an unknown language has only those facts that don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scopes

KEY = ["graph_id", "file_path"]

# Names and patterns that decide the results.
KEYWORDS = [
    "if", "else", "for", "while", "switch", "try", "catch", "return", "new", "class", "interface", "enum", "void", "int", "long", "boolean",
    "String", "List", "Map", "Set", "var", "val", "let", "const",
]
NOT_INSTANTIATED = [
    "ArrayList", "HashMap", "HashSet", "LinkedHashMap", "LinkedHashSet", "LinkedList", "TreeMap", "TreeSet", "StringBuilder", "StringBuffer",
    "Object", "Exception", "RuntimeException", "IllegalArgumentException", "IllegalStateException", "UnsupportedOperationException", "NullPointerException",
    "Thread", "Runnable", "Random", "Scanner", "File", "Path",
]
FRAMEWORK_ANNOTATIONS = [
    "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "InitBinder", "ModelAttribute", "ExceptionHandler",
    "Bean", "EventListener", "Scheduled", "PostConstruct", "PreDestroy", "Override",
    "Test", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "ParameterizedTest", "RepeatedTest",
]
STEREOTYPES = ["Component", "Service", "Repository", "Configuration", "RestController"]
DJANGO_WRITES = ["create", "bulk_create", "get_or_create", "update_or_create", "update", "bulk_update", "delete"]
TYPEORM_WRITES = ["save", "insert", "update", "delete", "remove", "softDelete", "softRemove", "upsert", "increment", "decrement"]
SCRIPT = ["TypeScript", "JavaScript"]
JVM = ["Java", "Kotlin"]
#: The definition behind an endpoint's annotation or decorator.
# possessive groups, which Java's engine walks without a stack frame a word
_JAVA_DEF = r"(?:(?:public|private|protected|static|final|synchronized|abstract|default|native)\s+)++(?:[\w<>\[\]?,]+\s++(?!\())*+(\w+)\s*\([^)]*\)\s*(?:throws[^{]+)?\{"
DEFINITIONS = {
    "Java": _JAVA_DEF, "C#": _JAVA_DEF,
    "Kotlin": r"(?m)^[ \t]*(?:(?:public|private|protected|internal|override|open|abstract|suspend|inline|operator|external)\s+)*+fun\s+(\w+)\s*[(<]",
    "Python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(",
}
IMPORTS = {
    "Java": r"(?m)^import\s+([\w.]+);", "Kotlin": r"(?m)^import\s+([\w.]+)", "TypeScript": r"from\s+['\"]([^'\"]+)['\"]", "JavaScript": r"from\s+['\"]([^'\"]+)['\"]",
    "Python": r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+([\w.,\s]+))", "Rust": r"(?m)^\s*use\s+([\w:]+)", "C#": r"(?m)^using\s+([\w.]+);",
    "Ruby": r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "PHP": r"(?m)^\s*(?:use|namespace)\s+([\w\\]+)", "Swift": r"(?m)^import\s+(\w+)",
}
#: Languages in which methods may begin with a capital.
PASCAL = ["C#", "Go"]
#: Endpoints by a method call or decorator: the method and the path.
ROUTES = {
    "JavaScript": r"(?i)\b(?:router|app)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`\n]+)['\"`]", "TypeScript": r"(?i)\b(?:router|app)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`\n]+)['\"`]",
    "Python": r"(?i)@(?:app|router|bp|blueprint)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`\n]+)['\"`]", "Go": r"(?i)\b\w+\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*\"([^\"\n]+)\"",
    "Ruby": r"(?im)^\s*(get|post|put|delete|patch)\s+['\"]([^'\"\n]+)['\"]", "PHP": r"(?i)(?:Route::|\$router->)(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"\n]+)['\"]",
    "Swift": r"(?i)(?:router|app)\.(get|post|put|delete|patch)\s*\(\s*\"([^\"\n]+)\"",
}
#: Calls of HTTP clients, up to the host that they name.
HTTP_HOST = r"http://([a-zA-Z0-9_-]+)"
JVM_CLIENT = r"\.(?:uri|getForObject|getForEntity|postForObject|postForEntity|put|delete|exchange)\s*\(\s*"
HOST_FIELD = r"\bString\s+(\w+)\s*=\s*[\"']http://([a-zA-Z0-9_-]+)"
VALUE_FIELD = r"@Value\s*\(\s*\"\$\{([a-zA-Z0-9_.-]+)\}\"\s*\)(?=([\s\S]{0,80}))"
PYTHON_CLIENT = r"\brequests\.(?:get|post|put|delete|patch|head|options)\s*\(\s*"
PYTHON_ENV = r"f[\"']http://\{os\.(?:environ\[['\"]|environ\.get\(['\"]|getenv\(['\"])([A-Za-z0-9_]+)"
SCRIPT_CLIENT = r"\baxios\.(?:get|post|put|delete|patch)\s*\(\s*"
SCRIPT_ENV = r"[`\"']?\$?\{?\s*process\.env\.([A-Za-z0-9_]+)"
GO_CLIENT = r"\bhttp\.(?:Get|Post|Head)\s*\(\s*\""
GO_REQUEST = r"\bhttp\.NewRequest\s*\(\s*\"[A-Z]+\"\s*,\s*\""
SPRING_CLASS = r"@RequestMapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']"
SPRING_METHOD = r"(?i)@(?:Get|Post|Put|Delete|Patch)Mapping(?:\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']*)[\"']\s*\))?"


def _by_language(patterns: dict[str, str], found) -> Column:
    """``found(pattern, language)`` for a row's language; null elsewhere."""
    out = None
    for language, pattern in patterns.items():
        out = F.when(F.col("language") == language, found(pattern, language)) if out is None else out.when(F.col("language") == language, found(pattern, language))
    return out


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))


def _first_group(text: str, pattern: str, groups: int) -> Column:
    """The first of a match's groups that isn't empty, for all matches."""
    if groups == 1:
        return _all(text, pattern)
    zipped = F.arrays_zip(*[_all(text, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)])
    return F.transform(zipped, lambda m: F.coalesce(*[F.when(F.trim(m[f"g{g}"]) != "", m[f"g{g}"]) for g in range(1, groups + 1)], F.lit("")))


def _long(df: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    return df.select(*KEY, *keep, F.posexplode(values).alias("ord", name))


def masked(files: DataFrame) -> DataFrame:
    """Adds ``code``, if it isn't there: the text without comments, strings kept. Quotes and comment signs are those of the language."""
    if "code" in files.columns:
        return files
    double, single, back, triple = r'"(?:\\.|[^"\\\n])*+"', r"'(?:\\.|[^'\\\n])*+'", r"`(?:\\.|[^`\\])*+`", r'"""(?s:.*?)"""'
    slashes = r"|//[^\n]*+|/\*(?s:.*?)\*/"
    forms = {
        "Python": rf"({triple}|'''(?s:.*?)'''|{double}|{single})|#[^\n]*+", "Ruby": rf"({double}|{single})|#[^\n]*+", "PHP": rf"({double}|{single})|#[^\n]*+{slashes}", "Rust": rf"({double}){slashes}",
        "TypeScript": rf"({double}|{single}|{back}){slashes}", "JavaScript": rf"({double}|{single}|{back}){slashes}", "Go": rf"({double}|{single}|{back}){slashes}",
        "Java": rf"({triple}|{double}|{single}){slashes}", "Kotlin": rf"({triple}|{double}|{single}){slashes}", "Swift": rf"({triple}|{double}|{single}){slashes}",
    }
    code = F.coalesce(_by_language(forms, lambda p, _: F.regexp_replace("content", p, "$1")), F.regexp_replace("content", rf"({double}|{single}){slashes}", "$1"))
    return files.withColumn("code", code)


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row a line: line (from 1), text."""
    return files.select(*KEY, "language", F.posexplode(F.split(text, "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")


def _with_next(files: DataFrame, text: str, n: int, wanted) -> DataFrame:
    """line (from 1), text, following: the wanted lines, each with the n lines from it on. A file's lines stay where the file lies."""
    cut = files.select(*KEY, "language", F.split(text, "\n").alias("all"))
    at = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: wanted(F.get("all", i - 1)))
    return cut.select(*KEY, "language", F.explode(F.transform(at, lambda i: F.struct(i.alias("line"), F.slice("all", i, F.lit(n)).alias("following")))).alias("x")).select(*KEY, "language", "x.line", F.get("x.following", F.lit(0)).alias("text"), "x.following")


def file_comments(files: DataFrame) -> DataFrame:
    """comment: what the first line says that is neither blank nor a package or directive line, if it is a comment."""
    hashes = F.col("language").isin("Python", "Ruby")
    told = lambda x: (F.trim(x) != "") & (hashes | ~F.trim(x).rlike("^(package|'use|#!)"))
    first = files.select(*KEY, "language", F.trim(F.get(F.filter(F.split("content", "\n"), told), F.lit(0))).alias("text")).where("text IS NOT NULL")
    block = F.trim(F.regexp_replace(F.regexp_replace("text", r"^/\*+\s*", ""), r"\s*\*+/$", ""))
    said = F.when(hashes & F.col("text").startswith("#"), F.trim(F.expr("substring(text, 2)"))).when(~hashes & F.col("text").startswith("//"), F.trim(F.expr("substring(text, 3)"))).when(~hashes & F.col("text").startswith("/*") & (block != ""), block)
    return first.select(*KEY, said.alias("comment")).where("comment IS NOT NULL")


def function_comments(files: DataFrame) -> DataFrame:
    """name, comment: of each comment line the functions named in the first line after it that is neither blank nor an annotation, within 9."""
    t = _with_next(files, "content", 10, lambda x: F.trim(x).rlike(r"^(//|\*|#)")).withColumn("text", F.trim("text"))
    said = F.when(F.col("text").startswith("//"), F.trim(F.expr("substring(text, 3)"))).when(F.col("text").startswith("*") & ~F.col("text").startswith("*/"), F.trim(F.regexp_replace("text", r"^\*+\s*", "")))
    said = said.when(F.col("language").isin("Python", "Ruby") & F.col("text").startswith("#"), F.trim(F.expr("substring(text, 2)")))
    real = F.filter(F.transform(F.slice("following", 2, 9), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("@"))
    t = t.withColumn("comment", said).withColumn("ahead", F.get(real, F.lit(0))).where("comment <> '' AND ahead IS NOT NULL")
    names = t.select(*KEY, "line", "comment", F.explode(F.regexp_extract_all("ahead", F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1))).alias("name"))
    return names.where(~F.col("name").isin(KEYWORDS)).groupBy(*KEY, "name").agg(F.min_by("comment", "line").alias("comment"))


def definitions(files: DataFrame) -> DataFrame:
    """pos, name, repeated, abstract, in_interface, is_test, body of each definition; bodies end at their bracket and leave out what is defined in them."""
    return files if "body" in files.columns else scopes.definitions(masked(files), KEYWORDS)


def functions(files: DataFrame) -> DataFrame:
    """name, defs, ord, is_test, in_interface: each file's functions with the number of definitions; methods without body where none has one."""
    d = definitions(files).withColumn("ord", F.col("pos") + F.when(F.col("abstract"), 1 << 20).otherwise(0))
    one = d.groupBy(*KEY, "name").agg(
        F.count(F.when(~F.col("abstract"), 1)).alias("real"), F.min("ord").alias("ord"), F.max("is_test").alias("is_test"), F.max("in_interface").alias("in_interface")
    )
    return one.select(*KEY, "name", F.greatest("real", F.lit(1)).alias("defs"), "ord", "is_test", "in_interface")


def calls(files: DataFrame) -> DataFrame:
    """caller, target_class (null for bare calls), callee: distinct calls in each function's body."""
    d = definitions(files).select(*KEY, "language", F.col("name").alias("caller"), "repeated", F.col("body").alias("text"))
    pascal = F.col("language").isin(PASCAL)
    bare = F.when(pascal, _all("text", r"(?<!new\s)\b([A-Za-z_][a-zA-Z0-9_]*)\s*\(")).otherwise(_all("text", r"\b([a-z][a-zA-Z0-9_]*)\s*\("))
    name = F.when(pascal, F.lit("[A-Za-z_]")).otherwise("[a-z]")
    dotted = F.regexp_extract_all(F.col("text"), F.concat(F.lit(r"\b([A-Z][a-zA-Z0-9_]*\."), name, F.lit(r"[a-zA-Z0-9_]*)\s*\(")), F.lit(1))
    call = lambda target, callee: F.struct(target.alias("target_class"), callee.alias("callee"))
    found = F.concat(F.transform(F.filter(F.array_distinct(bare), lambda x: x != F.col("caller")), lambda x: call(F.lit(None).cast("string"), x)), F.transform(F.array_distinct(dotted), lambda x: call(F.substring_index(x, ".", 1), F.substring_index(x, ".", -1))))
    # a body's calls are distinct where it lies; only the bodies of functions that a file defines more than once meet, a row each
    d = d.select(*KEY, "caller", "repeated", found.alias("found"))
    again = d.where("repeated").groupBy(*KEY, "caller").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    out = d.where("NOT repeated").select(*KEY, "caller", "found").unionByName(again)
    return out.select(*KEY, "caller", F.explode("found").alias("x")).select(*KEY, "caller", "x.target_class", "x.callee").where(~F.col("callee").isin(KEYWORDS))


def imports(files: DataFrame) -> DataFrame:
    """ord, import: import paths as written."""
    code = masked(files)
    found = _long(code, _by_language(IMPORTS, lambda p, lang: _first_group("code", p, 2 if lang == "Python" else 1)), "import")
    go = code.where("language = 'Go'")
    blocks = go.select(*KEY, F.explode(_all("code", r"(?ms)^import\s*\((.*?)\)")).alias("block"))
    quoted = _long(blocks, F.regexp_extract_all("block", F.lit('"([^"]+)"'), F.lit(1)), "import")
    single = _long(go, _all("code", r'(?m)^import\s+(?:[\w.]+\s+|_\s+)?"([^"]+)"'), "import")
    return found.unionByName(quoted).unionByName(single).withColumn("import", F.regexp_replace("import", r"^\s+|\s+$", "")).where("import <> ''")


def value_references(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """name: functions of the file (``known``, if they have been read) that are named without being called, and not behind a dot."""
    tokens = masked(files).select(*KEY, F.explode(F.array_distinct(_all("code", r"(?<![.\w])(\w+)\b(?!\s*\()"))).alias("name"))
    return tokens.join((functions(files) if known is None else known).select(*KEY, "name"), [*KEY, "name"], "left_semi").distinct()


def instantiated(files: DataFrame) -> DataFrame:
    """class_name: classes behind ``new``, without common library classes."""
    found = masked(files).select(*KEY, F.explode(F.array_distinct(_all("code", r"\bnew\s+([A-Z]\w*)\s*[<(]"))).alias("class_name"))
    return found.where(~F.col("class_name").isin(NOT_INSTANTIATED))


def _one(files: DataFrame, languages: list[str], pattern: str, name: str, text: str = "code") -> DataFrame:
    found = masked(files).where(F.col("language").isin(languages)).select(*KEY, F.regexp_extract(text, pattern, 1).alias(name))
    return found.where(F.col(name) != "")


def repository_entities(files: DataFrame) -> DataFrame:
    return _one(files, JVM, r"extends\s+(?:Jpa|Crud|PagingAndSorting)?Repository\s*<\s*(\w+)\s*,", "entity_class")


def superclasses(files: DataFrame) -> DataFrame:
    return _one(files, ["Java"], r"\bclass\s+\w+(?:<[^{]*?>)?\s+extends\s+(\w+)", "superclass")


def feign_targets(files: DataFrame) -> DataFrame:
    """service: the logical name of a Feign client, by name or value, else its first argument."""
    args = _one(files, JVM, r"@FeignClient\s*\(([^)]*)\)", "args")
    named, bare = F.regexp_extract("args", r"(?:name|value)\s*=\s*[\"']([^\"']+)[\"']", 1), F.regexp_extract("args", r"^\s*[\"']([^\"']+)[\"']", 1)
    return args.select(*KEY, F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit(""))).alias("service")).where("service IS NOT NULL")


def bean_stereotypes(files: DataFrame) -> DataFrame:
    """stereotype: the first of the listed annotations that the file holds."""
    code = masked(files).where(F.col("language").isin(JVM))
    return code.select(*KEY, F.coalesce(*[F.when(F.col("code").rlike(rf"@{s}\b"), s) for s in STEREOTYPES]).alias("stereotype")).where("stereotype IS NOT NULL")


def lazy_types(files: DataFrame) -> DataFrame:
    return masked(files).where(F.col("language").isin(JVM)).select(*KEY, F.explode(F.array_distinct(_all("code", r"@Lazy\s+(?:final\s+)?([A-Z]\w*)\s+\w"))).alias("type"))


def record_components(files: DataFrame) -> DataFrame:
    """name: components of Java's records, each of which is an accessor without definition."""
    heads = masked(files).where("language = 'Java'").select(*KEY, F.explode(_all("code", r"\brecord\s+\w+\s*(?:<[^>(]*>)?\s*\(([^)]*)\)")).alias("list"))
    parts = heads.select(*KEY, F.explode(F.split(F.regexp_replace("list", r"<[^<>]*>", ""), ",")).alias("part"))
    return parts.select(*KEY, F.regexp_extract("part", r"(\w+)\s*$", 1).alias("name")).where("name <> ''").distinct()


def implemented_interfaces(files: DataFrame) -> DataFrame:
    """interface: what the first class implements; in JVM languages else what the first interface extends, but for Spring's repositories."""
    code = masked(files).where(F.col("language").isin(JVM + SCRIPT))
    by_class = F.regexp_extract("code", r"\bclass\s+\w[\w<>]*(?:\s+extends\s+[\w<>,.\s]+)?\s+implements\s+([\w<>,.\s]+?)\s*\{", 1)
    by_interface = F.when(F.col("language").isin(JVM), F.regexp_extract("code", r"\binterface\s+\w[\w<>]*\s+extends\s+([\w<>,.\s]+?)\s*\{", 1)).otherwise("")
    found = code.select(*KEY, by_class.alias("c"), by_interface.alias("i")).withColumn("own", F.col("c") != "")
    parts = found.select(*KEY, "own", F.explode(F.split(F.when(F.col("own"), F.col("c")).otherwise(F.col("i")), ",")).alias("p"))
    name = F.trim(F.regexp_replace(F.trim("p"), "<[^>]*>", ""))
    parts = parts.select(*KEY, "own", F.when(F.col("own"), name).otherwise(F.substring_index(name, ".", -1)).alias("interface"))
    return parts.where((F.col("interface") != "") & (F.col("own") | ~F.col("interface").rlike("^(Jpa|Crud|PagingAndSorting)?Repository$"))).select(*KEY, "interface").distinct()


def snake(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def entity_columns(files: DataFrame) -> DataFrame:
    """line, field_name, column_name, java_type, has_converter: private fields of entities, with what their annotations say."""
    t = masked(files).where(F.col("language").isin(JVM) & F.col("content").contains("@Entity")).select(*KEY, F.transform(F.split("code", "\n"), lambda x: F.trim(x)).alias("all"))
    # annotations hold up to the next line that is none, which is the field: each such line with what stands between it and the one before
    plain = lambda x: (x != "") & ~x.startswith("@")
    t = t.select(*KEY, "all", F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: plain(F.get("all", i - 1))).alias("ends"))
    before = lambda j: F.coalesce(F.get("ends", j - 1), F.lit(0))
    t = t.select(*KEY, F.explode(F.transform("ends", lambda i, j: F.struct(i.alias("line"), F.get("all", i - 1).alias("text"), F.slice("all", before(j) + 1, i - before(j) - 1).alias("block")))).alias("x")).select(*KEY, "x.*")
    names = F.transform(F.filter("block", lambda x: x.startswith("@Column")), lambda x: F.regexp_extract(x, r"name\s*=\s*[\"']([^\"']+)[\"']", 1))
    t = t.withColumn("named", F.get(F.reverse(names), F.lit(0))).withColumn("converted", F.exists("block", lambda x: x.startswith("@Convert")))
    form = r"private\s+([\w<>\[\]?,\s]+?)\s+(\w+)\s*;"
    t = t.where(F.col("text").startswith("private ")).select(*KEY, "line", F.regexp_extract("text", form, 2).alias("field_name"), F.trim(F.regexp_extract("text", form, 1)).alias("java_type"), "named", F.col("converted").alias("has_converter"))
    t = t.where("field_name NOT IN ('', 'serialVersionUID') AND NOT contains(java_type, 'static')")
    return t.select(*KEY, "line", "field_name", F.coalesce(F.nullif("named", F.lit("")), snake("field_name")).alias("column_name"), "java_type", "has_converter")


def _stem(path: str = "file_path") -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def db_tables(files: DataFrame) -> DataFrame:
    """table_name, class_name: tables by the conventions of JPA, TypeORM, SQLAlchemy, Django, Prisma, ActiveRecord, Eloquent, EF Core, Core Data, GORM and Beego."""
    some = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    row = lambda df, table, name: df.select(*KEY, table.alias("table_name"), name.alias("class_name"))
    first_class, entities = some("content", r"\bclass\s+(\w+)"), files.where(F.col("content").contains("@Entity"))
    out = row(entities.where(F.col("language").isin(JVM)), F.coalesce(some("content", r"@Table\s*\([^)]*name\s*=\s*[\"']([^\"']+)[\"']"), first_class), _stem())
    out = out.unionByName(row(entities.where(F.col("language").isin(SCRIPT)), F.coalesce(some("content", r"@Entity\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"), first_class), first_class))
    python = files.where((F.col("language") == "Python") & ~F.col("file_path").contains("/migrations/"))
    head = r"(?m)^class\s+(\w+)\s*\(([^)]*)\)\s*:"
    # top-level classes, each with the text up to the next one
    blocks = python.select(*KEY, F.explode(F.split("content", r"(?m)(?=^class\s+\w)")).alias("block")).select(*KEY, "block", some("block", head).alias("name"), F.regexp_extract("block", head, 2).alias("bases")).where("name IS NOT NULL")
    alchemy = blocks.where((F.col("bases").contains("Base") | F.col("bases").contains("Model")) & F.col("block").rlike(r"=\s*(?:db\.)?(?:Column|mapped_column)\(|\bMapped\[|\b__tablename__\s*=") & ~F.col("block").rlike(r"\b__abstract__\s*=\s*True\b"))
    out = out.unionByName(row(alchemy, F.coalesce(some("block", r"\b__tablename__\s*=\s*['\"]([^'\"]+)['\"]"), F.col("name")), F.col("name")))
    django = blocks.where(~F.col("bases").contains("migrations.Migration") & (F.col("bases").contains("models.Model") | F.col("block").rlike(r"\bmodels\.(?:\w*Field|ForeignKey)\b")) & ~F.col("block").rlike(r"\babstract\s*=\s*True\b"))
    out = out.unionByName(row(django, F.coalesce(some("block", r"\bdb_table\s*=\s*['\"]([^'\"]+)['\"]"), F.lower("name")), F.col("name")))
    names = lambda df, pattern: df.select(*KEY, F.explode(_all("content", pattern)).alias("n"))
    out = out.unionByName(row(names(files.where(F.col("file_path").endswith(".prisma")), r"(?m)^model\s+(\w+)\s*\{"), F.col("n"), F.col("n")))
    plural = F.concat(snake("n"), F.lit("s"))
    out = out.unionByName(row(names(files.where("language = 'Ruby'"), r"(?m)^class\s+(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)"), plural, F.col("n")))
    out = out.unionByName(row(names(files.where("language = 'PHP'"), r"(?m)^class\s+(\w+)\s+extends\s+(?:Model|Eloquent)"), plural, F.col("n")))
    sharp = files.where("language = 'C#'")
    sets = r"public\s+DbSet\s*<\s*(\w+)\s*>\s+(\w+)\s*\{"
    pairs = sharp.select(*KEY, F.explode(F.arrays_zip(_all("content", sets).alias("c"), _all("content", sets, 2).alias("t"))).alias("x"))
    out = out.unionByName(row(pairs, F.col("x.t"), F.col("x.c"))).unionByName(row(sharp, some("content", r"\[Table\s*\(\s*\"([^\"]+)\"\s*\)\]"), first_class).where("table_name IS NOT NULL AND class_name IS NOT NULL"))
    swift = files.where("language = 'Swift'")
    objc = r"@objc\(\"(\w+)\"\)\s*\nclass\s+(\w+)\s*:\s*NSManagedObject"
    pairs = swift.select(*KEY, F.explode(F.arrays_zip(_all("content", objc).alias("t"), _all("content", objc, 2).alias("c"))).alias("x"))
    out = out.unionByName(row(pairs, F.col("x.t"), F.col("x.c"))).unionByName(row(names(swift, r"class\s+(\w+)\s*:\s*NSManagedObject"), snake("n"), F.col("n")))
    go = files.where("language = 'Go'")
    named = r"func\s*\(\s*(?:\w+\s+)?\*?(\w+)\s*\)\s*TableName\s*\(\s*\)\s*string\s*\{\s*return\s+\"([^\"]+)\""
    pairs = go.select(*KEY, F.explode(F.arrays_zip(_all("content", named).alias("c"), _all("content", named, 2).alias("t"))).alias("x"))
    beego = go.select(*KEY, F.explode(_all("content", r"orm\.RegisterModel\s*\(((?:\s*new\s*\(\s*\w+\s*\)\s*,?)++)\s*\)")).alias("content"))
    ranked = row(pairs, F.col("x.t"), F.col("x.c")).withColumn("rank", F.lit(0)).unionByName(row(names(go, r"type\s+(\w+)\s+struct\s*\{[^}]*?\bgorm\.Model\b"), plural, F.col("n")).withColumn("rank", F.lit(1)))
    ranked = ranked.unionByName(row(names(beego, r"new\s*\(\s*(\w+)\s*\)"), snake("n"), F.col("n")).withColumn("rank", F.lit(2)))
    out = out.unionByName(ranked.groupBy(*KEY, "class_name").agg(F.min_by("table_name", "rank").alias("table_name")).select(*KEY, "table_name", "class_name"))
    return out.where("table_name IS NOT NULL").distinct()


def client_calls(files: DataFrame) -> DataFrame:
    """method, path: HTTP calls of scripts by client methods and fetch; parts in ``${}`` become ``*``."""
    text = files.where(F.col("language").isin(SCRIPT))
    form = r"(?i)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`\n]+)['\"`]"
    direct = text.select(*KEY, F.explode(F.arrays_zip(_all("content", form).alias("m"), _all("content", form, 2).alias("p"))).alias("x")).select(*KEY, F.upper("x.m").alias("method"), F.col("x.p").alias("path"))
    # each fetch with what follows it up to the end of the statement or the next fetch, at most 300 signs
    parts = text.select(*KEY, F.explode(F.slice(F.split("content", r"\bfetch\s*(?=\(\s*['\"`])"), 2, 1 << 30)).alias("s")).select(*KEY, F.regexp_extract("s", r"^\(\s*['\"`]([^'\"`\n]+)['\"`]", 1).alias("path"), F.regexp_replace("s", r"^\(\s*['\"`][^'\"`\n]+['\"`]", "").alias("rest"))
    option = F.regexp_extract(F.split(F.substring("rest", 1, 300), r";|fetch\(")[0], r"(?i)method\s*:\s*['\"`](\w+)['\"`]", 1)
    fetched = parts.select(*KEY, F.coalesce(F.nullif(F.upper(option), F.lit("")), F.lit("GET")).alias("method"), "path")
    return direct.unionByName(fetched).withColumn("path", F.regexp_replace("path", r"\$\{[^}]+\}", "*")).where(F.col("path").startswith("/"))


def compose_hosts(files: DataFrame) -> DataFrame:
    """key, host: environment variables of compose files with an http URL, in list and map style."""
    text = files.where("language = 'DockerCompose'")
    pair = lambda p: F.arrays_zip(_all("content", p).alias("k"), _all("content", p, 2).alias("h"))
    both = F.concat(pair(r"-\s*([A-Za-z0-9_]+)=http://([a-zA-Z0-9_-]+)"), pair(r"(?m)^\s*([A-Za-z0-9_]+):\s*[\"']?http://([a-zA-Z0-9_-]+)"))
    return text.select(*KEY, F.posexplode(both).alias("pos", "x")).groupBy(*KEY, F.col("x.k").alias("key")).agg(F.max_by("x.h", "pos").alias("host"))


def property_hosts(files: DataFrame) -> DataFrame:
    """key, host: settings whose value is an http URL, by dotted key; nested YAML keys by indentation."""
    spring = files.where("language = 'SpringYaml'")
    form = r"(?m)^([A-Za-z0-9_.-]+)\s*=\s*http://([a-zA-Z0-9_-]+)"
    flat = spring.where(F.col("file_path").endswith(".properties")).select(*KEY, F.explode(F.arrays_zip(_all("content", form).alias("k"), _all("content", form, 2).alias("h"))).alias("x"))
    return flat.select(*KEY, F.col("x.k").alias("key"), F.col("x.h").alias("host")).unionByName(scopes.settings(spring.where(~F.col("file_path").endswith(".properties"))))


def endpoints(files: DataFrame) -> DataFrame:
    """mapping, handler, ord: endpoints and the function that serves each, null if none is found.

    Spring (class prefix and method path), NestJS, ASP.NET, Django, and frameworks with a call or decorator a method.
    """
    jvm = files.where(F.col("language").isin(JVM)).withColumn("prefix", F.regexp_extract("content", SPRING_CLASS, 1))
    spring = F.arrays_zip(_all("content", SPRING_METHOD).alias("p"), F.slice(F.split("content", SPRING_METHOD, -1), 2, 1 << 30).alias("rest"))
    handler = _by_language({k: DEFINITIONS[k] for k in JVM}, lambda p, _: F.nullif(F.regexp_extract("x.rest", p, 1), F.lit("")))
    out = jvm.select(*KEY, "language", "prefix", F.posexplode(spring).alias("ord", "x")).select(*KEY, F.concat("prefix", "x.p").alias("mapping"), handler.alias("handler"), "ord").where("mapping <> ''")
    alone = jvm.where((F.col("prefix") != "") & ~F.col("content").rlike(SPRING_METHOD)).select(*KEY, F.col("prefix").alias("mapping"), F.lit(None).cast("string").alias("handler"), F.lit(0).alias("ord"))
    ktor = r"(?i)\b(get|post|put|delete|patch)\s*\(\s*\"(/[^\"\n]*)\""
    plain = jvm.where((F.col("language") == "Kotlin") & (F.col("prefix") == "") & ~F.col("content").rlike(SPRING_METHOD))
    pair = lambda p: F.arrays_zip(_all("content", p).alias("m"), _all("content", p, 2).alias("p"), F.slice(F.split("content", p, -1), 2, 1 << 30).alias("rest"))
    mapping = F.concat(F.upper("x.m"), F.lit(":"), "x.p").alias("mapping")
    none = F.lit(None).cast("string").alias("handler")
    out = out.unionByName(alone).unionByName(plain.select(*KEY, F.posexplode(pair(ktor)).alias("ord", "x")).select(*KEY, mapping, none, "ord"))
    routes = files.select(*KEY, "language", F.posexplode(_by_language(ROUTES, lambda p, _: pair(p))).alias("ord", "x"))
    # the last argument of the line that is a name; behind a decorator the next definition
    last = F.nullif(F.regexp_extract(F.split("x.rest", "\n")[0], r"^\s*,(?:.*[,\s])?(?:\w+\.)?(\w+)\s*\)\s*;?\s*$", 1), F.lit(""))
    after = F.nullif(F.regexp_extract("x.rest", DEFINITIONS["Python"], 1), F.lit(""))
    out = out.unionByName(routes.select(*KEY, mapping, F.when(F.col("language") == "Python", after).otherwise(last).alias("handler"), "ord"))
    django = r"\b(?:re_)?path\s*\(\s*r?['\"]([^'\"\n]*)['\"]\s*,"
    paths = files.where("language = 'Python'").select(*KEY, F.posexplode(_all("content", django)).alias("ord", "p")).withColumn("p", F.regexp_replace(F.regexp_replace("p", r"^\^", ""), r"\$$", ""))
    out = out.unionByName(paths.select(*KEY, F.concat(F.lit("GET:"), F.when(F.col("p").startswith("/"), F.col("p")).otherwise(F.concat(F.lit("/"), "p"))).alias("mapping"), none, "ord"))
    nest = r"@(Get|Post|Put|Delete|Patch)\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?\s*\)"
    nests = files.where(F.col("language").isin(SCRIPT) & F.col("content").contains("@Controller")).withColumn("prefix", F.regexp_extract("content", r"@Controller\s*\(\s*['\"`]([^'\"`]*)['\"`]", 1)).select(*KEY, "prefix", F.posexplode(pair(nest)).alias("ord", "x"))
    method = F.nullif(F.regexp_extract("x.rest", r"(?m)^[ \t]*(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*\(", 1), F.lit(""))
    out = out.unionByName(nests.select(*KEY, F.concat(F.upper("x.m"), F.lit(":"), F.regexp_replace(F.concat(F.lit("/"), "prefix", F.lit("/"), "x.p"), "/+(?=/)|(?<=.)/+$", "")).alias("mapping"), method.alias("handler"), "ord"))
    sharp = files.where("language = 'C#'")
    own = F.lower(F.regexp_extract("content", r"\bclass\s+(\w+)Controller\b", 1))
    sharp = sharp.withColumn("prefix", F.replace(F.regexp_extract("content", r"\[Route\s*\(\s*\"([^\"]+)\"\s*\)\]", 1), F.lit("[controller]"), own))
    http = r"(?i)\[Http(Get|Post|Put|Delete|Patch)(?:\s*\(\s*\"([^\"]+)\"\s*\))?\]"
    sharp = sharp.select(*KEY, "prefix", F.posexplode(pair(http)).alias("ord", "x"))
    full = F.when(F.col("prefix") == "", F.col("x.p")).otherwise(F.regexp_replace(F.concat("prefix", F.lit("/"), "x.p"), "/+", "/"))
    out = out.unionByName(sharp.select(*KEY, F.concat(F.upper("x.m"), F.lit(":"), full).alias("mapping"), F.nullif(F.regexp_extract("x.rest", _JAVA_DEF, 1), F.lit("")).alias("handler"), "ord"))
    return out.groupBy(*KEY, "mapping").agg(F.max_by("handler", "ord").alias("handler"), F.min("ord").alias("ord"))


def raw_sql(files: DataFrame) -> DataFrame:
    """table_name, is_write: tables in string literals that begin with a verb of SQL and hold a sign of it."""
    literal = files.select(*KEY, F.explode(_all("content", r"[\"'`]([^\"'`\n]{5,500})[\"'`]")).alias("s")).withColumn("s", F.trim("s"))
    verb = F.upper(F.regexp_extract("s", r"(?i)^\s*\(?\s*(SELECT|INSERT|UPDATE|DELETE)\b", 1))
    mark = r"(?i)[*=]|\?|%[sd]|:\w|\$\d|;\s*$|\b(WHERE|JOIN|VALUES|GROUP|ORDER|LIMIT|HAVING|RETURNING|UNION)\b"
    literal = literal.withColumn("verb", verb).where((F.col("verb") != "") & F.col("s").rlike(mark))
    forms = {"SELECT": r"(?is)\bSELECT\b.+?\bFROM\s+(\w+)", "INSERT": r"(?i)\bINSERT\s+INTO\s+(\w+)", "UPDATE": r"(?i)\bUPDATE\s+(\w+)\s+SET", "DELETE": r"(?i)\bDELETE\s+FROM\s+(\w+)"}
    tables = F.coalesce(*[F.when(F.col("verb") == v, F.regexp_extract_all("s", F.lit(p), F.lit(1))) for v, p in forms.items()])
    return literal.select(*KEY, F.explode(tables).alias("t"), (F.col("verb") != "SELECT").alias("is_write")).select(*KEY, F.lower("t").alias("table_name"), "is_write").distinct()


def orm_accesses(files: DataFrame) -> DataFrame:
    """entity_class, is_write: accesses of Django, SQLAlchemy and TypeORM that name their entity."""
    code = masked(files)
    python, script = code.where("language = 'Python'"), code.where(F.col("language").isin(SCRIPT))
    objects = r"\b([A-Z]\w+)\.objects\.(\w+)"
    out = python.select(*KEY, F.explode(F.arrays_zip(_all("code", objects).alias("e"), _all("code", objects, 2).alias("m"))).alias("x")).select(*KEY, F.col("x.e").alias("entity_class"), F.col("x.m").isin(DJANGO_WRITES).alias("is_write"))
    reads = lambda df, p: df.select(*KEY, F.explode(_all("code", p)).alias("entity_class"), F.lit(False).alias("is_write"))
    out = out.unionByName(reads(python, r"\b([A-Z]\w+)\.query\b")).unionByName(reads(python, r"\.query\(\s*(?:\w+\.)?([A-Z]\w+)")).unionByName(reads(script, r"\bgetRepository\((\w+)\)"))
    field, use = r"(\w+)\s*:\s*Repository<(\w+)>", r"this\.(\w+)\.(\w+)\("
    fields = script.select(*KEY, F.posexplode(F.arrays_zip(_all("code", field).alias("f"), _all("code", field, 2).alias("e"))).alias("pos", "x")).groupBy(*KEY, F.col("x.f").alias("field")).agg(F.max_by("x.e", "pos").alias("entity_class"))
    uses = script.select(*KEY, F.explode(F.arrays_zip(_all("code", use).alias("f"), _all("code", use, 2).alias("m"))).alias("x")).select(*KEY, F.col("x.f").alias("field"), F.col("x.m").isin(TYPEORM_WRITES).alias("is_write"))
    return out.unionByName(uses.join(fields, [*KEY, "field"]).select(*KEY, "entity_class", "is_write")).distinct()


def jsx_components(files: DataFrame) -> DataFrame:
    text = masked(files).where(F.col("file_path").rlike(r"\.(tsx|jsx)$"))
    return text.select(*KEY, F.explode(F.array_distinct(_all("code", r"<([A-Z]\w*)(?:\s|/?>)"))).alias("component"))


def async_methods(files: DataFrame) -> DataFrame:
    java = r"(?m)^[ \t]*@Async\b[\s\S]{0,200}?(?:public|protected|private)\s+(?:\w+\s++(?!\())*+(\w+)\s*\("
    script = r"(?:async\s+function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*async\s*(?:\(|\w))"
    forms = {"Java": java, "Python": r"(?m)^\s*async\s+def\s+(\w+)\s*\(", "TypeScript": script, "JavaScript": script}
    found = masked(files).select(*KEY, F.explode(_by_language(forms, lambda p, lang: _first_group("code", p, 2 if lang in SCRIPT else 1))).alias("name"))
    return found.where((F.col("name") != "") & ~F.col("name").isin(KEYWORDS)).distinct()


def annotated_methods(files: DataFrame) -> DataFrame:
    """annotation, name: the method behind each line that begins with an annotation or decorator, within 8 more lines."""
    t = _with_next(masked(files).where(F.col("language").isin(JVM + SCRIPT + ["Python"])), "code", 9, lambda x: F.trim(x).startswith("@")).withColumn("annotation", F.regexp_extract(F.trim("text"), r"^@(\w+)", 1))
    bare = F.transform("following", lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s*)++", "")))
    t = t.withColumn("signature", F.get(F.filter(bare, lambda x: (x != "") & ~x.rlike(r"^(//|\*|/\*)")), F.lit(0)))
    name = F.when(F.col("language") == "Python", F.regexp_extract("signature", r"def\s+(\w+)\s*\(", 1)).otherwise(F.regexp_extract("signature", r"([A-Za-z_]\w*)\s*\(", 1))
    t = t.select(*KEY, "language", "annotation", name.alias("name"))
    return t.where((F.col("name") != "") & ~F.col("name").isin(KEYWORDS)).distinct()


def transactional_methods(files: DataFrame) -> DataFrame:
    return annotated_methods(files).where((F.col("annotation") == "Transactional") & F.col("language").isin(JVM)).select(*KEY, "name").distinct()


def framework_methods(files: DataFrame) -> DataFrame:
    """name: methods that a framework calls: listed annotations in JVM languages, any decorator elsewhere."""
    found = annotated_methods(files)
    return found.where(~F.col("language").isin(JVM) | F.col("annotation").isin(FRAMEWORK_ANNOTATIONS)).select(*KEY, "name").distinct()


def interface_methods(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """name: functions (``known``, if they have been read) of JVM files that are defined in the body of the first interface itself, but for Spring's repositories."""
    own = masked(files).where(F.col("language").isin(JVM) & ~F.col("code").rlike(r"extends\s+(?:Jpa|Crud|PagingAndSorting)?Repository\s*<")).select(*KEY)
    return (functions(files) if known is None else known).where("in_interface").join(own, KEY, "left_semi").select(*KEY, "name")


def service_calls(files: DataFrame) -> DataFrame:
    """kind, value: what the HTTP clients of a file call: a ``host``, or a host that an environment variable (``env``) or a setting (``property``) names.

    A JVM field that is put together with a path stands for the host or the setting in its declaration, the last one of its name.
    """
    code = masked(files)
    row = lambda df, pattern, kind: df.select(*KEY, F.lit(kind).alias("kind"), F.explode(_all("code", pattern)).alias("value"))
    jvm, python, script, go = code.where(F.col("language").isin(JVM)), code.where("language = 'Python'"), code.where(F.col("language").isin(SCRIPT)), code.where("language = 'Go'")
    out = row(jvm, JVM_CLIENT + r"[\"']" + HTTP_HOST, "host")
    for df, pattern, kind in (
        (python, PYTHON_CLIENT + r"f?[\"']" + HTTP_HOST, "host"), (python, PYTHON_CLIENT + PYTHON_ENV, "env"), (script, SCRIPT_CLIENT + r"[`\"']" + HTTP_HOST, "host"),
        (script, SCRIPT_CLIENT + SCRIPT_ENV, "env"), (go, GO_CLIENT + HTTP_HOST, "host"), (go, GO_REQUEST + HTTP_HOST, "host"),
    ):
        out = out.unionByName(row(df, pattern, kind))
    pair = lambda p: F.arrays_zip(_all("code", p).alias("a"), _all("code", p, 2).alias("b"))
    hosts = jvm.select(*KEY, F.posexplode(pair(HOST_FIELD)).alias("at", "x")).select(*KEY, F.col("x.a").alias("field"), F.lit("host").alias("kind"), F.col("x.b").alias("value"), "at")
    settings = jvm.select(*KEY, F.posexplode(pair(VALUE_FIELD)).alias("at", "x")).select(*KEY, F.regexp_extract("x.b", r"String\s+(\w+)", 1).alias("field"), F.lit("property").alias("kind"), F.col("x.a").alias("value"), "at")
    # a literal host comes before a setting
    fields = hosts.withColumn("first", F.lit(1)).unionByName(settings.where("field <> ''").withColumn("first", F.lit(0)))
    fields = fields.groupBy(*KEY, "field").agg(F.max_by(F.struct("kind", "value"), F.struct("first", "at")).alias("v")).select(*KEY, "field", "v.kind", "v.value")
    used = jvm.select(*KEY, F.explode(F.array_distinct(_all("code", JVM_CLIENT + r"(\w+)\s*\+"))).alias("field"))
    return out.unionByName(used.join(fields, [*KEY, "field"]).select(*KEY, "kind", "value")).distinct()
