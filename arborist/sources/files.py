"""Source files as a table: scan, language, size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension and by name, folders that are left out, the largest file.
LANGUAGES = {
    "java": "Java", "kt": "Kotlin", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python",
    "go": "Go", "rs": "Rust", "cs": "C#", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "c": "C", "rb": "Ruby",
    "php": "PHP", "swift": "Swift", "prisma": "Prisma",
}
NAMED = {
    "docker-compose.yml": "DockerCompose", "docker-compose.yaml": "DockerCompose", "compose.yml": "DockerCompose", "compose.yaml": "DockerCompose",
    "application.yml": "SpringYaml", "application.yaml": "SpringYaml", "application.properties": "SpringYaml",
}
SKIPPED_FOLDERS = [".git", "node_modules", "vendor", "target", "build", "dist", ".gradle", "__pycache__", ".idea", ".vscode", "docsets"]
MAX_BYTES = 2 << 20


def language_of(path: Column) -> Column:
    """The language of a path by its file name, else by its extension; null if neither is known."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    lookup = lambda known: F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup(NAMED), name), F.try_element_at(lookup(LANGUAGES), extension))


def eligible(path: Column) -> Column:
    """Whether a path relative to its root is scanned: no folder that is left out, a known language, not minified."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    skipped = F.exists(folders, lambda f: f.isin(SKIPPED_FOLDERS) | f.endswith(".docset"))
    return ~skipped & language_of(path).isNotNull() & ~F.element_at(F.split(path, "/"), -1).contains(".min.")


def scan_sources(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file_path (relative to ``root``), language, n_bytes, sha256, content. Size is filtered before content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    inner = root.split(":", 1)[-1].strip("/") + "/"
    rel = raw.withColumn("file_path", F.substring_index("path", inner, -1)).where(eligible(F.col("file_path")))
    return rel.select("file_path", language_of(F.col("file_path")).alias("language"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))
