"""Where graphs and facts are kept, how reports are written, and how changed folders are followed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.storage import materialise

from .files import MAX_BYTES, eligible, language_of

#: Buckets of a store by the hash of its key.
BUCKETS = 64


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges by graph; graphs that are there already are replaced, all others stay."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, graph_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; of one graph only its partition is read."""
    both = (spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges"))
    n, e = (df if graph_id is None else df.where(F.col("graph_id") == graph_id) for df in both)
    return n, e


def encode(facts: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``json``: all other columns as one JSON text, nulls kept."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def decode(stored: DataFrame, schema: str, *keys: str) -> DataFrame:
    return stored.select(*keys, F.from_json("json", schema).alias("facts")).select(*keys, "facts.*")


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with the rows of ``fresh`` whose (project_id, file_path, content_hash, analyzer_version) it lacks."""
    key = ["project_id", "file_path", "content_hash", "analyzer_version"]
    return cache.unionByName(fresh.dropDuplicates(key).join(cache.select(*key), key, "left_anti").select(*cache.columns))


def markdown(warnings: DataFrame) -> DataFrame:
    """graph_id, report: a graph's warnings by type, each type with its number."""
    lines = warnings.groupBy("graph_id", "type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "message"))), "\n").alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("type", "n", "text"))), lambda p: F.concat(F.lit("## "), p["type"], F.lit(" ("), p["n"].cast("string"), F.lit(")\n"), p["text"]))
    return lines.groupBy("graph_id").agg(F.array_join(parts, "\n\n").alias("report"))


def _read(spark: SparkSession, folder: str, schema) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(folder) if there else spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("bucket")


def change_store(spark: SparkSession, folder: str, key: list[str], touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrites the buckets of a store that hold the keys of ``touched``: ``change`` gets all their rows and returns what is to stand there.

    The new rows are written aside first, so that a lost executor never leaves half a bucket; all other buckets stay as they are.
    """
    now = _read(spark, folder, touched.schema)
    buckets = materialise(touched.select(_bucket(key).alias("bucket")).distinct())
    rows = change(now.join(buckets, "bucket", "left_semi").drop("bucket"))
    rows = materialise(rows.withColumn("bucket", _bucket(key)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    gone = buckets.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect()  # BUCKETS rows at most
    for r in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={r['bucket']}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_store(spark: SparkSession, folder: str, fresh: DataFrame, key: list[str], replace: bool = False) -> None:
    """Adds the rows of ``fresh`` whose key the store lacks; with ``replace`` those of keys that it has take their place."""
    fresh = materialise(fresh.dropDuplicates(key))

    def merged(rows: DataFrame) -> DataFrame:
        keep, add = (rows.join(fresh.select(*key), key, "left_anti"), fresh) if replace else (rows, fresh.join(rows.select(*key), key, "left_anti"))
        return keep.unionByName(add)

    change_store(spark, folder, key, fresh, merged)


def expire_store(spark: SparkSession, folder: str, key: list[str], expired: Column) -> None:
    """Drops the rows for which ``expired`` holds, e.g. a time before a project's own limit; only their buckets are rewritten."""
    change_store(spark, folder, key, read_store(spark, folder).where(expired), lambda rows: rows.where(~F.coalesce(expired, F.lit(False))))


def take_slot(spark: SparkSession, folder: str, key: list[str], taken: DataFrame, flag: str) -> None:
    """Sets ``flag`` on the rows that ``taken`` (key and other columns, none of them ``flag``) matches, and clears it on all others of their key: one holder a slot."""
    taken = materialise(taken.distinct())

    def moved(rows: DataFrame) -> DataFrame:
        names = rows.columns
        held = rows.join(taken.withColumn("taken_", F.lit(True)), taken.columns, "left").join(taken.select(*key).distinct().withColumn("asked_", F.lit(True)), key, "left")
        new = F.when(F.col("asked_"), F.coalesce("taken_", F.lit(False))).otherwise(F.col(flag))
        return held.withColumn(flag, new).select(*names)

    change_store(spark, folder, key, taken, moved)


def mark_all(spark: SparkSession, folder: str, key: list[str], owners: DataFrame, flag: str) -> None:
    """Sets ``flag`` on every row of ``owners`` (key), e.g. all notifications of a user as read."""
    owners = materialise(owners.select(*key).distinct())

    def marked(rows: DataFrame) -> DataFrame:
        names = rows.columns
        return rows.join(owners.withColumn("asked_", F.lit(True)), key, "left").withColumn(flag, F.col(flag) | F.coalesce("asked_", F.lit(False))).select(*names)

    change_store(spark, folder, key, owners, marked)


def cache_state(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Adds state to files (project_id, file_path, content_hash): ``hit`` where the cache has the file's hash under this analyzer's version, else ``miss``."""
    key = ["project_id", "file_path", "content_hash"]
    known = cache.where(F.col("analyzer_version") == version).select(*key).distinct().withColumn("known", F.lit(True))
    return files.join(known, key, "left").select(*files.columns, F.when(F.col("known"), "hit").otherwise("miss").alias("state"))


def folder_changes(spark: SparkSession, root: str, manifest: DataFrame | None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file_path, status (added, changed or deleted), language, n_bytes, modified, sha256, content: how a folder differs from its manifest.

    manifest: file_path, n_bytes, modified, sha256; None: nothing is known. Only files whose size or time differs are read, and only those whose
    hash differs too are changed.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    path = F.substring_index("path", root.split(":", 1)[-1].strip("/") + "/", -1)
    listed = raw.select(path.alias("file_path"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified")).where(eligible(F.col("file_path")))
    if manifest is None:
        manifest = listed.limit(0).withColumn("sha256", F.lit(None).cast("string"))
    known = manifest.select("file_path", F.col("n_bytes").alias("old_bytes"), F.col("modified").alias("old_modified"), F.col("sha256").alias("old_sha256"))
    both = materialise(listed.join(known, "file_path", "full"))
    suspects = both.where("n_bytes IS NOT NULL AND NOT (n_bytes <=> old_bytes AND modified <=> old_modified)")
    oldest = suspects.agg(F.min("modified")).first()[0]
    # the scan's own filter on the time keeps it from opening older files
    texts = raw.where(F.col("modificationTime") >= F.lit(oldest)).select(path.alias("file_path"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))
    read = suspects.join(texts, "file_path").where("NOT (sha256 <=> old_sha256)")
    status = F.when(F.col("old_bytes").isNull(), "added").otherwise("changed")
    new = read.select("file_path", status.alias("status"), language_of(F.col("file_path")).alias("language"), "n_bytes", "modified", "sha256", "content")
    none = F.lit(None)
    gone = both.where("n_bytes IS NULL").select("file_path", F.lit("deleted").alias("status"), language_of(F.col("file_path")).alias("language"), none.cast("long").alias("n_bytes"), none.cast("timestamp").alias("modified"), none.cast("string").alias("sha256"), none.cast("string").alias("content"))
    return new.unionByName(gone)


def poll(spark: SparkSession, root: str, state: str, on_changes: Callable[[DataFrame], None], max_bytes: int = MAX_BYTES) -> int:
    """Compares a folder with the manifest kept in ``state``, gives ``on_changes`` what differs, and returns the number of files that do.

    The manifest is replaced after ``on_changes`` has returned, as a new version beside the old one: if it fails, the next poll gives the same changes again.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(x.getPath().getName()[1:]) for x in (system.listStatus(folder) if system.exists(folder) else []) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    version = max(done, default=-1)
    manifest = spark.read.parquet(f"{state}/v{version}") if done else None
    changes = materialise(folder_changes(spark, root, manifest, max_bytes))
    n = changes.count()
    if n:
        on_changes(changes)
        fields = ["file_path", "n_bytes", "modified", "sha256"]
        rows = changes.where("status <> 'deleted'").select(*fields)
        rows = rows if manifest is None else manifest.join(changes.select("file_path"), "file_path", "left_anti").select(*fields).unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{state}/v{version + 1}")
        for old in done:
            if old < version:  # the last two are kept
                system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/v{old}"), True)
    return n


def follow(spark: SparkSession, root: str, state: str, on_changes: Callable[[DataFrame], None], every: str = "1 minute", max_bytes: int = MAX_BYTES):
    """Polls a folder at each trigger of a stream, until that is stopped: new, changed and deleted files."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: poll(spark, root, state, on_changes, max_bytes) and None).trigger(processingTime=every).start()


def watch(spark: SparkSession, root: str, checkpoint: str, on_files: Callable[[DataFrame, int], None], max_bytes: int = MAX_BYTES):
    """Follows a folder: ``on_files`` gets each batch of new files (file_path, language, content). See ``follow`` for files that change or go."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    inner = root.split(":", 1)[-1].strip("/") + "/"
    rel = raw.withColumn("file_path", F.substring_index("path", inner, -1)).where(eligible(F.col("file_path")))
    files = rel.select("file_path", language_of(F.col("file_path")).alias("language"), F.decode("content", "UTF-8").alias("content"))
    return files.writeStream.foreachBatch(on_files).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
