"""Newest rows, retention, upserts, anomalies, feeds and threads over operational tables.

Limits for each key are windows that Spark cuts before the shuffle; limits over all rows are an ordered limit, never a window
over one partition of everything. Ties are broken by the orders that callers give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Versions kept of a project, rows and share of failures of an anomaly (percent), least base and change of a daily anomaly (percent).
KEPT, LEAST_RUNS, FAILED_PERCENT, LEAST_BASE, CHANGE_PERCENT = 3, 5, 20, 10, 50


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key, with their place from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def expired(versions: DataFrame, references: DataFrame, key: str, by: list[str], order: list[Column], keep: int = KEPT) -> DataFrame:
    """Versions neither ``pinned`` nor referenced that come after the newest ``keep`` such of their key."""
    loose = versions.where("NOT pinned").join(references.select(key), key, "left_anti")
    return loose.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") > keep).drop("rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key, the new one where there is one. Rows of one key and table are ordered by their values, the largest stays."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, F.struct(F.lit(0).alias("at"), *rest).alias("v")).unionByName(new.select(*key, F.struct(F.lit(1).alias("at"), *rest).alias("v")))
    return both.groupBy(*key).agg(F.max("v").alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in rest))


def failure_anomalies(runs: DataFrame, by: str, failed: Column, least: int = LEAST_RUNS, percent: int = FAILED_PERCENT) -> DataFrame:
    """by, n, failed of keys with enough runs and that share of failures or more."""
    n = runs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return n.where((F.col("n") >= least) & (F.col("failed") * 100 >= F.col("n") * percent))


def daily_changes(days: DataFrame, by: list[str], base: int = LEAST_BASE, percent: int = CHANGE_PERCENT) -> DataFrame:
    """Days (by, day, n) with the day before them, prev, where that is there and large enough and the change is too; day: a date or a number."""
    at = F.unix_date("day") if days.schema["day"].dataType.typeName() == "date" else F.col("day").cast("long")
    seen = days.withColumn("prev", F.max("n").over(Window.partitionBy(*by).orderBy(at).rangeBetween(-1, -1)))
    return seen.where((F.col("prev") >= base) & (F.abs(F.col("n") - F.col("prev")) * 100 >= percent * F.col("prev")))


def feed_by_count(posts: DataFrame, marks: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The posts with the most marks (key, one row a mark), n (0 without any) and their place rn; ``order`` breaks ties."""
    n = marks.groupBy(key).agg(F.count("*").alias("n"))
    best = posts.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = [F.col("n").desc(), *order]
    return best.orderBy(*first).limit(top).withColumn("rn", F.row_number().over(Window.orderBy(*first)))


def threads(messages: DataFrame) -> DataFrame:
    """one, two, message, sender, pos: what each two users wrote to each other (message, sender, receiver, at), newest first. Messages to oneself are left out."""
    pair = messages.where("sender <> receiver").select(F.least("sender", "receiver").alias("one"), F.greatest("sender", "receiver").alias("two"), "message", "sender", "at")
    return pair.withColumn("pos", F.row_number().over(Window.partitionBy("one", "two").orderBy(F.col("at").desc(), "message"))).drop("at")
