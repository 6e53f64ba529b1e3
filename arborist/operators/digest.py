"""Daily metrics of a platform over whole tables, and what stands out in them.

Days are those of a time zone. Each source is added up by day before anything is joined, so what meets is a row a day and source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
#: Runs from which a failure rate counts, its limit; least base and change of a day (percent); open requests, bytes and limited requests that stand out.
LEAST_RUNS, FAILED_PERCENT, LEAST_BASE, CHANGE_PERCENT, BACKLOG, BYTES, TRIPS = 5, 20, 10, 50, 10, 400 << 20, 20
METRICS = ["new_users", "active_users", "new_projects", "analyses", "failed_analyses", "payments", "amount", "new_feedback"]
MB = 1 << 20


def day_of(rows: DataFrame, time: str, zone: str = ZONE) -> Column:
    """The day in ``zone`` of an instant, whatever the session's zone; times without a zone are UTC."""
    plain = rows.schema[time].dataType.typeName() == "timestamp_ntz"
    return F.to_date(F.convert_timezone(F.lit("UTC") if plain else F.current_timezone(), F.lit(zone), F.col(time).cast("timestamp_ntz")))


def daily_metrics(users: DataFrame, projects: DataFrame, analyses: DataFrame, payments: DataFrame, feedback: DataFrame, zone: str = ZONE) -> DataFrame:
    """day and METRICS, a row for each day of which any source has something; 0 where it has nothing.

    users: created_at, last_active_at (a user is active on the day of the last activity only); projects, feedback: created_at; analyses: created_at,
    status (FAILED ones count twice); payments: confirmed_at, status, amount, of which CONFIRMED ones count. Rows without a time are left out.
    """

    def part(rows: DataFrame, time: str, **sums: Column) -> DataFrame:
        return rows.where(F.col(time).isNotNull()).groupBy(day_of(rows, time, zone).alias("day")).agg(*[v.alias(k) for k, v in sums.items()])

    n = F.count(F.lit(1))
    parts = [
        part(users, "created_at", new_users=n), part(users, "last_active_at", active_users=n), part(projects, "created_at", new_projects=n),
        part(analyses, "created_at", analyses=n, failed_analyses=F.count_if(F.col("status") == "FAILED")),
        part(payments.where("status = 'CONFIRMED'"), "confirmed_at", payments=n, amount=F.sum("amount")), part(feedback, "created_at", new_feedback=n),
    ]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return all_.groupBy("day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in METRICS])


def latest_two(days: DataFrame) -> DataFrame:
    """The newest day and the one before it among those stored, rn 1 and 2; one row a day is expected."""
    return days.orderBy(F.col("day").desc()).limit(2).withColumn("rn", F.row_number().over(Window.orderBy(F.col("day").desc())))


def largest(tables: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest tables (name, bytes), with their place; ties by name."""
    order = [F.col("bytes").desc(), F.col("name")]
    return tables.orderBy(*order).limit(n).withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def anomalies(metrics: DataFrame, gauges: DataFrame, trips: DataFrame) -> DataFrame:
    """day, pos, kind, subject, value, base: what stands out on each day, in the order of a digest.

    metrics: see ``daily_metrics``; gauges: day, open_requests, bytes; trips: day, category, n (several rows of a category are added up).
    Kinds: FAILURE_RATE (percent of that many runs), DAY_CHANGE of active_users, then of analyses (percent against the calendar day before, which must
    be there and large enough), BACKLOG, SIZE (MiB), TRIPS by category. Percentages and MiB are rounded half up.
    """
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    at = lambda rank, kind, subject, value, base=None: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(subject).alias("subject"), value.cast("long").alias("value"), (F.lit(None) if base is None else base).cast("long").alias("base"))
    before = metrics.select(F.date_add("day", 1).alias("day"), *[F.col(c).alias(f"{c}_before") for c in ("active_users", "analyses")])
    m = metrics.join(before, "day", "left").join(gauges.select("day", "open_requests", "bytes"), "day", "full")
    failed = F.when((F.col("analyses") >= LEAST_RUNS) & (F.col("failed_analyses") * 100 >= F.col("analyses") * FAILED_PERCENT), at(0, "FAILURE_RATE", "analyses", half_up(F.col("failed_analyses") * 100 / F.col("analyses")), F.col("analyses")))

    def changed(rank: int, c: str) -> Column:
        was, diff = F.col(f"{c}_before"), F.col(c) - F.col(f"{c}_before")
        return F.when((was >= LEAST_BASE) & (F.abs(diff) * 100 >= was * CHANGE_PERCENT), at(rank, "DAY_CHANGE", c, half_up(diff * 100 / was), was))

    backlog = F.when(F.col("open_requests") >= BACKLOG, at(3, "BACKLOG", "requests", F.col("open_requests")))
    size = F.when(F.col("bytes") >= BYTES, at(4, "SIZE", "database", half_up(F.col("bytes") / MB)))
    found = F.filter(F.array(failed, changed(1, "active_users"), changed(2, "analyses"), backlog, size), lambda x: x.isNotNull())
    of_day = m.select("day", F.explode(found).alias("a")).select("day", "a.*")
    tripped = trips.groupBy("day", "category").agg(F.sum("n").alias("value")).where(F.col("value") >= TRIPS)
    tripped = tripped.select("day", F.lit(5).alias("rank"), F.lit("TRIPS").alias("kind"), F.col("category").alias("subject"), F.col("value").cast("long").alias("value"), F.lit(None).cast("long").alias("base"))
    # a day has few rows, so each window is small
    pos = F.row_number().over(Window.partitionBy("day").orderBy("rank", "subject"))
    return of_day.unionByName(tripped).withColumn("pos", pos).select("day", "pos", "kind", "subject", "value", "base")
