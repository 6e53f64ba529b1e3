"""Counts and limits of requests, messages and connections, on streams; windowed counts and notifications on batches as well."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trips(rejected: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """start, category, n: rejected requests by window of time; later than ``late`` they are left out on streams."""
    return rejected.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "category", "n")


# Requests that are limited: method, path, category, requests, minutes. The first that fits counts.
REQUEST_RULES = [
    ("POST", "/api/analyses", "analysis", 1, 3), ("POST", "/api/attachments/presign", "attach", 20, 1), ("POST", "/api/community/posts", "post-create", 5, 1),
    ("POST", "/api/community/posts/*/like", "post-like", 60, 1), ("POST", "/api/graphs/*/nodes/*/comments", "comment-create", 20, 1), ("POST", "/api/feedback", "feedback", 5, 1),
    ("POST", "/api/reports", "report", 5, 1), ("POST", "/api/messages/*", "message-send", 30, 1), ("POST", "/api/users/*/follow", "follow", 30, 1), ("POST", "/api/push/subscribe", "push-subscribe", 10, 1),
    ("POST", "/api/cron/refresh-featured", "cron-refresh", 2, 60), ("POST", "/api/cron/daily-digest", "cron-digest", 5, 60), ("POST", "/api/projects/*/warnings/report-fp", "report-fp", 10, 1),
    ("POST", "/api/community/posts/*/comments", "post-comment-create", 20, 1), ("POST", "/api/payments/toss/prepare", "payment-prepare", 5, 1), ("POST", "/api/teams/payment/prepare", "payment-prepare", 5, 1),
    ("POST", "/api/teams/*/seats/payment/prepare", "payment-prepare", 5, 1), ("POST", "/api/webhooks/github", "webhook-github", 60, 1), ("POST", "/api/admin/digest/run", "admin-digest-run", 5, 60),
    ("GET", "/api/projects/*/graph", "graph-read", 30, 1), ("GET", "/api/share/*/graph", "graph-read-public", 20, 1), ("GET", "/api/projects/*/graph/context-md", "graph-context-md", 20, 1),
    ("GET", "/api/projects/*/diff", "graph-diff", 20, 1), ("PUT", "/api/users/me/ai-key", "ai-key-write", 10, 1), ("DELETE", "/api/users/me/ai-key/*", "ai-key-write", 10, 1), ("PUT", "/api/users/me/ai-key/priority", "ai-key-write", 10, 1),
]


def routed(requests: DataFrame) -> DataFrame:
    """Adds key, category, limit and window_s to requests (method, path, forwarded, remote); requests that no rule fits are left out.

    A ``*`` stands for one part of a path. The key is the address and the category; the address is the last of ``forwarded``, which the nearest proxy adds, else ``remote``.
    """
    fits = lambda m, p: (F.col("method") == m) & F.col("path").rlike("^" + p.replace("*", "[^/]+") + "$")
    rule = lambda *v: F.struct(F.lit(v[0]).alias("category"), F.lit(v[1]).alias("limit"), F.lit(60.0 * v[2]).alias("window_s"))
    found = F.coalesce(*[F.when(fits(m, p), rule(*rest)) for m, p, *rest in REQUEST_RULES])
    last = F.trim(F.element_at(F.split("forwarded", ","), -1))
    address = F.when(F.trim(F.coalesce("forwarded", F.lit(""))) != "", last).otherwise(F.col("remote"))
    out = requests.withColumn("rule", found).where("rule IS NOT NULL")
    return out.withColumns({"category": F.col("rule.category"), "limit": F.col("rule.limit"), "window_s": F.col("rule.window_s"), "key": F.concat_ws(":", address, "rule.category")}).drop("rule")


def _with_limits(requests: DataFrame, limit: int | None, window_s: float | None) -> DataFrame:
    """key, event_id, ts, limit, window_s; limits that are not given are the requests' own."""
    own = [F.col("limit") if limit is None else F.lit(limit).alias("limit"), F.col("window_s") if window_s is None else F.lit(float(window_s)).alias("window_s")]
    return requests.select("key", "event_id", "ts", *own)


def rate_limit(requests: DataFrame, limit: int | None = None, window_s: float | None = None, forget_s: float = 600.0, late: str = "10 minutes") -> DataFrame:
    """key, event_id, allowed of requests (key, event_id, ts, and limit and window_s where they are not given), as a stream.

    A key has ``limit`` tokens, all given back at once each ``window_s`` after its first request; a key that is idle for longer than
    ``forget_s`` starts anew. A request that comes late is counted in the window of its own time. The state holds the counts of the windows that the
    watermark hasn't passed, and goes when that is ``forget_s`` past the last request.
    """

    def decide(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # runs of requests without a longer pause: first and last time, and the tokens used by window
        runs = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t, most, width in zip(rows["ts"].map(pd.Timestamp.timestamp), rows["limit"].tolist(), rows["window_s"].tolist()):
            run = next((r for r in reversed(runs) if r[0] <= t), runs[0] if runs and runs[0][0] - t <= forget_s else None)
            if run is None or t - run[1] > forget_s:
                run = [t, t, {}]
                runs.append(run)
                runs.sort(key=lambda r: r[0])
            window = str(math.floor((t - run[0]) / width))
            used = run[2].get(window, 0)
            allowed.append(used < most)
            run[2][window] = used + allowed[-1]
            run[1] = max(run[1], t)
        mark, width = state.getCurrentWatermarkMs() / 1000, max(rows["window_s"])
        for run in runs:
            run[2] = {w: n for w, n in run[2].items() if run[0] + (int(w) + 1) * width > mark}
        runs = [r for r in runs[:-1] if r[2] or r[1] + forget_s > mark] + runs[-1:]
        state.update((json.dumps(runs),))
        state.setTimeoutTimestamp(max(int((runs[-1][1] + forget_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    fields = requests.select("key", "event_id").schema
    output = f"key {fields['key'].dataType.simpleString()}, event_id {fields['event_id'].dataType.simpleString()}, allowed boolean"
    return _with_limits(requests, limit, window_s).withWatermark("ts", late).groupBy("key").applyInPandasWithState(decide, output, "runs string", "append", "EventTimeTimeout")


def rate_limit_batch(requests: DataFrame, limit: int | None = None, window_s: float | None = None, forget_s: float = 600.0) -> DataFrame:
    """key, event_id, allowed of requests that are all there, by windows over each key; whole seconds count."""
    order = Window.partitionBy("key").orderBy("t", "event_id")
    t = _with_limits(requests, limit, window_s).withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    t = t.withColumn("fresh", F.when(F.col("t") - F.lag("t").over(order) <= forget_s, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    t = t.withColumn("window", F.floor((F.col("t") - F.min("t").over(Window.partitionBy("key", "run"))) / F.col("window_s")))
    nth = F.row_number().over(Window.partitionBy("key", "run", "window").orderBy("t", "event_id"))
    return t.withColumn("nth", nth).select("key", "event_id", (F.col("nth") <= F.col("limit")).alias("allowed"))


def send_guard(messages: DataFrame, limit: int = 40) -> DataFrame:
    """key, event_id, allowed: at most ``limit`` messages a second of one session."""
    return rate_limit(messages, limit, 1.0)


def connections(events: DataFrame, limit: int = 30, late: str = "10 minutes") -> DataFrame:
    """key, event_id, open_n, allowed of connection events (key, event_id, ts, action), as a stream: the open connections of a key, never
    below 0; a connect beyond ``limit`` is rejected and not counted."""

    def count(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, (n, allowed) in zip(rows["event_id"], _steps(rows["action"], n, limit)):
            out.append((key[0], event, n, allowed))
        state.update((n,))
        yield pd.DataFrame(out, columns=["key", "event_id", "open_n", "allowed"])

    fields = events.select("key", "event_id").schema
    output = f"key {fields['key'].dataType.simpleString()}, event_id {fields['event_id'].dataType.simpleString()}, open_n long, allowed boolean"
    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(count, output, "n long", "append", "NoTimeout")


def _steps(actions, n: int, limit: int) -> Iterator[tuple[int, bool]]:
    """The open connections after each action, from n on, and whether it was allowed."""
    for action in actions:
        allowed = action != "connect" or n < limit
        n = max(0, n - 1) if action == "disconnect" else n + 1 if action == "connect" and allowed else n
        yield n, allowed


def connections_batch(events: DataFrame, limit: int = 30, span: str = "1 hour") -> DataFrame:
    """key, event_id, open_n, allowed of connection events that are all there, as ``connections``.

    Each event is a function min(max(n + a, low), high) of the open connections, and such functions in a row are one of the same form. So the events of
    a key are cut into spans of time, each span becomes one function, the few functions of a key are run through in order, and then each span
    is counted from where it begins: a key of any size is many tasks.
    """
    cut = events.select("key", "event_id", "ts", "action").withColumn("span", F.unix_seconds(F.window(F.col("ts").cast("timestamp"), span)["start"]))
    kind = {f.name: f.dataType.simpleString() for f in cut.schema.fields}

    def function(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, low, high = 0, 0, limit
        for action in rows.sort_values(["ts", "event_id"])["action"]:
            step = {"connect": 1, "disconnect": -1}.get(action, 0)
            a, low, high = a + step, min(max(low + step, 0), limit), min(max(high + step, 0), limit)
        return pd.DataFrame([(key[0], key[1], a, low, high)], columns=["key", "span", "a", "low", "high"])

    def starts(key, rows: pd.DataFrame) -> pd.DataFrame:
        n, out = 0, []
        for span_, a, low, high in rows.sort_values("span")[["span", "a", "low", "high"]].itertuples(index=False):
            out.append((key[0], span_, n))
            n = min(max(n + a, low), high)
        return pd.DataFrame(out, columns=["key", "span", "first"])

    def counted(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        found = list(_steps(rows["action"], int(rows["first"].iloc[0]), limit))
        return pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "open_n": [n for n, _ in found], "allowed": [ok for _, ok in found]})

    functions = cut.groupBy("key", "span").applyInPandas(function, f"key {kind['key']}, span long, a long, low long, high long")
    first = functions.groupBy("key").applyInPandas(starts, f"key {kind['key']}, span long, first long")
    return cut.join(first, ["key", "span"]).groupBy("key", "span").applyInPandas(counted, f"key {kind['key']}, event_id {kind['event_id']}, open_n long, allowed boolean")


def fan_out(events: DataFrame, admins: DataFrame) -> DataFrame:
    """event_id, recipient, kind of notifications, on streams and batches alike.

    events: event_id, kind, actor, owner. Comments and likes of one's own are not told; a ``digest`` goes to every one of ``admins``
    (recipient), a table of a few people; all else to the owner.
    """
    told = events.where("kind <> 'digest' AND NOT (kind IN ('comment', 'like') AND actor <=> owner)").select("event_id", F.col("owner").alias("recipient"), "kind")
    digests = events.where("kind = 'digest'").withColumn("all", F.lit(1)).join(admins.select("recipient").withColumn("all", F.lit(1)), "all").select("event_id", "recipient", "kind")
    return told.unionByName(digests)


def daily_active(events: DataFrame) -> DataFrame:
    """day, n of events (ts, user_id) that are all there: how many users were last seen on each day."""
    last = events.where("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.groupBy(F.to_date("last").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def activity_changes(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, change of events (ts, user_id), as a stream: a user who is seen on a later day leaves the old one (-1) and counts on the new one (+1).

    The changes of a day add up to its users in ``daily_active``, exactly. The state is one day a user.
    """

    def move(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        new = max(int(b["day"].max()) for b in batches)
        if old is None or new > old:
            state.update((new,))
            yield pd.DataFrame([(new, 1)] + ([] if old is None else [(old, -1)]), columns=["day", "change"])

    days = events.where("user_id IS NOT NULL").withWatermark("ts", late).select("user_id", F.unix_date(F.to_date("ts")).alias("day"))
    moved = days.groupBy("user_id").applyInPandasWithState(move, "day int, change long", "day int", "append", "NoTimeout")
    return moved.select(F.date_from_unix_date("day").alias("day"), "change")
