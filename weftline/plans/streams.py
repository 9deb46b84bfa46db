"""Streaming queries; the SQL twins compute the same over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.base import Catalog, Tables
from weftline.sources import log_source
from weftline.sources.folders import shared_folder
from weftline.streaming import events as ev

QUERIES = Catalog()


def _stream(t: Tables, delay: str = "1 hour") -> DataFrame:
    return ev.event_stream(t.spark, t.sf_dir, delay)


@QUERIES.add("SELECT event_id, user_id, value * 2 AS twice FROM events WHERE event_type = 'click'")
def st_stateless(t: Tables) -> DataFrame:
    rows = _stream(t).where("event_type = 'click'").select("event_id", "user_id", (F.col("value") * 2).alias("twice"))
    return ev.run_appending(rows)


@QUERIES.add(
    """SELECT date_trunc('hour', ts) AS start_at, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_at, event_type, count(*) AS n,
    round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3"""
)
def st_tumbling(t: Tables) -> DataFrame:
    return ev.run_updating(ev.windowed(_stream(t), F.window("ts", "1 hour")))


@QUERIES.add(
    """SELECT start_at, start_at + INTERVAL 2 HOUR AS end_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM
    (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start_at FROM events) GROUP BY 1, 2, 3"""
)
def st_sliding(t: Tables) -> DataFrame:
    return ev.run_updating(ev.windowed(_stream(t), F.window("ts", "2 hours", "1 hour")))


@QUERIES.add(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    numbered AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM marked)
    SELECT min(ts) AS start_at, max(ts) + INTERVAL 20 MINUTE AS end_at, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM numbered GROUP BY event_type, g"""
)
def st_session(t: Tables) -> DataFrame:
    return ev.run_updating(ev.windowed(_stream(t), F.session_window("ts", "20 minutes")))


@QUERIES.add(
    """SELECT date_trunc('day', ts) AS start_at, date_trunc('day', ts) + INTERVAL 1 DAY AS end_at, event_type, count(*) AS n,
    round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def st_append_closed(t: Tables) -> DataFrame:
    """Append mode gives the windows that the watermark has passed."""
    return ev.run_appending(ev.windowed(_stream(t), F.window("ts", "1 day")))


@QUERIES.add("SELECT DISTINCT user_id, event_type FROM events")
def st_dedup(t: Tables) -> DataFrame:
    return ev.run_appending(_stream(t).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"))


@QUERIES.add("SELECT event_id FROM events")
def st_dedup_within_watermark(t: Tables) -> DataFrame:
    return ev.run_appending(_stream(t).dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


@QUERIES.add(
    """SELECT e.event_id, u.name FROM events e JOIN (SELECT c_custkey AS user_id, c_name AS name FROM customer) u USING (user_id)
    WHERE event_type = 'signup'"""
)
def st_static_join(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return ev.run_appending(_stream(t).where("event_type = 'signup'").join(users, "user_id").select("event_id", "name"))


@QUERIES.add(
    """SELECT a.event_id AS view_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id
    AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR"""
)
def st_stream_join(t: Tables) -> DataFrame:
    views = _stream(t).where("event_type = 'view'").select(F.col("user_id").alias("u1"), F.col("ts").alias("t1"), F.col("event_id").alias("view_id"))
    buys = _stream(t).where("event_type = 'purchase'").select(F.col("user_id").alias("u2"), F.col("ts").alias("t2"), F.col("event_id").alias("buy_id"))
    both = views.join(buys, F.expr("u1 = u2 AND t2 >= t1 AND t2 <= t1 + INTERVAL 2 HOURS"))
    return ev.run_appending(both.select("view_id", "buy_id"))


@QUERIES.add("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def st_keyed_state(t: Tables) -> DataFrame:
    totals = ev.run_updating(ev.running_totals(_stream(t)), "update")
    return totals.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("most", "n").alias("most"))


@QUERIES.add("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def st_sorted_complete(t: Tables) -> DataFrame:
    counts = _stream(t).groupBy("user_id").agg(F.count("*").alias("n"))
    return ev.run_updating(counts.orderBy(F.desc("n"), "user_id").limit(10))


def _in_batches(t: Tables, n: int = 4) -> list[DataFrame]:
    """The events in n parts by their number, which is their order in time."""
    most = t.events.agg(F.max("event_id")).first()[0] + 1
    return [t.events.where((F.col("event_id") * n >= k * most) & (F.col("event_id") * n < (k + 1) * most)) for k in range(n)]


@QUERIES.add(
    """SELECT date_trunc('hour', ts) AS start_at, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_at, event_type, count(*) AS n,
    round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3"""
)
def st_batches(t: Tables) -> DataFrame:
    """Windows whose state lives on from batch to batch."""
    return ev.run_updating(ev.windowed(ev.event_batches(t.spark, _in_batches(t)), F.window("ts", "1 hour")))


@QUERIES.add(
    """WITH held AS (SELECT * FROM events WHERE event_id * 4 >= (SELECT max(event_id) + 1 FROM events))
    SELECT date_trunc('day', ts) AS start_at, date_trunc('day', ts) + INTERVAL 1 DAY AS end_at, event_type, count(*) AS n,
    round(sum(value), 4) AS total FROM held GROUP BY 1, 2, 3
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def st_late_rows(t: Tables) -> DataFrame:
    """The first quarter of the events comes last, behind the watermark, and is dropped."""
    first, *others = _in_batches(t)
    return ev.run_appending(ev.windowed(ev.event_batches(t.spark, [*others, first]), F.window("ts", "1 day")))


@QUERIES.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st_memory_sink(t: Tables) -> DataFrame:
    counts = ev.event_batches(t.spark, _in_batches(t, 2)).groupBy("event_type").agg(F.count("*").alias("n"))
    return ev.run_to_memory(counts, "complete")


@QUERIES.add("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def st_state_processor(t: Tables) -> DataFrame:
    with ev.rocks_state(t.spark):
        totals = ev.run_updating(ev.transformed_totals(ev.event_batches(t.spark, _in_batches(t, 3))), "update")
    return totals.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("most", "n").alias("most"))


@QUERIES.add("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def st_state_table(t: Tables) -> DataFrame:
    """What a stateful processor holds at the end, read from its state store."""
    state = shared_folder(t.spark, "stream-state")
    with ev.rocks_state(t.spark):
        ev.run_updating(ev.transformed_totals(ev.event_batches(t.spark, _in_batches(t, 3))), "update", state)
        return ev.held_totals(ev.state_table(t.spark, state, "totals"))


@QUERIES.add(
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS s FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked),
    sessions AS (SELECT user_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n, min(event_id) AS first_id,
        count(*) FILTER (event_type = 'purchase') AS p FROM numbered GROUP BY user_id, session)
    SELECT user_id, start_at, end_at, n, first_id, (sum(p) OVER (PARTITION BY user_id ORDER BY start_at))::BIGINT AS bought
    FROM sessions WHERE end_at + INTERVAL 5 HOUR <= (SELECT max(ts) FROM events)"""
)
def st_timer_sessions(t: Tables) -> DataFrame:
    """Sessions that timers close, four hours after their last event and the watermark's hour."""
    with ev.rocks_state(t.spark):
        return ev.run_appending(ev.timed_sessions(ev.event_batches(t.spark, _in_batches(t)), 4 * 3600))


@QUERIES.add("SELECT event_id, event_type FROM events WHERE event_id >= 0")
def st_rate_join(t: Tables) -> DataFrame:
    """Numbers that come at a rate, joined to the events of these numbers."""
    rows = (t.events.agg(F.max("event_id")).first()[0] or 0) + 1
    numbers = ev.rated(t.spark, rows).withColumnRenamed("value", "event_id")
    return ev.run_appending(numbers.join(t.events.select("event_id", "event_type"), "event_id"))


@QUERIES.add("SELECT event_id, user_id, ts, value FROM events WHERE user_id % 3 = 1")
def st_python_source(t: Tables) -> DataFrame:
    """Commits of a Python source as a stream."""
    path = shared_folder(t.spark, "log")
    for k in range(3):
        log_source.write_log(t.events.where(F.col("event_id") % 3 == k), path)
    rows = log_source.stream_log(t.spark, path, t.events.schema)
    return ev.run_appending(rows.where("user_id % 3 = 1").select("event_id", "user_id", "ts", "value"))
