"""Queries of event logs (section 2.16) and generic relational forms that the engine relies on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import sessions as st
from .registry import query, read


def events(spark, sf_dir):
    return read(spark, sf_dir, "events")


_NEXT = "lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("A8_screen_time", f"SELECT event_type, CAST(coalesce(sum(least(epoch(date_trunc('second', nx))::BIGINT - epoch(date_trunc('second', ts))::BIGINT, 1800)), 0) AS BIGINT) AS seconds, count(*) AS n FROM (SELECT *, {_NEXT} AS nx FROM events) GROUP BY event_type")
def screens(spark, sf_dir):
    return st.screen_time(events(spark, sf_dir))


@query("A8_segments", "SELECT user_id, CAST(max(k) AS BIGINT) AS segments, count(*) FILTER (k = 0) AS before FROM (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id")
def segs(spark, sf_dir):
    s = st.segments(events(spark, sf_dir), F.col("event_type") == "purchase")
    return s.groupBy("user_id").agg(F.max("segment").alias("segments"), F.count_if(F.col("segment") == 0).alias("before"))


@query("A8_gap_median", f"WITH g AS (SELECT user_id, epoch(date_trunc('second', {_NEXT}))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS g FROM events), l AS (SELECT user_id, list_sort(list(g)) AS l FROM g WHERE g IS NOT NULL GROUP BY user_id) SELECT user_id, CAST(l[len(l) // 2 + 1] AS BIGINT) AS median, CAST(l[-1] AS BIGINT) AS longest FROM l")
def gaps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = events(spark, sf_dir).select("user_id", (F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")).alias("g")).where("g is not null")
    return g.groupBy("user_id").agg(st.upper_median(F.col("g")).alias("median"), F.max("g").alias("longest"))


@query("A8_tally", "SELECT coalesce(event_type, 'none') AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def tally(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.coalesce("event_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("A8_transitions", f"SELECT event_type AS a, nx AS b, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NOT NULL GROUP BY ALL")
def transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("A8_ring", "SELECT user_id, count(*) AS n, min(event_id) AS oldest FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY user_id")
def ring(spark, sf_dir):
    return st.ring(events(spark, sf_dir), 20).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


@query("X_windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark, sf_dir):
    return st.windowed(events(spark, sf_dir)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("X_sessions", "WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf_dir):
    return st.sessions(events(spark, sf_dir)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("X_asof_screen", "SELECT event_id, (SELECT e.event_id FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'view' AND (e.ts, e.event_id) < (p.ts, p.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS screen FROM events p WHERE event_type = 'click'")
def asof(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, sf_dir).withColumn("screen", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("event_type = 'click'").select("event_id", "screen")
