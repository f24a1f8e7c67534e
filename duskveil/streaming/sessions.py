"""Event logs: screens, segments, gaps, and the same measures on streams.

The reference's logs are batches; windows, sessions and the ring of latest events on streams are extensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def screen_time(events: DataFrame, by: str = "user_id", most: int = 1800) -> DataFrame:
    """(event_type, seconds, n): time from each event to the next of its user, at most ``most`` seconds a step."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    return events.withColumn("gap", F.least(gap, F.lit(most))).groupBy("event_type").agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("seconds"), F.count("*").alias("n"))


def segments(events: DataFrame, opens: Column, by: str = "user_id") -> DataFrame:
    """events with segment, the number of opening events so far of the user."""
    w = Window.partitionBy(by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("segment", F.sum(opens.cast("int")).over(w))


def upper_median(c: Column) -> Column:
    """The upper of the two middle values, as an aggregate: position n div 2 of the sorted values."""
    return F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, for batches and streams alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events without a longer gap between them."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ring(events: DataFrame, keep: int = 2000, by: str = "user_id") -> DataFrame:
    """The latest ``keep`` events of each user."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def redact_stream(docs: DataFrame) -> DataFrame:
    """Arriving documents(doc_id, text) redacted one by one: the chain is a projection, so it streams as it is."""
    from ..functions import spans
    from ..operators import detect, substitute as su

    kept = spans.resolve(F.filter(detect.hits(F.col("text"), detect.NEUTRAL), lambda h: h["ok"]))
    return docs.select("doc_id", su.labelled(F.col("text"), su.ordinals(su.keyed(kept))).alias("redacted"))
