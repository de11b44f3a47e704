"""Error patterns: daily rollup, trends and the pattern master."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import error_fingerprint
from ..functions.times import hour
from .events import is_error
from .ordered import share_of_total


def with_fingerprint(events: DataFrame, normalise: str = "literal") -> DataFrame:
    """Error events with fingerprint and defaulted type and message."""
    mark = error_fingerprint(
        F.col("agent_id"), F.col("event_type"), F.col("error_type"), F.col("error_message"), normalise
    )
    return events.filter(is_error()).select(
        "event_id", "trace_id", "agent_id", "event_type", "model", "ts",
        mark.alias("error_fingerprint"),
        F.coalesce("error_type", F.lit("Unknown")).alias("error_type"),
        F.coalesce("error_message", F.lit("No message")).alias("error_message"),
        F.to_date("ts").alias("date"),
    )


def error_patterns(events: DataFrame, normalise: str = "literal") -> DataFrame:
    """One row per day and pattern, with its share of all events of that day.

    Traces are counted, never collected.  The sample is the earliest message.
    """
    keys = ["date", "error_fingerprint", "agent_id", "event_type", "error_type"]
    patterns = with_fingerprint(events, normalise).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min_by("error_message", F.struct("ts", "event_id")).alias("sample_error_message"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count_distinct("trace_id").alias("affected_trace_count"),
        F.concat_ws(",", F.array_sort(F.collect_set("model"))).alias("affected_models_list"),
    )
    return with_error_share(patterns, events).withColumn("resolution_status", F.lit("unresolved"))


def with_error_share(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """Adds the percentage of all events of the day."""
    totals = events.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("total_events"))
    share = F.try_divide(F.col("occurrence_count").cast("double"), F.col("total_events")) * 100
    return patterns.join(totals, "date", "left").withColumn("frequency_percentage", share).drop("total_events")


def error_trends_hourly(events: DataFrame) -> DataFrame:
    return with_fingerprint(events).groupBy(hour(F.col("ts")).alias("hour"), "error_type").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.count_distinct("agent_id").alias("affected_agents"),
        F.count_distinct("trace_id").alias("affected_traces"),
    )


def top_errors(events: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent error types with their share of all errors and the agents hit."""
    rows = events.filter(is_error()).groupBy(F.coalesce("error_type", F.lit("Unknown")).alias("error_type")).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("agent_id").alias("affected_agents")
    )
    return share_of_total(rows, "count").orderBy(F.desc("count"), "error_type").limit(n)


_MASTER = [
    "error_fingerprint", "agent_id", "event_type", "error_type", "sample_error_message",
    "occurrence_count", "first_occurrence", "last_occurrence", "resolution_status",
]


def _as_master(daily: DataFrame) -> DataFrame:
    """Daily patterns folded to one row per fingerprint, in the master's columns."""
    order = F.struct("first_seen", "sample_error_message")
    return daily.groupBy("error_fingerprint").agg(
        F.min_by(F.struct("agent_id", "event_type", "error_type", "sample_error_message"), order).alias("d"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_seen").alias("first_occurrence"),
        F.max("last_seen").alias("last_occurrence"),
    ).select(
        "error_fingerprint", "d.*", "occurrence_count", "first_occurrence", "last_occurrence",
        F.lit("unresolved").alias("resolution_status"),
    ).select(*_MASTER)


def new_patterns(daily: DataFrame, master: DataFrame) -> DataFrame:
    """Patterns not yet in the master, as master rows."""
    return _as_master(daily).join(master.select("error_fingerprint"), "error_fingerprint", "left_anti")


def existing_pattern_updates(daily: DataFrame, master: DataFrame) -> DataFrame:
    """Known patterns with their new total and last occurrence."""
    seen = _as_master(daily).select("error_fingerprint", "occurrence_count", "last_occurrence")
    known = master.select("error_fingerprint", F.col("occurrence_count").alias("existing_count"))
    return seen.join(known, "error_fingerprint").select(
        "error_fingerprint",
        (F.col("occurrence_count") + F.col("existing_count")).alias("total_count"),
        "last_occurrence",
    )


def merge_patterns(daily: DataFrame, master: DataFrame) -> DataFrame:
    """The master after adding a day: counts added, the time span widened, resolution kept.

    Folding the union keeps it to one grouped shuffle and lets partial
    aggregation absorb a dominant fingerprint.
    """
    both = _as_master(daily).withColumn("known", F.lit(0)).unionByName(
        master.select(*_MASTER).withColumn("known", F.lit(1))
    )
    pick = F.struct((1 - F.col("known")).alias("fresh"), "first_occurrence", "sample_error_message")
    return both.groupBy("error_fingerprint").agg(
        F.min_by(
            F.struct("agent_id", "event_type", "error_type", "sample_error_message", "resolution_status"), pick
        ).alias("d"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first_occurrence").alias("first_occurrence"),
        F.max("last_occurrence").alias("last_occurrence"),
    ).select("error_fingerprint", "d.*", "occurrence_count", "first_occurrence", "last_occurrence").select(*_MASTER)


def rebuild_master(daily: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The master derived from all daily partitions, so rerunning a day never counts twice.

    ``resolutions`` (error_fingerprint, resolution_status) holds the manual part.
    """
    fresh = _as_master(daily).drop("resolution_status")
    marks = resolutions.select("error_fingerprint", "resolution_status")
    return fresh.join(marks, "error_fingerprint", "left").withColumn(
        "resolution_status", F.coalesce("resolution_status", F.lit("unresolved"))
    ).select(*_MASTER)
