"""Anomaly detection over recent windows and over series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import severity_by_multiple
from ..functions.times import as_ts, in_last, period_delta
from .events import is_end_event
from .metrics import error_rate
from .ordered import blocked_frame, ordered_scan, top_per

ERROR_ITEM = "array<struct<error_type:string,error_message:string,timestamp:timestamp>>"


def _finding(kind: str, severity: Column, at: Column, metrics: dict[str, Column], errors: Column | None = None) -> list[Column]:
    cells = [x for name, value in metrics.items() for x in (F.lit(name), value.cast("double"))]
    recent = errors if errors is not None else F.array().cast(ERROR_ITEM)
    return [
        F.lit(kind).alias("anomaly_type"),
        "agent_id",
        severity.alias("severity"),
        at.alias("timestamp"),
        F.create_map(*cells).alias("metrics"),
        recent.alias("recent_errors"),
    ]


def error_burst_anomalies(errors: DataFrame, asof, threshold: int = 5, minutes: int = 5) -> DataFrame:
    """Agents with at least ``threshold`` errors in the window, with their first five errors."""
    recent = errors.filter(in_last(F.col("ts"), asof, period_delta(f"{minutes}m")))
    recent = recent.withColumn("agent_id", F.coalesce("agent_id", F.lit("unknown")))
    counts = recent.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    # The per-agent limit runs before the shuffle, so at most five rows per agent are collected.
    item = F.struct(
        "error_type",
        F.substring(F.coalesce("error_message", F.lit("")), 1, 200).alias("error_message"),
        F.col("ts").alias("timestamp"),
    )
    firsts = top_per(recent, ["agent_id"], [F.asc("ts"), F.asc("event_id")], 5, rank="r")
    firsts = firsts.groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("r", item.alias("e")))).alias("l"))
    rows = counts.join(firsts, "agent_id")
    metrics = {"error_count": F.col("n"), "threshold": F.lit(threshold), "window_minutes": F.lit(minutes)}
    return rows.select(
        *_finding("high_error_rate", severity_by_multiple(F.col("n"), threshold), as_ts(asof), metrics, F.col("l.e"))
    )


def latency_anomalies(points: DataFrame, asof, threshold_ms: float = 5000, minutes: int = 5) -> DataFrame:
    """Agents whose mean duration in the window exceeds the threshold; twice as much is critical."""
    recent = points.filter(
        (F.col("measure_name") == "duration_ms") & in_last(F.col("ts"), asof, period_delta(f"{minutes}m"))
    )
    v = "measure_value"
    stats = recent.groupBy("agent_id").agg(F.avg(v).alias("a"), F.max(v).alias("m"), F.count(v).alias("n"))
    metrics = {
        "avg_latency_ms": F.round("a", 2),
        "max_latency_ms": F.round("m", 2),
        "sample_count": F.col("n"),
        "threshold_ms": F.lit(threshold_ms),
        "window_minutes": F.lit(minutes),
    }
    return stats.filter(F.col("a") > threshold_ms).select(
        *_finding("high_latency", severity_by_multiple(F.col("a"), threshold_ms), as_ts(asof), metrics)
    )


def error_rate_anomalies(traces: DataFrame, asof, threshold: float = 0.1, minutes: int = 5) -> DataFrame:
    rates = error_rate(traces, asof, minutes).filter(F.col("error_rate") > threshold)
    metrics = {"error_rate": F.col("error_rate"), "total": F.col("total"), "threshold": F.lit(threshold)}
    return rates.select(
        *_finding("error_rate", severity_by_multiple(F.col("error_rate"), threshold), as_ts(asof), metrics)
    )


def windowed_anomalies(events: DataFrame, window: str = "5 minutes", slide: str | None = None, errors_at: int = 5, latency_at: float = 5000) -> DataFrame:
    """Both checks for every window of a table or stream: one row per window, agent and finding."""
    is_err = F.col("event_type") == "error"
    dur = F.when(is_end_event(), F.col("duration_ms"))
    stats = events.groupBy(F.window("ts", window, slide), "agent_id").agg(
        F.count_if(is_err).alias("error_count"), F.avg(dur).alias("avg_latency_ms"),
        F.max(dur).alias("max_latency_ms"), F.count(dur).alias("sample_count"),
    )
    finding = lambda kind, severity, value: F.struct(
        F.lit(kind).alias("anomaly_type"), severity.alias("severity"), value.cast("double").alias("value")
    )
    n, mean = F.col("error_count"), F.col("avg_latency_ms")
    burst = F.when(n >= errors_at, finding("high_error_rate", severity_by_multiple(n, errors_at), n))
    slow = F.when(mean > latency_at, finding("high_latency", severity_by_multiple(mean, latency_at), F.round(mean, 2)))
    hits = stats.withColumn("hit", F.explode(F.array_compact(F.array(burst, slow))))
    return hits.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "agent_id", "hit.*"
    )


def union_anomalies(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def alarm_state(points: DataFrame, keys: list[str], threshold: float, n_periods: int, period_s: int = 300, stat: str = "avg", ts: str = "ts", value: str = "measure_value") -> DataFrame:
    """Alarm per period: the statistic breaches for ``n_periods`` periods in a row.

    A missing period does not breach, so a run of breaches must be consecutive
    in time.  Only breaching periods are kept and grouped into runs.
    """
    agg = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[stat](value)
    slot = F.floor(F.unix_seconds(ts) / period_s)
    periods = points.groupBy(*keys, slot.alias("slot")).agg(agg.alias("stat"))
    hot = periods.filter(F.col("stat") > threshold)
    # A breach is in alarm when the breach n-1 rows before it is exactly n-1 slots earlier.
    rows = ordered_scan(
        hot.withColumn("at", F.timestamp_seconds(F.col("slot") * period_s)), keys, "at", "slot", row_number="rn",
        piece_seconds=period_s * 10_000,
    )
    run = F.col("slot") - F.col("rn")
    runs = rows.groupBy(*keys, run.alias("run")).agg(
        F.min("slot").alias("first"), F.max("slot").alias("last"), F.count(F.lit(1)).alias("breaches"), F.max("stat").alias("peak")
    )
    start = F.timestamp_seconds((F.col("first") + n_periods - 1) * period_s)
    end = F.timestamp_seconds((F.col("last") + 1) * period_s)
    return runs.filter(F.col("breaches") >= n_periods).select(
        *keys, start.alias("alarm_from"), end.alias("alarm_until"), "breaches", "peak"
    )


def outliers(df: DataFrame, value: str, method: str = "zscore", key: str = "agent_id", ts: str = "ts", tie: str = "event_id", n: int = 30, k: float | None = None) -> DataFrame:
    """Rows far from their key's usual values.

    ``zscore``: more than ``k`` (3) deviations from the mean of the ``n`` rows
    before; ``baseline``: more than ``k`` (2) times that mean; ``iqr``: outside
    the key's quartiles by ``k`` (1.5) ranges.
    """
    x = F.col(value)
    if method == "iqr":
        k = 1.5 if k is None else k
        q = df.groupBy(key).agg(F.percentile_approx(value, [0.25, 0.75]).alias("q"))
        rows = df.join(q, key)
        span = (F.col("q")[1] - F.col("q")[0]) * k
        hit = (x < F.col("q")[0] - span) | (x > F.col("q")[1] + span)
        return rows.filter(hit).withColumns({"low": F.col("q")[0] - span, "high": F.col("q")[1] + span}).drop("q")

    numbered = ordered_scan(df, [key], ts, tie, row_number="__seq")

    def stats(w) -> dict[str, Column]:
        before = w.rowsBetween(-n, -1)
        return {"mean": F.avg(value).over(before), "sd": F.stddev_samp(value).over(before), "samples": F.count(value).over(before)}

    rows = blocked_frame(numbered, [key], "__seq", n, stats).drop("__seq")
    if method == "baseline":
        return rows.filter((F.col("samples") > 0) & (x > F.col("mean") * (2 if k is None else k))).drop("sd")
    return rows.filter((F.col("samples") > 1) & (F.abs(x - F.col("mean")) > F.col("sd") * (3 if k is None else k)))
