"""The daily batch: one scan of the raw day, all rollups, one report row."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import anomalies, cost, errors, events as ev, metrics, tokens, tools, traces
from ..session import scratch_path
from ..sources import files, tables


def load_day(spark: SparkSession, raw_base: str, store: str, day: date, min_events: int = 1) -> DataFrame:
    """Parse one raw day into the canonical event table and read it back from there.

    The rollups then scan columnar files with pruning instead of parsing JSON
    again, and a lost executor only re-reads its split.
    """
    staged = scratch_path(spark, "load")
    files.read_raw_json(spark, f"{raw_base}/raw/events/{day:%Y/%m/%d}").write.parquet(staged)
    good, bad = files.split_bad_records(spark.read.parquet(staged))
    found = good.count()
    if found < min_events:  # nothing of an incomplete day is published
        raise ValueError(f"{day}: {found} events, at least {min_events} expected")
    files.canonical(good).write.mode("overwrite").parquet(f"{store}/events/load_date={day}")
    bad.write.mode("overwrite").parquet(f"{store}/quarantine/load_date={day}")
    return read_day(spark, store, "events", day)


def read_day(spark: SparkSession, store: str, table: str, day: date) -> DataFrame:
    return spark.read.parquet(f"{store}/{table}").filter(F.col("load_date") == F.lit(day)).drop("load_date")


def run_daily(spark: SparkSession, events: DataFrame, agents: DataFrame, budgets: DataFrame, store: str, day: date, asof) -> dict[str, int]:
    """All rollups of a day, written by partition; returns rows written per table.

    Tables are partitioned by the day of loading, ``load_date``; ``date`` stays the
    day of the events, so late events of other days have rows of their own.  A rerun
    replaces the load day's partitions, also by nothing.  Rollups that feed others are
    read back from what was just written, so nothing is computed twice.  The master of
    error patterns is rebuilt from all load days and keeps what was resolved by hand.
    """
    rows: dict[str, int] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        whole = df.withColumn("load_date", F.lit(day))
        rows[name] = tables.write_observed(whole, f"{store}/{name}", name, "load_date", day).get["rows"]
        return read_day(spark, store, name, day)

    hourly = save("token_usage_hourly", tokens.token_usage_hourly(events))
    save("token_usage_daily", tokens.token_usage_daily(hourly))
    calls = save("costed_calls", cost.costed_calls(events, agents))
    for level in ("agent", "team", "project", "cost_center"):
        save(f"cost_by_{level}_daily", cost.cost_by(calls, level))
    history = spark.read.parquet(f"{store}/cost_by_cost_center_daily").drop("load_date")
    save("cost_alerts", cost.budget_alerts(cost.mtd_cost(history, asof), budgets))
    save("tool_usage_hourly", tools.tool_usage_hourly(events))
    save("tool_performance_daily", tools.tool_performance_daily(events))
    save("tool_transitions", tools.tool_transitions(events))
    save("error_patterns_daily", errors.error_patterns(events))
    rows["error_patterns_master"] = save_master(spark, store)
    save("error_trends_hourly", errors.error_trends_hourly(events))
    archive = save("traces_archive", traces.reconstruct_traces(events))
    save("trace_documents", traces.trace_documents(events))
    save("trace_statistics_daily", traces.trace_statistics(archive))
    save("trace_anomalies", traces.trace_anomalies(archive))
    save("anomalies", anomaly_report(events))
    return rows


def save_master(spark: SparkSession, store: str) -> int:
    """Rebuild the master from all days, so that reruns never count twice; returns its rows.

    The table is written next to the old one and becomes current by the pointer's version.
    """
    daily = spark.read.parquet(f"{store}/error_patterns_daily").drop("load_date")
    try:
        old = spark.read.parquet(f"{store}/error_patterns_master")
        version = old.agg(F.max("version")).first()[0] or 0
        marks = old.filter(F.col("version") == version)
    except AnalysisException:
        version, marks = 0, spark.createDataFrame([], "error_fingerprint string, resolution_status string")
    out, seen = tables.counted(errors.rebuild_master(daily, marks), "error_patterns_master")
    out.write.mode("overwrite").parquet(f"{store}/error_patterns_master/version={version + 1}")
    return seen.get["rows"]


def read_master(spark: SparkSession, store: str) -> DataFrame:
    """The current master of error patterns."""
    table = spark.read.parquet(f"{store}/error_patterns_master")
    return table.filter(F.col("version") == table.agg(F.max("version")).scalar()).drop("version")


def anomaly_report(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Both anomaly checks for every window of the day."""
    return anomalies.windowed_anomalies(events, window)


def daily_report(trace_rows: DataFrame, alerts: DataFrame, events: DataFrame, day: date) -> DataFrame:
    """One summary row of a day: traces, success, cost, agents, alerts, latency, tokens, LLM calls."""
    on_day = lambda df, ts: df.filter(F.to_date(ts) == F.lit(day))
    n = F.count(F.lit(1))
    t = on_day(trace_rows, "start_time").agg(
        n.alias("total_traces"),
        metrics.safe_ratio(F.count_if(F.col("status") == "success"), n).alias("success_rate"),
        F.coalesce(F.sum("total_cost_usd").cast("double"), F.lit(0.0)).alias("total_cost"),
        F.count_distinct("agent_id").alias("active_agents"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_latency_ms"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )
    a = on_day(alerts, "ts").agg(
        F.struct(n.alias("total"), F.count_if(F.lower("severity") == "critical").alias("critical")).alias("a")
    )
    calls = on_day(ev.of_types(events, "llm_call_end"), "ts").agg(n.alias("n"))
    return (
        t.withColumn("date", F.lit(day))
        .withColumn("alerts", a.scalar())
        .withColumns({"total_alerts": F.col("alerts.total"), "critical_alerts": F.col("alerts.critical")})
        .withColumn("llm_calls", calls.scalar())
        .drop("alerts")
    )
