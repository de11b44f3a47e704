"""Tool and MCP call rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import safe_ratio
from ..functions.times import hour
from .events import of_types
from .ordered import ordered_scan


def _outcomes(ok: str, failed: str):
    return [
        F.count_if(F.col("status") == "success").alias(ok),
        F.count_if(F.col("status") == "error").alias(failed),
    ]


def _percentiles(col: str, prefix: str = "p", suffix: str = "_duration_ms"):
    q = F.percentile_approx(col, [0.5, 0.95, 0.99])
    return q, [(0, f"{prefix}50{suffix}"), (1, f"{prefix}95{suffix}"), (2, f"{prefix}99{suffix}")]


def tool_usage_hourly(events: DataFrame) -> DataFrame:
    """(agent, tool, hour) -> calls, outcomes, duration statistics, success rate."""
    out = of_types(events, "tool_call_end").groupBy("agent_id", "tool_name", hour(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("invocation_count"),
        *_outcomes("success_count", "error_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.stddev_samp("duration_ms").alias("stddev_duration_ms"),
    )
    rate = safe_ratio(F.col("success_count"), F.col("invocation_count"))
    return out.withColumn("success_rate", rate).withColumn("date", F.to_date("hour"))


def tool_performance_daily(events: DataFrame) -> DataFrame:
    q, names = _percentiles("duration_ms")
    out = of_types(events, "tool_call_end").groupBy("agent_id", "tool_name", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("total_invocations"),
        *_outcomes("total_successes", "total_errors"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        q.alias("q"),
    )
    out = out.withColumns({n: F.col("q")[i] for i, n in names}).drop("q")
    return out.withColumn("success_rate", safe_ratio(F.col("total_successes"), F.col("total_invocations")))


def with_previous_tool(events: DataFrame) -> DataFrame:
    """Tool starts with their position and the tool called before them in the trace."""
    starts = of_types(events, "tool_call_start").select("event_id", "trace_id", "agent_id", "ts", "tool_name")
    return ordered_scan(starts, ["trace_id"], row_number="sequence_position", lag={"prev_tool": "tool_name"})


def tool_transitions(events: DataFrame) -> DataFrame:
    """(agent, day, from_tool, to_tool) -> transitions."""
    steps = with_previous_tool(events).filter(F.col("prev_tool").isNotNull())
    return steps.groupBy(
        "agent_id", F.to_date("ts").alias("date"), F.col("prev_tool").alias("from_tool"), F.col("tool_name").alias("to_tool")
    ).agg(F.count(F.lit(1)).alias("transition_count"))


def tool_metrics(events: DataFrame) -> DataFrame:
    """Calls, success rate, mean and p95 duration per tool."""
    return of_types(events, "tool_call_end").groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("invocation_count"),
        safe_ratio(F.count_if(F.col("status") == "success"), F.count(F.lit(1))).alias("success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_duration_ms"),
    )


def mcp_calls(events: DataFrame) -> DataFrame:
    """Calls, failures and durations per MCP server and method."""
    failed = F.count_if(~F.coalesce(F.col("success"), F.lit(True)))
    return of_types(events, "mcp_call_end").groupBy("server_name", "method").agg(
        F.count(F.lit(1)).alias("calls"),
        failed.alias("failures"),
        safe_ratio(failed, F.count(F.lit(1))).alias("failure_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_duration_ms"),
    )
