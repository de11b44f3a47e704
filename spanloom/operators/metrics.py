"""Dashboard metrics, series and the structured metric query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import safe_ratio
from ..functions.times import (
    SERIES_BUCKETS,
    TREND_BUCKETS,
    as_ts,
    bucket,
    in_last,
    period_delta,
    since,
    span_literal,
)
from .traces import traces_in_period

_ERR = "error"


def _zero(col: Column, kind: str = "double") -> Column:
    return F.coalesce(col.cast(kind), F.lit(0).cast(kind))


def _errors() -> Column:
    return F.count_if(F.col("status") == _ERR)


def dashboard_metrics(traces: DataFrame, agents: DataFrame, period: str, asof) -> DataFrame:
    """One overview row for the period, agent counts included."""
    n = F.count(F.lit(1))
    over = traces_in_period(traces, period, asof).agg(
        n.alias("total_traces"),
        _errors().alias("total_errors"),
        safe_ratio(_errors(), n).alias("error_rate"),
        _zero(F.avg("duration_ms")).alias("avg_latency_ms"),
        _zero(F.percentile_approx("duration_ms", 0.95)).alias("p95_latency_ms"),
        _zero(F.sum("total_tokens"), "bigint").alias("total_tokens"),
        _zero(F.sum("total_cost_usd")).alias("total_cost"),
    )
    counts = agents.agg(F.struct(F.count(F.lit(1)).alias("t"), F.count_if("is_active").alias("a")).alias("c"))
    return over.withColumn("c", counts.scalar()).select(
        F.lit(period).alias("period"), F.col("c.t").alias("total_agents"), F.col("c.a").alias("active_agents"),
        *[c for c in over.columns],
    )


def _series(traces: DataFrame, period: str, asof, agent_id: str | None, *aggs: Column) -> DataFrame:
    rows = traces_in_period(traces, period, asof)
    if agent_id is not None:
        rows = rows.filter(F.col("agent_id") == agent_id)
    width = SERIES_BUCKETS.get(period, "15 minutes")
    return rows.groupBy(bucket(F.col("start_time"), width).alias("timestamp")).agg(*aggs)


def latency_series(traces: DataFrame, period: str, asof, agent_id: str | None = None) -> DataFrame:
    return _series(
        traces, period, asof, agent_id,
        F.avg("duration_ms").alias("value"), F.percentile_approx("duration_ms", 0.95).alias("p95"),
    )


def request_series(traces: DataFrame, period: str, asof, agent_id: str | None = None) -> DataFrame:
    return _series(traces, period, asof, agent_id, F.count(F.lit(1)).alias("value"))


def error_series(traces: DataFrame, period: str, asof, agent_id: str | None = None) -> DataFrame:
    return _series(traces, period, asof, agent_id, _errors().alias("value"))


def agent_metrics(traces: DataFrame, period: str, asof, agent_id: str | None = None) -> DataFrame:
    rows = traces_in_period(traces, period, asof)
    if agent_id is not None:
        rows = rows.filter(F.col("agent_id") == agent_id)
    n = F.count(F.lit(1))
    out = rows.groupBy("agent_id").agg(
        n.alias("request_count"),
        _errors().alias("error_count"),
        safe_ratio(_errors(), n).alias("error_rate"),
        F.avg("duration_ms").alias("avg_latency_ms"),
        F.percentile_approx("duration_ms", [0.5, 0.95, 0.99]).alias("q"),
        _zero(F.sum("total_tokens"), "bigint").alias("total_tokens"),
        _zero(F.sum("total_prompt_tokens"), "bigint").alias("input_tokens"),
        _zero(F.sum("total_completion_tokens"), "bigint").alias("output_tokens"),
        _zero(F.sum("total_cost_usd")).alias("total_cost"),
    )
    names = ["p50_latency_ms", "p95_latency_ms", "p99_latency_ms"]
    return out.withColumns({c: F.col("q")[i] for i, c in enumerate(names)}).drop("q")


def error_rate(traces: DataFrame, asof, minutes: int = 5) -> DataFrame:
    recent = traces.filter(in_last(F.col("start_time"), asof, period_delta(f"{minutes}m")))
    return recent.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total"),
        _errors().alias("errors"),
        safe_ratio(_errors(), F.count(F.lit(1))).alias("error_rate"),
    )


def _breakdown(calls: DataFrame, key: Column, label: str, value: Column) -> DataFrame:
    return calls.groupBy(key.alias("key")).agg(value.alias("value")).select(F.lit(label).alias("dimension"), "key", "value")


def _recent_calls(calls: DataFrame, period: str, asof) -> DataFrame:
    return calls.filter(in_last(F.col("ts"), asof, period_delta(period)))


def token_breakdown(calls: DataFrame, period: str, asof) -> DataFrame:
    """Tokens of finished LLM calls by model and by agent: (dimension, key, value).

    Long form instead of maps, so the number of agents is not limited by one row.
    """
    rows = _recent_calls(calls, period, asof)
    total = F.sum("total_tokens")
    return _breakdown(rows, F.col("model"), "model", total).unionByName(
        _breakdown(rows, F.col("agent_id"), "agent", total)
    )


def cost_breakdown(calls: DataFrame, period: str, asof) -> DataFrame:
    """Cost of finished LLM calls by model, agent and day: (dimension, key, value)."""
    rows = _recent_calls(calls, period, asof)
    total = F.sum("cost_usd")
    by_day = _breakdown(rows, F.date_format("ts", "yyyy-MM-dd"), "day", total)
    return (
        _breakdown(rows, F.col("model"), "model", total)
        .unionByName(_breakdown(rows, F.col("agent_id"), "agent", total))
        .unionByName(by_day)
    )


def approx_agents(traces: DataFrame, rsd: float = 0.05) -> DataFrame:
    return traces.agg(F.approx_count_distinct("agent_id", rsd).alias("unique_agents"))


def agent_sketches(traces: DataFrame) -> DataFrame:
    """Daily mergeable sketches of the agents seen."""
    return traces.groupBy("date").agg(F.hll_sketch_agg("agent_id").alias("sketch"))


def agents_from_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_agents"))


def agent_counts(agents: DataFrame) -> DataFrame:
    return agents.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "inactive").alias("inactive"),
        F.count_if(F.col("status") == "error").alias("error"),
    )


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("agent_id").agg(F.max("ts").alias("last_seen"))


def inactive_agents(events: DataFrame, asof, hours: int = 24) -> DataFrame:
    return last_seen(events).filter(F.col("last_seen") < since(asof, period_delta(f"{hours}h")))


def metrics_summary(traces: DataFrame, period: str, asof) -> DataFrame:
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "success")
    cost = _zero(F.sum("total_cost_usd"))
    out = traces_in_period(traces, period, asof).agg(
        n.alias("total_traces"),
        safe_ratio(ok, n).alias("success_rate"),
        safe_ratio(_errors(), n).alias("error_rate"),
        F.percentile_approx("duration_ms", [0.5, 0.95, 0.99]).alias("q"),
        _zero(F.sum("total_tokens"), "bigint").alias("total_tokens"),
        _zero(F.sum("total_prompt_tokens"), "bigint").alias("prompt_tokens"),
        _zero(F.sum("total_completion_tokens"), "bigint").alias("completion_tokens"),
        cost.alias("total_cost_usd"),
        safe_ratio(cost, n).alias("avg_cost_per_trace"),
    )
    names = ["p50_latency_ms", "p95_latency_ms", "p99_latency_ms"]
    return out.withColumns({c: F.col("q")[i] for i, c in enumerate(names)}).drop("q")


def latency_percentiles(traces: DataFrame, interval: str = "1 hour") -> DataFrame:
    out = traces.groupBy(bucket(F.col("start_time"), interval).alias("timestamp")).agg(
        F.percentile_approx("duration_ms", [0.5, 0.95, 0.99]).alias("q"), F.count(F.lit(1)).alias("request_count")
    )
    return out.withColumns({c: F.col("q")[i] for i, c in enumerate(["p50_ms", "p95_ms", "p99_ms"])}).drop("q")


# ---- structured metric query over narrow points ----

AGGREGATES = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "p50": lambda c: F.percentile_approx(c, 0.50),
    "p95": lambda c: F.percentile_approx(c, 0.95),
    "p99": lambda c: F.percentile_approx(c, 0.99),
}


@dataclass(frozen=True)
class MetricQuery:
    metrics: tuple[str, ...] = ("duration_ms",)
    aggregations: tuple[str, ...] = ("avg",)
    period: str = "24h"
    agent_ids: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    order_by: str | None = None
    limit: int | None = None


def _measure_columns(q: MetricQuery, when: Column | None = None, suffix: str = "") -> list[Column]:
    cols = []
    for m in q.metrics:
        hit = F.col("measure_name") == m
        value = F.when(hit if when is None else hit & when, F.col("measure_value"))
        cols += [AGGREGATES[a](value).alias(f"{m}_{a}{suffix}") for a in q.aggregations]
    return cols


def _selected(points: DataFrame, q: MetricQuery) -> DataFrame:
    rows = points.filter(F.col("measure_name").isin(list(q.metrics)))
    if q.agent_ids:
        rows = rows.filter(F.col("agent_id").isin(list(q.agent_ids)))
    for name, value in q.filters.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def run_query(points: DataFrame, q: MetricQuery, asof) -> DataFrame:
    """Each metric and aggregation becomes one column; filters reach the scan."""
    rows = _selected(points, q).filter(in_last(F.col("ts"), asof, period_delta(q.period)))
    out = rows.groupBy(*q.group_by).agg(*_measure_columns(q))
    if q.order_by:
        out = out.orderBy(F.desc(q.order_by), *q.group_by)
    return out.limit(q.limit) if q.limit else out


def trend(points: DataFrame, metric: str, agg: str, period: str, asof) -> DataFrame:
    """(time bucket, agent) -> one aggregate of one metric."""
    rows = points.filter((F.col("measure_name") == metric) & in_last(F.col("ts"), asof, period_delta(period)))
    width = TREND_BUCKETS.get(period, "1 hour")
    return rows.groupBy(bucket(F.col("ts"), width).alias("time_bucket"), "agent_id").agg(
        AGGREGATES[agg](F.col("measure_value")).alias("value")
    )


def compare_agents(points: DataFrame, agents: list[str], q: MetricQuery, asof) -> DataFrame:
    spec = MetricQuery(q.metrics, q.aggregations, q.period, tuple(agents), ("agent_id",), q.filters)
    return run_query(points, spec, asof)


def compare_periods(points: DataFrame, q: MetricQuery, asof) -> DataFrame:
    """The query over the period and over the one before it, from one scan."""
    delta = period_delta(q.period)
    middle = since(asof, delta)
    rows = _selected(points, q).filter(
        (F.col("ts") > middle - span_literal(delta)) & (F.col("ts") <= as_ts(asof))
    )
    current = F.col("ts") > middle
    cols = _measure_columns(q, current, "_current") + _measure_columns(q, ~current, "_previous")
    return rows.groupBy(*q.group_by).agg(*cols)


def trend_vs_previous(traces: DataFrame, period: str, asof) -> DataFrame:
    """Relative change of traces, errors and mean latency against the period before."""
    delta = period_delta(period)
    middle = since(asof, delta)
    at = F.col("start_time")
    rows = traces.filter((at > middle - span_literal(delta)) & (at <= as_ts(asof)))
    now = at > middle
    failed = F.col("status") == _ERR
    sums = rows.agg(
        F.count_if(now).alias("n1"),
        F.count_if(~now).alias("n0"),
        F.count_if(now & failed).alias("e1"),
        F.count_if(~now & failed).alias("e0"),
        F.avg(F.when(now, F.col("duration_ms"))).alias("l1"),
        F.avg(F.when(~now, F.col("duration_ms"))).alias("l0"),
    )
    change = lambda a, b: safe_ratio(F.col(a) - F.col(b), F.col(b))
    return sums.select(
        F.lit(period).alias("period"),
        change("n1", "n0").alias("traces_trend"),
        change("e1", "e0").alias("errors_trend"),
        change("l1", "l0").alias("latency_trend"),
    )


def measure_stats(points: DataFrame, asof, hours: int = 1) -> DataFrame:
    rows = points.filter(in_last(F.col("ts"), asof, period_delta(f"{hours}h")))
    v = "measure_value"
    return rows.groupBy("agent_id", "measure_name").agg(
        F.avg(v).alias("avg_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value")
    )
