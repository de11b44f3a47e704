"""Dashboard metrics, series, structured queries, lists and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import events as P, metrics as M, ordered as O, search as Q, traces as R
from .. import sample as S
from ..sample import ASOF
from .registry import query

IN_7D = "start_time >= :asof - INTERVAL 7 DAY AND start_time <= :asof"
PCT = "quantile_disc(duration_ms, {q})"


@query("A-20", f"""
SELECT '7d' AS period, (SELECT count(*) FROM ag) AS total_agents, (SELECT count(*) FROM ag WHERE is_active) AS active_agents, count(*) AS total_traces,
  count(*) FILTER (status = 'error') AS total_errors, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate,
  round(avg(duration_ms), 6) AS avg_latency_ms, CAST(quantile_disc(duration_ms, 0.95) AS DOUBLE) AS p95_latency_ms,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_cost_usd), 6) AS total_cost FROM tr WHERE {IN_7D}""")
def dashboard_metrics(spark, d):
    return M.dashboard_metrics(S.traces(spark, d), S.agents(spark, d), "7d", ASOF)


def _bucket(width):
    return f"time_bucket(INTERVAL '{width}', start_time, TIMESTAMP '1970-01-01')"


@query("A-21", f"""
SELECT {_bucket('1 hour')} AS timestamp, round(avg(duration_ms), 6) AS value, quantile_disc(duration_ms, 0.95) AS p95
FROM tr WHERE {IN_7D} GROUP BY 1""")
def latency_series(spark, d):
    return M.latency_series(S.traces(spark, d), "7d", ASOF)


@query("A-22", f"""
SELECT {_bucket('6 hours')} AS timestamp, count(*) AS value FROM tr WHERE start_time >= :asof - INTERVAL 30 DAY AND start_time <= :asof
  AND agent_id = 'agent-2' GROUP BY 1""")
def request_series_of_agent(spark, d):
    return M.request_series(S.traces(spark, d), "30d", ASOF, "agent-2")


@query("A-23", f"SELECT {_bucket('1 hour')} AS timestamp, count(*) FILTER (status = 'error') AS value FROM tr WHERE {IN_7D} GROUP BY 1")
def error_series(spark, d):
    return M.error_series(S.traces(spark, d), "7d", ASOF)


@query("A-24", f"""
SELECT agent_id, count(*) AS request_count, count(*) FILTER (status = 'error') AS error_count,
  round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, round(avg(duration_ms), 6) AS avg_latency_ms,
  quantile_disc(duration_ms, 0.5) AS p50_latency_ms, quantile_disc(duration_ms, 0.95) AS p95_latency_ms, quantile_disc(duration_ms, 0.99) AS p99_latency_ms,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(total_prompt_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(total_completion_tokens), 0) AS BIGINT) AS output_tokens, round(coalesce(sum(total_cost_usd), 0), 6) AS total_cost
FROM tr WHERE {IN_7D} GROUP BY agent_id""")
def agent_metrics(spark, d):
    return M.agent_metrics(S.traces(spark, d), "7d", ASOF)


@query("A-25", """
SELECT agent_id, count(*) AS total, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate
FROM tr WHERE start_time >= :asof - INTERVAL 2880 MINUTE AND start_time <= :asof GROUP BY agent_id""")
def recent_error_rate(spark, d):
    return M.error_rate(S.traces(spark, d), ASOF, minutes=2880)


_CALLS = "FROM call WHERE ts >= :asof - INTERVAL 7 DAY AND ts <= :asof GROUP BY 2"


@query("A-26", f"""
SELECT 'model' AS dimension, model AS key, CAST(sum(total_tokens) AS BIGINT) AS value {_CALLS}
UNION ALL SELECT 'agent', agent_id, CAST(sum(total_tokens) AS BIGINT) {_CALLS}""")
def token_breakdown(spark, d):
    return M.token_breakdown(S.calls(spark, d), "7d", ASOF)


@query("A-27", f"""
SELECT 'model' AS dimension, model AS key, round(CAST(sum(cost_usd) AS DOUBLE), 10) AS value {_CALLS}
UNION ALL SELECT 'agent', agent_id, round(CAST(sum(cost_usd) AS DOUBLE), 10) {_CALLS}
UNION ALL SELECT 'day', date, round(CAST(sum(cost_usd) AS DOUBLE), 10) {_CALLS}""")
def cost_breakdown(spark, d):
    return M.cost_breakdown(S.calls(spark, d), "7d", ASOF)


@query("A-30", """
SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'inactive') AS inactive,
  count(*) FILTER (status = 'error') AS error FROM ag""")
def agent_counts(spark, d):
    return M.agent_counts(S.agents(spark, d))


@query("A-31", "SELECT agent_id, max(ts) AS last_seen FROM ev WHERE ts <= :asof GROUP BY agent_id HAVING max(ts) < :asof - INTERVAL 1 HOUR")
def inactive_agents(spark, d):
    return M.inactive_agents(P.filter_by(S.events(spark, d), end=ASOF), ASOF, hours=1)


@query("A-41", f"""
SELECT count(*) AS total_traces, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate,
  round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, quantile_disc(duration_ms, 0.5) AS p50_latency_ms,
  quantile_disc(duration_ms, 0.95) AS p95_latency_ms, quantile_disc(duration_ms, 0.99) AS p99_latency_ms,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(total_completion_tokens) AS BIGINT) AS completion_tokens, round(sum(total_cost_usd), 6) AS total_cost_usd,
  round(sum(total_cost_usd) / count(*), 6) AS avg_cost_per_trace FROM tr WHERE {IN_7D}""")
def metrics_summary(spark, d):
    return M.metrics_summary(S.traces(spark, d), "7d", ASOF)


@query("A-43", f"""
SELECT {_bucket('1 hour')} AS timestamp, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms,
  quantile_disc(duration_ms, 0.99) AS p99_ms, count(*) AS request_count FROM tr GROUP BY 1""")
def latency_percentiles(spark, d):
    return M.latency_percentiles(S.traces(spark, d), "1 hour")


_MQ = M.MetricQuery(("duration_ms", "input_tokens"), ("avg", "sum", "min", "max", "count", "p50", "p95", "p99"), "7d", group_by=("agent_id",))


def _cols(metric, when="", suffix=""):
    v = f"CASE WHEN measure_name = '{metric}'{when} THEN measure_value END"
    f = {"avg": f"round(avg({v}), 6)", "sum": f"sum({v})", "min": f"min({v})", "max": f"max({v})", "count": f"count({v})",
         "p50": f"quantile_disc({v}, 0.5)", "p95": f"quantile_disc({v}, 0.95)", "p99": f"quantile_disc({v}, 0.99)"}
    return ", ".join(f"{e} AS {metric}_{a}{suffix}" for a, e in f.items())


@query("A-32", f"""
SELECT agent_id, {_cols('duration_ms')}, {_cols('input_tokens')} FROM points WHERE measure_name IN ('duration_ms', 'input_tokens')
  AND ts >= :asof - INTERVAL 7 DAY AND ts <= :asof GROUP BY agent_id""")
def metric_query(spark, d):
    return M.run_query(S.points(spark, d), _MQ, ASOF)


@query("A-32", """
SELECT agent_id, environment, count(measure_value) AS duration_ms_count FROM points WHERE measure_name = 'duration_ms' AND environment = 'staging'
  AND ts >= :asof - INTERVAL 7 DAY AND ts <= :asof GROUP BY ALL ORDER BY count(measure_value) DESC, agent_id LIMIT 5""")
def metric_query_top(spark, d):
    spec = M.MetricQuery(("duration_ms",), ("count",), "7d", group_by=("agent_id", "environment"), filters={"environment": "staging"}, order_by="duration_ms_count", limit=5)
    return M.run_query(S.points(spark, d), spec, ASOF)


@query("A-34", """
SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS time_bucket, agent_id, quantile_disc(measure_value, 0.95) AS value
FROM points WHERE measure_name = 'duration_ms' AND ts >= :asof - INTERVAL 7 DAY AND ts <= :asof GROUP BY 1, 2""")
def metric_trend(spark, d):
    return M.trend(S.points(spark, d), "duration_ms", "p95", "7d", ASOF)


@query("A-35 U-02", """
SELECT agent_id, round(avg(measure_value), 6) AS duration_ms_avg FROM points WHERE measure_name = 'duration_ms'
  AND agent_id IN ('agent-1', 'agent-2', 'agent-3') AND ts >= :asof - INTERVAL 7 DAY AND ts <= :asof GROUP BY agent_id""")
def agent_comparison(spark, d):
    return M.compare_agents(S.points(spark, d), ["agent-1", "agent-2", "agent-3"], M.MetricQuery(period="7d"), ASOF)


def _period_cols(q):
    now, before = " AND ts > :asof - INTERVAL 7 DAY", " AND ts <= :asof - INTERVAL 7 DAY"
    v = lambda w: f"CASE WHEN measure_name = 'duration_ms'{w} THEN measure_value END"
    return ", ".join(
        f"{f'round(avg({v(w)}), 6)' if a == 'avg' else f'count({v(w)})'} AS duration_ms_{a}_{s}"
        for w, s in [(now, "current"), (before, "previous")] for a in ("avg", "count")
    )


@query("J-21", f"""
SELECT agent_id, {_period_cols(None)} FROM points WHERE measure_name = 'duration_ms' AND ts > :asof - INTERVAL 14 DAY AND ts <= :asof GROUP BY agent_id""")
def period_comparison(spark, d):
    spec = M.MetricQuery(("duration_ms",), ("avg", "count"), "7d", group_by=("agent_id",))
    return M.compare_periods(S.points(spark, d), spec, ASOF)


@query("W-10", """
SELECT '7d' AS period, round((n1 - n0) / n0, 6) AS traces_trend, round((e1 - e0) / e0, 6) AS errors_trend, round((l1 - l0) / l0, 6) AS latency_trend FROM (
  SELECT count(*) FILTER (x) AS n1, count(*) FILTER (NOT x) AS n0, count(*) FILTER (x AND status = 'error') AS e1,
    count(*) FILTER (NOT x AND status = 'error') AS e0, avg(duration_ms) FILTER (x) AS l1, avg(duration_ms) FILTER (NOT x) AS l0
  FROM (SELECT *, start_time > :asof - INTERVAL 7 DAY AS x FROM tr WHERE start_time > :asof - INTERVAL 14 DAY AND start_time <= :asof))""")
def trend_vs_previous(spark, d):
    return M.trend_vs_previous(S.traces(spark, d), "7d", ASOF)


@query("A-36", """
SELECT agent_id, measure_name, round(avg(measure_value), 6) AS avg_value, max(measure_value) AS max_value, min(measure_value) AS min_value
FROM points WHERE ts >= :asof - INTERVAL 24 HOUR AND ts <= :asof GROUP BY agent_id, measure_name""")
def measure_stats(spark, d):
    return M.measure_stats(S.points(spark, d), ASOF, hours=24)


# ---- lists, pages, top-k ----


@query("T-01", "SELECT trace_id, start_time FROM tr ORDER BY start_time DESC, trace_id LIMIT 10 OFFSET 20")
def traces_page_3(spark, d):
    return O.page(S.traces(spark, d), [F.desc("start_time"), F.asc("trace_id")], 3, 10)[0].select("trace_id", "start_time")


@query("T-01", "SELECT count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM tr")
def traces_page_totals(spark, d):
    return O.page(S.traces(spark, d), [F.desc("start_time")], 3, 10)[1]


@query("T-01", """
SELECT trace_id, start_time FROM tr WHERE start_time < TIMESTAMP '2024-01-15' OR (start_time = TIMESTAMP '2024-01-15' AND trace_id > '')
ORDER BY start_time DESC, trace_id LIMIT 10""")
def traces_keyset_page(spark, d):
    return O.page_after(S.traces(spark, d), "start_time", "trace_id", ("2024-01-15", ""), 10).select("trace_id", "start_time")


@query("T-02", """
SELECT agent_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY start_time DESC, trace_id) AS r FROM tr) WHERE r <= 5""")
def latest_traces_per_agent(spark, d):
    return O.latest_per(S.traces(spark, d), "agent_id", 5, "start_time", "trace_id").select("agent_id", "trace_id")


@query("T-03 U-02", """
SELECT agent_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY start_time DESC, trace_id) AS r FROM tr
  WHERE agent_id IN ('agent-1', 'agent-2', 'agent-3')) WHERE r <= 6""")
def traces_by_quota(spark, d):
    return O.latest_quota(S.traces(spark, d), ["agent-1", "agent-2", "agent-3"], 20, "start_time", "trace_id").select("agent_id", "trace_id")


@query("T-04", "SELECT error_id, ts FROM er WHERE ts >= :asof - INTERVAL 24 HOUR ORDER BY ts DESC, error_id LIMIT 50")
def recent_errors(spark, d):
    cut = P.filter_by(S.errors(spark, d), start="2024-01-29 12:00:00")
    return O.top_k(cut, [F.desc("ts"), F.asc("error_id")], 50).select("error_id", "ts")


@query("T-07", "SELECT trace_id, duration_ms FROM tr ORDER BY duration_ms DESC, trace_id LIMIT 10")
def slowest_traces(spark, d):
    return O.top_k(S.traces(spark, d), [F.desc("duration_ms"), F.asc("trace_id")], 10).select("trace_id", "duration_ms")


@query("T-07", "SELECT agent_id, count(*) AS errors FROM er GROUP BY agent_id ORDER BY count(*) DESC, agent_id LIMIT 3")
def agents_with_most_errors(spark, d):
    n = S.errors(spark, d).groupBy("agent_id").agg(F.count("*").alias("errors"))
    return O.top_k(n, [F.desc("errors"), F.asc("agent_id")], 3)


@query("T-09", "SELECT span_id, start_time FROM sp WHERE trace_id = '7-20240101'")
def spans_of_trace(spark, d):
    return R.ordered_spans(S.spans(spark, d), "7-20240101").select("span_id", "start_time")


@query("P-12", "SELECT error_id, ts FROM er WHERE agent_id = 'agent-5' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, error_id LIMIT 20")
def searched_errors(spark, d):
    return Q.search_errors(S.errors(spark, d), "agent-5", "2024-01-10")[0].select("error_id", "ts")


@query("U-03", "SELECT agent_id, array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), ',') AS models FROM ev WHERE model IS NOT NULL GROUP BY agent_id")
def models_per_agent(spark, d):
    sets = O.distinct_values(S.events(spark, d).filter("model IS NOT NULL"), ["agent_id"], "model", "models")
    return sets.withColumn("models", F.array_join("models", ","))
