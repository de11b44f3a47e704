"""Daily rollups: tokens, cost, tools, errors, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import fmt_cost
from ...operators import cost as C, errors as E, ordered as O, tokens as K, tools as T, traces as R
from .. import sample as S
from ..sample import ASOF
from ..sample_sql import cost, hourly_cost
from .registry import query

HOURLY = f"""
SELECT agent_id, model, date_trunc('hour', ts) AS hour, CAST(sum(input_tokens) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  count(*) FILTER (event_type = 'llm_call_end') AS request_count, avg(duration_ms) AS avg_latency_ms,
  max(duration_ms) AS max_latency_ms, min(duration_ms) AS min_latency_ms, count(duration_ms) AS latency_samples,
  {hourly_cost('sum(input_tokens)', 'sum(output_tokens)')} AS estimated_cost_usd, strftime(date_trunc('hour', ts), '%Y-%m-%d') AS date
FROM ev WHERE event_type IN ('llm_call_start', 'llm_call_end') GROUP BY agent_id, model, date_trunc('hour', ts)"""

ROUND_HOURLY = """
  round(avg_latency_ms, 6) AS avg_latency_ms, round(CAST(estimated_cost_usd AS DOUBLE), 10) AS estimated_cost_usd"""


@query("A-01 F-01 UD-01 P-03", f"SELECT * REPLACE ({ROUND_HOURLY}) FROM ({HOURLY})")
def token_usage_hourly(spark, d):
    return K.token_usage_hourly(S.events(spark, d))


@query("A-01", f"""SELECT agent_id, model, date_trunc('hour', ts) AS hour, count(*) AS request_count FROM ev
WHERE event_type IN ('llm_call_start', 'llm_call_end') GROUP BY ALL""")
def token_usage_hourly_all_events(spark, d):
    return K.token_usage_hourly(S.events(spark, d), count="all").select("agent_id", "model", "hour", "request_count")


@query("A-02", f"""
SELECT agent_id, model, date, CAST(sum(total_prompt_tokens) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(total_completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(request_count) AS BIGINT) AS total_requests, round(CAST(sum(estimated_cost_usd) AS DOUBLE), 10) AS total_cost_usd,
  round(avg(avg_latency_ms), 6) AS avg_latency_ms,
  round(sum(avg_latency_ms * latency_samples) / nullif(sum(latency_samples), 0), 6) AS weighted_latency_ms
FROM ({HOURLY}) GROUP BY agent_id, model, date""")
def token_usage_daily(spark, d):
    return K.token_usage_daily(K.token_usage_hourly(S.events(spark, d)))


for _by, _key in [("agent", "agent_id"), ("model", "model"), ("hour", "date_trunc('hour', ts)"), ("day", "date_trunc('day', ts)")]:

    def _usage(spark, d, by=_by):
        return K.token_usage_by(S.events(spark, d), by)

    query("A-42", f"""
SELECT {'CAST(' + _key + ' AS TIMESTAMP)' if _by in ('hour', 'day') else _key} AS {_by}, CAST(sum(input_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(CAST(sum(cost_usd) AS DOUBLE), 10) AS cost_usd FROM call GROUP BY 1""", name=f"token_usage_by_{_by}")(_usage)


@query("J-01 J-02 F-02 UD-02", """
SELECT agent_id, model, ts, input_tokens, output_tokens, total_tokens, round(CAST(cost_usd AS DOUBLE), 10) AS cost_usd, date,
  CAST(team_id AS BIGINT) AS team_id, CAST(project_id AS BIGINT) AS project_id, cost_center FROM call""")
def llm_calls_with_cost_and_team(spark, d):
    return S.calls(spark, d)


@query("J-02", f"""
SELECT event_id, round(CAST({cost('input_tokens', 'output_tokens', unknown=('3', '15'))} AS DOUBLE), 10) AS cost_usd
FROM ev WHERE event_type = 'llm_call_end'""")
def cost_from_price_table(spark, d):
    from ...functions.pricing import PER_MILLION

    prices = spark.createDataFrame([(m, float(a), float(b)) for m, (a, b) in PER_MILLION.items()], "model string, input_price double, output_price double")
    calls = S.events(spark, d).filter("event_type = 'llm_call_end'")
    return C.with_pricing(calls, prices).select("event_id", "cost_usd")


_CALL_SUMS = """round(CAST(sum(cost_usd) AS DOUBLE), 10) AS total_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  count(DISTINCT agent_id) AS active_agents, count(*) AS total_requests"""


@query("A-03", """
SELECT date, agent_id, CAST(team_id AS BIGINT) AS team_id, CAST(project_id AS BIGINT) AS project_id, cost_center, model,
  round(CAST(sum(cost_usd) AS DOUBLE), 10) AS total_cost_usd, CAST(sum(input_tokens) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_completion_tokens, count(*) AS request_count
FROM call GROUP BY date, agent_id, team_id, project_id, cost_center, model""")
def cost_by_agent_daily(spark, d):
    return C.cost_by(S.calls(spark, d), "agent")


@query("A-04", f"SELECT date, CAST(team_id AS BIGINT) AS team_id, {_CALL_SUMS} FROM call GROUP BY date, team_id")
def cost_by_team_daily(spark, d):
    return C.cost_by(S.calls(spark, d), "team")


@query("A-05", f"SELECT date, CAST(project_id AS BIGINT) AS project_id, {_CALL_SUMS} FROM call GROUP BY date, project_id")
def cost_by_project_daily(spark, d):
    return C.cost_by(S.calls(spark, d), "project")


@query("A-06", f"""
SELECT date, cost_center, {_CALL_SUMS}, count(DISTINCT team_id) AS active_teams FROM call GROUP BY date, cost_center""")
def cost_by_cost_center_daily(spark, d):
    return C.cost_by(S.calls(spark, d), "cost_center")


@query("A-03 A-04 A-05 A-06", """
SELECT CASE WHEN grouping(agent_id) = 0 THEN 'agent' WHEN grouping(team_id) = 0 THEN 'team'
    WHEN grouping(project_id) = 0 THEN 'project' ELSE 'cost_center' END AS level,
  date, agent_id, CAST(team_id AS BIGINT) AS team_id, CAST(project_id AS BIGINT) AS project_id, cost_center, model,
  round(CAST(sum(cost_usd) AS DOUBLE), 10) AS total_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS total_requests
FROM call GROUP BY GROUPING SETS ((date, agent_id, team_id, project_id, cost_center, model), (date, team_id), (date, project_id), (date, cost_center))""")
def cost_cube(spark, d):
    return C.cost_cube(S.calls(spark, d))


_MTD = "SELECT cost_center, sum(total_cost_usd) AS mtd_cost FROM ccd WHERE date >= '2024-01-01' AND date <= '2024-01-30' GROUP BY cost_center"


@query("A-07 S-05", f"SELECT cost_center, round(CAST(mtd_cost AS DOUBLE), 10) AS mtd_cost FROM ({_MTD})")
def mtd_cost(spark, d):
    return C.mtd_cost(S.cost_center_daily(spark, d), ASOF)


@query("A-08 J-03", f"""
SELECT cost_center, round(CAST(mtd_cost AS DOUBLE), 10) AS mtd_cost, CAST(monthly_budget AS DOUBLE) AS monthly_budget,
  CAST(alert_threshold AS DOUBLE) AS alert_threshold, 'BUDGET_THRESHOLD' AS alert_type
FROM ({_MTD}) JOIN bud USING (cost_center) WHERE mtd_cost > monthly_budget * alert_threshold""")
def budget_alerts(spark, d):
    return C.budget_alerts(C.mtd_cost(S.cost_center_daily(spark, d), ASOF), S.budgets(spark, d))


_SUMMARY = """
SELECT c.date, c.cost_center, round(CAST(total_cost_usd AS DOUBLE), 10) AS total_cost_usd, total_tokens, active_agents, active_teams, total_requests,
  CAST(monthly_budget AS DOUBLE) AS monthly_budget,
  round(CASE WHEN monthly_budget IS NOT NULL THEN CAST(m AS DOUBLE) END, 10) AS mtd_cost,
  round(CAST(m AS DOUBLE) / CAST(monthly_budget AS DOUBLE) * 100, 6) AS budget_utilization_pct
FROM (SELECT x.*, (SELECT sum(y.total_cost_usd) FROM ccd y WHERE y.cost_center = x.cost_center AND substr(y.date, 1, 7) {op} substr(x.date, 1, 7) {upto}) AS m FROM ccd x) c
LEFT JOIN bud USING (cost_center)"""


def _summary(spark, d, bounded):
    return C.cost_summary(S.cost_center_daily(spark, d), S.budgets(spark, d), bounded)


@query("J-08 W-12", _SUMMARY.format(op="=", upto="AND y.date <= x.date"))
def cost_summary(spark, d):
    return _summary(spark, d, True)


@query("J-08", _SUMMARY.format(op=">=", upto=""))
def cost_summary_unbounded(spark, d):
    return _summary(spark, d, False)


@query("W-12", """
SELECT cost_center, date, round(CAST(sum(total_cost_usd) OVER (PARTITION BY cost_center, substr(date, 1, 7) ORDER BY date) AS DOUBLE), 10) AS running_mtd FROM ccd""")
def running_mtd(spark, d):
    return C.running_mtd(S.cost_center_daily(spark, d)).select("cost_center", "date", "running_mtd")


for _by, _key in [("agent", "agent_id"), ("team", "CAST(team_id AS BIGINT)"), ("project", "CAST(project_id AS BIGINT)"), ("cost_center", "cost_center"), ("day", "CAST(date_trunc('day', ts) AS TIMESTAMP)")]:

    def _share(spark, d, by=_by):
        return C.cost_share(S.calls(spark, d), by)

    query("A-45 W-09", f"""
SELECT {_by}, round(CAST(c AS DOUBLE), 10) AS cost_usd, total_tokens, round(CAST(c AS DOUBLE) * 100 / CAST((SELECT sum(cost_usd) FROM call) AS DOUBLE), 6) AS percentage
FROM (SELECT {_key} AS {_by}, sum(cost_usd) AS c, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM call GROUP BY 1)""", name=f"cost_share_by_{_by}")(_share)


@query("A-53", """
SELECT agent_id, round(CAST(sum(cost_usd) AS DOUBLE), 10) AS total_cost_usd FROM call GROUP BY agent_id ORDER BY sum(cost_usd) DESC, agent_id LIMIT 5""")
def top_spenders_by_agent(spark, d):
    return C.top_spenders(C.cost_by(S.calls(spark, d), "agent"), "agent_id", 5)


@query("A-53", """
SELECT CAST(team_id AS BIGINT) AS team_id, round(CAST(sum(cost_usd) AS DOUBLE), 10) AS total_cost_usd FROM call
GROUP BY team_id ORDER BY sum(cost_usd) DESC, team_id LIMIT 5""")
def top_spenders_by_team(spark, d):
    return C.top_spenders(C.cost_by(S.calls(spark, d), "team"), "team_id", 5)


@query("A-52", """
SELECT cost_center, date, t AS total_tokens, round(c, 10) AS total_cost_usd,
  CAST(lag(t) OVER w AS DOUBLE) AS total_tokens_prev, round((t - lag(t) OVER w) / CAST(lag(t) OVER w AS DOUBLE), 6) AS total_tokens_change,
  round(lag(c) OVER w, 6) AS total_cost_usd_prev, round((c - lag(c) OVER w) / nullif(lag(c) OVER w, 0), 6) AS total_cost_usd_change
FROM (SELECT cost_center, date, total_tokens AS t, CAST(total_cost_usd AS DOUBLE) AS c FROM ccd)
WINDOW w AS (PARTITION BY cost_center ORDER BY date)""")
def day_over_day(spark, d):
    mart = S.cost_center_daily(spark, d).select("cost_center", "date", "total_tokens", "total_cost_usd")
    return C.day_over_day(mart, ["cost_center"], ["total_tokens", "total_cost_usd"])


@query("A-09", """
SELECT agent_id, tool_name, date_trunc('hour', ts) AS hour, count(*) AS invocation_count, count(*) FILTER (status = 'success') AS success_count,
  count(*) FILTER (status = 'error') AS error_count, round(avg(duration_ms), 6) AS avg_duration_ms, max(duration_ms) AS max_duration_ms,
  min(duration_ms) AS min_duration_ms, round(stddev_samp(duration_ms), 6) AS stddev_duration_ms,
  round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate, strftime(date_trunc('hour', ts), '%Y-%m-%d') AS date
FROM tool GROUP BY agent_id, tool_name, date_trunc('hour', ts)""")
def tool_usage_hourly(spark, d):
    return T.tool_usage_hourly(S.events(spark, d))


@query("A-10", """
SELECT agent_id, tool_name, strftime(ts, '%Y-%m-%d') AS date, count(*) AS total_invocations, count(*) FILTER (status = 'success') AS total_successes,
  count(*) FILTER (status = 'error') AS total_errors, round(avg(duration_ms), 6) AS avg_duration_ms,
  quantile_disc(duration_ms, 0.5) AS p50_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms,
  quantile_disc(duration_ms, 0.99) AS p99_duration_ms, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate
FROM tool GROUP BY ALL""")
def tool_performance_daily(spark, d):
    return T.tool_performance_daily(S.events(spark, d))


@query("W-02 W-01", """
SELECT event_id, row_number() OVER w AS sequence_position, lag(tool_name) OVER w AS prev_tool, tool_name
FROM ev WHERE event_type = 'tool_call_start' WINDOW w AS (PARTITION BY trace_id ORDER BY ts, event_id)""")
def previous_tool(spark, d):
    return T.with_previous_tool(S.events(spark, d)).select("event_id", "sequence_position", "prev_tool", "tool_name")


@query("A-11 W-02", """
SELECT agent_id, strftime(ts, '%Y-%m-%d') AS date, prev AS from_tool, tool_name AS to_tool, count(*) AS transition_count
FROM (SELECT *, lag(tool_name) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS prev FROM ev WHERE event_type = 'tool_call_start')
WHERE prev IS NOT NULL GROUP BY ALL""")
def tool_transitions(spark, d):
    return T.tool_transitions(S.events(spark, d))


@query("A-46", """
SELECT tool_name, count(*) AS invocation_count, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate,
  round(avg(duration_ms), 6) AS avg_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms FROM tool GROUP BY tool_name""")
def tool_metrics(spark, d):
    return T.tool_metrics(S.events(spark, d))


@query("A-54", """
SELECT server_name, method, count(*) AS calls, count(*) FILTER (NOT success) AS failures, round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate,
  round(avg(duration_ms), 6) AS avg_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms
FROM ev WHERE event_type = 'mcp_call_end' GROUP BY server_name, method""")
def mcp_calls(spark, d):
    return T.mcp_calls(S.events(spark, d))


_PATTERNS = """
SELECT pat.*, round(occurrence_count / n * 100.0, 6) AS frequency_percentage, 'unresolved' AS resolution_status
FROM pat JOIN (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY 1) USING (date)"""


@query("A-12 A-13 F-04 UD-03 P-04", _PATTERNS)
def error_patterns_daily(spark, d):
    return E.error_patterns(S.events(spark, d))


@query("A-14", """
SELECT date_trunc('hour', ts) AS hour, etype AS error_type, count(*) AS error_count, count(DISTINCT agent_id) AS affected_agents,
  count(DISTINCT trace_id) AS affected_traces FROM fp GROUP BY date_trunc('hour', ts), etype""")
def error_trends_hourly(spark, d):
    return E.error_trends_hourly(S.events(spark, d))


@query("A-44", """
SELECT etype AS error_type, count(*) AS count, count(DISTINCT agent_id) AS affected_agents,
  round(count(*) * 100.0 / (SELECT count(*) FROM fp), 6) AS percentage FROM fp GROUP BY etype ORDER BY count(*) DESC, etype LIMIT 3""")
def top_errors(spark, d):
    return E.top_errors(S.events(spark, d), 3)


def _split(spark, d):
    """Patterns of all days up to the 15th as the master's source, later days as the new batch."""
    daily = E.error_patterns(S.events(spark, d))
    early = daily.filter("date <= DATE'2024-01-15'")
    late = daily.filter("date > DATE'2024-01-15'")
    none = spark.createDataFrame([], "error_fingerprint string, resolution_status string")
    return E.rebuild_master(early, none), late


_FOLD = """
SELECT error_fingerprint, min(agent_id) AS agent_id, min(event_type) AS event_type, min(error_type) AS error_type,
  (list(sample_error_message ORDER BY first_seen, sample_error_message))[1] AS sample_error_message,
  CAST(sum(occurrence_count) AS BIGINT) AS occurrence_count, min(first_seen) AS first_occurrence, max(last_seen) AS last_occurrence,
  'unresolved' AS resolution_status FROM pat {where} GROUP BY error_fingerprint"""
_EARLY = _FOLD.format(where="WHERE date <= '2024-01-15'")
_LATE = _FOLD.format(where="WHERE date > '2024-01-15'")


@query("J-04 U-04 A-53", f"SELECT * FROM ({_LATE}) WHERE error_fingerprint NOT IN (SELECT error_fingerprint FROM ({_EARLY}))")
def new_error_patterns(spark, d):
    master, late = _split(spark, d)
    return E.new_patterns(late, master)


@query("J-05 S-07", f"""
SELECT l.error_fingerprint, l.occurrence_count + e.occurrence_count AS total_count, l.last_occurrence
FROM ({_LATE}) l JOIN ({_EARLY}) e USING (error_fingerprint)""")
def existing_pattern_updates(spark, d):
    master, late = _split(spark, d)
    return E.existing_pattern_updates(late, master)


@query("J-06", f"""
SELECT coalesce(e.error_fingerprint, l.error_fingerprint) AS error_fingerprint, coalesce(e.agent_id, l.agent_id) AS agent_id,
  coalesce(e.event_type, l.event_type) AS event_type, coalesce(e.error_type, l.error_type) AS error_type,
  coalesce(e.sample_error_message, l.sample_error_message) AS sample_error_message,
  coalesce(e.occurrence_count, 0) + coalesce(l.occurrence_count, 0) AS occurrence_count,
  coalesce(e.first_occurrence, l.first_occurrence) AS first_occurrence, coalesce(l.last_occurrence, e.last_occurrence) AS last_occurrence,
  'unresolved' AS resolution_status
FROM ({_EARLY}) e FULL JOIN ({_LATE}) l ON e.error_fingerprint = l.error_fingerprint""")
def merged_error_patterns(spark, d):
    master, late = _split(spark, d)
    return E.merge_patterns(late, master)


_TRACE = """trace_id, agent_id, start_time, end_time, duration_ms, status, event_count, llm_call_count, tool_call_count,
  total_prompt_tokens, total_completion_tokens, total_tokens, error_count, models_used_str, tools_used_str, root_span_name, date"""


@query("A-15 A-16 W-03 U-03", f"SELECT {_TRACE}, round(total_cost_usd, 10) AS total_cost_usd FROM tr")
def traces_archive(spark, d):
    return S.traces(spark, d).select(*[c.strip() for c in _TRACE.replace("\n", "").split(",")], "total_cost_usd")


@query("A-15 F-19", """
SELECT trace_id, agent_id, CAST((seq - 1) // 10 AS BIGINT) AS chunk, count(*) AS items, CAST(sum(seq) AS BIGINT) AS seq_sum, min(event_id) AS first_id
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS seq FROM ev) GROUP BY ALL""")
def trace_documents(spark, d):
    docs = R.trace_documents(S.events(spark, d), chunk=10)
    items = F.from_json("full_trace_json", "array<struct<sequence_number:bigint,event_id:string>>")
    return docs.withColumn("x", items).select(
        "trace_id", "agent_id", "chunk", "items",
        F.aggregate("x", F.lit(0).cast("bigint"), lambda a, e: a + e["sequence_number"]).alias("seq_sum"),
        F.array_min(F.transform("x", lambda e: e["event_id"])).alias("first_id"),
    )


@query("A-15", """
SELECT trace_id, agent_id, CAST((n - 1) // 5 AS BIGINT) AS chunk, count(*) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, agent_id ORDER BY ts, event_id) AS n FROM ev WHERE error_type IS NOT NULL OR error_message IS NOT NULL)
GROUP BY ALL""")
def trace_errors(spark, d):
    return R.trace_errors(S.events(spark, d), chunk=5).drop("errors_json")


@query("W-01", "SELECT event_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS sequence_number FROM ev")
def event_sequence(spark, d):
    return R.with_sequence(S.events(spark, d)).select("event_id", "sequence_number")


@query("W-03", """
SELECT trace_id, (list(name ORDER BY ts, event_id) FILTER (parent_span_id IS NULL AND name IS NOT NULL))[1] AS root_span_name,
  nullif((list(coalesce(status, '') ORDER BY ts DESC, event_id DESC))[1], '') AS final_status FROM ev GROUP BY trace_id""")
def root_and_final(spark, d):
    return R.root_and_final(S.events(spark, d))


@query("A-17", """
SELECT agent_id, date, count(*) AS total_traces, count(*) FILTER (status = 'success') AS successful_traces,
  count(*) FILTER (status = 'error') AS failed_traces, round(avg(duration_ms), 2) AS avg_duration_ms,
  round(avg(event_count), 6) AS avg_events_per_trace, round(avg(llm_call_count), 6) AS avg_llm_calls_per_trace,
  round(avg(tool_call_count), 6) AS avg_tool_calls_per_trace, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  quantile_disc(duration_ms, 0.5) AS p50_duration_ms, quantile_disc(duration_ms, 0.95) AS p95_duration_ms,
  quantile_disc(duration_ms, 0.99) AS p99_duration_ms, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate
FROM tr GROUP BY agent_id, date""")
def trace_statistics_daily(spark, d):
    stats = R.trace_statistics(S.traces(spark, d))
    return stats.withColumn("avg_duration_ms", F.round("avg_duration_ms", 2))


_OUT = "trace_id, agent_id, duration_ms, llm_call_count, tool_call_count, error_count, total_tokens, date"


@query("A-18", f"SELECT {_OUT}, 'slow_trace' AS anomaly_type FROM tr WHERE duration_ms > (SELECT quantile_disc(duration_ms, 0.95) FROM tr)")
def slow_traces(spark, d):
    return R.slow_traces(S.traces(spark, d))


@query("A-19", " UNION ALL ".join(
    f"SELECT {_OUT}, '{k}' AS anomaly_type FROM tr WHERE {c} > (SELECT quantile_disc({c}, 0.95) FROM tr)" for k, c in R.OUTLIER_KINDS.items()))
def trace_anomalies(spark, d):
    return R.trace_anomalies(S.traces(spark, d))


_SPAN = "span_id, trace_id, agent_id, span_type, name, start_time, end_time, duration_ms, status, error_message, total_tokens"


@query("J-13 ST-06", f"SELECT {_SPAN} FROM sp")
def paired_spans(spark, d):
    return S.spans(spark, d).select(*[c.strip() for c in _SPAN.split(",")])


@query("W-04 T-09", """
SELECT span_id, CAST(epoch_us(start_time) // 1000 - epoch_us(min(start_time) OVER (PARTITION BY trace_id)) // 1000 AS BIGINT) AS offset_ms FROM sp""")
def span_offsets(spark, d):
    return R.with_span_offset(S.spans(spark, d)).select("span_id", "offset_ms")


@query("J-20", """
WITH RECURSIVE tree AS (
  SELECT span_id, span_id AS root_span_id, CAST(0 AS BIGINT) AS depth, span_id AS path FROM cs WHERE parent_span_id IS NULL OR parent_span_id NOT IN (SELECT span_id FROM cs)
  UNION ALL SELECT c.span_id, t.root_span_id, t.depth + 1, t.path || '/' || c.span_id FROM cs c JOIN tree t ON c.parent_span_id = t.span_id)
SELECT span_id, root_span_id, depth, path FROM tree""")
def span_tree(spark, d):
    return R.span_tree(S.conversation_spans(spark, d)).select("span_id", "root_span_id", "depth", "path")


@query("P-20", "SELECT trace_id, count(*) AS span_count FROM cs GROUP BY trace_id")
def nested_span_counts(spark, d):
    spans = S.conversation_spans(spark, d)
    nested = spans.groupBy("trace_id").agg(F.collect_list(F.struct("span_id", "name")).alias("spans"))
    return nested.select("trace_id", R.span_count("spans").alias("span_count"))


@query("P-20", "SELECT trace_id, span_id, name FROM cs")
def exploded_spans(spark, d):
    spans = S.conversation_spans(spark, d)
    return R.explode_spans(spans.groupBy("trace_id").agg(F.collect_list(F.struct("span_id", "name")).alias("spans")))


@query("F-17", """
SELECT agent_id, '$' || CASE WHEN c < 0.01 THEN printf('%.4f', c) WHEN c < 1 THEN printf('%.3f', c) ELSE printf('%.2f', c) END AS shown
FROM (SELECT agent_id, CAST(sum(cost_usd) AS DOUBLE) AS c FROM call GROUP BY agent_id)""")
def formatted_costs(spark, d):
    sums = S.calls(spark, d).groupBy("agent_id").agg(F.sum("cost_usd").cast("double").alias("c"))
    return sums.select("agent_id", fmt_cost(F.col("c")).alias("shown"))


@query("A-28", "SELECT count(DISTINCT agent_id) AS unique_agents FROM tr")
def approx_agents(spark, d):
    from ...operators.metrics import approx_agents as approx

    return approx(S.traces(spark, d), 0.01)


@query("A-28", "SELECT count(DISTINCT agent_id) AS unique_agents FROM tr")
def agents_from_sketches(spark, d):
    from ...operators.metrics import agent_sketches, agents_from_sketches as merge

    return merge(agent_sketches(S.traces(spark, d)))


@query("T-02", """
SELECT agent_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id) AS r FROM er) WHERE r <= 3""")
def latest_errors_per_agent(spark, d):
    return O.latest_per(S.errors(spark, d), "agent_id", 3).select("agent_id", "event_id")


@query("A-47", """
SELECT '2024-01-15' AS date, count(*) AS total_traces, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate, round(sum(total_cost_usd), 6) AS total_cost,
  count(DISTINCT agent_id) AS active_agents, round(avg(duration_ms), 2) AS avg_latency_ms, quantile_disc(duration_ms, 0.95) AS p95_latency_ms,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, (SELECT count(*) FROM al WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15') AS total_alerts,
  (SELECT count(*) FROM al WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15' AND lower(severity) = 'critical') AS critical_alerts,
  (SELECT count(*) FROM ev WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15' AND event_type = 'llm_call_end') AS llm_calls
FROM tr WHERE strftime(start_time, '%Y-%m-%d') = '2024-01-15'""")
def daily_report(spark, d):
    from datetime import date

    from ..daily import daily_report as report

    out = report(S.traces(spark, d), S.alerts(spark, d), S.events(spark, d), date(2024, 1, 15))
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 2))


@query("A-51 S-06 S-08 S-21", """
SELECT 'events' AS mart, count(*) AS n FROM ev UNION ALL
SELECT 'traces_archive', count(*) FROM tr UNION ALL
SELECT 'cost_by_team_daily', count(*) FROM (SELECT DISTINCT team_id, strftime(ts, '%Y-%m-%d') FROM call) UNION ALL
SELECT 'tool_transitions', count(*) FROM (SELECT DISTINCT agent_id, strftime(ts, '%Y-%m-%d'), prev, tool_name FROM (
  SELECT *, lag(tool_name) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS prev FROM ev WHERE event_type = 'tool_call_start') WHERE prev IS NOT NULL)""")
def daily_run(spark, d):
    """The whole batch over raw JSON files, kept as one load day."""
    from datetime import date

    from ...session import scratch_path
    from ..daily import load_day, run_daily

    base, store, day = scratch_path(spark, "raw"), scratch_path(spark, "store"), date(2024, 1, 30)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
    S.events(spark, d).select("*", stamp).drop("ts", "ingestion_ts").write.json(f"{base}/raw/events/{day:%Y/%m/%d}/00")
    events = load_day(spark, base, store, day)
    run_daily(spark, events, S.agents(spark, d), S.budgets(spark, d), store, day, ASOF)
    size = lambda t: spark.read.parquet(f"{store}/{t}").agg(F.lit(t).alias("mart"), F.count(F.lit(1)).alias("n"))
    return size("events").unionByName(size("traces_archive")).unionByName(size("cost_by_team_daily")).unionByName(size("tool_transitions"))
