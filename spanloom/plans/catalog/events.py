"""Event-level operators, scalar functions and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import keys as K, pricing as M, text as X, times as TM
from ...operators import catalog_views as V, events as P, ordered as O, otel, traces as R
from ...sources import feeds, files, tables
from ...session import scratch_path
from .. import sample as S
from ..sample import ASOF
from .registry import query


def _ev(spark, d):
    return S.events(spark, d)


@query("P-01", """
SELECT event_id, coalesce(agent_id, 'unknown') AS agent_id, coalesce(environment, 'unknown') AS environment,
  coalesce(agent_type, 'unknown') AS agent_type, coalesce(agent_version, 'unknown') AS agent_version FROM ev""")
def events_with_defaults(spark, d):
    return P.with_defaults(_ev(spark, d)).select("event_id", "agent_id", "environment", "agent_type", "agent_version")


@query("P-01", """
SELECT event_id, 'agent-x' AS agent_id, 'staging' AS environment, 'crewai' AS agent_type, 'unknown' AS agent_version,
  TIMESTAMP '2024-02-01 00:00:00' AS ingestion_ts, '{"team":"a"}' AS global_tags FROM ev""")
def enriched_events(spark, d):
    batch = {"environment": "staging", "global_tags": {"team": "a"}, "agent_id": "other"}
    out = P.enrich_events(_ev(spark, d), batch, {"agent_id": "agent-x", "agent_type": "crewai"}, "2024-02-01 00:00:00")
    return out.select("event_id", "agent_id", "environment", "agent_type", "agent_version", "ingestion_ts", "global_tags")


@query("P-03", "SELECT event_type, count(*) AS n FROM ev WHERE event_type IN ('tool_call_start', 'tool_call_end') GROUP BY event_type")
def tool_event_counts(spark, d):
    return P.of_types(_ev(spark, d), "tool_call_start", "tool_call_end").groupBy("event_type").agg(F.count("*").alias("n"))


@query("P-04 P-05", """
SELECT event_id, coalesce(status = 'error', false) OR error_type IS NOT NULL OR error_message IS NOT NULL OR event_type = 'error' AS is_error,
  event_type LIKE '%_end' AS is_end FROM ev""")
def event_flags(spark, d):
    return _ev(spark, d).select("event_id", P.is_error().alias("is_error"), P.is_end_event().alias("is_end"))


@query("P-06 S-14", """
SELECT error_id, agent_id, execution_id, ts, error_type, error_message, severity, resolution_status, ttl FROM er""")
def error_records(spark, d):
    return S.errors(spark, d).select(
        "error_id", "agent_id", "execution_id", "ts", "error_type", "error_message", "severity", "resolution_status", "ttl"
    )


@query("P-07", """
SELECT 'e' || o_orderkey AS event_id, CAST(NULL AS VARCHAR) AS agent_id, o_orderstatus AS status FROM orders""")
def projected_to_event_schema(spark, d):
    o = S.table(spark, d, "orders").select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("event_id"), F.col("o_orderstatus").alias("status"), "o_totalprice"
    )
    return files.to_event_schema(o).select("event_id", "agent_id", "status")


@query("P-07", """
SELECT event_id, '{"event_id":"' || event_id || '"' || CASE WHEN tool_name IS NOT NULL THEN ',"tool_name":"' || tool_name || '"' ELSE '' END
  || CASE WHEN status IS NOT NULL THEN ',"status":"' || status || '"' ELSE '' END || '}' AS value FROM ev""")
def events_as_json(spark, d):
    df = _ev(spark, d).select("event_id", "tool_name", "status")
    return df.select("event_id", F.to_json(F.struct("event_id", "tool_name", "status")).alias("value"))


@query("P-08", """
SELECT id, CAST(CASE WHEN k % 3 = 0 OR k % 3 = 1 THEN k * 10 + dur ELSE k END AS BIGINT) AS total FROM b""")
def total_token_default(spark, d):
    b = S.base_rows(spark, d)
    k = F.col("k").cast("bigint")
    total = F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 2, k)
    return b.select("id", X.total_tokens(k * 10, F.col("dur"), total).alias("total"))


@query("P-09", "SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS processing_date FROM ev")
def processing_dates(spark, d):
    return _ev(spark, d).select("event_id", F.date_sub(F.to_date("ts"), 1).alias("processing_date"))


for _p, _i in [("6h", "6 HOUR"), ("24h", "24 HOUR"), ("7d", "7 DAY")]:

    def _recent(spark, d, p=_p):
        return P.in_period(_ev(spark, d), p, ASOF).select("event_id", "ts")

    query("P-10", f"SELECT event_id, ts FROM ev WHERE ts >= :asof - INTERVAL {_i} AND ts <= :asof", name=f"events_in_last_{_p}")(_recent)


@query("P-11", """
SELECT id, CASE id % 5 WHEN 0 THEN :asof - to_minutes(k) WHEN 1 THEN :asof - to_hours(k) WHEN 2 THEN :asof - to_days(k)
  WHEN 3 THEN at0 END AS at
FROM (SELECT *, date_trunc('second', t0) AS at0 FROM b)""")
def parsed_times(spark, d):
    b = S.base_rows(spark, d)
    k, i = F.col("k").cast("string"), F.col("id") % 5
    text = (
        F.when(i == 0, F.concat(k, F.lit("m"))).when(i == 1, F.concat(k, F.lit("h"))).when(i == 2, F.concat(k, F.lit("d")))
        .when(i == 3, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    )
    return b.select("id", TM.parse_time_expr(text, ASOF).alias("at"))


@query("P-12 T-05", """
SELECT trace_id, agent_id, status, start_time FROM tr WHERE status = 'error' AND agent_id = 'agent-3' AND start_time >= TIMESTAMP '2024-01-05'
  AND start_time <= TIMESTAMP '2024-01-28' ORDER BY start_time DESC, trace_id LIMIT 20""")
def filtered_traces(spark, d):
    out = R.list_traces(S.traces(spark, d), 20, "2024-01-05", "2024-01-28", agent_id="agent-3", status="error", name=None)
    return out.select("trace_id", "agent_id", "status", "start_time")


@query("P-13 S-12", """
SELECT event_id, measure_name, measure_value, measure_type, agent_id, environment, event_type, model, provider FROM points""")
def metric_points(spark, d):
    ev = _ev(spark, d)
    pts = P.to_metric_points(ev)
    ids = P.of_types(ev, "execution_end", "llm_call_end", "tool_call_end", "mcp_call_end").select("event_id", "ts", "trace_id")
    return pts.join(ids, ["ts", "trace_id"]).select(
        "event_id", "measure_name", "measure_value", "measure_type", "agent_id", "environment", "event_type", "model", "provider"
    )


@query("A-33", """
SELECT trace_id, ts, max(measure_value) FILTER (measure_name = 'duration_ms') AS duration_ms, sum(measure_value) FILTER (measure_name = 'input_tokens') AS input_tokens,
  sum(measure_value) FILTER (measure_name = 'output_tokens') AS output_tokens, round(sum(measure_value) FILTER (measure_name = 'cost_usd'), 6) AS cost
FROM points GROUP BY trace_id, ts""")
def wide_points(spark, d):
    return P.widen_points(S.points(spark, d), ["trace_id", "ts"])


@query("P-14", "SELECT span_id, duration_ms FROM sp WHERE duration_ms >= 10000 AND duration_ms <= 30000")
def spans_by_duration(spark, d):
    return P.by_duration(S.spans(spark, d), 10000, 30000).select("span_id", "duration_ms")


@query("P-15", "SELECT event_id, trace_id FROM ev WHERE trace_id IN ('7-20240101', '11-20240108')")
def trace_lookup(spark, d):
    return P.lookup_rows(_ev(spark, d), "trace_id", ["7-20240101", "11-20240108"]).select("event_id", "trace_id")


@query("P-15", "SELECT event_id FROM ev WHERE agent_id IN (SELECT agent_id FROM ag WHERE status = 'error')")
def lookup_by_frame(spark, d):
    keys = S.agents(spark, d).filter("status = 'error'")
    return P.lookup_rows(_ev(spark, d), "agent_id", keys).select("event_id")


@query("P-16", "SELECT error_id, ts + INTERVAL 14 DAY AS expires_at FROM er WHERE ts + INTERVAL 14 DAY > :asof")
def unexpired_errors(spark, d):
    return P.drop_expired(P.with_expiry(S.errors(spark, d), 14), ASOF).select("error_id", "expires_at")


@query("P-17", """
SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') >= 365 THEN 'deleted'
  WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') >= 90 THEN 'archive'
  WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') >= 30 THEN 'infrequent' ELSE 'standard' END AS tier FROM orders""")
def storage_tiers(spark, d):
    o = S.table(spark, d, "orders")
    return o.select("o_orderkey", TM.storage_tier(F.to_date("o_orderdate"), "1999-01-01").alias("tier"))


@query("P-18", "SELECT event_id, trace_id FROM ev WHERE CAST('0x' || substr(md5(trace_id || '|7'), 1, 8) AS BIGINT) % 10000 < 2500")
def sampled_traces(spark, d):
    return P.sample_events(_ev(spark, d), 0.25, seed=7).select("event_id", "trace_id")


@query("P-19", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE text END AS response, CAST(NULL AS VARCHAR) AS prompt FROM conversations")
def suppressed_payloads(spark, d):
    c = S.table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("role") != "user", F.col("text")).alias("response")
    )
    return P.suppress_payloads(c, redact_prompts=True, redact_responses=False)


@query("P-23", """
SELECT event_id, ts FROM ev WHERE agent_id = 'agent-4' AND ts >= :asof - INTERVAL 72 HOUR AND ts <= :asof ORDER BY ts, event_id LIMIT 100""")
def execution_trace(spark, d):
    return P.execution_trace(_ev(spark, d), "agent-4", ASOF, hours=72).select("event_id", "ts")


def _keyed(spark, d):
    ev = _ev(spark, d)
    n = F.regexp_extract("agent_id", r"(\d+)$", 1)
    return ev.withColumn("api_key", F.when(F.col("environment") == "staging", "bad").otherwise(F.concat(F.lit("key-"), n)))


@query("J-14 F-33", "SELECT event_id FROM ev WHERE environment <> 'staging' AND agent_id IN (SELECT agent_id FROM ag WHERE is_active)")
def admitted_events(spark, d):
    return P.admit(_keyed(spark, d), S.agents(spark, d))[0].select("event_id")


@query("J-14", "SELECT event_id FROM ev WHERE NOT (environment <> 'staging' AND agent_id IN (SELECT agent_id FROM ag WHERE is_active))")
def rejected_events(spark, d):
    return P.admit(_keyed(spark, d), S.agents(spark, d))[1].select("event_id")


@query("F-03", """
SELECT event_id, round(CAST(coalesce(input_tokens, 0) * p.i + coalesce(output_tokens, 0) * p.o AS DOUBLE) / 1000, 10) AS cost
FROM (SELECT *, CASE WHEN model LIKE '%claude-3-opus%' THEN {'i': 0.015, 'o': 0.075} WHEN model LIKE '%claude-3-haiku%' THEN {'i': 0.00025, 'o': 0.00125}
  WHEN model LIKE '%gpt-4%' THEN {'i': 0.03, 'o': 0.06} WHEN model LIKE '%gpt-3.5-turbo%' THEN {'i': 0.0005, 'o': 0.0015} ELSE {'i': 0.0, 'o': 0.0} END AS p
  FROM ev WHERE event_type = 'llm_call_end')""")
def cost_by_family(spark, d):
    c = M.cost_substring(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return P.of_types(_ev(spark, d), "llm_call_end").select("event_id", c.alias("cost"))


@query("F-04", r"""
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(error_message, '')),
  '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '\d{4}-\d{2}-\d{2}', '<date>', 'g'), '\b\d+\b', '<num>', 'g') AS message
FROM ev WHERE event_type = 'error'""")
def normalised_messages(spark, d):
    return P.of_types(_ev(spark, d), "error").select("event_id", K.normalised_message(F.col("error_message"), "fixed").alias("message"))


@query("F-14", """
SELECT event_id, CASE WHEN model LIKE 'claude%' THEN 'anthropic' WHEN model LIKE 'gpt%' THEN 'openai' ELSE 'unknown' END AS provider
FROM ev WHERE model IS NOT NULL""")
def providers(spark, d):
    return _ev(spark, d).filter("model IS NOT NULL").select("event_id", X.provider_of(F.col("model")).alias("provider"))


@query("F-15 F-16", """
SELECT alert_id, CASE lower(severity) WHEN 'critical' THEN 'Highest' WHEN 'info' THEN 'Low' ELSE 'Medium' END AS priority,
  CAST(CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'info' THEN 3 ELSE 2 END AS BIGINT) AS urgency,
  CAST(CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'info' THEN 3 ELSE 2 END AS BIGINT) AS impact,
  CASE lower(severity) WHEN 'high' THEN 'info' ELSE lower(severity) END AS pager,
  CASE status WHEN 'resolved' THEN 'Done' WHEN 'open' THEN 'To Do' END AS ticket_status FROM al""")
def mapped_severities(spark, d):
    s = F.col("severity")
    return S.alerts(spark, d).select(
        "alert_id", X.map_severity(s, "jira_priority").alias("priority"), X.map_severity(s, "snow_urgency").alias("urgency"),
        X.map_severity(s, "snow_impact").alias("impact"), X.map_severity(s, "pager").alias("pager"),
        X.map_status(F.col("status"), "jira", "out").alias("ticket_status"),
    )


@query("F-17", """
SELECT id, CASE WHEN dur < 1000 THEN dur || 'ms' ELSE '' END AS short,
  CASE WHEN k < 50 THEN substr('value ' || k || ' of trace ' || trace_id, 1, 17) || '...' ELSE 'ok' END AS cut,
  strftime(t0, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM b""")
def formatted_values(spark, d):
    b = S.base_rows(spark, d)
    text = F.concat(F.lit("value "), F.col("k").cast("string"), F.lit(" of trace "), F.col("trace_id"))
    return b.select(
        "id", F.when(F.col("dur") < 1000, X.fmt_duration(F.col("dur"))).otherwise("").alias("short"),
        F.when(F.col("k") < 50, X.truncate(text, 20)).otherwise("ok").alias("cut"), X.fmt_ts(F.col("at")).alias("shown"),
    )


@query("F-18", """
SELECT id, date_trunc('hour', t0) AS hour, time_bucket(INTERVAL '6 hours', t0, TIMESTAMP '1970-01-01') AS bucket, strftime(date_trunc('month', t0), '%Y-%m-%d') AS month FROM b""")
def time_functions(spark, d):
    at = F.col("at")
    return S.base_rows(spark, d).select(
        "id", TM.hour(at).alias("hour"), TM.bucket(at, "6 hours").alias("bucket"), TM.month_start(F.to_date(at)).alias("month")
    )


@query("F-20", "SELECT id, CASE WHEN k % 5 = 0 THEN 0.0 ELSE round(dur / (k % 5), 6) END AS ratio FROM b")
def safe_ratios(spark, d):
    return S.base_rows(spark, d).select("id", X.safe_ratio(F.col("dur"), F.col("k") % 5).alias("ratio"))


@query("F-22", """
SELECT id, CASE WHEN k % 3 = 0 THEN CAST(k AS BIGINT) END AS as_long, CASE WHEN k % 3 = 1 THEN round(value, 6) END AS as_double,
  CASE WHEN k % 3 = 2 THEN trace_id END AS as_text FROM b""")
def coerced_numbers(spark, d):
    k = F.col("k")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.col("value").cast("string")).otherwise(F.col("trace_id"))
    return S.base_rows(spark, d).select("id", X.coerce_number(text).alias("n")).select("id", "n.*")


@query("F-35", "SELECT event_id, sha256(coalesce(error_message, '')) AS stack_key FROM ev WHERE event_type = 'error'")
def stack_hashes(spark, d):
    return P.of_types(_ev(spark, d), "error").select("event_id", K.stack_hash(F.coalesce("error_message", F.lit(""))).alias("stack_key"))


@query("F-27", """
SELECT span_id, CASE span_type WHEN 'execution' THEN 'agent.execution' WHEN 'llm' THEN 'llm.' || coalesce(provider, 'unknown') || '.' || coalesce(model, 'unknown')
    WHEN 'tool' THEN 'tool.' || tool_name ELSE 'mcp.' || server_name || '.' || method END AS otel_name,
  CASE WHEN span_type = 'execution' THEN 'SERVER' WHEN span_type IN ('llm', 'mcp') THEN 'CLIENT' ELSE 'INTERNAL' END AS otel_kind,
  CASE status WHEN 'success' THEN 'OK' WHEN 'error' THEN 'ERROR' ELSE 'UNSET' END AS status_code,
  CASE WHEN status = 'error' THEN coalesce(error_message, 'Unknown error') END AS status_message, agent_id AS agent_attribute FROM sp""")
def otel_spans(spark, d):
    out = otel.otel_spans(S.spans(spark, d))
    return out.select("span_id", "otel_name", "otel_kind", "status_code", "status_message", F.col("attributes")["gen_ai.agent.id"].alias("agent_attribute"))


@query("F-28", """
SELECT span_id, CASE WHEN n > 0 THEN 'error' ELSE status END AS status, n FROM (
  SELECT sp.span_id, any_value(sp.status) AS status, count(e.event_id) AS n FROM sp LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') e ON e.span_id = sp.span_id GROUP BY sp.span_id)""")
def spans_with_events(spark, d):
    out = otel.attach_span_events(S.spans(spark, d), _ev(spark, d))
    return out.select("span_id", "status", F.coalesce(F.array_size("events"), F.lit(0)).alias("n"))


# ---- dimension joins ----


@query("J-07", """
SELECT agent_id, ag.name, n_name AS team_name, r_name AS project_name, ag.cost_center, is_active, coalesce(n, 0) AS active_api_keys
FROM ag LEFT JOIN nation ON team_id = n_nationkey LEFT JOIN region ON project_id = r_regionkey
LEFT JOIN (SELECT 'agent-' || (c_custkey % 150) AS agent_id, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) USING (agent_id)""")
def agent_overview(spark, d):
    out = V.agent_overview(S.agents(spark, d), S.teams(spark, d), S.projects(spark, d), S.api_keys(spark, d))
    return out.select("agent_id", "name", "team_name", "project_name", "cost_center", "is_active", "active_api_keys")


@query("J-19", """
SELECT agent_id, ag.name, n.n_name AS team_name, r_name AS project_name, c_name AS created_by,
  (SELECT count(*) FROM nation x WHERE x.n_nationkey % 4 <> 0 AND 'agent-' || x.n_nationkey = agent_id) AS alert_rule_count
FROM ag JOIN nation n ON team_id = n.n_nationkey JOIN region ON project_id = r_regionkey JOIN customer ON owner_id = c_custkey WHERE is_active""")
def agent_details(spark, d):
    return V.agent_details(S.agents(spark, d), S.teams(spark, d), S.projects(spark, d), S.users(spark, d), S.alert_rules(spark, d))


@query("T-06", "SELECT agent_id, name FROM ag WHERE status = 'active' ORDER BY agent_id LIMIT 10")
def listed_agents(spark, d):
    return V.list_agents(S.agents(spark, d), status="active", limit=10).select("agent_id", "name")


# ---- sources and sinks: written to the shared scratch folder and read back ----


@query("S-06 S-08", """
SELECT date, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM call GROUP BY date""")
def mart_round_trip(spark, d):
    path = scratch_path(spark, "mart")
    mart = S.calls(spark, d).groupBy("date").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"))
    tables.write_mart(mart, path)
    tables.write_mart(mart, path)  # a rerun replaces, it does not add
    return tables.read_table(spark, path)


@query("S-03", "SELECT event_id, event_type, ts, agent_id FROM ev WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def hive_events_round_trip(spark, d):
    path = scratch_path(spark, "hive")
    files.write_hive_events(_ev(spark, d), path)
    back = files.read_hive_events(spark, path).filter("year = '2024' AND month = '01' AND day = '10'")
    return back.select("event_id", "event_type", "ts", "agent_id")


@query("S-01 S-15 P-07", """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, model, total_tokens, status FROM ev""")
def raw_json_round_trip(spark, d):
    path = scratch_path(spark, "raw")
    nested = F.struct(
        "model", "status", "duration_ms", "tool_name",
        F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"), "total_tokens").alias("token_usage"),
        F.when(P.has_error(), F.struct(F.col("error_type").alias("type"), F.col("error_message").alias("message"))).alias("error"),
    )
    legacy = F.regexp_replace("event_type", "^(llm|tool)_call_", "$1_")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = _ev(spark, d).select("event_id", legacy.alias("event_type"), stamp.alias("timestamp"), "agent_id", "trace_id", "span_id", nested.alias("attributes"))
    raw.write.json(path)
    good, _ = files.split_bad_records(files.read_raw_json(spark, path))
    return files.canonical(good).select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "model", "total_tokens", "status")


@query("S-13", "SELECT strftime(ts, '%Y-%m') AS index_month, count(*) AS n FROM ev GROUP BY 1")
def event_index_months(spark, d):
    path = scratch_path(spark, "index")
    feeds.write_event_index(_ev(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("index_month").cast("string").alias("index_month")).agg(F.count("*").alias("n"))


@query("S-12", "SELECT measure_name, count(*) AS n FROM points GROUP BY measure_name")
def stored_metric_points(spark, d):
    path = scratch_path(spark, "points")
    feeds.write_metric_points(S.points(spark, d), path)
    return spark.read.parquet(path).groupBy("measure_name").agg(F.count("*").alias("n"))


@query("S-14", "SELECT error_id, error_type FROM er")
def stored_errors(spark, d):
    path = scratch_path(spark, "errors")
    feeds.write_error_store(S.errors(spark, d), path)
    return spark.read.parquet(path).select("error_id", "error_type")


@query("S-10", "SELECT key, count(*) AS n FROM (SELECT agent_id AS key FROM ev) GROUP BY key")
def keyed_record_counts(spark, d):
    return feeds.keyed_records(_ev(spark, d)).groupBy("key").agg(F.count("value").alias("n"))


@query("S-18", "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM lineitem")
def compacted_lineitem(spark, d):
    small, big = scratch_path(spark, "small"), scratch_path(spark, "big")
    S.table(spark, d, "lineitem").repartition(32).write.parquet(small)
    tables.compact(spark, small, big, ["l_orderkey"])
    return spark.read.parquet(big).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))


@query("A-50 S-20", """
SELECT 'ingest-20240130120000' AS audit_id, 'ingest' AS operation, CAST((SELECT count(*) FROM ev) AS DOUBLE) AS accepted,
  CAST((SELECT count(*) FROM ev WHERE event_type = 'error') AS DOUBLE) AS errors, CAST(1706616000 + 7776000 AS BIGINT) AS ttl""")
def ingest_audit(spark, d):
    out, seen = tables.ingest_counters(_ev(spark, d))
    out.write.format("noop").mode("overwrite").save()
    row = tables.audit_row(spark, "ingest", seen.get, ASOF)
    return row.select("audit_id", "operation", F.col("stats")["accepted"].alias("accepted"), F.col("stats")["errors"].alias("errors"), "ttl")
