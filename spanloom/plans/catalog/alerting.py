"""Anomalies, alerts, rules, region health, investigations, remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import keys as K, text as X
from ...operators import alerts as A, anomalies as N, events as P, investigations as I, reliability as H, remediation as Z
from .. import sample as S
from ..sample import ASOF
from .registry import query

DAY = "ts >= :asof - INTERVAL 1440 MINUTE AND ts <= :asof"


@query("A-38 F-13", f"""
SELECT 'high_error_rate' AS anomaly_type, agent_id, CASE WHEN n >= 10 THEN 'critical' ELSE 'warning' END AS severity, :asof AS timestamp,
  CAST(n AS DOUBLE) AS error_count, m AS messages
FROM (SELECT agent_id, count(*) AS n, array_to_string(list(substr(error_message, 1, 200) ORDER BY ts, event_id)[1:5], '|') AS m FROM er WHERE {DAY} GROUP BY agent_id) WHERE n >= 5""")
def error_burst_anomalies(spark, d):
    out = N.error_burst_anomalies(S.errors(spark, d), ASOF, minutes=1440)
    return out.select(
        "anomaly_type", "agent_id", "severity", "timestamp", F.col("metrics")["error_count"].alias("error_count"),
        F.array_join("recent_errors.error_message", "|").alias("messages"),
    )


@query("A-37 F-13", f"""
SELECT 'high_latency' AS anomaly_type, agent_id, CASE WHEN a >= 10000 THEN 'critical' ELSE 'warning' END AS severity, round(a, 2) AS avg_ms, round(m, 2) AS max_ms, CAST(n AS DOUBLE) AS n
FROM (SELECT agent_id, avg(measure_value) AS a, max(measure_value) AS m, count(*) AS n FROM points WHERE measure_name = 'duration_ms' AND {DAY} GROUP BY agent_id) WHERE a > 5000""")
def latency_anomalies(spark, d):
    m = F.col("metrics")
    return N.latency_anomalies(S.points(spark, d), ASOF, minutes=1440).select(
        "anomaly_type", "agent_id", "severity", m["avg_latency_ms"].alias("avg_ms"), m["max_latency_ms"].alias("max_ms"), m["sample_count"].alias("n")
    )


@query("A-39", """
SELECT agent_id, CASE WHEN r >= 0.2 THEN 'critical' ELSE 'warning' END AS severity, round(r, 6) AS rate FROM (
  SELECT agent_id, count(*) FILTER (status = 'error') / count(*) AS r FROM tr WHERE start_time >= :asof - INTERVAL 14400 MINUTE AND start_time <= :asof GROUP BY agent_id) WHERE r > 0.1""")
def error_rate_anomalies(spark, d):
    out = N.error_rate_anomalies(S.traces(spark, d), ASOF, minutes=14400)
    return out.select("agent_id", "severity", F.col("metrics")["error_rate"].alias("rate"))


@query("U-01", f"""
SELECT anomaly_type, count(*) AS n FROM (
  SELECT 'high_error_rate' AS anomaly_type FROM er WHERE {DAY} GROUP BY agent_id HAVING count(*) >= 5
  UNION ALL SELECT 'high_latency' FROM points WHERE measure_name = 'duration_ms' AND {DAY} GROUP BY agent_id HAVING avg(measure_value) > 5000) GROUP BY anomaly_type""")
def anomaly_union(spark, d):
    out = N.union_anomalies(
        N.error_burst_anomalies(S.errors(spark, d), ASOF, minutes=1440), N.latency_anomalies(S.points(spark, d), ASOF, minutes=1440)
    )
    return out.groupBy("anomaly_type").agg(F.count("*").alias("n"))


WINDOWED = """
SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, agent_id, h.t AS anomaly_type, h.s AS severity, h.v AS value FROM (
  SELECT w, agent_id, unnest([CASE WHEN e >= 3 THEN {'t': 'high_error_rate', 's': CASE WHEN e >= 6 THEN 'critical' ELSE 'warning' END, 'v': CAST(e AS DOUBLE)} END,
    CASE WHEN l > 5000 THEN {'t': 'high_latency', 's': CASE WHEN l >= 10000 THEN 'critical' ELSE 'warning' END, 'v': round(l, 2)} END]) AS h
  FROM (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w, agent_id, count(*) FILTER (event_type = 'error') AS e,
    avg(CASE WHEN event_type LIKE '%!_end' ESCAPE '!' THEN duration_ms END) AS l FROM ev GROUP BY 1, 2)) WHERE h IS NOT NULL"""


@query("A-37 A-38 A-51", WINDOWED)
def windowed_anomalies(spark, d):
    return N.windowed_anomalies(S.events(spark, d), "6 hours", errors_at=3)


@query("W-08", """
SELECT agent_id, make_timestamp((first + 1) * 14400000000) AS alarm_from, make_timestamp((last + 1) * 14400000000) AS alarm_until, breaches, round(peak, 6) AS peak FROM (
  SELECT agent_id, min(slot) AS first, max(slot) AS last, count(*) AS breaches, max(a) AS peak FROM (
    SELECT *, slot - row_number() OVER (PARTITION BY agent_id ORDER BY slot) AS run FROM (
      SELECT agent_id, CAST(epoch_us(ts) // 14400000000 AS BIGINT) AS slot, avg(measure_value) AS a FROM points WHERE measure_name = 'duration_ms' GROUP BY 1, 2) WHERE a > 5000)
  GROUP BY agent_id, run) WHERE breaches >= 2""")
def metric_alarms(spark, d):
    pts = S.points(spark, d).filter("measure_name = 'duration_ms'")
    return N.alarm_state(pts, ["agent_id"], 5000, 2, period_s=14400)


_PREV = "OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"


@query("W-11", f"""
SELECT event_id, duration_ms FROM (SELECT event_id, duration_ms, avg(duration_ms) {_PREV} AS m, stddev_samp(duration_ms) {_PREV} AS s, count(*) {_PREV} AS n
  FROM ev WHERE duration_ms IS NOT NULL) WHERE n > 1 AND abs(duration_ms - m) > 3 * s""")
def zscore_outliers(spark, d):
    rows = S.events(spark, d).filter("duration_ms IS NOT NULL").select("event_id", "agent_id", "ts", "duration_ms")
    return N.outliers(rows, "duration_ms").select("event_id", "duration_ms")


@query("W-11", f"""
SELECT event_id, duration_ms FROM (SELECT event_id, duration_ms, avg(duration_ms) {_PREV} AS m FROM ev WHERE duration_ms IS NOT NULL) WHERE duration_ms > 2 * m""")
def baseline_outliers(spark, d):
    rows = S.events(spark, d).filter("duration_ms IS NOT NULL").select("event_id", "agent_id", "ts", "duration_ms")
    return N.outliers(rows, "duration_ms", "baseline").select("event_id", "duration_ms")


@query("W-11", """
SELECT event_id, duration_ms FROM ev JOIN (SELECT agent_id, quantile_disc(duration_ms, 0.25) AS a, quantile_disc(duration_ms, 0.75) AS b FROM ev GROUP BY agent_id) USING (agent_id)
WHERE duration_ms < a - 1.5 * (b - a) OR duration_ms > b + 1.5 * (b - a)""")
def iqr_outliers(spark, d):
    rows = S.events(spark, d).filter("duration_ms IS NOT NULL").select("event_id", "agent_id", "ts", "duration_ms")
    return N.outliers(rows, "duration_ms", "iqr").select("event_id", "duration_ms")


# ---- alerts ----


@query("F-05 F-06", """
SELECT alert_id, sha256(agent_id || '|' || anomaly_type || '|' || metric_names) AS alert_fingerprint,
  sha256(agent_id || '|' || anomaly_type || '|' || substr('root ' || trace_id, 1, 100)) AS by_text FROM al""")
def alert_fingerprints(spark, d):
    a = A.with_fingerprint(S.alerts(spark, d))
    text = K.alert_fingerprint_text(F.col("agent_id"), F.col("anomaly_type"), F.concat(F.lit("root "), F.col("trace_id")))
    return a.select("alert_id", "alert_fingerprint", text.alias("by_text"))


@query("ST-07", """
SELECT alert_id, CASE WHEN severity IN ('critical', 'warning', 'info') THEN severity ELSE 'info' END AS topic, severity IN ('critical', 'warning') AS page FROM al""")
def alert_topics(spark, d):
    return A.with_topic(S.alerts(spark, d)).select("alert_id", "topic", "page")


DEDUP = """
WITH RECURSIVE a AS (SELECT *, agent_id || '|' || anomaly_type || '|' || metric_names AS fp FROM al),
sends AS (SELECT fp, min(ts) AS ts FROM a GROUP BY fp
  UNION ALL SELECT s.fp, (SELECT min(x.ts) FROM a x WHERE x.fp = s.fp AND x.ts >= s.ts + INTERVAL 24 HOUR) AS ts FROM sends s WHERE s.ts IS NOT NULL)
SELECT alert_id, sent, sent_by FROM (
  SELECT a.alert_id, max(s.ts) = a.ts AS sent, max(s.ts) AS sent_by FROM a JOIN sends s ON s.fp = a.fp AND s.ts <= a.ts GROUP BY a.alert_id, a.ts)"""


@query("ST-03", DEDUP)
def deduplicated_alerts(spark, d):
    return A.dedup_alerts(A.with_fingerprint(S.alerts(spark, d))).select("alert_id", "sent", "sent_by")


@query("ST-03", DEDUP)
def deduplicated_alerts_by_slices(spark, d):
    return A.dedup_alerts(A.with_fingerprint(S.alerts(spark, d)), F.lit(24.0)).select("alert_id", "sent", "sent_by")


@query("ST-03 P-16")
def alert_cache(spark, d):
    return A.alert_cache(A.dedup_alerts(A.with_fingerprint(S.alerts(spark, d))))


@query("A-29", """
SELECT count(*) AS total, count(*) FILTER (lower(severity) = 'critical') AS critical, count(*) FILTER (lower(severity) = 'warning') AS warning,
  count(*) FILTER (lower(severity) = 'info') AS info FROM al WHERE status = 'open'""")
def open_alert_counts(spark, d):
    return A.open_alert_counts(S.alerts(spark, d))


@query("J-16", """
SELECT alert_id, investigation_id, root_cause, investigation_id IS NOT NULL AS has_investigation FROM al LEFT JOIN inv USING (alert_id)""")
def alerts_with_investigation(spark, d):
    out = A.alerts_with_investigation(S.alerts(spark, d), S.investigations(spark, d))
    return out.select("alert_id", "investigation.investigation_id", "investigation.root_cause", "has_investigation")


@query("P-12", "SELECT alert_id, ts FROM al WHERE status = 'open' AND severity = 'critical' ORDER BY ts DESC, alert_id LIMIT 25")
def listed_alerts(spark, d):
    return A.list_alerts(S.alerts(spark, d), 25, status="open", severity="critical").select("alert_id", "ts")


@query("J-17 ST-08", """
SELECT alert_id AS message_id, connection_id FROM (SELECT *, CASE WHEN k % 20 = 0 THEN NULL ELSE agent_id END AS who FROM al)
JOIN (SELECT 'conn-' || s_suppkey AS connection_id, ['high_error_rate', 'high_latency', 'error_rate'][s_suppkey % 3 + 1] AS t,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'agent-' || (s_suppkey % 25) END AS f FROM supplier) ON t = anomaly_type AND (f IS NULL OR who IS NULL OR f = who)""")
def subscription_fanout(spark, d):
    b = S.base_rows(spark, d).select(F.concat(F.lit("al-"), F.col("id").cast("string")).alias("message_id"), "k")
    msgs = S.alerts(spark, d).select(F.col("alert_id").alias("message_id"), F.col("anomaly_type").alias("message_type"), "agent_id").join(b, "message_id")
    msgs = msgs.withColumn("agent_id", F.when(F.col("k") % 20 != 0, F.col("agent_id")))
    return A.route_to_subscriptions(msgs, S.subscriptions(spark, d)).select("message_id", "connection_id")


@query("J-18", """
SELECT alert_id, team_name, channel FROM al JOIN (
  SELECT n_name AS team_name, ['critical', 'warning', 'info'][n_nationkey % 3 + 1] AS s, CASE WHEN n_nationkey % 5 = 0 THEN '.*' ELSE 'agent-' || (n_nationkey % 10) || '[0-9]*' END AS p,
    unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['slack', 'pagerduty'] ELSE ['email'] END) AS channel FROM nation WHERE n_nationkey % 6 <> 5)
ON s = severity AND regexp_full_match(agent_id, p)""")
def notification_routes(spark, d):
    return A.route_notifications(S.alerts(spark, d), S.routes(spark, d)).select("alert_id", "team_name", "channel")


_RULES = """
SELECT 'rule-' || n_nationkey AS rule_id, ['error_rate', 'latency', 'token_usage'][n_nationkey % 3 + 1] AS rule_type,
  CASE WHEN n_nationkey % 4 <> 0 THEN 'agent-' || n_nationkey END AS rule_agent, n_nationkey % 2 * 720 AS cooldown,
  CASE WHEN n_nationkey % 5 = 0 THEN 500.0 ELSE [0.05, 5000, 100000][n_nationkey % 3 + 1] END AS threshold FROM nation WHERE n_nationkey % 7 <> 6"""
_BREACH = f"""
SELECT rule_id, agent_id, w AS window_start, v AS value, threshold, cooldown FROM (
  SELECT w, agent_id, unnest([{{'t': 'error_rate', 'v': e}}, {{'t': 'latency', 'v': l}}, {{'t': 'token_usage', 'v': k}}], recursive := true) FROM (
    SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w, agent_id,
      coalesce(count(*) FILTER (status = 'error') / nullif(count(status), 0), 0.0) AS e, avg(duration_ms) AS l, CAST(sum(total_tokens) AS DOUBLE) AS k FROM ev GROUP BY 1, 2))
JOIN ({_RULES}) ON t = rule_type AND (rule_agent IS NULL OR rule_agent = agent_id) WHERE v > threshold"""


@query("ST-04 F-34", f"SELECT rule_id, agent_id, window_start, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold FROM ({_BREACH})")
def rule_breaches(spark, d):
    out = A.evaluate_rules(A.rule_windows(S.events(spark, d), "6 hours"), S.alert_rules(spark, d))
    return out.select("rule_id", "agent_id", "window_start", "value", "threshold")


@query("ST-04", f"""
WITH RECURSIVE x AS ({_BREACH}), sends AS (SELECT rule_id, agent_id, cooldown, min(window_start) AS ts FROM x GROUP BY ALL
  UNION ALL SELECT s.rule_id, s.agent_id, s.cooldown, (SELECT min(y.window_start) FROM x y WHERE y.rule_id = s.rule_id AND y.agent_id = s.agent_id AND y.window_start > s.ts
    AND y.window_start >= s.ts + to_minutes(s.cooldown)) FROM sends s WHERE s.ts IS NOT NULL)
SELECT rule_id, agent_id, ts AS window_start FROM sends WHERE ts IS NOT NULL""")
def fired_rules(spark, d):
    out = A.rule_alerts(A.evaluate_rules(A.rule_windows(S.events(spark, d), "6 hours"), S.alert_rules(spark, d)))
    return out.filter("sent").select("rule_id", "agent_id", "window_start")


@query("S-19 F-17", """
SELECT alert_id, '#' AS mark, CASE severity WHEN 'critical' THEN ':rotating_light:' WHEN 'warning' THEN ':warning:' WHEN 'info' THEN ':information_source:' ELSE ':bell:' END
  || ' ' || upper(severity) || ': ' || anomaly_type AS head, CASE severity WHEN 'critical' THEN '#FF0000' WHEN 'warning' THEN '#FFA500' WHEN 'info' THEN '#0000FF' ELSE '#808080' END AS color FROM al""")
def slack_payloads(spark, d):
    out = A.notification_payloads(S.alerts(spark, d), "slack")
    return out.select(
        "alert_id", F.lit("#").alias("mark"), F.get_json_object("payload", "$.blocks[0].text.text").alias("head"), F.get_json_object("payload", "$.color").alias("color")
    )


@query("S-19 ST-07", """
SELECT alert_id, upper(severity) || ': ' || anomaly_type || ' - ' || agent_id AS summary, agent_id || '-' || anomaly_type AS dedup_key, severity
FROM al WHERE severity IN ('critical', 'warning')""")
def pagerduty_payloads(spark, d):
    out = A.notification_payloads(S.alerts(spark, d), "pagerduty")
    j = lambda p: F.get_json_object("payload", p)
    return out.select("alert_id", j("$.payload.summary").alias("summary"), j("$.dedup_key").alias("dedup_key"), j("$.payload.severity").alias("severity"))


@query("S-19", """
SELECT alert_id, CASE upper(severity) WHEN 'CRITICAL' THEN 'attention' WHEN 'HIGH' THEN 'attention' WHEN 'INFO' THEN 'accent' ELSE 'default' END AS style,
  CASE WHEN k % 3 = 0 THEN k || '.00%' END AS rate FROM al""")
def teams_payloads(spark, d):
    out = A.notification_payloads(S.alerts(spark, d), "teams", "https://dash.example.com")
    rate = F.regexp_extract("payload", r'"Error Rate","value":"([^"]*)"', 1)
    return out.select("alert_id", F.get_json_object("payload", "$.style").alias("style"), F.nullif(rate, F.lit("")).alias("rate"))


@query("S-19", """
SELECT alert_id, CASE upper(severity) WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'INFO' THEN '🔵' ELSE '⚪' END || ' [' || upper(severity) || '] ' || anomaly_type || ' - ' || agent_id AS subject FROM al""")
def email_payloads(spark, d):
    out = A.notification_payloads(S.alerts(spark, d), "email")
    return out.select("alert_id", F.get_json_object("payload", "$.subject").alias("subject"))


# ---- region health ----


@query("W-05", """
SELECT region_id, check_id, round(avg(latency_ms) OVER (PARTITION BY region_id ORDER BY ts, check_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_ms FROM chk WHERE ok""")
def rolling_region_latency(spark, d):
    return H.rolling_latency(S.checks(spark, d)).select("region_id", "check_id", "rolling_ms")


_RUNS = """
SELECT *, row_number() OVER (PARTITION BY region_id, run ORDER BY ts, check_id) AS n FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR p <> ok THEN 1 ELSE 0 END) OVER (PARTITION BY region_id ORDER BY ts, check_id) AS run FROM (
    SELECT *, lag(ok) OVER (PARTITION BY region_id ORDER BY ts, check_id) AS p FROM chk))"""


@query("W-06 ST-10", f"""
SELECT region_id, check_id, n AS run_length, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY ts, check_id), 'unknown') AS status FROM (
  SELECT *, CASE WHEN ok AND n >= 2 THEN 'healthy' WHEN NOT ok AND n >= 3 THEN 'unhealthy' WHEN NOT ok THEN 'degraded' END AS v FROM ({_RUNS}))""")
def region_health(spark, d):
    return H.health_timeline(S.checks(spark, d)).select("region_id", "check_id", "run_length", "status")


@query("W-07", f"""
SELECT region_id, min(ts) AS open_from, max(until) AS open_until, count(*) AS failures FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR ts > p THEN 1 ELSE 0 END) OVER (PARTITION BY region_id ORDER BY ts, check_id) AS island FROM (
    SELECT *, lag(until) OVER (PARTITION BY region_id ORDER BY ts, check_id) AS p FROM (
      SELECT region_id, check_id, ts, ts + INTERVAL 3600 SECOND AS until FROM ({_RUNS}) WHERE NOT ok AND n >= 3)))
GROUP BY region_id, island""")
def circuit_intervals(spark, d):
    return H.circuit_intervals(S.checks(spark, d), fails=3, secs=3600)


@query("T-10", f"""
SELECT bucket, region_id, status, row_number() OVER (PARTITION BY bucket ORDER BY priority, is_primary DESC, region_id) AS rank FROM (
  SELECT time_bucket(INTERVAL '24 hours', ts, TIMESTAMP '1970-01-01') AS bucket, region_id, (list(status ORDER BY ts DESC, check_id DESC))[1] AS status FROM (
    SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY ts, check_id), 'unknown') AS status FROM (
      SELECT *, CASE WHEN ok AND n >= 2 THEN 'healthy' WHEN NOT ok AND n >= 3 THEN 'unhealthy' WHEN NOT ok THEN 'degraded' END AS v FROM ({_RUNS}))) GROUP BY 1, 2)
JOIN (SELECT 'region-' || r_regionkey AS region_id, r_regionkey % 3 AS priority, r_regionkey = 1 AS is_primary FROM region) USING (region_id) WHERE status <> 'unhealthy'""")
def ranked_regions(spark, d):
    out = H.rank_regions(H.health_timeline(S.checks(spark, d)), S.regions(spark, d), width="24 hours")
    return out.select("bucket", "region_id", "status", F.col("rank").cast("bigint").alias("rank"))


# ---- investigations ----


def _anomalies(spark, d):
    a = S.alerts(spark, d)
    return a.select(F.col("alert_id").alias("anomaly_id"), "agent_id", "anomaly_type", "ts")


@query("J-11", """
SELECT al.alert_id AS anomaly_id, r AS rank, i.investigation_id, coalesce(i.root_cause, 'Unknown') AS root_cause, i.resolution_notes AS resolution FROM al JOIN (
  SELECT *, row_number() OVER (PARTITION BY agent_id, anomaly_type ORDER BY created_at DESC, investigation_id) AS r FROM inv WHERE resolution_status = 'resolved') i
ON al.agent_id = i.agent_id AND al.anomaly_type = i.anomaly_type WHERE r <= 5""")
def similar_incidents(spark, d):
    out = I.similar_incidents(_anomalies(spark, d), S.investigations(spark, d))
    return out.select("anomaly_id", "rank", "investigation_id", "root_cause", "resolution")


@query("J-12", """
SELECT alert_id AS anomaly_id, count(e.error_id) AS error_count, coalesce(array_to_string(list(e.error_id ORDER BY e.ts DESC, e.error_id)[1:10], ','), '') AS newest,
  (SELECT round(avg(measure_value), 6) FROM points p WHERE p.agent_id = any_value(al.agent_id) AND p.measure_name = 'duration_ms' AND p.ts >= any_value(al.ts) - INTERVAL 6 HOUR AND p.ts <= any_value(al.ts)) AS avg_ms
FROM al LEFT JOIN er e ON e.agent_id = al.agent_id AND e.ts >= al.ts - INTERVAL 6 HOUR AND e.ts <= al.ts GROUP BY alert_id""".replace("any_value(al.agent_id)", "al.agent_id").replace("any_value(al.ts)", "al.ts").replace("GROUP BY alert_id", "GROUP BY alert_id, al.agent_id, al.ts"))
def investigation_context(spark, d):
    out = I.investigation_context(_anomalies(spark, d), S.errors(spark, d), S.points(spark, d), hours=6)
    newest = F.coalesce(F.array_join("recent_errors.error_id", ","), F.lit(""))
    return out.filter("anomaly_id IS NOT NULL").select(
        "anomaly_id", "error_count", newest.alias("newest"), F.round(F.col("metrics")["duration_ms"]["avg"], 6).alias("avg_ms")
    )


_PAT1 = "SELECT DISTINCT error_fingerprint, agent_id, error_type FROM pat WHERE event_type = 'error'"


@query("J-09", f"""
SELECT error_fingerprint, 2 + coalesce(v, 0) AS times_applied, round(CASE WHEN v > 0 THEN (0.5 * 2 + h) / (2 + v) ELSE 0.5 END, 6) AS success_rate
FROM (SELECT DISTINCT error_fingerprint FROM ({_PAT1})) LEFT JOIN (
  SELECT error_fingerprint, CAST(count(*) AS BIGINT) AS v, CAST(count(*) FILTER (was_helpful) AS BIGINT) AS h FROM ({_PAT1}) p JOIN inv i ON i.agent_id = p.agent_id AND i.error_type = p.error_type
  JOIN fb USING (investigation_id) GROUP BY error_fingerprint) USING (error_fingerprint)""")
def resolution_feedback(spark, d):
    from ...operators.errors import error_patterns

    pats = error_patterns(S.events(spark, d)).filter("event_type = 'error'")
    known = pats.select("error_fingerprint").distinct().select(
        "error_fingerprint", F.lit(2).cast("bigint").alias("times_applied"), F.lit("0.5000").cast("decimal(5,4)").alias("success_rate")
    )
    return I.apply_feedback(known, S.feedback(spark, d), S.investigations(spark, d), pats)


@query("J-15 F-16", """
SELECT external_id, internal_id, CASE WHEN s IN ('Done', 'Closed') THEN 'resolved' WHEN s IN ('In Progress', 'In Review') THEN 'in_progress' ELSE 'open' END AS internal_status, updated_at
FROM (SELECT 'OPS-' || o_custkey AS external_id, 'inv-' || o_custkey AS internal_id,
  ['To Do', 'In Progress', 'In Review', 'Done', 'Closed'][(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC))[1] % 5 + 1] AS s, max(o_orderdate) AS updated_at
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)""")
def synced_ticket_status(spark, d):
    return I.sync_external_status(S.webhooks(spark, d), S.ticket_mapping(spark, d), "jira")


@query("A-49", """
SELECT date, count(*) AS total_investigations, count(*) FILTER (resolution_status = 'resolved' AND auto_resolved) AS auto_resolved,
  count(*) FILTER (resolution_status = 'resolved' AND NOT auto_resolved) AS manual_resolved,
  round(avg(CASE WHEN resolution_status = 'resolved' THEN k END), 6) AS avg_resolution_time_minutes,
  round(avg(cost_usd), 6) AS avg_investigation_cost_usd, round(sum(cost_usd), 6) AS total_investigation_cost_usd,
  count(*) FILTER (severity = 'critical') AS critical_investigations, count(*) FILTER (severity = 'high') AS high_investigations,
  count(*) FILTER (severity = 'medium') AS medium_investigations, count(*) FILTER (severity = 'low') AS low_investigations,
  round(coalesce(count(*) FILTER (root_cause_correct) / nullif(count(root_cause_correct), 0), 0), 6) AS root_cause_accuracy_rate,
  round(count(*) FILTER (was_helpful) / count(was_helpful), 6) AS recommendation_helpfulness_rate
FROM (SELECT inv.*, fb.was_helpful, fb.root_cause_correct, strftime(created_at, '%Y-%m-%d') AS date FROM inv JOIN fb USING (investigation_id)) GROUP BY date""")
def investigation_statistics(spark, d):
    return I.investigation_stats(S.investigations(spark, d), S.feedback(spark, d))


# ---- remediation ----


@query("A-48", "SELECT status, count(*) AS count FROM rem GROUP BY status")
def remediation_counts(spark, d):
    return Z.remediation_counts(S.remediations(spark, d))


@query("F-29", """
SELECT remediation_id, severity <> 'low' AND bool_or(risk_level = 'high' OR regexp_matches(type, 'restart|scale|rollback')) AS requires_approval FROM act GROUP BY remediation_id, severity""")
def approval_rule(spark, d):
    return S.remediations(spark, d).select("remediation_id", Z.requires_approval(F.col("actions"), F.col("severity")).alias("requires_approval"))


@query("F-30", "SELECT investigation_id, CAST(least(k % 7 + 1, 5) AS BIGINT) AS n, 'step 0' AS first FROM inv")
def fallback_plans(spark, d):
    p = Z.fallback_plan(F.col("recommendations"), limit=5)
    return S.investigations(spark, d).select("investigation_id", F.size(p).alias("n"), p[0]["description"].alias("first"))


@query("F-31", """
SELECT a.remediation_id, CASE WHEN count(*) FILTER (a.automated AND NOT a.success AND (s.x IS NULL OR a.x <= s.x)) = 0 AND any_value(a.checks_passed) THEN 'completed' ELSE 'failed' END AS final
FROM act a LEFT JOIN (SELECT remediation_id, min(x) AS x FROM act WHERE automated AND NOT success AND critical GROUP BY remediation_id) s ON s.remediation_id = a.remediation_id GROUP BY a.remediation_id""")
def remediation_outcomes(spark, d):
    return S.remediations(spark, d).select("remediation_id", Z.final_status(F.col("actions"), F.col("checks_passed")).alias("final"))


@query("F-32", "SELECT remediation_id FROM rem WHERE rollback_available AND rollback_deadline >= TIMESTAMP '2024-01-15' AND pre_state IS NOT NULL")
def rollback_candidates(spark, d):
    return Z.rollback_allowed(S.remediations(spark, d), "2024-01-15").select("remediation_id")


@query("F-32", """
SELECT remediation_id, CASE status WHEN 'pending_approval' THEN true WHEN 'approved' THEN false ELSE false END AS can_approve FROM rem""")
def valid_transitions(spark, d):
    return S.remediations(spark, d).select("remediation_id", Z.valid_transition(F.col("status"), F.lit("approved")).alias("can_approve"))


@query("F-29 F-30 F-32", """
SELECT investigation_id, CASE WHEN severity <> 'low' AND k % 6 = 4 THEN 'pending_approval' ELSE 'approved' END AS status,
  created_at + INTERVAL 30 MINUTE AS rollback_deadline, CASE WHEN severity <> 'low' AND k % 6 = 4 THEN created_at + INTERVAL 1 HOUR END AS approval_deadline FROM inv""")
def remediation_plans(spark, d):
    k = F.col("cost_usd") * 128
    action = F.array(F.struct(F.when(k % 6 == 4, "scale_down").otherwise("clear_cache").alias("type"), F.lit("x").alias("description"), F.lit(True).alias("automated"), F.lit("low").alias("risk_level")))
    rows = S.investigations(spark, d).withColumn("actions", action)
    return Z.plan(rows).select("investigation_id", "status", "rollback_deadline", "approval_deadline")


@query("T-08", "SELECT remediation_id, created_at FROM rem WHERE status = 'failed' AND severity = 'high' ORDER BY created_at DESC, remediation_id LIMIT 10")
def listed_remediations(spark, d):
    return Z.list_remediations(S.remediations(spark, d), 1, 10, status="failed", severity="high")[0].select("remediation_id", "created_at")


@query("T-08", """
SELECT count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages, count(*) > 10 AS has_more FROM rem WHERE status = 'failed' AND severity = 'high'""")
def remediation_page_totals(spark, d):
    return Z.list_remediations(S.remediations(spark, d), 1, 10, status="failed", severity="high")[1]
