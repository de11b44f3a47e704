"""The sample mapping in plain SQL, as named common table expressions.

``sql(body)`` prepends the expressions the body mentions, directly or not.
"""

from __future__ import annotations

import re

from .sample import AGENT_TYPES, ASOF, ENVIRONMENTS, ERROR_TYPES, MODELS, QUESTIONS
from ..functions.pricing import HOURLY_MODELS, PER_MILLION, UNKNOWN_PER_MILLION


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def price(model: str, side: int, models, unknown: str) -> str:
    arms = " ".join(f"WHEN '{m}' THEN {PER_MILLION[m][side]}" for m in models)
    return f"CAST(CASE {model} {arms} ELSE {unknown} END AS DECIMAL(8,2))"


def cost(inp: str, out: str, model: str = "model", models=tuple(PER_MILLION), unknown=UNKNOWN_PER_MILLION) -> str:
    return (
        f"(CAST(coalesce({inp}, 0) AS DECIMAL(18,0)) * {price(model, 0, models, unknown[0])}"
        f" + CAST(coalesce({out}, 0) AS DECIMAL(18,0)) * {price(model, 1, models, unknown[1])})"
        " * CAST(0.000001 AS DECIMAL(7,6))"
    )


def hourly_cost(inp: str, out: str) -> str:
    return cost(inp, out, models=HOURLY_MODELS, unknown=("0", "0"))


CTES = {
    "b": f"""
SELECT event_id AS id, user_id, event_type AS kind, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  ts AS t0, CAST(floor(value * 100) AS BIGINT) AS dur, 'agent-' || (user_id % 20) AS agent_id,
  user_id || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS trace_id,
  {_list(AGENT_TYPES)}[user_id % 20 % 3 + 1] AS agent_type, {_list(ENVIRONMENTS)}[user_id % 3 + 1] AS environment,
  '1.0.' || (user_id % 4) AS agent_version
FROM events""",
    "r": """
SELECT b.*, CASE WHEN kind = 'view' THEN 'llm_call' WHEN kind = 'click' AND k % 7 = 6 THEN 'mcp_call'
    WHEN kind = 'click' THEN 'tool_call' WHEN kind IN ('signup', 'purchase') THEN 'execution' ELSE 'error' END AS family,
  unnest(CASE WHEN kind IN ('view', 'click') THEN ['start', 'end'] WHEN kind = 'signup' THEN ['start']
    WHEN kind = 'purchase' THEN ['end'] ELSE ['error'] END) AS phase
FROM b""",
    "ev": f"""
SELECT id || CASE WHEN phase = 'start' THEN 's' ELSE 'e' END AS event_id,
  CASE WHEN family = 'error' THEN 'error' ELSE family || '_' || phase END AS event_type,
  CASE WHEN phase = 'start' AND family <> 'execution' THEN t0 - to_milliseconds(dur) ELSE t0 END AS ts,
  agent_id, 'run-' || user_id AS execution_id, trace_id,
  CASE WHEN family = 'error' THEN 'sp' || (id - 1 - k % 3) WHEN family = 'execution' THEN 'ex' || id ELSE 'sp' || id END AS span_id,
  CASE WHEN family <> 'execution' THEN trace_id || '-root' END AS parent_span_id,
  CASE family WHEN 'execution' THEN 'run-' || (k % 5) WHEN 'tool_call' THEN 'call tool-' || (k % 7)
    WHEN 'llm_call' THEN 'ask ' || {_list(MODELS)}[k % 6 + 1] WHEN 'mcp_call' THEN 'mcp request' ELSE 'error' END AS name,
  agent_type, agent_version, environment,
  CASE WHEN family = 'llm_call' THEN {_list(MODELS)}[k % 6 + 1] END AS model,
  CASE WHEN family = 'llm_call' AND k % 6 < 2 THEN 'anthropic' WHEN family = 'llm_call' AND k % 6 < 5 THEN 'openai' END AS provider,
  CASE WHEN family = 'llm_call' AND phase = 'end' AND k % 25 <> 24 THEN CAST(k * 10 AS BIGINT) END AS input_tokens,
  CASE WHEN family = 'llm_call' AND phase = 'end' AND k % 25 <> 24 THEN CAST(floor(value) AS BIGINT) END AS output_tokens,
  CASE WHEN family = 'llm_call' AND phase = 'end' AND k % 25 <> 24 THEN k * 10 + CAST(floor(value) AS BIGINT) END AS total_tokens,
  CASE WHEN phase = 'end' THEN CAST(dur AS DOUBLE) END AS duration_ms,
  CASE WHEN family = 'llm_call' AND phase = 'end' AND k % 25 <> 24 AND k % 3 = 0 THEN CAST(k * 10 AS DOUBLE) / 1000 END AS cost,
  CASE WHEN phase = 'end' THEN k % 10 <> 0 END AS success,
  CASE WHEN family = 'error' OR (phase = 'end' AND k % 10 = 0) THEN 'error' WHEN phase = 'end' THEN 'success' END AS status,
  CASE WHEN family = 'tool_call' THEN 'tool-' || (k % 7) END AS tool_name,
  CASE WHEN family = 'mcp_call' THEN 'mcp-' || (k % 3) END AS server_name,
  CASE WHEN family = 'mcp_call' THEN CASE WHEN k % 2 = 0 THEN 'call' ELSE 'list' END END AS method,
  CASE WHEN family = 'error' THEN ['warning', 'error', 'critical'][k % 4 + 1] END AS severity,
  CASE WHEN family = 'error' THEN {_list(ERROR_TYPES)}[k % 5 + 1] WHEN phase = 'end' AND k % 10 = 0 THEN 'CallError' END AS error_type,
  CASE WHEN family = 'error' THEN CASE k % 4
      WHEN 0 THEN 'Request ' || id || ' failed after ' || k || ' retries'
      WHEN 1 THEN 'Timeout on ' || strftime(t0, '%Y-%m-%d') || ' for job ' || k
      WHEN 2 THEN 'Record 123e4567-e89b-12d3-a456-4266' || lpad(CAST(id AS VARCHAR), 8, '0') || ' not found' END
    WHEN phase = 'end' AND k % 10 = 0 THEN 'call failed with code ' || k END AS error_message
FROM r""",
    "trb": f"""
SELECT trace_id, agent_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS event_count,
  count(*) FILTER (event_type = 'llm_call_start') AS llm_call_count,
  count(*) FILTER (event_type = 'tool_call_start') AS tool_call_count,
  CAST(sum(input_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_completion_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN event_type = 'llm_call_end' THEN {cost('input_tokens', 'output_tokens')} END) AS DOUBLE) AS total_cost_usd,
  count(*) FILTER (error_type IS NOT NULL OR error_message IS NOT NULL) AS error_count,
  coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), ','), '') AS models_used_str,
  coalesce(array_to_string(list_sort(list(DISTINCT tool_name) FILTER (tool_name IS NOT NULL)), ','), '') AS tools_used_str,
  (list(name ORDER BY ts, event_id) FILTER (parent_span_id IS NULL AND name IS NOT NULL))[1] AS root_span_name,
  (list(coalesce(status, '') ORDER BY ts DESC, event_id DESC))[1] AS final_status
FROM ev GROUP BY trace_id, agent_id""",
    "tr": """
SELECT trb.*, CAST(date_diff('millisecond', TIMESTAMP '1970-01-01', end_time) - date_diff('millisecond', TIMESTAMP '1970-01-01', start_time) AS BIGINT) AS duration_ms,
  CASE WHEN error_count > 0 THEN 'error' WHEN final_status = 'success' THEN 'success' ELSE 'unknown' END AS status,
  strftime(start_time, '%Y-%m-%d') AS date
FROM trb""",
    "pt": """
SELECT ts, agent_id, agent_type, environment, trace_id, event_type, model, provider, event_id,
  unnest([{'n': 'duration_ms', 'v': duration_ms, 't': 'DOUBLE'},
    {'n': 'input_tokens', 'v': CASE WHEN event_type = 'llm_call_end' AND input_tokens <> 0 THEN CAST(input_tokens AS DOUBLE) END, 't': 'BIGINT'},
    {'n': 'output_tokens', 'v': CASE WHEN event_type = 'llm_call_end' AND output_tokens <> 0 THEN CAST(output_tokens AS DOUBLE) END, 't': 'BIGINT'},
    {'n': 'cost_usd', 'v': CASE WHEN cost > 0 THEN cost END, 't': 'DOUBLE'}]) AS p
FROM ev WHERE event_type LIKE '%!_end' ESCAPE '!'""",
    "points": """
SELECT ts, agent_id, agent_type, environment, trace_id,
  CASE WHEN p.n = 'duration_ms' THEN event_type END AS event_type,
  CASE WHEN p.n IN ('input_tokens', 'output_tokens') THEN model END AS model,
  CASE WHEN p.n IN ('input_tokens', 'output_tokens') THEN coalesce(provider, 'unknown') END AS provider,
  p.n AS measure_name, p.v AS measure_value, p.t AS measure_type, event_id
FROM pt WHERE p.v IS NOT NULL""",
    "er": """
SELECT sha256(agent_id || '|' || execution_id || '|' || epoch_us(ts) || '|' || event_id) AS error_id, event_id, agent_id, execution_id, trace_id, ts,
  coalesce(error_type, 'unknown') AS error_type, coalesce(error_message, '') AS error_message,
  coalesce(severity, 'error') AS severity, 'open' AS resolution_status,
  CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) + 7776000 AS ttl
FROM ev WHERE event_type = 'error'""",
    "ag": f"""
SELECT 'agent-' || s_suppkey AS agent_id, s_name AS name, s_nationkey AS team_id, CAST(s_suppkey % 6 AS INTEGER) AS project_id,
  r_name AS cost_center, {_list(AGENT_TYPES)}[s_suppkey % 3 + 1] AS framework, {_list(ENVIRONMENTS)}[s_suppkey % 3 + 1] AS environment,
  s_acctbal > 0 AS is_active, CASE WHEN s_suppkey % 9 = 0 THEN 'error' WHEN s_acctbal > 0 THEN 'active' ELSE 'inactive' END AS status,
  s_suppkey * 3 AS owner_id
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "call": f"""
SELECT e.agent_id, e.model, e.ts, e.input_tokens, e.output_tokens, e.total_tokens,
  {cost('input_tokens', 'output_tokens')} AS cost_usd, strftime(e.ts, '%Y-%m-%d') AS date, team_id, project_id, cost_center
FROM ev e LEFT JOIN ag USING (agent_id) WHERE event_type = 'llm_call_end' AND total_tokens IS NOT NULL""",
    "ccd": """
SELECT date, cost_center, sum(cost_usd) AS total_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  count(DISTINCT agent_id) AS active_agents, count(DISTINCT team_id) AS active_teams, count(*) AS total_requests
FROM call GROUP BY date, cost_center""",
    "bud": """
SELECT r_name AS cost_center, CASE WHEN r_regionkey < 4 THEN CAST((r_regionkey + 1) * 0.30 AS DECIMAL(10,2)) END AS monthly_budget, CAST(0.80 AS DECIMAL(3,2)) AS alert_threshold
FROM region""",
    "tool": "SELECT * FROM ev WHERE event_type = 'tool_call_end'",
    "fp": r"""
SELECT *, strftime(ts, '%Y-%m-%d') AS date,
  substr(md5(agent_id || ':' || event_type || ':' || coalesce(error_type, 'None') || ':' ||
    regexp_replace(regexp_replace(regexp_replace(lower(coalesce(error_message, '')),
      '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '\b\d+\b', '<num>', 'g'), '\d{4}-\d{2}-\d{2}', '<date>', 'g')), 1, 16) AS error_fingerprint,
  coalesce(error_type, 'Unknown') AS etype, coalesce(error_message, 'No message') AS emsg
FROM ev WHERE status = 'error' OR error_type IS NOT NULL OR error_message IS NOT NULL OR event_type = 'error'""",
    "pat": """
SELECT date, error_fingerprint, agent_id, event_type, etype AS error_type, count(*) AS occurrence_count,
  (list(emsg ORDER BY ts, event_id))[1] AS sample_error_message, min(ts) AS first_seen, max(ts) AS last_seen,
  count(DISTINCT trace_id) AS affected_trace_count,
  coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), ','), '') AS affected_models_list
FROM fp GROUP BY ALL""",
    "al": """
SELECT 'al-' || id AS alert_id, agent_id, ['high_error_rate', 'high_latency', 'error_rate'][k % 3 + 1] AS anomaly_type,
  ['critical', 'warning', 'info', 'HIGH'][k % 4 + 1] AS severity, ['open', 'acknowledged', 'resolved'][id % 3 + 1] AS status, t0 AS ts,
  CASE WHEN k % 3 = 0 THEN 'error_rate,latency_p95' ELSE 'error_count' END AS metric_names, trace_id, k, dur
FROM b WHERE kind = 'error'""",
    "inv": """
SELECT 'inv-' || id AS investigation_id, 'al-' || id AS alert_id, b.agent_id, ['high_error_rate', 'high_latency', 'error_rate'][k % 3 + 1] AS anomaly_type,
  ['critical', 'high', 'medium', 'low'][id % 4 + 1] AS severity, ev.error_type, ev.error_message,
  CASE WHEN k % 3 = 0 THEN 'Cause ' || (k % 7) END AS root_cause, CASE WHEN id % 3 = 0 THEN 'Fix ' || k END AS resolution_notes,
  CASE WHEN id % 3 = 0 THEN 'resolved' ELSE 'open' END AS resolution_status, t0 AS created_at,
  CASE WHEN id % 3 = 0 THEN t0 + to_minutes(k) END AS resolved_at, k % 3 = 1 AS auto_resolved, CAST(k AS DOUBLE) / 128 AS cost_usd, k
FROM b JOIN ev ON ev.event_id = id || 'e' WHERE kind = 'error' AND ev.severity IN ('error', 'critical')""",
    "fb": """
SELECT investigation_id, k % 3 <> 0 AS was_helpful, CASE WHEN k % 8 <> 0 THEN k % 6 <> 0 END AS root_cause_correct FROM inv""",
    "sp": """
SELECT s.span_id, s.trace_id, s.agent_id, s.parent_span_id, s.name, s.model, s.provider, s.tool_name, s.server_name, s.method,
  replace(replace(s.event_type, '_start', ''), '_call', '') AS span_type, s.ts AS start_time, e.ts AS end_time, e.duration_ms,
  CASE WHEN e.ts IS NULL THEN 'running' WHEN e.success THEN 'success' ELSE 'error' END AS status, e.error_message, e.total_tokens
FROM (SELECT * FROM ev WHERE event_type LIKE '%!_start' ESCAPE '!') s
LEFT JOIN (SELECT * FROM ev WHERE event_type LIKE '%!_end' ESCAPE '!') e ON s.span_id = e.span_id AND e.ts >= s.ts""",
    "chk": """
SELECT 'region-' || (user_id % 4) AS region_id, id AS check_id, t0 AS ts, k % 3 <> 0 AS ok, CAST(dur AS DOUBLE) AS latency_ms FROM b""",
    "qs": f"""
SELECT 'q-' || id AS query_id, replace({_list(QUESTIONS)}[id % {len(QUESTIONS)} + 1], '{{k}}', CAST(k AS VARCHAR)) AS query,
  'user-' || (user_id % 10) AS created_by, k % 5 = 0 AS is_shared, t0 AS created_at, CAST(k % 4 AS BIGINT) AS result_count
FROM b WHERE kind = 'click'""",
    "cs": """
SELECT CAST(conv_id AS VARCHAR) AS trace_id, conv_id || '-' || turn AS span_id,
  CASE WHEN turn > 0 THEN conv_id || '-' || ((turn - 1) // 2) END AS parent_span_id, role AS name, role AS span_type, turn, text
FROM conversations""",
    "rem": """
SELECT 'rem-' || id AS remediation_id, agent_id, ['critical', 'high', 'medium', 'low'][id % 4 + 1] AS severity,
  ['pending_approval', 'approved', 'completed', 'failed', 'rejected'][k % 5 + 1] AS status, t0 AS created_at,
  t0 + INTERVAL 30 MINUTE AS rollback_deadline, k % 6 <> 0 AS rollback_available, CASE WHEN k % 5 <> 0 THEN 'state-' || k END AS pre_state,
  k % 8 <> 0 AS checks_passed, k, id
FROM b WHERE kind = 'error'""",
    "act": """
SELECT remediation_id, severity, checks_passed, x,
  ['restart_service', 'scale_up', 'clear_cache', 'update_config', 'rollback_deployment', 'throttle_requests'][(k + x) % 6 + 1] AS type,
  ['low', 'medium', 'high'][(k + x * 2) % 3 + 1] AS risk_level, (k + x) % 4 <> 0 AS automated, (id + x) % 7 <> 0 AS success, (id + x) % 2 = 0 AS critical
FROM (SELECT *, unnest(range(0, k % 4 + 1)) AS x FROM rem)""",
}


def sql(body: str) -> str:
    """``body`` with the expressions it needs; ``:asof`` becomes the fixed time."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+\(?\s*{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    text = body.replace(":asof", f"TIMESTAMP '{ASOF}'")
    if not needed:
        return text
    head = "WITH " if not text.lstrip().upper().startswith("WITH RECURSIVE") else "WITH RECURSIVE "
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    if text.lstrip().upper().startswith("WITH"):
        rest = re.sub(r"^\s*WITH( RECURSIVE)?\s", "", text, flags=re.I)
        return f"{head}{ctes},\n{rest}"
    return f"{head}{ctes}\n{text}"
