"""Maps the star-schema test tables onto the telemetry model.

``view`` becomes an LLM call, ``click`` a tool or MCP call, ``signup`` /
``purchase`` the start / end of an execution, ``error`` an error event.  Calls
yield a start and an end event.  Everything is a function of the row, so the
same data can be derived in plain SQL (see ``sample_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import key_hash
from ..operators.cost import costed_calls, cost_by
from ..operators.events import to_error_records, to_metric_points
from ..operators.traces import pair_spans, reconstruct_traces
from ..schema import EVENT
from ..session import prepare

MODELS = [
    "claude-3-opus-20240229",
    "claude-3-haiku-20240307",
    "gpt-4o",
    "gpt-4o-mini",
    "gpt-3.5-turbo",
    "custom-model",
]
ERROR_TYPES = ["ValueError", "TimeoutError", "RateLimitError", "ConnectionError"]
ENVIRONMENTS = ["production", "staging", "development"]
AGENT_TYPES = ["langchain", "crewai", "custom"]
ASOF = "2024-01-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, i: Column) -> Column:
    """values[i], null beyond the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


EVENTS_TABLE = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return derive(spark.read.schema(EVENTS_TABLE).parquet(f"{sf_dir}/events.parquet"))


def literals(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def derive(raw: DataFrame) -> DataFrame:
    """Row-wise fields shared by all derived events; also works on a stream."""
    rows = raw.selectExpr(
        "event_id AS id", "user_id", "event_type AS kind", "value", "CAST(ts AS timestamp) AS at",
        "CAST(get_json_object(props, '$.k') AS int) AS k",
    )
    return rows.selectExpr(
        "*",
        "CAST(floor(value * 100) AS bigint) AS dur",
        "concat('agent-', user_id % 20) AS agent_id",
        "concat(user_id, '-', date_format(date_trunc('week', at), 'yyyyMMdd')) AS trace_id",
        f"get({literals(AGENT_TYPES)}, CAST(user_id % 20 % 3 AS int)) AS agent_type",
        f"get({literals(ENVIRONMENTS)}, CAST(user_id % 3 AS int)) AS environment",
        "concat('1.0.', user_id % 4) AS agent_version",
    )


# Canonical event columns as expressions over a derived row, its family and its phase.
_LLM, _TOOL, _MCP, _RUN, _ERR = (f"family = '{f}'" for f in ("llm_call", "tool_call", "mcp_call", "execution", "error"))
_END, _START = "phase = 'end'", "phase = 'start'"
_MODEL = f"get({literals(MODELS)}, k % 6)"
_TOKENS = f"{_LLM} AND {_END} AND k % 25 <> 24"
_FAILED = f"{_END} AND k % 10 = 0"
_EVENT = {
    "event_id": f"concat(id, if({_START}, 's', 'e'))",
    "event_type": f"if({_ERR}, 'error', concat_ws('_', family, phase))",
    "ts": f"if({_START} AND NOT {_RUN}, timestamp_micros(unix_micros(at) - dur * 1000), at)",
    "agent_id": "agent_id",
    "execution_id": "concat('run-', user_id)",
    "trace_id": "trace_id",
    "span_id": f"CASE WHEN {_ERR} THEN concat('sp', id - 1 - k % 3) WHEN {_RUN} THEN concat('ex', id) ELSE concat('sp', id) END",
    "parent_span_id": f"CASE WHEN NOT {_RUN} THEN concat(trace_id, '-root') END",
    "name": f"CASE WHEN {_RUN} THEN concat('run-', k % 5) WHEN {_TOOL} THEN concat('call tool-', k % 7)"
    f" WHEN {_LLM} THEN concat('ask ', {_MODEL}) WHEN {_MCP} THEN 'mcp request' ELSE 'error' END",
    "agent_type": "agent_type",
    "agent_version": "agent_version",
    "environment": "environment",
    "model": f"CASE WHEN {_LLM} THEN {_MODEL} END",
    "provider": f"CASE WHEN {_LLM} AND k % 6 < 2 THEN 'anthropic' WHEN {_LLM} AND k % 6 < 5 THEN 'openai' END",
    "input_tokens": f"CASE WHEN {_TOKENS} THEN CAST(k * 10 AS bigint) END",
    "output_tokens": f"CASE WHEN {_TOKENS} THEN CAST(floor(value) AS bigint) END",
    "total_tokens": f"CASE WHEN {_TOKENS} THEN k * 10 + CAST(floor(value) AS bigint) END",
    "duration_ms": f"CASE WHEN {_END} THEN CAST(dur AS double) END",
    "cost": f"CASE WHEN {_TOKENS} AND k % 3 = 0 THEN CAST(k * 10 AS double) / 1000 END",
    "success": f"CASE WHEN {_END} THEN NOT ({_FAILED}) END",
    "status": f"CASE WHEN {_ERR} OR ({_FAILED}) THEN 'error' WHEN {_END} THEN 'success' END",
    "tool_name": f"CASE WHEN {_TOOL} THEN concat('tool-', k % 7) END",
    "server_name": f"CASE WHEN {_MCP} THEN concat('mcp-', k % 3) END",
    "method": f"CASE WHEN {_MCP} THEN if(k % 2 = 0, 'call', 'list') END",
    "severity": f"CASE WHEN {_ERR} THEN get(array('warning', 'error', 'critical'), k % 4) END",
    "error_type": f"CASE WHEN {_ERR} THEN get({literals(ERROR_TYPES)}, k % 5) WHEN {_FAILED} THEN 'CallError' END",
    "error_message": f"""CASE WHEN {_ERR} THEN CASE k % 4
        WHEN 0 THEN concat('Request ', id, ' failed after ', k, ' retries')
        WHEN 1 THEN concat('Timeout on ', date_format(at, 'yyyy-MM-dd'), ' for job ', k)
        WHEN 2 THEN concat('Record 123e4567-e89b-12d3-a456-4266', lpad(CAST(id AS string), 8, '0'), ' not found') END
      WHEN {_FAILED} THEN concat('call failed with code ', k) END""",
}


def expand(rows: DataFrame) -> DataFrame:
    """Canonical events of derived rows."""
    phased = rows.selectExpr(
        "*",
        "CASE WHEN kind = 'view' THEN 'llm_call' WHEN kind = 'click' AND k % 7 = 6 THEN 'mcp_call' WHEN kind = 'click' THEN 'tool_call'"
        " WHEN kind IN ('signup', 'purchase') THEN 'execution' ELSE 'error' END AS family",
        "explode(CASE WHEN kind IN ('view', 'click') THEN array('start', 'end') WHEN kind = 'signup' THEN array('start')"
        " WHEN kind = 'purchase' THEN array('end') ELSE array('error') END) AS phase",
    )
    absent = lambda f: f"CAST(NULL AS {f.dataType.simpleString()})"
    return phased.selectExpr(*[f"{_EVENT.get(f.name) or absent(f)} AS {f.name}" for f in EVENT.fields])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(base_rows(spark, sf_dir))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct_traces(events(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_spans(events(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_metric_points(events(spark, sf_dir))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_error_records(events(spark, sf_dir))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent registry: suppliers; team = nation, cost center = region."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    i = F.col("s_suppkey")
    return rows.select(
        F.concat(F.lit("agent-"), i.cast("string")).alias("agent_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("team_id"),
        (i % 6).cast("int").alias("project_id"),
        F.col("r_name").alias("cost_center"),
        pick(AGENT_TYPES, i % 3).alias("framework"),
        pick(ENVIRONMENTS, i % 3).alias("environment"),
        (F.col("s_acctbal") > 0).alias("is_active"),
        F.when(i % 9 == 0, "error").when(F.col("s_acctbal") > 0, "active").otherwise("inactive").alias("status"),
        (i * 3).alias("owner_id"),
        key_hash(F.concat(F.lit("key-"), i.cast("string"))).alias("key_hash"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("name"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("key_id"),
        F.concat(F.lit("agent-"), (F.col("c_custkey") % 150).cast("string")).alias("agent_id"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region; the last one has no budget set."""
    i = F.col("r_regionkey")
    amount = ((i + 1) * F.lit("0.30").cast("decimal(10,2)")).cast("decimal(10,2)")
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("cost_center"),
        F.when(i < 4, amount).alias("monthly_budget"),
        F.lit("0.80").cast("decimal(3,2)").alias("alert_threshold"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per nation: every third for all agents."""
    i = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("rule-"), i.cast("string")).alias("rule_id"),
        pick(["error_rate", "latency", "token_usage"], i % 3).alias("rule_type"),
        F.when(i % 4 != 0, F.concat(F.lit("agent-"), i.cast("string"))).alias("agent_id"),
        F.when(i % 5 == 0, F.lit(500.0)).alias("threshold"),
        pick(["warning", "critical"], i % 2).alias("severity"),
        (i % 2 * 720).alias("cooldown_minutes"),
        (i % 7 != 6).alias("is_active"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costed_calls(events(spark, sf_dir), agents(spark, sf_dir))


def cost_center_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_by(calls(spark, sf_dir), "cost_center")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error row raised an alert."""
    k, i = F.col("k"), F.col("id")
    return base_rows(spark, sf_dir).filter("kind = 'error'").select(
        F.concat(F.lit("al-"), i.cast("string")).alias("alert_id"),
        "agent_id",
        pick(["high_error_rate", "high_latency", "error_rate"], k % 3).alias("anomaly_type"),
        pick(["critical", "warning", "info", "HIGH"], k % 4).alias("severity"),
        pick(["open", "acknowledged", "resolved"], i % 3).alias("status"),
        F.col("at").alias("ts"),
        F.when(
            k % 3 == 0, F.create_map(F.lit("error_rate"), (k / 100).cast("double"), F.lit("latency_p95"), F.col("dur").cast("double"))
        ).otherwise(F.create_map(F.lit("error_count"), k.cast("double"))).alias("metrics"),
        "trace_id",
    )


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of severity error and critical were investigated."""
    k, i = F.col("k"), F.col("id")
    ev = expand(base_rows(spark, sf_dir).filter("kind = 'error'"))
    idn = F.regexp_extract("event_id", r"^(\d+)", 1).cast("bigint")
    src = ev.filter("severity IN ('error', 'critical')").select(idn.alias("id"), "error_type", "error_message")
    rows = base_rows(spark, sf_dir).filter("kind = 'error'").join(src, "id")
    resolved = i % 3 == 0
    return rows.select(
        F.concat(F.lit("inv-"), i.cast("string")).alias("investigation_id"),
        F.concat(F.lit("al-"), i.cast("string")).alias("alert_id"),
        "agent_id",
        pick(["high_error_rate", "high_latency", "error_rate"], k % 3).alias("anomaly_type"),
        pick(["critical", "high", "medium", "low"], i % 4).alias("severity"),
        "error_type",
        "error_message",
        F.when(k % 3 == 0, F.concat(F.lit("Cause "), (k % 7).cast("string"))).alias("root_cause"),
        F.when(resolved, F.concat(F.lit("Fix "), k.cast("string"))).alias("resolution_notes"),
        F.when(resolved, "resolved").otherwise("open").alias("resolution_status"),
        F.col("at").alias("created_at"),
        F.when(resolved, F.timestamp_micros(F.unix_micros("at") + k.cast("bigint") * 60_000_000)).alias("resolved_at"),
        (k % 3 == 1).alias("auto_resolved"),
        (k.cast("double") / 128).alias("cost_usd"),
        F.transform(F.sequence(F.lit(0), k % 7), lambda x: F.concat(F.lit("step "), x.cast("string"))).alias("recommendations"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigations(spark, sf_dir).select(
        "investigation_id",
        F.expr("cost_usd * 128 % 3 <> 0").alias("was_helpful"),
        F.expr("CASE WHEN cost_usd * 128 % 8 <> 0 THEN cost_usd * 128 % 6 <> 0 END").alias("root_cause_correct"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region check log: every row checks one of four regions."""
    return base_rows(spark, sf_dir).select(
        F.concat(F.lit("region-"), (F.col("user_id") % 4).cast("string")).alias("region_id"),
        F.col("id").alias("check_id"),
        F.col("at").alias("ts"),
        (F.col("k") % 3 != 0).alias("ok"),
        F.col("dur").cast("double").alias("latency_ms"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("region-"), i.cast("string")).alias("region_id"),
        (i % 3).alias("priority"),
        (i == 1).alias("is_primary"),
        (i * 10 + 50).alias("weight"),
    )


QUESTIONS = [
    "Show me errors in the last {k} hours",
    "What is the average latency over the last {k} days",
    "Which agent has the maximum cost",
    "Compare tokens versus requests past week",
    "Show the trend of response time over time",
    "List slow traces from yesterday",
    "p95 and p99 latency for the past hour",
    "total tokens past month",
    "Which service had failures",
    "minimum response time and requests",
    "history of cost last week",
    "how are things",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question log from clicks."""
    k = F.col("k")
    text = F.replace(pick(QUESTIONS, F.col("id") % len(QUESTIONS)), F.lit("{k}"), k.cast("string"))
    return base_rows(spark, sf_dir).filter("kind = 'click'").select(
        F.concat(F.lit("q-"), F.col("id").cast("string")).alias("query_id"),
        text.alias("query"),
        F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("created_by"),
        (k % 5 == 0).alias("is_shared"),
        F.col("at").alias("created_at"),
        (k % 4).cast("bigint").alias("result_count"),
    )


def remediations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with one to four actions per investigated error."""
    k, i = F.col("k"), F.col("id")
    kinds = ["restart_service", "scale_up", "clear_cache", "update_config", "rollback_deployment", "throttle_requests"]
    step = lambda x: F.struct(
        pick(kinds, (k + x) % 6).alias("type"),
        pick(["low", "medium", "high"], (k + x * 2) % 3).alias("risk_level"),
        ((k + x) % 4 != 0).alias("automated"),
        ((i + x) % 7 != 0).alias("success"),
        ((i + x) % 2 == 0).alias("critical"),
    )
    return base_rows(spark, sf_dir).filter("kind = 'error'").select(
        F.concat(F.lit("rem-"), i.cast("string")).alias("remediation_id"),
        "agent_id",
        pick(["critical", "high", "medium", "low"], i % 4).alias("severity"),
        F.transform(F.sequence(F.lit(0), k % 4), step).alias("actions"),
        pick(["pending_approval", "approved", "completed", "failed", "rejected"], k % 5).alias("status"),
        F.col("at").alias("created_at"),
        F.timestamp_micros(F.unix_micros("at") + F.lit(1_800_000_000)).alias("rollback_deadline"),
        (k % 6 != 0).alias("rollback_available"),
        F.when(k % 5 != 0, F.concat(F.lit("state-"), k.cast("string"))).alias("pre_state"),
        (k % 8 != 0).alias("checks_passed"),
    )


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spans; turn n hangs below turn (n - 1) div 2, a binary tree per conversation."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    return c.select(
        conv.alias("trace_id"),
        F.concat_ws("-", conv, turn.cast("string")).alias("span_id"),
        F.when(turn > 0, F.concat_ws("-", conv, F.floor((turn - 1) / 2).cast("string"))).alias("parent_span_id"),
        F.col("role").alias("name"),
        F.col("role").alias("span_type"),
        "turn",
        "text",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("conn-"), i.cast("string")).alias("connection_id"),
        pick(["high_error_rate", "high_latency", "error_rate"], i % 3).alias("subscription_type"),
        F.when(i % 4 != 0, F.concat(F.lit("agent-"), (i % 25).cast("string"))).alias("agent_filter"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("team_name"),
        pick(["critical", "warning", "info"], i % 3).alias("severity_level"),
        F.when(i % 5 == 0, F.lit(".*")).otherwise(F.concat(F.lit("agent-"), (i % 10).cast("string"), F.lit("[0-9]*"))).alias("agent_pattern"),
        F.when(i % 2 == 0, F.array(F.lit("slack"), F.lit("pagerduty"))).otherwise(F.array(F.lit("email"))).alias("channels"),
        (i % 6 != 5).alias("active"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis texts with section headers around whole documents."""
    d = table(spark, sf_dir, "documents")
    src = F.col("source")
    return d.select(
        "doc_id",
        F.concat(
            F.lit("Preamble\n## Root Cause\n"), F.col("text"), F.lit("\n## Evidence\n- from "), src,
            F.lit("\n\n## Impact\nLanguage "), F.col("lang"), F.lit("\n## Remediation\n1. check "), src,
            F.lit("\nnot a step\n- reload\n* notify\n4. close\n## Prevention\nwatch "), src, F.lit("\n"),
        ).alias("analysis"),
    )


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket events from orders."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    return o.select(
        F.lit("jira").alias("integration_type"),
        F.concat(F.lit("OPS-"), F.col("o_custkey").cast("string")).alias("external_id"),
        pick(["To Do", "In Progress", "In Review", "Done", "Closed"], i % 5).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        i.alias("webhook_id"),
    )


def ticket_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.lit("jira").alias("integration_type"),
        F.concat(F.lit("OPS-"), F.col("c_custkey").cast("string")).alias("external_id"),
        F.concat(F.lit("inv-"), F.col("c_custkey").cast("string")).alias("internal_id"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON records."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct("role", F.struct(F.col("text").alias("content")).alias("message"))).alias("record")
    )
