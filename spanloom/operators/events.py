"""Event-level projections, filters and predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import error_id, key_hash
from ..functions.times import as_ts, expires_at, in_last, period_delta, since, ttl_epoch
from ..schema import END_EVENTS, EVENT_COLUMNS


def enrich_events(events: DataFrame, batch: dict | None = None, auth: dict | None = None, ingested_at=None) -> DataFrame:
    """Fill batch metadata: the authorised agent id wins, then the batch's values, then ``unknown``."""
    batch, auth = batch or {}, auth or {}
    agent = auth.get("agent_id") or batch.get("agent_id", "unknown")
    at = as_ts(ingested_at) if ingested_at is not None else F.current_timestamp()

    def known(name: str, *places: dict) -> Column:
        value = next((p[name] for p in places if name in p), "unknown")
        return F.lit(value)

    tags = [F.lit(x) for kv in batch.get("global_tags", {}).items() for x in kv]
    return events.withColumns(
        {
            "agent_id": F.lit(agent),
            "environment": known("environment", batch, auth),
            "agent_type": known("agent_type", batch, auth),
            "agent_version": known("agent_version", batch),
            "global_tags": F.create_map(*tags).cast("map<string,string>"),
            "ingestion_ts": at,
        }
    )


def with_defaults(events: DataFrame) -> DataFrame:
    """Column form of the enrichment for tables that already carry metadata columns."""
    names = ["agent_id", "environment", "agent_type", "agent_version"]
    return events.withColumns({n: F.coalesce(n, F.lit("unknown")) for n in names})


def of_types(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*types))


def llm_ends_with_tokens(events: DataFrame) -> DataFrame:
    return of_types(events, "llm_call_end").filter(F.col("total_tokens").isNotNull())


def has_error() -> Column:
    """The event carries an error description."""
    return F.col("error_type").isNotNull() | F.col("error_message").isNotNull()


def is_error() -> Column:
    """Error status, an error description, or an error event; never null."""
    flagged = F.coalesce(F.col("status") == "error", F.lit(False))
    return flagged | has_error() | F.coalesce(F.col("event_type") == "error", F.lit(False))


def is_end_event() -> Column:
    return F.col("event_type").isin(END_EVENTS)


def to_error_records(events: DataFrame, ttl_days: int = 90) -> DataFrame:
    """Rows of the error store, from error events."""
    return of_types(events, "error").select(
        error_id(F.col("agent_id"), F.col("execution_id"), F.col("ts"), F.col("event_id")).alias("error_id"),
        "event_id",
        F.coalesce("agent_id", F.lit("unknown")).alias("agent_id"),
        F.coalesce("execution_id", F.lit("")).alias("execution_id"),
        "trace_id",
        "ts",
        F.coalesce("error_type", F.lit("unknown")).alias("error_type"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce("severity", F.lit("error")).alias("severity"),
        F.lit("open").alias("resolution_status"),
        "stack_trace",
        "context",
        ttl_epoch(F.col("ts"), ttl_days).alias("ttl"),
    )


def in_period(df: DataFrame, period: str, asof, ts: str = "ts") -> DataFrame:
    return df.filter(in_last(F.col(ts), asof, period_delta(period)))


def filter_by(df: DataFrame, ts: str = "ts", start=None, end=None, **equal) -> DataFrame:
    """Conjunction of the filters that are given; ``None`` means no filter."""
    conds = [F.col(name) == value for name, value in equal.items() if value is not None]
    if start is not None:
        conds.append(F.col(ts) >= as_ts(start))
    if end is not None:
        conds.append(F.col(ts) <= as_ts(end))
    return df.filter(reduce(and_, conds)) if conds else df


def by_duration(df: DataFrame, min_ms=None, max_ms=None) -> DataFrame:
    if min_ms is not None:
        df = df.filter(F.col("duration_ms") >= min_ms)
    return df if max_ms is None else df.filter(F.col("duration_ms") <= max_ms)


def to_metric_points(events: DataFrame) -> DataFrame:
    """Narrow metric points of end events.

    Duration for every end event; token counts only for LLM calls and only when
    above zero; cost only when above zero.
    """
    llm = F.col("event_type") == "llm_call_end"
    point = lambda name, value, kind: F.struct(
        F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(kind).alias("kind")
    )
    tokens = lambda c: F.when(llm & (F.col(c) != 0), F.col(c))
    points = F.array(
        point("duration_ms", F.col("duration_ms"), "DOUBLE"),
        point("input_tokens", tokens("input_tokens"), "BIGINT"),
        point("output_tokens", tokens("output_tokens"), "BIGINT"),
        point("cost_usd", F.when(F.col("cost") > 0, F.col("cost")), "DOUBLE"),
    )
    unknown = F.lit("unknown")
    rows = events.filter(is_end_event()).select(
        "ts",
        F.coalesce("agent_id", unknown).alias("agent_id"),
        F.coalesce("agent_type", unknown).alias("agent_type"),
        F.coalesce("environment", unknown).alias("environment"),
        "event_type",
        "trace_id",
        F.coalesce("model", unknown).alias("model"),
        F.coalesce("provider", unknown).alias("provider"),
        F.explode(F.filter(points, lambda p: p["value"].isNotNull())).alias("p"),
    )
    token_point = F.col("p.name").isin("input_tokens", "output_tokens")
    return rows.select(
        "ts",
        "agent_id",
        "agent_type",
        "environment",
        "trace_id",
        F.when(F.col("p.name") == "duration_ms", F.col("event_type")).alias("event_type"),
        F.when(token_point, F.col("model")).alias("model"),
        F.when(token_point, F.col("provider")).alias("provider"),
        F.col("p.name").alias("measure_name"),
        F.col("p.value").alias("measure_value"),
        F.col("p.kind").alias("measure_type"),
    )


def widen_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key set with a column per measure (durations averaged, the rest summed)."""
    m, v = F.col("measure_name"), F.col("measure_value")
    pick = lambda name: F.when(m == name, v)
    return points.groupBy(*keys).agg(
        F.max(pick("duration_ms")).alias("duration_ms"),
        F.sum(pick("input_tokens")).alias("input_tokens"),
        F.sum(pick("output_tokens")).alias("output_tokens"),
        F.sum(pick("cost_usd")).alias("cost"),
    )


def lookup_rows(df: DataFrame, key: str, keys) -> DataFrame:
    """Rows whose key is in a list (pushed to the scan) or in a DataFrame (semi join)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(keys) if isinstance(keys, (list, tuple, set)) else [keys]))


def with_expiry(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    return df.withColumn("expires_at", expires_at(F.col(ts), days))


def drop_expired(df: DataFrame, asof) -> DataFrame:
    return df.filter(F.col("expires_at") > as_ts(asof))


def sample_events(df: DataFrame, rate: float, seed: int = 0, by: str = "trace") -> DataFrame:
    """Keep a fraction of events; ``by='trace'`` keeps or drops whole traces."""
    if by == "event":
        return df.sample(fraction=rate, seed=seed)
    # The bucket comes from a digest that other engines have too.
    digest = F.md5(F.concat_ws("|", "trace_id", F.lit(str(seed))).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    return df.filter(slot < round(rate * 10_000))


# Payload columns hidden by each policy flag.
PAYLOADS = {
    "redact_prompts": "prompt",
    "redact_responses": "response",
    "redact_tool_inputs": "tool_input",
    "redact_tool_outputs": "tool_output",
}


def suppress_payloads(df: DataFrame, **policy: bool) -> DataFrame:
    hidden = [PAYLOADS[flag] for flag, on in policy.items() if on]
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden if c in df.columns})


def execution_trace(events: DataFrame, agent_id: str, asof, execution_id: str | None = None, hours: int = 24, limit: int = 100) -> DataFrame:
    """First events of an agent's recent execution, oldest first."""
    rows = filter_by(events, agent_id=agent_id, execution_id=execution_id, end=asof)
    return rows.filter(F.col("ts") >= since(asof, period_delta(f"{hours}h"))).orderBy("ts", "event_id").limit(limit)


def admit(events: DataFrame, agents: DataFrame, secret: str = "api_key") -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): the agent must be registered and active, and the key hash must match."""
    live = agents.filter("is_active").select("agent_id", "key_hash").distinct()
    keyed = events.withColumn("key_hash", key_hash(F.col(secret)))
    on = ["agent_id", "key_hash"]
    return keyed.join(live, on, "left_semi").drop("key_hash"), keyed.join(live, on, "left_anti").drop("key_hash")


def event_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in EVENT_COLUMNS if c in df.columns])
