"""The canonical event row and the value sets used across the package."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("execution_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("agent_type", T.StringType()),
        T.StructField("agent_version", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("server_name", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("tool_input", T.StringType()),
        T.StructField("tool_output", T.StringType()),
        T.StructField("context", _TEXT_MAP),
        T.StructField("dimensions", _TEXT_MAP),
        T.StructField("metadata", _TEXT_MAP),
        T.StructField("global_tags", _TEXT_MAP),
        T.StructField("ingestion_ts", T.TimestampType()),
    ]
)

EVENT_COLUMNS = [f.name for f in EVENT.fields]

_TOKEN_USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)

# What a raw JSON event may carry: the flat hot-path fields plus the nested
# ``attributes`` form.  ``sources.files.canonical`` folds both into EVENT.
RAW_EVENT = T.StructType(
    [f for f in EVENT.fields if f.name not in ("ts", "ingestion_ts")]
    + [
        T.StructField("timestamp", T.StringType()),
        T.StructField("ingestion_timestamp", T.StringType()),
        T.StructField("token_usage", _TOKEN_USAGE),
        T.StructField(
            "attributes",
            T.StructType(
                [
                    T.StructField("model", T.StringType()),
                    T.StructField("status", T.StringType()),
                    T.StructField("duration_ms", T.DoubleType()),
                    T.StructField("tool_name", T.StringType()),
                    T.StructField("token_usage", _TOKEN_USAGE),
                    T.StructField(
                        "error",
                        T.StructType(
                            [
                                T.StructField("type", T.StringType()),
                                T.StructField("message", T.StringType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

# Event type names.
EVENT_TYPES = [
    "execution_start",
    "execution_end",
    "llm_call_start",
    "llm_call_end",
    "tool_call_start",
    "tool_call_end",
    "mcp_call_start",
    "mcp_call_end",
    "error",
    "metric",
    "log",
]
END_EVENTS = ["execution_end", "llm_call_end", "tool_call_end", "mcp_call_end"]
START_EVENTS = ["execution_start", "llm_call_start", "tool_call_start", "mcp_call_start"]
LEGACY_TYPES = {
    "llm_start": "llm_call_start",
    "llm_end": "llm_call_end",
    "tool_start": "tool_call_start",
    "tool_end": "tool_call_end",
}

# Severities, lowest to highest; synonyms share a rank.
SEVERITY_RANK = {
    "debug": 0,
    "info": 1,
    "low": 2,
    "medium": 3,
    "warning": 3,
    "high": 4,
    "error": 4,
    "critical": 5,
}


def lookup(pairs: dict, key: Column, default=None) -> Column:
    """Literal lookup table as an expression (stays in codegen, no join)."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(col: Column) -> Column:
    return lookup(SEVERITY_RANK, F.lower(col), 1)


def canonical_type(col: Column) -> Column:
    return F.coalesce(lookup(LEGACY_TYPES, col), col)


def canonical_status(col: Column) -> Column:
    return F.when(F.lower(col) == "completed", F.lit("success")).otherwise(F.lower(col))
