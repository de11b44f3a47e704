"""Spans in the OpenTelemetry vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import ordered_scan

# Attribute names of the semantic conventions.
ATTRIBUTES = {
    "gen_ai.agent.id": "agent_id",
    "gen_ai.agent.type": "agent_type",
    "gen_ai.agent.version": "agent_version",
    "gen_ai.execution.id": "execution_id",
    "gen_ai.request.model": "model",
    "gen_ai.system": "provider",
    "gen_ai.tool.name": "tool_name",
    "gen_ai.mcp.server_name": "server_name",
    "gen_ai.mcp.method": "method",
    "deployment.environment": "environment",
    "duration_ms": "duration_ms",
    "gen_ai.usage.input_tokens": "input_tokens",
    "gen_ai.usage.output_tokens": "output_tokens",
    "gen_ai.usage.total_tokens": "total_tokens",
    "gen_ai.cost.usd": "cost",
}


def otel_spans(spans: DataFrame) -> DataFrame:
    """Span name, kind, status code and non-empty attributes of paired spans."""
    kind = F.col("span_type")
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    dotted = lambda *cs: F.concat_ws(".", *cs)
    name = (
        F.when(kind == "execution", F.lit("agent.execution"))
        .when(kind == "llm", dotted(F.lit("llm"), part("provider"), part("model")))
        .when(kind == "tool", dotted(F.lit("tool"), part("tool_name")))
        .when(kind == "mcp", dotted(F.lit("mcp"), part("server_name"), part("method")))
        .otherwise(F.col("start_event_type"))
    )
    role = F.when(kind == "execution", "SERVER").when(kind.isin("llm", "mcp"), "CLIENT").otherwise("INTERNAL")
    code = F.when(F.col("status") == "success", "OK").when(F.col("status") == "error", "ERROR").otherwise("UNSET")
    numeric = {"duration_ms", "input_tokens", "output_tokens", "total_tokens", "cost"}
    cells = []
    for label, c in ATTRIBUTES.items():
        value = F.col(c)
        text = F.when(value != 0, value.cast("string")) if c in numeric else F.nullif(value.cast("string"), F.lit(""))
        cells += [F.lit(label), text]
    message = F.when(F.col("status") == "error", F.coalesce("error_message", F.lit("Unknown error")))
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "start_time", "end_time",
        name.alias("otel_name"), role.alias("otel_kind"), code.alias("status_code"), message.alias("status_message"),
        F.map_filter(F.create_map(*cells), lambda _, v: v.isNotNull()).alias("attributes"),
    )


def span_events(events: DataFrame) -> DataFrame:
    """Error, metric and log events as span events."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "error", "exception")
        .when(kind == "metric", F.concat(F.lit("metric."), F.coalesce("metric_name", F.lit("unknown"))))
        .otherwise("log")
    )
    cells = {
        "error.type": F.when(kind == "error", F.coalesce("error_type", F.lit("Error"))),
        "error.message": F.when(kind == "error", F.coalesce("error_message", F.lit("Unknown error"))),
        "error.stack_trace": F.when(kind == "error", F.coalesce("stack_trace", F.lit(""))),
        "metric.value": F.when(kind == "metric", F.coalesce("metric_value", F.lit(0.0)).cast("string")),
        "metric.unit": F.when(kind == "metric", F.coalesce("unit", F.lit(""))),
        "log.severity": F.when(kind == "log", F.coalesce("severity", F.lit("info"))),
        "log.message": F.when(kind == "log", F.coalesce("message", F.lit(""))),
    }
    flat = [x for k, v in cells.items() for x in (F.lit(k), v)]
    return events.filter(kind.isin("error", "metric", "log")).select(
        "span_id", "ts", "event_id", name.alias("event_name"),
        F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull()).alias("event_attributes"),
    )


def attach_span_events(spans: DataFrame, events: DataFrame, chunk: int = 1000) -> DataFrame:
    """Span events grouped under their span, in ordered chunks of at most ``chunk``.

    A span with an error event has status ERROR.  Spans without events keep one
    row with an empty list.
    """
    notes = ordered_scan(span_events(events.filter("span_id IS NOT NULL")), ["span_id"], row_number="n")
    part = F.floor((F.col("n") - 1) / chunk).cast("int")
    item = F.struct("n", "ts", F.col("event_name").alias("name"), F.col("event_attributes").alias("attributes"))
    lists = notes.groupBy("span_id", part.alias("chunk")).agg(F.collect_list(item).alias("events"))
    lists = lists.withColumn("events", F.array_sort("events", lambda a, b: (a["n"] - b["n"]).cast("int")))
    failed = notes.filter(F.col("event_name") == "exception").select("span_id").distinct().withColumn("failed", F.lit(True))
    out = spans.join(lists, "span_id", "left").join(failed, "span_id", "left")
    return out.withColumns(
        {
            "chunk": F.coalesce("chunk", F.lit(0)),
            "status": F.when(F.col("failed"), "error").otherwise(F.col("status")),
        }
    ).drop("failed")
