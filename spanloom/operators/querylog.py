"""Analysis of a log of user questions: tags, follow-ups, summaries, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import lookup

# Keyword rules, first hit wins.
TYPE_WORDS = [
    ("errors", "Find errors", "error|fail|exception"),
    ("traces", "Find traces", "trace|execution|span"),
    ("agents", "Get agent information", "agent|service"),
    ("trend", "Show trend", "trend|over time|history"),
    ("comparison", "Compare metrics", "compare|versus|vs"),
]
METRIC_WORDS = [
    ("latency", "duration_ms"),
    ("response time", "duration_ms"),
    ("tokens", "total_tokens"),
    ("cost", "cost"),
    ("errors", "error_count"),
    ("requests", "request_count"),
]
AGG_WORDS = [
    ("avg", "average|avg"),
    ("sum", "total|sum"),
    ("max", "maximum|max"),
    ("min", "minimum|min"),
    ("p95", "p95|95th percentile"),
    ("p99", "p99|99th percentile"),
]
TIME_WORDS = [
    (r"last\s+(\d+)\s+hour", "h"),
    (r"last\s+(\d+)\s+day", "d"),
    (r"past\s+hour", "1h"),
    (r"past\s+day|yesterday", "24h"),
    (r"past\s+week|last\s+week", "7d"),
    (r"past\s+month|last\s+month", "30d"),
]
SUGGESTIONS = {
    "metrics": ["Show me the trend over the last week", "Compare with the previous period", "Break down by agent"],
    "errors": ["What's the most common error type?", "Show error trend over time", "Which agent has the most errors?"],
    "traces": ["Show me the slowest traces", "What's the average latency?", "Show traces with errors"],
}
WIDER = {"1h": "Expand to last 24 hours", "24h": "Show last week instead"}


def _found(q: Column, words: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(name)) for name, p in words]))


def tag_questions(queries: DataFrame, text: str = "query") -> DataFrame:
    """Query type, intent, time range, metrics and aggregations by keyword rules."""
    q = F.lower(F.col(text))
    kind = F.coalesce(*[F.when(q.rlike(p), F.lit(t)) for t, _, p in TYPE_WORDS], F.lit("metrics"))
    intent = F.coalesce(*[F.when(q.rlike(p), F.lit(i)) for _, i, p in TYPE_WORDS], F.lit("Unknown"))
    spans = [
        F.when(q.rlike(p), F.concat(F.regexp_extract(q, p, 1), F.lit(mark)) if "(" in p else F.lit(mark))
        for p, mark in TIME_WORDS
    ]
    metrics = _found(q, [(m, word) for word, m in METRIC_WORDS])
    aggs = _found(q, AGG_WORDS)
    return queries.withColumns(
        {
            "query_type": kind,
            "intent": intent,
            "time_range": F.coalesce(*spans, F.lit("24h")),
            "metrics": metrics,
            "aggregations": F.when(F.size(aggs) == 0, F.array(F.lit("avg"))).otherwise(aggs),
        }
    )


def suggest_followups(tagged: DataFrame, limit: int = 4) -> DataFrame:
    """The first ``limit`` follow-up questions by type and time range."""
    cells = [x for k, v in SUGGESTIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    base = F.coalesce(F.try_element_at(F.create_map(*cells), F.col("query_type")), F.array().cast("array<string>"))
    extra = lookup(WIDER, F.col("time_range"))
    more = F.when(extra.isNotNull(), F.array(extra)).otherwise(F.array().cast("array<string>"))
    return tagged.withColumn("suggestions", F.slice(F.concat(base, more), 1, limit))


def contextual_suggestions(col: Column) -> Column:
    """Questions about the agent a user is looking at (``agent:<id>`` or a text naming an agent)."""
    agent = F.when(col.contains(":"), F.substring_index(col, ":", -1)).otherwise(col)
    forms = [
        F.concat(F.lit("Show me recent traces for "), agent),
        F.concat(F.lit("What errors is "), agent, F.lit(" experiencing?")),
        F.concat(F.lit("Compare "), agent, F.lit(" latency with other agents")),
        F.concat(F.lit("Show "), agent, F.lit(" token usage trend")),
    ]
    return F.when(F.lower(col).contains("agent"), F.array(*forms)).otherwise(F.array().cast("array<string>"))


def summarise(tagged: DataFrame, n: str = "result_count") -> DataFrame:
    """One-line answer from the type, the time range and the number of results."""
    kind, rng, count = F.col("query_type"), F.col("time_range"), F.col(n)
    none = F.concat(F.lit("No "), kind, F.lit(" data found for the specified time range ("), rng, F.lit(")."))
    some = F.concat(F.lit("Found "), count.cast("string"), F.lit(" "), kind, F.lit(" in the last "), rng, F.lit("."))
    other = F.concat(F.lit("Query returned "), count.cast("string"), F.lit(" results."))
    text = F.when(F.coalesce(count, F.lit(0)) == 0, none).when(kind.isin("errors", "traces"), some).otherwise(other)
    return tagged.withColumn("summary", text)


def saved_queries(history: DataFrame, user_id: str, include_shared: bool = True, limit: int = 100) -> DataFrame:
    """A user's own and, if wanted, shared queries, newest first."""
    mine = F.col("created_by") == user_id
    wanted = mine | F.coalesce("is_shared", F.lit(False)) if include_shared else mine
    return history.filter(wanted).orderBy(F.desc("created_at"), "query_id").limit(limit)
