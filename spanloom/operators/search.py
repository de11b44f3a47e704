"""Full-text search over traces and spans.

The terms of a query are few and known when the plan is built, so matching is a
native expression over each row: no index, no join, and only the best rows of
each task reach the result.  Scores are this library's own ranking.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .events import filter_by
from .ordered import page


def _tokens(col: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def allowed_edits(term: str) -> int:
    """0 up to two characters, 1 up to five, else 2."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def relevance(query: str, fields: dict[Column | str, float], fuzzy: bool = True) -> Column:
    """Sum over the terms of the best field hit: its boost, less a tenth per edit; null when nothing matches."""
    terms = [t for t in re.split(r"[^\w]+|_", query.lower()) if t]
    parts = []
    for term in terms:
        edits = allowed_edits(term) if fuzzy else 0
        hits = []
        for col, boost in fields.items():
            tokens = _tokens(F.col(col) if isinstance(col, str) else col)
            if edits == 0:
                hits.append(F.when(F.array_contains(tokens, term), F.lit(float(boost))))
            else:
                # levenshtein with a threshold returns -1 beyond it
                distance = F.array_min(
                    F.filter(F.transform(tokens, lambda t: F.levenshtein(t, F.lit(term), edits)), lambda d: d >= 0)
                )
                hits.append(F.lit(float(boost)) * (1 - distance * 0.1))
        parts.append(F.greatest(*hits) if len(hits) > 1 else hits[0])
    if not parts:
        return F.lit(1.0)
    zero = F.lit(0.0)
    total = sum((F.coalesce(p, zero) for p in parts), zero)
    return F.when(F.coalesce(*parts).isNotNull(), F.round(total, 6))


def search_traces(traces: DataFrame, query: str | None = None, number: int = 1, size: int = 20, start=None, end=None, fields: dict | None = None, **equal) -> tuple[DataFrame, DataFrame]:
    """(page of matching traces newest first, totals); the name counts double."""
    rows = filter_by(traces, "start_time", start, end, **equal)
    if query:
        rows = rows.withColumn("score", relevance(query, fields or {"name": 2.0, "agent_id": 1.0})).filter("score IS NOT NULL")
    return page(rows, [F.desc("start_time"), F.asc("trace_id")], number, size)


def best_matches(df: DataFrame, query: str, fields: dict, key: str, k: int = 20) -> DataFrame:
    """Top ``k`` rows by relevance."""
    rows = df.withColumn("score", relevance(query, fields)).filter("score IS NOT NULL")
    return rows.orderBy(F.desc("score"), F.asc(key)).limit(k)


def search_spans(spans: DataFrame, query: str | None = None, trace_id: str | None = None, span_type: str | None = None, number: int = 1, size: int = 50, fields: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of matching spans, oldest first, totals)."""
    rows = filter_by(spans, trace_id=trace_id, span_type=span_type)
    if query:
        rows = rows.withColumn("score", relevance(query, fields or {"name": 2.0}, fuzzy=False)).filter("score IS NOT NULL")
    return page(rows, [F.asc("start_time"), F.asc("span_id")], number, size)


def search_errors(errors: DataFrame, agent_id: str | None = None, start=None, end=None, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    rows = filter_by(errors, "ts", start, end, agent_id=agent_id)
    return page(rows, [F.desc("ts"), F.asc("error_id")], number, size)
