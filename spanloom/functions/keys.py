"""Fingerprints and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns removed from messages before hashing.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NUMBER = r"\b\d+\b"
DATE = r"\d{4}-\d{2}-\d{2}"
DATETIME = r"\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?z?"


def normalised_message(message: Column, normalise: str = "literal") -> Column:
    """Lower-cased message with ids and numbers replaced by placeholders.

    ``literal`` replaces numbers before dates, so a date becomes three numbers
    and an ISO time keeps its middle part; ``fixed`` takes times and dates first.
    """
    text = F.lower(F.coalesce(message, F.lit("")))
    steps = [(UUID, "<uuid>"), (NUMBER, "<num>"), (DATE, "<date>")]
    if normalise == "fixed":
        steps = [(UUID, "<uuid>"), (DATETIME, "<date>"), (DATE, "<date>"), (NUMBER, "<num>")]
    for pattern, mark in steps:
        text = F.regexp_replace(text, pattern, mark)
    return text


def error_fingerprint(
    agent: Column, event_type: Column, error_type: Column, message: Column, normalise: str = "literal"
) -> Column:
    """16 hex digits identifying an error pattern."""
    none = F.lit("None")
    text = F.concat_ws(
        ":",
        F.coalesce(agent, none),
        F.coalesce(event_type, none),
        F.coalesce(error_type, none),
        normalised_message(message, normalise),
    )
    return F.substring(F.md5(text), 1, 16)


def alert_fingerprint(agent: Column, anomaly_type: Column, metrics: Column | None = None) -> Column:
    """Sha-256 over agent, type and the sorted metric names (values excluded)."""
    parts = [F.coalesce(agent, F.lit("")), F.coalesce(anomaly_type, F.lit(""))]
    if metrics is not None:
        names = F.array_join(F.array_sort(F.map_keys(metrics)), ",")
        parts.append(F.when(F.size(metrics) > 0, names))  # null parts are skipped by concat_ws
    return F.sha2(F.concat_ws("|", *parts), 256)


def alert_fingerprint_text(agent: Column, anomaly_type: Column, text: Column) -> Column:
    """Variant keyed by the first 100 characters of a text (metrics dump or root cause)."""
    empty = F.lit("")
    return F.sha2(
        F.concat_ws(
            "|",
            F.coalesce(agent, empty),
            F.coalesce(anomaly_type, empty),
            F.substring(F.coalesce(text, empty), 1, 100),
        ),
        256,
    )


def key_hash(secret: Column) -> Column:
    return F.sha2(secret, 256)


def stack_hash(stack: Column) -> Column:
    return F.sha2(stack, 256)


def error_id(agent: Column, execution: Column, ts: Column, event_id: Column) -> Column:
    """Deterministic error id, so a replayed event overwrites itself."""
    return F.sha2(
        F.concat_ws(
            "|",
            F.coalesce(agent, F.lit("unknown")),
            F.coalesce(execution, F.lit("no-exec")),
            F.unix_micros(ts).cast("string"),
            event_id,
        ),
        256,
    )
