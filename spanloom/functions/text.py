"""Text helpers: ratios, trigrams, display formats, keyword maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import lookup


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total_tokens(inp: Column, out: Column, total: Column) -> Column:
    """Reported total, or input + output when it is missing or 0."""
    summed = F.coalesce(inp, F.lit(0)) + F.coalesce(out, F.lit(0))
    return F.when(total.isNull() | (total == 0), summed).otherwise(total)


def severity_by_multiple(value: Column, threshold) -> Column:
    """At least twice the threshold is critical, else warning."""
    return F.when(value >= F.lit(threshold) * 2, F.lit("critical")).otherwise(F.lit("warning"))


def trigrams(col: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(
        F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0
    )

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct-element arrays."""
    shared = F.size(F.array_intersect(a, b))
    return safe_ratio(shared, F.size(a) + F.size(b) - shared)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


# Provider keywords, first match wins.
PROVIDERS = [
    ("anthropic", ["claude", "anthropic"]),
    ("openai", ["gpt", "openai"]),
    ("meta", ["llama", "meta"]),
    ("google", ["gemini", "google"]),
    ("mistral", ["mistral"]),
    ("cohere", ["cohere"]),
]


def provider_of(model: Column) -> Column:
    name = F.lower(model)
    hits = [F.when(name.rlike("|".join(words)), F.lit(provider)) for provider, words in PROVIDERS]
    return F.coalesce(*hits, F.lit("unknown"))


# Severity and status names of the ticket and paging systems.
SEVERITY_MAPS = {
    "jira_priority": ({"critical": "Highest", "error": "High", "warning": "Medium", "info": "Low"}, "Medium"),
    "snow_urgency": ({"critical": 1, "error": 2, "warning": 2, "info": 3}, 2),
    "snow_impact": ({"critical": 1, "error": 2, "warning": 2, "info": 3}, 2),
    "pager": ({"critical": "critical", "warning": "warning", "error": "error", "info": "info"}, "info"),
    "topic": ({"critical": "critical", "warning": "warning", "info": "info"}, "info"),
}
STATUS_MAPS = {
    ("jira", "in"): (
        {"done": "resolved", "closed": "resolved", "resolved": "resolved",
         "in progress": "in_progress", "in review": "in_progress"},
        "open",
    ),
    ("jira", "out"): ({"resolved": "Done", "in_progress": "In Progress", "open": "To Do"}, None),
    ("servicenow", "in"): (
        {"1": "open", "2": "in_progress", "3": "in_progress", "6": "resolved", "7": "resolved"},
        "open",
    ),
    ("github", "in"): ({"closed": "resolved", "reopened": "open"}, None),
}


def map_severity(severity: Column, target: str) -> Column:
    table, default = SEVERITY_MAPS[target]
    return lookup(table, F.lower(severity), default)


def map_status(status: Column, system: str, direction: str = "in") -> Column:
    table, default = STATUS_MAPS[(system, direction)]
    return lookup(table, F.lower(status), default)


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def fmt_duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(_fixed(ms / 1000, 1), F.lit("s")))
        .when(ms < 3600000, F.concat(_fixed(ms / 60000, 1), F.lit("m")))
        .otherwise(F.concat(_fixed(ms / 3600000, 1), F.lit("h")))
    )


def fmt_tokens(n: Column) -> Column:
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 1000000, F.concat(_fixed(n / 1000, 1), F.lit("K")))
        .otherwise(F.concat(_fixed(n / 1000000, 1), F.lit("M")))
    )


def fmt_cost(amount: Column) -> Column:
    shown = (
        F.when(amount < 0.01, _fixed(amount, 4))
        .when(amount < 1, _fixed(amount, 3))
        .otherwise(_fixed(amount, 2))
    )
    return F.concat(F.lit("$"), shown)


def fmt_pct(ratio: Column, digits: int = 1) -> Column:
    return F.concat(_fixed(ratio * 100, digits), F.lit("%"))


def truncate(text: Column, width: int) -> Column:
    short = F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) <= width, text).otherwise(short)


def fmt_ts(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("Unknown"))


def coerce_number(text: Column) -> Column:
    """Text result cell as (as_long, as_double, as_text); one of them is filled."""
    dotted = text.contains(".")
    as_double = F.when(dotted, text.try_cast("double"))
    as_long = F.when(~dotted, text.try_cast("bigint"))
    rest = F.when(as_double.isNull() & as_long.isNull(), text)
    return F.struct(as_long.alias("as_long"), as_double.alias("as_double"), rest.alias("as_text"))


def executive_summary(text: Column, width: int = 500) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


# Default alert thresholds by rule type.
RULE_THRESHOLDS = {"error_rate": 0.05, "latency": 5000.0, "token_usage": 100000.0, "anomaly": 2.0}


def rule_threshold(rule_type: Column, threshold: Column) -> Column:
    """The rule's own threshold, else the default of its type (0 counts as unset)."""
    own = F.when(threshold != 0, threshold)
    return F.coalesce(own, lookup(RULE_THRESHOLDS, rule_type, 1.0))
