"""Personal-data jobs over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import privacy as P
from ..functions.times import as_ts

JOB_RULES = P.Rules(min_confidence=0.7)


def pii_job(df: DataFrame, mode: str = "redact", col: str = "record", rules: P.Rules = JOB_RULES, all_strings: bool = False, dry_run: bool = False, asof=None) -> DataFrame:
    """Work on JSON records: ``redact`` them, ``detect`` matches, or ``validate`` that there are none.

    Matches are counted over the whole serialised record before redaction.
    """
    if mode in ("detect", "validate") or dry_run:
        found = df.withColumn("matches", P.detect_pii(F.col(col), rules))
    else:
        scanned = df.withColumn("__scan", P.scan_records(F.col(col), rules, P.JOB_SENSITIVE_KEYS, all_strings))
        found = scanned.withColumn("matches", F.col("__scan.matches"))
    found = found.withColumn("pii_count", F.size("matches"))
    if mode == "detect":
        return found
    types = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["type"])))
    if mode == "validate":
        return found.withColumns({"valid": F.col("pii_count") == 0, "types_found": types}).drop("matches")
    if dry_run:
        return found.withColumn("dry_run", F.lit(True)).drop("matches")
    clean = P.redacted_record(F.col(col), F.col("__scan.segments"), rules)
    at = as_ts(asof) if asof is not None else F.current_timestamp()
    note = F.struct(
        F.lit(True).alias("redacted"), F.col("pii_count"), at.alias("redacted_at"), F.lit(rules.strategy).alias("strategy")
    )
    return found.withColumns(
        {
            "redacted_record": clean,
            "redaction_map": P.redaction_map(F.col("__scan.segments"), rules),
            "_pii_redaction": F.when(F.col("pii_count") > 0, note),
            "result": F.when(clean.isNull(), "ProcessingFailed").otherwise("Ok"),
        }
    ).drop("matches", "__scan")


def redact_columns(df: DataFrame, cols: list[str], rules: P.Rules = P.Rules(), sensitive: list[str] | None = None) -> DataFrame:
    """Typed form: sensitive columns are masked, text columns scanned.

    ``cols`` may name string columns, or struct columns whose string fields are
    handled by name, decided from the schema when the plan is built.
    """
    keys = {k.lower() for k in [*P.SENSITIVE_KEYS, *(sensitive or [])]}

    def walk(value, kind, name: str, path: str):
        if kind.typeName() == "struct":
            for f in kind.fields:
                value = value.withField(f.name, walk(value[f.name], f.dataType, f.name, f"{path}.{f.name}"))
            return value
        if kind.typeName() != "string":
            return value
        if name.lower() in keys:
            return F.when(value.isNotNull(), F.lit(P.MASK))
        return P.redact_pii(value, rules) if any(p in path.lower() for p in P.SCANNED_PATHS) else value

    return df.withColumns({c: walk(F.col(c), df.schema[c].dataType, c, c) for c in cols})


def pii_stats(df: DataFrame, matches: str = "matches") -> DataFrame:
    """Matches per type."""
    return df.select(F.explode(matches).alias("m")).groupBy(F.col("m.type").alias("pii_type")).agg(
        F.count(F.lit(1)).alias("count")
    )


def pii_totals(df: DataFrame, matches: str = "matches", threshold: int = 100) -> DataFrame:
    """Records, records with matches, total matches, and whether the total passes the alert threshold."""
    n = F.size(matches)
    out = df.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(n > 0).alias("records_with_pii"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_pii"),
    )
    return out.withColumn("alert", F.col("total_pii") > threshold)
