"""Remediation plans: approval, final status, rollback, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import as_ts, period_delta, span_literal
from .events import filter_by
from .ordered import page

# Policy defaults and the status machine.
AUTO_APPROVE = ["low"]
NEEDS_APPROVAL = ["restart", "scale", "rollback"]
APPROVAL_WINDOW = "1h"
TRANSITIONS = {
    "pending_approval": ["approved", "rejected"],
    "approved": ["in_progress"],
    "in_progress": ["completed", "failed"],
    "completed": ["rolled_back"],
    "failed": ["in_progress", "rolled_back"],
}


def requires_approval(actions: Column, severity: Column) -> Column:
    """Low severity runs by itself; otherwise a risky action asks for approval."""
    risky = F.exists(
        actions,
        lambda a: (F.coalesce(a["risk_level"], F.lit("medium")) == "high")
        | F.coalesce(a["type"], F.lit("")).rlike("|".join(NEEDS_APPROVAL)),
    )
    return ~F.lower(severity).isin(AUTO_APPROVE) & F.coalesce(risky, F.lit(False))


def fallback_plan(recommendations: Column, limit: int | None = None) -> Column:
    """Manual actions made from recommendations: all, or the first ``limit``."""
    listed = F.coalesce(recommendations, F.array().cast("array<string>"))
    return F.transform(
        listed if limit is None else F.slice(listed, 1, limit),
        lambda r: F.struct(
            F.lit("custom_script").alias("type"),
            r.alias("description"),
            F.lit(False).alias("automated"),
            F.lit("medium").alias("risk_level"),
        ),
    )


def executed_actions(results: Column) -> Column:
    """The results that count: manual steps are skipped, nothing runs after a critical failure."""
    seen = F.aggregate(
        results,
        F.struct(F.lit(False).alias("stop"), F.filter(results, lambda _: F.lit(False)).alias("done")),
        lambda acc, r: F.struct(
            (acc["stop"] | (r["automated"] & ~r["success"] & r["critical"])).alias("stop"),
            F.when(acc["stop"] | ~r["automated"], acc["done"]).otherwise(F.concat(acc["done"], F.array(r))).alias("done"),
        ),
    )
    return seen["done"]


def final_status(results: Column, checks_passed: Column | None = None) -> Column:
    """Completed when every executed action succeeded and the checks after it passed."""
    failed = F.exists(executed_actions(results), lambda r: ~r["success"])
    passed = F.lit(True) if checks_passed is None else F.coalesce(checks_passed, F.lit(True))
    return F.when(~F.coalesce(failed, F.lit(False)) & passed, "completed").otherwise("failed")


def plan(investigations: DataFrame, rollback_minutes: int = 30) -> DataFrame:
    """A remediation row per investigation with recommendations."""
    actions = F.coalesce(F.col("actions"), fallback_plan(F.col("recommendations")))
    rows = investigations.withColumn("actions", actions)
    needs = requires_approval(F.col("actions"), F.col("severity"))
    rows = rows.withColumn("requires_approval", needs)
    deadline = F.col("created_at") + span_literal(period_delta(APPROVAL_WINDOW))
    return rows.withColumns(
        {
            "status": F.when(F.col("requires_approval"), "pending_approval").otherwise("approved"),
            "approval_deadline": F.when(F.col("requires_approval"), deadline),
            "rollback_deadline": F.col("created_at") + span_literal(period_delta(f"{rollback_minutes}m")),
        }
    )


def rollback_allowed(df: DataFrame, asof) -> DataFrame:
    """Rows that may still be rolled back: offered, not past the deadline, state captured."""
    open_until = F.col("rollback_deadline").isNull() | (F.col("rollback_deadline") >= as_ts(asof))
    return df.filter(F.coalesce("rollback_available", F.lit(False)) & open_until & F.col("pre_state").isNotNull())


def valid_transition(old: Column, new: Column) -> Column:
    allowed = [F.when(old == o, new.isin(ns)) for o, ns in TRANSITIONS.items()]
    return F.coalesce(*allowed, F.lit(False))


def remediation_counts(remediations: DataFrame) -> DataFrame:
    return remediations.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def list_remediations(remediations: DataFrame, number: int = 1, size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """(page newest first, totals with has_more)."""
    rows = filter_by(remediations, ts="created_at", **filters)
    out, totals = page(rows, [F.desc("created_at"), F.asc("remediation_id")], number, size)
    return out, totals.withColumn("has_more", F.col("total") > number * size)
