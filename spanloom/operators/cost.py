"""Cost attribution, budgets and spend reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.pricing import cost_default
from ..functions.times import as_ts
from .events import llm_ends_with_tokens
from .ordered import share_of_total


def with_agent_metadata(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Team, project and cost center of each event's agent; unregistered agents stay, with nulls.

    No broadcast hint: Spark broadcasts the agents when their size allows it, and
    otherwise joins by key with AQE splitting agents that dominate.
    """
    dims = agents.select("agent_id", "team_id", "project_id", "cost_center")
    return events.join(dims, "agent_id", "left")


def with_pricing(events: DataFrame, pricing: DataFrame, unknown: str = "default") -> DataFrame:
    """Cost from a price table (model, input_price, output_price per 1M tokens)."""
    rates = pricing.select("model", "input_price", "output_price")
    fallback = {"zero": (0, 0), "default": (3, 15), "null": (None, None)}[unknown]
    kind = "decimal(8,2)"
    p_in = F.coalesce(F.col("input_price").cast(kind), F.lit(fallback[0]).cast(kind))
    p_out = F.coalesce(F.col("output_price").cast(kind), F.lit(fallback[1]).cast(kind))
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)")
    bill = (tokens("input_tokens") * p_in + tokens("output_tokens") * p_out) / F.lit(1_000_000)
    return events.join(rates, "model", "left").withColumn("cost_usd", bill.cast("decimal(38,8)")).drop(
        "input_price", "output_price"
    )


def costed_calls(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Finished LLM calls with token data, their agent's metadata and cost."""
    cost = cost_default(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    calls = llm_ends_with_tokens(events).select(
        "agent_id", "model", "ts", "input_tokens", "output_tokens", "total_tokens",
        cost.alias("cost_usd"), F.to_date("ts").alias("date"),
    )
    return with_agent_metadata(calls, agents)


LEVELS = {
    "agent": ["agent_id", "team_id", "project_id", "cost_center", "model"],
    "team": ["team_id"],
    "project": ["project_id"],
    "cost_center": ["cost_center"],
}


def cost_by(calls: DataFrame, level: str) -> DataFrame:
    """Daily cost at one level of the organisation."""
    total = F.sum("cost_usd").alias("total_cost_usd")
    if level == "agent":
        measures = [
            total,
            F.sum("input_tokens").alias("total_prompt_tokens"),
            F.sum("output_tokens").alias("total_completion_tokens"),
            F.count(F.lit(1)).alias("request_count"),
        ]
    else:
        measures = [
            total,
            F.sum("total_tokens").alias("total_tokens"),
            F.count_distinct("agent_id").alias("active_agents"),
            F.count(F.lit(1)).alias("total_requests"),
        ]
        if level == "cost_center":
            measures.insert(3, F.count_distinct("team_id").alias("active_teams"))
    return calls.groupBy("date", *LEVELS[level]).agg(*measures)


def cost_cube(calls: DataFrame) -> DataFrame:
    """All levels in one pass.

    Calls are first summed per (day, agent, model, dimensions), which is small;
    only that is expanded into the four grouping sets.
    """
    base = calls.groupBy("date", *LEVELS["agent"]).agg(
        F.sum("cost_usd").alias("cost"), F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("calls")
    )
    cols = ["agent_id", "team_id", "project_id", "cost_center", "model"]
    sets = [[F.col("date"), *[F.col(c) for c in LEVELS[level]]] for level in LEVELS]
    grouped = base.groupingSets(sets, "date", *cols).agg(
        F.sum("cost").alias("total_cost_usd"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("calls").alias("total_requests"),
        F.grouping("agent_id").alias("g_agent"),
        F.grouping("team_id").alias("g_team"),
        F.grouping("project_id").alias("g_project"),
    )
    level = (
        F.when(F.col("g_agent") == 0, "agent")
        .when(F.col("g_team") == 0, "team")
        .when(F.col("g_project") == 0, "project")
        .otherwise("cost_center")
    )
    return grouped.select(
        level.alias("level"), "date", *cols, "total_cost_usd", "total_tokens", "total_requests"
    )


def mtd_cost(cost_daily: DataFrame, asof) -> DataFrame:
    """Cost of each cost center from the start of the month up to ``asof``."""
    day = F.to_date(as_ts(asof))
    month = cost_daily.filter((F.col("date") >= F.trunc(day, "MM")) & (F.col("date") <= day))
    return month.groupBy("cost_center").agg(F.sum("total_cost_usd").alias("mtd_cost"))


def over_budget(mtd: DataFrame, budgets: DataFrame) -> DataFrame:
    return mtd.join(budgets, "cost_center").filter(
        F.col("mtd_cost") > F.col("monthly_budget") * F.col("alert_threshold")
    )


def budget_alerts(mtd: DataFrame, budgets: DataFrame) -> DataFrame:
    return over_budget(mtd, budgets).withColumn("alert_type", F.lit("BUDGET_THRESHOLD"))


def cost_summary(cost_daily: DataFrame, budgets: DataFrame, bounded: bool = True) -> DataFrame:
    """Daily cost with month-to-date cost and budget use.

    ``bounded`` sums the month up to the row's day; otherwise everything from
    the month's first day on, later months included.
    """
    if bounded:
        w = Window.partitionBy("cost_center", F.trunc("date", "MM")).orderBy("date")
    else:
        w = Window.partitionBy("cost_center").orderBy(
            F.datediff(F.trunc("date", "MM"), F.lit("1970-01-01").cast("date"))
        ).rangeBetween(0, Window.unboundedFollowing)
    spent = F.sum("total_cost_usd").over(w)
    rows = cost_daily.withColumn("spent", spent).join(
        budgets.select("cost_center", "monthly_budget"), "cost_center", "left"
    )
    budget = F.col("monthly_budget")
    return rows.withColumn("mtd_cost", F.when(budget.isNotNull(), F.col("spent"))).withColumn(
        "budget_utilization_pct", F.try_divide(F.col("mtd_cost").cast("double"), budget.cast("double")) * 100
    ).drop("spent")


def running_mtd(cost_daily: DataFrame) -> DataFrame:
    """Running month-to-date cost per cost center."""
    w = Window.partitionBy("cost_center", F.trunc("date", "MM")).orderBy("date")
    return cost_daily.withColumn("running_mtd", F.sum("total_cost_usd").over(w))


def cost_share(calls: DataFrame, by: str) -> DataFrame:
    """Cost, tokens and share of the total by agent, team, project, cost center or day."""
    key: Column = {
        "agent": F.col("agent_id"),
        "team": F.col("team_id"),
        "project": F.col("project_id"),
        "cost_center": F.col("cost_center"),
        "day": F.date_trunc("day", "ts"),
    }[by]
    sums = calls.groupBy(key.alias(by)).agg(
        F.sum("cost_usd").alias("cost_usd"), F.sum("total_tokens").alias("total_tokens")
    )
    return share_of_total(sums, "cost_usd")


def top_spenders(cost_daily: DataFrame, by: str, k: int = 10) -> DataFrame:
    sums = cost_daily.groupBy(by).agg(F.sum("total_cost_usd").alias("total_cost_usd"))
    return sums.orderBy(F.desc("total_cost_usd"), by).limit(k)


def day_over_day(mart: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Relative change of daily measures against the previous day present for the key."""
    w = Window.partitionBy(*keys).orderBy("date")
    out = mart
    for c in cols:
        prev = F.lag(c).over(w).cast("double")
        out = out.withColumn(f"{c}_prev", prev)
        out = out.withColumn(f"{c}_change", F.try_divide(F.col(c).cast("double") - F.col(f"{c}_prev"), F.col(f"{c}_prev")))
    return out
