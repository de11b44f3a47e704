"""Joins of the dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def agent_overview(agents: DataFrame, teams: DataFrame, projects: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Agents with team and project names and the number of active keys."""
    keys = api_keys.filter("is_active").groupBy("agent_id").agg(F.count(F.lit(1)).alias("active_api_keys"))
    team = teams.select("team_id", F.col("name").alias("team_name"))
    project = projects.select("project_id", F.col("name").alias("project_name"))
    out = agents.join(team, "team_id", "left").join(project, "project_id", "left").join(keys, "agent_id", "left")
    return out.withColumn("active_api_keys", F.coalesce("active_api_keys", F.lit(0)))


def agent_details(agents: DataFrame, teams: DataFrame, projects: DataFrame, users: DataFrame, rules: DataFrame) -> DataFrame:
    """Active agents with team, project, owner and their number of alert rules."""
    counts = rules.groupBy("agent_id").agg(F.count("rule_id").alias("alert_rule_count"))
    rows = (
        agents.filter("is_active")
        .join(teams.select("team_id", F.col("name").alias("team_name")), "team_id")
        .join(projects.select("project_id", F.col("name").alias("project_name")), "project_id")
        .join(users.select(F.col("user_id").alias("owner_id"), F.col("name").alias("created_by")), "owner_id")
        .join(counts, "agent_id", "left")
    )
    return rows.select(
        "agent_id", "name", "team_name", "project_name", "created_by",
        F.coalesce("alert_rule_count", F.lit(0)).alias("alert_rule_count"),
    )


def list_agents(agents: DataFrame, agent_ids: list[str] | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    if agent_ids:
        return agents.filter(F.col("agent_id").isin(list(agent_ids)))
    rows = agents if status is None else agents.filter(F.col("status") == status)
    return rows.orderBy("agent_id").limit(limit)
