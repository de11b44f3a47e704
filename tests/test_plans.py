"""Shape of the physical plans."""

import pytest

from spanloom.plans import sample as S
from spanloom.plans.catalog import ENTRIES
from spanloom.operators import tokens, tools, traces


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["token_usage_hourly", "cost_cube", "error_patterns_daily", "traces_archive", "tool_transitions", "scrubbed_documents", "similar_investigations", "region_health", "analysis_sections"])
def test_no_python_in_native_queries(spark, sf, name):
    plan = plan_of(ENTRIES[name].run(spark, sf))
    assert "EvalPython" not in plan and "PandasUDF" not in plan and "CartesianProduct" not in plan


def test_rollup_scans_only_its_columns(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    S.events(spark, sf).write.parquet(path)
    plan = plan_of(tokens.token_usage_hourly(spark.read.parquet(path)))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "model" in schema and "error_message" not in schema and "tool_name" not in schema
    assert "PushedFilters: [In(event_type" in plan


def test_one_grouped_shuffle(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    S.events(spark, sf).write.parquet(path)
    events = spark.read.parquet(path)
    for df in (tools.tool_usage_hourly(events), traces.reconstruct_traces(events), traces.pair_spans(events)):
        assert plan_of(df).count("Exchange hashpartitioning") == 1


def test_top_k_per_key_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan_of(ENTRIES["latest_traces_per_agent"].run(spark, sf))


def test_scans_in_a_row_read_the_log_once(spark, sf):
    """In the plan as it ran: an exchange that is used again stands only once there."""
    for name in ("region_health", "circuit_intervals", "rolling_region_latency"):
        df = ENTRIES[name].run(spark, sf)
        df.collect()
        assert plan_of(df).split("== Initial Plan ==")[0].count("FileScan parquet") == 1
