"""Health as composed changes of state equals a sequential pass; ordered scans read their source once."""

import random
from datetime import datetime, timedelta

import pytest

from spanloom.operators import reliability as R
from spanloom.operators.ordered import ordered_scan
from spanloom.plans.catalog import ENTRIES

T0 = datetime(2024, 1, 1)
SCHEMA = "region_id string, ts timestamp, check_id long, ok boolean, latency_ms double, status string"


def log(n=2500, seed=4):
    """One region with half of all checks, long equal runs over many pieces, ties, missing outcomes and times."""
    rng = random.Random(seed)
    state, rows = {}, []
    for i in range(n):
        region = rng.choice(["hot", "hot", "a", "b", None])
        state[region] = state.get(region, True) if rng.random() < rng.choice([0.2, 0.97]) else rng.choice([True, False])
        at = None if i % 400 == 7 else T0 + timedelta(seconds=rng.randrange(4000))
        rows.append((region, at, i, None if i % 97 == 5 else state[region], rng.random(), "mine"))
    return rows


def sequential(rows, fail, recover):
    out = {}
    for region in {r[0] for r in rows}:
        run, before, status = 0, "none yet", "unknown"
        for _, _, check, ok, *_ in sorted((r for r in rows if r[0] == region), key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
            run, before = (run + 1 if ok is before else 1), ok
            if ok is True and run >= recover:
                status = "healthy"
            elif ok is False and run >= fail:
                status = "unhealthy"
            elif ok is False and run >= max(fail // 2, 1):
                status = "degraded"
            out[check] = (run, status)
    return out


@pytest.mark.parametrize("fail, recover, piece", [(3, 2, 60), (7, 4, 5), (2, 1, 100_000)])
def test_state_equals_a_sequential_pass(spark, fail, recover, piece):
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA).drop("status").repartition(4)
    got = {r.check_id: (r.run_length, r.status) for r in R.with_state(df, fail, recover, piece).collect()}
    assert got == sequential(rows, fail, recover)


def test_empty_log(spark):
    df = spark.createDataFrame([], SCHEMA).drop("status")
    assert R.health_timeline(df).count() == 0 and R.circuit_intervals(df).count() == 0


def scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.mark.parametrize("wanted", [{"row_number": "n"}, {"lag": {"before": "latency_ms"}}, {"last_value": {"seen": "ok"}}, {"running_sum": {"total": "latency_ms"}}])
def test_an_ordered_scan_reads_its_source_once(spark, tmp_path, wanted):
    from pyspark.sql import functions as F

    path = str(tmp_path / "log")
    spark.createDataFrame(log(500), SCHEMA).write.parquet(path)
    wanted = {k: {o: F.col(c) for o, c in v.items()} if k in ("last_value", "running_sum") else v for k, v in wanted.items()}
    df = ordered_scan(spark.read.parquet(path), ["region_id"], "ts", "check_id", **wanted)
    assert scans(df) == 1 and scans(df.select("check_id", df.columns[-1])) == 1


def test_health_reads_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(log(500), SCHEMA).drop("status").write.parquet(path)
    checks = spark.read.parquet(path)
    assert scans(R.health_timeline(checks)) == 1 and scans(R.health_timeline(checks).select("check_id", "status")) == 1
    assert scans(R.circuit_intervals(checks)) == 1


@pytest.mark.parametrize("name", ["previous_tool", "rolling_region_latency", "zscore_outliers", "tool_transitions"])
def test_registered_scans_read_once(spark, sf, name):
    assert scans(ENTRIES[name].run(spark, sf)) == 1
