from datetime import datetime, timedelta

import pytest

from spanloom.operators import alerts as A, anomalies as N
from spanloom.streaming import alerts as SA

T0 = datetime(2024, 1, 1)
SCHEMA = "alert_fingerprint string, alert_id string, ts timestamp"


def _alerts(spark, hours, fp="f"):
    rows = [(fp, f"{fp}{i:04d}", T0 + timedelta(hours=h)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, SCHEMA)


def _sent(df):
    return [r["ts"] for r in df.filter("sent").orderBy("ts").collect()]


def _greedy(times, window, last=None):
    sent = []
    for t in sorted(times):
        if last is None or t - last >= window:
            sent.append(t)
            last = t
    return sent


def test_window_counts_from_the_last_send(spark):
    """A chain of 23-hour gaps sends every second alert; exactly 24 hours later is sent."""
    got = A.dedup_alerts(_alerts(spark, [0, 23, 46, 69, 93, 117]))
    assert _sent(got) == [T0 + timedelta(hours=h) for h in (0, 46, 93, 117)]


@pytest.mark.parametrize("hours", [24, 1.5, 0])
def test_equals_sequential_pass(spark, hours):
    import random

    rnd = random.Random(5)
    times = {fp: [rnd.randrange(0, 12 * 24 * 60) / 60 for _ in range(n)] for fp, n in [("a", 80), ("b", 3), ("c", 30)]}
    df = None
    for fp, hs in times.items():
        part = _alerts(spark, hs, fp)
        df = part if df is None else df.unionByName(part)
    got = A.dedup_alerts(df, hours)
    assert got.count() == 113
    for fp, hs in times.items():
        want = _greedy([T0 + timedelta(hours=h) for h in hs], timedelta(hours=hours))
        assert _sent(got.filter(f"alert_fingerprint = '{fp}'")) == want


def test_many_times_of_one_rule(spark):
    """One fingerprint with 100,000 times, and cooldowns of 0 and of an hour: rounds grow with the logarithm of the path."""
    df = spark.range(100_000).selectExpr("'f' AS alert_fingerprint", "lpad(string(id), 6, '0') AS alert_id", "timestamp_seconds(1704067200 + id * 7) AS ts")
    assert A.dedup_alerts(df, 0).filter("sent").count() == 100_000
    got = [r["t"] for r in A.dedup_alerts(df, 1).filter("sent").selectExpr("unix_seconds(ts) - 1704067200 AS t").orderBy("t").collect()]
    step = -(-3600 // 7) * 7
    assert got == list(range(0, 7 * 100_000, step))


def test_cache_carries_over(spark):
    cache = spark.createDataFrame([("f", T0 - timedelta(hours=10))], "alert_fingerprint string, last_sent timestamp")
    got = A.dedup_alerts(_alerts(spark, [0, 13, 14, 20]), cache=cache)
    assert _sent(got) == [T0 + timedelta(hours=14)]
    by = {r["ts"]: r["sent_by"] for r in got.collect()}
    assert by[T0] == T0 - timedelta(hours=10)


def test_same_moment_sends_once(spark):
    got = A.dedup_alerts(_alerts(spark, [0, 0, 0]))
    assert [r["alert_id"] for r in got.filter("sent").collect()] == ["f0000"]


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    hours = [0, 5, 23, 24, 30, 47.5, 48, 60, 72, 95, 96, 97]
    whole = _sent(A.dedup_alerts(_alerts(spark, hours)))
    base = str(tmp_path / "dedup")
    for i in range(0, len(hours), 4):
        rows = [("f", f"x{i}{j}", T0 + timedelta(hours=h)) for j, h in enumerate(hours[i : i + 4])]
        batch = spark.createDataFrame(rows, SCHEMA)
        SA.dedup_batch(batch, i // 4, base)
        SA.dedup_batch(batch, i // 4, base)  # a replayed batch changes nothing
    assert _sent(spark.read.parquet(f"{base}/alerts")) == whole


def test_cooldown_per_rule(spark):
    rows = [("r1", "a", T0 + timedelta(minutes=m), 10) for m in (0, 5, 10, 15, 20)] + [("r2", "a", T0 + timedelta(minutes=m), 0) for m in (0, 5)]
    df = spark.createDataFrame(rows, "rule_id string, agent_id string, window_start timestamp, cooldown_minutes int")
    got = A.rule_alerts(df).filter("sent").groupBy("rule_id").count().collect()
    assert {r["rule_id"]: r["count"] for r in got} == {"r1": 3, "r2": 2}


def test_unknown_severity_goes_to_info(spark):
    df = spark.createDataFrame([("a", "weird"), ("b", None), ("c", "CRITICAL")], "alert_id string, severity string")
    got = {r["alert_id"]: (r["topic"], r["page"]) for r in A.with_topic(df).collect()}
    assert got == {"a": ("info", False), "b": ("info", False), "c": ("critical", True)}


def test_fingerprint_ignores_metric_values_and_empty_maps(spark):
    df = spark.createDataFrame(
        [("a", "t", {"y": 1.0, "x": 2.0}), ("a", "t", {"x": 9.0, "y": 9.0}), ("a", "t", {})],
        "agent_id string, anomaly_type string, metrics map<string,double>",
    )
    marks = [r["alert_fingerprint"] for r in A.with_fingerprint(df).collect()]
    import hashlib

    assert marks[0] == marks[1] == hashlib.sha256(b"a|t|x,y").hexdigest()
    assert marks[2] == hashlib.sha256(b"a|t").hexdigest()


def test_burst_thresholds(spark):
    rows = [("a", T0, f"{i}", "E", "m" * 300) for i in range(5)] + [("b", T0, f"{i}", "E", None) for i in range(10)] + [("c", T0, f"{i}", "E", "") for i in range(4)]
    df = spark.createDataFrame(rows, "agent_id string, ts timestamp, event_id string, error_type string, error_message string")
    got = {r["agent_id"]: r for r in N.error_burst_anomalies(df, "2024-01-01 00:05:00").collect()}
    assert {k: r["severity"] for k, r in got.items()} == {"a": "warning", "b": "critical"}
    assert len(got["b"]["recent_errors"]) == 5 and len(got["a"]["recent_errors"][0]["error_message"]) == 200
