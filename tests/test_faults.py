"""Cases that once gave wrong answers."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import alerts as A, ordered as O, traces as R
from spanloom.plans import daily, sample as S
from spanloom.sources import files, streams as SS, tables
from spanloom.streaming import alerts as SA

T0 = datetime(2024, 1, 1)


def test_rows_without_a_time_stay(spark):
    rows = [("k", None, "0"), ("k", T0, "1"), ("k", T0 + timedelta(hours=2), "2")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, event_id string")
    out = O.ordered_scan(df, ["k"], row_number="n", lag={"before": "event_id"}).orderBy("n").collect()
    assert [(r.n, r.event_id, r.before) for r in out] == [(1, "0", None), (2, "1", "0"), (3, "2", "1")]


def test_span_tree_of_cycles_duplicates_and_orphans(spark):
    rows = [
        ("t", "a", "b"), ("t", "b", "a"), ("t", "below", "a"), ("t", "self", "self"), ("t", "r", None), ("t", "c", "r"), ("t", "c", "r"),
        ("t", "d", "c"), ("t", "lost", "nowhere"), ("t", None, "r"), ("u", "c", None), (None, "x", None), (None, "y", "x"),
    ]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")
    out = {}
    got = R.span_tree(df).collect()
    for r in got:
        out.setdefault((r.trace_id, r.span_id), []).append((r.root_span_id, r.depth, r.path, r.cycle))
    assert len(got) == len(rows)
    assert all(out["t", s] == [(None, None, None, True)] for s in ("a", "b", "below", "self"))
    assert out["t", "c"] == [("r", 1, "r/c", False)] * 2 and out["t", "d"] == [("r", 2, "r/c/d", False)] and out["u", "c"] == [("c", 0, "c", False)]
    assert out["t", "lost"] == [("lost", 0, "lost", False)] and out["t", None] == [(None, None, None, False)] and out[None, "y"] == [("x", 1, "x/y", False)]


def test_partition_is_replaced_by_nothing(spark, tmp_path):
    path, df = str(tmp_path / "mart"), spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "v int, date date")
    tables.write_mart(df, path)
    tables.write_mart(df.limit(0), path, values=[date(2024, 1, 1)])
    assert [r.v for r in spark.read.parquet(path).collect()] == [2]


def test_quota_is_shared_by_all_agents(spark):
    df = spark.createDataFrame([(f"a{i}", T0 + timedelta(minutes=j), f"{i}-{j}") for i in range(7) for j in range(4)], "agent_id string, ts timestamp, event_id string")
    names = [f"a{i}" for i in range(7)]
    assert O.latest_quota(df, names, 14).count() == 14
    with pytest.raises(ValueError):
        O.latest_quota(df, names, 14, max_agents=5)


def test_daily_run_over_late_events(spark, sf, tmp_path):
    store, events = str(tmp_path / "store"), S.events(spark, sf)
    assert events.select(F.to_date("ts")).distinct().count() > 1
    rows = daily.run_daily(spark, events, S.agents(spark, sf), S.budgets(spark, sf), store, date(2024, 1, 30), "2024-01-30 12:00:00")
    keys = {
        "token_usage_daily": ["agent_id", "model", "date"], "tool_performance_daily": ["agent_id", "tool_name", "date"],
        "tool_transitions": ["agent_id", "date", "from_tool", "to_tool"], "cost_by_team_daily": ["date", "team_id"],
        "error_patterns_daily": ["date", "error_fingerprint", "agent_id", "event_type", "error_type"],
    }
    for name, key in keys.items():
        table = spark.read.parquet(f"{store}/{name}")
        assert table.count() == rows[name] == table.select(*key).distinct().count(), name
    first = daily.read_master(spark, store)
    n, total = first.count(), first.agg(F.sum("occurrence_count")).first()[0]
    daily.run_daily(spark, events, S.agents(spark, sf), S.budgets(spark, sf), store, date(2024, 1, 30), "2024-01-30 12:00:00")
    again = daily.read_master(spark, store)
    assert (again.count(), again.agg(F.sum("occurrence_count")).first()[0]) == (n, total)


def test_documents_of_short_and_long_traces(spark):
    rows = [(t, f"a{i % 2}", f"{t}-{i // 2}", T0 + timedelta(seconds=(i * 37) % 400) if i % 9 else None) for t, n in (("long", 90), ("short", 12), (None, 50)) for i in range(n)]
    events = spark.createDataFrame(rows, "trace_id string, agent_id string, event_id string, ts timestamp")
    events = files.to_event_schema(events)
    outs = [sorted(map(str, R.trace_documents(events, 10, most).collect())) for most in (0, 40, 1000)]
    assert outs[0] == outs[1] == outs[2] and sum(r["items"] for r in R.trace_documents(events, 10, 40).collect()) == 152


ALERT = "alert_id string, agent_id string, anomaly_type string, severity string, ts timestamp, metrics map<string,double>"


def test_stream_counts_over_batches(spark, tmp_path):
    for b in range(3):
        rows = [(f"{b}-{i}", "a", "errors", "critical", T0 + timedelta(minutes=10 * b + i), {"error_rate": 0.5}) for i in range(4)]
        spark.createDataFrame(rows, ALERT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SS.read_table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, max_files=1)
    base = str(tmp_path / "out")
    SA.start_dedup(stream, base, str(tmp_path / "ckpt"), trigger={"availableNow": True}).awaitTermination()
    cache = spark.read.parquet(f"{base}/cache/batch_id=2").collect()
    assert [(r["last_sent"], r["count"]) for r in cache] == [(T0, 12)]
    assert spark.read.parquet(f"{base}/alerts").filter("sent").count() == 1


def test_late_alerts_follow_the_rule(spark):
    at = lambda h: T0 + timedelta(hours=h)
    old = spark.createDataFrame([("x", "a", "errors", "critical", at(200), {"error_rate": 0.5})], ALERT)
    cache = A.alert_cache(A.dedup_alerts(A.with_fingerprint(old)))
    rows = [("l1", "a", "errors", "critical", at(100), {"error_rate": 0.5}), ("l2", "a", "errors", "critical", at(110), {"error_rate": 0.5}),
            ("n", "a", "errors", "critical", at(190), {"error_rate": 0.5}), ("s", "a", "errors", "critical", at(210), {"error_rate": 0.5}), ("f", "a", "errors", "critical", at(224), {"error_rate": 0.5})]
    out = {r.alert_id: (r.sent, r.late, r.sent_by) for r in A.dedup_alerts(A.with_fingerprint(spark.createDataFrame(rows, ALERT)), cache=cache).collect()}
    assert out == {
        "l1": (True, True, at(100)), "l2": (False, True, at(100)), "n": (False, True, at(200)), "s": (False, False, at(200)), "f": (True, False, at(224)),
    }
