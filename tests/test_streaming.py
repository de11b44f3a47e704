from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom.operators import reliability as H
from spanloom.sources import streams as SS
from spanloom.sources.files import to_event_schema
from spanloom.streaming import router as SR, spans as SP

T0 = datetime(2024, 1, 1)


def _feed(spark, path, schema, batches):
    """A folder with one file per batch, read one file per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return SS.read_table_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


def test_open_span_comes_out_after_the_watermark(spark, tmp_path):
    schema = "span_id string, event_type string, ts timestamp, event_id string"
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [
        [("s1", "tool_call_start", at(0), "1"), ("s2", "tool_call_start", at(1), "2"), ("s9", "tool_call_end", at(1), "9")],
        [("s1", "tool_call_end", at(2), "3")],
        [("s3", "tool_call_start", at(300), "4"), ("s3", "tool_call_end", at(300), "5")],
    ]
    stream = to_event_schema(_feed(spark, str(tmp_path / "in"), schema, batches))
    out = SR.drain(SP.stream_pair_spans(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {r["span_id"]: (r["status"], r["end_time"]) for r in out.collect()}
    assert got["s1"][1] == at(2) and got["s2"] == ("running", None) and "s9" not in got


def test_health_over_batches_equals_batch(spark, tmp_path):
    oks = [True, True, False, False, False, True, True, False, True, True, True, False]
    rows = [("r", T0 + timedelta(minutes=i), i, ok, 1.0) for i, ok in enumerate(oks)]
    schema = "region_id string, ts timestamp, check_id long, ok boolean, latency_ms double"
    stream = _feed(spark, str(tmp_path / "in"), schema, [rows[:5], rows[5:6], rows[6:]])
    out = SR.drain(SP.stream_health(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    batch = H.health_timeline(spark.createDataFrame(rows, schema))
    key = lambda df: [(r["check_id"], r["run_length"], r["status"]) for r in df.orderBy("check_id").collect()]
    assert key(out) == key(batch)
    assert [s for _, _, s in key(batch)][:5] == ["unknown", "healthy", "degraded", "degraded", "unhealthy"]


def test_router_is_idempotent_and_counts(spark, tmp_path):
    rows = [("e1", "error", T0, "a", "t"), ("e2", "tool_call_end", T0, "a", "t"), ("e3", "llm_call_start", T0, "a", "t")]
    batch = to_event_schema(spark.createDataFrame(rows, "event_id string, event_type string, ts timestamp, agent_id string, trace_id string")).withColumn("duration_ms", F.lit(5.0))
    base = str(tmp_path)
    for _ in range(2):
        counts = SR.route_batch(batch, 0, base)
    assert counts == {"records_processed": 3, "errors_detected": 1, "metrics_written": 1}
    assert spark.read.parquet(f"{base}/errors").count() == 1
    assert spark.read.parquet(f"{base}/points").count() == 1
    assert spark.read.parquet(f"{base}/index").count() == 3


def test_stream_of_messages_keeps_no_pairs(spark, tmp_path):
    from spanloom.operators import alerts as A
    from spanloom.streaming import alerts as SA

    subs = spark.createDataFrame(
        [(f"c{i % 30}" if i else None, "t" if i % 3 else "u", f"a{i % 4}" if i % 2 else None) for i in range(60)],
        "connection_id string, subscription_type string, agent_filter string",
    )
    rows = [(f"m{i}", "t" if i % 5 else None, f"a{i % 6}" if i % 7 else None) for i in range(40)]
    schema = "message_id string, message_type string, agent_id string"
    stream = _feed(spark, str(tmp_path / "in"), schema, [rows[:11], rows[11:]])
    base = str(tmp_path / "fanout")
    SA.start_fanout(stream, subs, base, str(tmp_path / "ckpt"), trigger={"availableNow": True}).awaitTermination()
    pairs = lambda df: sorted((r["message_id"], r["connection_id"] or "") for r in df.collect())
    wanted = sorted(
        (m[0], s["connection_id"] or "") for m in rows for s in subs.collect()
        if m[1] == s["subscription_type"] and (m[2] is None or s["agent_filter"] in (None, m[2]))
    )
    assert pairs(SA.read_fanout(spark, base)) == wanted == pairs(A.route_to_subscriptions(spark.createDataFrame(rows, schema), subs))
    assert spark.read.parquet(f"{base}/addressed").count() <= 2 * len(rows)


def test_health_of_checks_without_outcome_id_or_time(spark, tmp_path):
    rows = [("r", T0 + timedelta(minutes=i), i, i % 5 != 0) for i in range(30)]
    rows += [("r", T0 + timedelta(minutes=40), None, True), ("r", T0 + timedelta(minutes=40), 31, None), ("r", None, 32, False), (None, T0, 33, True)]
    stream = _feed(spark, str(tmp_path / "in"), "region_id string, ts timestamp, check_id long, ok boolean", [rows])
    out = SR.drain(SP.stream_health(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {r["check_id"]: (r["region_id"], r["ts"], r["ok"], r["run_length"], r["status"]) for r in out.collect()}
    at = T0 + timedelta(minutes=40)
    assert len(got) == 34 and got[29] == ("r", T0 + timedelta(minutes=29), True, 4, "healthy")
    assert got[31] == ("r", at, None, 1, "degraded") and got[None] == ("r", at, True, 1, "degraded")
    assert got[32] == ("r", None, False, 1, "degraded") and got[33][0] is None
    # Numbers alone are kept of a check while its region is put in order.
    import pandas as pd

    kept = SP._numbers(pd.DataFrame({"ts": pd.to_datetime([T0]), "check_id": [1], "ok": [True]}))
    assert sum(x.nbytes for x in kept) == 18
