import base64
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from spanloom.operators import events as P, remediation as Z, traces as R
from spanloom.sources import files, streams, tables

EVENT = {"event_type": "llm_end", "timestamp": "2024-01-01T10:00:00Z", "agent_id": "a", "trace_id": "t", "span_id": "s",
         "attributes": {"model": "gpt-4o", "token_usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 0}, "status": "completed"}}


def test_raw_day_with_malformed_line(spark, tmp_path):
    folder = tmp_path / "raw/events/2024/01/01/10"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text(json.dumps(EVENT) + "\n{broken\n\n" + json.dumps({**EVENT, "unknown_key": 1}) + "\n")
    events, malformed = files.read_raw_events(spark, str(tmp_path), date(2024, 1, 1))
    rows = events.collect()
    assert malformed.count() == 1
    assert [(r["event_type"], r["total_tokens"], r["status"], r["ts"]) for r in rows] == [("llm_call_end", 7, "success", datetime(2024, 1, 1, 10))] * 2
    _, bad = files.split_bad_records(files.read_raw_json(spark, str(tmp_path / "raw")))
    assert [r["record"] for r in bad.collect()] == ["{broken"]
    ready = files.day_ready(spark, str(tmp_path), date(2024, 1, 1), 3).first()
    assert (ready["events"], ready["malformed"], ready["ready"]) == (2, 1, False)


def test_wrapped_batches(spark, tmp_path):
    def put(name, n, **extra):
        body = {"agent_id": "w", "timestamp": "2024-01-01T10:00:00Z", "event_count": n, "environment": "prod", "events": [dict(EVENT, agent_id=None)] * n}
        (tmp_path / name).write_text(json.dumps({**body, **extra}))

    put("ok.json", 2)
    put("empty.json", 0)
    put("big.json", 6)
    got, refused = files.read_wrapped_batches(spark, str(tmp_path), max_events=5)
    whole, empty = files.read_wrapped_batches(spark, str(tmp_path))
    assert refused.count() == 2 and empty.count() == 1 and whole.count() > got.count()
    assert [(r["agent_id"], r["environment"]) for r in got.collect()] == [("w", "prod")] * 2
    _, rejected = files.validate_batches(files.read_batches(spark, str(tmp_path)), 5)
    assert {r["reason"] for r in rejected.collect()} == {"No events provided", "Too many events (max 5)"}


def test_decode_records(spark):
    enc = lambda b: base64.b64encode(b).decode()
    df = spark.createDataFrame([(enc(json.dumps(EVENT).encode()),), (enc(b"{nope"),), ("***",)], "data string")
    good, bad = streams.decode_records(df)
    assert good.count() == 1 and good.first()["event_type"] == "llm_call_end"
    assert [r["result"] for r in bad.collect()] == ["ProcessingFailed"] * 2


def test_register_table_merges_schemas(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2).select("id", F.lit(1).alias("day")).write.partitionBy("day").parquet(path)
    spark.range(3).select("id", F.lit("x").alias("extra"), F.lit(2).alias("day")).write.mode("append").partitionBy("day").parquet(path)
    spark.sql("DROP TABLE IF EXISTS merged_t")
    got = tables.register_table(spark, "merged_t", path)
    assert got.count() == 5 and "extra" in got.columns
    assert tables.read_table(spark, "merged_t").count() == 5
    spark.sql("DROP TABLE merged_t")


def test_staging_is_replaced(spark):
    spark.sql("DROP TABLE IF EXISTS staging_t")
    tables.write_staging(spark.range(5), "staging_t")
    tables.write_staging(spark.range(2), "staging_t")
    assert spark.table("staging_t").count() == 2
    spark.sql("DROP TABLE staging_t")


def test_error_predicate_is_never_null(spark):
    df = spark.createDataFrame([(None, None, None, None), ("success", None, None, "log"), (None, "E", None, None), (None, None, None, "error")],
                               "status string, error_type string, error_message string, event_type string")
    assert [r[0] for r in df.select(P.is_error()).collect()] == [False, False, True, True]


def test_unmatched_ends_are_dropped_and_open_starts_kept(spark):
    from spanloom.sources.files import to_event_schema

    rows = [("s1", "tool_call_start", "2024-01-01 00:00:00"), ("s1", "tool_call_end", "2024-01-01 00:00:01"), ("s2", "tool_call_end", "2024-01-01 00:00:01"),
            ("s3", "llm_call_start", "2024-01-01 00:00:00"), (None, "tool_call_start", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "span_id string, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df = to_event_schema(df.withColumn("event_id", F.concat_ws("-", "span_id", "event_type")))
    got = {r["span_id"]: (r["status"], r["duration_ms"]) for r in R.pair_spans(df).collect()}
    assert got == {"s1": ("success", 1000.0), "s3": ("running", None)}


def test_trace_sampling_keeps_traces_whole(spark):
    df = spark.range(5000).select((F.col("id") % 500).cast("string").alias("trace_id"), "id")
    kept = P.sample_events(df, 0.3, seed=1)
    sizes = {r["count"] for r in kept.groupBy("trace_id").count().collect()}
    assert sizes == {10} and 0.2 < kept.count() / 5000 < 0.4


def test_manual_actions_are_skipped_and_critical_failure_stops(spark):
    t = "results array<struct<automated:boolean,success:boolean,critical:boolean>>"
    rows = [([(True, True, False), (False, False, True)],), ([(True, False, False), (True, True, False)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, t).select(Z.final_status(F.col("results"))).collect()]
    assert got == ["completed", "failed", "completed"]
    stop = spark.createDataFrame([([(True, True, False), (True, False, True), (True, True, False)],)], t)
    assert stop.select(F.size(Z.executed_actions(F.col("results")))).first()[0] == 2


def test_compare_cost_rules(spark):
    from spanloom.functions import pricing as M

    df = spark.createDataFrame([("gpt-4-turbo-x", 1000, 1000), ("mystery", 1_000_000, None), (None, 1_000_000, 0)], "m string, i long, o long")
    args = [F.col("m"), F.col("i"), F.col("o")]
    got = df.select(
        M.cost_substring(*args).alias("first"), M.cost_substring(*args, longest_match=True).alias("longest"),
        M.cost_default(*args).alias("d"), M.cost_exact(*args).alias("z"), M.cost_exact(*args, unknown="null").alias("n"),
    ).collect()
    assert [float(got[0][c]) for c in ("first", "longest")] == [0.09, 0.04]
    assert float(got[1]["d"]) == 3.0 and float(got[1]["z"]) == 0.0 and got[1]["n"] is None and float(got[2]["d"]) == 3.0
