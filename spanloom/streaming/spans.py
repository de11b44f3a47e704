"""Streaming span pairing, heartbeat and region health."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reliability import FAILURES_UNHEALTHY, SUCCESSES_HEALTHY
from ..schema import END_EVENTS, START_EVENTS


def stream_pair_spans(events: DataFrame, max_duration: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    """Start events joined with their end within ``max_duration``.

    An end without a start never appears; a start without an end appears, still
    open, once the watermark has passed its limit.  Of repeated starts or ends of a
    span the first to arrive counts; an end that doesn't say so has succeeded.
    """
    keyed = events.filter(F.col("span_id").isNotNull())
    starts = keyed.filter(F.col("event_type").isin(START_EVENTS)).select(
        "span_id", "trace_id", "agent_id", "name", F.col("event_type").alias("start_event_type"), F.col("ts").alias("start_time")
    ).withWatermark("start_time", late).dropDuplicatesWithinWatermark(["span_id"])
    ends = keyed.filter(F.col("event_type").isin(END_EVENTS)).select(
        F.col("span_id").alias("end_span_id"), F.col("ts").alias("end_time"), "duration_ms", "success", "error_message"
    ).withWatermark("end_time", late).dropDuplicatesWithinWatermark(["end_span_id"])
    on = (
        (F.col("span_id") == F.col("end_span_id"))
        & (F.col("end_time") >= F.col("start_time"))
        & (F.col("end_time") <= F.col("start_time") + F.expr(f"INTERVAL {max_duration}"))
    )
    status = F.when(F.col("end_time").isNull(), "running").when(F.coalesce("success", F.lit(True)), "success").otherwise("error")
    return starts.join(ends, on, "left_outer").withColumn("status", status).drop("end_span_id", "success")


def stream_last_seen(events: DataFrame) -> DataFrame:
    """Latest event time per agent (update or complete mode)."""
    return events.groupBy("agent_id").agg(F.max("ts").alias("last_seen"))


_OUT = "region_id string, check_id bigint, ts timestamp, ok boolean, run_length bigint, status string"
_STATE = "ok boolean, run_length bigint, status string"
_UNKNOWN = 2
_NO_TIME = np.iinfo(np.int64).min  # as numpy has it
_AT_ONCE = 10_000  # rows of a result's part


def _numbers(checks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times in nanoseconds, ids, whether an id is missing, outcomes as 0, 1 or _UNKNOWN."""
    ids, ok = checks["check_id"], checks["ok"]
    return (
        checks["ts"].to_numpy("datetime64[ns]").view(np.int64),
        ids.fillna(0).to_numpy(np.int64),
        ids.isna().to_numpy(bool),
        np.where(ok.isna(), _UNKNOWN, ok == True).astype(np.int8),  # noqa: E712
    )


def stream_health(checks: DataFrame, fail: int = FAILURES_UNHEALTHY, recover: int = SUCCESSES_HEALTHY) -> DataFrame:
    """Status after each check, with the run length and status kept as state per region.

    A task keeps only numbers of a region's checks, about 40 bytes each, and gives its results in parts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ok, run, status = state.get if state.exists else (None, 0, "unknown")
        parts = [_numbers(f) for f in frames]
        ts, ids, no_id, ok = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, no_id, ts, ts == _NO_TIME))  # missing times and ids come last
        for lo in range(0, len(order), _AT_ONCE):
            now = order[lo : lo + _AT_ONCE]
            runs, marks, good = [], [], ok[now]
            for x in good.tolist():
                # A check without an outcome begins a run of failures.
                run = run + 1 if x == last_ok else 1
                last_ok = x == 1
                if last_ok and run >= recover:
                    status = "healthy"
                elif not last_ok and run >= fail:
                    status = "unhealthy"
                elif not last_ok and run >= max(fail // 2, 1):
                    status = "degraded"
                runs.append(run)
                marks.append(status)
            yield pd.DataFrame({
                "region_id": key[0], "check_id": pd.array(np.where(no_id[now], 0, ids[now]), "Int64"), "ts": ts[now].view("datetime64[ns]"),
                "ok": pd.array(good == 1, "boolean"), "run_length": runs, "status": marks,
            }).assign(check_id=lambda d: d["check_id"].mask(no_id[now]), ok=lambda d: d["ok"].mask(good == _UNKNOWN))
        state.update((last_ok, run, status))

    slim = checks.select("region_id", "check_id", "ts", "ok")
    return slim.groupBy("region_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
