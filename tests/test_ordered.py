"""Piecewise windows equal plain windows, also when one key dominates."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from spanloom.operators import anomalies, ordered as O

T0 = datetime(2024, 1, 1)


def _rows(seed=1, n=3000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        at = T0 + timedelta(seconds=rnd.randrange(0, 7200))  # many ties
        out.append((key, at, i, rnd.choice([None, "x", "y", "z"]), rnd.randrange(100)))
    return out


def _frame(spark):
    return spark.createDataFrame(_rows(), "k string, ts timestamp, event_id long, tool string, v long")


def test_ordered_scan_equals_windows(spark):
    df = _frame(spark)
    got = O.ordered_scan(
        df, ["k"], row_number="n", lag={"prev": "tool"}, running_sum={"s": F.col("v")}, last_value={"l": F.col("tool")}, piece_seconds=60
    )
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.lag("tool").over(w).alias("prev"),
        F.sum("v").over(upto).alias("s"), F.last("tool", ignorenulls=True).over(upto).alias("l"),
    )
    assert got.count() == 3000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_blocked_frame_equals_window(spark):
    df = O.ordered_scan(_frame(spark), ["k"], row_number="seq")
    make = lambda w: {"m": F.avg("v").over(w.rowsBetween(-9, 0)), "p": F.lag("v", 2).over(w)}
    got = O.blocked_frame(df, ["k"], "seq", 9, make, block=50)
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select("*", F.avg("v").over(w.rowsBetween(-9, 0)).alias("m"), F.lag("v", 2).over(w).alias("p"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_keyset_pages_cover_everything(spark):
    df = _frame(spark).select("ts", "event_id")
    last, seen = None, []
    while True:
        rows = O.page_after(df, "ts", "event_id", last, 700).collect()
        if not rows:
            break
        seen += [r["event_id"] for r in rows]
        last = (rows[-1]["ts"], rows[-1]["event_id"])
    assert sorted(seen) == list(range(3000))


def test_alarm_needs_consecutive_periods(spark):
    rows = [("a", T0 + timedelta(minutes=5 * i), float(v)) for i, v in enumerate([9, 9, 1, 9, None, 9, 9, 9]) if v is not None]
    df = spark.createDataFrame(rows, "agent_id string, ts timestamp, measure_value double")
    got = anomalies.alarm_state(df, ["agent_id"], 5, 2).orderBy("alarm_from").collect()
    assert [(r["alarm_from"], r["alarm_until"], r["breaches"]) for r in got] == [
        (T0 + timedelta(minutes=5), T0 + timedelta(minutes=10), 2),
        (T0 + timedelta(minutes=30), T0 + timedelta(minutes=40), 3),
    ]
