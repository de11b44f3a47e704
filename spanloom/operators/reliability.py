"""Region health from check logs (region_id, ts, check_id, ok, latency_ms).

What a check does to a region's state depends on the state before it.  Each piece of the log is summed up as such a
change of state, changes are put together in order over the summaries alone, and every piece is then finished with
the state it begins in.  The log is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import blocked_frame, in_pieces, ordered_scan

# Defaults of the health rules.
FAILURES_UNHEALTHY = 3
SUCCESSES_HEALTHY = 2
FAILURES_OPEN = 5
OPEN_SECONDS = 60
LATENCY_HISTORY = 10


def rolling_latency(checks: DataFrame, n: int = LATENCY_HISTORY) -> DataFrame:
    """Mean latency of the last ``n`` successful checks, up to and including each one."""
    good = ordered_scan(checks.filter("ok"), ["region_id"], "ts", "check_id", row_number="seq")
    if n == 1:
        return good.withColumn("rolling_ms", F.col("latency_ms")).drop("seq")
    mean = lambda w: {"rolling_ms": F.avg("latency_ms").over(w.rowsBetween(-(n - 1), 0))}
    return blocked_frame(good, ["region_id"], "seq", n - 1, mean).drop("seq")


def _verdict(ok: Column, n: Column, fail: int, recover: int) -> Column:
    """What the n-th equal outcome in a row says, if anything; a longer run never says less."""
    return (
        F.when(ok & (n >= recover), "healthy")
        .when(~ok & (n >= fail), "unhealthy")
        .when(~ok & (n >= max(fail // 2, 1)), "degraded")
    )


def with_state(checks: DataFrame, fail: int = FAILURES_UNHEALTHY, recover: int = SUCCESSES_HEALTHY, piece_seconds: int = 60) -> DataFrame:
    """``checks`` with run_length, the position of each check in its run of equal outcomes, and the status after it.

    A piece begins with a run that may go on from the piece before, so its first run's length and outcome stay open;
    all later runs, and what they say, are known within the piece.  A check without an outcome is a run of its own kind
    and says nothing.
    """
    group = ["__key", "__piece"]
    work = in_pieces(checks, ["region_id"], "ts", {}, piece_seconds)
    of = lambda name: F.col("__row")[name]
    local = Window.partitionBy(*group).orderBy(of("ts"), of("check_id"))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = work.withColumns({
        "__n": F.row_number().over(local).cast("long"), "__self": F.lag("__row", 0).over(local), "__ok": of("ok"), "__prev": F.lag(of("ok")).over(local),
    })
    begins = (F.col("__n") > 1) & ~F.col("__prev").eqNullSafe(F.col("__ok"))
    rows = rows.withColumn("__start", F.last(F.when(begins, F.col("__n")), ignorenulls=True).over(upto))
    known = _verdict(F.col("__ok"), F.col("__n") - F.col("__start") + 1, fail, recover)
    pieces = rows.groupBy(*group).agg(
        F.max_by("__row", "__n").alias("__end"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("__ok", "__n").alias("first_ok"),
        F.max_by("__ok", "__n").alias("last_ok"),
        F.count_if(F.col("__start").isNull()).alias("first_run"),
        (F.count(F.lit(1)) - F.coalesce(F.max("__start"), F.lit(1)) + 1).alias("last_run"),
        F.max_by(known, F.when(known.isNotNull(), F.col("__n"))).alias("said"),
    )
    # The whole last row, asked for here, keeps both uses of the exchange alike.
    across = Window.partitionBy("__key").orderBy("__piece")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.lag(F.lit(True)).over(across).isNotNull() & F.lag("last_ok").over(across).eqNullSafe(F.col("first_ok"))
    pieces = pieces.filter(F.col("__end").isNotNull()).withColumn("goes_on", goes_on)
    # Pieces of one run only that go on lengthen the run they take over: sums within such chains.
    chained = F.col("goes_on") & (F.col("first_run") == F.col("n"))
    pieces = pieces.withColumn("chain", F.sum(F.when(chained, 0).otherwise(1)).over(across))
    run_end = F.sum("last_run").over(Window.partitionBy("__key", "chain").orderBy("__piece"))
    pieces = pieces.withColumn("run_end", run_end)
    pieces = pieces.withColumn("__open", F.when(F.col("goes_on"), F.lag("run_end").over(across)).otherwise(F.lit(0)))
    said = F.coalesce("said", _verdict(F.col("first_ok"), F.col("__open") + F.col("first_run"), fail, recover))
    carry = pieces.withColumn("said", said).select(*group, "__open", F.last("said", ignorenulls=True).over(before).alias("__status"))

    length = F.col("__n") + F.when(F.col("__start").isNull(), F.col("__open")).otherwise(1 - F.col("__start"))
    joined = rows.join(carry, group).withColumn("run_length", length)
    verdict = _verdict(F.col("__ok"), F.col("run_length"), fail, recover)
    ordered = Window.partitionBy(*group).orderBy("__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    status = F.coalesce(F.last(verdict, ignorenulls=True).over(ordered), F.col("__status"), F.lit("unknown"))
    return joined.withColumn("status", status).select(*(F.col("__self")[c].alias(c) for c in checks.columns), "run_length", "status")


def health_timeline(checks: DataFrame, fail: int = FAILURES_UNHEALTHY, recover: int = SUCCESSES_HEALTHY) -> DataFrame:
    """Status after each check.

    ``recover`` successes in a row make a region healthy, ``fail`` failures
    unhealthy, half as many (at least one) degraded; any other check keeps the
    status reached before.
    """
    return with_state(checks, fail, recover)


def circuit_intervals(checks: DataFrame, fails: int = FAILURES_OPEN, secs: int = OPEN_SECONDS) -> DataFrame:
    """Times during which a region's circuit was open, overlapping ones merged.

    Every failure from the ``fails``-th in a row on (re)opens the circuit for
    ``secs`` seconds.
    """
    needed = with_state(checks.select("region_id", "check_id", "ts", "ok"))
    opens = needed.filter(~F.col("ok") & (F.col("run_length") >= fails))
    ends = F.col("ts") + F.make_dt_interval(secs=F.lit(secs))
    opens = opens.select("region_id", "check_id", "ts", ends.alias("until"))
    # All intervals have one length, so one overlaps an earlier one exactly when it overlaps its predecessor.
    rows = ordered_scan(opens, ["region_id"], "ts", "check_id", lag={"prev_until": "until"})
    fresh = F.when(F.col("prev_until").isNull() | (F.col("ts") > F.col("prev_until")), 1).otherwise(0)
    rows = ordered_scan(rows, ["region_id"], "ts", "check_id", running_sum={"island": fresh})
    return rows.groupBy("region_id", "island").agg(
        F.min("ts").alias("open_from"), F.max("until").alias("open_until"), F.count(F.lit(1)).alias("failures")
    ).drop("island")


def rank_regions(health: DataFrame, regions: DataFrame, strategy: str = "failover", width: str = "1 hour") -> DataFrame:
    """Rank of each usable region per time bucket.

    ``health`` has region_id, ts, check_id, status and latency_ms; ``regions``
    priority, is_primary and weight.  A region is usable unless its last status
    in the bucket is unhealthy.
    """
    order = F.struct("ts", "check_id")
    last = health.groupBy(F.window("ts", width)["start"].alias("bucket"), "region_id").agg(
        F.max_by("status", order).alias("status"), F.avg(F.when(F.col("ok"), F.col("latency_ms"))).alias("avg_latency_ms")
    )
    usable = last.filter(F.col("status") != "unhealthy").join(regions, "region_id")
    by: dict[str, list[Column]] = {
        "failover": [F.asc("priority"), F.desc("is_primary")],
        "primary_only": [F.desc("is_primary"), F.asc("priority")],
        "latency_based": [F.asc_nulls_last("avg_latency_ms")],
        "weighted": [F.desc("weight")],
    }
    # One row per region and bucket: the window is as small as the list of regions.
    w = Window.partitionBy("bucket").orderBy(*by[strategy], F.asc("region_id"))
    return usable.withColumn("rank", F.row_number().over(w))
