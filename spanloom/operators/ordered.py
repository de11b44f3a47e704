"""Ordered computations that survive a hot key.

A plain window puts every row of a key on one task.  Here a key's rows are cut
into pieces (by time, or by sequence number); rows are processed per piece and
only one summary row per piece is carried across.

The input is read and shuffled once: summaries and rows are made from the same
exchange, which Spark reuses as long as both need all of its columns.  So each
row travels as one struct, and a piece's summary holds its whole last row.
Select the columns that are needed before the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    ts: str = "ts",
    tie: str = "event_id",
    row_number: str | None = None,
    lag: dict[str, str] | None = None,
    running_sum: dict[str, Column] | None = None,
    last_value: dict[str, Column] | None = None,
    piece_seconds: int = 60,
) -> DataFrame:
    """Row number, previous value, running sum and last non-null value per key.

    ``lag``, ``running_sum`` and ``last_value`` map output column -> input.  The
    last value includes the current row.  Equal to the windows ``partitionBy(keys)
    .orderBy(ts, tie)``, computed per (key, time piece) plus a carry.
    """
    lag, running_sum, last_value = lag or {}, running_sum or {}, last_value or {}
    group = ["__key", "__piece"]
    work = in_pieces(df, keys, ts, {**{f"__sum_{o}": e for o, e in running_sum.items()}, **{f"__val_{o}": e for o, e in last_value.items()}}, piece_seconds)
    of = lambda name: F.col("__row")[name]
    order = F.struct(of(ts), of(tie))

    local = Window.partitionBy(*group).orderBy(of(ts), of(tie))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The row itself, as a window's result: so Spark doesn't prune it before the exchange, and the exchanges stay alike.
    own = {"__n": F.row_number().over(local).cast("long"), "__self": F.lag("__row", 0).over(local)}
    own |= {f"__lag_{out}": F.lag(of(src)).over(local) for out, src in lag.items()}
    own |= {f"__run_{out}": F.sum(of(f"__sum_{out}")).over(upto) for out in running_sum}
    own |= {f"__last_{out}": F.last(of(f"__val_{out}"), ignorenulls=True).over(upto) for out in last_value}
    rows = work.withColumns(own)

    # The whole last row, counted on, keeps every column of the exchange in use here as well.
    facts = [F.count(F.lit(1)).alias("__c"), F.max_by("__row", order).alias("__end")]
    facts += [F.sum(of(f"__sum_{o}")).alias(f"__tot_{o}") for o in running_sum]
    facts += [F.max_by(of(f"__val_{o}"), F.when(of(f"__val_{o}").isNotNull(), order)).alias(f"__fin_{o}") for o in last_value]
    across = Window.partitionBy("__key").orderBy("__piece")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("__end").isNotNull(), F.col("__c"))
    carries = [F.coalesce(F.sum(counted).over(before), F.lit(0)).alias("__c0")]
    carries += [F.lag(F.col("__end")[src]).over(across).alias(f"__end0_{o}") for o, src in lag.items()]
    carries += [F.sum(f"__tot_{o}").over(before).alias(f"__tot0_{o}") for o in running_sum]
    carries += [F.last(f"__fin_{o}", ignorenulls=True).over(before).alias(f"__fin0_{o}") for o in last_value]
    carry = work.groupBy(*group).agg(*facts).select(*group, *carries)

    joined = rows.join(carry, group).filter("__c0 >= 0")
    outs: list[Column] = []
    if row_number:
        outs.append((F.col("__n") + F.col("__c0")).alias(row_number))
    for o in lag:
        outs.append(F.when(F.col("__n") == 1, F.col(f"__end0_{o}")).otherwise(F.col(f"__lag_{o}")).alias(o))
    for o in running_sum:
        outs.append((F.col(f"__run_{o}") + F.coalesce(F.col(f"__tot0_{o}"), F.lit(0))).alias(o))
    for o in last_value:
        outs.append(F.coalesce(F.col(f"__last_{o}"), F.col(f"__fin0_{o}")).alias(o))
    return joined.select(*(F.col("__self")[c].alias(c) for c in df.columns), *outs)


def in_pieces(df: DataFrame, keys: list[str], ts: str, more: dict[str, Column], piece_seconds: int) -> DataFrame:
    """__row (all columns of ``df`` and ``more``), __key, __piece; shuffled by key and piece."""
    # Rows without a time come first, in a piece of their own.
    piece = F.coalesce(F.floor(F.unix_seconds(ts) / piece_seconds), F.lit(-(1 << 62)))
    row = F.struct(*df.columns, *(e.alias(o) for o, e in more.items()))
    work = df.select(F.struct(*keys).alias("__key"), piece.alias("__piece"), row.alias("__row"))
    return work.repartition("__key", "__piece")


def blocked_frame(
    df: DataFrame,
    keys: list[str],
    seq: str,
    lookback: int,
    make: Callable[[Window], dict[str, Column]],
    block: int = 100_000,
) -> DataFrame:
    """Bounded-frame window functions over a dense sequence number.

    A block of ``block`` rows also receives the ``lookback`` rows before it, so
    every frame is complete; those context rows are dropped afterwards.
    """
    assert 0 < lookback < block
    at = F.col(seq) - 1
    own = F.floor(at / block)
    tail = F.pmod(at, F.lit(block)) >= block - lookback
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumn("__own", own).withColumn("__block", F.explode(homes))
    w = Window.partitionBy(*keys, "__block").orderBy(seq)
    rows = rows.withColumns(make(w))
    return rows.filter("__own = __block").drop("__own", "__block")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key; Spark limits each key on the map side before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one page of the ordered rows, one row with total and total_pages)."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    totals = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / size).cast("long").alias("total_pages")
    )
    return rows, totals


def page_after(df: DataFrame, ts: str, key: str, last: tuple | None, size: int = 20) -> DataFrame:
    """Keyset page, newest first: cheap at any depth because the position is a filter."""
    if last is not None:
        at, ident = F.lit(str(last[0])).cast("timestamp"), F.lit(last[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) > ident)))
    return df.orderBy(F.desc(ts), key).limit(size)


def share_of_total(df: DataFrame, value: str, out: str = "percentage") -> DataFrame:
    """Percentage of the overall sum; the total is a scalar subquery, not a one-task window."""
    total = df.agg(F.sum(F.col(value).cast("double"))).scalar()
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value).cast("double") * 100, total), F.lit(0.0)))


def latest_per(df: DataFrame, key: str, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return top_per(df, [key], [F.desc(ts), F.asc(tie)], n)


def latest_quota(df: DataFrame, agents: list[str], limit: int, ts: str = "ts", tie: str = "event_id", max_agents: int | None = None) -> DataFrame:
    """The agents share ``limit``; each gets an equal whole number of newest rows.  More than ``max_agents`` are an error."""
    chosen = sorted(set(agents))
    if max_agents is not None and len(chosen) > max_agents:
        raise ValueError(f"{len(chosen)} agents, at most {max_agents}")
    return latest_per(df.filter(F.col("agent_id").isin(chosen)), "agent_id", limit // max(len(chosen), 1), ts, tie)


def for_agents(df: DataFrame, agents: list[str]) -> DataFrame:
    return df.filter(F.col("agent_id").isin(list(agents)))


def distinct_values(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Sorted distinct non-null values of a low-cardinality column per key."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias(out))
