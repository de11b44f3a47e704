"""Shared steps: tables in the shared folder, and joins with a side of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..session import scratch_path

BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(kind: DataType, c: Column) -> Column:
    """About the size of a value in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + _bytes(kind.elementType, e)), F.lit(0)) + 24
    if isinstance(kind, StructType):
        return sum((_bytes(f.dataType, c[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(8)


def join_sized(large: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored ``side``: broadcast if its rows were measured to be small together, else by a shuffle that AQE can
    split."""
    size, rows = side.agg(F.sum(sum((_bytes(f.dataType, F.col(f.name)) for f in side.schema.fields), F.lit(16))), F.count(F.lit(1))).first()
    return large.join(F.broadcast(side) if (size or 0) <= BROADCAST_BYTES and rows <= BROADCAST_ROWS else side, on, how)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))
