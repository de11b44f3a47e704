"""Event sinks used by batch and by ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keyed_records(df: DataFrame, key: str = "agent_id") -> DataFrame:
    """(key, value) rows for a keyed message sink; nulls are left out of the JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_keyed_stream(df: DataFrame, options: dict, checkpoint: str, key: str = "agent_id"):
    """Start a keyed message sink (``format`` in the options, Kafka by default)."""
    opts = {"format": "kafka", **options}
    return (
        keyed_records(df, key)
        .writeStream.format(opts.pop("format"))
        .options(**opts)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def _clustered(df: DataFrame, *parts: str) -> DataFrame:
    """Rows grouped by folder; AQE merges small folders per task and splits big ones."""
    return df.hint("rebalance", *[F.col(p) for p in parts])


def write_metric_points(points: DataFrame, path: str, mode: str = "append") -> None:
    rows = points.withColumn("date", F.to_date("ts"))
    _clustered(rows, "date", "measure_name").write.mode(mode).partitionBy("date", "measure_name").parquet(path)


def with_index_month(df: DataFrame) -> DataFrame:
    """Month of event time, the partition of the trace index."""
    return df.withColumn("index_month", F.date_format("ts", "yyyy-MM"))


def write_event_index(df: DataFrame, path: str, mode: str = "append") -> None:
    _clustered(with_index_month(df), "index_month").write.mode(mode).partitionBy("index_month").parquet(path)


def write_error_store(errors: DataFrame, path: str, mode: str = "append") -> None:
    rows = errors.withColumn("date", F.to_date("ts"))
    _clustered(rows, "date").write.mode(mode).partitionBy("date").parquet(path)
