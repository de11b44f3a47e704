"""Event router: one stream, several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import is_end_event, to_error_records, to_metric_points
from ..sources.feeds import with_index_month


def _replace_batch(df: DataFrame, path: str, batch_id: int, *parts: str) -> None:
    """Write one micro-batch under its id: replaying the batch overwrites the same folder."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(f"{path}/batch_id={batch_id}")


def route_batch(batch: DataFrame, batch_id: int, base: str) -> dict:
    """Errors to the error store, end events to metric points, everything to the index; returns counters."""
    batch = batch.persist()
    try:
        _replace_batch(to_error_records(batch), f"{base}/errors", batch_id)
        _replace_batch(to_metric_points(batch), f"{base}/points", batch_id)
        _replace_batch(with_index_month(batch), f"{base}/index", batch_id, "index_month")
        counts = batch.agg(
            F.count(F.lit(1)).alias("records_processed"),
            F.count_if(F.col("event_type") == "error").alias("errors_detected"),
            F.count_if(is_end_event()).alias("metrics_written"),
        )
        row = counts.first().asDict()
        spark = batch.sparkSession
        audit = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
        _replace_batch(audit, f"{base}/counters", batch_id)
        return row
    finally:
        batch.unpersist()


def start_router(events: DataFrame, base: str, checkpoint: str, on_errors: Callable[[int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start routing; ``on_errors`` is called with the error count of each batch that has any."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        counts = route_batch(batch, batch_id, base)
        if on_errors and counts["errors_detected"]:
            on_errors(counts["errors_detected"])

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def run_incremental(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived since the last run, then stop."""
    q = source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over the data available now into Parquet and read the result."""
    spark: SparkSession = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch_id={i}"))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if mode == "append" else spark.read.parquet(path)
