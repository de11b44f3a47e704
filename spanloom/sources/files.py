"""Readers for raw event files and their canonical form."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import total_tokens
from ..schema import EVENT, RAW_EVENT, canonical_status, canonical_type

CORRUPT = "_corrupt_record"
RAW_WITH_CORRUPT = T.StructType(RAW_EVENT.fields + [T.StructField(CORRUPT, T.StringType())])

WRAPPER = T.StructType(
    [
        T.StructField("agent_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("environment", T.StringType()),
        T.StructField("agent_type", T.StringType()),
        T.StructField("agent_version", T.StringType()),
        T.StructField("global_tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("events", T.ArrayType(RAW_EVENT)),
    ]
)


def canonical(raw: DataFrame) -> DataFrame:
    """Fold flat and nested raw shapes into the canonical columns."""
    nested = F.col("attributes")
    usage = F.coalesce(F.col("token_usage"), nested["token_usage"])
    inp = F.coalesce("input_tokens", usage["input_tokens"], usage["prompt_tokens"])
    out = F.coalesce("output_tokens", usage["output_tokens"], usage["completion_tokens"])
    total = F.coalesce("total_tokens", usage["total_tokens"])
    any_tokens = F.coalesce(inp, out, total).isNotNull()
    computed: dict[str, Column] = {
        "event_type": canonical_type(F.col("event_type")),
        "ts": F.try_to_timestamp(F.col("timestamp")),
        "ingestion_ts": F.try_to_timestamp(F.col("ingestion_timestamp")),
        "model": F.coalesce("model", nested["model"]),
        "status": canonical_status(F.coalesce("status", nested["status"])),
        "duration_ms": F.coalesce("duration_ms", nested["duration_ms"]),
        "tool_name": F.coalesce("tool_name", nested["tool_name"]),
        "error_type": F.coalesce("error_type", nested["error"]["type"]),
        "error_message": F.coalesce("error_message", nested["error"]["message"]),
        "input_tokens": inp,
        "output_tokens": out,
        "total_tokens": F.when(any_tokens, total_tokens(inp, out, total)),
    }
    return raw.select(*[computed.get(f.name, F.col(f.name)).alias(f.name) for f in EVENT.fields])


def to_event_schema(df: DataFrame) -> DataFrame:
    """Project any frame to the known event fields; unknown ones are dropped, absent ones null."""
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in EVENT.fields
        ]
    )


def to_json_rows(df: DataFrame, out: str = "value") -> DataFrame:
    """One JSON text per row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias(out))


def parse_json(texts: DataFrame, text: Column) -> DataFrame:
    """Raw event columns of JSON texts; a malformed text is kept whole in the corrupt column."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return texts.select(F.from_json(text, RAW_WITH_CORRUPT, options).alias("e")).select("e.*")


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines below ``path``, malformed lines kept in a side column."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return parse_json(lines.filter(F.length(F.trim("value")) > 0), F.col("value"))


def read_raw_events(spark: SparkSession, base: str, day: date) -> tuple[DataFrame, DataFrame]:
    """(canonical events, malformed lines) of one day under ``base/raw/events/YYYY/MM/DD``."""
    good, bad = split_bad_records(read_raw_json(spark, f"{base}/raw/events/{day:%Y/%m/%d}"))
    return canonical(good), bad


def split_bad_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, quarantined original texts)."""
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"), F.lit("ProcessingFailed").alias("result")
    )
    return good, bad


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WRAPPER).option("recursiveFileLookup", True).option("multiLine", True).json(path)


def validate_batches(batches: DataFrame, max_events: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): empty and oversized batches are rejected; no limit if None."""
    n = F.size(F.coalesce("events", F.array().cast(WRAPPER["events"].dataType)))
    reason = F.when(n == 0, "No events provided")
    if max_events is not None:
        reason = reason.when(n > max_events, F.lit(f"Too many events (max {max_events})"))
    tagged = batches.withColumn("reason", reason)
    return tagged.filter("reason IS NULL").drop("reason"), tagged.filter("reason IS NOT NULL")


def read_wrapped_batches(spark: SparkSession, path: str, max_events: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events with the wrapper's metadata filled in, rejected batches) of stored batch files.

    The limit belongs to admission; what has been stored is read whole unless ``max_events`` is given.
    """
    ok, rejected = validate_batches(read_batches(spark, path), max_events)
    rows = ok.select(
        F.struct("agent_id", "environment", "agent_type", "agent_version", "global_tags").alias("w"),
        F.explode("events").alias("e"),
    )
    raw = rows.select(
        *[
            (F.coalesce(F.col(f"e.{f.name}"), F.col(f"w.{f.name}")) if f.name in WRAPPER.names and f.name != "timestamp"
             else F.col(f"e.{f.name}")).alias(f.name)
            for f in RAW_EVENT.fields
        ]
    )
    return canonical(raw), rejected


# Microseconds survive the round trip only with an explicit format.
_JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_HOUR_PARTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}


def write_hive_events(df: DataFrame, path: str) -> None:
    """GZIP JSON partitioned by year/month/day/hour of event time.

    The rebalance hint groups rows by folder and lets AQE merge quiet hours into
    one task and split a busy hour over several, so files are neither many nor huge.
    """
    parts = {p: F.date_format("ts", f) for p, f in _HOUR_PARTS.items()}
    (
        df.withColumns(parts)
        .hint("rebalance", *[F.col(p) for p in parts])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .option("compression", "gzip")
        .option("timestampFormat", _JSON_TIME)
        .json(path)
    )


def read_hive_events(spark: SparkSession, path: str) -> DataFrame:
    """Counterpart of ``write_hive_events``; filters on the parts prune folders."""
    parts = [T.StructField(p, T.StringType()) for p in _HOUR_PARTS]
    reader = spark.read.schema(T.StructType(EVENT.fields + parts)).option("timestampFormat", _JSON_TIME)
    return reader.json(path)


def day_ready(spark: SparkSession, base: str, day: date, min_events: int = 1) -> DataFrame:
    """One row: day, events found, malformed lines, ready flag."""
    raw = read_raw_json(spark, f"{base}/raw/events/{day:%Y/%m/%d}")
    found = raw.agg(F.count_if(F.col(CORRUPT).isNull()).alias("events"), F.count(CORRUPT).alias("malformed"))
    return found.select(
        F.lit(day).alias("date"), "events", "malformed", (F.col("events") >= min_events).alias("ready")
    )
