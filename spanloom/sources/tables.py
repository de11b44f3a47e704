"""Dimension and rollup tables: catalog, Parquet or JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.times import as_ts, ttl_epoch


def read_table(spark: SparkSession, source) -> DataFrame:
    """A catalog table name, a Parquet path (contains ``/``) or a dict of JDBC options."""
    if isinstance(source, dict):
        return spark.read.format("jdbc").options(**source).load()
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def read_query(spark: SparkSession, source: dict, sql: str) -> DataFrame:
    """Run ``sql`` in the database and read its result only."""
    return spark.read.format("jdbc").options(**{**source, "query": sql}).load()


def write_mart(df: DataFrame, path: str, partition: str = "date", values: list | None = None) -> None:
    """Replace partitions; a rerun does not double rows.

    With ``values`` exactly these partitions are replaced, also by nothing: a correcting rerun that finds no rows leaves
    none behind.  Without them the partitions present in ``df`` are.
    """
    if values is not None:
        kind = df.schema[partition].dataType
        for v in values:
            own = df.filter(F.col(partition) == F.lit(v).cast(kind)).drop(partition)
            own.write.mode("overwrite").parquet(f"{path}/{partition}={v}")
        return
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_jdbc(df: DataFrame, options: dict, table: str, mode: str = "append") -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).mode(mode).save()


def write_staging(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def counted(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """Attach counters that fill in during the write, instead of extra count() jobs."""
    seen = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows"), *[e.alias(k) for k, e in metrics.items()]]
    return df.observe(seen, *exprs), seen


def write_observed(df: DataFrame, path: str, name: str, partition: str = "date", value=None) -> Observation:
    """Write one partition, or those present, counting the rows on the way."""
    out, seen = counted(df, name)
    if value is None:
        write_mart(out, path, partition)
    else:
        out.drop(partition).write.mode("overwrite").parquet(f"{path}/{partition}={value}")
    return seen


def ingest_counters(events: DataFrame) -> tuple[DataFrame, Observation]:
    """Accepted / failed / error counters of an ingest write."""
    usable = F.col("event_type").isNotNull() & F.col("ts").isNotNull()
    return counted(
        events,
        "ingest",
        accepted=F.count_if(usable),
        failed=F.count_if(~usable),
        errors=F.count_if(F.coalesce(F.col("event_type") == "error", F.lit(False))),
    )


def audit_row(spark: SparkSession, operation: str, stats: dict, asof, ttl_days: int = 90) -> DataFrame:
    """One audit record made of observed statistics."""
    at = as_ts(asof)
    cells = [x for k, v in sorted(stats.items()) for x in (F.lit(k), F.lit(v).cast("double"))]
    stats_map = F.create_map(*cells) if cells else F.create_map().cast("map<string,double>")
    return spark.range(1).select(
        F.concat(F.lit(f"{operation}-"), F.date_format(at, "yyyyMMddHHmmss")).alias("audit_id"),
        at.alias("timestamp"),
        F.lit(operation).alias("operation"),
        stats_map.alias("stats"),
        ttl_epoch(at, ttl_days).alias("ttl"),
    )


def register_table(spark: SparkSession, name: str, path: str, merge_schema: bool = True) -> DataFrame:
    """Catalog entry over existing Parquet files, with compatible schemas merged."""
    schema = spark.read.option("mergeSchema", merge_schema).parquet(path).schema
    spark.catalog.createTable(name, path=path, source="parquet", schema=schema)
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def compact(spark: SparkSession, src: str, dst: str, sort: list[str], target_mb: int = 128) -> None:
    """Rewrite small files of ``src`` as sorted Parquet files of about ``target_mb``.

    The rebalance hint lets AQE size the output partitions from real shuffle
    statistics, splitting big ones and merging small ones.
    """
    # A session of its own: the target size must not reach jobs that run meanwhile.
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{target_mb}m")
    own.read.parquet(src).hint("rebalance").sortWithinPartitions(*sort).write.mode("overwrite").parquet(dst)
