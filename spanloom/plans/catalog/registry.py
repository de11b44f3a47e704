"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sample_sql import sql as with_ctes


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns in comparable form: doubles rounded, dates as text, nested values as JSON."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "decimal":
            c = F.round(c.cast("double"), 10)
        elif kind in ("double", "float"):
            c = F.round(c, 6)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("array", "map", "struct"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(ids: str, sql: str | None = None, name: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(fn):
        key = name or fn.__name__
        assert key not in ENTRIES, key
        body = None if sql is None else with_ctes(sql)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        run.__name__ = key
        ENTRIES[key] = Entry(key, tuple(ids.split()), run, body)
        return fn

    return add
