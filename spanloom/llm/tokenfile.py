"""Token ids as ORC files: stripes with run-length encoded integers, row indexes and Bloom filters on document ids.

Files hold the documents in ascending doc_id order (null ids first; rows of one id by a hash of their text), one file
per range of ids.  A reader takes stripes in parallel, and a lookup by doc_id skips files, stripes and row groups by
their statistics and Bloom filters.

Defined cases: a null or empty text has the end id alone; repeated rows are written as often as they come, and a
doc_id that holds a third of the rows is spread over ranges by the text's hash; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tokens import ENCODED_BYTES, kept_encoder, slices

COLUMNS = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, written = kept_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in slices(batches, most=ENCODED_BYTES):
            ids, ends = encoder.encode(b.column("text"))
            n = len(ends) - 1
            ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype(np.int32)
            ends = ends + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(ends[:-1] + written),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "part", "before", "n_tokens", "ids"],
            )
            written += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, index_rows: int = 1000) -> None:
    """Write ``docs`` (doc_id, text) below ``path``; ``before`` counts the ids ahead of a document in its own file."""
    order = ["doc_id", "mix"]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("mix", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, end_id), COLUMNS)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents; ``start`` counts the ids of all documents before.

    Only one row per file is carried across: the sum of its ids.
    """
    rows = spark.read.orc(path)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        rows.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    )
    return rows.join(F.broadcast(files), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; the filter reaches the files' indexes."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[at[i] : at[i + 1]]) for i in range(len(lists))]
        kept = [c for c in b.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])


def with_checksum(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
