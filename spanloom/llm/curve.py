"""Packing along a space-filling curve: similar documents become neighbours in one sequence.

1. A document's words are hashed into signed buckets; their square roots, scaled to length one, are its vector.
2. A fixed random matrix projects it to a few dimensions, each cut into equal shares of a normal distribution.
3. The cell's number along the Hilbert curve is the document's key.  Spark sorts the documents by it in ranges.
4. A range is one run of ids, cut every ``size`` ids; what is left at its end is cut into powers of two, which need no
   padding.  So ranges are independent: no ids are written in between, and nothing is counted across ranges.

Defined cases: a null text is empty, and an empty text holds the end id alone; a document without words has the zero
vector, like others of its kind; repeated rows are packed as rows of their own; equal keys, also those of a third of all
rows, are told apart and spread over ranges by a hash of doc_id and text; long texts go on through as many sequences as
they need; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from .tokens import ENCODED_BYTES, Encoder, slices
from .wordhash import hash_words, text_bytes, word_bounds

BUCKETS = 256
DIMENSIONS = 7
BITS = 8  # of a key for each dimension
SEED = 31
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES_PER_RANGE = 1 << 40


# ---- documents to keys -------------------------------------------------------------------------------------------


def document_vectors(texts: pa.Array) -> np.ndarray:
    """One row of BUCKETS numbers for each text, of length one, or zero without words."""
    data, ends = text_bytes(texts)
    first, stops, at = word_bounds(data, ends)
    words = hash_words(data, first, stops)
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where(words >> np.uint64(63), 1.0, -1.0)
    sums = np.bincount(row * BUCKETS + bucket, sign, n * BUCKETS).reshape(n, BUCKETS)
    sums = np.sign(sums) * np.sqrt(np.abs(sums))
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)


def cells(vectors: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Projected and cut into 2^bits cells a dimension.  A projection of a random direction is normal with variance one;
    a logistic curve stands for its distribution."""
    matrix = np.random.default_rng(SEED).normal(size=(vectors.shape[1], dimensions))
    share = 1 / (1 + np.exp(-1.702 * (vectors @ matrix)))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_key(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers of cells along the Hilbert curve; ``cell`` has one row per point and one column per dimension.

    Going down from the highest bit, each level's sub-cube is mirrored or turned into the standard one by exchanging or
    flipping the lower bits of coordinates, and the coordinates' bits, as a Gray code, give its place on the curve.
    """
    x = cell.T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        lower = (1 << level) - 1
        for d in range(dims):
            flip = (x[d] >> level & 1).astype(bool)
            exchange = np.where(flip, 0, (x[0] ^ x[d]) & lower)
            x[0] ^= np.where(flip, lower, exchange)
            x[d] ^= exchange
    key = np.zeros(cell.shape[0], np.int64)
    before = np.zeros(cell.shape[0], np.int64)  # parity of the bits so far: the Gray code undone
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            before = before ^ (x[d] >> level & 1)
            key = key << 1 | before
    return key


def _add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=4 << 20):
        for lo in range(0, b.num_rows, 4096):  # 4096 vectors are 8 MB
            part = b.slice(lo, 4096)
            key = hilbert_key(cells(document_vectors(part.column("text"))))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text")), pa.array(key)], names=["doc_id", "text", "key"])


def along_the_curve(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, mix: sorted by key within ranges of keys; mix parts equal keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.mapInArrow(_add_key, "doc_id long, text string, key long").withColumn("mix", F.xxhash64("doc_id", "text"))
    return keyed.repartitionByRange("key", "mix").sortWithinPartitions("key", "mix")


# ---- a range of documents to pieces ------------------------------------------------------------------------------


def tail_cuts(left: int) -> list[int]:
    """Ends of the sequences that hold the last ``left`` ids: powers of two, the largest first."""
    ends, at = [], 0
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class _Range:
    """Cuts one run of ids.  The ids of the sequence that is not full yet are held back: at most ``size`` of them."""

    def __init__(self, size: int, number: int):
        self.size, self.sequence = size, number * SEQUENCES_PER_RANGE
        self.waiting: list[tuple] = []  # doc_id, place in its document, ids, tokens of its document
        self.held = 0

    def _cut(self, ends: list[int]) -> list[tuple]:
        """Rows of the held ids, in sequences that end at ``ends``."""
        rows, at, begun = [], 0, 0
        bounds = iter(ends)
        end = next(bounds)
        for doc_id, place, ids, total in self.waiting:
            done = 0
            while done < len(ids):
                if at == end:
                    begun, end = end, next(bounds)
                    self.sequence += 1
                take = min(len(ids) - done, end - at)
                crc = zlib.crc32(memoryview(ids[done : done + take]).cast("B"))
                rows.append((doc_id, place + done, take, crc, total, self.sequence, at - begun))
                done, at = done + take, at + take
        self.sequence += 1
        self.waiting, self.held = [], 0
        return rows

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """Rows of the sequences that ``ids`` fill up."""
        rows, done, total = [], 0, len(ids)
        while done < total:
            take = min(total - done, self.size - self.held)
            self.waiting.append((doc_id, done, ids[done : done + take], total))
            self.held, done = self.held + take, done + take
            if self.held == self.size:
                rows += self._cut([self.size])
        return rows

    def rest(self) -> list[tuple]:
        return self._cut(tail_cuts(self.held)) if self.held else []


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _pack(tokenizer: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, run_of_ids = Encoder(tokenizer), _Range(size, TaskContext.get().partitionId())
        for b in slices(batches, most=ENCODED_BYTES):
            ids, ends = encoder.encode(b.column("text"))
            ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
            ends = (ends + np.arange(len(ends))).tolist()
            rows: list[tuple] = []
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                rows += run_of_ids.add(doc_id, ids[ends[i] : ends[i + 1]])
            if rows:
                yield _rows(rows)
        rows = run_of_ids.rest()
        if rows:
            yield _rows(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document: its place in the document and in a sequence of at most ``size`` ids."""
    if size & (size - 1):
        raise ValueError("size is a power of two")
    return along_the_curve(docs).select("doc_id", "text").mapInArrow(_pack(tokenizer, size, end_id), COLUMNS)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
