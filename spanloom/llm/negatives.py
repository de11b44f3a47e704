"""Hard negatives by a vertical scan (BOND): vectors are stored by dimension, and read in the order that suits each anchor.

Components are integers, floor(scale * x); the score of two rows is their inner product.

1. The rows are dealt by hash into shards of bounded size.  A shard holds one array per dimension, its rows in the order
   of their labels, and the least and largest component of each dimension among the rows of each label.
2. Anchors go in blocks to the shards.  For an anchor the dimensions are read in descending order of its components' size.
   What was read gives every row a partial score; the least and largest contribution of the dimensions still to come, from
   the shard's minima and maxima, give it a lower and an upper bound.  Rows whose bounds meet none of the anchor's windows,
   and rows under the k-th lower bound of those surely in a window, leave the bitmap, until what is left is scored exactly.
3. The positives of an anchor are its k best rows of the same label: one open window.  Each positive opens a window for
   negatives, from 30 to 90 per cent of its score, among the rows of other labels.
4. The first shards, the square root of their number, are scanned first; the k-th score found there raises the lower
   edges of the windows for all others.  So the candidates of an anchor grow with the root of the number of shards.

The set of anchors is a fixed share of the rows, and every one asks all rows, so the work of an exact scan grows with
their product; the bounds spare part of each row, not the row.

Defined cases: rows with a null vec_id or label, a null vector, or null or non-finite components take no part, nor do vectors
whose squares, after scaling, sum to 2^62 or more, since their scores need not fit in 64 bits; rows equal in vec_id, label
and integer vector count once; a vec_id with several different rows is an anchor once for each of them, and none of its
own rows is its positive or negative; equal scores go to the smaller vec_id; windows of negative positives are empty;
shorter vectors count as if they ended in zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

SHARD_CELLS = 1 << 20  # components in a shard
BLOCK_CELLS = 1 << 16  # components of the anchors in a block
STEP = 8  # dimensions read between two looks at the bounds
EXACT = 2.0**53  # doubles hold smaller integers exactly; beyond it 64-bit integers are summed
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
ANSWER = "a long, low long, high long, vec_id long, score long"


def labelled_vectors(vectors: DataFrame, scale: int = 256, noisy_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v: array<long> of the rows that take part; every ``noisy_every``-th has the next label."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    rows = rows.filter(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    size = F.aggregate(x, F.lit(0.0), lambda a, e: a + (e * scale) * (e * scale))
    rows = rows.filter(size < float(1 << 62))
    label = F.when(F.col("vec_id") % noisy_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform(x, lambda e: F.floor(e * scale)).alias("v")).dropDuplicates()


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Integer rows padded with zeros to ``dim``."""
    at = lists.offsets.to_numpy()
    n = np.diff(at)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(lists)), n), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


# ---- one shard ---------------------------------------------------------------------------------------------------


class Shard:
    """Rows stored by dimension, ordered by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, by_dimension: np.ndarray, exact: bool):
        """``exact``: scores fit in doubles."""
        self.ids, self.labels = ids, labels
        self.columns = by_dimension.astype(np.float64 if exact else np.int64)
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        runs = self.starts[:-1]
        self.least = np.minimum.reduceat(self.columns, runs, axis=1).astype(float)
        self.most = np.maximum.reduceat(self.columns, runs, axis=1).astype(float)
        self.read = self.whole = 0  # components read, and those of all candidates

    def _ranges(self, label: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which runs of labels are candidates, and the bitmap of their rows."""
        runs = (self.labels[self.starts[:-1]] == label) == same
        return runs, np.repeat(runs, np.diff(self.starts))

    def scan(self, own: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int, same: bool) -> list[tuple[int, int, int, int]]:
        """(low, high, vec_id, score): for each window the first ``k`` rows with low <= score <= high."""
        runs, bitmap = self._ranges(label, same)
        bitmap = bitmap & (self.ids != own)
        alive = np.flatnonzero(bitmap)
        if not len(alive) or not windows:
            return []
        order = np.argsort(-np.abs(q), kind="stable")
        small, large = q * self.least[:, runs].min(axis=1), q * self.most[:, runs].max(axis=1)
        rest = lambda c: np.append(np.cumsum(c[order][::-1])[::-1], 0.0)
        still_least, still_most = rest(np.minimum(small, large)), rest(np.maximum(small, large))
        slack = 1e-9 * float(np.abs(still_least).max() + np.abs(still_most).max() + 1)
        q = q.astype(self.columns.dtype)
        lows, highs = min(w[0] for w in windows), max(w[1] for w in windows)
        partial = np.zeros(len(alive), self.columns.dtype)
        self.whole += len(alive) * len(order)
        for at in range(0, len(order), STEP):
            used = order[at : at + STEP]
            rows = self.columns[used] if len(alive) == len(self.ids) else self.columns[used[:, None], alive]
            partial = partial + q[used] @ rows
            self.read += len(alive) * len(used)
            down, up = still_least[min(at + STEP, len(order))] - slack, still_most[min(at + STEP, len(order))] + slack
            kept = (partial >= lows - up) & (partial <= highs - down)
            if len(used) + at < len(order):
                kept &= self._within(partial, down, up, windows, k)
            if not kept.all():
                alive, partial = alive[kept], partial[kept]
                if not len(alive):
                    return []
        score, ids = partial.astype(np.int64), self.ids[alive]
        found = []
        for low, high in windows:
            inside = np.flatnonzero((score >= low) & (score <= high))
            if len(inside) > k:
                edge = np.partition(score[inside], len(inside) - k)[len(inside) - k]
                inside = inside[score[inside] >= edge]
            best = inside[np.lexsort((ids[inside], -score[inside]))][:k]
            found += [(low, high, i, s) for i, s in zip(ids[best].tolist(), score[best].tolist(), strict=True)]
        return found

    @staticmethod
    def _within(partial: np.ndarray, down: float, up: float, windows: list[tuple[int, int]], k: int) -> np.ndarray:
        """Rows that may still be among the first ``k`` of a window."""
        kept = np.zeros(len(partial), bool)
        for low, high in windows:
            meets = (partial >= low - up) & (partial <= high - down)
            sure = meets & (partial >= low - down) & (partial <= high - up)
            if np.count_nonzero(sure) >= k:
                lower = partial[sure]
                meets &= partial >= np.partition(lower, len(lower) - k)[len(lower) - k] - (up - down)
            kept |= meets
        return kept


# ---- Spark -------------------------------------------------------------------------------------------------------


def _store_shard(dim: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        x = _matrix(t.column("v").combine_chunks(), dim)
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(x).max(initial=0) <= np.iinfo(k).max)
        column = lambda a, k: pa.array([np.ascontiguousarray(a, k).tobytes()], pa.binary())
        ids, labels = (t.column(c).to_numpy() for c in ("vec_id", "label"))
        return pa.table(
            {"shard": t.column("shard").slice(0, 1), "ids": column(ids, "<i8"), "labels": column(labels, "<i8"), "kind": [kind], "columns": column(x.T, kind)}
        )

    return run


def _scan(dim: int, exact: bool, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for b in batches:
            for i in range(b.num_rows):
                number = b.column("shard")[i].as_py()
                if number != last:
                    ids, labels = (np.frombuffer(b.column(c)[i].as_buffer(), "<i8") for c in ("ids", "labels"))
                    stored_as = np.frombuffer(b.column("columns")[i].as_buffer(), b.column("kind")[i].as_py())
                    shard, last = Shard(ids, labels, stored_as.reshape(dim, -1), exact), number
                asked = b.column("asked")[i].values
                q = _matrix(asked.field("v"), dim)
                own, labels = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                found: list[tuple] = []
                for j, (a, windows) in enumerate(zip(asked.field("a").to_pylist(), asked.field("windows").to_pylist(), strict=True)):
                    pairs = [(w["low"], w["high"]) for w in windows]
                    found += [(a, *f) for f in shard.scan(own[j], labels[j], q[j], pairs, k, same)]
                if found:
                    names = [c.split()[0] for c in ANSWER.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

    return run


class Scan:
    """Shards of ``rows`` (vec_id, label, v) in the shared folder, and searches through them."""

    def __init__(self, rows: DataFrame):
        n, self.dim, largest = rows.agg(
            F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))
        ).first()
        self.dim, self.exact, self.rows = max(self.dim or 0, 1), (largest or 0) < EXACT, rows
        self.count = max(1, -(-n * self.dim // SHARD_CELLS))
        shard = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(self.count)).alias("shard")
        layout = "shard long, ids binary, labels binary, kind string, columns binary"
        self.shards = stored(rows.select("vec_id", "label", "v", shard).groupBy("shard").applyInArrow(_store_shard(self.dim), layout), "shards")

    def _through(self, asks: DataFrame, first: int, last: int, k: int, same: bool) -> DataFrame:
        """Answers to ``asks`` (a, vec_id, label, v, windows) from the shards first to last - 1."""
        blocks = max(1, -(-asks.count() * self.dim // BLOCK_CELLS))
        block = F.pmod(F.xxhash64(F.lit("ask"), "a"), F.lit(blocks))
        asked = asks.groupBy(block.alias("block")).agg(F.collect_list(F.struct("a", "vec_id", "label", "v", "windows")).alias("asked"))
        spread = asked.select("asked", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long"))).alias("shard"))
        parts = min(2 * (last - first), 20_000)
        met = self.shards.repartition(parts, "shard").join(spread.repartition(parts, "shard"), "shard")
        return met.mapInArrow(_scan(self.dim, self.exact, k, same), ANSWER)

    def best(self, asks: DataFrame, k: int, same: bool, label: str) -> DataFrame:
        """(a, low, high, vec_id, score, rank): the first ``k`` of each window."""
        some = min(self.count, max(1, round(self.count**0.5)))
        found = stored(self._through(asks, 0, some, k, same), f"{label}-first")
        if some < self.count:
            ranked = Window.partitionBy("a", "low", "high").orderBy(F.desc("score"))
            kth = found.withColumn("i", F.row_number().over(ranked)).filter(F.col("i") == k).select("a", "low", "high", F.col("score").alias("floor"))
            opened = asks.select("a", F.explode("windows").alias("w")).select("a", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
            raised = opened.join(kth, ["a", "low", "high"], "left").withColumn("floor", F.coalesce("floor", "low"))
            windows = raised.groupBy("a").agg(F.collect_set(F.struct(F.col("floor").alias("low"), "high")).alias("windows"))
            again = stored(asks.drop("windows").join(windows, "a"), f"{label}-raised")
            rest = self._through(again, some, self.count, k, same).withColumnRenamed("low", "floor")
            rest = rest.join(raised, ["a", "floor", "high"]).select("a", "low", "high", "vec_id", "score")
            found = found.union(stored(rest, f"{label}-rest"))
        order = Window.partitionBy("a", "low", "high").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, scale: int = 256, noisy_every: int = 7) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``.
    """
    rows = stored(labelled_vectors(vectors, scale, noisy_every), "labelled")
    scan = Scan(rows)
    anchors = stored(rows.filter(F.col("vec_id") % every == 0).withColumn("a", F.monotonically_increasing_id()), "anchors")
    open_ = F.array(F.struct(F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high")))
    found = scan.best(anchors.withColumn("windows", open_), positives, True, "positives")
    alike = stored(found.select("a", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # 30 p <= 100 s <= 90 p without leaving 64 bits: s from ceil(3 p / 10) to floor(9 p / 10).
    tens, ones = F.expr("positive_score div 10"), F.col("positive_score") % 10
    low, high = tens * 3 + F.ceil(ones * 3 / 10).cast("long"), tens * 9 + F.floor(ones * 9 / 10).cast("long")
    edges = alike.filter("positive_score >= 0").select("a", "positive_id", "positive_score", low.alias("low"), high.alias("high"))
    windows = edges.groupBy("a").agg(F.collect_set(F.struct("low", "high")).alias("windows"))
    hard = scan.best(stored(anchors.join(windows, "a"), "asks"), negatives, False, "negatives")
    return (
        edges.join(hard, ["a", "low", "high"])
        .join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
