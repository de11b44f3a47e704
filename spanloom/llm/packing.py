"""Packing token pieces into as few fixed-size sequences as possible: bin completion on a histogram of lengths.

Only lengths matter for packing, and there are at most ``size`` of them.  The driver therefore solves the problem
for the histogram (at most ``size`` rows, whatever the corpus), as patterns with multiplicities; the tasks then look
up each piece's place from its rank among the pieces of its length.

Defined cases: a null text is empty; an empty text is one piece holding the end id; a text longer than ``size`` is cut
into pieces of ``size`` ids, the last one shorter; repeated rows, also with equal ids, are packed as rows of their own;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import logging
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .tokens import ENCODED_BYTES, Encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first
DIVES = 4  # steps of the search per length: a dive takes about one


# ---- the solver: lengths and counts in, patterns out -------------------------------------------------------------


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: total length, or pieces over a threshold that cannot meet."""
    total = -(-sum(n * c for n, c in counts.items()) // size)
    best = total
    lengths = sorted(counts)
    for k in {0, *(n for n in lengths if n <= size // 2)}:
        alone = sum(c for n, c in counts.items() if n > size - k)
        half = [(n, c) for n, c in counts.items() if size / 2 < n <= size - k]
        free = sum(c * (size - n) for n, c in half)
        small = sum(n * c for n, c in counts.items() if k <= n <= size / 2 and n)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - free) // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over whole length classes; the incumbent of the search."""
    open_: dict[int, list[list]] = {}  # room left -> [how many sequences, filling]
    rooms: list[int] = []  # the keys of open_, sorted

    def add(room: int, group: list) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(group)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, groups = size, [[left, ()]]
            else:
                room = rooms[at]
                groups = open_[room]
            times, filling = groups.pop()
            if not groups and at < len(rooms):
                del open_[room], rooms[at]
            k = min(room // length, left)
            use = min(times, left // k)
            if times > use and filling:
                add(room, [times - use, filling])
            add(room - k * length, [use, (*filling, (length, k))])
            left -= use * k
    return [(times, filling) for groups in open_.values() for times, filling in groups]


def completions(counts: dict[int, int], room: int, most: int, tries: int) -> tuple[list[Filling], bool]:
    """Undominated fillings of ``room``, least waste first, and whether these are all: at most ``most`` are found in ``tries`` steps.

    A filling is dominated if a further piece still fits, or if one of its pieces could be replaced by a longer unused
    one that fits: whatever can be packed after the dominated filling can be packed after the other.
    """
    lengths = sorted(n for n in counts if n <= room and counts[n])
    found: dict[Filling, int] = {}
    greedy: Filling | None = None
    steps, whole = 0, True

    def undominated(filling: Filling, waste: int) -> bool:
        if not waste:
            return True
        used = dict(filling)

        def least_spare(at: int) -> int:
            while at < len(lengths) and counts[lengths[at]] <= used.get(lengths[at], 0):
                at += 1
            return lengths[at] if at < len(lengths) else room + waste + 1

        return least_spare(0) > waste and all(least_spare(bisect_right(lengths, n)) > n + waste for n, _ in filling)

    def grow(below: int, left: int, filling: Filling) -> None:
        """Go on with pieces among the ``below`` shortest lengths."""
        nonlocal steps, whole, greedy
        below = min(below, bisect_right(lengths, left))
        if not below:
            if greedy is None:
                greedy = filling
            if undominated(filling, left):
                found[filling] = left
            return
        for at in range(below - 1, -1, -1):
            n = lengths[at]
            for k in range(min(counts[n], left // n), 0, -1):
                if steps >= tries or len(found) >= most:
                    whole = False
                    return
                steps += 1
                grow(at, left - k * n, (*filling, (n, k)))

    grow(len(lengths), room, ())
    return sorted(found, key=found.get) or [greedy or ()], whole


@dataclass(frozen=True)
class Packing:
    """Patterns ``(how many sequences, filling)``, how many sequences these are, a bound that none can be below, and whether
    the number is proven to be the least."""

    patterns: list[tuple[int, Filling]]
    sequences: int
    bound: int
    proven: bool


def search(counts: dict[int, int], size: int, max_nodes: int | None = None, width: int = 8, tries: int = 4000) -> Packing:
    """Bin completion: the longest piece left is completed by each undominated filling in turn.

    A filling is used as often as the counts allow, or else once, so that all packings can be reached.  A dive takes the
    first choice down to the last piece; the next dive leaves the one with the fewest later choices so far, as early as
    possible.  A branch ends once its waste leaves no room for fewer sequences than the incumbent.

    ``max_nodes``, by default ``DIVES`` for each length, which are as many dives (a step uses up about one length), ends the search
    without a proof.  ``width`` fillings found in ``tries`` steps are tried at a node; if that left any out and all branches
    are done, the search is repeated with eight times as many.  So there is a proof if the lower bound is met or if a
    repetition ends that left out nothing.
    """
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, size)
    n_best, least = sum(t for t, _ in best), lower_bound(counts, size)
    total = sum(n * c for n, c in counts.items())
    nodes = max(200, DIVES * len(counts)) if max_nodes is None else max_nodes
    done = False
    while n_best > least and nodes > 0 and not done:
        whole, number = True, 0
        # Later choices, depth, order; waste, sequences, and the way here as (way before, times, filling).
        heap: list[tuple] = [(0, 0, 0, 0, 0, None)]
        while heap and n_best > least and nodes > 0:
            later, depth, _, waste, used, way = heappop(heap)
            left = dict(counts)
            for times, filling in _patterns(way):
                _take(left, times, filling)
            while waste <= (n_best - 1) * size - total and n_best > least:
                if nodes <= 0:
                    heappush(heap, (later, depth, -1, waste, used, way))
                    break
                nodes -= 1
                if not left:
                    n_best, best = used, _patterns(way)
                    break
                # The incumbent's rule finishes this branch at once; often that is already better.
                tail = best_fit(left, size)
                if (n := used + sum(t for t, _ in tail)) < n_best:
                    n_best, best = n, _patterns(way) + tail
                longest = max(left)
                rest = {**left, longest: left[longest] - 1}
                fillings, all_ = completions(rest, size - longest, width, tries)
                whole &= all_
                choices, once = [], []
                for filling in fillings:
                    need = Counter({longest: 1})
                    for n, k in filling:
                        need[n] += k
                    pattern = tuple(sorted(need.items(), reverse=True))
                    times = min(left[n] // k for n, k in pattern)
                    lost = size - sum(n * k for n, k in pattern)
                    choices.append((times, pattern, lost))
                    if times > 1:
                        once.append((1, pattern, lost))
                for i, (times, pattern, lost) in enumerate(choices + once):
                    if i:
                        number += 1
                        heappush(heap, (later + i, depth + 1, number, waste + times * lost, used + times, (way, times, pattern)))
                times, pattern, lost = choices[0]
                _take(left, times, pattern)
                waste, used, way, depth = waste + times * lost, used + times, (way, times, pattern), depth + 1
        done = not heap and whole
        width, tries = 8 * width, 8 * tries
    return Packing(best, n_best, least, n_best <= least or done)


def _patterns(way: tuple | None) -> list[tuple[int, Filling]]:
    out = []
    while way:
        way, times, filling = way
        out.append((times, filling))
    return out[::-1]


def _take(left: dict[int, int], times: int, filling: Filling) -> None:
    for n, k in filling:
        left[n] -= times * k
        if not left[n]:
            del left[n]


def bin_completion(counts: dict[int, int], size: int, max_nodes: int | None = None, width: int = 8, tries: int = 4000) -> list[tuple[int, Filling]]:
    """Patterns ``(how many sequences, filling)`` that use every piece once, as ``search`` finds them."""
    return search(counts, size, max_nodes, width, tries).patterns


def places(patterns: list[tuple[int, Filling]]) -> dict[str, np.ndarray]:
    """Intervals of (length, rank): where a piece goes.  A pattern has at most sqrt(2 * size) lengths."""
    used: Counter[int] = Counter()
    rows, first = [], 0
    for times, filling in patterns:
        offset = 0
        for length, k in filling:
            rows.append((length, used[length], k, first, offset))
            used[length] += times * k
            offset += k * length
        first += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "first", "offset"), cols, strict=True))


# ---- Spark -------------------------------------------------------------------------------------------------------


def _cut(tokenizer: str, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for part in slices(batches, most=ENCODED_BYTES):
            ids, ends = encoder.encode(part.column("text"))
            ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
            ends = ends + np.arange(len(ends))
            pieces = -(-np.diff(ends) // size)
            row = np.repeat(np.arange(len(pieces)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = ends[:-1][row] + piece * size
            stop = np.minimum(first + size, ends[1:][row])
            data = memoryview(ids).cast("B")
            cuts = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
            columns = {
                "doc_id": part.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(piece * size),
                "length": pa.array(stop - first),
                "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array([bytes(c) for c in cuts], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece, written to the shared folder: ids as little-endian unsigned 32-bit binary if they are kept, and
    their crc32.

    ``part`` is the task that wrote the row; (part, length) groups are as small as a task's output.
    """
    path = scratch_path(docs.sparkSession, "pieces")
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_cut(tokenizer, size, end_id, keep_ids), PIECES + (", ids binary" if keep_ids else ""))
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd").parquet(path)
    )
    return docs.sparkSession.read.parquet(path)


def _look_up(spark: SparkSession, plan: dict[str, np.ndarray]):
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p["length"] << 40 | p["rank"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            i = rank - p["rank"][at]
            sequence, place = p["first"][at] + i // p["each"][at], p["offset"][at] + i % p["each"][at] * length
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(place)], names=[*kept, "sequence_id", "offset"])

    return run


def place_pieces(pieces: DataFrame, size: int = 2048, **limits) -> DataFrame:
    """``pieces`` without their ids, with sequence_id and offset.

    The broadcast plan has at most sqrt(2 * size) intervals for each pattern, and each step of the search uses up a
    length class or leaves less of it than a pattern needs, so it is bounded by the number of lengths.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = search(histogram, size, **limits)
    said = "proven to be the least" if found.proven else f"not proven to be the least, lower bound {found.bound}"
    logging.getLogger(__name__).log(logging.INFO if found.proven else logging.WARNING, "packed into %d sequences, %s", found.sequences, said)
    plan = places(found.patterns)
    keys = ["length", "part"]
    own = Window.partitionBy(*keys).orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (
        pieces.select("doc_id", "piece", "start", "ids_crc32", *keys)
        .withColumn("i", F.row_number().over(own))
        .join(base, keys)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("i") - 1).alias("rank"))
    )
    return ranked.mapInArrow(
        _look_up(pieces.sparkSession, plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, **limits) -> DataFrame:
    """Tokenise, cut and place all documents; one row per piece."""
    return place_pieces(token_pieces(docs, tokenizer, size, end_id, keep_ids=False), size, **limits)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, ids binary, and where each document's piece begins."""
    together = placed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return together.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id",
        F.expr("aggregate(rows, cast('' as binary), (a, r) -> concat(a, r.ids))").alias("ids"),
        F.expr("transform(rows, r -> struct(r.doc_id, r.piece, r.offset))").alias("documents"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
