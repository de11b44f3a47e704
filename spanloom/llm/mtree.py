"""Exact top-k by inner product: M-trees searched best first.

Components are integers, floor(scale * x).  Inner products become distances by one more coordinate: with m the largest
squared norm of all vectors, x' = (x, sqrt(m - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + m - 2 q.x, so the nearest
vectors are those of the highest products.

The tree's upper level is a bounded list of routing vectors; every vector goes to its nearest one.  The vectors of a routing
vector are split by hash into shards of bounded size (equal vectors too), and each shard is a tree of pages: a node keeps its
routing vector, its covering radius and the distance to its parent's routing vector; leaf entries keep theirs.  A search
takes nodes by their bound, and by the triangle inequality skips those, and those entries, that the stored distances already
rule out; a block of queries goes through a page at once.  Each query first searches the shard of its nearest routing
vector; its k-th score there bounds the rest.  The shards' roots lie in upper pages, which decide for blocks of queries
which shards a query still has to be sent to, before any vectors are shuffled for it.  The rest is searched in cells, of a
range of blocks and a range of shards: a cell gets its queries and its trees once, and what a query finds in one tree bounds
the next.  A tree whose leaf pages the bounds would hardly spare is multiplied as a whole.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id, nor
vectors whose squares, after scaling, sum to 2^62 or more, since their scores need not fit in 64 bits; rows equal in vec_id and vector count once; a query's own vec_id is no candidate; equal scores go to the smaller vec_id; fewer
candidates than k are all returned; shorter vectors count as if they ended in zeros; an empty table gives no rows; columns
other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import stored

SHARD = 4096
LEAF = 64
FANOUT = 16
MAX_ROUTES = 256
QUERIES = 512  # per block
PAGE = 256  # shards per upper page
CELL_BYTES, CELL_SHARDS = 32 << 20, 64  # of a cell's queries as doubles, and its shards
SCAN = 512  # queries that are multiplied with a whole tree at once
SPARED = 0.75  # of a tree's entries, so that its pages are searched one by one
NOBODY, NOTHING = np.iinfo(np.int64).max, -np.iinfo(np.int64).max  # an empty place's vec_id and score
EXACT = 2.0**53  # doubles hold smaller integers exactly; beyond it scores are computed as 64-bit integers
SINGLE = 2.0**24  # and so do floats; no sum of some of a product's terms exceeds the largest squared norm


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: 32-bit integers as bytes, norm: their squared norm; of the rows that take part."""
    x = F.col("embedding")
    if vectors.schema["embedding"].dataType != ArrayType(FloatType()):
        x = x.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.mapInArrow(_integers(scale), "vec_id long, v binary, norm long").dropDuplicates()


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            n = np.diff(lists.offsets.to_numpy())
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls are not finite either
            inside = np.arange(n.max(initial=0))[None, :] < n[:, None]
            scaled = np.zeros(inside.shape)
            scaled[inside] = np.where(np.isfinite(x), x, np.inf) * scale
            with np.errstate(over="ignore"):
                squares = np.zeros(len(n))
                for column in scaled.T:  # in order: another order rounds otherwise
                    squares += column * column
            fits = squares < float(1 << 62)
            whole = np.floor(scaled[fits]).astype("<i4")
            at = np.concatenate([[0], np.cumsum(4 * n[fits])]).astype(np.int32)
            v = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(at), pa.py_buffer(whole[inside[fits]])])
            norm = (whole.astype(np.int64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(fits)), v, pa.array(norm, pa.int64())], names=["vec_id", "v", "norm"])

    return run


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim``; doubles hold the products of such integers exactly up to 2^53."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    x = np.frombuffer(packed.buffers()[2] or b"", "<i4")[at[0] : at[-1]]
    out = np.zeros((len(packed), dim))
    out[np.arange(dim)[None, :] < np.diff(at)[:, None]] = x
    return out


def _kind(largest: float) -> type:
    """The smallest kind of numbers that holds all products exactly, or as good as doubles do."""
    return np.float32 if largest < SINGLE else np.float64


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64)


def _products(q: np.ndarray, x: np.ndarray, largest: float, room: np.ndarray | None = None) -> np.ndarray:
    return np.matmul(q, x.T, out=room) if largest < EXACT else q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The best ``k`` that each query has found, best first; places that nobody takes hold NOBODY."""

    def __init__(self, own: np.ndarray, k: int, least: np.ndarray):
        self.own, self.least = own, np.where(np.isfinite(least), least, -np.inf)
        self.score, self.ids = np.full((len(own), k), NOTHING), np.full((len(own), k), NOBODY)

    def take(self, rows: np.ndarray, value: np.ndarray, who: np.ndarray) -> None:
        """Offers ``who`` with the products ``value`` to the queries ``rows``."""
        value, new = value.astype(np.int64), who != self.own[rows]
        while new.any():
            rows, value, who = rows[new], value[new], who[new]
            last = self.score[rows, -1]
            new = (value > last) | ((value == last) & (who < self.ids[rows, -1]))
            rows, value, who = rows[new], value[new], who[new]
            # Of very many a part comes first, which rules out most of the others.
            many = len(rows) > 32 * (1 + np.count_nonzero(np.diff(rows)))
            first = np.arange(len(rows)) % 16 == 0 if many else np.ones(len(rows), bool)
            self._merge(rows[first], value[first], who[first])
            new = ~first

    def _merge(self, rows: np.ndarray, value: np.ndarray, who: np.ndarray) -> None:
        on, nth = np.unique(rows, return_inverse=True)
        k = self.score.shape[1]
        row = np.concatenate([np.repeat(np.arange(len(on)), k), nth])
        score, ids = np.concatenate([self.score[on].ravel(), value]), np.concatenate([self.ids[on].ravel(), who])
        order = np.lexsort((ids, -score, row))
        order = order[(np.searchsorted(row[order], np.arange(len(on)))[:, None] + np.arange(k)).ravel()]
        self.score[on], self.ids[on] = score[order].reshape(-1, k), ids[order].reshape(-1, k)
        full = on[self.ids[on, -1] != NOBODY]
        self.least[full] = np.maximum(self.least[full], self.score[full, -1])

    def found(self) -> pa.RecordBatch:
        taken = self.ids != NOBODY
        columns = [np.repeat(self.own, taken.sum(axis=1)), self.ids[taken], self.score[taken]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


# ---- one shard ---------------------------------------------------------------------------------------------------


class Tree:
    """Pages of an M-tree over ``x`` (rows of integers) with one more coordinate ``more``."""

    FIELDS = ("ids", "x", "more", "toward", "route", "radius", "parent", "first", "count", "leaf")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, largest: float) -> Tree:
        more = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
        distance = lambda rows, r: np.sqrt(((x[rows] - x[r]) ** 2).sum(axis=1) + (more[rows] - more[r]) ** 2)
        rng = np.random.default_rng(7)
        order: list[np.ndarray] = []
        toward: list[np.ndarray] = []
        nodes: list[list[float]] = []  # route, radius, parent distance, first, count, leaf
        placed = 0
        waiting = [(0, np.arange(len(ids)), 0)]  # node number, rows, routing row
        own = distance(np.arange(len(ids)), 0) if len(ids) else np.empty(0)
        nodes.append([0, own.max(initial=0), 0, 0, 0, 1])
        while waiting:
            node, rows, route = waiting.pop()
            if len(rows) <= LEAF:
                nodes[node][3:] = [placed, len(rows), 1]
                order.append(rows)
                toward.append(distance(rows, route))
                placed += len(rows)
                continue
            picks = rng.choice(rows, min(FANOUT, -(-len(rows) // LEAF)), replace=False)
            far = np.stack([distance(rows, p) for p in picks])
            side = far.argmin(axis=0)
            if np.bincount(side).max() == len(rows):  # equal vectors: no distance parts them
                side = np.arange(len(rows)) % len(picks)
            groups = [(p, rows[side == i], far[i][side == i]) for i, p in enumerate(picks) if (side == i).any()]
            nodes[node][3:] = [len(nodes), len(groups), 0]
            for p, members, d in groups:
                waiting.append((len(nodes), members, p))
                nodes.append([p, d.max(), distance(np.array([p]), route)[0], 0, 0, 1])
        where = np.concatenate(order)
        place = np.empty(len(ids), np.int64)
        place[where] = np.arange(len(ids))
        table = np.array(nodes, float)
        return cls(
            ids=ids[where], x=x[where], more=more[where], toward=np.concatenate(toward), route=place[table[:, 0].astype(int)], radius=table[:, 1],
            parent=table[:, 2], first=table[:, 3].astype(int), count=table[:, 4].astype(int), leaf=table[:, 5] > 0,
        )

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.FIELDS} | {"x": _narrow(self.x)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes, kind: type = np.float64) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{n: z[n] for n in cls.FIELDS} | {"x": z["x"].astype(kind)})

    def search(self, q: np.ndarray, own: int, k: int, largest: float, least: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        """((score, -vec_id) of the best k that score at least ``least``, best first; how many distances were needed)."""
        best = Best(np.array([own]), k, np.array([least]))
        needed = self.search_block(Bounds(q[None, :], largest), best, np.array([0]))
        found = best.ids[0] != NOBODY
        return [(s, -i) for s, i in zip(best.score[0][found].tolist(), best.ids[0][found].tolist(), strict=True) if s >= least], needed

    def search_block(self, bounds: Bounds, best: Best, asked: np.ndarray) -> int:
        """Searches for the queries ``asked`` and brings ``best`` up to date; returns how many distances were needed.

        Entries that score less than a query's ``least`` may be missing.  The page with the highest bound of any query comes
        first, and takes along only the queries that may find something in it.
        """
        d = bounds.distances(self.x[self.route[:1]], asked)[:, 0]
        bound = bounds.upper(d - self.radius[0], asked)
        still = bound >= bounds.floor(best, asked)
        asked, d, bound = asked[still], d[still], bound[still]
        needed, turn = len(still), 0
        if len(asked) and not self._spares(bounds, best, asked):
            self._scan(bounds, best, asked)
            return needed + len(asked) * len(self.ids)
        heap = [(-np.inf, turn, 0, asked, d, bound)]
        while heap:
            _, _, node, asked, d, bound = heapq.heappop(heap)
            still = bound >= bounds.floor(best, asked)
            asked, d = asked[still], d[still]
            if not len(asked):
                continue
            rows = np.arange(self.first[node], self.first[node] + self.count[node])
            stored = self.toward[rows] if self.leaf[node] else self.parent[rows]
            around = 0.0 if self.leaf[node] else self.radius[rows][None, :]
            floor = bounds.floor(best, asked)
            able = bounds.between(d, stored, around, asked) >= floor[:, None]
            if self.leaf[node]:
                able &= self.ids[rows][None, :] != best.own[asked, None]
            on, at = able.any(axis=1), able.any(axis=0)
            asked, rows, able, floor = asked[on], rows[at], able[np.ix_(on, at)], floor[on]
            if not len(asked):
                continue
            needed += int(able.sum())
            if not self.leaf[node]:
                near = bounds.distances(self.x[self.route[rows]], asked)
                reach = np.where(able, bounds.upper(near - self.radius[rows][None, :], asked), -np.inf)
                able &= reach >= floor[:, None]
                for j, row in enumerate(rows.tolist()):
                    for_it = np.flatnonzero(able[:, j])
                    if len(for_it):
                        turn += 1
                        heapq.heappush(heap, (-float(reach[for_it, j].max()), turn, row, asked[for_it], near[for_it, j], reach[for_it, j]))
                continue
            got = _products(bounds.q[asked], self.x[rows], bounds.largest)
            i, j = np.nonzero(got >= floor[:, None])
            best.take(asked[i], got[i, j], self.ids[rows[j]])
        return needed

    def _spares(self, bounds: Bounds, best: Best, asked: np.ndarray) -> bool:
        """Whether the leaf pages' radii leave out most entries, for a few of many queries that have a bound."""
        some = asked[:: max(1, len(asked) // 16)]
        floor = bounds.floor(best, some)
        if len(asked) < 16 or not np.isfinite(floor).all():
            return True
        leaves = np.flatnonzero(self.leaf)
        able = bounds.upper(bounds.distances(self.x[self.route[leaves]], some) - self.radius[leaves], some) >= floor[:, None]
        return (able * self.count[leaves]).sum() < (1 - SPARED) * len(some) * len(self.ids)

    def _scan(self, bounds: Bounds, best: Best, asked: np.ndarray) -> None:
        """All entries at once."""
        room = np.empty((min(SCAN, len(asked)), len(self.ids)), self.x.dtype)  # fresh memory for each part would cost as much as its products
        for part in (asked[i : i + SCAN] for i in range(0, len(asked), SCAN)):
            got = _products(bounds.q[part], self.x, bounds.largest, room[: len(part)])
            floor = bounds.floor(best, part)[:, None]
            i, j = np.divmod(np.flatnonzero(got >= (floor.astype(got.dtype) if got.dtype.kind == "f" else floor)), len(self.ids))
            best.take(part[i], got[i, j], self.ids[j])


class Bounds:
    """Distances of a block of queries, and the highest products they leave possible, with slack for rounding."""

    def __init__(self, q: np.ndarray, largest: float):
        self.q, self.largest, self.whole = q, largest, (q.astype(float) ** 2).sum(axis=1) + largest
        self.slack = 1e-7 * (self.whole + 1)
        self.inexact = self.slack / np.sqrt(self.whole + 1)

    def floor(self, best: Best, asked: np.ndarray) -> np.ndarray:
        """What products must reach at least; less for rounding."""
        return best.least[asked] - self.slack[asked]

    def distances(self, x: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Of each query to each row of ``x``."""
        return np.sqrt(np.maximum(self.whole[asked, None] - 2 * (self.q[asked] @ x.T), 0))

    def upper(self, d: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The highest product with a vector no nearer than ``d``."""
        shape = (-1,) + (1,) * (d.ndim - 1)
        return (self.whole[asked].reshape(shape) - np.maximum(d, 0) ** 2) / 2 + self.slack[asked].reshape(shape)

    def between(self, d: np.ndarray, stored: np.ndarray, around: np.ndarray | float, asked: np.ndarray) -> np.ndarray:
        """The same by the triangle inequality alone, for entries ``stored`` away from a routing vector at distance ``d``."""
        return self.upper(np.abs(d[:, None] - stored[None, :]) - around - self.inexact[asked, None], asked)


# ---- Spark -------------------------------------------------------------------------------------------------------


def _nearest(routes: np.ndarray, largest: float):
    """The number of the nearest routing vector: all squared norms are the same, so the one of the highest product."""
    full = lambda x: np.hstack([x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))[:, None]]).astype(_kind(largest))
    toward = full(routes).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = (full(_matrix(b.column("v"), routes.shape[1])) @ toward).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "v")), pa.array(near)], names=["vec_id", "v", "route"])

    return run


def _grow(dim: int, largest: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        tree = Tree.build(t.column("vec_id").to_numpy(), _matrix(t.column("v").chunk(0), dim), largest)
        root = pa.array([tree.x[tree.route[0]].astype("<i4").tobytes()])
        return pa.table({"shard": t.column("shard").slice(0, 1), "root": root, "radius": tree.radius[:1], "tree": pa.array([tree.packed()], pa.binary())})

    return run


def _upper_page(dim: int, largest: float):
    """One upper page: the roots of its shards, their distances to the page's routing vector, and its covering radius."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x = _matrix(t.column("root").chunk(0), dim)
        more = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
        toward = np.sqrt(((x - x[0]) ** 2).sum(axis=1) + (more - more[0]) ** 2)
        columns = [pa.array([t.column(c).chunk(0)], pa.list_(t.schema.field(c).type)) for c in ("shard", "root", "radius")]
        whole = pa.array([(toward + t.column("radius").to_numpy()).max()])
        return pa.table([t.column("page").slice(0, 1), *columns, pa.array([toward], pa.list_(pa.float64())), whole], names=["page", "shards", "roots", "radii", "toward", "whole"])

    return run


def _choose(dim: int, largest: float):
    """For every block of queries and upper page: (block, shard, asked) of the shards that may hold something for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = b.column("asked")[i].values
                bounds = Bounds(_matrix(block.field("v"), dim), largest)
                least = block.field("least").to_numpy(zero_copy_only=False)
                floor = np.where(np.isfinite(least), least, -np.inf) - bounds.slack
                shards, radii, toward = (b.column(c)[i].values.to_numpy() for c in ("shards", "radii", "toward"))
                x = _matrix(b.column("roots")[i].values, dim)
                everyone = np.arange(len(least))
                d = bounds.distances(x[:1], everyone)[:, 0]
                asked = everyone[bounds.upper(d - b.column("whole")[i].as_py(), everyone) >= floor]
                able = bounds.between(d[asked], toward, radii[None, :], asked) >= floor[asked, None]
                able &= block.field("home").to_numpy()[asked, None] != shards[None, :]
                near = np.flatnonzero(able.any(axis=0))
                able = able[:, near] & (bounds.upper(bounds.distances(x[near], asked) - radii[None, near], asked) >= floor[asked, None])
                near, able = near[able.any(axis=0)], able[:, able.any(axis=0)]
                if not len(near):
                    continue
                at = np.concatenate([[0], np.cumsum(able.sum(axis=0))])
                chosen = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(asked[np.nonzero(able.T)[1]], pa.int32()))
                number = np.full(len(near), b.column("block")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(shards[near]), chosen], names=["block", "shard", "asked"])

    return run


def _search(dim: int, largest: float, k: int):
    """The best of their home shard for its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tree = Tree.unpacked(b.column("tree")[i].as_py(), _kind(largest))
                asked = b.column("asked")[i].values
                best = Best(asked.field("vec_id").to_numpy(), k, np.full(len(asked), -np.inf))
                bounds = Bounds(_matrix(asked.field("v"), dim).astype(_kind(largest)), largest)
                tree.search_block(bounds, best, np.arange(len(asked)))
                yield best.found()

    return run


def _pack(dim: int):
    """Blocks as bytes, as cells get them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for i in range(b.num_rows):
                asked, out = b.column("asked")[i].values, io.BytesIO()
                least = asked.field("least").to_numpy(zero_copy_only=False)
                np.savez(out, own=asked.field("vec_id").to_numpy(), least=least, x=_narrow(_matrix(asked.field("v"), dim)))
                packed.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(packed, pa.binary())], names=["block", "data"])

    return run


def _search_cells(largest: float, k: int):
    """The best in each cell for its queries: blocks come first, then, for each shard, which queries are asked, and its tree."""

    def finished(blocks: dict[int, dict]) -> tuple[Bounds, Best, dict[int, int]]:
        at = np.cumsum([0] + [len(x["own"]) for x in blocks.values()]).tolist()
        whole = {n: np.concatenate([x[n] for x in blocks.values()]) for n in ("own", "least", "x")}
        return Bounds(whole["x"].astype(_kind(largest)), largest), Best(whole["own"], k, whole["least"]), dict(zip(blocks, at[:-1], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks, asked, ready = None, {}, [], None
        for b in batches:
            for i in range(b.num_rows):
                now, block, data = (b.column(c)[i].as_py() for c in ("cell", "block", "data"))
                if now != cell:
                    if ready:
                        yield ready[1].found()
                    cell, blocks, asked, ready = now, {}, [], None
                if data is None:
                    asked.append((block, b.column("asked")[i].values.to_numpy()))
                elif block is not None:
                    with np.load(io.BytesIO(data)) as z:
                        blocks[block] = {n: z[n] for n in z.files}
                else:
                    ready = ready or finished(blocks)
                    bounds, best, first = ready
                    Tree.unpacked(data, _kind(largest)).search_block(bounds, best, np.concatenate([first[n] + rows for n, rows in asked]))
                    asked = []
        if ready:
            yield ready[1].found()

    return run


def _blocks(queries: DataFrame, *keys: Column) -> DataFrame:
    """One row for the queries of the same keys."""
    return queries.groupBy(*keys).agg(F.collect_list(F.struct("vec_id", "v", "least", F.col("shard").alias("home"))).alias("asked"))


def chosen_shards(asked: DataFrame, trees: DataFrame, shards: int, dim: int, largest: float) -> DataFrame:
    """(block, shard, asked): which queries of each block a shard, other than their home, may still hold something for.

    Blocks meet the upper pages, of PAGE shards each, not the shards: a query goes on to a shard only if neither the page's
    radius, nor the root's stored distance, nor the root's own radius rule it out.
    """
    page = F.floor(F.col("shard") / PAGE).alias("page")
    kinds = "page long, shards array<long>, roots array<binary>, radii array<double>, toward array<double>, whole double"
    upper = stored(trees.select("shard", "root", "radius", page).groupBy("page").applyInArrow(_upper_page(dim, largest), kinds), "upper-pages")
    meets = asked.select("block", "asked", F.explode(F.expr(f"sequence(0L, {(shards - 1) // PAGE}L)")).alias("page")).join(upper, "page")
    # Few rows with much work each.
    meets = meets.repartition(4 * asked.sparkSession.sparkContext.defaultParallelism, "block", "page")
    return stored(meets.mapInArrow(_choose(dim, largest), "block long, shard long, asked array<int>"), "chosen-shards")


def _cells(chosen: DataFrame, asked: DataFrame, blocks: int, trees: DataFrame, shards: int, dim: int) -> DataFrame:
    """Rows for _search_cells, each cell in a partition of its own.

    Blocks and shards are cut into ranges; a cell is a range of either, and gets the blocks and trees that it has a chosen
    pair of.  The cores' number decides into how many ranges the shards are cut; trees are sent once for each range of blocks,
    which holds as many queries as CELL_BYTES allows.
    """
    wide = -(-blocks // max(1, -(-blocks * QUERIES * dim * 8 // CELL_BYTES)))
    across = -(-blocks // wide)
    cores = chosen.sparkSession.sparkContext.defaultParallelism
    tall = max(1, min(CELL_SHARDS, shards * across // (8 * cores)))
    down = -(-shards // tall)
    cell = F.floor(F.col("block") / wide) * down + F.floor(F.col("shard") / tall)
    pairs = chosen.withColumn("cell", cell.cast("int"))
    nothing = {"shard": F.lit(-1).cast("long"), "block": F.lit(None).cast("long"), "asked": F.lit(None).cast("array<int>"), "data": F.lit(None).cast("binary")}
    rows = lambda df, *own: df.select("cell", *(F.col(c) if c in own else e.alias(c) for c, e in nothing.items()))
    packed = asked.select("block", "asked").mapInArrow(_pack(dim), "block long, data binary")
    sent = rows(pairs.select("cell", "block").distinct().join(packed, "block"), "block", "data")
    grown = rows(pairs.select("cell", "shard").distinct().join(trees.select("shard", F.col("tree").alias("data")), "shard"), "shard", "data")
    dealt = sent.unionByName(grown).unionByName(rows(pairs, "shard", "block", "asked")).repartitionById(across * down, "cell")
    return dealt.sortWithinPartitions("cell", "shard", F.col("data").isNotNull(), "block")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other vectors for each vec_id divisible by ``every``."""
    rows = stored(integer_vectors(vectors, scale), "vectors")
    spark = rows.sparkSession
    n, largest, dim = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.octet_length("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    largest, dim = float(largest), dim // 4
    wanted = min(MAX_ROUTES, -(-n // SHARD))
    sample = rows.orderBy(F.xxhash64(F.lit("route"), "vec_id"), "vec_id").limit(wanted).select("v").distinct().collect()
    routes = _matrix(pa.array([bytes(r["v"]) for r in sample], pa.binary()), dim)

    routed = stored(rows.select("vec_id", "v").mapInArrow(_nearest(routes, largest), "vec_id long, v binary, route long"), "routed")
    # At most MAX_ROUTES rows: how many shards each routing vector has, and the number of its first.
    sizes = routed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("long").alias("parts")).orderBy("route").collect()
    ends = np.cumsum([r["parts"] for r in sizes]).tolist()
    parts, base = [1] * wanted, [0] * wanted
    for r, end in zip(sizes, ends, strict=True):
        parts[r["route"]], base[r["route"]] = r["parts"], end - r["parts"]
    shard = F.lit(base)[F.col("route")] + F.pmod(F.xxhash64(F.lit("shard"), "vec_id", "v"), F.lit(parts)[F.col("route")])
    sharded = routed.select("vec_id", "v", shard.alias("shard"))
    trees = stored(sharded.groupBy("shard").applyInArrow(_grow(dim, largest), "shard long, root binary, radius double, tree binary"), "trees")

    queries = stored(sharded.filter(F.col("vec_id") % every == 0), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    found = "query_id long, vec_id long, score long"
    at_home = _blocks(queries.withColumn("least", F.lit(None).cast("double")), F.col("shard"))
    first = stored(at_home.join(trees.select("shard", "tree"), "shard").mapInArrow(_search(dim, largest, k), found), "home-results")

    # The k-th score at home; a query that found fewer has no bound.
    bound = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
    block = F.pmod(F.xxhash64(F.lit("query"), "vec_id", "v"), F.lit(blocks)).alias("block")
    asked = stored(_blocks(queries.join(bound, "vec_id", "left"), block), "blocks")
    chosen = chosen_shards(asked, trees, ends[-1], dim, largest)
    rest = _cells(chosen, asked, blocks, trees, ends[-1], dim).mapInArrow(_search_cells(largest, k), found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
