"""Near-duplicate documents: HyperMinHash sketches, banding, estimation, then exact links on full shingle sets.

1. Every document's shingle set gives a fingerprint and a sketch.  Of n registers each keeps the least hash of its
   share of the set, as leading-zero count and mantissa bits (16 bits).  A register whose share is empty takes the least
   of its own hash over the whole set, so small sets are sketched as well as large ones.
2. Documents with one fingerprint are one class; its smallest member stands for it from here on.
3. Bands of registers are hashed.  Buckets with one class go; so do buckets that repeat another's members.
4. In each bucket classes are first compared with its most central one.  Pairs that the collision-corrected estimate leaves
   are verified on full sets, each class's closest one first, and collapse into components.
5. Only members of buckets that still hold several components go on.  A shingle that none of them shares is in no
   intersection, and near-copies differ by most of what sets each apart from its bucket's central class; with the sizes
   this rules out most pairs of the rest, and those left are estimated and verified in the same way.  So every pair of classes that share a band is connected or has been found too far apart; its components are the
   result.

The registers in a band follow from the threshold: a pair at it shares no band with a probability below 1e-8, and its estimate falls below the bound in step 4,
five and a half standard errors under the threshold, with one below 1e-7.

Defined cases: a document without words has an empty set, links with nothing and is its own component; fewer words than a
shingle are one shingle; equal texts and repeated rows are one class, so rows with one doc_id and different texts may
connect their classes by that id; a null doc_id can't name a component: it is kept as a component of its own (``keep_one``
treats both cases by row); an empty table gives no rows; columns other than doc_id and text are ignored, or returned by
``keep_one``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import join_sized, stored
from .components import components
from .tokens import slices
from .wordhash import mix, shingle_sets

REGISTERS = 256
MISSED = 1e-8  # how likely a pair at the threshold may share no band
MANTISSA = 11
_seeds = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_band_places = mix(np.arange(7, 7 + REGISTERS, dtype=np.uint64)) | np.uint64(1)


def band_rows(threshold: float) -> int:
    """The most registers in a band such that a pair at ``threshold`` surely shares one of the bands."""
    return max(r for r in range(1, REGISTERS + 1) if r == 1 or (1 - threshold**r) ** (REGISTERS // r) < MISSED)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of 5 bits of leading zeros and 11 bits of mantissa."""
    x = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (x & np.uint64(REGISTERS - 1)).astype(np.int64), mix(x))
    filled = np.zeros(REGISTERS, bool)
    filled[(x & np.uint64(REGISTERS - 1)).astype(np.int64)] = True
    empty = np.flatnonzero(~filled)
    if len(empty) and len(x):
        for lo in range(0, len(empty), 64):
            own = empty[lo : lo + 64]
            least[own] = mix(x[:, None] ^ _seeds[own]).min(axis=0)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 31)
    return (zeros.astype(np.uint16) << MANTISSA) | np.floor((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` registers."""
    bands = REGISTERS // rows
    values = registers[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return mix((values * _band_places[:rows]).sum(axis=1, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches along the last axis, without the matches that chance gives.

    Two independent registers agree in leading zeros and mantissa with a probability near 1 / (2950 * 4) for sets of one
    size, and less for others.
    """
    same = (a == b).mean(axis=-1)
    k, m = np.maximum(n_a / REGISTERS, 1), np.maximum(n_b / REGISTERS, 1)
    chance = k * m / (k + m) ** 2 / (2 * np.log(2) ** -1 * (1 << MANTISSA) / 2)
    return (same - chance) / (1 - chance)


def lowest_estimate(threshold: float) -> float:
    return threshold - 5.5 * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def fingerprint(shingles: np.ndarray) -> bytes | None:
    if not len(shingles):
        return None
    return int(shingles.sum(dtype=np.uint64)).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mix(shingles))).to_bytes(8, "little")


def _sketches(size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), size)
            regs = [sketch(s) if len(s) else np.empty(0, np.uint16) for s in sets]
            bands = np.concatenate([band_keys(r, rows) for r in regs if len(r)] or [np.empty(0, np.int64)])
            n = np.array([len(s) for s in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, REGISTERS // rows, 0))]).astype(np.int32)
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(prints, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(bands))],
                names=["doc_id", "n_shingles", "print", "registers", "bands"],
            )

    return run


def sketches(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, print (of the set), registers, bands; stored.  A set's print is its size and two 64-bit sums."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_sketches(size, band_rows(threshold / 100)), "doc_id long, n_shingles long, print binary, registers binary, bands array<long>"), "sketches")


def _estimate_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
            n, m = (b.column(c).to_numpy() for c in ("n", "m"))
            close = estimate(x, y, n, m)
            rows = pa.RecordBatch.from_arrays([b.column("rep"), b.column("pivot"), pa.array(close)], names=["rep", "pivot", "close"])
            yield rows.filter(pa.array(close >= lowest_estimate(threshold)))

    return run


def estimated(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """(rep, pivot, close) of the pairs whose estimate doesn't rule them out."""
    side = reps.select("rep", F.col("n_shingles").alias("n"), F.col("registers").alias("x"))
    other = reps.select(F.col("rep").alias("pivot"), F.col("n_shingles").alias("m"), F.col("registers").alias("y"))
    return pairs.join(side, "rep").join(other, "pivot").mapInArrow(_estimate_pairs(threshold / 100), "rep long, pivot long, close double")


def _shingles(size: int):
    """rep and shingles of the rows whose text has the wanted print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), size)
            own = pa.array([fingerprint(s) == p for s, p in zip(sets, b.column("print").to_pylist(), strict=True)], pa.bool_())
            at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            values = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(at, values)], names=["rep", "shingles"]).filter(own)

    return run


def full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, shingles) of the wanted classes, stored; equal rows of one doc_id are one set."""
    named = stored(wanted.join(reps.select("rep", "print"), "rep"), "wanted")
    texts = join_sized(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), named, ["rep"])
    return stored(texts.mapInArrow(_shingles(size), "rep long, shingles array<long>").dropDuplicates(["rep"]), "sets")


def _verify(threshold: int):
    """The pairs with 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, linked = b.column("x"), b.column("y"), []
            for i in range(b.num_rows):
                s, t = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(100 * both >= threshold * (len(s) + len(t) - both))
            yield b.select(["rep", "pivot"]).filter(pa.array(linked, pa.bool_()))

    return run


def _labelled(rows: DataFrame, node: str, parts: DataFrame, label: str) -> DataFrame:
    """``rows`` with the component of ``node``, itself if it has no edge."""
    named = parts.select(F.col("node").alias(node), F.col("root").alias("__root"))
    return rows.join(named, node, "left").withColumn(label, F.coalesce("__root", node)).drop("__root")


def connected_parts(pairs: DataFrame, sets: DataFrame, known: DataFrame | None, threshold: int) -> DataFrame:
    """(node, root), stored, of what the links among ``pairs`` connect with the ``known`` parts.

    First every class's closest pair is verified; then the pairs that still lie in two components.
    """
    x, y = sets.select("rep", F.col("shingles").alias("x")), sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("y"))
    verified = lambda p, label: stored(p.select("rep", "pivot").join(x, "rep").join(y, "pivot").mapInArrow(_verify(threshold), "rep long, pivot long"), label)

    def joined(parts: DataFrame | None, links: DataFrame, label: str) -> DataFrame:
        if parts is None:
            return stored(components(links, label), f"{label}-roots")
        if links.isEmpty():
            return parts
        return stored(components(parts.select(F.col("node").alias("rep"), F.col("root").alias("pivot")).union(links), label), f"{label}-roots")

    closest = verified(pairs.groupBy("rep").agg(F.max_by("pivot", F.struct("close", "pivot")).alias("pivot")), "closest")
    parts = joined(known, closest, "closest-parts")
    rest = _labelled(_labelled(pairs, "rep", parts, "a"), "pivot", parts, "b").filter("a <> b")
    return joined(parts, verified(rest, "links"), "parts")


def banded_members(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of the buckets with several classes, those with equal members once; (key, pivot) of each.

    The pivot is the member that meets most others in all its buckets: near the middle of a group, so most links lead to it.
    """
    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.bit_xor(F.xxhash64("rep")).alias("mixed"))
        .filter("size > 1")
        .groupBy("size", "least", "most", "mixed")
        .agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times"))
        .select("key", (F.col("size") * F.col("times")).alias("met"))
    )
    members = stored(banded.join(buckets, "key"), "buckets")
    weights = members.groupBy("rep").agg(F.sum("met").alias("weight"))
    pivots = members.select("key", "rep").join(weights, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("pivot"))
    return members.select("key", "rep"), stored(pivots, "pivots")


def _open_members(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, rep, pivot, label, main of the buckets whose members, but for the pivot, lie in several components; main is the largest."""
    rows = _labelled(members.filter("rep <> pivot"), "rep", parts, "label")
    counted = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).filter("labels > 1")
    return stored(rows.join(main.drop("labels"), "key"), "open-members")


def _unshared(items: DataFrame, group: list[str]) -> DataFrame:
    """For each rep of a group, how many ``s`` no other rep of the group holds."""
    alone = items.groupBy(*group, "s").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).filter("n = 1")
    return alone.groupBy(*group, "rep").agg(F.count(F.lit(1)).alias("alone"))


def _open_pairs(rows: DataFrame, sets: DataFrame, stars: DataFrame, star_sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs in two components of a bucket that may be linked, by their sizes and by how many shingles others share.

    A shingle that no other open class holds is in no intersection, so the ``shared`` ones bound it.  Of members near their
    bucket's pivot the differences from it (``apart`` shingles) bound it more closely: two members differ in what one of them
    has apart and the other hasn't, so by all that is apart but at most twice the ``common`` part that others have apart, too.
    Every pair holds a member outside its bucket's main component.
    """
    t = threshold
    bounds = sets.select("rep", F.size("shingles").cast("long").alias("n"))
    bounds = bounds.join(_unshared(sets.select("rep", F.explode("shingles").alias("s")), []), "rep", "left")
    bounds = bounds.withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).filter(f"100 * shared >= {t} * n").drop("alone")
    near = stars.join(rows.select("rep", "pivot").distinct(), ["rep", "pivot"]).select("rep", "pivot")
    near = near.join(star_sets.select("rep", F.col("shingles").alias("x")), "rep").join(star_sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("y")), "pivot")
    near = stored(near.select("rep", "pivot", F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("items")), "differences")
    alone = _unshared(near.select("pivot", "rep", F.explode("items").alias("s")), ["pivot"])
    apart = near.select("pivot", "rep", F.size("items").cast("long").alias("apart")).join(alone, ["pivot", "rep"], "left")
    apart = apart.withColumn("common", F.col("apart") - F.coalesce("alone", F.lit(0))).drop("alone")
    able = stored(rows.join(bounds, "rep").join(apart, ["pivot", "rep"], "left"), "able")
    a, b = able.filter("label <> main").alias("a"), able.alias("b")
    on = (
        "a.key = b.key and a.label <> b.label and (b.label = b.main or a.rep < b.rep)"
        f" and 100 * least(a.n, b.n) >= {t} * greatest(a.n, b.n)"
        f" and {100 + t} * least(a.shared, b.shared) >= {t} * (a.n + b.n)"
        f" and coalesce({100 + t} * (a.apart + b.apart - 2 * least(a.common, b.common)) <= {100 - t} * (a.n + b.n), true)"
    )
    return a.join(b, F.expr(on)).select(F.col("a.rep").alias("rep"), F.col("b.rep").alias("pivot")).distinct()


def linked_parts(docs: DataFrame, reps: DataFrame, threshold: int, size: int = 5) -> DataFrame:
    """(node, root) of the classes that links of classes sharing a band connect with others.  ``reps``: rep, n_shingles,
    print, registers, bands."""
    members, pivots = banded_members(reps)
    members = stored(members.join(pivots, "key"), "members")
    stars = stored(estimated(members.filter("rep <> pivot").select("rep", "pivot").distinct(), reps, threshold), "stars")
    wanted = stars.select("rep").union(stars.select("pivot")).distinct()
    star_sets = full_sets(docs, reps, wanted, size)
    parts = connected_parts(stars, star_sets, None, threshold)
    rows = _open_members(members, parts)
    sets = full_sets(docs, reps, rows.select("rep").distinct(), size)
    pairs = stored(estimated(_open_pairs(rows, sets, stars, star_sets, threshold), reps, threshold), "open-pairs")
    return connected_parts(pairs, sets, parts, threshold)


def near_duplicates(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of every row.

    Documents are linked if 100 * intersection >= ``threshold`` * union of their shingle sets.  class_id is the smallest
    doc_id with the same set, component_id the smallest one that links reach, kept marks that document.
    """
    rows = sketches(docs, threshold, size)
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(
        full.groupBy("n_shingles", "print").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("registers", "bands"), "doc_id").alias("s"))
        .select("n_shingles", "print", "rep", "s.registers", "s.bands"),
        "classes",
    )
    linked = linked_parts(docs, classes, threshold, size)
    named = stored(
        classes.select("n_shingles", "print", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("n_shingles", "print", "rep", F.coalesce("root", "rep").alias("root")),
        "named",
    )
    out = rows.select("doc_id", "n_shingles", "print").join(named, ["n_shingles", "print"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        root.alias("component_id"),
        F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``__rep``, a number for each pair of doc_id and text, the __rep of more than one row).

    It is the doc_id; null ids, and further texts of one id, get a number beyond 2^62 from a hash of both.
    """
    row = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__mix": F.xxhash64("text")})
    keys = stored(row.groupBy("__id", "__mix").agg(F.count(F.lit(1)).alias("__n")), "row-keys")
    first = stored(keys.filter("__id is not null").groupBy("__id").agg(F.min("__mix").alias("__first"), F.count(F.lit(1)).alias("__texts")).filter("__texts > 1").drop("__texts"), "ids")
    made_up = F.xxhash64(F.lit("row"), "__id", "__mix").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    further = join_sized(keys.filter("__id is not null"), first, ["__id"]).filter("__mix <> __first").select("__id", "__mix")
    named = stored(further.union(keys.filter("__id is null").select("__id", "__mix")).withColumn("__made", made_up), "made-up")
    # Null ids join by a flag: equality does not see them.
    on = ["__null", "__low", "__mix"]
    flagged = lambda df: df.withColumns({"__null": F.isnull("__id"), "__low": F.coalesce("__id", F.lit(0).cast("long"))}).drop("__id")
    rep = F.coalesce("__made", "__low").alias("__rep")
    tagged = join_sized(flagged(row), flagged(named), on, "left").select(*(docs[c] for c in docs.columns), rep)
    return tagged, join_sized(flagged(keys.filter("__n > 1")), flagged(named), on, "left").select(rep)


def keep_one(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: a row of its smallest doc_id.

    Each text of a doc_id counts by itself, so a text without copies stays even where another one of its id goes.  Rows
    without a doc_id come last: they stay only where nobody else holds their component.  Of rows equal in doc_id and text
    one stays, also if they have no words.
    """
    tagged, repeated = _told_apart(docs)
    found = near_duplicates(tagged.select(F.col("__rep").alias("doc_id"), "text"), threshold, size)
    gone = stored(found.filter("not kept").select(F.col("doc_id").alias("__rep")).distinct(), "gone")
    left = join_sized(tagged, gone, ["__rep"], "left_anti")
    repeated = stored(repeated, "repeated")
    once = join_sized(left, repeated, ["__rep"], "left_anti")
    one = join_sized(left, repeated, ["__rep"], "left_semi").dropDuplicates(["__rep"])
    return once.union(one).select(*docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
