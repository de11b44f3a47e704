"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

1. Words are counted over all texts; equal words are added up before they are shuffled.
2. Two words one edit apart have letter counts at squared distance 1 (a letter more or less) or 2 (one for another).  Words
   are dealt to blocks by length and by how many of their letters fall into each of a few groups of letters.  One edit
   moves a word to its own block, or to one that differs by one letter in one or two groups: adjacent blocks.
3. In each block a numpy product of its letter counts with those of itself and of the adjacent blocks gives all squared
   distances at once.  Pairs at distance 1 with lengths one apart, or 2 with one length, are verified letter by letter.
   Each pair meets in one block.  Blocks are cut into tiles of bounded size.
4. Every word counts its near words and takes the one of largest n as its form, if that is much more frequent; roots are
   found by pointer doubling along forms.  n grows at least fivefold along a form, so chains are short.

Defined cases: a null text has no words; a null doc_id is the empty string in the hash; a run whose only letter is deleted is
the empty word and too short to count; repeated rows count as often as they come; ties in n go to the smaller word in
code-point order; a word without near words has no form and is its own root; words of any length take part; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, join_sized, stored
from .wordhash import text_bytes

GROUPS = 5
LEFT, RIGHT = 2048, 4096  # words of a tile: their distances are 64 MB
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
PLACE = np.full(256, len(LETTERS), np.int64)  # of a code point among the letters
PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n of the runs of letters after the planned slips: one letter goes where ``every`` divides the hash."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    rows = rows.filter(F.length("run") >= least_length)  # a deletion only shortens
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(h % every == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


# ---- blocks ------------------------------------------------------------------------------------------------------


def _in_groups(word: Column) -> Column:
    """How many letters of each group a word has; the sum is its length."""
    groups = ["".join(LETTERS[g::GROUPS]) for g in range(GROUPS - 1)]
    counts = [F.length(word) - F.length(F.translate(word, g, "")) for g in groups]
    return F.array(*counts, F.length(word) - sum(counts[1:], counts[0]))


def _moves() -> list[list[int]]:
    """Changes of the group counts that lead from a word's block to the others in which it is met."""
    unit = np.eye(GROUPS, dtype=int)
    one_less = [-unit[i] for i in range(GROUPS)]
    replaced = [unit[j] - unit[i] for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return [m.tolist() for m in (*one_less, *replaced)]


def _met(words: DataFrame) -> DataFrame:
    """block, own, word, n: each word in its block (own) and in those where it is compared with their words."""
    home = words.select("word", "n", _in_groups(F.col("word")).alias("block"))
    moved = [F.zip_with("block", F.array(*map(F.lit, m)), lambda a, b: a + b) for m in _moves()]
    rows = home.select("word", "n", F.posexplode(F.array("block", *moved)).alias("move", "block"))
    return rows.filter(F.forall("block", lambda c: c >= 0)).select("block", (F.col("move") == 0).alias("own"), "word", "n")


def _tiled(met: DataFrame) -> DataFrame:
    """``met`` with tiles l and r; own words are in one tile l and every r, and again on the right in one r and every l."""
    sizes = met.groupBy("block").agg(F.count_if("own").alias("own_words"), F.count(F.lit(1)).alias("all_words")).filter("own_words > 0")
    sizes = stored(
        sizes.select("block", F.ceil(F.col("own_words") / LEFT).alias("ls"), F.ceil(F.col("all_words") / RIGHT).alias("rs")), "blocks"
    )
    rows = join_sized(met, sizes, ["block"])
    tile = F.xxhash64("word")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = rows.filter("own").select("block", F.pmod(tile, "ls").alias("l"), F.explode(every("rs")).alias("r"), "own", "word", "n")
    right = rows.select("block", F.explode(every("ls")).alias("l"), F.pmod(tile, "rs").alias("r"), F.lit(False).alias("own"), "word", "n")
    return left.union(right)


# ---- one tile ----------------------------------------------------------------------------------------------------


class Words:
    """Code points and letter counts of some words of Latin letters."""

    def __init__(self, words: pa.Array):
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        self.length = np.array([len(w) for w in words.to_pylist()], np.int64)
        self.points, self.at = points, np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(len(self.length)), self.length)
        width = len(LETTERS)
        self.counts = np.bincount(row * width + PLACE[points], minlength=len(self.length) * width).reshape(-1, width).astype(float)

    def letters(self, rows: np.ndarray, width: int, skip: int = 0) -> np.ndarray:
        """The ``width`` letters of each row from ``skip`` on."""
        return self.points[self.at[rows][:, None] + np.arange(skip, skip + width)]


def near_pairs(left: Words, right: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) one edit apart: of one length, or the right word one letter longer.  Left words have one length."""
    if not len(left.length) or not len(right.length):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = int(left.length[0])
    squared = (left.counts**2).sum(axis=1)[:, None] + (right.counts**2).sum(axis=1)[None, :] - 2 * (left.counts @ right.counts.T)
    longer = right.length == size + 1
    i, j = np.nonzero(squared == np.where(longer, 1, 2)[None, :])
    found = []
    step = max(1, (1 << 22) // size)  # letters compared at once
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        same = left.letters(a, size) == right.letters(b, size)
        ok = (size - same.sum(axis=1) == 1) & ~longer[b]
        more = np.flatnonzero(longer[b])
        if len(more):
            head = np.logical_and.accumulate(same[more], axis=1).sum(axis=1)
            shifted = left.letters(a[more], size) == right.letters(b[more], size, 1)
            tail = np.logical_and.accumulate(shifted[:, ::-1], axis=1).sum(axis=1)
            ok[more] = head + tail >= size
        found.append(lo + np.flatnonzero(ok))
    at = np.concatenate(found) if found else np.empty(0, np.int64)
    return i[at], j[at]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (block, l, r), which lie together and may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([*(b.column("block").flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS).T), *(b.column(c).to_numpy(zero_copy_only=False) for c in "lr")])
        starts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and tuple(keys[:, 0]) != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, z in zip(starts, starts[1:], strict=False):
            held.append(b.slice(a, z - a))
            if z < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every near pair."""
    for t in _groups(batches):
        own = t.column("own").to_numpy()
        left, right = t.filter(pa.array(own)), t.filter(pa.array(~own))
        i, j = near_pairs(Words(left.column("word").combine_chunks()), Words(right.column("word").combine_chunks()))
        u, v = left.take(pa.array(i)), right.take(pa.array(j))
        # Within a block a pair of equal length stands on both sides; elsewhere it is met once.
        block = lambda w: Words(w.column("word").combine_chunks()).counts
        inside = (_group_counts(block(u)) == _group_counts(block(v))).all(axis=1) if len(i) else np.empty(0, bool)
        back = pa.array(~inside)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([u.column("word").combine_chunks(), v.column("word").combine_chunks().filter(back)]),
                pa.concat_arrays([v.column("word").combine_chunks(), u.column("word").combine_chunks().filter(back)]),
                pa.concat_arrays([v.column("n").combine_chunks(), u.column("n").combine_chunks().filter(back)]),
            ],
            names=["word", "near", "near_n"],
        )


def _group_counts(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts[:, g::GROUPS].sum(axis=1) for g in range(GROUPS)], axis=1)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of ``words`` (word, n) one edit apart, in both directions."""
    keys = ["block", "l", "r"]
    tiles = _tiled(stored(_met(words), "met")).repartition(*keys).sortWithinPartitions(*keys)
    return tiles.mapInArrow(_compare, "word string, near string, near_n long")


# ---- forms and roots ---------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, following ``forms`` (word, form) to the last; they have no cycles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(join_sized(now, on, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, ratio: int = 5, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that is long and frequent enough."""
    words = stored(word_counts(docs, **counting), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, "word", "left")
    much = -F.col("best.minus_n") >= ratio * F.col("n")
    formed = stored(
        rows.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(much, F.col("best.form")).alias("form"),
            F.when(much, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(formed.filter("form is not null"))
    return join_sized(formed, last, ["word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
