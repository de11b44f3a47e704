"""Exact removal of repeated strings: a sparse suffix array over content-chosen suffixes.

Every byte covered by a ``length``-byte string that also starts earlier in the corpus goes.  Sorting the suffixes of all
positions would multiply the corpus by a hundred; only some suffixes are needed:

1. Anchors.  Of the 32-byte tokens that begin in a window of ``length`` bytes, the one with the least hash is the window's
   anchor.  Equal windows have equal anchors at equal offsets, so windows are compared through their anchors only.  The
   windows of one anchor are neighbours; together they are its stretch.  Occurrences of one stretch within a slice of input are
   reduced to the first before anything is shuffled.
2. Sampled splitters range-partition the anchors' suffixes by leading token, then by stretch and place, so that a token
   that holds a third of all rows is cut too; buckets are sorted, and neighbours compared.  Of equal stretches all but the
   first are covered.  What reaches a bucket's border is compared across the borders.
3. Tokens left with different stretches are the ends of repeats.  The suffixes that begin at each of their windows are
   sorted by multikey quicksort, eight bytes at a time, and equal neighbours compared; of equal windows all but the first
   are covered.  Before that, a token with very many different stretches is replaced by longer ones, each shared by a part
   of its windows, and step 2 is done for these parts; should one still be crowded, windows are compared by hash in an aggregation.

Equality is that of two 64-bit hashes in 1 and 2, and of the crowded windows; of all bytes otherwise.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; the order of documents is that of doc_id
(null first; rows with one doc_id and different texts by a 64-bit hash of the text); rows equal in doc_id and text are one document,
and get the same result each; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .tokens import slices
from .wordhash import BASE, TABLE, UNBASE, mix, text_bytes

SHARED_IDS = 500_000  # ids broadcast, of 30 bytes each
TOKEN = 32
PIECE = 1 << 20  # bytes handled at once
CROWDED = 1000  # different stretches of one token that are compared in one task
PARTS = 4  # of the stretches of crowded tokens
NO_ID = -(1 << 63)
COVERED, OPEN, BORDER = 0, 1, 2
ROWS = "kind byte, token long, stretch long, doc long, version long, place long"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def stretches(data: np.ndarray, ends: np.ndarray, length: int, up: np.ndarray, down: np.ndarray):
    """(text number, anchor, first window, last window, token hash, stretch hash) of all stretches in the texts of ``data``."""
    n, span = len(data), length - TOKEN + 1
    nothing = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    if n < length:
        return nothing
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:n], out=sums[1:])
    tokens = mix((sums[TOKEN:] - sums[:-TOKEN]) * down[: n - TOKEN + 1])
    # Hash above, position below: the least is the leftmost of equal hashes.
    keyed = (tokens & ~np.uint64(0xFFFFFF)) | np.arange(len(tokens), dtype=np.uint64)
    windows = n - length + 1
    grid = np.concatenate([keyed, np.full(-len(keyed) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:windows]
    inside = np.arange(windows) + length <= ends[text + 1]
    begins = np.ones(windows, bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    stops = np.ones(windows, bool)
    stops[:-1] = begins[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(begins & inside), np.flatnonzero(stops & inside)
    p = anchor[lo]
    shape = ((p - lo) * 256 + (hi - lo)).astype(np.uint64)
    whole = mix((sums[hi + length] - sums[lo]) * down[lo] + mix(shape))
    return text[lo], p - ends[text[lo]], lo - ends[text[lo]], hi - ends[text[lo]], tokens[p], whole


def _pieces(b: pa.RecordBatch, length: int):
    """(bytes, offsets, rows, position of the first byte); a long text comes in pieces that share ``length`` - 1 bytes."""
    data, ends = text_bytes(b.column("text"))
    if b.num_rows > 1 or len(data) <= 2 * PIECE:
        yield data, ends, np.arange(b.num_rows), 0
        return
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at : at + PIECE + length - 1]
        yield part, np.array([0, len(part)]), np.zeros(1, np.int64), at


def _place(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One number that sorts by position in the text: anchor, anchor - first window, windows - 1."""
    return p << 16 | (p - lo) << 8 | (hi - lo)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the row before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _not_first(token: np.ndarray, stretch: np.ndarray, doc: np.ndarray, version: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of equal stretches, rows at other places than the first); rows are sorted by all five."""
    first = _first_of(token, stretch)
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    return first, (doc != doc[leader]) | (version != version[leader]) | (place != place[leader])


def _batch(kind: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int8()), *(pa.array(c.view(np.int64)) for c in cols)], names=["kind", "token", "stretch", "doc", "version", "place"]
    )


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(BASE, 2 * PIECE + length), _powers(UNBASE, 2 * PIECE + length)
        for b in slices(batches, most=PIECE):
            docs, versions = (b.column(c).to_numpy() for c in ("doc", "version"))
            for data, ends, rows, at in _pieces(b, length):
                text, p, lo, hi, token, whole = stretches(data, ends, length, up, down)
                row = rows[text]
                place = _place(p + at, lo + at, hi + at)
                order = np.lexsort((place, versions[row], docs[row], whole, token))
                cols = token[order], whole[order], docs[row][order], versions[row][order], place[order]
                first, covered = _not_first(*cols)
                kept = first | covered
                yield _batch(np.where(covered, COVERED, OPEN)[kept], *(c[kept] for c in cols))

    return run


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, stretch, doc, version, place: covered ones, and the firsts of tokens with several stretches.

    The bucket's first and last token may go on in its neighbours; their rows are handed on as they are.
    """

    def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
        first, covered = _not_first(*cols)
        number = np.cumsum(_first_of(cols[0])) - 1
        several = (np.bincount(number, first) > 1)[number]
        kept = covered | (first & several)
        return _batch(np.where(covered, COVERED, OPEN)[kept], *(c[kept] for c in cols))

    held: list[list[np.ndarray]] = []
    border = None  # the bucket's first token
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in ("token", "stretch", "doc", "version", "place")]
        token = cols[0]
        if border is None:
            border = token[0]
        if token[0] == border:
            n = int(np.argmax(token != border)) if token[-1] != border else len(token)
            yield _batch(np.full(n, BORDER), *(c[:n] for c in cols))
            cols = [c[n:] for c in cols]
            if n == len(token):
                continue
        last = int(np.argmax(cols[0] == cols[0][-1]))
        if held and (last or held[0][0][0] != cols[0][0]):
            # A token ends within this batch, or ended with the one before.
            ends = last if last else 0
            yield settle([np.concatenate(x) for x in zip(*held, [c[:ends] for c in cols], strict=True)])
            held = []
            cols = [c[ends:] for c in cols]
        elif last:
            yield settle([c[:last] for c in cols])
            cols = [c[last:] for c in cols]
        held.append(cols)
    for cols in held:
        yield _batch(np.full(len(cols[0]), BORDER), *cols)


def equal_parts(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the classes of equal rows (key, words[0], words[1], ...), by multikey quicksort.

    Rows that tie so far form a part; every part is sorted by its next word, and only parts that still hold several rows
    go on to the word after.
    """
    part = np.unique(keys, return_inverse=True)[1]
    active = np.flatnonzero(np.bincount(part)[part] > 1)
    fresh = int(part.max(initial=-1)) + 1
    for w in range(words.shape[1]):
        if not len(active):
            break
        order = active[np.lexsort((words[active, w], part[active]))]
        new = _first_of(part[order], words[order, w])
        number = np.cumsum(new) - 1
        part[order] = fresh + number
        fresh += int(number[-1]) + 1
        active = order[np.bincount(number)[number] > 1]
    return part


def _words_at(data: np.ndarray, start: np.ndarray, width: int, size: np.ndarray | int) -> np.ndarray:
    """``size`` bytes from each start as big-endian eight-byte words, zero-padded to ``width``."""
    wide = -(-width // 8) * 8
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(wide, np.uint8)]), wide)[start].copy()
    if np.ndim(size):
        view[np.arange(wide)[None, :] >= np.asarray(size)[:, None]] = 0
    else:
        view[:, size:] = 0
    return view.view(">u8").astype(np.uint64)


def _joined(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes in a row, where each context starts)."""
    return np.frombuffer(b"".join(contexts), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1].astype(np.int64)


def _window_words(contexts: list[bytes], count: np.ndarray, length: int) -> np.ndarray:
    """The windows of all contexts in a row."""
    data, at = _joined(contexts)
    start = np.repeat(at - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
    return _words_at(data, start, length, length)


def _hash_words(words: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed.astype(np.uint64)
    for w in range(words.shape[1]):
        h = mix(h * UNBASE + words[:, w] + np.uint64(w + 1))
    return h


def _runs(doc: np.ndarray, version: np.ndarray, place: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Covered windows to (doc, version, lo, hi), neighbours joined; rows sorted by occurrence and start."""
    new = _first_of(doc, version, place)
    new[1:] |= start[1:] != start[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(start) else first
    cols = doc[first], version[first], start[first], start[last] + length
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "version", "lo", "hi"])


def _sort_windows(length: int, most: int = 4000):
    """Open stretches, sorted by token, to covered intervals; whole tokens are compared at once."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        token, doc, version, place = (rows.column(c).to_numpy() for c in ("token", "doc", "version", "place"))
        lo = ((place >> 16) & 0xFFFFFFF) - ((place >> 8) & 255)
        count = (place & 255) + 1
        words = _window_words(rows.column("context").to_pylist(), count, length)
        owner = np.repeat(np.arange(len(token)), count)
        start = np.repeat(lo - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(len(owner))
        offset = (((place >> 16) & 0xFFFFFFF)[owner] - start).astype(np.uint64)
        number = np.unique(token, return_inverse=True)[1].astype(np.uint64)
        part = equal_parts(number[owner] * np.uint64(256) + offset, words)
        # The least (doc, version, start) of each class stays.
        order = np.lexsort((start, version[owner], doc[owner], part))
        leader = order[np.flatnonzero(_first_of(part[order]))[np.cumsum(_first_of(part[order])) - 1]]
        later = (doc[owner[order]] != doc[owner[leader]]) | (version[owner[order]] != version[owner[leader]]) | (start[order] != start[leader])
        gone = order[later]
        gone = gone[np.lexsort((start[gone], place[owner[gone]], version[owner[gone]], doc[owner[gone]]))]
        return _runs(doc[owner[gone]], version[owner[gone]], place[owner[gone]], start[gone], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                held.append(b)
                n += b.num_rows
                if n < most:
                    continue
                rows = pa.Table.from_batches(held)
                token = rows.column("token").to_numpy()
                last = int(np.argmax(token == token[-1]))
                if last:
                    yield settle(rows.slice(0, last).combine_chunks())
                    held = rows.slice(last).combine_chunks().to_batches()
                    n = rows.num_rows - last
        if n:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _hash_windows(length: int):
    """Open stretches of crowded tokens to one row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                token, doc, version, place = (b.column(c).to_numpy() for c in ("token", "doc", "version", "place"))
                p = (place >> 16) & 0xFFFFFFF
                lo, count = p - ((place >> 8) & 255), (place & 255) + 1
                words = _window_words(b.column("context").to_pylist(), count, length)
                owner = np.repeat(np.arange(len(token)), count)
                start = np.repeat(lo - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(len(owner))
                h = _hash_words(words, np.zeros(len(owner)))
                cols = token[owner], p[owner] - start, h.view(np.int64), doc[owner], version[owner], place[owner], start
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["token", "offset", "window", "doc", "version", "place", "start"])

    return run


def _split_stretches(length: int):
    """Stretches of crowded tokens to parts, keyed by all bytes that the windows of a part share.

    The windows whose anchor lies at one of ``step`` neighbouring offsets have ``length`` - ``step`` + 1 bytes in common,
    so what equal windows share is a far longer token, which few other stretches have.
    """
    step = -(-(length - TOKEN + 1) // PARTS)
    core = length - step + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                token, doc, version, place = (b.column(c).to_numpy() for c in ("token", "doc", "version", "place"))
                data, base = _joined(b.column("context").to_pylist())
                raw = data.tobytes()
                p, most = (place >> 16) & 0xFFFFFFF, (place >> 8) & 255  # the first window has the largest offset
                least = most - (place & 255)
                for part in range(PARTS):
                    low, high = np.maximum(least, part * step), np.minimum(most, part * step + step - 1)
                    own = np.flatnonzero(low <= high)
                    if not len(own):
                        continue
                    # Where the part's windows, and the bytes common to all windows that a part can have, begin.
                    first = base[own] + most[own] - high[own]
                    size = high[own] - low[own] + length
                    shared = base[own] + most[own] - part * step
                    key = _hash_words(_words_at(data, shared, core, core), token[own].view(np.uint64) + np.uint64(part))
                    same = _hash_words(_words_at(data, first, length + step, size), (high[own] << 8 | low[own]).astype(np.uint64))
                    cut = [raw[x : x + n] for x, n in zip(first.tolist(), size.tolist(), strict=True)]
                    cols = key.view(np.int64), same.view(np.int64), doc[own], version[own], (place[own] >> 16 << 16) | high[own] << 8 | (high[own] - low[own])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(cut, pa.binary())], names=["token", "stretch", "doc", "version", "place", "context"])

    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 * PIECE):
            data, ends = text_bytes(b.column("text"))
            raw = data.tobytes()
            wanted = b.column("wanted")
            at, rows = wanted.offsets.to_numpy(), wanted.values
            owner = np.repeat(np.arange(b.num_rows), np.diff(at))
            token, place, crowded = (rows.field(c).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for c in ("token", "place", "crowded"))
            lo = ends[owner] + ((place >> 16) & 0xFFFFFFF) - ((place >> 8) & 255)
            hi = lo + (place & 255) + length
            doc, version = (b.column(c).to_numpy()[owner] for c in ("doc", "version"))
            cut = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            cols = [pa.array(token), pa.array(doc), pa.array(version), pa.array(place), pa.array(crowded, pa.bool_()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["token", "doc", "version", "place", "crowded", "context"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=4 * PIECE):
        data, ends = text_bytes(b.column("text"))
        raw, spans, kept = data.tobytes(), [], []
        for i, covered in enumerate(b.column("covered").to_pylist()):
            own: list[list[int]] = []
            for lo, hi in sorted((c["lo"], c["hi"]) for c in covered or ()):
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
            base, at, parts = int(ends[i]), 0, []
            for lo, hi in own:
                parts.append(raw[base + at : base + lo])
                at = hi
            parts.append(raw[base + at : int(ends[i + 1])])
            spans.append([{"start": lo, "stop": hi} for lo, hi in own])
            kept.append(b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc, version: rows that share a doc_id are told apart by their text's hash, others have version 0."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"))
    shared = stored(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", F.lit(True).alias("shared")), "shared-ids")
    if shared.count() > SHARED_IDS:  # no join of all texts: every row carries its hash
        return rows.withColumn("version", F.xxhash64("text"))
    version = F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(F.broadcast(shared), "doc", "left").select("doc_id", "text", "doc", version.alias("version"))


def _intervals(rows: DataFrame, length: int) -> DataFrame:
    place = F.col("place")
    lo = F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFFFFF)) - F.shiftright(place, 8).bitwiseAND(F.lit(255))
    return rows.select("doc", "version", lo.alias("lo"), (lo + place.bitwiseAND(F.lit(255)) + length).alias("hi"))


def covered_intervals(texts: DataFrame, length: int = 100) -> DataFrame:
    """(doc, version, lo, hi) of all stretches and windows that also start earlier; bytes, ends exclusive.

    ``texts``: rows of ``_keyed``.
    """
    if not TOKEN < length < TOKEN + 220:
        raise ValueError("length must lie between 33 and 251")
    anchors = stored(texts.select("doc", "version", "text").mapInArrow(_anchor_rows(length), ROWS), "anchors")
    key = ["token", "stretch", "doc", "version", "place"]
    compared = stored(
        anchors.filter(F.col("kind") == OPEN).select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_compare_neighbours, ROWS),
        "compared",
    )
    # Across the borders of buckets.
    border = compared.filter(F.col("kind") == BORDER).select(*key)
    at = F.struct("doc", "version", "place")
    leaders = border.groupBy("token", "stretch").agg(F.min(at).alias("leader"))
    later = border.join(leaders, ["token", "stretch"]).filter(at != F.col("leader")).select("doc", "version", "place")
    opened = leaders.select("token", "leader.doc", "leader.version", "leader.place").union(compared.filter(F.col("kind") == OPEN).select("token", "doc", "version", "place"))
    sizes = opened.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ends = stored(opened.join(sizes, "token").select("token", "doc", "version", "place", (F.col("n") > CROWDED).alias("crowded")), "open-ends")

    wanted = ends.groupBy("doc", "version").agg(F.collect_list(F.struct("token", "place", "crowded")).alias("wanted"))
    contexts = texts.select("doc", "version", "text").join(wanted, ["doc", "version"]).mapInArrow(
        _contexts(length), "token long, doc long, version long, place long, crowded boolean, context binary"
    )
    contexts = stored(contexts, "contexts")
    # Crowded tokens are replaced by longer ones, and equal parts of stretches reduced to the first again.
    kind = "token long, stretch long, doc long, version long, place long, context binary"
    parts = stored(contexts.filter("crowded").mapInArrow(_split_stretches(length), kind), "parts")
    heads = parts.groupBy("token", "stretch").agg(F.min(F.struct("doc", "version", "place", "context")).alias("leader"))
    again = parts.join(heads, ["token", "stretch"]).filter(at != F.struct("leader.doc", "leader.version", "leader.place")).select("doc", "version", "place")
    several = heads.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    longer = stored(heads.join(several, "token").select("token", "leader.*", (F.col("n") > CROWDED).alias("crowded")), "longer")

    few = contexts.filter("not crowded").union(longer.select("token", "doc", "version", "place", "crowded", "context").filter("not crowded"))
    few = few.select("token", "doc", "version", "place", "context").repartition("token").sortWithinPartitions("token")
    settled = few.mapInArrow(_sort_windows(length), "doc long, version long, lo long, hi long")

    windows = stored(longer.filter("crowded").mapInArrow(_hash_windows(length), "token long, offset long, window long, doc long, version long, place long, start long"), "windows")
    same, where = ["token", "offset", "window"], F.struct("doc", "version", "start")
    repeated = windows.groupBy(*same).agg(F.min(where).alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = windows.join(repeated, same).filter(where != F.col("leader")).select("doc", "version", "place", "start").distinct()
    run = F.col("start") - F.row_number().over(Window.partitionBy("doc", "version", "place").orderBy("start"))
    runs = (
        gone.withColumn("run", run).groupBy("doc", "version", "place", "run")
        .agg(F.min("start").alias("lo"), (F.max("start") + length).alias("hi"))
        .select("doc", "version", "lo", "hi")
    )
    whole = _intervals(anchors.filter(F.col("kind") == COVERED).select("doc", "version", "place").union(compared.filter(F.col("kind") == COVERED).select("doc", "version", "place")).union(later).union(again), length)
    return whole.union(settled).union(runs)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal), kept (the remaining bytes) of every row."""
    keyed = _keyed(docs)
    rows = covered_intervals(keyed, length)
    lists = stored(rows.groupBy("doc", "version").agg(F.collect_set(F.struct("lo", "hi")).alias("covered")), "covered")
    texts = keyed.join(lists, ["doc", "version"], "left").select("doc_id", "text", "covered")
    return texts.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
