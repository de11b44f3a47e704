"""Spelling variants against a plain search through all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import spelling
from spanloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(docs, every=199):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(docs, every=199):
    n = brute_counts(docs, every)
    near = {w: [] for w in n}
    for w in n:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))}
        near[w] = cut
    by_hole = {}
    for w, holes in near.items():
        for hole in holes | {w}:
            by_hole.setdefault(hole, []).append(w)
    near = {w: set() for w in n}
    for own in by_hole.values():
        for a in own:
            near[a] |= {b for b in own if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        last = w
        while form[last] is not None:
            last = form[last]
        out.append((w, form[w], last, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made_up(words=120, seed=3):
    """Words and their misspellings, in chains of falling frequency, with copies and accents."""
    rng = random.Random(seed)
    letters = "abcdeéÉßÿ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(words)]
    said = []
    for w in base:
        times = rng.choice([5, 30, 200])
        said += [w] * times
        while times >= 25 and rng.random() < 0.8:
            times //= rng.choice([5, 6])
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            said += [w] * times
    rng.shuffle(said)
    docs = [(i, " ".join(said[lo : lo + 50]) + rng.choice(["!", " 12", "\n"])) for i, lo in enumerate(range(0, len(said), 50))]
    long = "abc" * 400
    docs += [(5000, "HoTHot. " * 900), (None, "hothat hothat, hothat-hothat hothat " * 2), (5001, None), (5002, ""), (5003, f"{long} {long}x {long} " * 5)]
    return docs + docs[:3]


@pytest.mark.parametrize("tile", [(2048, 4096), (3, 5)])
def test_variants_equal_a_plain_search(frame, monkeypatch, tile):
    monkeypatch.setattr(spelling, "LEFT", tile[0])
    monkeypatch.setattr(spelling, "RIGHT", tile[1])
    docs = made_up(120 if tile[0] > 100 else 50)
    df = frame(docs, word=F.lit("x"), n=F.lit(1), block=F.lit(2))
    got = sorted(map(tuple, spelling.variants(df, every=7).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = brute(docs, 7)
    assert got == want
    assert sum(r[1] is not None for r in want) > 5 and any(r[2] != (r[1] or r[0]) for r in want)


def test_pairs_within_one_hot_block():
    """Many words that are anagrams or one letter apart, all of one length."""
    rng = random.Random(2)
    words = sorted({"".join(rng.sample("abcdef", 6)) for _ in range(300)} | {"".join(rng.choice("abc") for _ in range(6)) for _ in range(200)})
    longer = sorted({w[:3] + rng.choice("abcd") + w[3:] for w in words})
    left, right = spelling.Words(pa.array(words)), spelling.Words(pa.array(words + longer))
    i, j = spelling.near_pairs(left, right)
    want = {(a, b) for a, u in enumerate(words) for b, v in enumerate(words + longer) if one_edit(u, v)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_every_near_block_is_met():
    """Each one-edit pair's blocks are equal, or one of the moves leads from one word's to the other's."""
    moves = [tuple(m) for m in spelling._moves()]
    rng = random.Random(4)
    for _ in range(500):
        w = "".join(rng.choice(spelling.LETTERS) for _ in range(rng.randrange(6, 12)))
        at = rng.randrange(len(w))
        v = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(spelling.LETTERS) + w[at + 1 :]])
        groups = lambda x: np.array([sum(spelling.LETTERS.index(c) % spelling.GROUPS == g for c in x) for g in range(spelling.GROUPS)])
        step = groups(v) - groups(w)
        assert not step.any() or (tuple(step) in moves) + (tuple(-step) in moves) == 1


def test_empty(frame):
    df = frame([(1, "a")])
    assert spelling.variants(df).collect() == [] and spelling.variants(df.filter("false")).collect() == []


def test_query_on_the_small_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, sf).collect())) == brute(docs)
