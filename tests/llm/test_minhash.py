"""Near duplicates and components against exhaustive search."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import minhash
from spanloom.llm.components import components
from spanloom.llm.wordhash import shingle_sets

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, threshold):
    sets, where, links = {k: shingles(t) for k, t in docs.items()}, defaultdict(list), []
    for k, s in sets.items():
        for j, both in Counter(j for x in s for j in where[x]).items():
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                links.append((j, k))
        for x in s:
            where[x].append(k)
    found = roots(links, docs)
    return {k: (len(sets[k]), found[k]) for k in docs}


def corpus(n=400):
    rng = random.Random(2)
    base = [f"W{rng.randrange(500)}" for _ in range(120)]
    docs = {}
    for i in range(n):
        size = rng.choice([0, 1, 3, 5, 6, 7, 8, 9, 12, 30, 120])
        words = base[:size] if rng.random() < 0.8 else [f"q{rng.randrange(9)}" for _ in range(size)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            if words:
                words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        docs[i] = " ".join(words)
    return docs | {n: None, n + 1: "  \n", n + 2: base[0].lower()}


def near_copies(n=150):
    """A third of the rows of one group: copies with up to eight words changed, many of them close to the threshold."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    docs = {}
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        docs[i] = " ".join(words[: rng.choice([200, 200, 190, 180])])
    return docs | {n + i: " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for i in range(2 * n)}


@pytest.mark.parametrize("threshold, rows", [(85, corpus), (80, corpus), (85, near_copies), (80, near_copies)])
def test_equals_exhaustive_search(spark, frame, threshold, rows):
    docs = rows()
    want = brute(docs, threshold)
    rows = minhash.near_duplicates(frame(list(docs.items()), rep=F.lit(0), registers=F.lit("x")), threshold).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_odd_rows(spark, frame):
    rows = minhash.near_duplicates(frame([(3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F"), (None, "a b c d e f"), (4, None)]), 80).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [
        ("3", "3", True), ("3", "3", True), ("4", "4", True), ("9", "3", False), ("None", "None", True),
    ]
    assert minhash.near_duplicates(frame([]), 80).collect() == []


def test_keep_one_keeps_columns(spark, frame):
    df = frame([(1, "a b c d e f"), (2, "a b c d e f"), (5, "other words here")], kept=F.lit("mine"), component_id=F.lit(7))
    out = minhash.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 5]


def test_keep_one_goes_by_rows(spark, frame):
    a, b, c, d = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    rows = [(1, a), (1, a), (1, a), (2, "A B C D E F"), (2, b), (3, b.upper()), (None, c), (None, c), (None, "C D E F G H"), (4, d), (4, None), (4, None), (None, ""), (None, a)]
    df = frame(rows, n_shingles=F.lit(1))
    out = sorted((str(r.doc_id), (r.text or "").lower()) for r in minhash.keep_one(df).collect())
    assert out == sorted([("1", a), ("2", b), ("None", c), ("None", "c d e f g h"), ("4", d), ("4", ""), ("None", "")])


def test_keep_one_with_a_third_of_all_rows_equal(spark, frame):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(200)]
    out = minhash.keep_one(frame(docs + [(7, docs[7][1])] * 60 + [(None, docs[8][1])] * 60)).collect()
    assert sorted(r.doc_id for r in out) == list(range(200))


def test_bands_follow_from_the_threshold():
    for t in (0.5, 0.7, 0.8, 0.85, 0.95):
        rows = minhash.band_rows(t)
        assert (1 - t**rows) ** (minhash.REGISTERS // rows) < 1e-8
    assert minhash.band_rows(0.8) == 5 and minhash.band_rows(0.85) == 6


def test_sets_and_estimates():
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" if i % 60 else "new" for i in range(1000))
    x, y = shingle_sets(pa.array([a, b]))
    assert len(x) == len(shingles(a)) and len(y) == len(shingles(b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    got = minhash.estimate(minhash.sketch(x), minhash.sketch(y), np.array(len(x)), np.array(len(y)))
    assert abs(got - true) < 0.1 and minhash.estimate(minhash.sketch(x), minhash.sketch(x), np.array(996), np.array(996)) == pytest.approx(1)


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    want = roots(links, {n for e in links for n in e})
    assert got == {n: r for n, r in want.items() if n in got} and all(want[n] == n for n in want if n not in got)
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
