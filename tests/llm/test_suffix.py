"""Removal of repeated strings against a byte-by-byte search."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import suffix


def brute(docs, length):
    seen, out = set(), {}
    for k in sorted(docs, key=lambda k: (k is not None, k)):
        t = (docs[k] or "").encode()
        covered = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                covered[s : s + length] = b"\1" * length
            else:
                seen.add(t[s : s + length])
        kept = bytes(b for b, f in zip(t, covered) if not f)
        spans = sum(1 for i, f in enumerate(covered) if f and not (i and covered[i - 1]))
        out[k] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=4, n=200):
    rng = random.Random(seed)
    line = "a common line " + "x y z w " * 9
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(50, 500))) for _ in range(8)]
    docs = {}
    for i in range(n):
        parts = [
            rng.choice(base) if rng.random() < 0.5 else "".join(rng.choice("abcd \n") for _ in range(rng.randrange(300)))
            for _ in range(rng.randrange(5))
        ]
        parts = [p[rng.randrange(len(p) // 2 + 1) :] for p in parts]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), line)
        if i % 50 == 7:
            parts.append("ab" * rng.randrange(30, 400))
        docs[i] = "".join(parts)
    return docs | {n: None, n + 1: "a" * 5000, n + 2: "a" * 99, n + 3: "", None: line + base[0]}


def found(df, length):
    rows = suffix.remove_repeats(df, length).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans").cast("long"), F.sha2("kept", 256)
    )
    return [(r[0], tuple(r)[1:]) for r in rows.collect()]


@pytest.mark.parametrize("length, crowded", [(100, 1000), (100, 10), (100, 1), (60, 1000), (33, 1000), (143, 1000), (144, 10), (200, 1000), (251, 1)])
def test_equals_brute_force(spark, frame, monkeypatch, length, crowded):
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    docs = corpus()
    rows = found(frame(list(docs.items()), token=F.lit(1), place=F.lit("x")), length)
    assert len(rows) == len(docs) and dict(rows) == brute(docs, length)


def test_repeated_rows_and_empty_table(spark, frame):
    text = "".join(random.Random(1).choices("abcdef", k=400))
    rows = found(frame([(1, text), (1, text), (2, text)]), 100)
    assert sorted(r[1][1] for r in rows) == [0, 0, 400]
    assert found(frame([]), 100) == []


@pytest.mark.parametrize("crowded", [1000, 1])
def test_texts_without_ids_whose_short_hashes_collide(spark, frame, monkeypatch, crowded):
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    # Two texts that agree in 19 bits of their hash, each with a repeat of the same string at another place.
    rng = random.Random(5)
    line = "".join(rng.choices("abcdef", k=150))
    texts = spark.createDataFrame([(f"{i} " + line + str(i) * 60,) for i in range(4000)], "text string")
    short = texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(1 << 19))).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t[:2]
    for doc_id in (None, 7):
        rows = found(frame([(doc_id, t) for t in short]), 100)
        hashed = spark.createDataFrame([(t,) for t in short], "text string").orderBy(F.xxhash64("text"))
        want = brute({i: r.text for i, r in enumerate(hashed.collect())}, 100)
        assert sorted(r[1] for r in rows) == sorted(want.values())


def test_long_texts_are_cut_into_pieces():
    data = np.frombuffer(bytes(random.Random(3).choices(b"abcd", k=9000)), np.uint8)
    up, down = suffix._powers(suffix.BASE, 20_000), suffix._powers(suffix.UNBASE, 20_000)
    whole = suffix.stretches(data, np.array([0, len(data)]), 100, up, down)
    covered = np.zeros(len(data), int)
    for lo, hi in zip(whole[2], whole[3]):
        covered[lo : hi + 1] += 1
    assert (covered[: len(data) - 99] == 1).all() and not covered[len(data) - 99 :].any()


def test_equal_parts_is_grouping_by_whole_rows():
    rng = np.random.default_rng(0)
    keys, words = rng.integers(0, 4, 3000), rng.integers(0, 2, (3000, 5)).astype(np.uint64)
    part = suffix.equal_parts(keys, words)
    whole = np.unique(np.column_stack([keys.astype(np.uint64), words]), axis=0, return_inverse=True)[1].ravel()
    assert len({*zip(part.tolist(), whole.tolist())}) == len(np.unique(part)) == len(np.unique(whole))
