"""Hard negatives by a vertical scan against a scan of whole vectors."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import negatives
from spanloom.llm.queries import QUERIES, SQL


def brute(rows, every=100, positives=5, count=10):
    """Python integers, so that nothing overflows."""
    kept = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or None in v or not np.isfinite(v).all():
            continue
        if sum((256 * x) * (256 * x) for x in v) >= 2**62:
            continue
        kept[(vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v))] = 1
    out = []
    for vec_id, label, v in kept:
        if vec_id % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i, own == label) for i, own, w in kept if i != vec_id)
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            hard = [(n, j) for n, j, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p][:count]
            out += [(vec_id, i, rank + 1, j, -p, -n) for rank, (n, j) in enumerate(hard)]
    return Counter(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def run(spark, rows, kind="float", **extra):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(3)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return Counter(tuple(r) for r in negatives.hard_negatives(df).select(*COLUMNS).collect())


def single(rows):
    return [(i, c, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, c, v in rows]


@pytest.mark.parametrize("cells", [1 << 20, 400])
def test_equals_a_plain_scan(spark, monkeypatch, cells):
    monkeypatch.setattr(negatives, "SHARD_CELLS", cells)
    monkeypatch.setattr(negatives, "BLOCK_CELLS", cells // 10)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.gauss(0.2, 0.5) for _ in range(12)]) for i in range(450)]
    rows += [(1000 + i, 1, [0.25] * 12) for i in range(150)] + [(2000 + i, 2, [0.1] * 12) for i in range(30)]  # ties
    rows += [(3000, None, [1.0] * 12), (3100, 1, None), (3200, 1, [0.1, None]), (3300, 1, [float("nan")] * 12), (None, 1, [1.0] * 12)]
    rows += [(3400, 1, []), (3500, 0, [0.5, 0.5]), (3600, 2, [1.0]), (3600, 2, [0.5]), (3600, 1, [1.0]), (3700, 9, [1.0] * 12)]
    rows += rows[:20]
    got = run(spark, rows, shard=F.lit("x"), windows=F.lit(1), a=F.lit(2))
    assert got == brute(single(rows)) and len(got) > 100


def test_hot_id_and_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_CELLS", 300)
    rng = random.Random(5)
    rows = [(100 if i % 3 == 0 else i, 1 if i % 2 else 4, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    assert run(spark, rows) == brute(single(rows))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    shards = negatives.Scan(negatives.labelled_vectors(df)).shards.select(F.length("ids") / 8).collect()
    assert max(r[0] for r in shards) <= 2.5 * 300 / 4


def test_large_components(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(2), [rng.choice([1e6, -1e6, 3e5, 7.25]) * rng.random() for _ in range(5)]) for i in range(250)]
    rows += [(300, 0, [1e300, 1.0]), (400, 1, [2e7, 1.0]), (500, 0, [1e7, 2.0]), (501, 0, [9e6, 2.0]), (502, 1, [6e6, 1.0])]
    assert run(spark, rows, "double") == brute(rows)


def test_bounds_spare_components():
    """Components that fall off, as those of trained or rotated vectors do: most rows leave before their last dimension."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(4000, 64)) * 0.9 ** np.arange(64)).astype(np.int64)
    shard = negatives.Shard(np.arange(4000), np.sort(np.arange(4000) % 5), x.T.copy(), True)
    for own in range(0, 4000, 400):
        s = x @ x[own]
        same = shard.labels == shard.labels[own]
        want = [(negatives.LOWEST, negatives.HIGHEST, int(i), int(s[i])) for i in np.lexsort((np.arange(4000), -s)) if same[i] and i != own][:5]
        assert shard.scan(own, shard.labels[own], x[own], [(negatives.LOWEST, negatives.HIGHEST)], 5, True) == want
        top = want[0][3]
        windows = [(3 * top // 10, 9 * top // 10), (top // 10, top // 5)]
        got = shard.scan(own, shard.labels[own], x[own], windows, 10, False)
        for low, high in windows:
            hard = [(low, high, int(i), int(s[i])) for i in np.lexsort((np.arange(4000), -s)) if not same[i] and low <= s[i] <= high][:10]
            assert [g for g in got if g[:2] == (low, high)] == hard
    assert shard.read < 0.6 * shard.whole


def test_empty(spark):
    assert not run(spark, []) and not run(spark, [(100, 1, [0.5])])


def test_query_equals_its_sql(spark, sf):
    got = QUERIES["op11_bond_negatives"](spark, sf).select(*COLUMNS).collect()
    want = duckdb.sql(SQL["op11_bond_negatives"].replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'")).select(*COLUMNS).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want
