"""M-trees: what the search of all shards sends, and trees that no bound spares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mtree


def best_pairs(rows, k=5, every=50):
    """As the SQL has it: every pair of a query's vector and another id's vector is a row."""
    whole = sorted({(i, tuple(int(np.floor(256 * e)) for e in v)) for i, v in rows})
    out = set()
    for q in {i for i, _ in whole if i % every == 0}:
        pairs = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, v in whole if j == q for i, w in whole if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(pairs[:k])}
    return out


def test_pairs_of_query_and_shard_hold_no_vectors(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("PAGE", 4), ("QUERIES", 8), ("CELL_BYTES", 8 * 6 * 16), ("CELL_SHARDS", 3)):
        monkeypatch.setattr(mtree, name, value)
    sent, choose = [], mtree.chosen_shards

    def seen(asked, trees, shards, dim, largest):
        out = choose(asked, trees, shards, dim, largest)
        sent.append((dict(out.dtypes)["asked"], asked.count(), out.count()))
        return out

    monkeypatch.setattr(mtree, "chosen_shards", seen)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (600, 6)) / 4  # many equal scores
    rows = [(5 * i, v) for i, v in enumerate(x.tolist())]
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert len(got) == len(set(got)) and set(got) == best_pairs(rows)
    # Places in a block instead of vectors, and blocks in several ranges.
    assert sent[0][0] == "array<int>" and sent[0][1] > 2 and sent[0][2] > 10


def test_ids_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 30)
    rng = np.random.default_rng(6)
    rows = [(int(i), v) for i, v in zip(rng.integers(0, 160, 400), (rng.integers(-2, 3, (400, 3)) / 2).tolist(), strict=True)]
    rows += [(100, [0.5, 0.5, 0.5]), (100, [0.5, 0.5, -0.5]), (50, [1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0])]
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    # An id may take several places, with equal scores too.
    assert sorted(got) == sorted(best_pairs(rows)) and len({r[:2] for r in got}) == len(got)


@pytest.mark.parametrize("size", [50, 5_000, 40_000_000])
def test_tree_that_no_bound_spares(size, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.floor(rng.integers(-3, 4, (900, 40)) * (size / 3)).astype(float)
    x[600:] = x[:300]  # equal scores
    q, own = x[:700], np.arange(700) % 650  # some ids twice
    largest = float((x * x).sum(axis=1).max())
    assert {50: largest < mtree.SINGLE, 5_000: mtree.SINGLE < largest < mtree.EXACT, 40_000_000: largest > mtree.EXACT}[size]
    kind = mtree._kind(largest)
    tree = mtree.Tree.unpacked(mtree.Tree.build(np.arange(900), x, largest).packed(), kind)
    score = x.astype(np.int64)[:700] @ x.astype(np.int64).T
    least = np.sort(score, axis=1)[:, -8].astype(float)
    best = mtree.Best(own, 5, least)
    asked = np.arange(0, 700, 2)
    needed = tree.search_block(mtree.Bounds(q.astype(kind), largest), best, asked)
    assert needed == len(asked) * (len(x) + 1)  # multiplied as a whole
    for i in asked.tolist():
        order = [j for j in np.lexsort((np.arange(900), -score[i])) if j != own[i]][:5]
        want = [(j, int(score[i, j])) for j in order if score[i, j] >= least[i]]
        found = best.ids[i] != mtree.NOBODY
        assert [(j, s) for j, s in zip(best.ids[i][found].tolist(), best.score[i][found].tolist()) if s >= least[i]] == want
    assert (best.ids[1::2] == mtree.NOBODY).all()
    # Entries that tie are taken in parts, and the least ids stay.
    same = mtree.Best(np.array([3, -1]), 5, np.full(2, -np.inf))
    same.take(np.repeat([0, 1], 900), np.full(1800, 7), np.tile(np.arange(900)[::-1], 2))
    assert same.ids.tolist() == [[0, 1, 2, 4, 5], [0, 1, 2, 3, 4]]
