"""Packing along the Hilbert curve: the curve itself, exact ids, sequences without gaps or padding, neighbours alike."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import curve
from spanloom.llm.queries import QUERIES
from spanloom.llm.tokens import Encoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 5), (3, 3), (4, 2), (4, 3)])
def test_hilbert_key_visits_every_cell_in_single_steps(dims, bits):
    axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
    cell = np.stack([a.ravel() for a in axes], axis=1)
    key = curve.hilbert_key(cell, bits)
    order = np.argsort(key)
    assert key[order].tolist() == list(range(len(cell)))
    assert (np.abs(np.diff(cell[order], axis=0)).sum(axis=1) == 1).all()


def test_cells_and_vectors():
    v = curve.document_vectors(pa.array(["", None, "a b a", " \n", "b a a", "A B A"]))
    assert np.allclose((v * v).sum(axis=1), [0, 0, 1, 0, 1, 1]) and np.allclose(v[2], v[4]) and np.allclose(v[2], v[5])
    c = curve.cells(np.eye(256) * 50)
    assert c.min() == 0 and c.max() == (1 << curve.BITS) - 1


def test_tail_is_cut_into_powers_of_two():
    for n in range(1, 2048):
        ends = curve.tail_cuts(n)
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and all(s & (s - 1) == 0 for s in sizes) and sorted(sizes, reverse=True) == list(sizes)


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    letters = "aB'., !é́|<>endoftx\n1# \t\xa0÷Σ"
    return ["", None, "x" * 3000 + ".", "\n\n a", "a \n b \n\n  c", "a\xa0 b", "<|endoftext|> a", "don't!! 'S", "日本語。"] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(n)
    ]


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_the_library(special):
    library = Tokenizer.from_file(BYTE)
    all_ = [t for t in odd_texts(3000) if special or "<|" not in (t or "")]
    ids, ends = Encoder(BYTE).encode(pa.array(all_))
    for i, t in enumerate(all_):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr("spanloom.llm.tokens.REMEMBERED", 200)
    library, encoder = Tokenizer.from_file(BYTE), Encoder(BYTE)
    for seed in range(4):
        all_ = odd_texts(50, seed)
        ids, ends = encoder.encode(pa.array(all_))
        assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(all_))] == [library.encode(t or "", add_special_tokens=False).ids for t in all_]
        assert encoder.held <= 200 and sum(map(len, encoder.young)) <= 300


def holds(rows, docs, size):
    """Every id in exactly one piece, sequences gapless, full or a power of two."""
    library = Tokenizer.from_file(BYTE)
    left = defaultdict(list)
    for doc_id, text in docs:
        left[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [1])
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(of_doc) == set(left)
    for doc_id, own in left.items():
        want = sorted(len(i) for i in own)
        assert sum(r.length for r in of_doc[doc_id]) == sum(want)
        if len(own) == 1:
            at = 0
            for r in sorted(of_doc[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0])
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(own[0][r.start : at], "<u4").tobytes())
    for own in of_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & (at - 1) == 0


@pytest.mark.parametrize("size", [1, 64, 2048])
def test_pack(frame, size):
    rng = random.Random(1)
    docs = list(enumerate(odd_texts(80))) + [(500 + i, "word " * rng.randrange(300)) for i in range(40)]
    docs += [(900, "same text")] * 60 + [(None, "no id"), (7, "again"), (901, "long one " * 3000)]
    df = frame(docs, key=F.lit(1), mix=F.lit("x"), start=F.lit(0))
    holds(curve.pack(df, BYTE, size).collect(), docs, size)
    assert curve.pack(df.filter("false"), BYTE, size).collect() == []


def test_size_must_be_a_power_of_two(frame):
    with pytest.raises(ValueError):
        curve.pack(frame([(1, "a")]), BYTE, 100)


def test_equal_keys_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("all the same text").alias("text"))
    parts = curve.along_the_curve(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = curve.along_the_curve(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 2000


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(8)
    topics = [[f"w{t}x{i}" for i in range(40)] for t in range(12)]
    docs = [(i, " ".join(rng.choice(topics[i % 12]) for _ in range(60))) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = curve.along_the_curve(df).select("doc_id").collect()
    same = sum(a.doc_id % 12 == b.doc_id % 12 for a, b in zip(rows, rows[1:], strict=False)) / len(rows)
    assert same > 0.6  # one in twelve by chance


def test_query_on_the_small_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    holds(QUERIES["op13_curve_packing"](spark, sf).collect(), docs, 2048)
