"""From raw documents to packed training sequences; every stage is one operator of the corpus subpackage.

All stages but the last return the columns of ``documents``.  Each result is written to the shared folder and read again,
so a lost executor costs at most part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, minhash, packing, pii, quality
from spanloom.llm.common import stored
from spanloom.llm.queries import table, word_bpe
from spanloom.session import prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, table(prepare(spark), sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    prepare(spark)
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty from benchmark passages go."""
    return decontaminate.remove_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars stays that of the raw text."""
    prepare(spark)
    return pii.redact(docs, pii.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    prepare(spark)
    return packing.pack(docs, word_bpe())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
