import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with clashing extra columns, dealt over several partitions."""

    def make(rows, schema="doc_id long, text string", **extra):
        df = spark.createDataFrame(rows, schema)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df.repartition(3)

    return make
