import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Columns with the names that operators use for their own results and helpers.
CLASHING = ("shard", "slot", "score", "fp", "size", "kept", "tie", "_row", "key", "none", "stratum", "at", "_texts", "_epochs", "Score", "item", "block", "h")


@pytest.fixture(scope="session")
def docs(spark):
    """A table like ``documents``; rows may leave columns out at the end."""
    from termsheet.llm import common
    common.tune(spark)

    def make(rows):
        width = 5
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id BIGINT, quality INT, toxic INT")


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i % 977} and{i % 31}." for i in range(30_000))
    table = docs([
        (None, None, None, None, None), (None, "text without an id, and of some length. it has two sentences.", "en", "a", 9),
        (1, "", "en", "a", 0), (2, None, "de", None, None), (3, " \n\t ", None, "b", 4),
        (4, "the same row twice, of a few words more", "en", "b", 9), (4, "the same row twice, of a few words more", "en", "b", 9),
        (4, "the same id, another text", "fr", "b", 9), (5, "123 ... !!", "fr", "", 10), (6, long_text, "en", "a", len(long_text)),
        (7, "été à l'ouest 漢字 😀 été", "fr", "c", 1), (8, "x" * 70_000, "en", "c", 70_000),
    ])
    for name in dict.fromkeys(c.lower() for c in CLASHING):
        table = table.withColumn(name, F.lit(name))
    return table.cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
