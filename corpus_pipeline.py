"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Harmless, then distinct, then unseen by the benchmark, then mixed, then sharded.  Every stage takes all rows
that the one before kept and, but for the last, returns the columns of ``documents``; rows with nulls,
empty texts and repeated rows follow the rules in the docstrings of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termsheet.llm import common, decontam, mixture, shards, simhash, toxicity
from termsheet.session import drop_folder, work_folder


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    common.tune(spark)
    return toxicity.keep_harmless(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates."""
    common.tune(spark)
    return simhash.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    common.tune(spark)
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them: a row for each epoch, its text what the epoch takes."""
    common.tune(spark)
    return mixture.remix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, dealt to 24 shards that match the mixture: the columns of documents, shard and slot."""
    common.tune(spark)
    return shards.interleave(docs)


STAGES = [("toxicity", harmless), ("simhash", distinct), ("decontamination", unseen), ("mixture", mixed), ("sharding", sharded)]

#: No SQL: a fitted classifier, xxHash fingerprints and seeded draws; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the folder of ``spark.checkpoint.dir``, each until the
    next is written.  The last of them stays, as the result is read from it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            drop_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
