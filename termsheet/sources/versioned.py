"""Tables that batches are merged into: only touched files are rewritten, and a batch counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_COMMIT = "bucket INT, live BIGINT, batch BIGINT, version BIGINT"


class MergedTable:
    """One row per key, in ``buckets`` folders by the key's hash, with a written list of the folders that count.

    A batch rewrites the buckets of its keys into a new version's folder; the files of all others stay as they are.  The
    commit is one small Parquet file with each bucket's live version, made visible by a single rename, so readers see
    a batch whole or not at all, and what a failed run left behind is written over by the next.  A batch whose number was
    committed is passed over.  One writer at a time: a second one fails at the commit.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ddl: str, buckets: int = 64):
        self.spark, self.path, self.key, self.ddl, self.buckets = spark, path.rstrip("/"), key, ddl, buckets

    def create(self) -> MergedTable:
        """An empty table, version 0."""
        self._commit(0, -1, dict.fromkeys(range(self.buckets), -1))
        return self

    def _commit(self, version: int, batch: int, live: dict[int, int]) -> None:
        rows = self.spark.createDataFrame([(b, v, batch) for b, v in sorted(live.items())], "bucket INT, live BIGINT, batch BIGINT")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/version={version}")

    def _last(self) -> tuple[int, int, dict[int, int]]:
        commits = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")
        version = commits.agg(F.max("version")).first()[0]
        rows = commits.filter(F.col("version") == version).collect()       # a row per bucket
        return version, rows[0]["batch"], {r["bucket"]: r["live"] for r in rows}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, live: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in live.items() if v >= 0]
        if not folders:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*folders)

    def read(self) -> DataFrame:
        """The rows of the last committed version."""
        return self._rows(self._last()[2])

    def merge(self, batch: int, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """``how(stored rows of the touched buckets, changes)`` gives those buckets' new rows; False if the batch was in before."""
        version, last, live = self._last()
        if batch <= last:
            return False
        touched = {r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect()}     # buckets at most
        merged = how(self._rows({b: live[b] for b in touched}), changes).withColumn("bucket", self._bucket())
        folder = f"{self.path}/data/version={version + 1}"
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = {r["bucket"] for r in self.spark.read.schema(f"{self.ddl}, bucket INT").parquet(folder).select("bucket").distinct().collect()} if touched else set()
        self._commit(version + 1, batch, {b: (version + 1 if b in written else -1) if b in touched else v for b, v in live.items()})
        return True
