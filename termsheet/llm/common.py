"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termsheet import session

#: The white space that separates words; everything else belongs to a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """The session settings of the package, and Arrow batches whose texts fit a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return session.tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hex_fraction(digest: Column, buckets: Column | int) -> Column:
    """The bucket of a hexadecimal digest: buckets cover the digests' order evenly and keep it."""
    start = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(start * F.lit(buckets) / F.lit(2 ** 32)).cast("long")


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row, the last word where rows tie in everything an operator orders by."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0).cast("long")


def running_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], weight: Column,
                 before: str, total: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the group that come before, and over all of the group.

    ``bucket`` must follow the order, so that one group, however large, is spread over its buckets:
    sums of whole buckets are taken first and added to the running sum inside the bucket.  Group and
    bucket columns must not be null.  With no group, one small table of buckets is summed in one task.
    """
    w = fresh(df, "_weight")
    sums = fresh(df, "_bucket_sum")
    df = df.withColumn(w, weight.cast("long"))
    per_bucket = df.groupBy(*group, bucket).agg(F.sum(w).alias(sums))
    along = Window.partitionBy(*group) if group else Window.partitionBy()
    per_bucket = (
        per_bucket
        .withColumn(before, F.coalesce(F.sum(sums).over(along.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(total, F.sum(sums).over(along)).drop(sums)
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(per_bucket, [*group, bucket])
    return joined.withColumn(before, F.col(before) + F.coalesce(F.sum(w).over(inside), F.lit(0))).drop(w)


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str, total: str) -> DataFrame:
    """Adds a row's place in its group (from 0) and the rows of the group; written to the checkpoint folder on the way.

    Rows are dealt out by ranges of (group, order), so that one group, however large, is spread over many
    tasks; a group's rows of a range are counted and the counts summed along the ranges.  Rows that tie get places
    of their own, in no stated order.  Group columns must not be null.
    """
    spread, at, part, shift = (fresh(df, n) for n in ("_spread", "_at", "_part", "_shift"))
    keys = [*[F.col(g) for g in group], *order, F.col(spread)]
    rows = df.withColumn(spread, F.rand(42)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(spread)
    rows = rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    rows = session.reliable_checkpoint(rows)
    along = Window.partitionBy(*group)
    before = F.sum("n").over(along.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy(*group, part).agg(F.min(at).alias("first"), F.count("*").alias("n")).select(
        *group, part, (F.coalesce(before, F.lit(0)) - F.col("first")).alias(shift), F.sum("n").over(along).alias(total))
    return rows.join(runs, [*group, part]).withColumn(rank, F.col(at) + F.col(shift)).drop(at, part, shift)


def running(df: DataFrame, group: list[str], at: str, values: dict, back: bool = False, own: bool = True, block: int = 4096) -> DataFrame:
    """Adds aggregates over the rows of a group up to each row (with it if ``own``), in the order of the whole number ``at``.

    ``values``: name -> (aggregate, column, how to put two results together).  ``back`` runs from the last row on.  Blocks of
    places are aggregated first, so that a group is never in one task.  Group columns must not be null.
    """
    cut, ends = fresh(df, "_block"), {name: fresh(df, f"_{name}") for name in values}
    df = df.withColumn(cut, F.expr(f"`{at}` DIV {block}"))
    order = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    blocks = df.groupBy(*group, cut).agg(*[fn(column).alias(ends[name]) for name, (fn, column, _) in values.items()])
    earlier = Window.partitionBy(*group).orderBy(order(cut)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, cut, *[fn(ends[name]).over(earlier).alias(ends[name]) for name, (fn, _, _) in values.items()])
    inside = Window.partitionBy(*group, cut).orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    known = df.join(blocks, [*group, cut])
    both = {name: join(F.col(ends[name]), fn(column).over(inside)) for name, (fn, column, join) in values.items()}
    return known.withColumns(both).drop(cut, *ends.values())


class Numbers(dict):
    """64-bit numbers of words, remembered as long as the memory of them stays small."""

    def __missing__(self, word: str) -> int:
        number = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = number
        return number


def bit_filter(numbers: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits (a power of two) that holds the one column of ``numbers``, two bits each.

    Its size on the driver is fixed, however many numbers there are: bits are put together in Spark, 64 at a time.  It may take others
    for held, so an exact join has to follow.
    """
    (name,) = numbers.columns
    at = F.explode(F.array(F.expr(f"`{name}` & {bits - 1}L"), F.expr(f"shiftright(`{name}`, 32) & {bits - 1}L")))
    words = numbers.select(at.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
    rows = words.toArrow()
    held = np.zeros(bits // 64, "<u8")
    held[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return held.view(np.uint8)


def in_filter(held: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers (int64) a :func:`bit_filter` holds, or takes for held."""
    mask = np.int64(len(held) * 8 - 1)
    known = np.ones(len(numbers), bool)
    for at in (numbers & mask, (numbers >> 32) & mask):
        known &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return known
