"""Sharding by proportional stratified interleaving (operator 7); DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common

OUTPUT = ("shard", "slot")


def interleave(df: DataFrame, shards: int = 24, stratum: str = "source", key: str = "doc_id",
               seed: str = "interleave") -> DataFrame:
    """Deals all rows to ``shards`` shards of equal row counts that each hold the sources in proportion.

    Within a source, rows are ordered by the MD5 of seed and key: a seeded shuffle.  Row r (from 0) of
    a source of n rows gets the fractional rank (r + u) / n, where u in [0, 1) is a hash of the source,
    so that many small sources do not all meet at one place.  All rows sorted by fractional rank are cut
    into consecutive shards whose counts differ by at most one; ``slot`` counts a shard's rows from 0.

    Ranks are taken in buckets of the hash and of the fractional rank, as many as the root of the row
    count and each as large, so a source that holds a third of
    all rows is spread over many tasks.  Null sources are a source of their own, ordered last; a null key
    counts as empty text.  Rows with equal keys are ordered by a hash of the whole row; rows equal in
    everything are interchangeable.  Columns named ``shard`` or ``slot`` are replaced; an empty table
    gives an empty result.  Order of the rows, partitions and repeated runs change nothing.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in OUTPUT])
    columns = df.columns
    n = df.count()
    buckets = max(1, math.isqrt(n))
    name = {c: common.fresh(df, f"_il_{c}") for c in
            ("none", "stratum", "digest", "bucket", "tie", "rank", "size", "part", "cut", "place", "all")}
    col = {c: F.col(v) for c, v in name.items()}
    seeded = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c))
    ranked = (
        df.withColumn(name["tie"], common.row_hash(df))
        .withColumn(name["none"], F.col(stratum).isNull())
        .withColumn(name["stratum"], F.coalesce(F.col(stratum).cast("string"), F.lit("")))
        .withColumn(name["digest"], seeded(F.coalesce(F.col(key).cast("string"), F.lit(""))))
        .withColumn(name["bucket"], common.hex_fraction(col["digest"], buckets))
    )
    ranked = common.running_sums(ranked, [name["none"], name["stratum"]], name["bucket"],
                                 [col["digest"], col["tie"]], F.lit(1), name["rank"], name["size"])
    shift = F.conv(F.substring(seeded(F.concat(F.lit("source:"), col["none"].cast("string"), col["stratum"])), 1, 8),
                   16, 10).cast("double") / F.lit(float(2 ** 32))
    ranked = (
        ranked.withColumn(name["part"], (col["rank"] + shift) / col["size"])
        .withColumn(name["cut"], F.least(F.floor(col["part"] * buckets), F.lit(buckets - 1)).cast("long"))
    )
    placed = common.running_sums(ranked, [], name["cut"],
                                 [col["part"], col["none"], col["stratum"], col["digest"], col["tie"]],
                                 F.lit(1), name["place"], name["all"])
    shard = F.floor(col["place"] * shards / max(n, 1)).cast("long")
    # The exact quotient: a product beyond 2**53 is not a whole double.
    shard = F.expr(f"({name['place']} * {int(shards)}L) DIV {max(n, 1)}L") if n else shard
    first = F.expr(f"(shard * {max(n, 1)}L + {int(shards) - 1}L) DIV {int(shards)}L")
    return (
        placed.withColumn("shard", shard.cast("int")).withColumn("slot", (col["place"] - first).cast("long"))
        .select(*[F.col(f"`{c}`") for c in columns], "shard", "slot")
    )
