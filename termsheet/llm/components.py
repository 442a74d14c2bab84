"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.session import reliable_checkpoint


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not the smallest of its component.

    Alternating large and small stars (Kiveris et al., 2014): every round links each node's larger
    neighbours, then its smaller ones, to the smallest neighbour, until each component is one star.  Links
    never outnumber those of the start, rounds grow with the logarithm of the longest path, and a round
    ends in a reliable checkpoint, so neither lineage nor any one task holds a component.
    """
    links = reliable_checkpoint(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = state(links)
    while seen[0]:
        links = reliable_checkpoint(_small_star(_large_star(links)))
        now = state(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
