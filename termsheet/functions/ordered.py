"""Order-dependent lookups that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def previous_known(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                   block: int = 50_000) -> DataFrame:
    """Add the last non-null ``value`` strictly before each row of its key, by ``order``.

    ``order`` is a whole number, unique per key.  Keys are cut into blocks of ``block`` numbers:
    inside a block a window looks back, and what earlier blocks leave behind is carried by a
    window over one row per block.  A key holding a third of the data is thus spread over many
    tasks instead of one.
    """
    cut = df.withColumns({"_value": value, "_block": F.floor(F.col(order) / block)})
    part = [*keys, "_block"]
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    left_behind = (cut.groupBy(*part)
                   .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
                   .withColumn("_carry", F.last("_last", ignorenulls=True).over(across)).drop("_last"))
    looked = cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return (looked.join(left_behind, part, "left")
            .withColumn(name, F.coalesce("_inside", "_carry"))
            .drop("_value", "_block", "_inside", "_carry"))
