"""Merkle manifest of a dataset over labelled intervals of leaf ranks (operator 13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def climb(leaves: DataFrame, keys: list[str], fanout: int) -> list[DataFrame]:
    """The levels over ``leaves`` (keys, lo, hi, digest, n): nodes with the interval of leaf ranks that they cover.

    A node of level k covers ranks lo to hi, where lo is a multiple of fanout^k: this bucket brings its children together.
    Level 0 are the leaves; each further one has keys, lo, hi, digest, n and children (lo, hi, digest; ``fanout`` at
    most).  Trees end at the level where one node covers all.  Each level is written before the next is made.
    """
    levels, widest = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    size = 1
    while size < widest:
        bucket = F.expr(f"lo DIV {size * fanout}L")
        child = F.struct("lo", "hi", "digest")
        nodes = (levels[-1].where(F.col("n") > size).groupBy(*keys, bucket.alias("lo"))
                 .agg(F.sort_array(F.collect_list(child)).alias("children"), F.max("hi").alias("hi"), F.first("n").alias("n")))
        nodes = nodes.withColumn("lo", F.col("lo") * (size * fanout)).withColumn("digest", digest(F.array_join("children.digest", "")))
        levels.append(reliable_checkpoint(nodes))
        size *= fanout
    return levels


def _attached(children: DataFrame, parents: DataFrame, keys: list[str], size: int, carried: list[str]) -> DataFrame:
    """``children`` with the path of the parent whose interval holds theirs, a step added for their own siblings.

    Parent and child meet in the bucket of the parents' level.  What the parent covers before and after the child is where
    its siblings lie.
    """
    above = parents.select(*keys, F.expr(f"lo DIV {size}L").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                           F.col("children").alias("_children"), F.col("path").alias("_path"), *carried)
    met = children.withColumn("_bucket", F.expr(f"lo DIV {size}L")).join(above.hint("merge"), [*keys, "_bucket"])
    met = met.where("_lo <= lo AND hi <= _hi")
    covers = lambda keep: F.array_join(F.transform(F.filter("_children", keep), lambda c: c["digest"]), "")
    step = F.struct(covers(lambda c: c["hi"] <= F.col("lo")).alias("left"), covers(lambda c: c["lo"] >= F.col("hi")).alias("right"))
    return met.withColumn("path", F.concat(F.array(step), "_path")).drop("_bucket", "_lo", "_hi", "_children", "_path")


def descend(levels: list[DataFrame], keys: list[str], fanout: int, tops: DataFrame) -> DataFrame:
    """The leaves with their paths (left and right siblings of every level, from the leaf up).

    ``tops``: keys, path of a tree's top node, and columns that its leaves get too.
    """
    carried = [c for c in tops.columns if c not in (*keys, "path")]
    parents = None
    for k in reversed(range(len(levels))):
        whole = F.expr("hi - lo = n")
        found = levels[k].where(whole).join(tops, keys)
        if parents is not None:
            found = found.unionByName(_attached(levels[k].where(~whole), parents, keys, fanout ** (k + 1), carried))
        parents = found
    return parents


def manifest(docs: DataFrame, fanout: int = 8) -> DataFrame:
    """Every row with its leaf, its language's subroot, the root, its proof, and a proof folded from tampered text.

    A leaf is the digest of doc_id, source, lang, n_chars and text (:func:`field`).  In each language leaves ascend by doc_id (null
    first), equal ids by their digest; runs of ``fanout`` nodes become one until one is left, the subroot.  Subroots
    ascend by language (null first, by bytes) and become the root alike.  ``tampered`` is the leaf of the text
    with A-Z in lower case where 3 divides the crc32 of the id, else the leaf (a row without an id is not tampered with).

    Texts are digested where they are read; only digests move.  Ranks come from ranges, so one language may hold any
    share of the rows; no task sees more than ``fanout`` nodes of a parent at a time, and a language's path is joined once per
    level to an eighth of the rows below.

    Result: doc_id, lang, rank, leaf, subroot, root, path (array of left, right), proof_sha256, folded_root, verified.  Null
    and empty texts are leaves like others; equal rows are leaves of their own; an empty table gives no
    rows.  Extra columns are not looked at.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    known = [field(F.col(c)) for c in fields]
    changed = F.translate("text", _UPPER, _LOWER)
    tampering = F.col("doc_id").isNotNull() & (common.id_remainder(F.col("doc_id"), 3) == 0)
    rows = docs.select("doc_id", "lang", F.col("lang").isNotNull().alias("named"), F.coalesce("lang", F.lit("")).alias("tree"),
                       digest(*known, field(F.col("text"))).alias("digest"),
                       F.when(tampering, digest(*known, field(changed))).alias("tampered"))
    keys = ["named", "tree"]
    rows = reliable_checkpoint(rows)                              # ranges are sampled first; texts are not digested twice for it
    placed = common.ranked(rows, keys, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "lo", "n")
    leaves = reliable_checkpoint(placed.withColumn("hi", F.col("lo") + 1))
    levels = climb(leaves, keys, fanout)
    subroots = reduce(DataFrame.unionByName, [level.where("hi - lo = n").select(*keys, "digest") for level in levels])
    one = subroots.select(F.lit(0).alias("all"), *keys, "digest")
    upper = common.ranked(one, ["all"], [F.col(k) for k in keys], "lo", "n").withColumn("hi", F.col("lo") + 1)
    upper_levels = climb(reliable_checkpoint(upper), ["all"], fanout)
    steps = F.array().cast("array<struct<left:string,right:string>>")
    root = upper_levels[-1].select("all", F.col("digest").alias("root"), steps.alias("path"))
    tops = descend(upper_levels, ["all"], fanout, root).select(*keys, "path", "root", F.col("digest").alias("subroot"))
    found = descend(levels, keys, fanout, reliable_checkpoint(tops)).withColumnRenamed("digest", "leaf")
    fold = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda so_far, s: digest(s["left"], so_far, s["right"]))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    found = found.withColumn("proof_sha256", proof).withColumn("folded_root", fold)
    return found.select("doc_id", "lang", F.col("lo").alias("rank"), "leaf", "subroot", "root", "path", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
