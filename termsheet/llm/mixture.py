"""Mixing sources to target weights in blocks of tokens (operator 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint

_WORD = re.compile(common.WORD)
_CHUNK = 1 << 14


def draw(quotas: list[int], shards: int, seed: int, sizes: list[int] | None = None) -> np.ndarray:
    """Blocks of each source (column) in each output shard (row): multinomial draws by the quotas that are
    left, so that shards are random but the totals are the quotas.  Shards are equal, or have the ``sizes`` given."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, np.int64)
    rows = []
    for k in range(shards):
        n = int(left.sum()) // (shards - k) if sizes is None else int(sizes[k])
        if k == shards - 1 or not n:
            counts = left.copy() if k == shards - 1 else np.zeros_like(left)
        else:
            counts = np.minimum(rng.multinomial(n, left / left.sum()), left)
            lack = n - int(counts.sum())                          # what was drawn beyond a source's rest
            for i in np.argsort(counts - left, kind="stable") if lack else ():
                more = min(lack, int(left[i] - counts[i]))
                counts[i] += more
                lack -= more
                if not lack:
                    break
        rows.append(counts)
        left -= counts
    return np.array(rows, np.int64).reshape(shards, len(quotas))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where pseudorandom permutations of 0..size-1, one for each key, put the indices; ``back``: where from.

    Four Feistel rounds on the smallest even number of bits that holds the size; results beyond it
    are permuted again until they fall inside.
    """
    x, size = index.astype(np.uint64), size.astype(np.uint64)
    key = _mix64(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bits = np.ceil(np.log2(np.maximum(size.astype(float), 2)) / 2 + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        mixed = lambda half, turn: _mix64(half + k + np.uint64((turn + 1) * 0xD1B54A32D192ED03 % 2 ** 64)) & m  # noqa: B023, E731
        left, right = x[todo] >> b, x[todo] & m
        for turn in reversed(range(4)) if back else range(4):
            left, right = (right ^ mixed(left, turn), left) if back else (right, left ^ mixed(right, turn))
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def _key(epoch, source, seed: int):
    """The key of the permutation that orders a source's blocks in an epoch."""
    return epoch * 1_000_003 + source * 7_919 + seed


def quotas(sizes: list[int], wanted: list[float], block: int, seed: int, source: list[int] | None = None) -> list[tuple[int, int]]:
    """Slots of each source (numbered in turn, or as given) and the words that its last slot takes, so that all take the wanted words (rounded).

    Whole epochs come first; then blocks in the order of the last epoch's permutation until the words that
    are left are reached, the last block cut to them.  One block of a source may be shorter than the others.
    """
    size, words = np.array(sizes, np.int64), np.array([round(w) for w in wanted], np.int64)
    blocks = -(-size // block)
    epochs, rest = np.divmod(words, np.maximum(size, 1))
    place = permuted(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), _key(epochs, np.arange(len(size)) if source is None else np.array(source, np.int64), seed), back=True)
    short = blocks * block - size                                 # words that the last block lacks
    slots = -(-rest // block)
    slots += (place < slots) & (slots * block - short < rest)
    last = rest - (slots - 1) * block + np.where(place < slots - 1, short, 0)
    return [(int(e * b + n), int(x) if n else block) for e, b, n, x in zip(epochs, blocks, slots, last, strict=True)]


def source_table(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """none, stratum, size, source (its number) and target of every source (none, stratum, size).

    Sources by code point, null last, have ``weights`` in turn.  A target is the source's share by weight of all sizes, at most ``cap``
    times its size; what a source cannot give is shared out again by weight among the others until none is above.  So
    the sources above their cap are those with the least size for their weight: sorted by that, the first whose share of what
    all before it leave is not above its cap ends them.  Sums run along ranges, so the sources may be many.
    """
    one = F.lit(0).alias("all")
    table = common.ranked(sizes.select(one, "none", "stratum", "size"), ["all"], [F.col("none"), F.col("stratum")], "source", "sources")
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source") % len(weights) + 1).cast("int")))
    table = table.withColumn("most", F.col("size") * F.lit(float(cap)))
    row = common.ranked(table.where("size > 0"), ["all"], [F.col("most") / F.col("weight"), F.col("source")], "place", "open")
    both = lambda before, own: F.coalesce(before, F.lit(0.0)) + F.coalesce(own, F.lit(0.0))
    row = reliable_checkpoint(common.running(row, ["all"], "place", {"taken": (F.sum, F.col("most"), both), "gone": (F.sum, F.col("weight"), both)}, own=False))
    total, weight = row.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, rest = F.lit(float(total)) - F.col("taken"), F.lit(float(weight)) - F.col("gone")
    ends = row.where(left * F.col("weight") / rest <= F.col("most")).agg(F.min(F.struct("place", left.alias("left"), rest.alias("rest"))).alias("e")).first()["e"]
    known = table.select("none", "stratum", "size", "source", "weight", "most")
    if ends is None:
        return known.withColumn("target", F.lit(0.0)).drop("weight", "most")
    share = F.lit(ends["left"]) * F.col("weight") / F.lit(ends["rest"])
    return known.withColumn("target", F.when(F.col("size") > 0, F.least(share, F.col("most"))).otherwise(0.0)).drop("weight", "most")


def slot_table(sources: DataFrame, block: int, shards: int, seed: int, group: int = 1000, part: int = 1 << 18) -> DataFrame:
    """The drawn slots: shard, none, stratum, epoch, block, words (that it takes of the block at most).

    An epoch draws each block of a source at most once.  Counts are drawn in two steps: for groups of ``group``
    sources on the driver, then for the sources of each group in a task, so that the driver never holds a row per source.
    Slots are dealt out in parts of about ``part``, a number fixed by their total: the rows they are exploded from say nothing
    of their number.
    """
    @F.pandas_udf("struct<slots:bigint,last:bigint>")
    def quota(size: pd.Series, wanted: pd.Series, source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(quotas(size.tolist(), wanted.tolist(), block, seed, source.tolist()), columns=["slots", "last"])

    sources = sources.select("none", "stratum", "source", F.ceil(F.col("size") / block).alias("blocks"), quota("size", "target", "source").alias("q"))
    sources = reliable_checkpoint(sources.select("none", "stratum", "source", "blocks", "q.*", F.expr(f"source DIV {group}").alias("group")))
    groups = sources.groupBy("group").agg(F.sum("slots").alias("slots")).orderBy("group").toArrow()
    totals = groups["slots"].to_pylist()
    counts = draw(totals, shards, seed)
    sizes = dict(zip(groups["group"].to_pylist(), counts.T.tolist(), strict=True))
    shares = sources.sparkSession.createDataFrame(list(sizes.items()), "group BIGINT, sizes ARRAY<BIGINT>")

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        drawn = draw(rows["slots"].tolist(), shards, seed + 1 + int(rows["group"].iloc[0]), rows["sizes"].iloc[0])
        first = np.cumsum(drawn, axis=0) - drawn
        shard, at = np.nonzero(drawn)
        found = rows.iloc[at][["none", "stratum", "source", "blocks", "slots", "last"]].reset_index(drop=True)
        return found.assign(shard=shard.astype(np.int32), first=first[shard, at], n=drawn[shard, at])

    drawn = sources.join(shares, "group").groupBy("group").applyInPandas(
        each, "none BOOLEAN, stratum STRING, source BIGINT, blocks BIGINT, slots BIGINT, last BIGINT, shard INT, first BIGINT, n BIGINT")

    @F.pandas_udf("bigint")
    def place(slot: pd.Series, size: pd.Series, source: pd.Series) -> pd.Series:
        at, n = slot.to_numpy(), size.to_numpy()
        return pd.Series(permuted(at % n, n, _key(at // n, source.to_numpy(), seed)))

    cut = drawn.withColumn("lo", F.explode(F.expr(f"sequence(0L, n - 1, {_CHUNK}L)")))
    cut = cut.repartition(max(1, -(-sum(totals) // part)), F.col("shard"), F.col("source"), F.col("lo"))
    slots = cut.withColumn("slot", F.explode(F.expr(f"sequence(first + lo, first + least(lo + {_CHUNK}, n) - 1)")))
    slots = slots.withColumn("epoch", F.expr("slot DIV blocks").cast("int")).withColumn("block", place("slot", "blocks", "source"))
    slots = slots.withColumn("words", F.expr(f"IF(slot = slots - 1, last, {block}L)"))
    return slots.select("shard", "none", "stratum", "epoch", "block", "words")


def _stream(docs: DataFrame, seed: int, key: str, stratum: str, size) -> DataFrame:
    """Rows with their place ``at`` in their source's stream of tokens: a seeded shuffle, laid end to end."""
    n = max(1, docs.count())
    digest = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = (docs.withColumn("none", F.col(stratum).isNull()).withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
            .withColumn("digest", digest).withColumn("bucket", common.hex_fraction(F.col("digest"), max(1, int(n ** 0.5)))))
    return common.running_sums(rows, ["none", "stratum"], "bucket", [F.col("digest"), F.col("tie")], size, "at", "source_size")


def mix(docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 42, weights: tuple[float, ...] = (5, 2, 1),
        cap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Pieces of documents that the mix takes, and the documents' place in it.

    The words of a source's documents, in a seeded shuffle, form one stream that is cut into blocks of
    ``block`` words (the last may be shorter).  Sources ordered by code point, null last, get ``weights`` in
    turn; :func:`source_table` gives each its words, and :func:`draw` the blocks of each output shard.  The k-th
    slot of a source takes the block at the k-th place of a pseudorandom permutation; once all blocks were
    taken the next epoch permutes them anew.  The last slot takes the words that its source still lacks, from the start
    of its block.  So a word is taken at most ``cap`` times (rounded up), and a source meets its target to the word.
    Streams and slots are joined by source and block number.

    ``docs`` needs doc_id, source, size (words) and tie, a hash that tells rows of one id apart.  First result:
    none, stratum, at, doc_id, tie, size, shard, epoch, block, lo, hi: words lo to hi of the document stand
    in that block of that shard.  Second result: doc_id, size, tie, source_size, target, none, stratum, at.  Null
    sources are a source; rows without words have no pieces; repeated rows are laid one after the other, each with
    its own pieces.  Empty tables give empty results.  Reruns agree.
    """
    stream = reliable_checkpoint(_stream(docs.select("doc_id", "source", "size", "tie"), seed, "doc_id", "source", F.col("size"))
                                 .select("doc_id", "size", "tie", "none", "stratum", "at", "source_size"))
    sizes = stream.groupBy("none", "stratum").agg(F.sum("size").alias("size"))
    sources = reliable_checkpoint(source_table(sizes, weights, cap))
    slots = slot_table(sources, block, shards, seed)
    last = F.expr(f"(at + size - 1) DIV {block}L")
    spans = stream.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at DIV {block}L"), last)))
    lo = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size"))
    spans = spans.withColumn("lo", lo).withColumn("hi", hi).drop("source_size")
    # Exploded slots look as small as the rows they come from; without the hint they would be broadcast.
    pieces = spans.join(slots.hint("merge"), ["none", "stratum", "block"])
    cut = F.least("hi", F.col("block") * block + F.col("words") - F.col("at"))
    pieces = pieces.withColumn("hi", cut).where("lo < hi").drop("words")
    return pieces, stream.join(sources.select("none", "stratum", "target"), ["none", "stratum"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and tie of every row."""
    return docs.select("doc_id", "source", common.n_words(common.text_or_empty()).alias("size"), common.row_hash(docs).alias("tie"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row."""
    pieces, place = mix(sized(docs), **options)
    sums = pieces.groupBy("none", "stratum", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    key = ["none", "stratum", "at"]
    found = place.where("size > 0").join(sums, key, "left").unionByName(place.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text: str, pieces: list) -> str:
    """The text that an epoch takes: its pieces, with the white space that follows their words."""
    ends = [m.start() for m in _WORD.finditer(text)]
    if ends:
        ends[0] = 0
    ends.append(len(text))
    parts: list[list[int]] = []
    for lo, hi in sorted((p["lo"], p["hi"]) for p in pieces):
        if parts and parts[-1][1] == lo:
            parts[-1][1] = hi
        else:
            parts.append([lo, hi])
    whole = parts == [[0, len(ends) - 1]]
    return text if whole else "\n".join(text[ends[lo]:ends[hi]].strip() for lo, hi in parts)


def remix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: one row for every document and epoch that takes
    any of its blocks, with the text that it takes (all of it, as a rule as it is); ``n_chars`` is counted anew.

    Texts are moved once, equal rows as one, to meet the pieces of their rows, a list for each row and epoch.
    """
    pieces, _ = mix(sized(docs), **options)
    keys = ["_none", "_id", "_tie"]
    rows = (pieces.groupBy("none", "stratum", "at", "doc_id", "tie", "epoch")
            .agg(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias("_pieces")))
    rows = rows.select(F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("tie").alias("_tie"), "_pieces")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([_cut(t, p) for t, p in zip(texts, lists, strict=True)], dtype=object)

    names = {k: common.fresh(docs, k) for k in [*keys, "_pieces"]}
    on = [names[k] for k in keys]
    keyed = (docs.withColumn(names["_tie"], common.row_hash(docs)).withColumn(names["_none"], F.col("doc_id").isNull())
             .withColumn(names["_id"], F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    joined = keyed.dropDuplicates(on).join(rows.withColumnsRenamed(names), on)
    mixed = joined.withColumn("text", cut.asNondeterministic()("text", names["_pieces"]))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])
