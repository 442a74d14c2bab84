"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 1)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words in a seed: the shortest that is rare among the items.
LENGTHS = (3, 5, 8, 13)
_WORD = re.compile(r"\w+")
_CHUNK = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_CHUNKS = "array<struct<chunk:int,start:int,words:array<bigint>,places:array<int>,grams:array<bigint>>>"
_FOUND = "array<struct<key:bigint,score:int,similarity:double,start_word:int,end_word:int,n_seeds:int>>"
_FIELDS = ("key", "score", "similarity", "start_word", "end_word", "n_seeds")


def numbered(text: str | None, numbers: common.Numbers) -> np.ndarray:
    """The words of a text, lower-cased runs of letters, digits and underscores, as 64-bit numbers."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length the 64-bit numbers of all runs of so many words, from differences of one running sum."""
    size = len(words)
    power = np.full(size + 1, _BASE)
    back = np.full(size + 1, _INVERSE)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:size], dtype=np.uint64)])
    found = []
    for n in lengths:
        runs = (sums[n:] - sums[:max(size + 1 - n, 0)]) * back[:max(size + 1 - n, 0)] + np.uint64(n)
        runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((runs ^ (runs >> np.uint64(29))).view(np.int64))
    return found


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and where it ends in ``doc`` (exclusive)."""
    place = np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(doc == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - GAP * place) + GAP * place
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Items:
    """The words of a block of items, one after the other, by their keys in order."""

    def __init__(self, keys: np.ndarray, words: list[np.ndarray]):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ends = np.cumsum([len(words[i]) for i in order])
        self.words = np.concatenate([words[i] for i in order]) if len(words) else np.zeros(0, np.int64)

    def __getitem__(self, key: int) -> np.ndarray:
        at = int(np.searchsorted(self.keys, key))
        return self.words[self.ends[at - 1] if at else 0:self.ends[at]]


def shared(item: tuple[np.ndarray, np.ndarray], part: np.ndarray) -> int:
    """Words that an item (its different words, and how often it has each) and a part of a document share, each as often as both hold it."""
    words, counts = item
    at = np.minimum(np.searchsorted(words, part), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == part], minlength=len(words)), counts).sum())


def item_table(benchmark: DataFrame, least: int) -> DataFrame:
    """key, item_id, words of every item with ``least`` words or more; items with equal words have one key."""
    @F.pandas_udf("array<bigint>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers = common.Numbers()
        for texts in batches:
            yield pd.Series([numbered(t, numbers).view(np.int64) for t in texts])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.asNondeterministic()("text").alias("words"))
    return items.where(F.size("words") >= least).select(F.xxhash64("words").alias("key"), "item_id", "words")


def seed_table(items: DataFrame, lengths: tuple[int, ...], rare: int) -> DataFrame:
    """gram, n, key, first, last, size: the seeds of every item (key, words), with the first and last place that it stands at.

    At every place of an item the shortest n-gram that at most ``rare`` items hold is a seed; an item with none takes all
    its shortest ones.  How many documents hold an n-gram plays no part, so copies cannot hide each other.
    """
    @F.pandas_udf("array<struct<n:int,place:int,gram:bigint>>")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[{"n": n, "place": p, "gram": g} for n, found in zip(lengths, grams(np.asarray(w, np.int64).view(np.uint64), lengths), strict=True)
                              for p, g in enumerate(found.tolist())] for w in lists])

    held = items.select("key", F.size("words").alias("size"), F.explode(runs.asNondeterministic()("words")).alias("g")).select("key", "size", "g.*")
    held = reliable_checkpoint(held)
    holders = held.select("gram", "key").distinct().groupBy("gram").agg(F.count("*").alias("items")).where(F.col("items") <= rare)
    chosen = held.join(holders, "gram").groupBy("key", "size", "place").agg(F.min(F.struct("n", "gram")).alias("g")).select("key", "size", "place", "g.*")
    chosen = reliable_checkpoint(chosen)
    without = held.where(F.col("n") == lengths[0]).join(chosen.select("key").distinct(), "key", "left_anti").select("key", "size", "place", "n", "gram")
    return chosen.unionByName(without).groupBy("gram", "n", "key", "size").agg(F.min("place").alias("first"), F.max("place").alias("last"))


def _chunker(held, lengths: tuple[int, ...], reach: int):
    """A column function from texts to their chunks that may hold a seed: the seeds' places and numbers, and the words from
    ``reach`` before the first to ``reach`` after the last."""
    @F.pandas_udf(_CHUNKS)
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers, bits = common.Numbers(), held.value
        for texts in batches:
            out = []
            for text in texts:
                words = numbered(text, numbers)
                places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for runs in grams(words, lengths):
                    at = np.flatnonzero(common.in_filter(bits, runs))
                    places.append(at)
                    found.append(runs[at])
                at, of = np.concatenate(places), np.concatenate(found)
                parts = []
                for c in np.unique(at // _CHUNK).tolist():
                    inside = at // _CHUNK == c
                    here = at[inside]
                    start = max(0, int(here.min()) - reach)
                    parts.append({"chunk": c, "start": start, "words": words[start:int(here.max()) + reach].view(np.int64),
                                  "places": here.astype(np.int32), "grams": of[inside]})
                out.append(parts)
            yield pd.Series(out)

    return chunks.asNondeterministic()


def _aligner(items, similarity: float):
    """A column function from a chunk (start, words) and bands of items in it (keys, lo, hi, n) to the items that it holds."""
    @F.pandas_udf(_FOUND)
    def held(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, counts = items.value, {}
        for batch in batches:
            out = []
            for start, words, keys, los, his, ns in zip(*batch, strict=True):
                found = []
                for key, lo, hi, n in zip(keys.tolist(), los.tolist(), his.tolist(), ns.tolist(), strict=True):
                    item = known[key]
                    if key not in counts:
                        if len(counts) >= 10_000:
                            counts.clear()
                        counts[key] = np.unique(item, return_counts=True)
                    lo = max(0, lo - start)
                    part, need = words[lo:max(lo, hi - start)], similarity * MATCH * len(item)
                    if MATCH * shared(counts[key], part) < need:  # the score cannot reach the limit here
                        continue
                    score, end = align(item, part)
                    if score >= need:
                        _, back = align(item[::-1], part[:end][::-1])
                        at = start + lo + end
                        found.append(dict(zip(_FIELDS, (key, score, score / (MATCH * len(item)), at - back, at, n), strict=True)))
                out.append(found)
            yield pd.Series(out)

    return held.asNondeterministic()


def bands(chunks: DataFrame, seeds: DataFrame, similarity: float) -> DataFrame:
    """row, chunk, key, lo, hi, n: where a chunk's words may hold an item.

    A seed at place p of the document and q of the item lies on diagonal p - q.  Diagonals are taken together in bands as wide as the item is
    long, so seeds that repeat give few bands; lo and hi add the item's length and the words that an alignment can add at most.
    """
    hits = chunks.select("row", "chunk", F.explode(F.arrays_zip("places", "grams")).alias("h")).select("row", "chunk", F.col("h.places").alias("p"), F.col("h.grams").alias("gram"))
    near = hits.join(seeds, "gram").withColumn("d1", F.expr("CAST(p - last AS BIGINT)")).withColumn("d2", F.expr("CAST(p - first AS BIGINT)"))
    near = near.withColumn("band", F.explode(F.expr("sequence(floor(d1 / size), floor(d2 / size))")))
    found = near.groupBy("row", "chunk", "key", "size", "band").agg(
        F.min(F.expr("greatest(d1, band * size)")).alias("lo"), F.max(F.expr("least(d2, band * size + size - 1)")).alias("hi"), F.count("*").cast("int").alias("n"))
    loose = F.ceil(F.lit((1 - similarity) * MATCH) * F.col("size"))
    return found.select("row", "chunk", "key", (F.col("lo") - loose).alias("lo"), (F.col("hi") + F.col("size") + loose).alias("hi"), "n")


def find(docs: DataFrame, benchmark: DataFrame, n: int = 3, similarity: float = 0.5, rare: int = 16,
         block_bytes: int = 32 << 20, filter_bits: int = 1 << 26) -> DataFrame:
    """One row per document and benchmark item that it holds, copied, edited or paraphrased in part.

    Words are lower-cased runs of letters, digits and underscores.  Seeds are n-grams of ``n`` words or more that are rare among the items
    (:func:`seed_table`); items and passages of documents meet where they share one, by a join.  Around its seeds
    (:func:`bands`) an item is aligned with the passage: +2 for an equal word, -1 for a different, added or missing
    one; passages whose words cannot reach the limit in any order are passed over.  An item counts as held if
    the score reaches ``similarity`` of its score with itself.  So every alignment that reaches it and has one of the item's
    seeds whole is found; one without is not.  An n-gram that many items share is a longer seed or none, so common
    phrases cost nothing but a look.

    Whole texts are searched where they lie, once, for places that a bit filter of fixed size takes for seeds; only the words around such
    places move, as 64-bit numbers, at most 4,096 places long.  Items are broadcast for the alignment in blocks of ``block_bytes`` (8 for a word) in turn,
    each for the bands of its items alone.

    Result: doc_id, item_id, n_seeds (that led to the place), score, similarity, start_word, end_word (of the best place).  Null
    and empty texts and items of fewer than ``n`` words match nothing.  Rows with null ids are matched like
    others; repeated rows, of documents and of items, each get their own.  Without items or documents the result is empty.
    Extra columns are not looked at.
    """
    spark = docs.sparkSession
    lengths = (n, *[x for x in LENGTHS if x > n])
    items = reliable_checkpoint(item_table(benchmark, n))
    different = items.dropDuplicates(["key"]).select("key", "words")
    total, longest = different.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    seeds = reliable_checkpoint(seed_table(different, lengths, rare))
    held = spark.sparkContext.broadcast(common.bit_filter(seeds.select("gram"), filter_bits))
    reach = longest + math.ceil((1 - similarity) * MATCH * longest)
    used = tuple(sorted(r["n"] for r in seeds.select("n").distinct().collect()))       # of the few lengths there are
    chunks = docs.select("doc_id", _chunker(held, used, reach)("text").alias("chunks"))
    chunks = chunks.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode("chunks").alias("c")).select("row", "doc_id", "c.*")
    chunks = reliable_checkpoint(chunks)
    found = reliable_checkpoint(bands(chunks, seeds, similarity))
    blocks = max(1, math.ceil(8 * total / block_bytes))
    parts = []
    for block in range(blocks):
        here = lambda key: F.pmod(F.col(key), F.lit(blocks)) == block  # noqa: B023, E731
        rows = different.where(here("key")).toArrow()
        known = Items(rows["key"].to_numpy(), [np.array(w, np.int64) for w in rows["words"].to_pylist()])
        aligned = _aligner(spark.sparkContext.broadcast(known), similarity)
        lists = found.where(here("key")).groupBy("row", "chunk").agg(F.collect_list(F.struct("key", "lo", "hi", "n")).alias("b"))
        met = chunks.select("row", "doc_id", "chunk", "start", "words").join(lists, ["row", "chunk"])
        parts.append(met.select("row", "doc_id", F.explode(aligned("start", "words", "b.key", "b.lo", "b.hi", "b.n")).alias("m")).select("row", "doc_id", "m.*"))
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("row", "key").agg(
        F.first("doc_id").alias("doc_id"), F.max_by(F.struct(*_FIELDS[1:]), F.struct("score", -F.col("start_word"), -F.col("end_word"), "n_seeds")).alias("m"))
    return best.join(items.select("key", "item_id"), "key").select(
        "doc_id", "item_id", "m.n_seeds", "m.score", "m.similarity", "m.start_word", "m.end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are.

    Rows are told apart by a hash of all columns; of the texts only those of matching rows are moved.
    """
    name = common.fresh(docs, "_row")
    keyed = docs.withColumn(name, common.row_hash(docs))
    marked = find(keyed.select(F.col(name).alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(marked, name, "left_anti").drop(name)
