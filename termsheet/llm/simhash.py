"""SimHash near-duplicates by a self-join of binary tries (operator 5)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.llm.components import components
from termsheet.session import reliable_checkpoint

BITS = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), _BLOCK):
        block = [digest(joined[s:e], 42) for s, e in zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK], strict=False)]
        ones += np.unpackbits(np.array(block, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Adds ``fp``, the fingerprint of ``text`` as a signed long; only texts go to Python."""
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", of.asNondeterministic()("text"))


class _Forest:
    """Vectorised union-find over positions of sorted values."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self._flatten()
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self._flatten()

    def joined(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Whether all positions of two ranges are connected already."""
        changes = np.concatenate([[0], np.cumsum(self.parent[1:] != self.parent[:-1])])
        return (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1]) & (self.parent[alo] == self.parent[blo])


def _close(values: np.ndarray, a: np.ndarray, b: np.ndarray, half: int, budget: int) -> np.ndarray:
    differing = values[a] ^ values[b]
    return (np.bitwise_count(differing) <= budget) & (np.bitwise_count(differing >> np.uint64(32)) <= half)


def trie_links(values: np.ndarray, forest: _Forest, depth: int, left: tuple[int, int], right: tuple[int, int], used: int,
               half: int, budget: int, most: int = 1 << 15) -> None:
    """Links close values below two trie nodes in ``forest``, walking both subtries together.

    ``values`` are sorted, so a trie node is a range of positions that share ``depth`` leading bits;
    ``left`` and ``right`` are such ranges (the same one for a self-join) that differ in ``used`` bits.  A
    pair of nodes is split by its next bit into pairs of children; crossing pairs add a differing bit, and
    a pair is dropped once it has more than ``half`` in the first 32 bits or ``budget`` in all, or once
    everything below it is connected: a dense group is walked until it hangs together, not pair by pair.
    Pairs with few leaves are compared directly.  Pairs wait on a stack in blocks of at most ``most``, the deepest
    first, so memory stays bounded whatever the number of pairs.
    """
    one = np.uint64(1)
    stack = [(depth, *(np.array([x], np.int64) for x in (*left, *right, used)))]
    while stack:
        d, *pairs = stack.pop()
        if len(pairs[0]) > most:
            stack += [(d, *(x[cut] for x in pairs)) for cut in (slice(0, len(pairs[0]) // 2), slice(len(pairs[0]) // 2, None))]
            continue
        open_ = ~forest.joined(*pairs[:4])
        alo, ahi, blo, bhi, diff = (x[open_] for x in pairs)
        leaves = (ahi - alo) * (bhi - blo)
        direct = (leaves <= 16) | (d >= BITS)
        if direct.any():
            n = leaves[direct]
            pair = np.repeat(np.flatnonzero(direct), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wide = (bhi - blo)[pair]
            a, b = alo[pair] + k // wide, blo[pair] + k % wide
            ordered = (a < b) | (alo[pair] != blo[pair])
            a, b = a[ordered], b[ordered]
            near = _close(values, a, b, half, budget)
            forest.link(a[near], b[near])
            alo, ahi, blo, bhi, diff = (x[~direct] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        shift = np.uint64(BITS - 1 - d)
        middle = lambda lo: np.searchsorted(values, ((values[lo] >> shift) | one) << shift)  # noqa: B023, E731
        amid, bmid = np.minimum(middle(alo), ahi), np.minimum(middle(blo), bhi)
        same = alo == blo
        children = []
        for x0, x1, y0, y1, crossing in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            fits = (x0 < x1) & (y0 < y1) & (diff + crossing <= (half if d < 32 else budget))
            if crossing and x0 is amid:
                fits &= ~same                                     # of a node with itself, the mirrored pair
            children.append([v[fits] for v in (x0, x1, y0, y1, diff + crossing)])
        stack.append((d + 1, *(np.concatenate(v) for v in zip(*children, strict=True))))


def links(distinct: DataFrame, budget: int = 4, subtrie: int = 1 << 14) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``budget`` differing bits of each other.

    Two tries hold the fingerprints, one by their leading and one by their trailing half first: of at most
    ``budget`` differing bits one half has at most half of them, so each trie is pruned at that in its first
    32 levels.  Subtries of about ``subtrie`` fingerprints are dealt out in pairs whose prefixes may still
    match; a task walks one pair and returns a spanning forest of the links it finds, at most one row for
    each fingerprint it holds, so a dense group never yields all of its pairs.
    """
    half = budget // 2
    n = distinct.count()
    depth = min(24, max(0, math.ceil(math.log2(max(n, 1) / subtrie)))) if n else 0
    masks = [sum(1 << b for b in some) for k in range(min(half, depth) + 1) for some in itertools.combinations(range(depth), k)]
    low = F.lit((1 << 32) - 1)
    swapped = F.shiftleft(F.col("fp").bitwiseAND(low), 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    views = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("view"), F.col("fp").alias("fp")),
                                              F.struct(F.lit(1).alias("view"), swapped.alias("fp")))).alias("x")).select("x.*")
    prefix = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    pairs = (views.withColumn("p", prefix).withColumn("q", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
             .withColumn("q", F.col("p").bitwiseXOR(F.col("q")))
             .select("view", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "fp"))

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        view, a, b = (int(x) for x in key)
        values = np.sort(group["fp"].to_numpy().view(np.uint64))
        forest = _Forest(len(values))
        cut = int(np.searchsorted(values, np.uint64(b << (BITS - depth)))) if a != b else 0
        left, right = ((0, cut), (cut, len(values))) if a != b else ((0, len(values)),) * 2
        if left[0] < left[1] and right[0] < right[1]:
            trie_links(values, forest, depth, left, right, (a ^ b).bit_count(), half, budget)
        linked = np.flatnonzero(forest.parent != np.arange(len(values)))
        ends = [values[linked], values[forest.parent[linked]]]
        if view:
            ends = [(x << np.uint64(32)) | (x >> np.uint64(32)) for x in ends]
        return pd.DataFrame({"u": ends[0].view(np.int64), "v": ends[1].view(np.int64)})

    return pairs.groupBy("view", "a", "b").applyInPandas(walk, "u BIGINT, v BIGINT")


def classes(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, root) for every distinct fingerprint: root is the same within a component."""
    distinct = reliable_checkpoint(prints.select("fp").distinct())
    found = components(links(distinct, budget)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Copies are one
    fingerprint, so a group of copies is one leaf of the trie.  Repeated rows get equal results; rows with
    a null id take part, but their id is never a component's (null if a component has no other).  Extra
    columns are not looked at; an empty table gives an empty result.
    """
    prints = reliable_checkpoint(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = classes(prints, budget).join(smallest, "fp")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = of.join(ids, "root").select("fp", "component_id")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """The row of ``docs`` with the smallest id of every component, all columns as they are.

    Null ids come last; rows with equal ids are told apart by a hash of the row, and of rows equal in
    everything one stays.  The choice is made on ids and hashes; texts are read once more for the result.
    """
    key = {c: common.fresh(docs, f"_one_{c}") for c in ("row", "none", "id")}
    keyed = (docs.withColumn(key["row"], common.row_hash(docs)).withColumn(key["none"], F.col("doc_id").isNull())
             .withColumn(key["id"], F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    names = [key["none"], key["id"], key["row"]]
    prints = reliable_checkpoint(fingerprints(keyed.select(*names, "text"), shingle).select(*names, "fp"))
    per_print = prints.groupBy("fp").agg(F.min(F.struct(*names)).alias("w"))
    winners = (classes(prints, budget).join(per_print, "fp").groupBy("root").agg(F.min("w").alias("w")).select("w.*"))
    return keyed.join(winners, names, "left_semi").dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns])
