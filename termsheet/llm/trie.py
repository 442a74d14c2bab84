"""Prefix trie of conversations: a z-fast trie, built in batches and expanded to a node for every turn (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint

#: Turns that a conversation may borrow at most: crc32 % 9.
_MODULUS, _FAMILY = 9, 5
_CHUNK = 4096


def two_fattest(a: str, b: str) -> Column:
    """The number in (a, b] that the highest power of two divides."""
    bit = f"length(bin({a} ^ {b})) - 1"
    return F.expr(f"shiftleft(shiftright({b}, {bit}), {bit})")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations (c, d from 1, len, digest, bytes) and the conversations (c, len).

    Conversation c borrows the first h = crc32(c) % 9 turns of conversation c - c % 5 and goes on with its own turns
    after its first h.  Texts are digested where they are read.
    """
    role, text = common.text_or_empty("role"), common.text_or_empty("text")
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", content.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    placed = common.ranked(rows, ["c"], [F.col("turn").asc_nulls_first(), F.col("digest")], "at", "n")
    placed = reliable_checkpoint(placed.select("c", "at", "n", "digest", "bytes"))
    convs = placed.where("at = 0").select("c", "n", common.id_remainder(F.col("c"), _MODULUS).alias("h"),
                                          F.expr(f"c - c % {_FAMILY}").alias("base"))
    convs = convs.join(convs.select(F.col("c").alias("base"), F.col("n").alias("lent")), "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = reliable_checkpoint(convs.withColumn("len", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = placed.drop("n").join(convs.select("c", "h", "lent", "len"), "c").where("at >= h")
    lent = placed.where(f"at < {_MODULUS}").select(F.col("c").alias("base"), "at", "digest", "bytes").join(convs, "base").where("at < h")
    columns = ["c", "d", "len", "digest", "bytes"]
    turns = own.withColumn("d", F.expr("at - h + lent + 1")).select(columns).unionByName(lent.withColumn("d", F.col("at") + 1).select(columns))
    return turns, convs.select("c", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each first d turns of each conversation: c, d, len, bytes of the last turn, the fingerprint (p1, p2) and
    that of the first d - 1 turns (q1, q2).

    A fingerprint is the exclusive or of 128-bit hashes of (place, turn), so it can be put together block by block; that
    of no turns is zero.
    """
    last = {f"x{k}": F.xxhash64(F.lit(k), "d", "digest") for k in (1, 2)}
    both = lambda before, own: F.coalesce(before, F.lit(0)).bitwiseXOR(own)
    summed = common.running(turns.withColumns(last).drop("digest"), ["c"], "d", {f"p{k}": (F.bit_xor, F.col(f"x{k}"), both) for k in (1, 2)})
    return summed.select("c", "d", "len", "bytes", "p1", "p2", F.expr("p1 ^ x1").alias("q1"), F.expr("p2 ^ x2").alias("q2"))


def handles(points: DataFrame, paths: DataFrame) -> DataFrame:
    """The compacted nodes, from explicit points (owner, b, e1, e2, top) on the conversations that own them.

    Node (owner, b) is the first b turns of its owner, which has fingerprint (e1, e2); its edge begins after turn a, that of
    the owner's point before or ``top``, where the owner leaves the rest of the trie.  Its handle is the prefix
    of two-fattest length f in (a, b], with fingerprint (h1, h2).  (s1, s2) belongs to the first a + 1 turns, (u1, u2) to the first a.
    """
    chain = common.running(points, ["owner"], "b", {"a": (F.max, F.col("b"), F.greatest)}, own=False)
    chain = chain.withColumn("a", F.coalesce("a", "top")).withColumn("f", two_fattest("a", "b"))
    wanted = chain.select("*", F.explode(F.array_distinct(F.array("f", F.expr("a + 1")))).alias("d"))
    found = wanted.join(paths.select(F.col("c").alias("owner"), "d", "p1", "p2", "q1", "q2"), ["owner", "d"])
    pick = lambda where, column, name: F.max(F.when(F.expr(where), F.col(column))).alias(name)
    return found.groupBy("owner", "b", "e1", "e2", "top", "a", "f").agg(
        *[pick("d = f", f"p{k}", f"h{k}") for k in (1, 2)], *[pick("d = a + 1", f"p{k}", f"s{k}") for k in (1, 2)],
        *[pick("d = a + 1", f"q{k}", f"u{k}") for k in (1, 2)])


def grown(rows: DataFrame) -> DataFrame:
    """The points that prefixes outside the trie add: where one of them ends or more than one goes on."""
    nodes = rows.groupBy("d", "p1", "p2").agg(F.min("c").alias("owner"), F.max(F.expr("d = len")).alias("ends"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    nodes = reliable_checkpoint(nodes)
    kids = nodes.groupBy(F.expr("d - 1").alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("kids"))
    tops = nodes.groupBy("owner").agg((F.min("d") - 1).alias("top"))
    points = nodes.join(kids, ["d", "p1", "p2"], "left").where("ends OR kids > 1")
    return points.join(tops, "owner").select("owner", F.col("d").alias("b"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), "top")


def located(convs: DataFrame, paths: DataFrame, trie: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many turns of each conversation the trie holds (c, e), and the points inside its edges where they leave or end.

    Fat binary search: between ``lo`` turns, known to be a node, and ``hi``, the handle of two-fattest length is looked up.
    A node whose whole prefix the conversation has becomes ``lo``; one whose it has not is the exit node; without a node ``hi``
    falls below the length.  All conversations take a step together, so there are as many rounds as the longest has binary
    digits.  A conversation that stops at a node may leave inside an edge below it that has its handle further down.
    """
    at = paths.select("c", "d", "p1", "p2")
    by_handle = trie.select("owner", "top", "a", "b", "e1", "e2", "f", F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    active = convs.select("c", "len", F.lit(0).cast("long").alias("lo"), F.col("len").alias("hi"))
    stopped, exits = [active.where("lo >= hi")], []
    active = active.where("lo < hi")
    while True:
        step = active.withColumn("f", two_fattest("lo", "hi")).join(at.withColumnRenamed("d", "f"), ["c", "f"])
        step = step.join(by_handle, ["f", "p1", "p2"], "left").drop("p1", "p2")
        ends = at.select("c", F.col("d").alias("b"), F.col("p1").alias("v1"), F.col("p2").alias("v2"))
        step = step.join(ends, ["c", "b"], "left").withColumn("holds", F.coalesce(F.expr("v1 = e1 AND v2 = e2"), F.lit(False)))
        step = reliable_checkpoint(step.select("c", "len", "lo", "hi", "f", "owner", "top", "a", "b", "holds"))
        exits.append(step.where("b IS NOT NULL AND NOT holds").select("c", "owner", "top", "a", "b"))
        moved = step.where("b IS NULL OR holds").select("c", "len", F.expr("IF(holds, b, lo)").alias("lo"), F.expr("IF(holds, hi, f - 1)").alias("hi"))
        stopped.append(moved.where("lo >= hi"))
        active = moved.where("lo < hi")
        if active.isEmpty():
            break
    at_node = reduce(DataFrame.unionByName, stopped).where("lo < len").withColumn("d", F.col("lo") + 1).join(at, ["c", "d"])
    by_first = trie.select("owner", "top", "a", "b", F.expr("a + 1").alias("d"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    below = at_node.join(by_first, ["d", "p1", "p2"]).select("c", "owner", "top", "a", "b")
    on_edge = reduce(DataFrame.unionByName, [*exits, below])
    shared = at.join(on_edge, "c").where("d > a AND d <= b")
    shared = shared.join(at.withColumnRenamed("c", "owner"), ["owner", "d", "p1", "p2"])
    left = reliable_checkpoint(shared.groupBy("c", "owner", "top").agg(F.max(F.struct("d", "p1", "p2")).alias("at")))
    points = left.select("owner", F.col("at.d").alias("b"), F.col("at.p1").alias("e1"), F.col("at.p2").alias("e2"), "top").distinct()
    depths = reduce(DataFrame.unionByName, stopped).select("c", F.col("lo").alias("e")).join(left.select("c"), "c", "left_anti")
    return depths.unionByName(left.select("c", F.col("at.d").alias("e"))), points


def build(convs: DataFrame, paths: DataFrame, batches: int = 2, growth: int = 8) -> DataFrame:
    """The z-fast trie (:func:`handles`) of all conversations, inserted in batches of which each is ``growth`` times the trie so far.

    A batch is located in the trie, edges that its conversations leave or end in are split, and only what lies beyond
    is grouped to new nodes.
    """
    share = F.pmod(F.xxhash64("c"), F.lit(growth ** (batches - 1)))
    spark, trie = paths.sparkSession, None
    for k in range(batches):
        inside = share < 1 if k == 0 else (share >= growth ** (k - 1)) & (share < growth ** k)
        rows = paths.where(inside)
        if trie is None:
            points = grown(rows)
        else:
            depths, splits = located(convs.where(inside), paths, trie)
            points = grown(rows.join(depths, "c").where("d > e").drop("e")).unionByName(splits)
            points = points.unionByName(trie.select(points.columns))
        trie = reliable_checkpoint(handles(points, paths))
    return trie


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's lists of ids, which come in order, a part at a time."""
    key, state = None, hashlib.sha256()
    for rows in batches:
        done = []
        for owner, b, ids in zip(rows["owner"], rows["b"], rows["ids"], strict=True):
            if key == (owner, b):
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (owner, b), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["owner", "b", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["owner", "b", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """owner, b, ends_sha256 of (owner, b, c): the ids in order, joined by commas.

    Ids are ranked by ranges and joined in parts of 4,096; one task reads a node's parts in turn and keeps only the state of the hash.
    """
    parts = (common.ranked(ends, ["owner", "b"], [F.col("c")], "k", "n").groupBy("owner", "b", F.expr(f"k DIV {_CHUNK}").alias("part"))
             .agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids")))
    parts = parts.repartition("owner", "b").sortWithinPartitions("owner", "b", "part")
    return parts.mapInPandas(_hashed, "owner BIGINT, b BIGINT, ends_sha256 STRING")


def nodes(conversations: DataFrame, batches: int = 2, growth: int = 8) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations (:func:`rebuilt`), from the root, which has none.

    Turns are ordered by turn (null first), equal ones by their content; null roles and texts are empty.  Rows without a
    conv_id belong to no conversation and are left out.  Repeated rows are turns of their own.  Two
    prefixes are the same where 128-bit fingerprints are.  An empty table has no conversations and no nodes, not even
    a root.  Extra columns are not looked at.

    The trie (:func:`build`) has a node wherever a conversation ends or two part.  Each conversation meets the nodes on its way by their
    handles.  A node's edge is expanded along its smallest conversation, so each expanded node stands in one row of one
    conversation, and what a subtree sums is the sum over that row's conversation from there on and over
    all of the other conversations that pass.  Conversations of any length are summed in blocks of turns.

    Result: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns, convs = rebuilt(conversations)
    paths = reliable_checkpoint(prefixes(turns))
    trie = build(convs, paths, batches, growth)
    total = convs.agg(F.min("c").alias("first"), F.count("*").alias("n")).first()

    met = paths.select("c", "len", F.col("d").alias("f"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).join(
        trie.select("owner", "b", "f", "h1", "h2"), ["f", "h1", "h2"])
    met = reliable_checkpoint(met.select("c", "len", "owner", "b"))
    stats = met.groupBy("owner", "b").agg(F.min("c").alias("c"), F.count("*").alias("n"))
    kids = trie.groupBy(F.col("a").alias("b"), F.col("u1").alias("e1"), F.col("u2").alias("e2")).agg(F.count("*").alias("kids"))
    known = trie.join(stats, ["owner", "b"]).join(kids, ["b", "e1", "e2"], "left")
    known = reliable_checkpoint(known.select("owner", "a", "b", "c", "n", F.coalesce("kids", F.lit(0)).alias("kids"), "e1", "e2", "u1", "u2"))
    above = known.select(F.col("b").alias("a"), F.col("e1").alias("u1"), F.col("e2").alias("u2"), F.col("c").alias("parent"))
    known = known.join(above, ["a", "u1", "u2"], "left").withColumn("parent", F.coalesce("parent", F.lit(total["first"])))
    known = known.select("c", F.col("b").alias("d"), F.struct("b", "a", "owner", "n", "kids", "parent").alias("node"))

    rows = paths.select("c", "d", "bytes").join(known, ["c", "d"], "left")
    nearest = common.running(rows, ["c"], "d", {"node": (F.min, F.col("node"), F.least)}, back=True)
    expanded = nearest.where("d > node.a").select("c", "d", "bytes", "node.*")
    saved, leaf = F.expr("(n - 1) * bytes"), F.expr("IF(d = b AND kids = 0, 1L, 0L)")
    expanded = reliable_checkpoint(expanded.withColumn("saved", saved).withColumn("leaf", leaf).drop("bytes"))
    both = lambda before, own: F.coalesce(before, F.lit(0)) + own
    sums = common.running(expanded, ["c"], "d", {"saved_here": (F.sum, F.col("saved"), both), "leaves_here": (F.sum, F.col("leaf"), both)}, back=True)
    whole = reliable_checkpoint(expanded.groupBy("c").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves")))
    others = met.join(whole, "c").groupBy("owner", "b").agg(F.sum("all_saved").alias("saved_there"), F.sum("all_leaves").alias("leaves_there"))

    ended = met.where("len = b").select("owner", "b", "c")
    nowhere = convs.where("len = 0").select(F.lit(0).cast("long").alias("owner"), F.lit(0).cast("long").alias("b"), "c")
    ends = reliable_checkpoint(ends_digest(ended.unionByName(nowhere)))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = sums.join(whole, "c").join(others, ["owner", "b"]).join(ends.withColumn("d", F.col("b")), ["owner", "b", "d"], "left")
    found = found.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.expr("IF(d = a + 1, parent, c)").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.expr("IF(d = b, kids, 1L)").alias("n_children"), F.expr("leaves_here + leaves_there - all_leaves").alias("n_leaves"),
        F.expr("saved_here + saved_there - all_saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    if not total["n"]:
        return found
    # One row each, put together by an aggregate rather than a join without keys.
    parts = [whole.agg(F.sum("all_leaves").alias("n_leaves"), F.sum("all_saved").alias("saved_tokens")),
             trie.where("a = 0").agg(F.count("*").alias("n_children")), ends.where("b = 0").agg(F.max("ends_sha256").alias("ends_sha256"))]
    root = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).agg(
        F.coalesce(F.max("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.max("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.max("n_children").alias("n_children"), F.coalesce(F.max("ends_sha256"), none).alias("ends_sha256")).select(
        F.lit(total["first"]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total["n"]).alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return found.unionByName(root)
