"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes (operator 3).

A string of ``length`` bytes that occurs twice has its copies cut up alike by *anchors*: positions whose
``GRAM``-byte hash is the least among all that start inside some window of ``length`` bytes.  A window
belongs to its least hash, the leftmost if equal, which depends on the window's bytes alone.  So equal windows have
equal anchors at equal distance, and it is enough to sort the suffixes that start at anchors: one in about 170
bytes.  A suffix whose first ``GRAM`` bytes occur once in the corpus cannot repeat and is not exchanged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint, work_folder

GRAM = 64
_SEGMENT = 1 << 19
_PLACE = (1 << 20) - 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 64, n, dtype=np.uint64)


_BYTES = _random(256, 1)
_ODD = _random(16, 2) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every position on, made of hashes of half as many bytes."""
    h, size, level = _BYTES[data], 1, 0
    while size < GRAM:
        h = h[:-size] * _ODD[level] + h[size:]
        h ^= h >> np.uint64(31)
        size, level = 2 * size, level + 1
    return h * _ODD[level]


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:len(keys) - (width - size)], keys[width - size:]) if width > size else keys


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, gram): the windows first..last of a text have that anchor.

    ``data`` holds texts end to end, at most 2**20 bytes; windows across two texts do not count.
    """
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    h = gram_hashes(data)
    keys = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_window_least(keys, length - GRAM + 1) & np.uint64(_PLACE)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for s, e in zip(starts, ends, strict=True):
        valid[max(s, e - length + 1):e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    own = anchor[at]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first, last = at[new], at[np.concatenate([new[1:], [True]])]
    gram = h[own[new]]                                            # the least hashes: mixed once more, to be spread evenly
    for k in (12, 13):
        gram = (gram ^ (gram >> np.uint64(32))) * _ODD[k]
    return np.searchsorted(starts, first, side="right") - 1, own[new], first, last, gram ^ (gram >> np.uint64(32))


def _groups(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts end to end in groups below the segment size; long texts in segments that overlap by length - 1."""
    held, offsets, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - length + 1), _SEGMENT):
            part = text[lo:lo + _SEGMENT + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > 2 * _SEGMENT - length:
                yield held, offsets, b"".join(parts)
                held, offsets, parts, size = [], [], [], 0
            held.append(i)
            offsets.append((lo, len(part)))
            parts.append(part)
            size += len(part)
    if held:
        yield held, offsets, b"".join(parts)


def block_table(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, tie, anchor, first, last, gram of every block of every row (doc_id, tie, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for held, offsets, data in _groups(texts, length):
                ends = np.cumsum([n for _, n in offsets])
                starts = ends - np.array([n for _, n in offsets])
                part, anchor, first, last, gram = blocks(np.frombuffer(data, np.uint8), starts, ends, length)
                shift = np.array([lo for lo, _ in offsets])[part] - starts[part]
                of = pa.array(np.array(held)[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(of), batch.column("tie").take(of), *(pa.array((x + shift).astype(np.int32)) for x in (anchor, first, last)),
                     pa.array(gram.view(np.int64))], names=["doc_id", "tie", "anchor", "first", "last", "gram"])

    return rows.select("doc_id", "tie", "text").mapInArrow(run, "doc_id BIGINT, tie BIGINT, anchor INT, first INT, last INT, gram BIGINT")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes; those are not looked at again."""
    n = min(len(a), len(b))
    differing = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differing.bit_length() + 7) // 8


def front_code(ordered: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(prefix shared with the string before, bytes beyond it, those bytes end to end)."""
    shared, tails, before = [], [], b""
    for s in ordered:
        k = common_prefix(before, s)
        shared.append(k)
        tails.append(s[k:])
        before = s
    return np.array(shared, np.int32), np.array([len(t) for t in tails], np.int32), b"".join(tails)


class Run:
    """A sorted, front-coded run, read one string after the other."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, tails: bytes):
        self.shared, self.sizes, self.tails = shared.tolist(), sizes.tolist(), tails
        self.next, self.offset, self.string, self.prefix = 0, 0, b"", 0

    def advance(self) -> bool:
        k = self.next
        if k == len(self.shared):
            self.string = None
            return False
        end = self.offset + self.sizes[k]
        self.prefix = self.shared[k]
        self.string = self.string[:self.prefix] + self.tails[self.offset:end]
        self.offset, self.next = end, k + 1
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, number in it, prefix shared with the string before, string) in sorted order, by a loser tree.

    Every waiting string knows how much it shares with the last winner that beat it.  Of two strings, the one that
    shares more comes first; only if both share the same are bytes compared, and only beyond that prefix.
    """
    runs = list(runs)
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    for r in runs:
        r.advance()
        r.prefix = 0
    strings = [r.string for r in runs] + [None] * (leaves - len(runs))
    prefix = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        sa, sb = strings[a], strings[b]
        if sb is None:
            return a, b
        if sa is None:
            return b, a
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        k = common_prefix(sa, sb, prefix[a])
        first = sa[k:k + 1] < sb[k:k + 1] or (len(sa) == k == len(sb) and a < b)
        winner, loser = (a, b) if first else (b, a)
        prefix[loser] = k
        return winner, loser

    losers = [0] * leaves
    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if leaves > 1 else 0
    while strings[best] is not None:
        run = runs[best]
        yield best, run.next - 1, prefix[best], strings[best]
        run.advance()
        strings[best], prefix[best] = run.string, run.prefix
        node = (leaves + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _key(text: bytes, anchor: int, first: int, last: int, gram: int, length: int) -> bytes:
    """What is sorted: hash of the gram, the bytes from the anchor on that its windows reach, those before it
    backwards, and the two lengths.  The hash first spreads the order evenly and keeps equal prefixes together."""
    right, left = text[anchor:last + length], text[first:anchor]
    return struct.pack(">q", gram) + right + left[::-1] + struct.pack(">HH", len(right), len(left))


_RUN = ("range BIGINT, shared BINARY, sizes BINARY, tails BINARY, counts BINARY, none BINARY, ids BINARY, ties BINARY, anchors BINARY")


def _sorted_runs(held: dict[bytes, list[tuple]], ranges: int) -> Iterator[dict]:
    """One run for every range of the order that has any of the strings."""
    ordered = sorted(held, key=lambda s: ((int.from_bytes(s[:8], "big") * ranges) >> 64, s))
    at = 0
    while at < len(ordered):
        number = (int.from_bytes(ordered[at][:8], "big") * ranges) >> 64
        end = at
        while end < len(ordered) and (int.from_bytes(ordered[end][:8], "big") * ranges) >> 64 == number:
            end += 1
        shared, sizes, tails = front_code(ordered[at:end])
        places = [p for s in ordered[at:end] for p in held[s]]
        column = lambda k, kind: np.array([p[k] for p in places], kind).tobytes()  # noqa: B023, E731
        yield {"range": number, "shared": shared.tobytes(), "sizes": sizes.tobytes(), "tails": zstandard.compress(tails, 3),
               "counts": np.array([len(held[s]) for s in ordered[at:end]], np.int32).tobytes(), "none": column(0, bool),
               "ids": column(1, np.int64), "ties": column(2, np.int64), "anchors": column(3, np.int32)}
        at = end


def run_table(found: DataFrame, ranges: int, length: int, run_bytes: int = 24 << 20) -> DataFrame:
    """Sorted front-coded runs of the blocks of every row (doc_id, tie, text, blocks); equal strings of a run
    are one string with several places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        flush = lambda: pa.RecordBatch.from_pylist(list(_sorted_runs(held, ranges)), schema)
        schema = pa.schema([("range", pa.int64())] + [(c.split()[0], pa.binary()) for c in _RUN.split(", ")[1:]])
        for batch in batches:
            for doc_id, tie, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text", "blocks")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for b in {(b["anchor"], b["first"], b["last"], b["gram"]) for b in parts if not b["hot"]}:
                    key = _key(data, *b, length)
                    places = held.setdefault(key, [])
                    places.append((doc_id is None, doc_id or 0, tie, b[0]))
                    size += len(key) + 200 if len(places) == 1 else 150
                if size > run_bytes:
                    yield flush()
                    held, size = {}, 0
        yield flush()

    return found.select("doc_id", "tie", "text", "blocks").mapInArrow(run, _RUN)


class _Resolver:
    """Turns sorted strings with their shared prefixes into repeated windows, some thousand strings at a time."""

    def __init__(self, length: int):
        self.length, self.reach = length, length - GRAM           # most bytes before an anchor
        self.left = _random(self.reach * 256, 3).reshape(self.reach, 256)

    def windows(self, strings: list[bytes], shared: list[int], counts: list[int]) -> np.ndarray:
        """(string, m): True where the window that starts m bytes before the anchor occurs elsewhere.

        Two windows with the same m are equal if their strings share ``length - m`` bytes from the anchor on, that is
        if none between them in the order shares less with its neighbour, and the m bytes before the anchor agree.
        """
        sizes = [struct.unpack(">HH", s[-4:]) for s in strings]
        right, left = np.array([r for r, _ in sizes]), np.array([l for _, l in sizes])
        before = np.frombuffer(b"".join(s[8 + r:8 + r + l].ljust(self.reach, b"\0") for s, (r, l) in zip(strings, sizes, strict=True)), np.uint8)
        before = before.reshape(len(strings), self.reach)
        neighbours = np.array(shared) - 8
        repeated = np.zeros((len(strings), self.reach + 1), bool)
        carried = np.zeros(len(strings), np.uint64)
        width = max(1, (1 << 20) // len(strings))
        for lo in range(0, self.reach + 1, width):
            m = np.arange(lo, min(lo + width, self.reach + 1))
            hashed = np.empty((len(strings), len(m)), np.uint64)
            for k, one in enumerate(m):
                if one:
                    carried = carried + self.left[one - 1][before[:, one - 1]]
                hashed[:, k] = carried
            classes = (neighbours[:, None] < self.length - m).cumsum(0).astype(np.uint64)
            inside = (m >= self.length - right[:, None]) & (m <= left[:, None])
            key = (hashed ^ (classes * _ODD[9])) + m.astype(np.uint64) * _ODD[10]
            key = (key ^ (key >> np.uint64(29))) * _ODD[11]
            key = key[inside]
            order = np.argsort(key)
            equal = key[order][1:] == key[order][:-1]
            flags = np.zeros(len(key), bool)
            flags[order[1:]] |= equal
            flags[order[:-1]] |= equal
            part = np.zeros(inside.shape, bool)
            part[inside] = flags
            part |= inside & (np.array(counts) > 1)[:, None]
            repeated[:, lo:lo + len(m)] = part
        return repeated


def _repeats(group: pd.DataFrame, length: int, most: int = 4096) -> Iterator[tuple]:
    """(none, id, tie, start, end) of repeated byte ranges, from all runs of a range."""
    resolver = _Resolver(length)
    load = lambda c, kind: [np.frombuffer(x, kind) for x in group[c]]
    runs = [Run(a, b, zstandard.decompress(t)) for a, b, t in zip(load("shared", np.int32), load("sizes", np.int32), group["tails"], strict=True)]
    counts = load("counts", np.int32)
    ends = [np.cumsum(c) for c in counts]
    places = list(zip(load("none", bool), load("ids", np.int64), load("ties", np.int64), load("anchors", np.int32), strict=True))
    strings: list[bytes] = []
    shared: list[int] = []
    where: list[list[tuple[int, int, int]]] = []
    group_start = 0

    def flush(end: int) -> Iterator[tuple]:
        alone = [s < 8 for s in shared[:end]]
        single = [alone[k] and (k + 1 == end or alone[k + 1]) and sum(hi - lo for _, lo, hi in where[k]) == 1 for k in range(end)]
        some = [k for k in range(end) if not single[k]]
        if some:
            # A string alone with its gram stands between two grams, so leaving it out joins none.
            flags = resolver.windows([strings[k] for k in some], [shared[k] for k in some], [sum(hi - lo for _, lo, hi in where[k]) for k in some])
            edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            rows, lows = np.nonzero(edge == 1)
            _, highs = np.nonzero(edge == -1)
            for row, lo_m, hi_m in zip(rows, lows, highs, strict=True):
                for run, lo, hi in where[some[row]]:
                    none, ids, ties, anchors = (x[lo:hi] for x in places[run])
                    yield none, ids, ties, anchors - (hi_m - 1), anchors - lo_m + length

    for run, number, prefix, string in merge(runs):
        lo, hi = int(ends[run][number] - counts[run][number]), int(ends[run][number])
        if strings and string == strings[-1]:
            where[-1].append((run, lo, hi))
            continue
        if prefix < 8:
            if len(strings) >= most:
                yield from flush(len(strings))
                strings, shared, where = [], [], []
        strings.append(string)
        shared.append(prefix)
        where.append([(run, lo, hi)])
    if strings:
        yield from flush(len(strings))


def repeat_table(runs: DataFrame, length: int) -> DataFrame:
    """none, doc_id, tie, start, end: byte ranges whose every window of ``length`` bytes occurs elsewhere."""
    names = ["none", "doc_id", "tie", "start", "end"]

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        found = list(_repeats(group, length))
        if not found:
            return pd.DataFrame({n: np.empty(0, bool if n == "none" else np.int64) for n in names})
        return pd.DataFrame({n: np.concatenate([f[k] for f in found]) for k, n in enumerate(names)})

    return runs.groupBy("range").applyInPandas(resolve, "none BOOLEAN, doc_id BIGINT, tie BIGINT, start INT, end INT")


def window_table(found: DataFrame, length: int) -> DataFrame:
    """none, doc_id, tie, start, end: the repeated windows of hot blocks, counted one by one by their hashes.

    Sums start before the shuffle and the join back can split a hot hash, so no task holds a hot gram.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, tie, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text", "blocks")), strict=True):
                hot = sorted({(b["first"], b["last"]) for b in parts if b["hot"]})
                if hot:
                    data = text.encode("utf-8", "surrogatepass")
                    starts = [p for first, last in hot for p in range(first, last + 1)]
                    digests = [xxhash.xxh3_128_intdigest(data[p:p + length]) for p in starts]
                    half = lambda shift: pa.array(np.array([d >> shift & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(starts), pa.int64()), pa.array([tie] * len(starts), pa.int64()), pa.array(starts, pa.int32()), half(64), half(0)],
                        names=["doc_id", "tie", "start", "h1", "h2"])

    windows = found.select("doc_id", "tie", "text", "blocks").mapInArrow(run, "doc_id BIGINT, tie BIGINT, start INT, h1 BIGINT, h2 BIGINT")
    often = reliable_checkpoint(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    return windows.join(often, ["h1", "h2"]).select(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "start", (F.col("start") + length).alias("end"))


def _cutter():
    """A column function from a text and its repeated ranges to the bytes kept and the maximal ranges removed."""
    @F.pandas_udf("struct<kept:binary,spans:array<struct<start:int,end:int>>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            kept, spans = [], []
            for text, found in zip(texts, ranges, strict=True):
                if text is None:
                    kept.append(None)
                    spans.append(None)
                    continue
                data, merged = text.encode("utf-8", "surrogatepass"), []
                for start, end in sorted((r["start"], r["end"]) for r in found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pd.DataFrame({"kept": kept, "spans": spans})

    return cut.asNondeterministic()


def dedup(docs: DataFrame, length: int = 400, range_bytes: int = 16 << 20, hot: int = 100_000) -> DataFrame:
    """doc_id, text, kept (binary) and spans (start, end in bytes): every text without repeated strings.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in another text or in the
    same one; matches never cross texts, and strings are judged on the whole input.  Suffixes at anchors (see the
    module) whose first 64 bytes occur more than once are sorted by every task into runs, front-coded, and sent to the
    range of the order that they belong to; a range merges its runs by a loser tree that never compares a
    known prefix again, and reads the repeated windows off the neighbours' shared prefixes.

    Equal strings of a run travel once.  Ranges are as many as the suffixes need at ``range_bytes`` each, so the memory
    of a task does not grow with the corpus.  All different suffixes with the same first 64 bytes meet in one
    range; where there are more than ``hot`` of them (a passage in very many different surroundings), their windows
    are counted one by one instead, by 128-bit hashes in plain sums and joins.  Null texts count as empty; texts shorter than ``length`` are kept; rows equal in id and text count as
    two texts, so both go; null ids are treated like others.  Extra columns are not looked at; an empty table
    gives an empty result.
    """
    if not GRAM < length < 1 << 15:
        raise ValueError(f"length must be above {GRAM} and below {1 << 15}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "tie"]
    on = ["_id", "_none", "tie"]
    folder = work_folder(spark, "suffix-blocks")
    block_table(rows, length).write.parquet(folder)
    table = spark.read.schema("doc_id BIGINT, tie BIGINT, anchor INT, first INT, last INT, gram BIGINT").parquet(folder)
    often = reliable_checkpoint(table.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    n, most = often.agg(F.coalesce(F.sum(F.when(F.col("n") <= hot, F.col("n"))), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    live = (table.join(often.select("gram", (F.col("n") > hot).alias("hot")), "gram").groupBy(*key)
            .agg(F.collect_list(F.struct("anchor", "first", "last", "gram", "hot")).alias("blocks")))
    keyed = rows.select("doc_id", "text", *key)
    found = keyed.join(live, on)
    repeats = repeat_table(run_table(found, max(1, -(-n * 600 // range_bytes)), length), length)
    if most > hot:
        repeats = repeats.unionByName(window_table(found, length))
    ranges = repeats.groupBy(F.col("doc_id").alias("_id"), F.col("none").alias("_none"), "tie").agg(
        F.collect_list(F.struct("start", "end")).alias("ranges"))
    found = keyed.join(ranges, on, "left")
    touched = F.when(F.col("ranges").isNotNull(), F.col("text"))  # only these go to Python
    found = found.withColumn("r", _cutter()(touched, "ranges"))
    return found.select("doc_id", "text", F.coalesce(F.col("r.kept"), F.col("text").cast("binary")).alias("kept"),
                        F.coalesce(F.col("r.spans"), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
