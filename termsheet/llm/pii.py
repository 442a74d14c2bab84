"""Personal data: patterns of four kinds, and identifiers found by the contexts that they share (operator 11)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: An address from its @ on; what stands before it is read backwards, so that no run of letters is tried at every place.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where its first run of digits does, so there is no need to try inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: What may be an identifier that no pattern knows, and the kinds that it may be of.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![0-9A-Za-z])")
_AT = re.compile(r"(?<![^\s<(\[\"'])[^\s@<>()\[\]\"',;]{1,64}@[^\s@<>()\[\]\"',;]{1,255}")
_SPELLED = re.compile(r"(?<!\S)[\w.%+-]{1,64} ?[\[(]at[\])] ?[\w-]{1,64}(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]{1,64}){1,8}")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

_CACHED_WORDS = 200_000
_LONGEST_CACHED = 64
_SPAN = "struct<kind:int,start:int,stop:int>"
_SEEN = f"struct<base:array<{_SPAN}>,slots:array<struct<kind:int,may_be:int,start:int,stop:int,instance:bigint,patterns:array<bigint>>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points: leftmost, not overlapping within a kind, failing matches dropped."""
    found = [(EMAIL, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            found.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((PHONE, *m.span()))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kinds that it may be of as bits, start, end) of strings shaped like identifiers."""
    found = []
    for m in _NUMBER.finditer(text):
        n = sum(map(str.isdigit, m.group())) if m.end() - m.start() >= 7 else 0
        if 7 <= n <= 19:
            found.append(((n <= 15) << PHONE | (n >= 13) << CARD, *m.span()))
    if "@" in text:
        found += [(1 << EMAIL, *m.span()) for m in _AT.finditer(text)]
    if "at]" in text or "at)" in text:
        found += [(1 << EMAIL, *m.span()) for m in _SPELLED.finditer(text)]
    if ":" in text:
        found += [(1 << IP, *m.span()) for m in _COLONS.finditer(text)]
    return found


class Reader:
    """Texts as rows of units: words, and each identifier or candidate as one slot."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def number(self, word: str) -> int:
        known = self.numbers.get(word)
        if known is None:
            known = xxhash.xxh64_intdigest(word)
            if len(word) <= _LONGEST_CACHED:
                if len(self.numbers) >= _CACHED_WORDS:
                    self.numbers.clear()
                self.numbers[word] = known
        return known

    @staticmethod
    def slots(text: str) -> tuple[list, list]:
        """The base spans, and the slots (kind or -1, may_be, start, end) in order: base spans, candidates that overlap none of
        them, and of spans that overlap the first."""
        base = base_spans(text)
        inside = sorted((s, e) for _, s, e in base)
        reach = np.maximum.accumulate([e for _, e in inside]) if inside else np.zeros(0, np.int64)
        spans = [(s, -e, k, 1 << k) for k, s, e in base]
        for bits, s, e in candidates(text):
            before = bisect_left(inside, (e, 0))                  # base spans that begin before the candidate ends
            if not before or reach[before - 1] <= s:
                spans.append((s, -e, -1, bits))
        chosen, free = [], 0
        for s, e, kind, bits in sorted(spans):
            if s >= free:
                chosen.append((kind, bits, s, -e))
                free = -e
        return base, chosen

    def units(self, text: str, slots: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all units, and which of them are the slots."""
        number, numbers, places, free = self.number, [], [], 0
        get = self.numbers.get
        for kind, bits, s, e in [*slots, (None, 0, len(text), len(text))]:
            numbers += [get(w) or number(w) for w in text[free:s].lower().split()]
            if kind is not None:
                places.append(len(numbers))
                numbers.append(kind + 1 if kind >= 0 else 8 + bits)
            free = e
        return np.array(numbers, np.uint64), np.array(places, np.int64)

    @staticmethod
    def patterns(units: np.ndarray) -> np.ndarray:
        """Three patterns around every unit: the two before, the one before, the ones before and after.  64-bit numbers."""
        edge = np.array([7], np.uint64)
        padded = np.concatenate([edge, edge, units, edge])
        a, b, c = padded[:-3], padded[1:-2], padded[3:]
        mix = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        one = mix(b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return np.stack([mix(one + a * np.uint64(0xD6E8FEB86659FD93)), one, mix(one ^ (c * np.uint64(0xA0761D6478BD642F)))], axis=1).view(np.int64)


def _surface(kind: int, bits: int, text: str) -> int:
    """An identifier's own number: its digits, or its letters in lower case."""
    numeric = bits & (1 << CARD | 1 << PHONE)
    plain = "".join(filter(str.isdigit, text)) if numeric else text.lower()
    return xxhash.xxh64_intdigest(f"{bool(numeric)}:{plain}") - (1 << 63)


def _seen(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Base spans and slots of each text, each slot with its patterns."""
    reader = Reader()
    for batch in texts:
        out = []
        for text in batch:
            base, slots = reader.slots(text)
            found = []
            if slots:
                units, places = reader.units(text, slots)
                around = reader.patterns(units)[places].tolist()
                found = [{"kind": k, "may_be": bits, "start": s, "stop": e, "instance": _surface(k, bits, text[s:e]), "patterns": p}
                         for (k, bits, s, e), p in zip(slots, around, strict=True)]
            out.append({"base": [{"kind": k, "start": s, "stop": e} for k, s, e in base], "slots": found})
        yield pd.DataFrame(out, columns=["base", "slots"])


def _counter(held):
    """A column function from texts to the patterns of all their units that a bit filter holds, with counts."""
    @F.pandas_udf("array<struct<pattern:bigint,n:bigint>>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, bits = Reader(), held.value
        mask = np.int64(len(bits) * 8 - 1)
        for texts in batches:
            out = []
            for text in texts:
                units, _ = reader.units(text, reader.slots(text)[1])
                around = reader.patterns(units).ravel() if len(units) else np.zeros(0, np.int64)
                at = around & mask
                known, n = np.unique(around[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0], return_counts=True)
                out.append([{"pattern": p, "n": c} for p, c in zip(known.tolist(), n.tolist(), strict=True)])
            yield pd.Series(out)

    return count


def _filter_bits(patterns: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits, of fixed size on the driver however many patterns there are; exact joins follow it."""
    at = F.expr(f"pattern & {bits - 1}L")
    words = patterns.select(at.alias("at")).groupBy(F.expr("at >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
    held = np.zeros(bits // 64, "<u8")
    rows = words.toPandas()
    held[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).view(np.uint64)
    return held.view(np.uint8)


def bootstrap(edges: DataFrame, totals: DataFrame, support: int, confidence: float, doubt: float, rounds: int) -> DataFrame:
    """Instances that contexts show to be of a kind: instance, kind, score.

    ``edges``: pattern, instance, kind (-1 where no base pattern knows it), may_be, n (places).  ``totals``: pattern, total
    (places of the pattern around any unit in all texts).  A pattern's confidence in a kind is the share of its places that instances of
    the kind fill, each by its score (base spans have 1); places of instances that may be of the kind but have no score yet
    count ``doubt``, all others 1, and one more is counted against it.  It is trusted from ``confidence`` on if ``support``
    different instances with a score stand in it.  An instance's score is that of a noisy or of the trusted patterns around
    it; it takes part in the next round.
    """
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    kinds = F.filter(F.array(*[F.lit(k) for k in range(len(KINDS))]), lambda k: F.col("may_be").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0)
    unknown = edges.where("kind < 0").join(seeds.select("instance").distinct(), "instance", "left_anti").select("pattern", "instance", "n", F.explode(kinds).alias("kind"))
    unknown = reliable_checkpoint(unknown)
    open_places = unknown.groupBy("pattern", "kind").agg(F.sum("n").alias("open"))
    found = None
    for _ in range(rounds):
        scores = seeds.withColumn("new", F.lit(0))
        if found is not None:
            scores = scores.unionByName(found.withColumn("new", F.lit(1)))
        held = edges.select("pattern", "instance", "n").join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("mass"), F.sum(F.col("n") * F.col("new")).alias("closed"), F.count_distinct("instance").alias("instances"))
        held = held.where(F.col("instances") >= support).join(totals, "pattern").join(open_places, ["pattern", "kind"], "left")
        against = F.lit(1) + F.col("total") - F.lit(1 - doubt) * (F.coalesce("open", F.lit(0)) - F.col("closed"))
        trusted = held.withColumn("trust", F.round(F.col("mass") / against, 9)).where(F.col("trust") >= confidence).select("pattern", "kind", "trust")
        scored = unknown.join(trusted, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("kind")).alias("kind"))).alias("best"))
        found = reliable_checkpoint(best.select("instance", (-F.col("best.kind")).alias("kind"), "best.score"))
        if found.isEmpty():
            break
    return found


def find(docs: DataFrame, support: int = 3, confidence: float = 0.6, doubt: float = 0.5, rounds: int = 3, filter_bits: int = 1 << 24) -> DataFrame:
    """Personal data in every row: doc_id, base and added (arrays of kind, start, stop in code points, stop exclusive).

    ``base`` are the spans of the four patterns (:func:`base_spans`), by kind, then place.  Every base span, and every string shaped like an
    identifier (:func:`candidates`) that overlaps none, is a slot in a row of lower-cased words.  Its lexical patterns are the two words
    before, the word before, and the words before and after.  Patterns and the strings in their slots form a graph, which
    :func:`bootstrap` scores from the base spans on; strings that it trusts are ``added`` wherever they stand, copies included.

    Texts are read twice where they lie: once for slots, and once to count at how many places of all texts the patterns of
    at least ``support`` different strings stand.  For this a bit filter of fixed size goes to the tasks.  Only slots and counts move.
    Words, patterns and strings are told apart by 64-bit hashes.

    Null and empty texts have no spans; rows without ids, repeated rows and repeated ids are rows of their own; an empty
    table gives no rows.  Copies of a text add places but no support.  Extra columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", common.text_or_empty().alias("text"))
    seen = F.pandas_udf(_seen, _SEEN).asNondeterministic()
    rows = texts.select("doc_id", seen("text").alias("seen")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "seen.*")
    rows = reliable_checkpoint(rows)
    slots = rows.select("row", F.explode("slots").alias("slot")).select("row", "slot.*")
    edges = slots.select("kind", "may_be", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind", "may_be").agg(F.count("*").alias("n"))
    edges = reliable_checkpoint(edges)
    strong = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("strings")).where(F.col("strings") >= support).select("pattern")
    strong = reliable_checkpoint(strong)
    count = _counter(spark.sparkContext.broadcast(_filter_bits(strong, filter_bits))).asNondeterministic()
    totals = texts.select(F.explode(count("text")).alias("c")).groupBy("c.pattern").agg(F.sum("c.n").alias("total"))
    totals = reliable_checkpoint(totals.join(strong, "pattern", "left_semi"))
    known = bootstrap(edges.join(strong, "pattern", "left_semi"), totals, support, confidence, doubt, rounds)
    new = slots.where("kind < 0").select("row", "instance", "start", "stop").join(known.select("instance", "kind"), "instance")
    added = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
