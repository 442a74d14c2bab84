"""Token counts by overlap resynchronisation (operator 2)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint, work_folder

_SPACE = re.compile(common.SPACES)
_UNIT = "key STRING, unit INT, n INT, left_at ARRAY<BIGINT>, left_n ARRAY<INT>, right_at ARRAY<BIGINT>, right_n ARRAY<INT>, last BOOLEAN"
_MOST_BYTES = 16 << 20


@functools.cache
def tokenizer(path: str):
    """The file's tokenizer, read once by each worker rather than by each task, which would leave its memory in pieces."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pieces(text: str) -> list[bytes]:
    """The text between white space.  Tokens are of lower-cased text, but special strings are looked for before."""
    data = text.encode("utf-8", "surrogatepass")
    return data.split() if b"<|" in data else data.lower().split()


def _counter(path: str):
    """A column function from texts to token counts.

    White space separates tokens whatever stands around it, so a text's tokens are those of the pieces
    between; pieces equal but for the case of ASCII letters are encoded once in a task, as long as the memory
    of them stays small.
    """
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, known, held = tokenizer(path), {}, 0
        for texts in batches:
            split = [_pieces(t) for t in texts]
            new = list({w for ws in split for w in ws if w not in known})
            for at in range(0, len(new), 2000):
                part = new[at:at + 2000]
                known.update(zip(part, (len(e) for e in encode.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)), strict=True))
            yield pd.Series([sum(map(known.__getitem__, ws)) for ws in split], dtype=np.int64)
            held += sum(len(w) + 100 for w in new)                # a key and its place in the table
            if held > _MOST_BYTES:
                known.clear()
                held = 0

    return count


def _cut(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, unit, base, start, stop, size, piece: chunks of every text with ``overlap`` characters around them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                step = len(text) if overlap >= len(text) else chunk
                for unit, lo in enumerate(range(0, len(text), step)):
                    base, stop = max(0, lo - overlap), min(len(text), lo + step)
                    piece = text[base:min(len(text), stop + overlap)]
                    yield pd.DataFrame({"key": [key], "unit": [unit], "base": [base], "start": [lo], "stop": [stop], "size": [len(text)], "piece": [piece]})

    return huge.mapInPandas(run, "key STRING, unit INT, base BIGINT, start BIGINT, stop BIGINT, size BIGINT, piece STRING")


def _stable(piece: str, base: int, starts: np.ndarray, lo: int, hi: int, most: int = 16) -> tuple[list[int], list[int]]:
    """The first token starts after white space between lo and hi (exclusive), and how many tokens come before."""
    inside = np.flatnonzero((starts > max(lo - base, 0)) & (starts < hi - base))
    at, before = [], []
    for k in inside:
        s = int(starts[k])
        if _SPACE.match(piece[s - 1]) and (k == 0 or starts[k - 1] < s):
            at.append(base + s)
            before.append(int(k))
            if len(at) == most:
                break
    return at, before


def _encode(pieces: DataFrame, path: str, overlap: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                offsets = encode.encode(r.piece, add_special_tokens=False).offsets
                starts = np.array([o[0] for o in offsets], np.int64)
                left = _stable(r.piece, r.base, starts, r.start - overlap, r.start + overlap) if r.start else ([], [])
                right = _stable(r.piece, r.base, starts, r.stop - overlap, r.stop + overlap) if r.stop < r.size else ([], [])
                rows.append((r.key, r.unit, len(starts), *left, *right, r.stop == r.size))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _UNIT.split(", ")])

    return pieces.mapInPandas(run, _UNIT)


def _splice(units: DataFrame) -> DataFrame:
    """key, n_tokens and failed: neighbours are joined at their first common stable boundary."""
    a = units.select("key", "unit", "n", "right_at", "right_n", "last")
    b = units.select("key", (F.col("unit") - 1).alias("unit"), "left_at", "left_n")
    at = F.array_min(F.array_intersect("right_at", "left_at"))
    value = lambda n, places: F.element_at(F.col(n), F.array_position(F.col(places), F.col("at")).cast("int"))
    joined = a.join(b, ["key", "unit"], "left").withColumn("at", at)
    part = F.when(F.col("last"), F.col("n")).otherwise(value("right_n", "right_at") - value("left_n", "left_at"))
    return joined.groupBy("key").agg(F.sum(part.cast("long")).alias("n_tokens"), F.max(~F.col("last") & F.col("at").isNull()).alias("failed"))


def huge_counts(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key and n_tokens of every text of ``huge`` (key, text), which is longer than ``chunk`` characters.

    Chunks are spread over all tasks and encoded with offsets.  Neighbours overlap by ``overlap`` characters on either
    side of a cut.  A token start after white space is a stable boundary: neither what comes before nor
    after it can change the tokens beyond it; the first that both encodings have is where they are spliced.  Texts with a
    cut without one go into the next round, with overlaps eight times as wide; once as wide as the text, it is encoded whole.
    """
    done = None
    while True:
        # Written, as splicing takes every unit and its neighbour: else each would be encoded twice.
        units = reliable_checkpoint(_encode(_cut(huge, chunk, overlap).repartition("key", "unit"), path, overlap))
        counts = reliable_checkpoint(_splice(units))
        good = counts.where("NOT failed").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = counts.where("failed").select("key")
        if failed.isEmpty():
            return done
        huge, overlap = huge.join(failed, "key", "left_semi"), overlap * 8


def count_tokens(docs: DataFrame, path: str, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs`` (doc_id, text), as the tokenizer file at ``path`` counts.

    The file's library counts whole texts: special strings count as it takes them, no special tokens are
    added, nothing is cut off or padded.  The file must drop white space and case, and write special strings as <|...|>.  Texts of more than ``chunk`` characters, which only sit on one
    task otherwise, are encoded in overlapping chunks (:func:`huge_counts`), each distinct text once.   Null and empty texts have no tokens; repeated rows
    and null ids are counted like others; extra columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_text = F.length("text") > chunk
    short = rows.where(~long_text).withColumn("n_tokens", _counter(path).asNondeterministic()("text")).select("doc_id", "n_bytes", "n_tokens")
    keyed = rows.where(long_text).withColumn("key", F.sha2("text", 256))
    folder = work_folder(spark, "huge-texts")
    keyed.select("key", "text").dropDuplicates(["key"]).write.parquet(folder)
    huge = spark.read.schema("key STRING, text STRING").parquet(folder)
    return short.unionByName(keyed.select("doc_id", "n_bytes", "key").join(huge_counts(huge, path, chunk, overlap), "key").drop("key"))
