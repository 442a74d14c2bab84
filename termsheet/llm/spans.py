"""Substring dedup by sliding sentence spans (operator 6)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint, work_folder

#: Sentences tile a text: each ends after its full stops, exclamation or question marks and line ends.
SENTENCE = r"[^.!?\n]+[.!?\n]*|[.!?\n]+"
_SENTENCE = re.compile(SENTENCE)


def runs(text: str | None, sentences: int, min_words: int) -> list[tuple[int, int, int, int]]:
    """(first, last, hash, hash) of the run that starts at each sentence with words: the shortest one with
    ``sentences`` sentences and ``min_words`` words; sentences without words are passed over."""
    parts = [(k, w) for k, s in enumerate(_SENTENCE.findall(text or "")) if (w := s.lower().encode("utf-8", "surrogatepass").split())]
    found = []
    end, held = 0, 0
    for start, (k, words) in enumerate(parts):
        while end < len(parts) and (end - start < sentences or held < min_words):
            held += len(parts[end][1])
            end += 1
        if end - start < sentences or held < min_words:
            break
        digest = xxhash.xxh3_128_intdigest(b"\n".join(b" ".join(w) for _, w in parts[start:end]))
        found.append((k, parts[end - 1][0], digest >> 64, digest & 0xFFFFFFFFFFFFFFFF))
        held -= len(words)
    return found


def span_table(docs: DataFrame, sentences: int, min_words: int) -> DataFrame:
    """id, digest, h1, h2, again for every different run of every row of ``docs`` (id, digest, text); ``again``
    tells whether the text holds it more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):              # few texts at once: their runs outnumber them
                part = batch.slice(at, 100)
                each = [Counter(r[2:] for r in runs(t, sentences, min_words)) for t in part.column("text").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
                rows = [(h1, h2, n > 1) for e in each for (h1, h2), n in e.items()]
                whole = lambda k: pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(of), part.column("digest").take(of), whole(0), whole(1), pa.array([r[2] for r in rows], pa.bool_())],
                    names=["id", "digest", "h1", "h2", "again"])

    return docs.select("id", "digest", "text").mapInArrow(run, "id BIGINT, digest BIGINT, h1 BIGINT, h2 BIGINT, again BOOLEAN")


def _remover(sentences: int, min_words: int):
    """A column function from a text, the hashes of its repeated runs, and whether it is a copy of a whole row before it, to what is kept
    and how many sentences went."""
    @F.pandas_udf("struct<kept:string,n_removed:int>")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, repeated, copies in batches:
            kept, removed = [], []
            for text, found, copy in zip(texts, repeated, copies, strict=True):
                if text is None:
                    kept.append(None)
                    removed.append(0)
                    continue
                gone = {} if found is None else {(r["h1"] % 2 ** 64, r["h2"] % 2 ** 64): r["first_too"] for r in found}
                out, seen, parts = set(), set(), _SENTENCE.findall(text)
                for first, last, *key in runs(text, sentences, min_words):
                    if copy or gone.get(tuple(key), False) or tuple(key) in gone and tuple(key) in seen:
                        out |= {k for k in range(first, last + 1) if parts[k].encode("utf-8", "surrogatepass").split()}
                    seen.add(tuple(key))
                kept.append("".join(p for k, p in enumerate(parts) if k not in out))
                removed.append(len(out))
            yield pd.DataFrame({"kept": kept, "n_removed": removed})

    return remove.asNondeterministic()


def dedup(docs: DataFrame, sentences: int = 2, min_words: int = 20) -> DataFrame:
    """doc_id, text, kept and n_removed: every text without the sentences of repeated spans.

    A span is a run of consecutive sentences: from every sentence on, the shortest run of at least
    ``sentences`` sentences and ``min_words`` words (short sentences alone repeat by chance).  Spans are
    equal if their lower-cased words are, sentence by sentence; 128-bit hashes stand for them.  Of equal
    spans the first stays: the first in the row with the smallest id.  Sentences with words that any
    other of them covers are removed, n_removed of them.

    Spans are hashed once and written.  Every row sends each of its spans' hashes once; a hash's first row is found by sums that start before
    the shuffle, and the join that brings it back can split a hot hash.  Lists are only of one row's
    spans.  Rows with a null id come after all others; rows that share an id are ordered by a hash of their text, and
    of rows equal in both any one is first and the others lose all of their spans.  Null texts count as
    empty and come back empty.  Extra columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("digest", F.xxhash64("text"))
    folder = work_folder(spark, "sentence-spans")
    span_table(rows, sentences, min_words).write.parquet(folder)
    table = spark.read.schema("id BIGINT, digest BIGINT, h1 BIGINT, h2 BIGINT, again BOOLEAN").parquet(folder)
    row = F.struct("id", "digest")
    # Written out, so that both sides of the join are plain shuffles, of which a hot one can be split.
    firsts = reliable_checkpoint(
        table.groupBy("h1", "h2").agg(F.min(row).alias("least"), F.max(row).alias("most"), F.max("again").alias("twice"))
        .where("least <> most OR twice").select("h1", "h2", "least"))
    repeated = table.join(firsts, ["h1", "h2"]).withColumn("first_too", row != F.col("least")).where("first_too OR again")
    covered = repeated.groupBy("id", "digest").agg(F.collect_list(F.struct("h1", "h2", "first_too")).alias("spans"))
    found = rows.join(covered, ["id", "digest"], "left")
    copy = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(0))) > 1
    found = found.withColumn("copy", copy)
    touched = F.when(F.col("spans").isNotNull() | F.col("copy"), F.col("text"))      # only these go to Python
    found = found.withColumn("r", _remover(sentences, min_words)(touched, "spans", "copy"))
    return found.select("doc_id", "text", F.coalesce("r.kept", "text").alias("kept"), F.coalesce("r.n_removed", F.lit(0)).alias("n_removed"))
