"""Toxicity classifier with a counterfactual penalty (operator 10)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common
from termsheet.session import reliable_checkpoint, work_folder

#: Words that name groups of people.  Words of one line can stand for each other.
IDENTITY_TERMS = [
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "black white asian african arab hispanic latino european indigenous",
    "gay lesbian bisexual transgender straight heterosexual homosexual queer",
    "women men girls boys", "woman man girl boy",
    "immigrants refugees foreigners natives", "disabled blind deaf autistic",
    "musulman chrétien juif hindou bouddhiste athée", "noirs blancs asiatiques arabes africains", "femmes hommes filles garçons",
    "muslime christen juden hindus atheisten", "schwarze weiße asiaten araber afrikaner", "frauen männer mädchen jungen",
    "musulmán cristiano judío hindú budista ateo", "negros blancos asiáticos árabes africanos", "mujeres hombres niñas niños",
]

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def tokens(text: str | None) -> set[str]:
    return set(_TOKEN.findall((text or "").lower()))


def features(text: str | None) -> set[str]:
    """The words of a text and their beginnings of five and six letters, which compounds and inflected forms share."""
    found = tokens(text)
    return found | {f"{w[:k]}-" for w in found for k in (5, 6) if len(w) > k}


def _partners() -> dict[str, list[str]]:
    return {w: [x for x in line.split() if x != w] for line in IDENTITY_TERMS for w in line.split()}


def word_statistics(labelled: DataFrame) -> DataFrame:
    """(word, n, n_toxic): labelled texts with the feature, and toxic ones among them, summed before they are shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):                  # sums of few texts, so memory stays small
                n, toxic = Counter(), Counter()
                part = batch.iloc[at:at + 200]
                for text, label in zip(part["text"], part["toxic"], strict=True):
                    found = features(text)
                    n.update(found)
                    if label:
                        toxic.update(found)
                yield pd.DataFrame({"word": list(n), "n": list(n.values()), "n_toxic": [toxic[w] for w in n]})

    counts = labelled.select("text", "toxic").mapInPandas(run, "word STRING, n BIGINT, n_toxic BIGINT")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def vocabulary(labelled: DataFrame, total: int, toxic: int, size: int = 4096, chi2: float = 20.0) -> list[str]:
    """The words most associated with the label, by chi-squared over all labelled texts, and all identity terms."""
    terms = sorted({w for line in IDENTITY_TERMS for w in line.split()})
    if not 0 < toxic < total:
        return terms
    a, n = F.col("n_toxic").cast("double"), F.col("n").cast("double")
    gap = a * total - n * toxic
    stat = gap * gap * total / (n * (total - n) * toxic * (total - toxic))
    top = (word_statistics(labelled).where((F.col("n") < total) & (F.col("n") >= 3)).withColumn("stat", stat)
           .where(F.col("stat") >= chi2).orderBy(F.desc("stat"), "word").limit(size).select("word").collect())
    return list(dict.fromkeys([*terms, *(r["word"] for r in top)]))


def _rows(labelled: DataFrame, words: list[str]) -> DataFrame:
    """(toxic, ids, swaps): the known features of a text, and for every sentence that names a group and every
    word that can stand in its place the features that come (id + 1) and go (-id - 1)."""
    index = {w: i for i, w in enumerate(words)}
    partners = _partners()

    def swapped(named: set[str], out: str, put: str) -> tuple[int, ...]:
        before, after = features(" ".join(named)), features(" ".join(named - {out} | {put}))
        return tuple(sorted([index[f] + 1 for f in after - before if f in index] + [-index[f] - 1 for f in before - after if f in index]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, swaps = [], []
            for text in batch["text"]:
                found = features(text)
                ids.append(sorted(index[w] for w in found if w in index))
                changes = set()
                if any(w in partners for w in found):
                    for sentence in _SENTENCE.findall((text or "").lower()):
                        named = tokens(sentence)
                        changes |= {swapped(named, w, x) for w in named for x in partners.get(w, ()) if x not in named}
                swaps.append([list(c) for c in sorted(changes) if c])
            yield pd.DataFrame({"toxic": batch["toxic"], "ids": ids, "swaps": swaps})

    return labelled.select("toxic", "text").mapInPandas(run, "toxic INT, ids ARRAY<INT>, swaps ARRAY<ARRAY<INT>>")


def fit(rows: list, size: int, penalty: float = 1.0, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression over word presence, by gradient steps with momentum.

    The counterfactual penalty is ``penalty`` times the mean, over labelled sentences with a group word
    swapped for another, of the squared change of the linear score.
    """
    y = np.array([r["toxic"] for r in rows], float)
    lengths = np.array([len(r["ids"]) for r in rows], int)
    ids = np.array([i for r in rows for i in r["ids"]], int)
    of = np.repeat(np.arange(len(rows)), lengths)
    changes = [c for r in rows for c in r["swaps"]]
    signed = np.array([i for c in changes for i in c], int)
    moved, sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    swap = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    offset = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))
    weights = np.zeros(size)
    if not 0 < y.sum() < len(y):
        return weights, offset
    square, speed, bias_square, bias_speed = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = offset + np.bincount(of, weights[ids], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(ids, error[of], size) + ridge * weights / size
        if changes:
            change = np.bincount(swap, sign * weights[moved], len(changes)) * (2 * penalty / len(changes))
            grad += np.bincount(moved, sign * change[swap], size)
        speed, square = 0.9 * speed + 0.1 * grad, 0.99 * square + 0.01 * grad ** 2
        weights -= 0.1 * (speed / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
        b = error.sum()
        bias_speed, bias_square = 0.9 * bias_speed + 0.1 * b, 0.99 * bias_square + 0.01 * b * b
        offset -= 0.1 * (bias_speed / (1 - 0.9 ** step)) / (np.sqrt(bias_square / (1 - 0.99 ** step)) + 1e-6)
    return weights, float(offset)


def train(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, max_rows: int = 20_000, size: int = 4096,
          filter_bits: int = 1 << 24) -> tuple[dict[str, float], float]:
    """Word weights and offset, learnt from labelled texts whose crc32(doc_id) mod 5 is not 0.

    The vocabulary is chosen by counts over all of these texts; the weights are fitted to a sample of at most
    ``max_rows`` of them, by the hash of the text, which with ``size`` bounds what the driver holds.  Ids with
    contradicting labels count as not toxic, as do texts; each distinct text counts once.  Labels meet hashes of
    texts; only labelled texts are moved, once, copies within a task as one: others are told by a bit filter of fixed size over the
    labelled ids, to which only ids' hashes go.
    """
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.min(F.col("toxic").cast("int")).alias("toxic")))
    learnt = reliable_checkpoint(known.where(common.id_remainder(F.col("doc_id"), 5) != 0))
    id_hash = lambda c: F.xxhash64(F.col(c).cast("long"))
    held = docs.sparkSession.sparkContext.broadcast(common.bit_filter(learnt.select(id_hash("doc_id").alias("h")), filter_bits))

    @F.arrow_udf("boolean")
    def may_be_known(hashes: pa.Array) -> pa.Array:
        return pa.array(common.in_filter(held.value, hashes.to_numpy(zero_copy_only=False)))

    hashed = docs.select("doc_id", common.text_or_empty().alias("text")).where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    by_text = hashed.select("doc_id", "h").join(learnt, "doc_id").groupBy("h").agg(F.min("toxic").alias("toxic"))
    near = hashed.withColumn("near", may_be_known.asNondeterministic()(id_hash("doc_id"))).where("near")
    folder = work_folder(docs.sparkSession, "toxicity-labelled")
    near.groupBy("h").agg(F.min("text").alias("text")).join(by_text, "h").write.parquet(folder)
    labelled = docs.sparkSession.read.schema("h BIGINT, text STRING, toxic INT").parquet(folder)
    total, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    words = vocabulary(labelled, total, toxic, size)
    sample = labelled
    if total > max_rows:
        sample = labelled.where(F.col("h") <= labelled.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0])
    rows = _rows(sample, words).collect()
    weights, offset = fit(sorted(rows, key=lambda r: (r["toxic"], r["ids"], r["swaps"])), len(words), penalty)
    return {w: float(x) for w, x in zip(words, weights, strict=True) if x}, offset


def score(docs: DataFrame, weights: dict[str, float], offset: float, name: str = "score") -> DataFrame:
    """Adds the toxicity score of every text; texts are scored whole, only they go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            z = np.array([offset + sum(sorted(known[w] for w in features(t) if w in known)) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return docs.withColumn(name, of.asNondeterministic()("text"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    Null texts count as empty and get the offset's score; a null id counts as empty text in ``held_out``
    and has no label.  Repeated rows are scored alike.  Without labels of both kinds every text gets the
    smoothed share of toxic labels (0.25 without any).  Extra columns are not looked at.
    """
    weights, offset = train(docs, labels, **options)
    scored = score(docs.select("doc_id", "text"), weights, offset)
    return scored.select("doc_id", (common.id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    weights, offset = train(docs, labels, **options)
    name = common.fresh(docs, "score")
    return score(docs, weights, offset, name).where(F.col(name) < 0.5).drop(name)
