"""Language identification by a linear-chain conditional random field over words (operator 4)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsheet.llm import common

_LETTERS = re.compile(r"[^\W\d_]+")
#: Where long texts may be cut: signs that no word holds and that change no letter's lower case beside them.
_CUT = re.compile(r"[\s\d,;!?，。、！？]")
_MOST_WORDS, _MOST_LETTERS = 400_000, 16_000_000
_LONG_WORD = 4096
_WINDOW = 512
UNKNOWN = "und"


def _parts(word: str) -> list[str]:
    return "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in word).split()


def split(text: str | None) -> list[str]:
    """The lower-cased words of a text: runs of letters.

    Numbers that are written with signs of their own, such as fractions or circled digits, are no letters.
    """
    found = _LETTERS.findall((text or "").lower())
    return found if all(map(str.isalpha, found)) else [w for part in found for w in _parts(part)]


def pieces(text: str | None, size: int) -> Iterator[list[str]]:
    """The words of a text, in lists from about ``size`` characters each; together they are those of ``split``."""
    text, at = text or "", 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.end() if cut else len(text)
        yield split(text[at:end])
        at = end


def features(word: str) -> Iterator[str]:
    """Affixes of one to three letters, letter pairs and triples, and the word itself, for the lexicon."""
    edged = f"^{word}$"
    yield from (f"{word[:1]}-", f"{word[:2]}-", f"{word[:3]}-", f"-{word[-1:]}", f"-{word[-2:]}", f"-{word[-3:]}", edged)
    for size in (2, 3):
        yield from (edged[i:i + size] for i in range(len(edged) - size + 1))


@dataclass
class Crf:
    """Weights: of features (feature, language), of transitions, and of the languages at the start."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    _known: dict[str, int] = field(default_factory=dict)
    _scores: list[np.ndarray] = field(default_factory=list)
    _letters: int = 0

    def ids(self, word: str) -> list[int]:
        """The known features of a word; the first row of the weights stands for all others and stays zero."""
        get = self.index.get
        return [0, *(i for i in map(get, features(word)) if i)]

    def emissions(self, words: list[str]) -> np.ndarray:
        """The features' score of every word for every language; equal words are scored once.

        Scores are kept until the words kept are too many or too long; a very long word's features are counted first.
        """
        if len(self._known) > _MOST_WORDS or self._letters > _MOST_LETTERS:
            self._known.clear()
            self._scores.clear()
            self._letters = 0
        known = self._known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            ids = [self.ids(w) if len(w) <= _LONG_WORD else [0] for w in new]
            starts = np.cumsum([0, *map(len, ids[:-1])])
            found = np.add.reduceat(self.weights[np.array([i for part in ids for i in part])], starts, axis=0)
            for at, word in enumerate(new):
                if len(word) > _LONG_WORD:
                    counted = Counter(i for i in map(self.index.get, features(word)) if i)
                    found[at] = sum((n * self.weights[i].astype(float) for i, n in sorted(counted.items())), np.zeros(found.shape[1]))
            self._scores.append(found)
            self._letters += sum(map(len, new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._scores = [np.concatenate(self._scores)]
        return self._scores[0][np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def _laid(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Of runs of words laid end to end, sorted by falling length: each one's first row, how many have a word number t
    for every t, the factor of every word, and that of every move."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    active = [int(n) for n in np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")]
    return first, active, np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float64), np.exp(moves - moves.max())


def transfers(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For each run of words the matrix that turns the message entering its first word into that at its last."""
    first, active, local, step = _laid(emissions, lengths, moves)
    result = np.tile(np.eye(step.shape[0]), (len(lengths), 1, 1))
    for t, n in enumerate(active):
        onward = (result[:n] @ step if t else result[:n]) * local[first[:n] + t][:, None, :]
        result[:n] = onward / onward.sum((1, 2), keepdims=True)
    return result


def _borders(matrices: list[np.ndarray], step: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages entering every one of a row of runs, and those coming back to its last word, from the runs' matrices."""
    entering, leaving = [enter], [leave]
    for matrix in matrices[:-1]:
        message = entering[-1] @ matrix @ step
        entering.append(message / message.sum())
    for matrix in matrices[:0:-1]:
        message = step @ (matrix @ leaving[-1])
        leaving.append(message / message.sum())
    return np.array(entering), np.array(leaving[::-1])


def posteriors(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray,
               enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginal chance of every language at every word, and the expected moves between neighbours.

    Forward-backward over many texts at once: all first words, then all second words, and so on; texts are
    laid end to end in ``emissions`` and sorted by falling length.  Messages are scaled to sum to one.
    Where the runs are windows of longer texts, ``enter`` and ``leave`` hold the messages of the words around each.
    """
    first, active, local, step = _laid(emissions, lengths, moves)
    forward = np.empty_like(local)
    for t, n in enumerate(active):
        at = first[:n] + t
        message = (forward[at - 1] @ step if t else np.exp(start - start.max()) if enter is None else enter[:n]) * local[at]
        forward[at] = message / message.sum(1, keepdims=True)
    marginal, expected = np.empty_like(local), np.zeros_like(step)
    beta = np.ones((len(lengths), step.shape[0])) if leave is None else leave.copy()
    for t in range(len(active) - 1, -1, -1):
        n, longer = active[t], active[t + 1] if t + 1 < len(active) else 0
        at = first[:n] + t
        if longer:
            onward = local[at[:longer] + 1] * beta[:longer]
            pair = forward[at[:longer], :, None] * step * onward[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            back = onward @ step.T
            beta[:longer] = back / back.sum(1, keepdims=True)
        joint = forward[at] * beta[:n]
        marginal[at] = joint / joint.sum(1, keepdims=True)
    return marginal, expected


def _segments(docs: DataFrame, words: int, per_doc: int) -> DataFrame:
    """(lang, segment): up to ``per_doc`` runs of ``words`` words from places spread over every sampled text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found = split(text)
                places = sorted({int(x) for x in np.linspace(0, max(0, len(found) - words), per_doc)})
                rows += [(lang, " ".join(found[p:p + words])) for p in places if found]
            yield pd.DataFrame(rows, columns=["lang", "segment"])

    return docs.select("lang", "text").mapInPandas(run, "lang STRING, segment STRING")


def _sequences(rows: list[tuple[str, list[str]]], index: dict[str, int], rng: np.random.Generator) -> list[tuple[list[str], np.ndarray]]:
    """Code-switched texts: one to four segments, of any languages, in a row, with the language of each word."""
    order = rng.permutation(len(rows))
    result, at = [], 0
    while at < len(order):
        part = [rows[i] for i in order[at:at + int(rng.integers(1, 5))]]
        at += len(part)
        result.append(([w for _, ws in part for w in ws], np.concatenate([np.full(len(ws), index[lang]) for lang, ws in part])))
    return sorted(result, key=lambda r: -len(r[0]))


def fit(rows: list[tuple[str, list[str]]], epochs: int = 6, lexicon_size: int = 300, seed: int = 42, ridge: float = 1e-4) -> Crf:
    """A CRF fitted to (language, words) segments by the gradient of the conditional likelihood (Adagrad).

    Features that one word alone of the segments has are left out; of whole words the lexicon holds each
    language's ``lexicon_size`` most frequent ones.
    """
    rows = sorted(r for r in rows if r[1])
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    lexicon = {f"^{w}$" for one in languages for w, _ in sorted(
        Counter(w for lang, ws in rows if lang == one for w in ws).items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]}
    seen_in = Counter(f for w in {w for _, ws in rows for w in ws} for f in set(features(w)) if len(f) <= 4 or f in lexicon)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen_in.items() if n > 1 or f in lexicon), 1)}
    k = len(languages)
    crf = Crf(languages, index, np.zeros((1 + len(index), k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return crf
    cache = {w: crf.ids(w) for w in {w for _, ws in rows for w in ws}}
    square, move_square = np.full_like(crf.weights, 1e-3), np.full((k, k), 1e-3)
    for epoch in range(epochs):
        sequences = _sequences(rows, number, np.random.default_rng(seed + epoch))
        for at in range(0, len(sequences), 64):
            part = sequences[at:at + 64]
            gold = np.concatenate([y for _, y in part])
            lengths = np.array([len(ws) for ws, _ in part])
            ids = [cache[w] for ws, _ in part for w in ws]
            flat, of = np.array([f for fs in ids for f in fs]), np.repeat(np.arange(len(ids)), [len(fs) for fs in ids])
            scores = np.add.reduceat(crf.weights[flat], np.cumsum([0, *map(len, ids[:-1])]), axis=0)
            marginal, expected = posteriors(scores, lengths, crf.moves, crf.start)
            error = marginal
            error[np.arange(len(gold)), gold] -= 1
            touched, place = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(touched), k))
            np.add.at(grad, place, error[of])
            grad = grad / len(part) + ridge * crf.weights[touched]
            square[touched] += grad ** 2
            crf.weights[touched] -= 0.3 * grad / np.sqrt(square[touched])
            crf.weights[0] = 0
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths)[:-1]] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
            move = (expected - seen) / len(part) + ridge * crf.moves
            move_square += move ** 2
            crf.moves -= 0.3 * move / np.sqrt(move_square)
    return crf


def train(docs: DataFrame, texts_per_language: int = 500, words: int = 20, per_doc: int = 6) -> Crf:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2 and whose lang is not null.

    The sample is about ``texts_per_language`` texts of each language by a hash of the id, ``per_doc``
    segments of ``words`` words each; that and the number of languages bound what the driver holds.
    Every word of a text counts as of its language; rows of several languages in one text are made
    by laying segments end to end, which is what the transitions are learnt from.
    """
    rows = docs.where(F.col("lang").isNotNull() & (common.id_remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    shares = {r["lang"]: texts_per_language / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return fit([])
    chance = F.conv(F.substring(F.md5(F.concat(F.lit("crf:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2 ** 32
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    sample = _segments(rows.where(chance < share), words, per_doc)
    return fit([(r["lang"], r["segment"].split(" ")) for r in sample.collect()])


def label(text: str | None, crf: Crf) -> list[tuple[str, str, float]]:
    """(word, language, chance) for every word of a text."""
    words = split(text)
    if not words or not crf.languages:
        return []
    marginal, _ = posteriors(crf.emissions(words), np.array([len(words)]), crf.moves, crf.start)
    return [(w, crf.languages[i], float(m[i])) for w, m, i in zip(words, marginal, marginal.argmax(1), strict=True)]


def _windows(words: int) -> list[int]:
    """The lengths of the windows of a run of words."""
    return [_WINDOW] * (words // _WINDOW) + ([words % _WINDOW] if words % _WINDOW else [])


def _shares(runs: list[list[str]], crf: Crf, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """The sum of the chances of every language over the words of each run; no run is empty.

    Runs are cut into windows, which are worked on side by side: first each window's matrix, then the messages
    at the borders of windows, then forward-backward inside them.  The result is that of whole runs.
    """
    step, emissions = np.exp(crf.moves - crf.moves.max()), crf.emissions([w for run in runs for w in run])
    cut = [_windows(len(run)) for run in runs]
    lengths, of = np.array([n for part in cut for n in part]), np.repeat(np.arange(len(runs)), [len(part) for part in cut])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    if enter is None:
        enter = np.tile(np.exp(crf.start - crf.start.max()), (len(runs), 1))
    if leave is None:
        leave = np.ones((len(runs), len(step)))
    entering, leaving = enter[of], leave[of]

    def laid(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = which[np.argsort(-lengths[which], kind="stable")]
        return order, emissions[np.concatenate([np.arange(first[i], first[i] + lengths[i]) for i in order])]

    several = np.flatnonzero(np.array([len(part) for part in cut])[of] > 1)
    if len(several):
        order, rows = laid(several)
        matrices = np.empty((len(lengths), *step.shape))
        matrices[order] = transfers(rows, lengths[order], crf.moves)
        at = 0
        for run, part in enumerate(cut):
            if len(part) > 1:
                here = slice(at, at + len(part))
                entering[here], leaving[here] = _borders(list(matrices[here]), step, enter[run], leave[run])
            at += len(part)
    order, rows = laid(np.arange(len(lengths)))
    marginal, _ = posteriors(rows, lengths[order], crf.moves, crf.start, entering[order], leaving[order])
    sums = np.zeros((len(runs), len(step)))
    np.add.at(sums, of[order], np.add.reduceat(marginal, np.concatenate([[0], np.cumsum(lengths[order])[:-1]]), axis=0))
    return sums


def _matrix(words: list[str], crf: Crf) -> np.ndarray:
    """The matrix of a whole run of words, from those of its windows."""
    lengths, step = np.array(_windows(len(words))), np.exp(crf.moves - crf.moves.max())
    result = None
    for one in transfers(crf.emissions(words), lengths, crf.moves):
        result = one if result is None else result @ step @ one
        result = result / result.sum()
    return result


def _share_of_long(text: str, crf: Crf, size: int) -> tuple[np.ndarray, int]:
    """What ``_shares`` gives for one text, and its words, read piece by piece: once for the pieces' matrices, once for the chances."""
    matrices = [_matrix(words, crf) for words in pieces(text, size) if words]
    total, n = np.zeros(len(crf.languages)), 0
    if matrices:
        step = np.exp(crf.moves - crf.moves.max())
        entering, leaving = _borders(matrices, step, np.exp(crf.start - crf.start.max()), np.ones(len(step)))
        for at, words in enumerate(words for words in pieces(text, size) if words):
            total += _shares([words], crf, entering[at:at + 1], leaving[at:at + 1])[0]
            n += len(words)
    return total, n


def _judge(texts: list[str | None], crf: Crf, size: int) -> tuple[list[str], list[float]]:
    """The language that most words of each text belong to, by the sum of chances, and its share.

    Texts of over ``size`` characters are read in pieces of that size, all others together."""
    found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not crf.languages:
        return found, scores
    short = [(i, words) for i, t in enumerate(texts) if len(t or "") <= size and (words := split(t))]
    shares = [(i, share, len(words)) for (i, words), share in zip(short, _shares([words for _, words in short], crf), strict=True)] if short else []
    shares += [(i, *_share_of_long(t, crf, size)) for i, t in enumerate(texts) if len(t or "") > size]
    for i, share, n in shares:
        if n:
            found[i], scores[i] = crf.languages[int(share.argmax())], float(min(1.0, share.max() / n))
    return found, scores


def identify(docs: DataFrame, crf: Crf, group_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``: whole texts, labelled word by word.

    Forward-backward runs over groups of texts of about ``group_bytes`` together, longer texts in pieces of that size
    with the messages carried over, which bounds the memory to the text itself and the arrays of a piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            found, scores = _judge(texts, model, group_bytes)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size > group_bytes:
                    yield flush()
                    ids, texts, size = [], [], 0
        yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def classify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Language, source and id are no inputs of a prediction.  A text that is null or has no letter, or any text if
    no language can be learnt, is ``und`` with score 0.  Very long texts are read whole, in pieces.  Null ids count as empty text in ``held_out``; repeated
    rows are labelled alike; extra columns are not looked at; an empty table gives an empty result.
    """
    found = identify(docs, train(docs, **options))
    return found.select("doc_id", (common.id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
