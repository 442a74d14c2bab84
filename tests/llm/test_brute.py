"""Operators that SQL cannot express, against brute force, exact round trips or held-out labels."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from termsheet.llm import decontam, langid, mixture, queries, rules, simhash, spans, suffixes, tokens, toxicity

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# Decontamination

def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        score, end = decontam.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b)
        assert score == 0 or score == smith_waterman(a, b[:end])


def test_finds_copies_and_edited_copies_only(spark, docs):
    rng = random.Random(2)
    items = {i: words(rng, 30) for i in range(6)}
    texts, planted = [], set()
    for k in range(80):
        text = words(rng, 120)
        if k % 4 == 0:
            i = k // 4 % 6
            copy = list(items[i])
            if k % 8 == 0:
                for at in range(6, 30, 9):
                    copy[at] = "edited"                            # substitutions,
                copy.insert(15, "added")                           # an insertion
                del copy[20]                                       # and a deletion
            text[50:50] = [w.upper() + "," for w in copy]
            planted.add((k, i))
        texts.append((k, " ".join(text)))
    found = decontam.find(docs(texts), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id BIGINT, text STRING")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    brute = {(k, i): smith_waterman(w, t.lower().replace(",", "").split()) for k, t in texts for i, w in items.items()}
    assert {p for p, s in brute.items() if s >= 0.5 * 2 * 30} == planted
    assert all(r["score"] == brute[r["doc_id"], r["item_id"]] for r in found)
    assert all(49 <= r["start_word"] <= 51 and 78 <= r["end_word"] <= 82 for r in found)


@pytest.mark.parametrize("every", [4, 5, 6])
@pytest.mark.parametrize("exact_too", [False, True])
def test_finds_copies_with_every_few_words_changed(spark, docs, every, exact_too):
    rng = random.Random(every)
    items = {i: words(rng, 60, 4000) for i in range(4)}
    texts = []
    for i, item in items.items():
        copy = ["changed" if at % every == every - 1 else w for at, w in enumerate(item)]
        long = item[:30] + words(rng, 45, 4000) + item[30:]
        texts += [words(rng, 50) + c + words(rng, 50) for c in (copy, long, item[:25], *([item] * 3 if exact_too else []))]
    found = decontam.find(docs([(k, " ".join(t)) for k, t in enumerate(texts)]),
                          spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id BIGINT, text STRING")).collect()
    brute = {(k, i): smith_waterman(w, t) for k, t in enumerate(texts) for i, w in items.items()}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == {p: s for p, s in brute.items() if s >= 0.5 * 2 * 60}
    assert len(found) == (20 if exact_too else 8)


def test_common_phrases_cost_no_alignment(spark, docs):
    """Ten phrases in every item and every twelfth place of a text: they are no seeds, however many items there are."""
    rng = random.Random(13)
    phrases = [words(rng, 3, 100_000) for _ in range(10)]
    natural = lambda n: [w for _ in range(n // 3) for w in (rng.choice(phrases) if rng.random() < 0.25 else words(rng, 3, 200_000))]
    items = [(i, " ".join(natural(60))) for i in range(10_000)]
    rows = [(k, " ".join(natural(5000))) for k in range(20)]
    rows.append((99, " ".join([*natural(200), items[77][1], *natural(200)])))
    table, benchmark = docs(rows), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    started = time.time()
    found = decontam.find(table, benchmark).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in found] == [(99, 77, 1.0)]
    assert time.time() - started < 60


def test_items_with_the_same_phrases_are_still_found(spark, docs):
    """Forty items that differ in two words: none of their short n-grams is rare, so longer ones are seeds, or all of them."""
    rng = random.Random(14)
    frame = words(rng, 40, 5000)
    items = {i: [*frame[:20], f"x{i}", *frame[20:], f"y{i}"] for i in range(40)}
    items[40] = frame[:20]
    texts = [(i, " ".join([*words(rng, 30), *items[i], *words(rng, 30)])) for i in (3, 11, 40)]
    found = decontam.find(docs(texts), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id BIGINT, text STRING")).collect()
    scores = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert all(scores[k, k] == 1.0 for k in (3, 11, 40)) and scores[3, 40] == 1.0


def test_seeds_over_the_ends_of_chunks_and_repeats(spark, docs, monkeypatch):
    """Bands of a repeated phrase, copies across chunks, and a copy cut off at the start of its text."""
    rng = random.Random(15)
    items = {0: words(rng, 40, 3000), 1: ["again"] * 30 + words(rng, 10, 3000), 2: words(rng, 25, 3000)}
    monkeypatch.setattr(decontam, "_CHUNK", 16)
    texts = [words(rng, 50) + items[0] + words(rng, 50), ["again"] * 100 + words(rng, 20), items[0][12:] + words(rng, 60), words(rng, 90) + items[2][:20], items[1]]
    found = decontam.find(docs([(k, " ".join(t)) for k, t in enumerate(texts)]), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id BIGINT, text STRING")).collect()
    brute = {(k, i): smith_waterman(w, t) for k, t in enumerate(texts) for i, w in items.items()}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == {p: s for p, s in brute.items() if s >= 0.5 * 2 * len(items[p[1]])}


def test_gram_numbers(spark):
    rng = np.random.default_rng(5)
    words_ = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    words_[20:33] = words_[3:16]
    for n, found in zip((3, 5, 13, 50), decontam.grams(words_, (3, 5, 13, 50)), strict=True):
        assert len(found) == max(0, 40 - n + 1)
        same = {(i, j) for i in range(len(found)) for j in range(i) if found[i] == found[j]}
        assert same == {(i, j) for i in range(len(found)) for j in range(i) if (words_[i:i + n] == words_[j:j + n]).all()}
    assert [len(x) for x in decontam.grams(words_[:2], (3, 5))] == [0, 0]


def test_blocks_of_items_change_nothing(spark, docs):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(words(rng, 12))) for i in range(20)], "item_id BIGINT, text STRING")
    table = docs([(i, r["text"] + " and more words here") for i, r in enumerate(items.collect())])
    one = decontam.find(table, items).collect()
    assert Counter(one) == Counter(decontam.find(table, items, block_bytes=300).collect()) and len(one) >= 20


# Token counts

def test_counts_equal_the_library(spark, docs):
    rng = random.Random(4)
    strange = ["Ünïcödé", "漢字かな", "😀👍🏽", "it's", "don't", "<|endoftext|>", "x<|startoftext|>y", "é", "Σ", "a b", " ", "12345", "--!!", "\x1c", "İ"]
    texts = ["", "  \n", "hello world", " ".join(rng.choice(strange) for _ in range(300))]
    texts += ["".join(rng.choice([*strange, " ", "\n", "word", " the "]) for _ in range(3000)) for _ in range(6)]
    texts += ["abc" * 3000, "漢" * 4000, "x" * 1500 + " " + "y" * 2500]         # no white space in the overlaps
    counted = tokens.count_tokens(docs([(i, t) for i, t in enumerate(texts)]), PATH, chunk=700, overlap=16).collect()
    encode = Tokenizer.from_file(PATH)
    assert {r["doc_id"]: r["n_tokens"] for r in counted} == {i: len(encode.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_bytes"] for r in counted} == {i: len(t.encode()) for i, t in enumerate(texts)}


# Suffix dedup

def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    result = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        result.append((bytes(b for b, g in zip(d, gone, strict=True) if not g), len(re.findall(rb"\x01+", bytes(gone)))))
    return result


@pytest.mark.parametrize("hot", [100_000, 20, 1])
def test_removes_exactly_the_repeated_bytes(spark, docs, hot):
    rng = random.Random(5)
    text = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    passage, other = text(150), text(90)
    texts = [text(500) + passage + text(300), passage, text(99), other + text(200) + other, "ab" * 300, "a" * 700, "a" * 99 + "b",
             passage[20:] + text(50) + passage[:130], text(3000, "ab"), None, "", "é" * 200]
    texts += [texts[0], text(40) + passage[:101] + text(40), passage[:100], passage[1:101], "x" + passage[:99] + "y"]
    for k in range(40):
        texts.append(text(rng.randrange(60)) + passage[rng.randrange(30):rng.randrange(100, 150)] + text(rng.randrange(80)))
    found = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in suffixes.dedup(docs([(i, t) for i, t in enumerate(texts)]), 100, range_bytes=4000, hot=hot).collect()}
    assert [found[i] for i in range(len(texts))] == removed(texts, 100)


def test_long_texts_are_cut_into_segments(spark, docs, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef ") for _ in range(4000))
    whole = suffixes._groups([text.encode(), b"short", text[100:900].encode()], 100)
    monkeypatch.setattr(suffixes, "_SEGMENT", 700)
    cut = suffixes._groups([text.encode(), b"short", text[100:900].encode()], 100)

    def windows(groups):
        found = set()
        for held, offsets, data in groups:
            ends = np.cumsum([n for _, n in offsets])
            starts = ends - np.array([n for _, n in offsets])
            part, anchor, first, last, _ = suffixes.blocks(np.frombuffer(data, np.uint8), starts, ends, 100)
            for p, a, f, l in zip(part, anchor, first, last, strict=True):
                at = offsets[p][0] - starts[p]
                found |= {(held[p], int(w + at), int(a + at)) for w in range(f, l + 1)}
        return found

    assert windows(whole) == windows(cut)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, docs, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    short, long, other = text(60), text(67)[:400], text(67)[:399]   # 359, 400 and 399 bytes
    assert min(len(t.split()) for t in (short, long, other)) > 50
    texts = [f"{text(30)}{k}{t}{k}{text(30)}" for t in (short, long, other) for k in (1, 2)] + [text(200)]
    docs([(i, t) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [found[i]["n_bytes"] for i in range(7)] == [len(t) for t in texts]
    assert [(found[i]["n_removed"], found[i]["n_spans"]) for i in range(7)] == [(0, 0), (0, 0), (400, 1), (400, 1), (0, 0), (0, 0), (0, 0)]
    assert [found[i]["kept_sha256"] for i in range(7)] == [hashlib.sha256(t.replace(long, "").encode()).hexdigest() for t in texts]


def test_merge_orders_runs_and_knows_prefixes():
    rng = random.Random(7)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(40))}) for _ in range(k)]
        merged = list(suffixes.merge([suffixes.Run(*suffixes.front_code(r)) for r in runs]))
        strings = [s for *_, s in merged]
        assert strings == sorted(s for r in runs for s in r)
        assert [p for _, _, p, _ in merged][1:] == [suffixes.common_prefix(a, b) for a, b in zip(strings, strings[1:])]
        assert all(runs[r][n] == s for r, n, _, s in merged)


# Language

def test_held_out_languages(spark):
    df = queries.QUERIES["op4_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = df.where("held_out").collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def crf(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"), 100)


def test_code_switched_text_is_labelled_word_by_word(spark, crf):
    pick = {r["lang"]: langid.split(r["text"])[:25] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 2000 AND crc32(binary(string(doc_id))) % 4 = 2").collect()}
    mixed = [w for lang in sorted(pick) for w in pick[lang]]
    gold = [lang for lang in sorted(pick) for _ in pick[lang]]
    found = langid.label(" ".join(mixed), crf)
    assert np.mean([a == b for (_, a, _), b in zip(found, gold, strict=True)]) > 0.9
    assert sum(a != b for (_, a, _), (_, b, _) in zip(found, found[1:])) < 12


def test_forward_backward_equals_enumeration():
    import itertools
    rng = np.random.default_rng(8)
    lengths, k = np.array([4, 3, 1]), 3
    scores, moves, start = rng.normal(size=(8, k)).astype(np.float32), rng.normal(size=(k, k)), rng.normal(size=k)
    marginal, expected = langid.posteriors(scores, lengths, moves, start)
    want, pairs, at = np.zeros((8, k)), np.zeros((k, k)), 0
    for n in lengths:
        part, total, here = scores[at:at + n], 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = math.exp(start[path[0]] + sum(part[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                want[at + t, y] += p
            for a, b in zip(path, path[1:]):
                here[a, b] += p
        want[at:at + n] /= total
        pairs += here / total
        at += n
    assert np.allclose(marginal, want, atol=1e-5) and np.allclose(expected, pairs, atol=1e-5)


def _random_crf(rng, words, k=3):
    index = {f: i for i, f in enumerate(sorted({f for w in words for f in langid.features(w)}), 1)}
    weights = rng.normal(size=(1 + len(index), k)).astype(np.float32) * 0.3
    weights[0] = 0
    return langid.Crf([f"l{i}" for i in range(k)], index, weights, rng.normal(size=(k, k)) + 2 * np.eye(k), rng.normal(size=k))


def test_windows_of_a_text_give_what_the_whole_text_gives(monkeypatch):
    rng, source = np.random.default_rng(3), random.Random(3)
    vocabulary = ["".join(source.choice("abcdeé") for _ in range(source.randrange(1, 7))) for _ in range(200)]
    crf = _random_crf(rng, vocabulary)
    runs = [[source.choice(vocabulary) for _ in range(n)] for n in (1, 7, 8, 9, 40, 333)]
    whole = [langid.posteriors(crf.emissions(r), np.array([len(r)]), crf.moves, crf.start)[0].sum(0) for r in runs]
    monkeypatch.setattr(langid, "_WINDOW", 8)
    assert np.allclose(langid._shares(runs, crf), whole)
    for run, want in zip(runs, whole, strict=True):
        text = "".join(w + source.choice([" ", ", ", " 12 ", "! ", "\u3000"]) for w in run)
        for size in (1, 30, 5000):
            share, n = langid._share_of_long(text, crf, size)
            assert n == len(run) and np.allclose(share, want)
    texts = [" ".join(r) for r in runs] + [None, "", "12 -- 3"]
    for size in (1, 50, 10_000):
        found, scores = langid._judge(texts, crf, size)
        assert found == [f"l{int(w.argmax())}" for w in whole] + ["und"] * 3
        assert np.allclose(scores, [w.max() / len(r) for w, r in zip(whole, runs, strict=True)] + [0, 0, 0])


def test_pieces_hold_the_words_of_the_text():
    text = "ΟΔΟΣ ΣΑΣ'Α, ½cup² naïve\u3000漢字，かな。E\u0301te' l’Été\nİstanbul; x1y2 " * 3
    for size in (1, 2, 7, 40, 10_000):
        assert [w for part in langid.pieces(text, size) for w in part] == langid.split(text)
    assert list(langid.pieces(None, 5)) == list(langid.pieces("", 5)) == []


def test_very_long_words_score_like_others(monkeypatch):
    word = "abcab" * 50
    crf = _random_crf(np.random.default_rng(4), [word])
    want = crf.emissions([word])[0]
    monkeypatch.setattr(langid, "_LONG_WORD", 20)
    crf._known.clear(), crf._scores.clear()
    assert np.allclose(crf.emissions(["ab", word, "ab"])[1], want, atol=1e-3)


def test_very_long_texts_take_little_time_and_memory(spark, docs, crf):
    import resource
    import time
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'de' AND n_chars > 2000").limit(20).collect() for w in r["text"].split(" ")]
    text = " ".join(words)
    text = (text + " ") * (20_000_000 // len(text))
    before, started = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    found, scores = langid._judge([text, "a" * 5_000_000, None], crf, 1 << 20)
    assert found[0] == "de" and scores[0] > 0.9 and found[2] == "und"
    assert time.perf_counter() - started < 90 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


# SimHash

def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in (None, "", " \n", "One", "one two THREE", "ÄÖ é A b C d e f g", "a b c d " * 9):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    value = spark.createDataFrame([("a b c d",)], "t STRING").select(F.xxhash64("t")).first()[0]
    assert xxhash.xxh64_intdigest(b"a b c d", seed=42) == value % 2 ** 64


def groups(values, budget=4):
    values, parent = list(values), {v: v for v in values}
    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


@pytest.mark.parametrize("subtrie", [1 << 14, 8])
def test_links_connect_what_brute_force_connects(spark, subtrie):
    rng = random.Random(9)
    values = {0, 2 ** 64 - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):                      # chains: each a few bits from the one before
            values.add(v)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                v ^= 1 << b
    signed = [(v - 2 ** 64 if v >> 63 else v,) for v in values]
    table = spark.createDataFrame(signed, "fp BIGINT")
    from termsheet.llm.components import components
    found = {r["node"] % 2 ** 64: r["root"] % 2 ** 64 for r in components(simhash.links(table, 4, subtrie)).collect()}
    want = groups(values)
    mine, theirs = defaultdict(set), defaultdict(set)
    for v in values:
        mine[found.get(v, v)].add(v)
        theirs[want[v]].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_dense_groups_are_connected_without_all_pairs():
    rng = np.random.default_rng(12)
    center = rng.integers(0, 2 ** 64, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 2, replace=False).astype(np.uint64)) for _ in range(60_000)]
    values = np.unique(center ^ np.array(flips, np.uint64))
    many = np.unique(np.concatenate([values ^ np.uint64(1 << b) for b in range(0, 64, 8)]))
    forest = simhash._Forest(len(many))
    simhash.trie_links(many, forest, 0, (0, len(many)), (0, len(many)), 0, 4, 4)
    assert len(set(forest.parent.tolist())) == 1


def test_near_duplicate_query(spark):
    rows = queries.QUERIES["op5_simhash_trie"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    of = groups(set(prints.values()))
    least = defaultdict(lambda: 10 ** 9)
    for i, p in prints.items():
        least[of[p]] = min(least[of[p]], i)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", least[of[p]]) for i, p in prints.items()}


# Mixing

def source_sizes(spark, sizes):
    return spark.createDataFrame([(False, f"s{i:06}", s) for i, s in enumerate(sizes)], "none BOOLEAN, stratum STRING, size BIGINT")


def targets(spark, sizes):
    return [r["target"] for r in mixture.source_table(source_sizes(spark, sizes)).orderBy("source").collect()]


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Shares by weight, again and again among those that are below their cap."""
    result, left, open_ = [0.0] * len(sizes), float(sum(sizes)), [i for i, s in enumerate(sizes) if s]
    while open_:
        weight = sum(weights[i % 3] for i in open_)
        full = {i for i in open_ if left * weights[i % 3] / weight > cap * sizes[i]}
        for i in full or open_:
            result[i] = cap * sizes[i] if full else left * weights[i % 3] / weight
        if not full:
            break
        left -= sum(result[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return result


def test_targets_share_out_what_small_sources_cannot_give(spark):
    assert targets(spark, [100, 100, 100]) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    wanted = targets(spark, [10, 1000, 1000])
    assert wanted[0] == 30 and wanted[1] == pytest.approx(1980 * 2 / 3) and sum(wanted) == pytest.approx(2010)
    assert targets(spark, [0, 5]) == [0.0, 5.0] and targets(spark, []) == [] and targets(spark, [0, 0]) == [0.0, 0.0]
    rng = random.Random(3)
    for n in (7, 300):
        sizes = [int(rng.paretovariate(0.6)) * rng.choice([0, 1, 1, 5]) for _ in range(n)]
        assert targets(spark, sizes) == plain_targets(sizes)


def test_slots_are_spread_over_tasks(spark):
    """Fifty million of them: more than a hundred partitions, whatever adaptive execution makes of the few rows they come from."""
    sources = mixture.source_table(source_sizes(spark, [40_000_000, 2_000_000_000, 1_000_000, 1_159_000_000]))
    slots = mixture.slot_table(sources, 64, 64, 1)
    counts = [r["n"] for r in slots.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == pytest.approx(3_200_000_000 / 64, rel=0.001) and len(counts) > 100 and max(counts) < 3 * sum(counts) / len(counts)


def test_many_sources(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 400) for _ in range(100_000)]
    started = time.time()
    slots = mixture.slot_table(mixture.source_table(source_sizes(spark, sizes)), 64, 64, 1).groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert time.time() - started < 60 and len(slots) == 64
    totals = [r["n"] for r in slots]
    assert max(totals) - min(totals) <= 1


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            assert sorted(mixture.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert list(mixture.permuted(np.arange(99), np.full(99, 99), np.zeros(99))) != list(mixture.permuted(np.arange(99), np.full(99, 99), np.ones(99)))


def test_draws_meet_the_quotas():
    for quotas, shards in (([500, 30, 0, 7], 9), ([3], 8), ([1, 1, 1], 2)):
        counts = mixture.draw(quotas, shards, 1)
        assert counts.sum(0).tolist() == quotas and (counts >= 0).all() and np.ptp(counts.sum(1)) <= 1


def test_mix_follows_targets_and_texts(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixture.taken(table).collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by_source = {r["doc_id"]: r["source"] for r in table.collect()}
    total, wanted = Counter(), {}
    for r in rows:
        total[by_source[r["doc_id"]]] += r["taken"]
        wanted[by_source[r["doc_id"]]] = r["target"]
    assert all(abs(total[s] - wanted[s]) <= 0.01 * wanted[s] + 64 for s in wanted)
    assert sorted(map(tuple, mixture.taken(table.repartition(3)).collect())) == sorted(map(tuple, rows))
    mixed = Counter()
    for r in mixture.remix(table).select("doc_id", "text", "n_chars").collect():
        found = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        mixed[r["doc_id"]] += len(found)
        assert r["n_chars"] == len(r["text"])
        assert not Counter(found) - Counter(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]))
    assert mixed == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_quotas_meet_the_targets_to_the_word():
    for block in (4, 64):
        for seed in (0, 42):
            sizes = list(range(1, 201))
            wanted = [size * share for size in sizes for share in (0, 0.3, 1, 1.7, 2, 2.95, 3)]
            sizes = [size for size in sizes for _ in range(7)]
            for i, (size, w, (slots, last)) in enumerate(zip(sizes, wanted, mixture.quotas(sizes, wanted, block, seed), strict=True)):
                blocks = -(-size // block)
                at, n = np.arange(slots), np.full(slots, blocks)
                order = mixture.permuted(at % n, n, mixture._key(at // n, np.full(slots, i), seed))
                held = [min(block, size - block * b) for b in order.tolist()]
                assert not held or 0 < last and sum(held[:-1]) < round(w) <= 3 * size
                assert sum(held[:-1]) + min(last, *held[-1:], block) * bool(held) == round(w)


def test_small_sources_meet_their_targets(spark, docs):
    rows = [(1000 * size + k, " ".join(f"w{size}_{i}" for i in range(k, size, 3)), "en", f"s{size:03}")
            for size in range(1, 201) for k in range(3)]
    table = docs([*rows, (1, " ".join(f"big{i}" for i in range(40_000)), "en", "t")])
    source, total, target = {r["doc_id"]: r["source"] for r in table.collect()}, Counter(), {}
    for r in mixture.taken(table).collect():
        total[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(target) == 201 and all(abs(total[s] - target[s]) <= 0.5 for s in target)
    assert {"s001", "s010", "s130"} <= {s for s in target if s != "t" and target[s] == 3 * int(s[1:])}
    mixed = Counter()
    for r in mixture.remix(table).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert mixed == +total


# Quality rules

def test_exact_binomial_tail(spark):
    for n, k, p in ((1, 0, 0.5), (200, 3, 0.01), (5000, 30, 0.01), (40_000, 350, 0.01)):
        got = spark.range(1).select(rules.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(terms)
        assert got == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), rel=1e-9, abs=1e-9)


def test_measures(spark, docs):
    texts = ["a b c a b c a b c", "a a a a", "x y z\nx y z\n\n \nx y z #$ <|>", "one two three", "", None, "A B! C!! d\x0be\x1cf", "a b c d a b c e"]
    rows = {r["doc_id"]: r for r in rules.measures(docs([(i, t) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        held = {j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(held))
        assert tuple(rows[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, text


def test_few_good_texts_are_rejected_and_strata_differ(spark, docs):
    rng = random.Random(10)
    clean = lambda: " ".join(words(rng, 60, 5000))
    dirty = lambda: " ".join(f"{w}###" if rng.random() < 0.5 else w for w in words(rng, 60, 5000))
    rows = [(i, clean() if i % 10 else dirty(), "en" if i < 3000 else "xx") for i in range(3600)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0 or lang == "xx"), 0) for i, _, lang in rows], "doc_id BIGINT, quality INT, toxic INT")
    found = rules.risk_controlled(docs(rows), labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] == (i % 10 > 0) for i in range(3000))       # many labels: the rule holds
    assert all(kept[i] for i in range(3000, 3600))                 # here the dirty ones are labelled good


# Toxicity

def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    df = queries.QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = df.select("toxic", "predicted", "score").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.85
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.01


def test_vocabulary_counts_all_labelled_texts(spark, docs, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, 20, 300) + (["vile"] if i % 2 else []) + (["rarest"] if i % 40 == 1 else [])), "en", "a") for i in range(2400)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(2400)], "doc_id BIGINT, quality INT, toxic INT")
    fitted, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a: fitted.append(len(rows)) or fit(rows, *a))
    weights, _ = toxicity.train(docs(rows), labels, max_rows=300)
    assert weights["vile"] > 0 and weights["rarest"] > 0 and fitted == [300]


def test_penalty_closes_the_gap_between_groups(spark, docs):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(1200):
        toxic = i % 2
        group = ("muslim" if rng.random() < 0.9 else "christian") if toxic else ("christian" if rng.random() < 0.9 else "muslim")
        insult = " idiot" if toxic and rng.random() < 0.7 else ""
        rows.append((i, " ".join(words(rng, 12, 60)) + f". The {group} neighbour spoke{insult}."))
        marks.append((i, 1, toxic))
    labels = spark.createDataFrame(marks, "doc_id BIGINT, quality INT, toxic INT")
    probes = docs([(1, "a christian neighbour spoke"), (2, "a muslim neighbour spoke"), (3, "you idiot")])

    def scores(penalty):
        weights, offset = toxicity.train(docs(rows), labels, penalty=penalty)
        return [r["score"] for r in toxicity.score(probes, weights, offset).orderBy("doc_id").collect()]

    plain, fair = scores(0.0), scores(10.0)
    assert plain[1] - plain[0] > 0.4 and abs(fair[1] - fair[0]) < 0.1
    assert fair[2] > 0.5 and fair[1] < plain[1]


def loss(rows, weights, offset, size, penalty, ridge):
    total = sum(math.log1p(math.exp(-(2 * r["toxic"] - 1) * (offset + sum(weights[i] for i in r["ids"])))) for r in rows) / len(rows)
    swaps = [sum(weights[abs(i) - 1] * (1 if i > 0 else -1) for i in c) for r in rows for c in r["swaps"]]
    return total + ridge / size / 2 * sum(w * w for w in weights) + penalty * sum(s * s for s in swaps) / max(1, len(swaps))


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_fit_against_plain_gradient_descent(penalty):
    rng, size, ridge = random.Random(12), 6, 0.3
    rows = [{"toxic": int(rng.random() < (0.8 if 0 in ids else 0.3)), "ids": ids, "swaps": [[1, -2], [3, -1]] if 0 in ids else []}
            for ids in (sorted(rng.sample(range(size), rng.randrange(4))) for _ in range(60))]
    weights, offset, step = [0.0] * size, 0.0, 1e-4
    for _ in range(3000):
        here = loss(rows, weights, offset, size, penalty, ridge)
        slopes = [(loss(rows, [w + step * (i == k) for i, w in enumerate(weights)], offset, size, penalty, ridge) - here) / step for k in range(size)]
        slope = (loss(rows, weights, offset + step, size, penalty, ridge) - here) / step
        weights, offset = [w - 0.5 * s for w, s in zip(weights, slopes, strict=True)], offset - 0.5 * slope
        if max(map(abs, [*slopes, slope])) < 2e-4:
            break
    fitted, bias = toxicity.fit(rows, size, penalty, ridge)
    assert loss(rows, fitted, bias, size, penalty, ridge) == pytest.approx(loss(rows, weights, offset, size, penalty, ridge), abs=2e-3)
    assert np.allclose(fitted, weights, atol=0.1)


def test_scores_are_those_of_the_features(spark, docs):
    weights = {"vile": 2.0, "vilen-": 0.5, "kind": -1.0}
    texts = ["a vile text", "VILENESS is vile", "kind, kind kind", "", None]
    want = [2.0, 2.5, -1.0, 0.0, 0.0]
    for row, z in zip(toxicity.score(docs(list(enumerate(texts))), weights, -0.25).orderBy("doc_id").collect(), want, strict=True):
        assert row["score"] == pytest.approx(1 / (1 + math.exp(0.25 - z)))


# Sentence spans

def test_copies_under_one_id_or_none_lose_their_spans(spark, docs):
    text = "the first sentence has quite a number of words in it. the second one has rather more than ten words too."
    other = "something else that nobody repeats, with words enough to be a span of its own. and here goes one more of it all."
    rows = [(1, text), (1, text), (None, text), (None, text), (2, f"{other} {text}"), (0, other), (0, f"{text} more."), (3, other), (3, other)]
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["kept"]), r["n_removed"]) for r in spans.dedup(docs(rows)).collect())
    gone = [f for f in found if f[3]]
    assert len(found) == 9 and sum(f[2] > 0 for f in found) == 2 and len(gone) == 7        # the first of either text, with id 0
    alone = spans.dedup(docs([(7, text), (7, text), (None, other), (None, other)])).collect()
    assert sorted((r["doc_id"] is None, r["kept"] != "") for r in alone) == [(False, False), (False, True), (True, False), (True, True)]


# Letters

def test_signs_that_are_no_letters(spark, docs):
    assert langid.split("½ ² ① Ⅷ ⒈ ٣") == [] and langid.split("a² ½cup naïve") == ["a", "cup", "naïve"]
    table = docs([(i, f"the house of {w} and the garden", "en", "a") for i, w in enumerate("abcdefgh" * 4)] + [(100 + i, f"das haus von {w} und der garten", "de", "a") for i, w in enumerate("abcdefgh" * 4)]
                 + [(900, "½ ² ① Ⅷ", "en", "a")])
    assert [(r["lang_pred"], r["score"]) for r in langid.classify(table).where("doc_id = 900").collect()] == [("und", 0.0)]


# Pipeline

def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    start, harmless, distinct, unseen, mixed, dealt = ({r["doc_id"]: r for r in t.collect()} for t in tables)
    columns = tables[0].columns
    assert all(t.columns == columns for t in tables[:-1]) and tables[-1].columns == [*columns, "shard", "slot"]
    scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op10_toxicity"](spark, sf).collect()}
    assert set(harmless) == {i for i, p in scores.items() if not p}
    prints = {i: plain_fingerprint(r["text"]) for i, r in harmless.items()}
    of = groups(set(prints.values()))
    assert set(distinct) == {min(i for i, p in prints.items() if of[p] == g) for g in set(of.values())}
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {i for i, r in distinct.items() if any(f" {' '.join(w)} " in f" {' '.join(re.findall(chr(92) + 'w+', r['text'].lower()))} " for w in items)}
    assert set(distinct) - set(unseen) >= holds and len(set(distinct) - set(unseen) - holds) <= 2
    assert set(mixed) <= set(unseen) and len(mixed) > 0.7 * len(unseen)
    rows = tables[-1].collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in tables[-2].collect())
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    per_source = Counter((r["shard"], r["source"]) for r in rows)
    for source, n in Counter(r["source"] for r in rows).items():
        assert all(abs(per_source[s, source] - n / 24) < 2 for s in range(24))
    ran = corpus_pipeline.run(spark, sf)
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in ran.collect()) == Counter((r["doc_id"], r["text"], r["shard"]) for r in rows)


def test_sha_helper_matches_kept_bytes(spark):
    rows = queries.QUERIES["op3_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts)
    want = dict(zip(order, removed([texts[i] for i in order], 400), strict=True))
    for r in rows:
        kept, n = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(texts[r["doc_id"]].encode()), len(texts[r["doc_id"]].encode()) - len(kept), n, hashlib.sha256(kept).hexdigest())
