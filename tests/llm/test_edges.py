"""Every operator and stage on odd rows, on an empty table, without labels or items, and run twice."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termsheet.llm import decontam, langid, merkle, mixture, pii, rules, shards, simhash, spans, suffixes, tokens, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id BIGINT, quality INT, toxic INT")


def _items(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id BIGINT, text STRING")


LABELS = [(4, 1, 0), (4, 0, 1), (None, 1, 1), (1, None, None), (6, 1, 0), (99, 1, 1), (7, 1, 1)]
ITEMS = [(1, None), (2, ""), (None, "the same row twice of a few words more"), (2, "two words"), (2, "the same row twice of a few words more")]

#: name, operator, whether it returns a row for each row
OPERATORS = {
    "decontaminate": (lambda s, d: decontam.find(d, _items(s, ITEMS)), False),
    "tokens": (lambda s, d: tokens.count_tokens(d, PATH, chunk=20_000), True),
    "suffixes": (lambda s, d: suffixes.dedup(d, 100), True),
    "language": (lambda s, d: langid.classify(d), True),
    "simhash": (lambda s, d: simhash.near_duplicates(d), True),
    "keep_one": (lambda s, d: simhash.keep_one(d), False),
    "spans": (lambda s, d: spans.dedup(d), True),
    "shards": (lambda s, d: shards.interleave(d, 3), True),
    "mixture": (lambda s, d: mixture.taken(d, block=4, shards=3), True),
    "remix": (lambda s, d: mixture.remix(d, block=4, shards=3), False),
    "rules": (lambda s, d: rules.risk_controlled(d, _labels(s, LABELS)), True),
    "pii": (lambda s, d: pii.find(d), True),
    "merkle": (lambda s, d: merkle.manifest(d), True),
    "toxicity": (lambda s, d: toxicity.classify(d, _labels(s, LABELS)), True),
    "keep_harmless": (lambda s, d: toxicity.keep_harmless(d, _labels(s, LABELS)), False),
    "keep_clean": (lambda s, d: decontam.keep_clean(d, _items(s, ITEMS)), False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    operator, every = OPERATORS[name]
    first = operator(spark, odd)
    one = Counter(map(repr, first.collect()))
    assert one == Counter(map(repr, operator(spark, odd.repartition(5)).collect()))
    if every:
        assert sum(one.values()) == odd.count()
        assert Counter(r["doc_id"] for r in first.select("doc_id").collect()) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name][0](spark, empty).collect() == []


def test_columns_survive_where_rows_are_kept(spark, odd):
    for name in ("keep_one", "remix", "keep_harmless", "keep_clean"):
        assert OPERATORS[name][0](spark, odd).columns == odd.columns
    dealt = OPERATORS["shards"][0](spark, odd)
    assert dealt.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]


def test_no_labels_and_no_items(spark, docs):
    table = docs([(1, "a b c d e f g", "en", "s"), (2, "a b c d e f h", None, None)])
    assert decontam.find(table, _items(spark)).collect() == []
    assert decontam.keep_clean(table, _items(spark)).count() == 2
    assert {r["score"] for r in toxicity.classify(table, _labels(spark)).collect()} == {0.25}
    assert [r["kept"] for r in rules.risk_controlled(table, _labels(spark)).collect()] == [False, False]
    only = table.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.classify(only).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, odd, empty, name, stage):
    sf = "/root/testdata/sf0.001"
    done = stage(spark, odd, sf)
    if (name, stage) != corpus_pipeline.STAGES[-1]:
        assert done.columns == odd.columns
    assert done.count() <= 3 * odd.count()
    assert stage(spark, empty, sf).count() == 0


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]


def _by_text(spark, odd, name, *columns):
    """Counter of (doc_id, ...) of an operator's rows."""
    return Counter(tuple(r) for r in OPERATORS[name][0](spark, odd).select("doc_id", *columns).collect())


def test_odd_rows_have_the_tokens_of_the_library(spark, odd, odd_rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in odd_rows)
    assert _by_text(spark, odd, "tokens", "n_bytes", "n_tokens") == want


def test_odd_rows_lose_the_repeated_bytes(spark, odd, odd_rows):
    texts = [(t or "").encode() for _, t, _ in odd_rows]
    seen = Counter(t[i:i + 100] for t in texts for i in range(len(t) - 99))
    want = Counter()
    for (doc_id, _, _), text in zip(odd_rows, texts, strict=True):
        kept, until = bytearray(), 0
        for i, byte in enumerate(text):
            if i + 100 <= len(text) and seen[text[i:i + 100]] > 1:
                until = i + 100
            if i >= until:
                kept.append(byte)
        want[doc_id, bytes(kept)] += 1
    found = OPERATORS["suffixes"][0](spark, odd).select("doc_id", F.col("kept").cast("binary").alias("kept")).collect()
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in found) == want


def test_odd_rows_without_letters_have_no_language(spark, odd, odd_rows):
    found = _by_text(spark, odd, "language", "lang_pred", "score")
    without = Counter((i, "und", 0.0) for i, t, _ in odd_rows if not any(c.isalpha() for c in t or ""))
    assert Counter({row: n for row, n in found.items() if row[1] == "und"}) == without
    assert all(0 < row[2] <= 1 for row in found if row[1] != "und")


def test_odd_rows_without_words_are_near_duplicates(spark, odd, odd_rows):
    found = OPERATORS["simhash"][0](spark, odd).collect()
    assert Counter(r["doc_id"] for r in found if r["fingerprint"] == "0" * 16) == Counter(i for i, t, _ in odd_rows if not (t or "").split())
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {1}
    assert len({r["component_id"] for r in found if r["doc_id"] in (6, 8)}) == 2


def test_odd_rows_in_shards_and_mixture(spark, odd, odd_rows):
    dealt = OPERATORS["shards"][0](spark, odd).select("shard", "slot").collect()
    sizes = Counter(r["shard"] for r in dealt)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2}
    assert {(r["shard"], r["slot"]) for r in dealt} == {(s, i) for s, n in sizes.items() for i in range(n)}
    mixed = OPERATORS["mixture"][0](spark, odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in mixed) == Counter((i, len((t or "").split())) for i, t, _ in odd_rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    assert sum(r["taken"] for r in mixed if r["doc_id"] == 6) > 0


def test_odd_rows_that_hold_items_and_rows_of_no_kind(spark, odd, odd_rows):
    assert {r["doc_id"] for r in OPERATORS["decontaminate"][0](spark, odd).select("doc_id").collect()} == {4}
    kept = Counter((r["doc_id"], r["text"]) for r in OPERATORS["keep_clean"][0](spark, odd).collect())
    assert kept == Counter((i, t) for i, t, _ in odd_rows if not (t or "").startswith("the same row"))
    assert all(not r["base"] and not r["added"] for r in OPERATORS["pii"][0](spark, odd).select("base", "added").collect())
    judged = _by_text(spark, odd, "rules", "n_words", "base_failed", "kept")
    assert Counter(row[:3] for row in judged.elements()) == Counter(
        (i, len((t or "").split()), len((t or "").split()) < 50) for i, t, _ in odd_rows)
    assert all(not kept for _, _, failed, kept in judged if failed)
    scores = OPERATORS["toxicity"][0](spark, odd).collect()
    empty = {r["score"] for r in scores if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and all(0 < r["score"] < 1 for r in scores)
