"""Base spans against plain regular expressions, and what contexts add."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termsheet.llm import common, pii

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


@given(st.text(alphabet="aZ.@-+%0123 ()é\n_", max_size=60))
@settings(max_examples=3000, deadline=None)
def test_base_spans_are_those_of_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@given(st.lists(st.sampled_from(["a@b.c", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1112", "+1 (017) 555-7713", "+", "-", " ", "é", "5", "a"]), max_size=14))
@settings(max_examples=2000, deadline=None)
def test_base_spans_that_touch(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain(text)
    base, slots = pii.Reader.slots(text)
    assert all(a[3] <= b[2] for a, b in zip(slots, slots[1:], strict=False))
    for kind, _, s, e in slots:
        assert (kind, s, e) in base if kind >= 0 else all(e <= x or s >= y for _, x, y in base)


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a.b" * 500_000, "1." * 500_000, "+1" + " " * 1_000_000, "@a." * 300_000, "1:" * 300_000, "( " * 500_000, "a@b" * 300_000):
        pii.Reader.slots(text)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def phone(k):
    return f"+1 ({100 + k}) 555-{1000 + 7 * k}"


def spans(docs, rows, **options):
    """Added spans by id, with their text."""
    texts = {r[0]: r[1] for r in rows}
    found = pii.find(docs(rows), **options).collect()
    return {r["doc_id"]: [(pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"]:s["stop"]]) for s in r["added"]] for r in found}


def test_contexts_discover_what_no_pattern_knows(docs):
    """Numbers after the words that come before phones are phones, first round; words that come before those, second round."""
    rows = [(k, f"{words(k, 9)} please call {phone(k)} {words(99 + k, 5)}") for k in range(8)]
    rows += [(20 + k, f"{words(20 + k, 9)} please call 555-30{k}0-{k}12 {words(50 + k, 4)}") for k in range(5)]
    rows += [(30 + k, f"{words(30 + k, 9)} telefon bitte 555-30{k}0-{k}12 {words(60 + k, 4)}") for k in range(5)]
    rows += [(40, f"{words(40, 9)} telefon bitte 777 88 99 66 {words(41, 3)}"), (41, f"the order 777 123 456 {words(3, 9)}"), (42, f"please call back {words(4, 9)}")]
    found = spans(docs, rows)
    for k in range(5):
        assert found[20 + k] == found[30 + k] == [("phone", f"555-30{k}0-{k}12")]
    assert found[40] == [("phone", "777 88 99 66")]
    assert found[41] == found[42] == [] and all(found[k] == [] for k in range(8))
    assert spans(docs, rows, rounds=1)[40] == []


def test_common_words_prove_nothing(docs):
    """The same words before other things make the pattern weak; copies of one phone are no support."""
    rows = [(k, f"please call {phone(k)} {words(k, 3)}") for k in range(8)] + [(50 + k, f"please call {words(60 + k, 2)}") for k in range(8)]
    rows += [(90, "please call 5550001234 soon")]
    assert spans(docs, rows)[90] == []
    copies = [(k, f"please call {phone(1)} soon") for k in range(30)] + [(90, "please call 5550001234 soon")]
    assert spans(docs, copies)[90] == []


def test_spelled_addresses_and_long_numbers(docs):
    rows = [(k, f"{words(k, 5)} write to me{k}@site{k}.example today") for k in range(6)] + [(10, "write to anna [at] post [dot] example today"), (11, "write to nobody today 1:2:3")]
    found = spans(docs, rows)
    assert found[10] == [("email", "anna [at] post [dot] example")] and found[11] == []


def test_a_small_filter_changes_nothing(docs):
    rows = [(k, f"{words(k, 40)} please call {phone(k)} {words(99 + k, 5)}") for k in range(8)] + [(9, "x please call 5550001234 soon")]
    assert spans(docs, rows, filter_bits=64) == spans(docs, rows)


def test_odd_rows(spark, odd):
    found = pii.find(odd)
    assert found.columns == ["doc_id", "base", "added"] and found.count() == odd.count()
    texts = {r["doc_id"]: [] for r in odd.select("doc_id").collect()}
    for r in odd.select("doc_id", "text").collect():
        texts[r["doc_id"]].append([tuple(s) for s in plain(r["text"] or "")])
    for r in found.collect():
        assert [tuple(s) for s in r["base"]] in texts[r["doc_id"]]


def test_empty_table(empty):
    assert pii.find(empty).collect() == []


@pytest.mark.parametrize("sf", ["0.01"])
def test_query_against_brute_force(spark, sf):
    from hashlib import sha256

    from termsheet.llm import queries
    folder = f"/root/testdata/sf{sf}"
    texts = {r["doc_id"]: r["text"] or "" for r in common.table(spark, folder, "documents").select("doc_id", "text").collect()}
    total = 0
    for r in queries.QUERIES["op11_pii"](spark, folder).collect():
        base = plain(texts[r["doc_id"]])
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert set(listed) <= set(r["spans"].split(",")) | {""}
        total += len(base)
    assert total > 50
