"""The manifest against a tree built in Python."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from termsheet.llm import common, merkle


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests, fanout):
    """The top, and for each digest its (left, right) siblings from the bottom up."""
    paths, own = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, path in enumerate(paths):
            start = own[i] // fanout * fanout
            path.append(("".join(digests[start:own[i]]), "".join(digests[own[i] + 1:start + fanout])))
            own[i] //= fanout
        digests = [H("".join(digests[k:k + fanout])) for k in range(0, len(digests), fanout)]
    return digests[0], paths


def expected(rows, fanout):
    langs = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        tampered = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            tampered = "".join(c.lower() if c.isascii() else c for c in text)
        langs[lang].append((doc_id, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, tampered, lang, source, n_chars)))
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(langs[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *tree([x[1] for x in leaves], fanout)))
    if not trees:
        return Counter()
    root, upper = tree([t[1] for t in trees], fanout)
    found = Counter()
    for (leaves, subroot, paths), above in zip(trees, upper, strict=True):
        for (doc_id, digest, folded), path in zip(leaves, paths, strict=True):
            for left, right in path + above:
                folded = H(left + folded + right)
            found[doc_id, digest, subroot, root, H("".join(a + b for a, b in path + above)), folded, folded == root] += 1
    return found


def made(spark, table, fanout):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(map(tuple, merkle.manifest(table, fanout).select(*columns).collect()))


@pytest.mark.parametrize("fanout", [2, 8])
def test_trees_of_all_sizes(spark, docs, fanout):
    """Languages of 1, 2, 8, 9, 64 and 65 rows, nine and more of them, null and empty ones, in two files."""
    sizes = {None: 65, "": 1, "de": 2, "en": 8, "es": 9, "fr": 64, "ß": 3, "漢": 1, "a": 1, "b": 17, "c": 1}
    rows = [(n * 1000 + i, f"Text {i} Ä", lang, "s" if i % 2 else None, i) for n, (lang, size) in enumerate(sizes.items()) for i in range(size)]
    assert made(spark, docs(rows), fanout) == expected(rows, fanout)


def test_one_row_is_its_own_root(spark, docs):
    rows = [(3, "Only", "en", "s", 4)]
    assert made(spark, docs(rows), 8) == expected(rows, 8)
    (row,) = merkle.manifest(docs(rows)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == [] and row["proof_sha256"] == H("")


def test_odd_rows(spark, odd):
    rows = list(map(tuple, odd.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    assert made(spark, odd, 3) == expected(rows, 3)


def test_only_changed_texts_fail(spark, docs):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = merkle.manifest(table).join(table.select("doc_id", "text"), "doc_id")
    changes = (common.id_remainder(F.col("doc_id"), 3) == 0) & F.col("text").rlike("[A-Z]")
    assert found.where(F.col("verified") == F.coalesce(changes, F.lit(False))).count() == 0
    assert found.where(~F.col("verified")).count() > 100


def test_parents_meet_their_children_by_intervals(spark, docs):
    """Ranks are gapless and follow the ids, equal rows and rows without ids included."""
    rows = [(i // 3 if i % 7 else None, "same", "en", None, i % 2) for i in range(100)]
    found = merkle.manifest(docs(rows)).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(100))
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert made(spark, docs(rows), 8) == expected(rows, 8)
