"""The conversation trie against prefixes counted in Python."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from termsheet.llm import common, trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode())
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return Counter(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
         sha256(",".join(str(c) for c in sorted(cs) if rebuilt[c] == p).encode()).hexdigest())
        for p, cs in members.items())


def check(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, trie.nodes(table, **options).collect())) == expected(rows)


def families(n, seed):
    """Conversations that share first turns of any number, some of them equal, some with missing bases."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * n), n):
        start = rng.randrange(4)
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, "user" if turn % 2 else "assistant", f"é{start} {turn}" if rng.random() < 0.9 else f"own {rng.randrange(5)}"))
    return rows


@pytest.mark.parametrize("batches,growth", [(1, 8), (2, 3), (3, 3)])
def test_shared_turns(spark, batches, growth):
    check(spark, families(60, batches), batches=batches, growth=growth)


def test_long_conversations_in_blocks(spark):
    """A conversation over several blocks of turns, and others that leave it far down."""
    long = [(0, t, "user", f"turn {t}") for t in range(9000)]
    rows = long + [(10, t, "user", f"turn {t}") for t in range(4100)] + [(20, t, "user", f"turn {t}" if t < 5000 else "else") for t in range(5003)]
    check(spark, rows, batches=2, growth=2)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, None, None), (1, None, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"),
            (2, 5, "", ""), (3, 1, "user", "x" * 100_000), (-3, 1, "user", "x"), (-4, 0, "user", "x"), (0, 0, "user", "x"), (7, 0, "us", "erx"),
            (8, 0, "user", "x"), (9, 3, "user", "漢"), (9, 1, "user", "x"), (11, 0, "user", "only"), (50, 0, "user", "x"), (55, 0, "user", "x")]
    check(spark, rows, batches=2, growth=2)
    table = spark.createDataFrame(rows, SCHEMA)
    clashing = table.withColumns({c: F.lit("?") for c in ("c", "d", "len", "at", "n", "owner", "b", "digest", "bytes", "depth")})
    assert Counter(map(tuple, trie.nodes(clashing).collect())) == expected(rows)


def test_equal_conversations_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK", 7)
    check(spark, [(5 * c, t, "user", f"hello {t}") for c in range(40) for t in range(2)] + [(3, 0, "user", "bye")])


def test_empty_table_and_no_turns(spark):
    assert trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    lonely = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 9 >= 1 and c % 5)
    check(spark, [(lonely, 0, "user", "lost, as there is no conversation to borrow from")])


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    got = spark.createDataFrame(pairs, "a BIGINT, b BIGINT").select("a", "b", trie.two_fattest("a", "b")).collect()
    for a, b, f in got:
        assert a < f <= b and f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_whole_table(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "conversations")
    rows = list(map(tuple, table.select("conv_id", "turn", "role", "text").collect()))
    assert Counter(map(tuple, trie.nodes(table).collect())) == expected(rows)
