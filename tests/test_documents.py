"""Text windows, anchors and HTML tables against plain Python."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from termsheet import config
from termsheet.operators import documents, htmlrows


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts, self.hidden, self.run = [], 0, ""

    def _cut(self):
        if self.run.strip():
            self.parts.append(self.run.strip())
        self.run = ""

    def handle_starttag(self, tag, attrs):
        self._cut()
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self._cut()
        self.hidden -= tag in ("script", "style", "head")

    def handle_comment(self, data):
        self._cut()

    def handle_data(self, data):
        self.run += "" if self.hidden else data

    def handle_entityref(self, name):
        from html import unescape
        self.run += "" if self.hidden else unescape(f"&{name};")

    def handle_charref(self, name):
        from html import unescape
        self.run += "" if self.hidden else unescape(f"&#{name};")


def test_strip_html_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    own = ["<p>a&nbsp;b&#8212;c &#x1F600; &eacute; &bogus; &amp;lt;</p><br>x", "<div title='a > b'>t</div>", "a<!-- <b> -->b", "x < 3 & y",
           "<header>kept</header><script>var a='<p>';", "<STYLE>p{}</STYLE>q\n\n\n\n\nr"]
    df = pages.select("html").unionByName(spark.createDataFrame([(h,) for h in own], "html STRING"))
    for row in documents.plain_text(df).collect():
        parser = _Text()
        parser.feed(row["html"])
        parser.close()
        parser._cut()
        want = re.sub(r"\n{3,}", "\n\n", "\n".join(parser.parts))
        if "var a=" in row["html"]:
            want = "kept"
        assert row["text"] == want and row["char_count"] == len(want)


def _windows(text, words, lead=200, window=1500, cap=8000):
    spans = [(max(0, m.start() - lead), min(len(text), m.end() + window))
             for m in re.finditer("|".join(map(re.escape, words)), text, re.I)]
    merged = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, total = [], 0
    for s, e in merged:
        chunk = text[s:e].strip()
        if total >= cap:
            break
        out.append(chunk[:cap - total])
        total += len(out[-1])
    return "\n\n[...]\n\n".join(out)


def test_targeted_sections_against_interval_merge(spark):
    rng = random.Random(3)
    texts = ["", "BARRIER", "x" * 300 + "Barrier" + "y" * 1700 + "coupon" + "z" * 1701 + "trigger" + " " * 4000 + "autocall", "no hit here"]
    for _ in range(60):
        pieces = []
        for _ in range(rng.randint(0, 14)):
            pieces += [rng.choice("abc \n") * rng.choice([0, 3, 199, 200, 201, 1500, 1699, 1700, 1701, 2500]), rng.choice(["Coupon", "KNOCK-IN", "worst of"])]
        texts.append("".join(pieces) + "t" * rng.choice([0, 100, 1499, 1500, 1501]))
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = df.select("text", documents.targeted_sections(F.col("text")).alias("t")).collect()
    for row in got:
        assert row["t"] == _windows(row["text"], config.FEATURE_WORDS)


def test_key_terms_window(spark):
    df = spark.createDataFrame([(1, "x" * 500 + "Key Terms" + "y" * 50, None), (2, "ab KEY TERMS", None), (3, "nothing", None),
                                (4, "Summary then Key Terms", ["Summary"])], "i INT, text STRING, headings ARRAY<STRING>")
    got = {r["i"]: (r["window_text"], r["was_trimmed"]) for r in documents.key_terms_window(df, F.col("headings"), window=210).collect()}
    assert got[1] == ("x" * 200 + "Key Terms" + "y", True)
    assert got[2] == ("ab KEY TERMS", True) and got[3] == ("nothing", False) and got[4][1] is True


def test_section_slices(spark):
    text = "CUSIP " + "a" * 700 + " the issue-date x Maturity Date " + "b" * 20000
    df = spark.createDataFrame([("f", "index", text), ("g", "equityShare", "Guarantorship"), ("h", "legacy", text)], "filing_id STRING, model STRING, text STRING")
    got = {(r["filing_id"], r["section"]): r["slice"] for r in documents.section_slices(df).collect()}
    assert set(k for k in got if k[0] == "f") == {("f", "identifiers")} and got["f", "identifiers"] == text[:8000]
    assert got["g", "parties"] == ""                                      # whole words only
    assert len([k for k in got if k[0] == "h"]) == 7
    start = text.index("Maturity Date") - 500
    assert got["h", "product_generic"] == text[start:start + 15000]


@pytest.mark.parametrize("text,excerpt,want", [
    ("alpha beta gamma delta epsilon", "beta gamma delta epsi", (7, 21)),
    ("alpha beta\n  gamma delta epsilon", "beta gamma delta epsi", (7, 23)),
    ("x" * 10 + "abcdefghij" * 6 + "tail", "abcdefghij" * 6 + "DIFFERENT END OF IT", (11, 49)),
    ("short", "short", None), ("alpha", "not in there at all, no", None), (r"cost \Q a.b* \E (c) and more text here", r"\Q a.b* \E (c) and more", (6, 23))])
def test_excerpt_anchor(spark, text, excerpt, want):
    row = spark.createDataFrame([(text, excerpt)], "t STRING, e STRING").select(documents.anchor_excerpt(F.col("t"), F.col("e")).alias("a")).first()
    assert (tuple(row["a"]) if row["a"] else None) == want


def test_loose_anchor(spark):
    rows = [("ab\n\n  cd ef", "ab cd", (1, 8)), ("abcd", "abc", None), ("q" * 45 + "!", "q" * 42 + "zz", (1, 40))]
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(rows)], "i INT, t STRING, e STRING")
    got = {r["i"]: tuple(r["a"]) if r["a"] else None for r in df.select("i", documents.anchor_excerpt_loose(F.col("t"), F.col("e")).alias("a")).collect()}
    assert [got[i] for i in range(3)] == [w for _, _, w in rows]


def test_loose_anchor_in_texts_that_repeat_themselves(spark):
    """A regular expression tries every way through such a text; the steps find the same place as one does where it ends."""
    rng = random.Random(3)
    rows = [("# " * 20_000 + "z", "# " * 30 + "q", (1, 40)), ("# " * 3_000, "#  " * 40 + "#", (1, 401)), ("", " " * 6, (1, None)), ("a", " " * 6, (1, 1))]
    for _ in range(200):
        text = "".join(rng.choice("ab \n\tüx") for _ in range(rng.randrange(40)))
        excerpt = "".join(rng.choice("ab  ü") for _ in range(rng.randrange(5, 12)))
        at = text.find(excerpt)
        found = (at + 1, len(excerpt)) if at >= 0 else None
        if not found and (m := re.search(r"[\s\S]{0,10}".join(map(re.escape, re.split(r"\s+", excerpt))), text)):
            found = (m.start() + 1, len(m[0]) or None)
        rows.append((text, excerpt, found))
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(rows)], "i INT, t STRING, e STRING")
    got = {r["i"]: tuple(r["a"]) if r["a"] else None for r in df.select("i", documents.anchor_excerpt_loose(F.col("t"), F.col("e")).alias("a")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, _, w in rows]


def test_history_window_starts_with_user(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(13)] + [(2, 0, "user", "a")],
                                  "conv_id INT, turn INT, role STRING, text STRING")
    current = spark.createDataFrame([(1, "now"), (3, "first")], "conv_id INT, text STRING")
    got = {}
    for r in documents.history_window(turns, current).orderBy("conv_id", "pos").collect():
        got.setdefault(r["conv_id"], []).append(r["text"])
    assert got == {1: [str(i) for i in range(4, 13)] + ["now"], 2: ["a"], 3: ["first"]}


ROWS = "<tr><td>A</td><td>1</td></tr><tr><td>B<td>2"
TABLES = [
    ("th", f"<table><tr><th>Key Terms</th></tr>{ROWS}</table>", None, [("A", "1"), ("B", "2")]),
    ("caption", f"<table><caption>THE KEY TERMS</caption>{ROWS}</table>", None, [("A", "1"), ("B", "2")]),
    ("first row", f"<table><tr><td>Product Terms</td></tr>{ROWS}</table>", None, [("A", "1"), ("B", "2")]),
    ("paragraph before", f"<p>Key terms</p><p>x</p><table>{ROWS}</table>", None, [("A", "1"), ("B", "2")]),
    ("one ancestor up", f"<div><p>Key terms</p></div><table>{ROWS}</table>", None, [("A", "1"), ("B", "2")]),
    ("three ancestors up", f"<section><section><section><p>Key terms</p></section></section></section><table>{ROWS}</table>", None, [("A", "1"), ("B", "2")]),
    ("four ancestors up", f"<section><section><section><section><p>Key terms</p></section></section></section></section><table>{ROWS}</table>", None, []),
    ("inside a later cell", f"<table><tr><td>x</td></tr>{ROWS}</td></tr><tr><td>about key terms</td></tr></table>", None, [("A", "1"), ("B", "2")]),
    ("issuer heading first", f"<table><tr><th>Key Terms</th></tr><tr><td>n</td><td>9</td></tr></table><table><tr><th>Note Offering</th></tr>{ROWS}</table>", "NOTE Offering",
     [("A", "1"), ("B", "2")]),
    ("default order", f"<table><tr><th>Summary of Terms</th></tr><tr><td>n</td><td>9</td></tr></table><table><tr><th>Key Terms</th></tr>{ROWS}</table>", None,
     [("A", "1"), ("B", "2")]),
    ("nested", "<table><tr><th>Key Terms</th></tr><tr><td>A</td><td>x<table><tr><td>i</td><td>j</td></tr></table></td></tr></table>", None, [("A", "x i j"), ("i", "j")]),
    ("none", "<p>Key terms</p>", None, []), ("no html", None, None, []),
    ("header and empty rows", "<table><tr><th>Key Terms</th></tr><tr><td>Currency</td><td>USD</td></tr><tr><td>CUSIP</td><td>06749FWA3</td></tr>"
     "<tr><td>a</td><td> </td></tr><tr><td>only</td></tr><tr><td>Two words</td><td>USD</td><td>3rd</td></tr></table>", None,
     [("CUSIP", "06749FWA3"), ("Two words", "USD")]),
]


def test_key_terms_tables(spark):
    df = spark.createDataFrame([(n, h, i) for n, h, i, _ in TABLES], "name STRING, html STRING, heading STRING")
    rows = htmlrows.label_value_rows(htmlrows.key_terms_rows(df, F.col("heading"))).orderBy("name", "row_no").collect()
    for name, _, _, want in TABLES:
        assert [(r["label_raw"], r["value_raw"]) for r in rows if r["name"] == name] == want, name


def test_table_rows_stream_from_a_lateral_table_function(spark):
    row = "<tr><td>Term {}</td><td>{}</td></tr>"
    page = "<h2>Key Terms</h2><table>" + "".join(row.format(i, i) for i in range(5_000)) + "</table>"
    df = spark.createDataFrame([(1, page, "key"), (2, None, None), (3, "", "x"), (4, "<p>no table</p>", "Key Terms")], "id INT, html STRING, heading STRING")
    rows = htmlrows.key_terms_rows(df, F.concat(F.col("heading"), F.lit(" Terms"))).drop("heading")
    assert rows.columns == ["id", "row_no", "label_raw", "value_raw"]
    found = rows.orderBy("row_no").collect()
    assert [tuple(r) for r in found] == [(1, i, f"Term {i}", str(i)) for i in range(5_000)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange" not in plan and "Join" not in plan
