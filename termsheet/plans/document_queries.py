"""Text windows, excerpt anchors, conversation history, HTML tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet import config
from termsheet.functions.excerpts import anchor_excerpts
from termsheet.operators import documents as ops, extract, htmlrows, labels
from termsheet.plans import domain
from termsheet.plans.domain import table
from termsheet.plans.label_queries import d_norm, d_strip, q
from termsheet.plans.registry import query

# Words, headers and anchors that occur in the synthetic documents.
WORDS = ["ththre", "HAND", "under", "lyst", "of thre", "whan"]
SECTIONS = {
    "identifiers": {"schema_keys": ["identifiers"], "search_headers": ["CUSIP"], "max_chars": 800},
    "coupon": {"schema_keys": ["coupon"], "search_headers": ["WHAN", "ther", "Under", "tion"], "max_chars": 1000},
    "parties": {"schema_keys": ["parties"], "search_headers": ["HAND", "ties", "of the"], "max_chars": 2000},
    "autocall": {"schema_keys": ["autocall"], "search_headers": ["no such header"], "max_chars": 500},
}
ANCHORS = ["Thth", "Er the", "Ha th", "KEY TERMS"]

_MARKUP = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
           r"|<head\b.*?</head\s*>|</?[a-z](?:[^''\">]|\"[^\"]*\"|''[^'']*'')*>|<[!?][^>]*>")
domain.CHECK_TABLES["page_texts"] = f"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '{_MARKUP}', chr(1), 'g'), chr(1)),
  lambda t: {d_strip("replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')")}),
  lambda t: t <> ''), chr(10)) AS text FROM {{pages}}"""


@query("h1_strip_to_text", """
SELECT page_id, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS text, length(text)::int AS char_count FROM {page_texts}""")
def h1(spark, sf):
    return ops.plain_text(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "text", "char_count")


@query("h4_cover_window", "SELECT doc_id, substr(text, 1, 4000) AS cover FROM {documents}")
def h4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.cover(F.col("text")).alias("cover"))


_DOC_ISSUER = "CASE doc_id % 3 WHEN 0 THEN 'The ' || lang WHEN 1 THEN 'Of th' ELSE NULL END"
_pos = " , ".join(f"nullif(strpos(text, {q(a)}), 0)" for a in ANCHORS)


@query("h5_key_terms_window", f"""
WITH p AS (SELECT doc_id, text, least(nullif(strpos(text, {_DOC_ISSUER}), 0), {_pos}) AS pos FROM {{documents}})
SELECT doc_id, substr(text, coalesce(greatest(pos - 200, 1), 1), 3000) AS window_text, pos IS NOT NULL AS was_trimmed FROM p""")
def h5(spark, sf):
    docs = table(spark, sf, "documents").withColumn("heading", F.expr(_DOC_ISSUER))
    headings = F.when(F.col("heading").isNotNull(), F.array("heading"))
    return (ops.key_terms_window(docs, headings, ANCHORS, window=3000)
            .select("doc_id", "window_text", "was_trimmed"))


def _slice_sql(name: str, i: int) -> str:
    spec = SECTIONS[name]
    if name == "identifiers":
        return f"SELECT doc_id, '{name}' AS section, {i} AS ord, substr(text, 1, {spec['max_chars']}) AS slice FROM {{documents}}"
    return f"""SELECT doc_id, '{name}' AS section, {i} AS ord,
  CASE WHEN pos IS NULL THEN '' ELSE substr(text, greatest(pos - 500, 1), {spec['max_chars']}) END AS slice
FROM (SELECT doc_id, text, least({', '.join(_first_word(h) for h in spec['search_headers'])}) AS pos FROM {{documents}}) t"""


# The check engine's \\b is ASCII; a word boundary is spelt by Unicode classes instead.
_WORDLESS = r"[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]"


def _first_word(header: str) -> str:
    """Position of the first whole-word hit: length of the text before it, and of the sign in front of it, plus one."""
    hit = rf"(?i)(^|{_WORDLESS}){header}($|{_WORDLESS})"
    return (f"CASE WHEN regexp_matches(text, '{hit}') THEN "
            f"length(string_split_regex(text, '{hit}')[1]) + length(regexp_extract(text, '{hit}', 1)) + 1 END")


domain.CHECK_TABLES["doc_slices"] = " UNION ALL ".join(_slice_sql(n, i) for i, n in enumerate(SECTIONS))


def slices(spark, sf):
    return ops.section_slices(table(spark, sf, "documents").select("doc_id", "text"), SECTIONS, routes=None)


@query("h6_section_slices", "SELECT doc_id, section, ord, slice FROM {doc_slices}")
def h6(spark, sf):
    return slices(spark, sf)


# Every document gets a model; the last name is in no route, so it gets every section.
_MODELS = [*config.MODEL_SECTIONS, "legacyNote"]
_ROUTED = ", ".join(f"({i}, '{name}')" for i, m in enumerate(_MODELS) for name in SECTIONS if name in config.MODEL_SECTIONS.get(m, SECTIONS))


@query("h6_routed_slices", f"""
SELECT doc_id, s.section, ord, slice FROM {{doc_slices}} s JOIN (VALUES {_ROUTED}) r(n, section)
  ON r.section = s.section AND r.n = doc_id % {len(_MODELS)}""")
def h6b(spark, sf):
    model = F.get(F.array(*map(F.lit, _MODELS)), (F.col("doc_id") % len(_MODELS)).cast("int"))
    return ops.section_slices(table(spark, sf, "documents").select("doc_id", "text", model.alias("model")), SECTIONS).drop("model")


@query("h7_slices_to_ask", "SELECT doc_id, section, length(slice)::int AS chars FROM {doc_slices} WHERE length(slice) >= 100")
def h7(spark, sf):
    return ops.split_short_slices(slices(spark, sf))[0].select("doc_id", "section", F.length("slice").alias("chars"))


@query("h7_slices_skipped", "SELECT doc_id, section, ord FROM {doc_slices} WHERE length(slice) < 100")
def h7b(spark, sf):
    return ops.split_short_slices(slices(spark, sf))[1]


# Interval view of the same rule: hit positions, windows, islands by running end, cap by running length.
domain.CHECK_TABLES["targeted"] = f"""
SELECT d.doc_id, coalesce(t.sections, '') AS targeted FROM {{documents}} d LEFT JOIN (
  SELECT doc_id, string_agg(substr(chunk, 1, (8000 - before)::bigint), '\n\n[...]\n\n' ORDER BY s) AS sections FROM (
    SELECT doc_id, s, chunk, coalesce(sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT i.doc_id, i.s, {d_strip("substr(d.text, (i.s + 1)::bigint, (i.e - i.s)::bigint)")} AS chunk FROM (
      SELECT doc_id, island, min(s) AS s, max(e) AS e FROM (
        SELECT *, sum(CASE WHEN s <= coalesce(prev, -1) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM (
          SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM (
            SELECT doc_id, n, greatest(0, pos - 200) AS s, least(total, pos + hit_len + 1500) AS e FROM (
              SELECT doc_id, n, total, hit_len, sum(part_len) OVER w + coalesce(sum(hit_len) OVER (PARTITION BY doc_id ORDER BY n
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
                SELECT doc_id, length(text) AS total, unnest(range(1, len(h) + 1)) AS n,
                  length(p[unnest(range(1, len(h) + 1))]) AS part_len, length(h[unnest(range(1, len(h) + 1))]) AS hit_len FROM (
                  SELECT doc_id, text, regexp_extract_all(text, '(?i){'|'.join(WORDS)}') AS h,
                    string_split_regex(text, '(?i){'|'.join(WORDS)}') AS p FROM {{documents}}) a) b
              WINDOW w AS (PARTITION BY doc_id ORDER BY n)) c) d0) e0) f0 GROUP BY 1, 2) i
    JOIN {{documents}} d ON i.doc_id = d.doc_id) g) k
  WHERE before < 8000 GROUP BY 1) t ON d.doc_id = t.doc_id"""


@query("h8_targeted_sections", "SELECT * FROM {targeted}")
def h8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.targeted_sections(F.col("text"), WORDS).alias("targeted"))


# Excerpts of each document: verbatim, with altered white space, with an altered end, and absent.
_EXCERPT = """CASE doc_id % 5 WHEN 0 THEN substr(text, 41, 130)
  WHEN 1 THEN replace(replace(substr(text, 61, 90), chr(10), ' '), ' ', '  ')
  WHEN 2 THEN substr(text, 21, 45) || ' but paraphrased from here on in other words'
  WHEN 3 THEN substr(text, 11, 15) ELSE 'never in any document ' || text END"""
domain.TABLES["excerpts"] = f"SELECT doc_id, text, {_EXCERPT} AS excerpt FROM {{documents}}"


def _quoted(x: str, space: str) -> str:
    return rf"'\Q' || regexp_replace({x}, '\s+', '\\E{space}\\Q', 'g') || '\E'"


def _where(cond: str, start: str, length: str) -> str:
    return f"CASE WHEN {cond} THEN struct_pack(s := {start}, l := {length}) END"


def _try(x: str, space: str) -> list[str]:
    flexible = f"regexp_extract(text, {_quoted(x, space)}, 0, 's')"
    return [_where(f"strpos(text, {x}) > 0", f"strpos(text, {x})", f"length({x})"),
            _where(f"regexp_matches(text, {_quoted(x, space)}, 's')", f"strpos(text, {flexible})", f"length({flexible})")]


_PREFIXES = [t for k in range(6) for t in (
    f"CASE WHEN least(length(excerpt), 100) - {15 * k} >= 20 THEN {c} END"
    for c in _try(f"substr(excerpt, 1, least(length(excerpt), 100)::bigint - {15 * k})", r"\\s+"))]


@query("h9_excerpt_anchor", f"""
SELECT doc_id, a.s::int AS start, a.l::int AS length FROM (SELECT doc_id, coalesce({', '.join(_PREFIXES)}) AS a FROM {{excerpts}}) t""")
def h9(spark, sf):
    found = ops.anchor_excerpt(F.col("text"), F.col("excerpt"))
    return table(spark, sf, "excerpts").select("doc_id", found.alias("a")).select("doc_id", "a.start", "a.length")


@query("h10_excerpt_anchor_loose", f"""
SELECT doc_id, a.s::int AS start, a.l::int AS length FROM (SELECT doc_id, CASE WHEN length(excerpt) >= 5 THEN coalesce(
  {', '.join(_try("excerpt", r"[\\s\\S]{{0,10}}"))},
  CASE WHEN length(excerpt) > 40 THEN {_where("strpos(text, substr(excerpt, 1, 40)) > 0", "strpos(text, substr(excerpt, 1, 40))", "40")} END) END AS a
  FROM {{excerpts}}) t""")
def h10(spark, sf):
    found = ops.anchor_excerpt_loose(F.col("text"), F.col("excerpt"))
    return table(spark, sf, "excerpts").select("doc_id", found.alias("a")).select("doc_id", "a.start", "a.length")


# Two dozen excerpts of each document: verbatim, with altered white space, with an altered end, and absent.
_MANY = """CASE i % 4 WHEN 0 THEN substr(text, 41 + 7 * i, 130)
  WHEN 1 THEN replace(replace(substr(text, 61 + 5 * i, 90), chr(10), ' '), ' ', '  ')
  WHEN 2 THEN substr(text, 21 + 3 * i, 45) || ' but paraphrased from here on in other words' ELSE 'in no document at all ' || cast(i AS string) END"""


@query("h9_excerpts_of_document", f"""
SELECT doc_id, i, a.s::int AS start, a.l::int AS length FROM (SELECT doc_id, i, coalesce({', '.join(_PREFIXES)}) AS a
  FROM (SELECT doc_id, text, i, {_MANY} AS excerpt FROM {{documents}}, (SELECT unnest(range(0, 24))::int AS i) n) x) t""")
def h9_many(spark, sf):
    many = F.expr(f"transform(sequence(0, 23), i -> {_MANY})")
    found = table(spark, sf, "documents").select("doc_id", anchor_excerpts(F.col("text"), many).alias("found"))
    return found.select("doc_id", F.posexplode("found").alias("i", "a")).select("doc_id", "i", "a.start", "a.length")


_HISTORY = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {{conversations}}),
k AS (SELECT *, max(back) OVER (PARTITION BY conv_id) AS oldest FROM r WHERE back <= {n})
SELECT conv_id, (-back)::int AS pos, role, text FROM k WHERE back < oldest OR role = 'user'
UNION ALL SELECT conv_id, 0, 'user', 'next question ' || conv_id FROM (SELECT DISTINCT conv_id FROM {{conversations}}) c"""


for _n in (10, 3):
    def _history(spark, sf, n=_n):
        turns = table(spark, sf, "conversations")
        current = turns.select("conv_id").distinct().withColumn(
            "text", F.concat(F.lit("next question "), F.col("conv_id").cast("string")))
        return ops.history_window(turns, current, n)
    query(f"h11_history_last_{_n}", _HISTORY.replace("{n}", str(_n)).replace("{{", "{").replace("}}", "}"))(_history)


# Pages with image tags: own folder, foreign host, inline data, duplicates, other extensions.
domain.TABLES["image_pages"] = """
SELECT page_id, html || '<IMG width=3 src="logo' || cast(page_id % 4 AS string) || '.GIF"><img src=" /chart.png?v=2 ">'
  || '<img alt="x" src=''data:image/png;base64,AAAA''><img src="https://elsewhere.example.org/a.jpg">'
  || '<img src="https://docs.example.com/f/' || cast(page_id AS string) || '/sub/plan.svg"><img src=chart.png><img src="">'
  || '<img src="notes.pdf"><img src="scan"><img src="b&amp;w.jpeg">' AS html FROM {pages}"""


@query("s20_filing_images", """
SELECT page_id, ord::int AS ord, image_name FROM (SELECT page_id, unnest(range(0, 6)) AS ord,
  unnest(['logo' || (page_id % 4) || '.GIF', 'chart.png', 'plan.svg', 'scan', 'b&w.jpeg', NULL]) AS image_name FROM {image_pages}) t
WHERE image_name IS NOT NULL""")
def s20(spark, sf):
    pages = table(spark, sf, "image_pages")
    base = F.concat(F.lit("https://docs.example.com/f/"), F.col("page_id").cast("string"), F.lit("/"))
    return ops.filing_images(pages, base)


# Filing documents whose key-terms table is placed in five ways; rows come from the page text.
_ROWS = """'<tr><th>Term</th><th>VALUE</th></tr><tr><td>Maturity&nbsp;Date:</td><td>March ' || cast(page_id % 28 + 1 AS string)
  || ', 2029</td></tr><tr><td>Currency</td><td>USD</td></tr><tr><td>CUSIP<td>Q' || lpad(cast(page_id AS string), 8, '0')
  || '</tr><tr><td colspan=2>Notes</td></tr><tr><td>Coupon Rate</td><td>TBD</td><td>x</td></tr>'
  || '<tr><td>Interest Rate</td><td><b>' || cast(page_id % 9 + 1 AS string) || '.5%</b> per annum</td></tr><tr><td></td><td>z</td></tr>'
  || '<tr><td>Extra Item ' || cast(page_id % 3 AS string) || '</td><td>v' || cast(page_id AS string) || '</td></tr>'"""
domain.TABLES["filing_pages"] = f"""
SELECT page_id, html || '<table><tr><td>Other</td><td>9</td></tr></table>' || CASE page_id % 6
  WHEN 0 THEN '<table><caption>Our <i>Key Terms</i></caption>' || {_ROWS} || '</table>'
  WHEN 1 THEN '<table><tr><td colspan=2>KEY TERMS</td></tr>' || {_ROWS} || '</table>'
  WHEN 2 THEN '<p>Summary of Terms</p><p>text</p><table>' || {_ROWS} || '</table>'
  WHEN 3 THEN '<div><div><span>Offering terms</span></div></div><table>' || {_ROWS} || '</table>'
  WHEN 4 THEN '<table>' || {_ROWS} || '</table>'
  ELSE '<table><tr><th>Key Terms and Assumptions' || {_ROWS} || '</table>' END AS html FROM {{pages}}"""
_KEPT = """
FROM (SELECT page_id, unnest([{first}]) AS r FROM {pages} WHERE page_id % 6 <> 4) t"""


def _key_rows(spark, sf):
    return htmlrows.key_terms_rows(table(spark, sf, "filing_pages"))


@query("h2_key_terms_rows", """
SELECT page_id, r.l AS label_raw, r.v AS value_raw FROM (SELECT page_id, unnest([
  {{'l': 'Term', 'v': 'VALUE'}}, {{'l': 'Maturity' || chr(160) || 'Date:', 'v': 'March ' || (page_id % 28 + 1) || ', 2029'}},
  {{'l': 'Currency', 'v': 'USD'}}, {{'l': 'CUSIP', 'v': 'Q' || lpad(page_id::varchar, 8, '0')}}, {{'l': 'Coupon Rate', 'v': 'TBD'}},
  {{'l': 'Interest Rate', 'v': (page_id % 9 + 1) || '.5% per annum'}}, {{'l': '', 'v': 'z'}},
  {{'l': 'Extra Item ' || (page_id % 3), 'v': 'v' || page_id}}]) AS r FROM {pages} WHERE page_id % 6 <> 4) t""")
def h2(spark, sf):
    return _key_rows(spark, sf).select("page_id", "label_raw", "value_raw")


@query("h3_label_value_rows", """
SELECT page_id, r.l AS label_raw, r.v AS value_raw FROM (SELECT page_id, unnest([
  {{'l': 'Maturity' || chr(160) || 'Date:', 'v': 'March ' || (page_id % 28 + 1) || ', 2029'}},
  {{'l': 'CUSIP', 'v': 'Q' || lpad(page_id::varchar, 8, '0')}}, {{'l': 'Coupon Rate', 'v': 'TBD'}},
  {{'l': 'Interest Rate', 'v': (page_id % 9 + 1) || '.5% per annum'}}, {{'l': 'Extra Item ' || (page_id % 3), 'v': 'v' || page_id}}]) AS r
  FROM {pages} WHERE page_id % 6 <> 4) t""")
def h3(spark, sf):
    return htmlrows.label_value_rows(_key_rows(spark, sf)).select("page_id", "label_raw", "value_raw")


@query("e2_table_fields_from_html", """
SELECT filing_id, field_path, value_json FROM (SELECT page_id::varchar AS filing_id, unnest([
  {{'field_path': 'structuredProductsGeneric.maturityDate', 'value_json': '"March ' || (page_id % 28 + 1) || ', 2029"'}},
  {{'field_path': 'identifiers.cusip', 'value_json': '"Q' || lpad(page_id::varchar, 8, '0') || '"'}},
  {{'field_path': 'coupon.rate', 'value_json': '0.0' || (page_id % 9 + 1) || '5'}}], recursive := true) FROM {pages} WHERE page_id % 6 <> 4) t""")
def e2_html(spark, sf):
    rows = htmlrows.label_value_rows(_key_rows(spark, sf)).withColumn("filing_id", F.col("page_id").cast("string"))
    resolved = labels.resolve(rows, labels.merge_layers(labels.label_table(spark)))
    return (extract.table_fields(resolved, extract.parser_registry(spark))
            .select("filing_id", "field_path", "value_json"))


domain.TABLES["index_pages"] = """
SELECT page_id, '<table><tr><th>Seq</th><th> Document </th></tr>'
  || '<tr><td>1</td><td>Main <b>doc</b></td><td><a href="/d/' || cast(page_id AS string) || '.htm">p' || cast(page_id AS string)
  || CASE page_id % 4 WHEN 0 THEN '.pdf' ELSE '.HTM' END || '</a></td><td>' || CASE page_id % 3 WHEN 0 THEN '424B2' ELSE 'EX-5' END || '</td></tr>'
  || '<tr><td>2</td><td>short</td></tr><tr><td>3<td>Second<td><a href="s.html">second.html</a><td>Form 424b2'
  || '<tr><td>4</td><td>No link</td><td>plain</td></tr></table><table><tr><td>a</td><td>b</td><td>c</td></tr></table>' || html AS html FROM {pages}"""
_INDEX = """
WITH rows AS (SELECT page_id, r.* FROM (SELECT page_id, unnest([
  {{'seq': 0, 'sequence': '1', 'description': 'Maindoc', 'name': 'p' || page_id || CASE page_id % 4 WHEN 0 THEN '.pdf' ELSE '.HTM' END,
    'url': '/d/' || page_id || '.htm', 'type': CASE page_id % 3 WHEN 0 THEN '424B2' ELSE 'EX-5' END}},
  {{'seq': 1, 'sequence': '3', 'description': 'Second', 'name': 'second.html', 'url': 's.html', 'type': 'Form 424b2'}},
  {{'seq': 2, 'sequence': '4', 'description': 'No link', 'name': '', 'url': '', 'type': ''}}]) AS r FROM {pages}) t)
"""


@query("s4_index_rows", _INDEX + "SELECT page_id, seq::bigint AS seq, sequence, description, name, url, type FROM rows")
def s4(spark, sf):
    return htmlrows.index_rows(table(spark, sf, "index_pages"))


# ---- request text ------------------------------------------------------------------------

domain.TABLES["shared_rules"] = """
SELECT lower(p_type) || '.' || split_part(p_name, ' ', 1) AS field_path, max(p_name) AS description,
  CASE WHEN max(p_size) % 2 = 0 THEN min(p_brand) || ', ' || max(p_brand) END AS synonyms,
  CASE WHEN max(p_size) % 3 = 0 THEN 'decimal' ELSE '' END AS value_format,
  CASE WHEN max(p_size) % 5 = 0 THEN 'not the ' || min(p_type) END AS caution
FROM {part} GROUP BY lower(p_type) || '.' || split_part(p_name, ' ', 1)"""
GUIDE = ["Unions: write the $type key.", "Frequencies: monthly, quarterly."]


def hint_blocks(spark, sf):
    issuers = table(spark, sf, "hint_issuers").select(
        "issuer_key", F.split("headings", ",").alias("section_headings"), F.lit("early").alias("key_terms_position"),
        F.lit(None).cast("string").alias("document_structure"), F.repeat(F.col("issuer_key"), 90).alias("general_notes"))
    hints = table(spark, sf, "issuer_hints").select(
        "issuer_key", "field_path", "synonyms", "label_in_doc", F.repeat(F.col("synonyms"), 30).alias("format"),
        F.lit("").alias("location"))
    return extract.hint_blocks(issuers, hints, table(spark, sf, "shared_rules"), GUIDE)


domain.CHECK_TABLES["blocks"] = """
WITH s AS (SELECT string_agg('- ' || field_path || ': ' || concat_ws(' | ', nullif(description, ''),
    'synonyms: ' || nullif(synonyms, ''), 'format: ' || nullif(value_format, ''), 'caution: ' || nullif(caution, '')),
    chr(10) ORDER BY field_path) AS t FROM {shared_rules}),
o AS (SELECT issuer_key, string_agg('  - ' || field_path || ': ' || concat_ws(' | ', 'synonyms: ' || nullif(synonyms, ''),
    'label: ' || nullif(label_in_doc, ''), 'format: ' || substr(repeat(synonyms, 30), 1, 150)), chr(10) ORDER BY field_path) AS t
  FROM {issuer_hints} GROUP BY 1)
SELECT i.issuer_key, '## Output rules' || chr(10) || 'Unions: write the $type key.' || chr(10) || 'Frequencies: monthly, quarterly.'
  || chr(10) || chr(10) || '## Shared field rules' || chr(10) || s.t || chr(10) || '## Issuer guidance' || chr(10) || 'Key terms: early'
  || chr(10) || 'Headings: ' || replace(headings, ',', ', ') || chr(10) || 'Notes: ' || substr(repeat(i.issuer_key, 90), 1, 800)
  || coalesce(chr(10) || 'Field aliases:' || chr(10) || o.t, '') AS hints_block
FROM {hint_issuers} i CROSS JOIN s LEFT JOIN o ON i.issuer_key = o.issuer_key"""


@query("e16_hint_blocks", "SELECT * FROM {blocks}")
def e16(spark, sf):
    return hint_blocks(spark, sf)


@query("e17_extraction_requests", """
SELECT doc_id::varchar AS filing_id, section, 'Extract the fields of the schema below from the filing text.' || chr(10) || 'Model: ' || lang
  || chr(10) || 'Section: ' || section || chr(10) || 'Instruction: ' || CASE section WHEN 'coupon' THEN 'rates only' ELSE '' END || chr(10)
  || 'Schema:' || chr(10) || CASE WHEN section <> 'parties' THEN lang || '/' || section ELSE '' END || chr(10)
  || coalesce(CASE WHEN source <> 'src0' THEN 'hints for ' || source END, '') AS preamble,
  'FILING TEXT:' || chr(10) || CASE slice WHEN '' THEN '[No matching section in this filing: answer null for every field]' ELSE slice END AS filing_part
FROM {doc_slices} s JOIN {documents} d USING (doc_id)""")
def e17(spark, sf):
    docs = table(spark, sf, "documents")
    asked = ops.section_slices(docs.selectExpr("cast(doc_id AS string) AS filing_id", "lang AS model",
                                               "source AS issuer_key", "text"), SECTIONS, routes=None)
    models = docs.select(F.col("lang").alias("model")).distinct()
    schemas = models.select("model", F.explode(F.array(F.lit("identifiers"), F.lit("coupon"), F.lit("autocall"))).alias("section"))
    schemas = schemas.withColumn("schema_text", F.concat_ws("/", "model", "section"))
    hints = (docs.select(F.col("source").alias("issuer_key")).distinct().filter("issuer_key <> 'src0'")
             .withColumn("hints_block", F.concat(F.lit("hints for "), F.col("issuer_key"))))
    sections = extract.section_table(spark, {n: {**s, "note": "rates only" if n == "coupon" else ""} for n, s in SECTIONS.items()})
    return extract.extraction_requests(asked, schemas, hints, sections)
