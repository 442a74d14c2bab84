"""Typed values, label mapping and the table tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet import config
from termsheet.functions import values
from termsheet.functions.text import (
    accession_folder, camel_label, json_string, normalise_accession, normalise_label, strip_footnotes)
from termsheet.operators import extract, labels as ops
from termsheet.plans import domain
from termsheet.plans.domain import table
from termsheet.plans.registry import query
from termsheet.session import work_folder
from termsheet.sources.versioned import MergedTable

USER_LABELS = [("Observation Style", "barrier.triggerDetails.observationType"),
               ("Product  Maturity:", "structuredProductsGeneral.maturityDate"),
               ("calculation agent", "parties.issuer.name")]
ISSUER_LABELS = [("Barclays Bank PLC", "Initial Value", "product.issuePrice"),
                 ("Barclays Bank PLC", "INITIAL VALUE*", "underlyingTerms.underlyingAssets[*].finalLevel"),
                 ("GS Finance Corp", "Denomination", "structuredProductsGeneral.notional"),
                 ("UBS AG", "Fee Schedule", "structuredProductsGeneral.term")]


# ---- check-side helpers (independent spelling of the same rules) ------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_notes(x: str) -> str:
    return d_strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '[*†‡§¶]', '', 'g'), "
                   rf"'\s*\(\d+\)', '', 'g'), '\s*\[\d+\]', '', 'g')")


def d_norm(x: str) -> str:
    x = rf"regexp_replace(lower({d_strip(x)}), '\s+', ' ', 'g')"
    x = d_strip(rf"regexp_replace({x}, '[\s*†‡§¶]+$', '')")
    x = d_strip(rf"regexp_replace({x}, '\s*\(\d+\)$', '')")
    return d_strip(f"rtrim({x}, ':')")


def d_first(x: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def d_double(x: str) -> str:
    return f"try_cast(replace({x}, ',', '') AS double)"


def d_date(x: str) -> str:
    t = d_notes(x)
    words = r"\b([A-Za-z]+)\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    number = "CASE lower(" + d_first(t, words, 1) + ") " + " ".join(
        f"WHEN '{name}' THEN '{n:02d}'" for name, n in config.MONTHS.items()) + " END"
    digits = r"\b(\d{{4}})[/\-](\d{{2}})[/\-](\d{{2}})\b"
    return (rf"CASE WHEN regexp_full_match({t}, '\d{{{{4}}}}-\d{{{{2}}}}-\d{{{{2}}}}') THEN {t} "
            f"WHEN {number} IS NOT NULL THEN regexp_extract({t}, '{words}', 3) || '-' || {number} || '-' "
            f"|| lpad(regexp_extract({t}, '{words}', 2), 2, '0') "
            f"WHEN regexp_matches({t}, '{digits}') THEN regexp_extract({t}, '{digits}', 1) || '-' || "
            f"regexp_extract({t}, '{digits}', 2) || '-' || regexp_extract({t}, '{digits}', 3) END")


def d_rate(x: str) -> str:
    def fraction(n: str) -> str:
        return f"round(CASE WHEN {d_double(n)} > 1 THEN {d_double(n)} / 100 ELSE {d_double(n)} END, 6)"
    yearly = d_first(x, r"(?i)([\d,]+\.?\d*)\s*%\s*(?:per\s+annum|p\.a\.|per\s+year|annually)\b", 1)
    found = rf"regexp_extract_all({x}, '(?i)[\d,]+\.?\d*\s*%(?:\s*(?:per\s+month|monthly)\b)?')"
    last = f"coalesce(list_filter({found}, lambda m: ends_with(m, '%'))[-1], {found}[-1])"
    return f"coalesce({fraction(yearly)}, {fraction(d_first(last, r'[\d,]+\.?\d*'))})"


def d_amount(x: str) -> str:
    return d_double(d_first(f"regexp_replace({x}, '[US$£€¥]', '', 'g')", r"[\d,]+\.?\d*"))


def d_number(x: str) -> str:
    return d_double(d_first(f"regexp_replace({d_strip(x)}, '[,$£€¥]', '', 'g')", r"[\d,]+\.?\d*"))


def d_keyword(x: str, rows) -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in rows) + " END"


def d_currency(x: str) -> str:
    t = f"upper({d_strip(x)})"
    spelled = " OR ".join(f"contains({t}, '{s}')" for s in config.DOLLAR_SPELLINGS)
    return (f"coalesce({d_first(t, chr(92) + 'b(' + '|'.join(config.CURRENCY_CODES) + ')' + chr(92) + 'b', 1)}, "
            f"CASE WHEN {spelled} THEN 'USD' END)")


CUSIP = r"\b([A-Z0-9]{{9}})\b"
ISIN = r"\b([A-Z]{{2}}[A-Z0-9]{{10}})\b"
CHECKS = {
    "text": f"nullif({d_notes('value_raw')}, '')", "date": d_date("value_raw"), "percentage": d_rate("value_raw"),
    "amount": d_amount("value_raw"), "number": d_number("value_raw"),
    "cusip": d_first(d_notes("value_raw"), CUSIP, 1), "isin": d_first(d_notes("value_raw"), ISIN, 1),
    "currency": d_currency("value_raw"), "frequency": d_keyword("value_raw", config.FREQUENCY_WORDS),
    "observation": d_keyword("value_raw", config.OBSERVATION_WORDS),
}


def d_json(kind: str) -> str:
    x = CHECKS[kind]
    if kind in ("percentage", "amount", "number"):
        return f"cast({x} AS varchar)"
    if kind == "frequency":
        return "'{{\"$type\":\"' || " + x + " || '\"}}'"
    return "'\"' || " + x + " || '\"'"


# Label map and registry for the checks, from the same constants.
def _rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else (str(v) if isinstance(v, int) else q(v))
                                     for v in row) + ")" for row in rows)


domain.CHECK_TABLES["label_layers"] = "SELECT * FROM (VALUES " + _rows(
    [(1, None, i, a, b) for i, (a, b) in enumerate(config.shared_label_rows())]
    + [(2, None, i, a, b) for i, (a, b) in enumerate(USER_LABELS)]
    + [(3, k, i, a, b) for i, (k, a, b) in enumerate(ISSUER_LABELS)]
) + ") t(layer, issuer_key, ord, label_raw, field_path)"
domain.CHECK_TABLES["parser_kinds"] = ("SELECT * FROM (VALUES " + _rows(sorted(config.PARSER_KINDS.items()))
                                       + ") t(field_path, kind)")
domain.CHECK_TABLES["issuer_patterns"] = "SELECT * FROM (VALUES " + _rows(
    [(i, d["issuer_key"], p) for i, d in enumerate(config.ISSUERS) for p in d["patterns"]]
) + ") t(issuer_ord, issuer_key, pattern)"
domain.CHECK_TABLES["matched"] = """
SELECT f.*, m.issuer_key FROM {filings} f LEFT JOIN (
  SELECT n.issuer_name, arg_min(p.issuer_key, p.issuer_ord) AS issuer_key
  FROM (SELECT DISTINCT issuer_name FROM {filings} WHERE issuer_name <> '') n JOIN {issuer_patterns} p
    ON contains(lower(n.issuer_name), lower(p.pattern)) OR contains(lower(p.pattern), lower(n.issuer_name))
  GROUP BY 1) m ON f.issuer_name = m.issuer_name"""
domain.CHECK_TABLES["resolved"] = f"""
SELECT p.*, {d_norm('p.label_raw')} AS label_norm, f.issuer_key, (
    SELECT arg_max(l.field_path, l.layer * 100000 + l.ord) FROM {{label_layers}} l
    WHERE {d_norm('l.label_raw')} = {d_norm('p.label_raw')}
      AND (l.issuer_key IS NULL OR l.issuer_key = f.issuer_key)) AS field_path
FROM {{label_values}} p LEFT JOIN {{matched}} f ON p.filing_id = f.filing_id"""
domain.CHECK_TABLES["typed"] = (
    "SELECT r.*, k.kind, CASE " + " ".join(f"WHEN k.kind = '{k}' THEN {d_json(k)}" for k in CHECKS)
    + f" ELSE '\"' || nullif({d_strip('value_raw')}, '') || '\"' END AS value_json "
    "FROM {resolved} r LEFT JOIN {parser_kinds} k ON r.field_path = k.field_path WHERE r.field_path IS NOT NULL")
domain.CHECK_TABLES["tier1"] = """
SELECT filing_id, field_path, arg_min(value_json, row_no) AS value_json, 0.97::double AS confidence,
  arg_min(label_raw || ': ' || substr(value_raw, 1, 200), row_no) AS excerpt, 'html_table' AS source
FROM {typed} WHERE value_json IS NOT NULL GROUP BY 1, 2"""


# ---- Spark side --------------------------------------------------------------------------

def pairs(spark, sf):
    """Label/value rows with the issuer whose label overrides apply to them."""
    about = (table(spark, sf, "filings")
             .select("filing_id", ops.issuer_match(F.col("issuer_name")).alias("issuer_key")))
    return table(spark, sf, "label_values").join(about, "filing_id", "left")


def resolved(spark, sf):
    layers = ops.label_table(spark, USER_LABELS, ISSUER_LABELS)
    return ops.resolve(pairs(spark, sf), ops.merge_layers(layers))


def tier1(spark, sf):
    return extract.table_fields(resolved(spark, sf), extract.parser_registry(spark))


_PARSERS = {
    "v1_text": ("text", values.text_value), "v2_date": ("date", values.date_value),
    "v3_percentage": ("percentage", values.rate_value), "v4_amount": ("amount", values.amount_value),
    "v5_number": ("number", values.number_value), "v6_cusip": ("cusip", values.cusip_value),
    "v7_isin": ("isin", values.isin_value), "v8_currency": ("currency", values.currency_value),
    "v9_frequency": ("frequency", values.frequency_value),
    "v10_observation": ("observation", values.observation_value),
}
for _name, (_kind, _parse) in _PARSERS.items():
    def _run(spark, sf, parse=_parse):
        return (table(spark, sf, "label_values")
                .select("filing_id", "row_no", "value_raw", parse(F.col("value_raw")).alias("value")))
    query(_name, f"SELECT filing_id, row_no, value_raw, {CHECKS[_kind]} AS value FROM {{label_values}}")(_run)


@query("v0_footnotes", f"SELECT filing_id, row_no, {d_notes('value_raw')} AS cleaned FROM {{label_values}}")
def v0(spark, sf):
    return (table(spark, sf, "label_values")
            .select("filing_id", "row_no", strip_footnotes(F.col("value_raw")).alias("cleaned")))


@query("v11_plain_number", r"""
SELECT filing_id, row_no, try_cast(rtrim(regexp_replace(value_raw, '[,$£€¥\s]', '', 'g'), '%') AS double) AS value
FROM {label_values}""")
def v11(spark, sf):
    return (table(spark, sf, "label_values")
            .select("filing_id", "row_no", values.plain_number(F.col("value_raw")).alias("value")))


@query("v12_typed_values", """
SELECT filing_id, row_no, field_path, kind, value_json FROM {typed}""")
def v12(spark, sf):
    rows = resolved(spark, sf).filter("field_path IS NOT NULL").join(extract.parser_registry(spark), "field_path", "left")
    return rows.select("filing_id", "row_no", "field_path", "kind",
                       values.typed_json(F.col("kind"), F.col("value_raw")).alias("value_json"))


@query("l1_normalise_label", f"""
SELECT label_raw, {d_norm('label_raw')} AS label_norm, count(*) AS n FROM {{label_values}} GROUP BY 1, 2""")
def l1(spark, sf):
    return (table(spark, sf, "label_values").groupBy("label_raw")
            .agg(F.count("*").alias("n")).withColumn("label_norm", normalise_label(F.col("label_raw"))))


domain.TABLES["label_entries"] = """
SELECT CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS layer,
  CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ':' ELSE p_name || '  *' END AS label_raw,
  lower(p_type) || '.' || lower(replace(p_brand, '#', '')) AS field_path, p_partkey AS ord
FROM {part}"""


@query("l2_layered_merge", f"""
SELECT {d_norm('label_raw')} AS label_norm,
  arg_max(field_path, layer::hugeint * 1000000000000 + ord) AS field_path FROM {{label_entries}} GROUP BY 1""")
def l2(spark, sf):
    entries = table(spark, sf, "label_entries").withColumn("issuer_key", F.lit(None).cast("string"))
    return ops.merge_layers(entries).select("label_norm", "field_path")


@query("l3_resolve_labels", """
SELECT filing_id, row_no, label_norm, issuer_key, field_path FROM {resolved}""")
def l3(spark, sf):
    return resolved(spark, sf).select("filing_id", "row_no", "label_norm", "issuer_key", "field_path")


_ENTRIES = f"""
WITH e AS (SELECT {d_norm('label_raw')} AS label_norm, layer, arg_max(label_raw, ord) AS label,
  arg_max(field_path, ord) AS field_path FROM {{label_entries}} GROUP BY 1, 2),
m AS (SELECT label, label_norm, field_path, CASE layer WHEN 2 THEN 'user' ELSE 'cross_issuer' END AS source FROM e
  QUALIFY row_number() OVER (PARTITION BY label_norm ORDER BY layer DESC) = 1)
"""


def _entries(spark, sf):
    rows = table(spark, sf, "label_entries")
    return ops.merged_entries(rows.filter("layer = 1"), rows.filter("layer = 2"))


@query("l4_merged_entries", _ENTRIES + "SELECT * FROM m")
def l4(spark, sf):
    return _entries(spark, sf)


@query("l5_filter_entries", _ENTRIES + """
SELECT * FROM m WHERE (contains(lower(label), 'ring') OR contains(lower(field_path), 'ring')) AND source = 'user'""")
def l5(spark, sf):
    return ops.filter_entries(_entries(spark, sf), "Ring ", "user")


@query("l5_user_entry_count", _ENTRIES + """
SELECT count(*) AS entries, count(*) FILTER (source = 'user') AS user_entries FROM m""")
def l5b(spark, sf):
    return ops.count_user_entries(_entries(spark, sf))


domain.CHECK_TABLES["filing_misses"] = """
SELECT filing_id, label_norm, arg_min(label_raw, row_no) AS label_raw,
  arg_min(substr(value_raw, 1, 200), row_no) AS sample_value
FROM {resolved} WHERE field_path IS NULL GROUP BY 1, 2"""


@query("l6_label_misses", "SELECT * FROM {filing_misses}")
def l6(spark, sf):
    return ops.misses_per_filing(resolved(spark, sf))


# The log as it stood before the batch: labels seen under part names and one of the misses.
domain.TABLES["miss_log"] = """
SELECT label_norm, min(label_raw) AS label_raw, min(sample_value) AS sample_value,
  min(issuer_name) AS issuer_name, min(filing_id) AS filing_id, count(*) AS occurrences,
  '1995-01-01' AS first_seen_at, '1995-06-01' AS last_seen_at, min(cast(dismissed AS int)) = 1 AS dismissed
FROM (
  SELECT CASE WHEN p_size % 10 = 0 THEN 'fee schedule' ELSE lower(p_name) END AS label_norm, p_name AS label_raw,
    CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS sample_value, p_brand AS issuer_name,
    cast(p_partkey AS string) AS filing_id, p_retailprice > 905 AS dismissed
  FROM {part}) t GROUP BY label_norm"""


def _misses(spark, sf):
    about = table(spark, sf, "filings").selectExpr("filing_id", "issuer_name", "filing_date AS seen_at")
    return ops.misses_per_filing(resolved(spark, sf)).join(about, "filing_id", "left")


domain.CHECK_TABLES["miss_log_after"] = """
SELECT coalesce(l.label_norm, b.label_norm) AS label_norm, coalesce(l.label_raw, b.raw) AS label_raw,
  coalesce(nullif(l.sample_value, ''), b.sample) AS sample_value,
  CASE WHEN b.n IS NULL THEN l.issuer_name ELSE b.issuer END AS issuer_name,
  CASE WHEN b.n IS NULL THEN l.filing_id ELSE b.filing END AS filing_id,
  coalesce(l.occurrences, 0) + coalesce(b.n, 0) AS occurrences,
  coalesce(l.first_seen_at, b.lo) AS first_seen_at, coalesce(b.hi, l.last_seen_at) AS last_seen_at,
  coalesce(l.dismissed, false) AS dismissed
FROM {miss_log} l FULL OUTER JOIN (
  SELECT m.label_norm, count(*) AS n, arg_min(label_raw, (filing_date, m.filing_id)) AS raw,
    arg_min(sample_value, (filing_date, m.filing_id)) FILTER (sample_value <> '') AS sample,
    arg_max_null(f.issuer_name, (filing_date, m.filing_id)) AS issuer,
    arg_max(m.filing_id, (filing_date, m.filing_id)) AS filing, min(filing_date) AS lo, max(filing_date) AS hi
  FROM {filing_misses} m LEFT JOIN {filings} f ON m.filing_id = f.filing_id GROUP BY 1) b
ON l.label_norm = b.label_norm"""


def _log_after(spark, sf):
    return ops.upsert_misses(table(spark, sf, "miss_log"), _misses(spark, sf))


@query("l7_miss_upsert", "SELECT * FROM {miss_log_after}")
def l7(spark, sf):
    return _log_after(spark, sf)


@query("l7_committed_upsert", "SELECT * FROM {miss_log_after}")
def l7_committed(spark, sf):
    """The same through the stored table: the log as first batch, the misses as second, and that one delivered twice."""
    log = table(spark, sf, "miss_log")
    stored = MergedTable(spark, work_folder(spark, "miss-log"), "label_norm", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema), 16).create()
    stored.merge(0, log.withColumn("sample_value", F.nullif("sample_value", F.lit(""))), lambda _, rows: rows)
    for _ in range(2):
        stored.merge(1, _misses(spark, sf), ops.upsert_misses)
    return stored.read()


@query("l8_open_misses", """
SELECT * REPLACE (CASE WHEN coalesce(occurrences, 0) = 0 THEN 1 ELSE occurrences END AS occurrences)
FROM {miss_log_after} WHERE NOT dismissed""")
def l8(spark, sf):
    return ops.list_misses(_log_after(spark, sf))


domain.TABLES["miss_actions"] = """
SELECT CASE WHEN p_size % 17 = 0 THEN 'no such label' ELSE lower(p_name) END AS label_norm,
  CASE WHEN p_size % 3 = 0 THEN 'resolve' ELSE 'dismiss' END AS action,
  CASE WHEN p_size % 6 = 0 THEN ' ' ELSE ' ' || lower(p_type) || '.value' END AS field_path, p_partkey AS seq
FROM {part} WHERE p_retailprice > 903"""


def _acted(spark, sf):
    return ops.apply_miss_actions(table(spark, sf, "miss_log"), table(spark, sf, "miss_actions"))


_GOOD = """
WITH j AS (SELECT a.*, l.label_raw, CASE WHEN action = 'resolve' AND trim(field_path) = '' THEN 'field_path must not be empty'
  WHEN l.label_norm IS NULL THEN 'miss entry not found' END AS reason
  FROM {miss_actions} a LEFT JOIN {miss_log} l ON a.label_norm = l.label_norm)
"""


@query("l9_miss_actions_log", _GOOD + """
SELECT l.* REPLACE (l.dismissed OR EXISTS (SELECT 1 FROM j WHERE reason IS NULL AND j.label_norm = l.label_norm) AS dismissed)
FROM {miss_log} l""")
def l9(spark, sf):
    return _acted(spark, sf)[0]


@query("l9_miss_actions_labels", _GOOD + """
SELECT trim(label_raw) AS label_raw, arg_max(trim(field_path), seq) AS field_path, max(seq) AS seq
FROM j WHERE reason IS NULL AND action = 'resolve' GROUP BY 1""")
def l9b(spark, sf):
    return _acted(spark, sf)[1]


@query("l9_miss_actions_rejected", _GOOD + "SELECT label_norm, action, reason FROM j WHERE reason IS NOT NULL")
def l9c(spark, sf):
    return _acted(spark, sf)[2]


@query("l9_dismiss_all", "SELECT count(*) FILTER (NOT dismissed) AS dismissed_count FROM {miss_log}")
def l9d(spark, sf):
    return ops.dismiss_all(table(spark, sf, "miss_log"))[1]


domain.TABLES["label_edits"] = """
SELECT p_partkey AS seq, CASE WHEN p_size % 5 = 0 THEN 'remove' ELSE 'add' END AS action,
  CASE WHEN p_size % 5 = 0 THEN lower(p_name) WHEN p_size % 7 = 0 THEN ' '
    WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name || ':' END AS label_raw,
  CASE WHEN p_size % 11 = 0 THEN '' ELSE lower(p_type) || '.' || cast(p_size AS string) END AS field_path
FROM {part}"""
_EDITS = f"""
WITH j AS (SELECT *, CASE WHEN action = 'add' THEN CASE WHEN trim(label_raw) = '' THEN 'label must not be empty'
  WHEN trim(field_path) = '' THEN 'field_path must not be empty' END END AS reason FROM {{label_edits}}),
a AS (SELECT trim(label_raw) AS label_raw, trim(field_path) AS field_path, -1 AS seq FROM {{label_entries}} WHERE layer = 2
  QUALIFY row_number() OVER (PARTITION BY label_raw ORDER BY ord DESC) = 1
  UNION ALL SELECT trim(label_raw), trim(field_path), seq FROM j WHERE action = 'add' AND reason IS NULL),
l AS (SELECT label_raw, arg_max(field_path, seq) AS field_path, max(seq) AS seq, {d_norm('label_raw')} AS label_norm
  FROM a GROUP BY label_raw)
"""


def _edited(spark, sf):
    current = (table(spark, sf, "label_entries").filter("layer = 2")
               .groupBy("label_raw").agg(F.max_by("field_path", "ord").alias("field_path")))
    return ops.edit_user_labels(current, table(spark, sf, "label_edits"))


@query("l10_edit_user_labels", _EDITS + """
SELECT label_raw, label_norm, field_path FROM l WHERE NOT EXISTS (
  SELECT 1 FROM j WHERE action = 'remove' AND j.label_raw = l.label_norm AND j.seq >= l.seq)""")
def l10(spark, sf):
    return _edited(spark, sf)[0]


@query("l10_rejected_edits", _EDITS + "SELECT seq, label_raw, reason FROM j WHERE reason IS NOT NULL")
def l10b(spark, sf):
    return _edited(spark, sf)[1]


@query("l11_issuer_match", "SELECT filing_id, issuer_name, issuer_key FROM {matched}")
def l11(spark, sf):
    return table(spark, sf, "filings").select(
        "filing_id", "issuer_name", ops.issuer_match(F.col("issuer_name")).alias("issuer_key"))


domain.TABLES["hint_issuers"] = """
SELECT p_brand || ' & ' || p_type AS issuer_key, min(p_name) || ',' || max(p_name) AS headings
FROM {part} GROUP BY p_brand || ' & ' || p_type"""
domain.TABLES["issuer_hints"] = """
SELECT p_brand || ' & ' || p_type AS issuer_key, lower(p_type) || '.' || cast(p_size % 20 AS string) AS field_path,
  max(CASE WHEN p_size % 2 = 0 THEN p_name END) AS label_in_doc, max(p_name) AS synonyms
FROM {part} WHERE p_size % 9 <> 0 GROUP BY p_brand || ' & ' || p_type, lower(p_type) || '.' || cast(p_size % 20 AS string)"""


@query("l12_issuer_summary", """
SELECT trim(regexp_replace(lower(i.issuer_key), '[^a-z0-9]+', '_', 'g'), '_') AS slug, i.issuer_key AS name,
  (SELECT count(DISTINCT field_path) FROM {issuer_hints} h WHERE h.issuer_key = i.issuer_key) AS field_hints_count,
  headings AS section_headings FROM {hint_issuers} i""")
def l12(spark, sf):
    issuers = table(spark, sf, "hint_issuers").withColumn("section_headings", F.split("headings", ","))
    return (ops.issuer_summary(issuers, table(spark, sf, "issuer_hints"))
            .withColumn("section_headings", F.array_join("section_headings", ",")))


@query("l13_parser_catalogue", """
SELECT k.field_path, count(f.field_id) AS stored_rows FROM {parser_kinds} k LEFT JOIN {fields} f
ON k.field_path = f.field_path GROUP BY 1""")
def l13(spark, sf):
    stored = table(spark, sf, "fields").groupBy("field_path").agg(F.count("*").alias("n"))
    return (ops.parser_catalogue(extract.parser_registry(spark)).join(stored, "field_path", "left")
            .select("field_path", F.coalesce("n", F.lit(0)).alias("stored_rows")))


domain.TABLES["hint_updates"] = """
SELECT issuer_key, field_path, CASE WHEN n % 2 = 0 THEN 'label ' || cast(n AS string) END AS label_in_doc,
  CASE WHEN n % 3 = 0 THEN 'words ' || cast(n AS string) END AS synonyms
FROM (SELECT p_brand || ' & ' || p_type AS issuer_key, lower(p_type) || '.' || cast(p_size % 20 AS string) AS field_path,
  count(*) AS n FROM {part} WHERE p_size % 4 = 0
  GROUP BY p_brand || ' & ' || p_type, lower(p_type) || '.' || cast(p_size % 20 AS string)) t"""


@query("l14_hint_update", """
SELECT coalesce(h.issuer_key, u.issuer_key) AS issuer_key, coalesce(h.field_path, u.field_path) AS field_path,
  coalesce(u.label_in_doc, h.label_in_doc) AS label_in_doc, coalesce(u.synonyms, h.synonyms) AS synonyms
FROM {issuer_hints} h FULL OUTER JOIN {hint_updates} u ON h.issuer_key = u.issuer_key AND h.field_path = u.field_path""")
def l14(spark, sf):
    return ops.update_hints(table(spark, sf, "issuer_hints"), table(spark, sf, "hint_updates"),
                            ["issuer_key", "field_path"])


@query("s5_accession_normalise", """
SELECT filing_id, substr(accession_raw, 1, 10) || '-' || substr(accession_raw, 11, 2) || '-' || substr(accession_raw, 13)
  AS accession_number, accession_raw AS folder_key FROM {filings}""")
def s5(spark, sf):
    acc = normalise_accession(F.col("accession_raw"))
    return table(spark, sf, "filings").select("filing_id", acc.alias("accession_number"),
                                              accession_folder(acc).alias("folder_key"))


@query("s15_camel_label", """
SELECT DISTINCT lower(p_type) || replace(p_brand, '#', 'No') || 'Level' AS name,
  upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' ' || replace(p_brand, '#', ' No') || ' Level' AS label FROM {part}""")
def s15(spark, sf):
    name = F.concat(F.lower("p_type"), F.replace("p_brand", F.lit("#"), F.lit("No")), F.lit("Level"))
    return table(spark, sf, "part").select(name.alias("name")).distinct().withColumn("label", camel_label(F.col("name")))


@query("e1_registry_fields", """
SELECT filing_id, 'identifiers.cusip' AS field_path, '"' || cusip || '"' AS value_json, 1.0::double AS confidence,
  'EDGAR registry CUSIP: ' || cusip AS excerpt, 'registry' AS source FROM {filings}
UNION ALL SELECT filing_id, 'parties.issuer.name', '"' || issuer_name || '"', 1.0::double,
  'EDGAR registry issuer: ' || issuer_name, 'registry' FROM {filings} WHERE trim(issuer_name) <> ''""")
def e1(spark, sf):
    return extract.registry_fields(table(spark, sf, "filings"))


@query("e2_table_fields", "SELECT * FROM {tier1}")
def e2(spark, sf):
    return tier1(spark, sf)


@query("e2_fill_rate_by_issuer", f"""
SELECT coalesce(f.issuer_key, 'other') AS issuer, count(*) AS filings, sum(coalesce(n, 0))::bigint AS fields_found,
  round(sum(coalesce(n, 0)) / (count(*) * {len(config.PARSER_KINDS)}) * 100, 2) AS fill_rate_pct
FROM {{matched}} f LEFT JOIN (SELECT filing_id, count(*) AS n FROM {{tier1}} GROUP BY 1) t ON f.filing_id = t.filing_id
GROUP BY 1""")
def e2b(spark, sf):
    about = table(spark, sf, "filings").select(
        "filing_id", ops.issuer_match(F.col("issuer_name")).alias("issuer_key"))
    return extract.issuer_fill_rate(tier1(spark, sf), about, len(config.PARSER_KINDS))
