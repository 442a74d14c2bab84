"""Answer parsing, section merge, tiers, coverage, validation, review values and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet import config
from termsheet.functions.jsonvalues import object_text
from termsheet.operators import export, extract as ops
from termsheet.plans import domain
from termsheet.plans.domain import table
from termsheet.plans.label_queries import q, tier1
from termsheet.plans.registry import query


def descriptors(spark, sf):
    return table(spark, sf, "descriptors").withColumn("enum_values", F.split("enum_text", ",")).drop("enum_text")


def flat(spark, sf):
    return ops.flatten_answers(table(spark, sf, "answers"))


# A payload counts as good (three parts), text (fenced), odd (what a strict reader refuses) or empty.
domain.CHECK_TABLES["judged_answers"] = """
SELECT filing_id, ord, CASE WHEN payload LIKE '{{"odd%' THEN substr(payload, 6, 1)::int END AS odd,
  CASE WHEN tool_name = 'submit_extraction' AND payload NOT LIKE '{{"odd%' AND json_valid(payload) THEN payload::json END AS good,
  CASE WHEN tool_name IS NULL THEN replace(replace(payload, '```json' || chr(10), ''), chr(10) || '```', '')::json END AS txt
FROM {answers}"""


def _object(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'OBJECT' THEN {x}::varchar ELSE '{{{{}}}}' END"


_DATA = "coalesce(good->'data', txt)"
_PARTS = ("coupon", "identifiers", "list", "schedule", "a", "c")


def _odd(values: dict) -> str:
    return " ".join(f"WHEN {k} THEN {v}" for k, v in values.items())


# Fields of the odd answers: kind, path, value, confidence.
_ODD_FIELDS = [(1, "'s'", "'\"a?b\"'", "NULL"), (2, "'a'", "'2'", "'0.25'"), (2, "'b'", "'3'", "NULL"), (3, "repeat('x.', 1499) || 'x'", "'1'", "NULL"),
               (4, "'n'", "repeat('9', 5000)", "NULL"), (5, "'n'", "'NaN'", "NULL"), (5, "'m'", "'1'", "NULL")]


@query("e3_answer_parts", f"""
SELECT filing_id, ord, CASE odd {_odd({1: "'s'", 2: "'a,b'", 3: "'x'", 4: "'n'", 5: "'n,m'"})}
    ELSE CASE WHEN json_type({_DATA}) = 'OBJECT' THEN array_to_string(json_keys({_DATA}), ',') END END AS data_keys,
  {", ".join(f"CASE WHEN json_type({_DATA}) = 'OBJECT' THEN ({_DATA}->'{p}')::varchar{' WHEN odd = 2 THEN 2::varchar' if p == 'a' else ''} END AS {p}_json" for p in _PARTS)},
  CASE odd WHEN 3 THEN repeat('{{{{"x":', 1499) || '1' || repeat('}}}}', 1499) END AS x_json,
  CASE odd WHEN 2 THEN '{{{{"a":0.25}}}}' ELSE {_object("coalesce(good, txt)->'_confidence'")} END AS confidences_json,
  {_object("coalesce(good, txt)->'_excerpts'")} AS excerpts_json FROM {{judged_answers}}""")
def e3(spark, sf):
    parts = ops.parse_answers(table(spark, sf, "answers"))
    keys = F.when(F.size("data") > 0, F.array_join(F.map_keys("data"), ","))
    return parts.select("filing_id", "ord", keys.alias("data_keys"), *[F.col("data")[p].alias(f"{p}_json") for p in (*_PARTS, "x")],
                        object_text(F.col("confidences")).alias("confidences_json"), object_text(F.col("excerpts")).alias("excerpts_json"))


@query("e4_text_answers", """
SELECT filing_id, ord, json_extract(txt, '$.a.b')::varchar AS b_json, json_extract(txt, '$.c')::varchar AS c_json
FROM {judged_answers} WHERE txt IS NOT NULL""")
def e4(spark, sf):
    texts = ops.parse_answers(table(spark, sf, "answers").filter("tool_name IS NULL"))
    inner = F.to_json(F.try_variant_get(F.try_parse_json(F.col("data")["a"]), "$.b", "variant"))
    return texts.select("filing_id", "ord", inner.alias("b_json"), F.col("data")["c"].alias("c_json"))


_PATHS = {"coupon.frequency.$type": "$.data.coupon.frequency.\"$type\"", "coupon.rate": "$.data.coupon.rate",
          "flag": "$.data.flag", "identifiers.cusip": "$.data.identifiers.cusip",
          "identifiers.isin": "$.data.identifiers.isin", "list": "$.data.list", "schedule": "$.data.schedule"}
# Paths whose text is not as it stands in the answer.
_WRITTEN = {"named.note": "1.5", "named.2024-01-01T00:00:00Z": "10000000.0", "named.2024-02-01T00:00:00Z": "1.0",
            "named.2024-03-01T00:00:00Z": "[2.0,1000.0]", ".".join(f"k{i}" for i in range(1, 13)): "-5e-05"}
domain.CHECK_TABLES["flat_answers"] = " UNION ALL ".join(
    f"SELECT filing_id, ord, '{p}' AS field_path, nullif(json_extract(good, '{j}')::varchar, 'null') AS value_json, "
    f"json_extract_string(good, '$._confidence.\"{p}\"') AS conf, json_extract_string(good, '$._excerpts.\"{p}\"') AS exc "
    f"FROM {{judged_answers}} WHERE json_type(good->'data') = 'OBJECT'" for p, j in _PATHS.items()
) + "".join(f""" UNION ALL SELECT filing_id, ord, '{p}', '{v}', NULL, NULL FROM {{judged_answers}} WHERE json_type(good->'data') = 'OBJECT'"""
          for p, v in _WRITTEN.items()) + """ UNION ALL SELECT filing_id, ord, 'a.b', json_extract(txt, '$.a.b')::varchar, '2', NULL FROM {judged_answers} WHERE txt IS NOT NULL
UNION ALL SELECT filing_id, ord, 'c', json_extract(txt, '$.c')::varchar, NULL, json_extract_string(txt, '$._excerpts.c')
FROM {judged_answers} WHERE txt IS NOT NULL""" + "".join(
    f" UNION ALL SELECT filing_id, ord, {p}, {v}, {c}, NULL FROM {{judged_answers}} WHERE odd = {k}" for k, p, v, c in _ODD_FIELDS)


@query("e5_flatten_answers", "SELECT filing_id, ord, field_path, value_json FROM {flat_answers}")
def e5(spark, sf):
    return flat(spark, sf).select("filing_id", "ord", "field_path", "value_json")


@query("e6_clamp_confidence", """
SELECT filing_id, ord, field_path, value_json, CASE WHEN conf = 'true' THEN 1.0::double
  WHEN try_cast(trim(conf) AS double) IS NULL THEN CASE WHEN value_json IS NULL THEN 0 ELSE 0.5 END
  ELSE least(1, greatest(0, try_cast(trim(conf) AS double))) END
  AS confidence, substr(coalesce(exc, ''), 1, 500) AS excerpt FROM {flat_answers}""")
def e6(spark, sf):
    return ops.answer_fields(flat(spark, sf))


domain.CHECK_TABLES["merged_sections"] = """
SELECT filing_id, field_path, w.value_json AS value_json, w.confidence AS confidence, w.excerpt AS excerpt FROM (
  SELECT filing_id, field_path, list_reduce(list(struct_pack(ord := ord, confidence := coalesce(confidence, 0.5::double),
      value_json := value_json, excerpt := excerpt) ORDER BY ord),
    lambda held, new: CASE WHEN held.confidence < 0 OR new.confidence - held.confidence >= 0.15::double THEN new ELSE held END) AS w
  FROM {section_values} WHERE value_json IS NOT NULL GROUP BY 1, 2) t"""


@query("e7_merge_sections", "SELECT * FROM {merged_sections}")
def e7(spark, sf):
    return ops.merge_sections(table(spark, sf, "section_values"))


def tiers(spark, sf):
    merged = ops.merge_sections(table(spark, sf, "section_values")).withColumn(
        "confidence", ops.clamp_confidence(F.col("confidence").cast("string"), 0.5))
    return ops.registry_fields(table(spark, sf, "filings")), tier1(spark, sf), merged


domain.CHECK_TABLES["tier_rows"] = """
SELECT filing_id, field_path, value_json, confidence, excerpt, source, 0 AS rnk FROM {tier1}
UNION ALL SELECT filing_id, 'identifiers.cusip', '"' || cusip || '"', 1.0::double, 'EDGAR registry CUSIP: ' || cusip, 'registry', 1 FROM {filings}
UNION ALL SELECT filing_id, 'parties.issuer.name', '"' || issuer_name || '"', 1.0::double, 'EDGAR registry issuer: ' || issuer_name, 'registry', 1
  FROM {filings} WHERE issuer_name IS NOT NULL
UNION ALL SELECT filing_id, field_path, value_json, least(1, greatest(0, confidence)), excerpt, 'llm', 2 FROM {merged_sections}"""
domain.CHECK_TABLES["merged_tiers"] = """
SELECT filing_id, field_path, value_json, confidence, excerpt, source FROM {tier_rows}
QUALIFY row_number() OVER (PARTITION BY filing_id, field_path ORDER BY rnk) = 1"""


@query("e8_merge_tiers", "SELECT * FROM {merged_tiers}")
def e8(spark, sf):
    return ops.merge_tiers(*tiers(spark, sf))


@query("e9_tier_conflicts", """
WITH v AS (SELECT filing_id, field_path, max(value_json) FILTER (rnk = 0) AS t, max(value_json) FILTER (rnk = 1) AS r,
  max(value_json) FILTER (rnk = 2) AS m FROM {tier_rows} GROUP BY 1, 2)
SELECT filing_id, field_path, 'table_over_registry' AS kind, t AS kept, r AS dropped FROM v WHERE t <> r
UNION ALL SELECT filing_id, field_path, 'trusted_over_model', coalesce(t, r), m FROM v WHERE coalesce(t, r) <> m""")
def e9(spark, sf):
    return ops.tier_conflicts(*tiers(spark, sf))


def covered(spark, sf):
    ready, _ = ops.extractable(table(spark, sf, "filings"))
    return ops.covered_fields(ready, descriptors(spark, sf), *tiers(spark, sf)).drop("enum_values")


domain.CHECK_TABLES["ready"] = "SELECT filing_id, model FROM {filings} WHERE model IS NOT NULL AND model <> 'unknown'"
domain.CHECK_TABLES["covered"] = """
SELECT coalesce(e.filing_id, v.filing_id) AS filing_id, coalesce(e.field_path, v.field_path) AS field_path, v.value_json,
  coalesce(v.confidence, 0) AS confidence, coalesce(v.excerpt, '') AS excerpt, coalesce(v.source, 'llm') AS source,
  v.value_json IS NULL AS not_found
FROM (SELECT filing_id, field_path FROM {ready} r JOIN {descriptors} d ON r.model = d.model) e
FULL OUTER JOIN (SELECT m.* FROM {merged_tiers} m SEMI JOIN {ready} r ON m.filing_id = r.filing_id) v
ON e.filing_id = v.filing_id AND e.field_path = v.field_path"""
domain.CHECK_TABLES["validated"] = """
SELECT c.* REPLACE (CASE WHEN bad THEN 0 ELSE confidence END AS confidence),
  CASE WHEN bad THEN 'Schema violation: ''' || txt || ''' is not a valid value. Allowed: [''' || replace(enum_text, ',', ''', ''') || ''']' END
    AS validation_error, CASE WHEN bad THEN 'schema_error' ELSE 'pending' END AS review_status
FROM (SELECT c.*, enum_text, CASE WHEN value_json LIKE '"%' THEN json_extract_string(value_json, '$') WHEN value_json = 'true' THEN 'True'
    ELSE value_json END AS txt,
    coalesce(value_json IS NOT NULL AND NOT list_contains(string_split(enum_text, ','), txt), false) AS bad
  FROM {covered} c LEFT JOIN {ready} r ON c.filing_id = r.filing_id
  LEFT JOIN {descriptors} d ON r.model = d.model AND c.field_path = d.field_path) c"""


@query("e10_full_coverage", "SELECT * FROM {covered}")
def e10(spark, sf):
    return covered(spark, sf)


@query("e11_enum_validation", "SELECT * EXCLUDE (enum_text, txt, bad) FROM {validated}")
def e11(spark, sf):
    ready, _ = ops.extractable(table(spark, sf, "filings"))
    return ops.complete_fields(ready, descriptors(spark, sf), *tiers(spark, sf))


@query("e12_extraction_summary", """
SELECT filing_id, count(*) AS field_count, count(*) FILTER (NOT not_found) AS fields_found,
  count(*) FILTER (not_found) AS fields_null, 'sectioned' AS extraction_mode FROM {covered} GROUP BY 1""")
def e12(spark, sf):
    return ops.extraction_summary(covered(spark, sf), "sectioned")


@query("e13_excerpt_cut", """
SELECT doc_id, substr(text, 1, 500) AS excerpt FROM {documents}""")
def e13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, config.EXCERPT_CHARS).alias("excerpt"))


_ROUTES = ", ".join(f"('{m}', {i}, '{s}')" for m, names in config.MODEL_SECTIONS.items() for i, s in enumerate(names))
_DEFAULT_ROUTE = ", ".join(f"({i}, '{s}')" for i, s in enumerate(config.ALL_SECTIONS))


@query("e14_section_routing", f"""
WITH r AS (SELECT * FROM (VALUES {_ROUTES}) t(model, ord, section)), d AS (SELECT * FROM (VALUES {_DEFAULT_ROUTE}) t(ord, section))
SELECT filing_id, f.model, r.ord, r.section FROM {{filings}} f JOIN r ON f.model = r.model
UNION ALL SELECT filing_id, model, d.ord, d.section FROM {{filings}} f, d WHERE model IS NULL OR model NOT IN (SELECT model FROM r)""")
def e14(spark, sf):
    return ops.route_sections(table(spark, sf, "filings"))


_KEYS = ", ".join(f"('{n}', '{k}')" for n, s in config.SECTIONS.items() for k in s["schema_keys"])


@query("e15_section_schema", f"""
SELECT model, section, field_path, data_type, required FROM {{descriptors}} d
JOIN (VALUES {_KEYS}) k(section, top) ON split_part(d.field_path, '.', 1) = k.top""")
def e15(spark, sf):
    return ops.section_descriptors(descriptors(spark, sf), ops.section_table(spark))


@query("e18_classified_guard", """
SELECT filing_id, model, 'filing must be classified before extraction' AS reason FROM {filings}
WHERE model IS NULL OR model IN ('', 'unknown')""")
def e18(spark, sf):
    return ops.extractable(table(spark, sf, "filings"))[1].select("filing_id", "model", "reason")


# ---- review values and export ------------------------------------------------------------

domain.CHECK_TABLES["effective"] = """
SELECT filing_id, extraction_id, field_path, CASE WHEN review_status IS DISTINCT FROM 'rejected' THEN nullif(
    CASE WHEN json_valid(coalesce(reviewed_json, value_json)) THEN coalesce(reviewed_json, value_json)
      ELSE '"' || coalesce(reviewed_json, value_json) || '"' END, 'null') END AS value_json,
  coalesce(review_status, 'accepted') AS review_status FROM {fields}"""
domain.CHECK_TABLES["latest"] = """
SELECT * FROM {extractions} QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY extracted_at DESC, extraction_id DESC) = 1"""
domain.CHECK_TABLES["blocked"] = """
SELECT l.filing_id, string_agg(DISTINCT d.field_path, ', ' ORDER BY d.field_path) AS missing
FROM {latest} l JOIN {filings} f ON l.filing_id = f.filing_id AND f.status = 'approved'
JOIN {descriptors} d ON d.model = l.model AND d.required
LEFT JOIN {effective} e ON e.extraction_id = l.extraction_id AND e.field_path = d.field_path
WHERE e.value_json IS NULL OR e.value_json IN ('0', '""') GROUP BY 1"""


def _latest(spark, sf):
    return export.latest_extraction(table(spark, sf, "extractions"))


def _runs(spark, sf):
    """The latest runs, with no more of them than the nested export reads."""
    return export.latest_extraction(table(spark, sf, "extractions").select("extraction_id", "filing_id", "extracted_at", "model"))


def _current(spark, sf):
    return export.run_values(table(spark, sf, "fields"), _runs(spark, sf))


@query("w3_latest_extraction", "SELECT * FROM {latest}")
def w3(spark, sf):
    return _latest(spark, sf)


@query("x1_effective_value", "SELECT * FROM {effective}")
def x1(spark, sf):
    return export.effective_values(table(spark, sf, "fields"))


@query("x2_exportable", """
SELECT filing_id FROM {filings} f WHERE status = 'approved' AND filing_id IN (SELECT filing_id FROM {extractions})""")
def x2(spark, sf):
    return export.exportable(table(spark, sf, "filings"), table(spark, sf, "extractions")).select("filing_id")


@query("x3_required_gate", "SELECT filing_id, missing AS missing_paths FROM {blocked}")
def x3(spark, sf):
    runs = export.approved_runs(table(spark, sf, "filings"), table(spark, sf, "extractions"))
    return (export.missing_required(runs, table(spark, sf, "fields"), descriptors(spark, sf))
            .withColumn("missing_paths", F.array_join("missing_paths", ", ")))


def _split(spark, sf):
    return export.batch_split(table(spark, sf, "filings"), table(spark, sf, "extractions"),
                              table(spark, sf, "fields"), descriptors(spark, sf))


domain.CHECK_TABLES["exported"] = """
SELECT filing_id FROM {filings} WHERE status = 'approved' AND filing_id IN (SELECT filing_id FROM {latest})
  AND filing_id NOT IN (SELECT filing_id FROM {blocked})"""


@query("x4_batch_exported", "SELECT * FROM {exported}")
def x4(spark, sf):
    return _split(spark, sf)[0]


@query("x4_batch_failed", """
SELECT f.filing_id, CASE WHEN l.filing_id IS NULL THEN 'No extraction results found'
  ELSE 'Export blocked — required fields are null: ' || b.missing END AS reason
FROM {filings} f LEFT JOIN {latest} l ON f.filing_id = l.filing_id LEFT JOIN {blocked} b ON f.filing_id = b.filing_id
WHERE f.status = 'approved' AND (l.filing_id IS NULL OR b.filing_id IS NOT NULL)""")
def x4b(spark, sf):
    return _split(spark, sf)[1]


@query("x4_status_after", """
SELECT filing_id, CASE WHEN filing_id IN (SELECT filing_id FROM {exported}) THEN 'exported' ELSE status END AS status FROM {filings}""")
def x4c(spark, sf):
    return export.mark_exported(table(spark, sf, "filings"), _split(spark, sf)[0]).select("filing_id", "status")


_NEST = """
WITH s AS (SELECT e.filing_id, string_split(field_path, '.') AS p, e.value_json AS j FROM {effective} e
    SEMI JOIN {latest} l ON e.extraction_id = l.extraction_id WHERE e.value_json IS NOT NULL
  UNION ALL SELECT filing_id, ['model'], '"' || model || '"' FROM {latest}),
c AS (SELECT filing_id, p[1] AS a, p[2] AS b, '{{' || string_agg('"' || p[3] || '":' || j, ',' ORDER BY p[3]) || '}}' AS j
  FROM s WHERE len(p) = 3 GROUP BY 1, 2, 3),
b AS (SELECT filing_id, a, '{{' || string_agg('"' || b || '":' || j, ',' ORDER BY b) || '}}' AS j FROM (
  SELECT filing_id, p[1] AS a, p[2] AS b, j FROM s WHERE len(p) = 2 UNION ALL SELECT * FROM c) t GROUP BY 1, 2)
SELECT filing_id, '{{' || string_agg('"' || a || '":' || j, ',' ORDER BY a) || '}}' AS nested_json FROM (
  SELECT filing_id, p[1] AS a, j FROM s WHERE len(p) = 1 UNION ALL SELECT * FROM b) t GROUP BY 1"""


@query("x5_unflatten", _NEST)
def x5(spark, sf):
    return export.unflatten(_current(spark, sf), _runs(spark, sf).select("filing_id", "model"))


@query("x6_export_audit", """
SELECT filing_id, '__filing__' AS field_path, 'approved' AS old_value, 'exported' AS new_value, 'exported' AS action,
  '2001-06-15T00:00:00' AS edited_at FROM {exported}""")
def x6(spark, sf):
    return export.export_audit(_split(spark, sf)[0], domain.AS_OF)
