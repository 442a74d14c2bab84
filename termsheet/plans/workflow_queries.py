"""Classification and review workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet import config
from termsheet.operators import classify, documents, workflow as ops
from termsheet.plans import domain
from termsheet.plans.document_queries import WORDS
from termsheet.plans.domain import AS_OF, table
from termsheet.plans.label_queries import q
from termsheet.plans.registry import query

_MODELS = ", ".join(q(m) for m in config.MODELS)

_BODY = ("""'{{"confidence_score":' || CASE doc_id % 6 WHEN 4 THEN '1.7' WHEN 5 THEN CASE WHEN n % 2 = 0 THEN '0.55' ELSE '"0.65"' END """
         """ELSE '0.' || lpad(cast(60 + n % 40 AS string), 2, '0') END || ',"payout_type_id":"' || CASE doc_id % 6 WHEN 3 THEN 'legacyNote' """
         """WHEN 4 THEN 'index' ELSE 'equityShare' END || '","product_features":{{"features":["barrier"],"type":"note ' || lang || '"}},"""
         """"reasoning":"because ' || source || '","title_excerpt":"' || repeat('Note ' || lang || ' ', 60) || '"}}'""")
domain.TABLES["class_answers"] = f"""
SELECT cast(doc_id AS string) AS filing_id, 1 AS stage, CASE doc_id % 6 WHEN 1 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```'
  WHEN 2 THEN '{{{{"payout_type_id": ' ELSE {_BODY} END AS payload
FROM (SELECT *, cast(floor(doc_id / 6) AS bigint) AS n FROM {{documents}}) d""".replace("{{{{", "{{")
domain.TABLES["class_answers_2"] = """
SELECT cast(doc_id AS string) AS filing_id, 2 AS stage, '{{"confidence_score":0.' || lpad(cast(55 + doc_id % 45 AS string), 2, '0')
  || ',"payout_type_id":"depositaryReceipt","product_features":{{}},"reasoning":"second","title_excerpt":""}}' AS payload
FROM {documents} WHERE n_chars > 700"""


def _validated(name: str) -> str:
    return f"""
SELECT filing_id, stage, CASE WHEN conf >= 0.6::double AND given IN ({_MODELS}) THEN given ELSE 'unknown' END AS model, conf AS confidence,
  CASE WHEN j IS NULL THEN 'Failed to parse answer.' ELSE coalesce(json_extract_string(j, '$.reasoning'), '') END AS reasoning,
  CASE WHEN j IS NULL THEN '' ELSE substr(coalesce(json_extract_string(j, '$.title_excerpt'), ''), 1, 300) END AS title_excerpt,
  CASE WHEN j IS NULL THEN '{{{{}}}}' ELSE coalesce(json_extract(j, '$.product_features')::varchar, '{{{{}}}}') END AS product_features
FROM (SELECT *, json_extract_string(j, '$.payout_type_id') AS given, CASE WHEN j IS NULL THEN 0::double
    ELSE least(1, greatest(0, coalesce(try_cast(json_extract_string(j, '$.confidence_score') AS double), 0))) END AS conf FROM (
  SELECT filing_id, stage, CASE WHEN json_valid(p) THEN p::json END AS j FROM (
    SELECT *, replace(replace(payload, '```json' || chr(10), ''), chr(10) || '```', '') AS p FROM {{{name}}}) a) b) c"""


domain.CHECK_TABLES["stage1"] = _validated("class_answers").replace("{{{{}}}}", "{{}}")
domain.CHECK_TABLES["stage2"] = _validated("class_answers_2").replace("{{{{}}}}", "{{}}")
domain.CHECK_TABLES["stage1_with_text"] = """
SELECT s.*, t.targeted FROM {stage1} s JOIN {targeted} t ON s.filing_id = t.doc_id::varchar"""


def stage1(spark, sf):
    return classify.validate_answers(table(spark, sf, "class_answers"), config.MODELS)


def stage2(spark, sf):
    return classify.validate_answers(table(spark, sf, "class_answers_2"), config.MODELS)


def stage1_with_text(spark, sf):
    texts = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("filing_id"), documents.targeted_sections(F.col("text"), WORDS).alias("targeted"))
    return stage1(spark, sf).join(texts, "filing_id")


@query("c7_validate_answers", "SELECT * FROM {stage1}")
def c7(spark, sf):
    return stage1(spark, sf)


@query("c8_final_after_stage1", "SELECT * FROM {stage1_with_text} WHERE NOT (confidence < 0.75::double AND targeted <> '')")
def c8(spark, sf):
    return classify.escalate(stage1_with_text(spark, sf))[0]


@query("c8_escalated", "SELECT * FROM {stage1_with_text} WHERE confidence < 0.75::double AND targeted <> ''")
def c8b(spark, sf):
    return classify.escalate(stage1_with_text(spark, sf))[1]


domain.CHECK_TABLES["chosen"] = """
SELECT unnest(CASE WHEN b.confidence >= a.confidence THEN b ELSE a END) FROM (SELECT * FROM {stage1}) a
LEFT JOIN (SELECT * FROM {stage2}) b ON a.filing_id = b.filing_id"""


@query("c9_stage_choice", "SELECT * FROM {chosen}")
def c9(spark, sf):
    return classify.choose_stage(stage1(spark, sf), stage2(spark, sf))


@query("c10_gate", """
SELECT filing_id, model, confidence, CASE WHEN model = 'unknown' THEN 'needs_review' WHEN confidence >= 0.8::double THEN 'classified'
  ELSE 'needs_classification_review' END AS status, confidence < 0.75::double AS low_confidence FROM {chosen}""")
def c10(spark, sf):
    return classify.gate(classify.choose_stage(stage1(spark, sf), stage2(spark, sf))).select(
        "filing_id", "model", "confidence", "status", "low_confidence")


@query("c11_low_confidence", """
SELECT low_confidence, count(*) AS filings FROM (SELECT confidence < 0.75::double AS low_confidence FROM {stage1}) t GROUP BY 1""")
def c11(spark, sf):
    return classify.gate(stage1(spark, sf)).groupBy("low_confidence").agg(F.count("*").alias("filings"))


# Model entries with and without classification hints, built from part names.
domain.TABLES["model_entries"] = """
SELECT model, ord, CASE WHEN ord % 4 = 0 THEN '{{"description":"plain ' || model || '"}}'
  WHEN ord % 4 = 1 THEN '{{"description":"unused","classificationHints":{{"description":"' || first_name || '","discriminating_features":["' || names
    || '","f2","f3","f4","f5"],"counter_indicators":["' || last_name || '","c2","c3","c4"],"title_keywords":["t1","t2","t3","t4","t5","t6","t7"]}}}}'
  WHEN ord % 4 = 2 THEN '{{"classificationHints":{{"title_keywords":["' || first_name || '"],"counter_indicators":[]}}}}'
  ELSE '{{"classificationHints":{{}}}}' END AS entry_json, first_name, last_name, names
FROM (SELECT p_type || ' ' || p_brand AS model, min(p_partkey) AS ord, min(p_name) AS first_name, max(p_name) AS last_name,
  min(p_name) || ' to ' || max(p_name) AS names FROM {part} GROUP BY p_type || ' ' || p_brand) t"""
domain.CHECK_TABLES["described"] = """
SELECT model, ord, CASE ord % 4 WHEN 0 THEN 'plain ' || model
  WHEN 1 THEN first_name || ' | Key features: ' || names || '; f2; f3; f4. | Not this model if: ' || last_name
    || '; c2; c3. | Typical title terms: t1, t2, t3, t4, t5, t6.'
  WHEN 2 THEN 'Typical title terms: ' || first_name || '.' ELSE '' END AS description FROM {model_entries}"""


def described(spark, sf):
    entries = table(spark, sf, "model_entries").select("model", "ord", F.parse_json("entry_json").alias("entry"))
    return classify.model_descriptions(entries)


@query("c1_model_descriptions", "SELECT * FROM {described}")
def c1(spark, sf):
    return described(spark, sf)


domain.CHECK_TABLES["model_text"] = f"""
SELECT string_agg('  - ' || model || CASE WHEN description <> '' THEN '  — ' || description ELSE '' END, chr(10) ORDER BY ord)
  || chr(10) || {q(classify.UNKNOWN_LINE)} AS model_list FROM {{described}}"""


@query("c1_model_list", "SELECT * FROM {model_text}")
def c1b(spark, sf):
    return classify.model_list(described(spark, sf))


domain.TABLES["feedback"] = """
SELECT lpad(cast(doc_id AS string), 12, '0') AS feedback_id, cast(doc_id AS string) AS filing_id,
  CASE quality WHEN 1 THEN 'equityShare' ELSE 'unknown' END AS original_model,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 1 THEN 'index' ELSE 'depositaryReceipt' END AS corrected_model,
  CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE 'reason ' || cast(doc_id AS string) END AS reason,
  '2024-01-' || lpad(cast(doc_id % 28 + 1 AS string), 2, '0') AS corrected_at, doc_id % 3 = 0 AS used_as_example FROM {labels}"""
domain.CHECK_TABLES["examples"] = """
SELECT b.*, f.cusip FROM (SELECT * FROM {feedback} WHERE NOT used_as_example AND corrected_model IS NOT NULL
  ORDER BY corrected_at DESC, feedback_id DESC LIMIT 3) b LEFT JOIN {filings} f ON b.filing_id = f.filing_id"""


def examples(spark, sf):
    return classify.few_shot(table(spark, sf, "feedback"), table(spark, sf, "filings"))


@query("c2_few_shot", "SELECT * FROM {examples}")
def c2(spark, sf):
    return examples(spark, sf)


@query("c2_few_shot_block", """
SELECT '## Recent corrections' || chr(10) || string_agg('- ' || coalesce('CUSIP ' || cusip || ' | ', '') || 'Predicted: ' || original_model
  || ' | Corrected: ' || corrected_model || CASE WHEN coalesce(reason, '') <> '' THEN ' | Reason: ' || reason ELSE '' END, chr(10)
  ORDER BY corrected_at DESC, feedback_id DESC) || chr(10) AS few_shot_block FROM {examples}""")
def c2b(spark, sf):
    return classify.few_shot_block(examples(spark, sf))


@query("c3_mark_used", """
SELECT * REPLACE (used_as_example OR feedback_id IN (SELECT feedback_id FROM {examples}) AS used_as_example) FROM {feedback}""")
def c3(spark, sf):
    return classify.mark_used(table(spark, sf, "feedback"), examples(spark, sf))


domain.TABLES["cusip_map"] = """
SELECT 'Q' || lpad(cast(c_custkey AS string), 8, '0') AS cusip, CASE c_custkey % 4 WHEN 0 THEN 'equityShare' WHEN 1 THEN 'index'
  WHEN 2 THEN 'retiredNote' ELSE 'unlistedNote' END AS model,
  CASE c_custkey % 3 WHEN 0 THEN 'https://docs.example.com/m' || cast(c_custkey AS string) || '.htm'
    WHEN 1 THEN 'https://docs.example.com/m' || cast(c_custkey AS string) || '.pdf' ELSE '' END AS source_url
FROM {customer} WHERE c_acctbal > 1000"""


def hinted(spark, sf):
    return classify.cusip_hints(table(spark, sf, "filings"), table(spark, sf, "cusip_map"), config.MODELS)


domain.CHECK_TABLES["hinted"] = f"""
SELECT filing_id, f.cusip, m.model AS cusip_hint, coalesce(m.model IN ({_MODELS}), false) AS hint_in_schema,
  CASE WHEN m.model IS NULL THEN '' WHEN m.model IN ({_MODELS}) THEN 'A mapping file links this CUSIP to ' || m.model || '; treat it as weak background only.'
    ELSE 'A mapping file links this CUSIP to ' || m.model || ', which is not a listed model; ignore it.' END
    || CASE WHEN m.model IS NULL THEN '' ELSE chr(10) END AS hint_text
FROM {{filings}} f LEFT JOIN {{cusip_map}} m ON upper(f.cusip) = m.cusip"""


@query("c4_cusip_hint", "SELECT * FROM {hinted}")
def c4(spark, sf):
    return hinted(spark, sf).select("filing_id", "cusip", "cusip_hint", "hint_in_schema", "hint_text")


def _covers(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("filing_id"), F.substring("text", 1, config.COVER_CHARS).alias("cover"))
    return docs.join(hinted(spark, sf).select("filing_id", "hint_text"), "filing_id")


@query("c5_stage1_requests", """
SELECT d.doc_id::varchar AS filing_id, 'Classify this filing as one of the models below.' || chr(10) || hint_text || chr(10) || 'Models:' || chr(10)
  || (SELECT model_list FROM {model_text}) || chr(10) || chr(10) || 'Answer as JSON: payout_type_id, confidence_score, reasoning, title_excerpt, product_features.'
  || chr(10) || chr(10) || 'COVER:' || chr(10) || substr(text, 1, 4000) || chr(10) AS prompt
FROM {documents} d JOIN {hinted} h ON h.filing_id = d.doc_id::varchar""")
def c5(spark, sf):
    return classify.stage1_requests(_covers(spark, sf), classify.model_list(described(spark, sf)).scalar())


@query("c6_stage2_requests", """
SELECT s.filing_id, 'A first pass on the cover was not conclusive.' || chr(10) || hint_text || CASE WHEN product_features = '{{}}' THEN '' ELSE
  'Cover: type=' || (product_features->>'$.type') || ', features=' || (product_features->'$.features')::varchar || ', underlyings=[]. Reasoning: '
    || reasoning || chr(10) END || chr(10) || 'Models:' || chr(10) || (SELECT model_list FROM {model_text}) || chr(10) || chr(10)
  || 'Answer as JSON: payout_type_id, confidence_score, reasoning, title_excerpt, product_features.' || chr(10) || chr(10) || 'COVER:' || chr(10)
  || substr(text, 1, 4000) || chr(10) || chr(10) || 'SECTIONS:' || chr(10) || targeted || chr(10) AS prompt
FROM {stage1_with_text} s JOIN {documents} d ON s.filing_id = d.doc_id::varchar JOIN {hinted} h ON h.filing_id = s.filing_id
WHERE confidence < 0.75::double AND targeted <> ''""")
def c6(spark, sf):
    again = classify.escalate(stage1_with_text(spark, sf))[1].join(_covers(spark, sf), "filing_id")
    return classify.stage2_requests(again, classify.model_list(described(spark, sf)).scalar())


# ---- workflow ----------------------------------------------------------------------------

domain.TABLES["actions"] = """
SELECT CASE WHEN event_id % 53 = 0 THEN 'none-' ELSE '' END || cast(user_id AS string) AS filing_id, event_id AS seq,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE CASE event_id % 12 WHEN 0 THEN 'confirm' WHEN 1 THEN 'override' WHEN 2 THEN 'reset' WHEN 3 THEN 'extract' WHEN 4 THEN 'reextract'
    WHEN 5 THEN 'finish' WHEN 6 THEN 'fail' WHEN 7 THEN 'approve' WHEN 8 THEN 'unapprove' WHEN 9 THEN 'export' WHEN 10 THEN 'finish'
    ELSE 'archive' END END AS action,
  CASE cast(floor(event_id / 12) AS bigint) % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'legacyNote' WHEN 2 THEN '' ELSE 'equityShare' END AS model,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE 'why ' || event_type END AS reason
FROM {events}"""
# The same rules replayed one action at a time.
_LOW, _WRONG = "'classification confidence is below the gate'", "'not allowed from ' || s.status"
_TARGET = "coalesce(nullif(a.model, ''), s.model, 'unknown')"
domain.CHECK_TABLES["numbered_actions"] = """
SELECT a.*, row_number() OVER (PARTITION BY filing_id ORDER BY seq) AS n FROM {actions} a SEMI JOIN {filings} f ON a.filing_id = f.filing_id"""
_REPLAY = f"""
WITH RECURSIVE r AS (
  SELECT filing_id, 0::bigint AS n, -1::bigint AS seq, '' AS action, NULL::varchar AS reason, status AS old_status, status,
    model AS old_model, model, confidence FROM {{filings}}
  UNION ALL
  SELECT x.filing_id, x.n, x.seq, x.action, x.reason, x.st AS old_status,
    CASE WHEN x.action = 'reextract' THEN CASE WHEN x.reason IS NULL THEN 'extracting' ELSE 'classified' END WHEN x.reason IS NOT NULL THEN x.st
      ELSE CASE x.action WHEN 'confirm' THEN 'classified' WHEN 'override' THEN CASE WHEN x.st = 'extracted' THEN 'extracted' ELSE 'classified' END
        WHEN 'reset' THEN 'ingested' WHEN 'extract' THEN 'extracting' WHEN 'finish' THEN 'extracted' WHEN 'fail' THEN 'classified'
        WHEN 'approve' THEN 'approved' WHEN 'unapprove' THEN 'extracted' ELSE 'exported' END END AS status,
    x.mo AS old_model,
    CASE WHEN x.reason IS NOT NULL THEN x.mo WHEN x.action = 'confirm' THEN x.target WHEN x.action = 'override' THEN x.arg
      WHEN x.action = 'reset' THEN NULL ELSE x.mo END AS model,
    CASE WHEN x.reason IS NOT NULL THEN x.confidence WHEN x.action IN ('confirm', 'override') THEN 1 WHEN x.action = 'reset' THEN NULL
      ELSE x.confidence END AS confidence
  FROM (SELECT s.filing_id, a.n, a.seq, a.action, a.model AS arg, s.status AS st, s.model AS mo, s.confidence, {_TARGET} AS target,
    CASE a.action
      WHEN 'confirm' THEN CASE WHEN s.status <> 'needs_classification_review' THEN {_WRONG}
        WHEN {_TARGET} NOT IN ({_MODELS}, 'unknown') THEN 'unknown model ' || {_TARGET} END
      WHEN 'override' THEN CASE WHEN s.status IN ('approved', 'exported') THEN {_WRONG} END
      WHEN 'reset' THEN CASE WHEN s.status IN ('extracted', 'approved', 'exported') THEN {_WRONG} END
      WHEN 'extract' THEN CASE WHEN s.status = 'extracting' THEN 'extraction already in progress'
        WHEN s.status NOT IN ('classified', 'needs_review', 'extracted') THEN {_WRONG}
        WHEN coalesce(s.confidence, 0) < 0.8::double AND s.status <> 'extracted' THEN {_LOW} END
      WHEN 'reextract' THEN CASE WHEN coalesce(s.confidence, 0) < 0.8::double THEN {_LOW} END
      WHEN 'finish' THEN CASE WHEN s.status <> 'extracting' THEN {_WRONG} END
      WHEN 'fail' THEN CASE WHEN s.status <> 'extracting' THEN {_WRONG} END
      WHEN 'approve' THEN CASE WHEN s.status NOT IN ('extracted', 'needs_review') THEN {_WRONG} END
      WHEN 'unapprove' THEN CASE WHEN s.status <> 'approved' THEN {_WRONG} END
      WHEN 'export' THEN CASE WHEN s.status <> 'approved' THEN {_WRONG} END
      ELSE 'no such action ' || coalesce(a.action, 'null') END AS reason
    FROM r s JOIN {{numbered_actions}} a ON s.filing_id = a.filing_id AND a.n = s.n + 1) x),
out AS (SELECT filing_id, seq, action, reason, old_status, status AS new_status, old_model, model AS new_model FROM r WHERE n > 0
  UNION ALL SELECT filing_id, seq, action, 'filing not found', NULL, NULL, NULL, NULL FROM {{actions}} a
  WHERE filing_id NOT IN (SELECT filing_id FROM {{filings}}))
"""


def acted(spark, sf):
    return ops.apply_actions(table(spark, sf, "filings"), table(spark, sf, "actions").drop("reason"))


@query("w0_action_outcomes", _REPLAY + "SELECT * FROM out")
def w0(spark, sf):
    return acted(spark, sf)[1]


@query("w0_filing_states", _REPLAY + """
SELECT filing_id, arg_max(status, n) AS status, arg_max_null(model, n) AS model, arg_max_null(confidence, n) AS confidence FROM r GROUP BY 1""")
def w0b(spark, sf):
    return acted(spark, sf)[0].select("filing_id", "status", "model", "confidence")


@query("w0_filing_states_in_slices", _REPLAY + """
SELECT filing_id, arg_max(status, n) AS status, arg_max_null(model, n) AS model, arg_max_null(confidence, n) AS confidence FROM r GROUP BY 1""")
def w0c(spark, sf):
    todo = table(spark, sf, "actions").drop("reason")
    moved, _ = ops.apply_actions(table(spark, sf, "filings"), todo, block=3, stretch=700)
    return moved.select("filing_id", "status", "model", "confidence")


@query("w1_extraction_gate", _REPLAY + "SELECT * FROM out WHERE action = 'extract'")
def w1(spark, sf):
    return acted(spark, sf)[1].filter("action = 'extract'")


@query("w2_reextract_results", _REPLAY + """
SELECT extraction_id, filing_id FROM {extractions} WHERE filing_id NOT IN (
  SELECT filing_id FROM out WHERE action = 'reextract' AND old_status IS NOT NULL)""")
def w2(spark, sf):
    return ops.drop_results(table(spark, sf, "extractions"), acted(spark, sf)[1]).select("extraction_id", "filing_id")


@query("c12_c13_feedback_rows", _REPLAY + f"""
SELECT o.filing_id, o.seq, coalesce(old_model, 'unknown') AS original_model, new_model AS corrected_model,
  CASE o.action WHEN 'confirm' THEN 'human confirmation via classification review gate'
    ELSE coalesce(nullif(a.reason, ''), 'manual override via UI') END AS reason, '{AS_OF}' AS corrected_at
FROM out o JOIN {{actions}} a ON o.filing_id = a.filing_id AND o.seq = a.seq WHERE o.reason IS NULL AND o.action IN ('confirm', 'override')""")
def c12(spark, sf):
    return ops.feedback_rows(acted(spark, sf)[1], table(spark, sf, "actions"), AS_OF)


@query("c14_reset", _REPLAY + "SELECT * FROM out WHERE action = 'reset'")
def c14(spark, sf):
    return acted(spark, sf)[1].filter("action = 'reset'")


@query("w6_filing_audit", _REPLAY + f"""
SELECT filing_id, seq, '__filing__' AS field_path, CASE action WHEN 'approve' THEN 'extracted' ELSE 'approved' END AS old_value,
  CASE action WHEN 'approve' THEN 'approved' WHEN 'unapprove' THEN 'extracted' ELSE 'exported' END AS new_value,
  CASE action WHEN 'approve' THEN 'approved' WHEN 'unapprove' THEN 'unapproved' ELSE 'exported' END AS action, '{AS_OF}' AS edited_at
FROM out WHERE reason IS NULL AND action IN ('approve', 'unapprove', 'export')""")
def w6(spark, sf):
    return ops.filing_audit(acted(spark, sf)[1], AS_OF)


@query("w6_accept_pending", """
SELECT field_id, CASE WHEN hit AND review_status = 'pending' THEN 'accepted' ELSE review_status END AS review_status,
  CASE WHEN hit AND review_status = 'pending' THEN '2001-06-15T00:00:00' ELSE reviewed_at END AS reviewed_at
FROM (SELECT f.*, f.extraction_id IN (SELECT extraction_id FROM {latest} WHERE filing_id IN (
  SELECT filing_id FROM {filings} WHERE status = 'approved')) AS hit FROM {fields} f) t""")
def w6b(spark, sf):
    approved = table(spark, sf, "filings").filter("status = 'approved'")
    return ops.accept_pending(table(spark, sf, "fields"), table(spark, sf, "extractions"), approved, AS_OF).select(
        "field_id", "review_status", "reviewed_at")


def _decoded(c: str) -> str:
    return f"nullif(CASE WHEN json_valid({c}) THEN {c} ELSE '\"' || {c} || '\"' END, 'null')"


@query("w4_field_view", f"""
SELECT field_id, field_path, {_decoded('value_json')} AS value_json, confidence, not_found, {_decoded('reviewed_json')} AS reviewed_json,
  coalesce(review_status, 'pending') AS review_status, coalesce(nullif(confidence, 0), 1) < 0.8::double AS low_confidence,
  coalesce(source, 'llm') AS source FROM {{fields}}""")
def w4(spark, sf):
    return ops.field_view(table(spark, sf, "fields").withColumn("confidence", F.col("confidence") + F.lit(0.0)))


domain.TABLES["reviews"] = """
SELECT cast(l_orderkey AS string) AS filing_id,
  CASE WHEN l_suppkey % 29 = 0 THEN 'x' ELSE '' END || cast(l_orderkey AS string) || '-' || cast(l_linenumber % 2 AS string) || '-' ||
  CASE l_partkey % 3 WHEN 0 THEN 'coupon.rate' WHEN 1 THEN 'identifiers.cusip' ELSE 'parties.issuer.name' END AS field_id,
  (cast(l_linenumber AS bigint) * 1000000 + l_partkey) * 10000 + l_suppkey AS seq,
  CASE l_suppkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rejected' WHEN 3 THEN 'pending' ELSE CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'accepted' END END AS review_status,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE '"' || l_returnflag || cast(l_suppkey AS string) || '"' END AS reviewed_json,
  cast(cast(l_shipdate AS date) AS string) AS reviewed_at
FROM {lineitem}"""
_REVIEWED = """
WITH j AS (SELECT r.*, f.field_path, f.value_json, f.reviewed_json AS first_reviewed, CASE
    WHEN coalesce(r.review_status, '') NOT IN ('accepted', 'corrected', 'rejected') THEN 'review_status must be accepted | corrected | rejected'
    WHEN f.filing_id IS NULL OR f.filing_id <> r.filing_id THEN 'field result not found' END AS problem
  FROM {reviews} r LEFT JOIN {fields} f ON r.field_id = f.field_id),
g AS (SELECT *, coalesce(reviewed_json, value_json) AS new_value, lag(1) OVER w AS has, lag(coalesce(reviewed_json, value_json)) OVER w AS before
  FROM j WHERE problem IS NULL WINDOW w AS (PARTITION BY field_id ORDER BY seq))
"""


def _reviewed(spark, sf):
    return ops.review_fields(table(spark, sf, "fields"), table(spark, sf, "reviews"))


@query("w5_reviewed_fields", _REVIEWED + """
SELECT f.field_id, CASE WHEN l.field_id IS NULL THEN f.reviewed_json ELSE l.new_value END AS reviewed_json,
  coalesce(l.review_status, f.review_status) AS review_status, CASE WHEN l.field_id IS NULL THEN f.reviewed_at ELSE l.reviewed_at END AS reviewed_at
FROM {fields} f LEFT JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY seq DESC) = 1) l ON f.field_id = l.field_id""")
def w5(spark, sf):
    return _reviewed(spark, sf)[0].select("field_id", "reviewed_json", "review_status", "reviewed_at")


@query("w5_review_audit", _REVIEWED + """
SELECT filing_id, field_path, seq, CASE WHEN has = 1 THEN before ELSE first_reviewed END AS old_value, new_value, review_status AS action,
  reviewed_at AS edited_at FROM g""")
def w5b(spark, sf):
    return _reviewed(spark, sf)[1]


@query("w5_rejected_reviews", _REVIEWED + "SELECT field_id, seq, problem AS reason FROM j WHERE problem IS NOT NULL")
def w5c(spark, sf):
    return _reviewed(spark, sf)[2]


@query("w7_list_filings", """
SELECT filing_id, cusip, status, model, ingest_timestamp, CASE WHEN json_valid(product_features) THEN product_features::json->>'$.type' END AS feature_type
FROM {filings} WHERE status = 'extracted' AND model = 'equityShare'""")
def w7(spark, sf):
    rows = ops.list_filings(table(spark, sf, "filings"), status="extracted", model="equityShare")
    return rows.select("filing_id", "cusip", "status", "model", "ingest_timestamp",
                       F.get_json_object("product_features", "$.type").alias("feature_type"))


@query("w8_issuer_facets", "SELECT DISTINCT issuer_name FROM {filings} WHERE issuer_name <> ''")
def w8(spark, sf):
    return ops.facets(table(spark, sf, "filings"), "issuer_name")


@query("w8_search_filings", """
SELECT filing_id, cusip FROM {filings} WHERE status = 'approved' AND issuer_name = 'UBS AG' AND contains(lower(cusip), 'q0000')""")
def w8b(spark, sf):
    return ops.search_filings(table(spark, sf, "filings"), "approved", "UBS AG", "", "Q0000").select("filing_id", "cusip")


@query("w9_field_stats", """
SELECT extraction_id, count(*) AS total, count(*) FILTER (NOT not_found) AS found,
  count(*) FILTER (NOT not_found AND coalesce(nullif(confidence, 0), 1) < 0.8::double) AS low_confidence,
  count(*) FILTER (review_status IN ('accepted', 'corrected')) AS reviewed FROM {fields} GROUP BY 1""")
def w9(spark, sf):
    return ops.field_stats(table(spark, sf, "fields"))


@query("w9_filter_fields", "SELECT field_id FROM {fields} WHERE contains(lower(field_path), 'issuer') AND NOT not_found")
def w9b(spark, sf):
    return ops.filter_fields(table(spark, sf, "fields"), "Issuer", True).select("field_id")


@query("w10_delete_cascade", """
SELECT 'fields' AS t, count(*) AS n FROM {fields} WHERE filing_id NOT IN (SELECT filing_id FROM {filings} WHERE status = 'needs_review')
UNION ALL SELECT 'extractions', count(*) FROM {extractions} WHERE filing_id NOT IN (SELECT filing_id FROM {filings} WHERE status = 'needs_review')
UNION ALL SELECT 'filings', count(*) FROM {filings} WHERE status <> 'needs_review'""")
def w10(spark, sf):
    filings = table(spark, sf, "filings")
    names = ["fields", "extractions", "filings"]
    kept = ops.delete_filings(filings.filter("status = 'needs_review'"), *[table(spark, sf, n) for n in names])
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, t in zip(names, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("w11_lookup", "SELECT field_id, value_json FROM {fields} WHERE filing_id = '7'")
def w11(spark, sf):
    return ops.lookup(table(spark, sf, "fields"), filing_id="7").select("field_id", "value_json")
