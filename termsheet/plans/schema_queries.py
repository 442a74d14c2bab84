"""Schema documents, schema differences, logs and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet.functions.text import json_string
from termsheet.operators import logs, runs, schemas as ops, usage
from termsheet.operators.extract import parser_registry
from termsheet.plans import domain
from termsheet.plans.domain import table
from termsheet.plans.extract_queries import descriptors
from termsheet.plans.registry import query

# One schema document per brand: models, nested objects and seven kinds of leaf.
domain.TABLES["schema_fields"] = """
SELECT doc_id, model, top, leaf, min(label) AS label, min(p_size) % 7 AS kind, min(p_size) % 2 = 0 AS required,
  max(p_name) || ' of ' || top AS description, min(p_type) AS word
FROM (SELECT *, p_brand AS doc_id, 'note' || cast(p_partkey % 3 AS string) AS model, lower(p_type) AS top,
    split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS leaf,
    upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1))
      || substr(split_part(p_name, ' ', 2), 2) AS label FROM {part}) t
GROUP BY doc_id, model, top, leaf"""

_DEFS = ('"linked":{"$ref":"#/$defs/choice","description":"sibling text"},'
         '"choice":{"type":"string","oneOf":[{"const":"a"},{"$ref":"#/$defs/other"},{"properties":{"$type":{"const":"t"}}}]},'
         '"other":{"const":"b"},"row":{"type":"object","required":["when"],"properties":{"amount":{"type":"number"},'
         '"when":{"type":"string","description":"day"}}}')


_FAR = '"far":{"$ref":"#/$defs/row/properties/when"}'
_DEEP = '"deep":' + "".join(f'{{"type":"object","properties":{{"n{i}":' for i in range(1, 15)) + '{"type":"number","description":"down"}' + "}}" * 14


def schema_json(spark, sf):
    """(doc_id, json): the schema text a product-schema file would hold."""
    text = json_string(F.col("description"))
    kinds = [
        F.concat(F.lit('{"type":"string","description":'), text, F.lit(',"enum":["x",'), json_string(F.col("word")), F.lit(']}')),
        F.concat(F.lit('{"type":"number","description":'), text, F.lit("}")),
        F.concat(F.lit('{"type":"boolean","description":'), text, F.lit(',"const":true}')),
        F.concat(F.lit('{"type":"array","description":'), text, F.lit(',"items":{"type":"string","enum":["x","y"]}}')),
        F.concat(F.lit('{"type":"object","description":'), text, F.lit(',"patternProperties":{"^U":{"type":"number"}}}')),
        F.lit('{"$ref":"#/$defs/linked"}'),
        F.concat(F.lit('{"type":"array","description":'), text, F.lit(',"items":{"$ref":"#/$defs/row"}}'))]
    node = F.coalesce(*[F.when(F.col("kind") == i, k) for i, k in enumerate(kinds)])

    def joined(key, value):
        rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.concat(json_string(key), F.lit(":"), value).alias("v"))))
        return F.array_join(F.transform(rows, lambda r: r["v"]), ",")

    leaves = table(spark, sf, "schema_fields").withColumn("node", node)
    tops = leaves.groupBy("doc_id", "model", "top").agg(
        joined(F.col("leaf"), F.col("node")).alias("props"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("required"), json_string(F.col("leaf"))))), ",").alias("req"))
    body = F.concat(F.lit('{"type":"object","required":['), F.col("req"), F.lit('],"properties":{'), F.col("props"), F.lit("}}"))
    models = tops.groupBy("doc_id", "model").agg(joined(F.col("top"), body).alias("props"))
    entry = F.concat(F.lit('{"type":"object","required":["noteId"],"properties":{"model":{"const":'), json_string(F.col("model")),
                     F.lit('},"noteId":{"type":"string","description":"id"},' + _FAR + "," + _DEEP + ","), F.col("props"), F.lit("}}"))
    docs = models.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("model", entry.alias("e")))), lambda r: r["e"]), ",").alias("entries"))
    return docs.select("doc_id", F.concat(F.lit('{"$id":"https://schemas.example.com/notes.v'), F.length("doc_id").cast("string"),
                       F.lit('.schema.json","$defs":{' + _DEFS + '},"oneOf":['), F.col("entries"), F.lit("]}")).alias("json"))


def docs(spark, sf):
    return ops.documents(schema_json(spark, sf))


domain.CHECK_TABLES["note_ids"] = """
SELECT DISTINCT doc_id, model, 'noteId' AS field_path, 'Note Id' AS label, 'string' AS data_type, 'id' AS description,
  true AS required, '' AS enum_values FROM {schema_fields} UNION ALL
SELECT DISTINCT doc_id, model, 'far', 'Far', 'string', 'day', false, '' FROM {schema_fields}"""
_DEEP_ROW = """ UNION ALL SELECT DISTINCT doc_id, model, 'deep.""" + ".".join(f"n{i}" for i in range(1, 15)) + """', 'number', 'down', false, '', false
FROM {schema_fields}"""


@query("s13_descriptors", """
SELECT * FROM {note_ids} UNION ALL
SELECT doc_id, model, top || '.' || leaf, label, CASE kind WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'array' WHEN 4 THEN 'object'
    WHEN 6 THEN 'array' ELSE 'string' END, CASE kind WHEN 5 THEN 'sibling text' ELSE description END, required,
  CASE kind WHEN 0 THEN 'x,' || word WHEN 2 THEN 'True' WHEN 5 THEN 'a,b' ELSE '' END FROM {schema_fields}""")
def s13(spark, sf):
    return ops.descriptors(docs(spark, sf)).withColumn("enum_values", F.array_join("enum_values", ","))


@query("s14_models", "SELECT doc_id, model, 'v' || length(doc_id) AS schema_version FROM (SELECT DISTINCT doc_id, model FROM {schema_fields}) t")
def s14(spark, sf):
    d = docs(spark, sf)
    return ops.model_entries(d).select("doc_id", "model").join(
        ops.schema_versions(d).select("doc_id", "schema_version"), "doc_id")


@query("d1_diff_fields", """
SELECT doc_id, model, field_path, data_type, description, required, enum_values, false AS is_dynamic FROM {note_ids} UNION ALL
SELECT doc_id, model, top || '.' || leaf, CASE kind WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'array'
    WHEN 4 THEN 'object(dynamic)' ELSE 'string' END, CASE kind WHEN 5 THEN 'sibling text' ELSE description END, required,
  CASE kind WHEN 0 THEN 'x,' || word WHEN 2 THEN 'True' WHEN 3 THEN 'x,y' WHEN 5 THEN 'a,t' ELSE '' END, kind = 4
FROM {schema_fields} WHERE kind <> 6 UNION ALL
SELECT doc_id, model, top || '.' || leaf || '[*].' || m.name, m.kind, m.about, m.req, '', false FROM {schema_fields} JOIN (VALUES
  ('amount', 'number', '', false), ('when', 'string', 'day', true)) m(name, kind, about, req) ON true WHERE schema_fields.kind = 6""" + _DEEP_ROW)
def d1(spark, sf):
    return ops.diff_fields(docs(spark, sf)).withColumn("enum_values", F.array_join("enum_values", ","))


# A second version of the descriptor table: fields dropped, renamed, retyped and re-described.
domain.TABLES["descriptors_new"] = """
SELECT CASE WHEN model = 'depositaryReceipt' THEN 'basketNote' ELSE model END AS model,
  CASE WHEN length(field_path) % 5 = 0 THEN replace(field_path, '.', '.new_') ELSE field_path END AS field_path, label,
  CASE WHEN length(field_path) % 7 = 0 THEN 'number' ELSE data_type END AS data_type,
  CASE WHEN length(field_path) % 3 = 0 THEN description || ' in full' ELSE description END AS description,
  CASE WHEN length(field_path) % 11 = 0 THEN NOT required ELSE required END AS required,
  CASE WHEN length(field_path) % 4 = 0 THEN 'A,extra' ELSE enum_text END AS enum_text
FROM {descriptors} WHERE length(field_path) % 13 <> 0"""


def versions(spark, sf):
    new = table(spark, sf, "descriptors_new")
    new = new.withColumn("enum_values", F.split("enum_text", ",")).drop("enum_text")
    fill = {"enum_values": F.coalesce("enum_values", F.array().cast("array<string>"))}
    return descriptors(spark, sf).withColumns(fill), new.withColumns(fill)


domain.CHECK_TABLES["model_status"] = """
SELECT coalesce(o.model, n.model) AS model, CASE WHEN o.model IS NULL THEN 'new' WHEN n.model IS NULL THEN 'removed' ELSE 'common' END AS status
FROM (SELECT DISTINCT model FROM {descriptors}) o FULL OUTER JOIN (SELECT DISTINCT model FROM {descriptors_new}) n ON o.model = n.model"""
domain.CHECK_TABLES["both_versions"] = """
SELECT coalesce(o.model, n.model) AS model, coalesce(o.field_path, n.field_path) AS field_path, m.status, o.model IS NOT NULL AS was,
  n.model IS NOT NULL AS now, o.data_type AS ot, n.data_type AS nt, o.description AS od, n.description AS nd, o.required AS orq, n.required AS nrq,
  coalesce(string_split(o.enum_text, ','), []) AS oe, coalesce(string_split(n.enum_text, ','), []) AS ne
FROM {descriptors} o FULL OUTER JOIN {descriptors_new} n ON o.model = n.model AND o.field_path = n.field_path
JOIN {model_status} m ON m.model = coalesce(o.model, n.model)"""
domain.CHECK_TABLES["changes"] = """
SELECT model, field_path, 'added' AS change, CASE WHEN status = 'common' AND nrq THEN 'breaking' ELSE 'safe' END AS severity, nt AS detail
  FROM {both_versions} WHERE NOT was
UNION ALL SELECT model, field_path, 'removed', 'breaking', ot FROM {both_versions} WHERE NOT now AND status = 'common'
UNION ALL SELECT model, field_path, 'type_changed', 'breaking', ot || ' -> ' || nt FROM {both_versions} WHERE was AND now AND ot <> nt
UNION ALL SELECT model, field_path, 'enum_removed', 'breaking', array_to_string(list_sort(list_filter(oe, lambda x: NOT list_contains(ne, x))), ',')
  FROM {both_versions} WHERE was AND now AND len(list_filter(oe, lambda x: NOT list_contains(ne, x))) > 0
UNION ALL SELECT model, field_path, 'enum_added', 'safe', array_to_string(list_sort(list_filter(ne, lambda x: NOT list_contains(oe, x))), ',')
  FROM {both_versions} WHERE was AND now AND len(list_filter(ne, lambda x: NOT list_contains(oe, x))) > 0
UNION ALL SELECT model, field_path, CASE WHEN nrq THEN 'required_added' ELSE 'required_removed' END, CASE WHEN nrq THEN 'breaking' ELSE 'caution' END, NULL
  FROM {both_versions} WHERE was AND now AND orq <> nrq
UNION ALL SELECT model, field_path, 'desc_changed', CASE WHEN nrq THEN 'caution' ELSE 'safe' END, substr(nd, 1, 120)
  FROM {both_versions} WHERE was AND now AND od <> nd"""
domain.CHECK_TABLES["changed_models"] = """
SELECT m.model, CASE m.status WHEN 'common' THEN 'changed' ELSE m.status END AS status, CASE m.status WHEN 'removed' THEN 'breaking' WHEN 'new' THEN 'safe'
  ELSE CASE max(CASE severity WHEN 'breaking' THEN 2 WHEN 'caution' THEN 1 ELSE 0 END) WHEN 2 THEN 'breaking' WHEN 1 THEN 'caution' ELSE 'safe' END END AS severity
FROM {model_status} m LEFT JOIN {changes} c ON m.model = c.model GROUP BY m.model, m.status HAVING m.status <> 'common' OR count(c.change) > 0"""

domain.TABLES["definitions_old"] = """
SELECT p_type || ' ' || p_brand AS name, '{{"b":1,"a":"' || min(p_name) || '"}}' AS json FROM {part} WHERE p_size % 8 <> 1 GROUP BY p_type || ' ' || p_brand"""
domain.TABLES["definitions_new"] = """
SELECT p_type || ' ' || p_brand AS name, '{{ "a": "' || min(CASE WHEN p_size % 8 = 5 THEN p_name || '!' ELSE p_name END) || '", "b": 1 }}' AS json
FROM {part} WHERE p_size % 8 <> 2 GROUP BY p_type || ' ' || p_brand"""
domain.CHECK_TABLES["def_changes"] = """
SELECT * FROM (SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NULL THEN 'removed' WHEN o.name IS NULL THEN 'added'
  WHEN json_extract(o.json, '$.a') <> json_extract(n.json, '$.a') THEN 'changed' END AS status,
  CASE WHEN o.name IS NULL THEN 'safe' ELSE 'caution' END AS severity
FROM {definitions_old} o FULL OUTER JOIN {definitions_new} n ON o.name = n.name) t WHERE status IS NOT NULL"""


def definition_changes(spark, sf):
    old, new = [table(spark, sf, n).select("name", F.parse_json("json").alias("definition"))
                for n in ("definitions_old", "definitions_new")]
    return ops.definition_diff(old, new)


@query("d2_definition_diff", "SELECT * FROM {def_changes}")
def d2(spark, sf):
    return definition_changes(spark, sf)


@query("d3_model_status", "SELECT * FROM {model_status}")
def d3(spark, sf):
    return ops.model_status(*versions(spark, sf))


@query("d4_field_changes", "SELECT * FROM {changes}")
def d4(spark, sf):
    return ops.field_changes(*versions(spark, sf))


@query("d5_model_severity", "SELECT * FROM {changed_models}")
def d5(spark, sf):
    return ops.model_changes(*versions(spark, sf))


domain.CHECK_TABLES["rename_edges"] = r"""
SELECT * FROM (SELECT o.model, o.field_path AS old_path, n.field_path AS new_path, round(0.5 * (CASE WHEN greatest(len(ow), len(nw)) = 0 THEN 1.0
    ELSE len(list_intersect(ow, nw)) / greatest(len(ow), len(nw)) END) + 0.5 * (len(list_intersect(os, ns)) / greatest(len(os), len(ns))), 2) AS confidence
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(description), '\w+')) AS ow,
      list_distinct(regexp_extract_all(lower(string_split(field_path, '.')[-1]), '\w+')) AS os FROM {descriptors} d
    WHERE NOT EXISTS (SELECT 1 FROM {descriptors_new} x WHERE x.model = d.model AND x.field_path = d.field_path)) o
  JOIN (SELECT *, list_distinct(regexp_extract_all(lower(description), '\w+')) AS nw,
      list_distinct(regexp_extract_all(lower(string_split(field_path, '.')[-1]), '\w+')) AS ns FROM {descriptors_new} d
    WHERE NOT EXISTS (SELECT 1 FROM {descriptors} x WHERE x.model = d.model AND x.field_path = d.field_path)) n
  ON o.model = n.model AND o.data_type = n.data_type) t WHERE confidence >= 0.5::double"""


@query("d6_rename_candidates", "SELECT model, old_path, new_path, confidence FROM {rename_edges}")
def d6(spark, sf):
    return ops.rename_candidates(*versions(spark, sf)).select("model", "old_path", "new_path", "confidence")


@query("d6_rename_suggestions", """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY old_path, confidence DESC, new_path) AS n FROM {rename_edges}),
s AS (SELECT model, 0::bigint AS n, []::varchar[] AS olds, []::varchar[] AS news, NULL::varchar AS old_path, NULL::varchar AS new_path, NULL::double AS confidence
    FROM (SELECT DISTINCT model FROM e) m
  UNION ALL SELECT s.model, e.n, CASE WHEN f THEN list_append(olds, e.old_path) ELSE olds END, CASE WHEN f THEN list_append(news, e.new_path) ELSE news END,
    CASE WHEN f THEN e.old_path END, CASE WHEN f THEN e.new_path END, CASE WHEN f THEN e.confidence END
  FROM (SELECT s.*, NOT list_contains(olds, x.old_path) AND NOT list_contains(news, x.new_path) AS f FROM s JOIN e x ON x.model = s.model AND x.n = s.n + 1) s
  JOIN e ON e.model = s.model AND e.n = s.n + 1)
SELECT model, old_path, new_path, confidence FROM s WHERE old_path IS NOT NULL""")
def d6b(spark, sf):
    return ops.rename_suggestions(*versions(spark, sf))


def referenced(spark, sf):
    path = "lower(p_type) || '.' || split_part(p_name, ' ', 1) AS field_path"
    part = table(spark, sf, "part")
    return ops.cross_reference(
        ops.field_changes(*versions(spark, sf)), parser_registry(spark), part.selectExpr("p_name AS label_raw", path),
        part.filter("p_size > 25").selectExpr("p_brand AS issuer_key", path), usage.field_counts(table(spark, sf, "fields")))


domain.CHECK_TABLES["referenced"] = """
SELECT c.*, k.field_path IS NOT NULL AS has_parser, coalesce(l.v, '') AS labels, coalesce(i.v, '') AS issuers, coalesce(n.n, 0) AS stored_rows FROM {changes} c
LEFT JOIN {parser_kinds} k ON c.field_path = k.field_path
LEFT JOIN (SELECT lower(p_type) || '.' || split_part(p_name, ' ', 1) AS p, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS v FROM {part} GROUP BY 1) l ON c.field_path = l.p
LEFT JOIN (SELECT lower(p_type) || '.' || split_part(p_name, ' ', 1) AS p, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS v FROM {part}
  WHERE p_size > 25 GROUP BY 1) i ON c.field_path = i.p
LEFT JOIN (SELECT field_path, count(*) AS n FROM {fields} WHERE NOT not_found GROUP BY 1) n ON c.field_path = n.field_path"""


@query("d7_cross_reference", "SELECT * FROM {referenced}")
def d7(spark, sf):
    return referenced(spark, sf).withColumns({c: F.array_join(c, ",") for c in ("labels", "issuers")})


@query("d8_diff_summary", """
WITH s AS (SELECT severity FROM {changes} UNION ALL SELECT severity FROM {def_changes})
SELECT (SELECT count(*) FROM s WHERE severity = 'breaking') AS breaking, (SELECT count(*) FROM s WHERE severity = 'caution') AS caution,
  (SELECT count(*) FROM s WHERE severity = 'safe') AS safe, (SELECT count(*) FROM {changed_models} WHERE status = 'new') AS models_added,
  (SELECT count(*) FROM {changed_models} WHERE status = 'removed') AS models_removed, count(*) FILTER (change = 'added') AS fields_added,
  count(*) FILTER (change = 'removed') AS fields_removed, count(*) FILTER (change = 'type_changed') AS type_changes,
  count(*) FILTER (change IN ('enum_added', 'enum_removed')) AS enum_changes, (SELECT count(*) FROM {def_changes} WHERE status = 'added') AS defs_added,
  (SELECT count(*) FROM {def_changes} WHERE status = 'removed') AS defs_removed, (SELECT count(*) FROM {def_changes} WHERE status = 'changed') AS defs_changed
FROM {changes}""")
def d8(spark, sf):
    old, new = versions(spark, sf)
    return ops.diff_summary(ops.field_changes(old, new), ops.model_changes(old, new), definition_changes(spark, sf))


@query("d9_diff_impact", """
SELECT (SELECT coalesce(string_agg(DISTINCT field_path, ',' ORDER BY field_path), '') FROM {referenced} WHERE has_parser AND change IN ('removed', 'type_changed', 'enum_removed')) AS parsers_at_risk,
  (SELECT coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') FROM (SELECT unnest(string_split(labels, ',')) AS x FROM {referenced} WHERE change IN ('removed', 'type_changed')) t WHERE x <> '') AS labels_at_risk,
  (SELECT coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') FROM (SELECT unnest(string_split(issuers, ',')) AS x FROM {referenced} WHERE change IN ('removed', 'type_changed')) t WHERE x <> '') AS issuers_at_risk,
  (SELECT coalesce(sum(stored_rows), 0)::bigint FROM {referenced} WHERE change IN ('removed', 'type_changed')) AS rows_affected,
  string_agg(DISTINCT m.model, ',' ORDER BY m.model) AS active_models_affected, count(*) AS active_filings_affected
FROM {changed_models} m JOIN {filings} f ON f.model = m.model WHERE m.status IN ('changed', 'removed')""")
def d9(spark, sf):
    active = usage.active_models(table(spark, sf, "filings"))
    out = ops.diff_impact(referenced(spark, sf), ops.model_changes(*versions(spark, sf)), active)
    lists = ["parsers_at_risk", "labels_at_risk", "issuers_at_risk", "active_models_affected"]
    return out.withColumns({c: F.array_join(c, ",") for c in lists})


@query("d10_same_content", """
SELECT DISTINCT p_brand AS doc_id, length(p_brand) % 2 = 0 AS same_content FROM {part}""")
def d10(spark, sf):
    old = schema_json(spark, sf)
    spaced, changed = F.replace("json", F.lit(',"'), F.lit(' , "')), F.replace("json", F.lit('"string"'), F.lit('"text"'))
    new = old.withColumn("json", F.when(F.length("doc_id") % 2 == 0, spaced).otherwise(changed))
    return ops.same_content(ops.documents(old), ops.documents(new)).select("doc_id", "same_content")


domain.TABLES["pending_diffs"] = """
SELECT cast(p_partkey AS string) AS fetch_id, p_brand AS doc_id, '2024-' || lpad(cast(p_size % 12 + 1 AS string), 2, '0') || '-01' AS fetched_at FROM {part}"""


@query("d11_pending_list", "SELECT * FROM {pending_diffs}")
def d11(spark, sf):
    return ops.pending_list(table(spark, sf, "pending_diffs"))


@query("d12_schema_status", """
SELECT p.doc_id, 'https://schemas.example.com/notes.v' || length(p.doc_id) || '.schema.json' AS schema_id, 'v' || length(p.doc_id) AS schema_version,
  (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM {schema_fields} s WHERE s.doc_id = p.doc_id) AS models, count(*) AS pending,
  max(fetched_at) AS last_fetched FROM {pending_diffs} p GROUP BY p.doc_id""")
def d12(spark, sf):
    return (ops.schema_status(docs(spark, sf), table(spark, sf, "pending_diffs")).drop("content_hash")
            .withColumn("models", F.array_join("models", ",")))


# ---- logs --------------------------------------------------------------------------------

_FILE = "'app-' || cast(user_id % 2 AS string) || '.log'"
_STAMP = "replace(substr(cast(ts AS string), 1, 19), 'T', ' ') || ',' || lpad(cast(event_id % 1000 AS string), 3, '0')"
_LEVEL = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' WHEN 'purchase' THEN 'WARNING' ELSE 'NOTICE' END"""
domain.TABLES["log_lines"] = f"""
SELECT {_FILE} AS file, event_id * 4 AS line_no, CASE WHEN event_id < 4 THEN 'no stamp ' || cast(event_id AS string)
  ELSE {_STAMP} || '  ' || {_LEVEL} || '     app.' || event_type || '  value ' || cast(user_id AS string) || ' done' END AS line FROM {{events}}
UNION ALL SELECT {_FILE}, event_id * 4 + 1, 'Traceback ' || cast(event_id AS string) FROM {{events}} WHERE event_type = 'error'
UNION ALL SELECT {_FILE}, event_id * 4 + 2, '  at line ' || cast(user_id AS string) FROM {{events}} WHERE event_type = 'error' AND user_id % 3 = 0"""
_HEAD = r"'^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}},\d{{3}})\s+(\w+)\s+(\S+)\s+(.*)'"
domain.CHECK_TABLES["log_entries"] = """
SELECT file, min(line_no) AS line_no, arg_min(ts, line_no) AS ts, arg_min(level, line_no) AS level, arg_min(name, line_no) AS name,
  string_agg(text, chr(10) ORDER BY line_no) AS message FROM (
  SELECT file, line_no, entry, regexp_extract(line, HEAD, 1) AS ts, regexp_extract(line, HEAD, 2) AS level, regexp_extract(line, HEAD, 3) AS name,
    CASE WHEN head THEN regexp_extract(line, HEAD, 4) ELSE line END AS text FROM (
    SELECT *, sum(head::int) OVER (PARTITION BY file ORDER BY line_no) AS entry FROM (
      SELECT *, regexp_matches(line, HEAD) AS head FROM {log_lines}) a) b WHERE entry > 0) c GROUP BY file, entry""".replace("HEAD", _HEAD)


def entries(spark, sf):
    return logs.parse_log(table(spark, sf, "log_lines"))


@query("g1_parse_log", "SELECT * FROM {log_entries}")
def g1(spark, sf):
    return entries(spark, sf)


@query("g2_filter_log", """
SELECT * FROM {log_entries} WHERE level IN ('WARNING', 'ERROR', 'CRITICAL') AND contains(lower(name), 'e') AND contains(lower(message), 'value 1')""")
def g2(spark, sf):
    return logs.filter_log(entries(spark, sf), "warning", " E ", "Value 1")


@query("g3_log_tail", """
SELECT * FROM {log_entries} WHERE level IN ('WARNING', 'ERROR', 'CRITICAL') ORDER BY file DESC, line_no DESC LIMIT 50""")
def g3(spark, sf):
    return logs.tail_log(logs.filter_log(entries(spark, sf), "WARNING"), 50)[0]


@query("g3_log_total", "SELECT count(*) AS total_matched FROM {log_entries} WHERE level IN ('ERROR', 'CRITICAL')")
def g3b(spark, sf):
    return logs.tail_log(logs.filter_log(entries(spark, sf), "ERROR"))[1]


# ---- runs --------------------------------------------------------------------------------

domain.TABLES["run_calls"] = """
SELECT filing_id, issuer_name, phase, CASE WHEN n % 17 = 0 THEN 'timeout' END AS error, status, model, confidence,
  CASE WHEN phase = 'extract' THEN CASE n % 5 WHEN 0 THEN 'Classification Confidence 0.5 is low' WHEN 1 THEN 'blocked by GATE' WHEN 2 THEN 'bad request' END END AS message
FROM (SELECT *, 'classify' AS phase, cast(accession_raw AS bigint) + cast(cik AS bigint) AS n FROM {filings}
  UNION ALL SELECT *, 'extract' AS phase, cast(accession_raw AS bigint) * 3 + cast(cik AS bigint) AS n FROM {filings}) t"""
_CLASSIFY = """CASE WHEN error IS NOT NULL THEN 'failed' WHEN status = 'classified' AND confidence >= 0.8::double THEN 'ok'
  WHEN status = 'needs_review' THEN 'needs_review' WHEN model = 'unknown' THEN 'unknown' ELSE 'ok' END"""


@query("r1_status_snapshot", "SELECT status, count(*) AS filings FROM {filings} GROUP BY 1")
def r1(spark, sf):
    return runs.status_snapshot(table(spark, sf, "filings"))


@query("r2_run_outcomes", f"""
SELECT phase, CASE phase WHEN 'classify' THEN {_CLASSIFY} ELSE CASE WHEN error IS NOT NULL THEN 'failed'
  WHEN regexp_matches(lower(message), 'gate|confidence') THEN 'gate_blocked' WHEN message IS NOT NULL THEN 'failed' ELSE 'ok' END END AS outcome,
  count(*) AS calls FROM {{run_calls}} GROUP BY 1, 2""")
def r2(spark, sf):
    return runs.outcome_counts(table(spark, sf, "run_calls"))


@query("r3_issuer_breakdown", f"""
SELECT * FROM (SELECT coalesce(issuer_name, 'Unknown') AS issuer_name, count(*) FILTER (phase = 'classify' AND o = 'ok') AS classified,
  count(*) FILTER (phase = 'classify' AND o IN ('needs_review', 'unknown')) AS needs_review,
  count(*) FILTER (phase = 'extract' AND error IS NULL AND message IS NULL) AS extracted, count(*) FILTER (error IS NOT NULL) AS failed
FROM (SELECT *, {_CLASSIFY} AS o FROM {{run_calls}}) t GROUP BY 1) u""")
def r3(spark, sf):
    return runs.issuer_breakdown(table(spark, sf, "run_calls"))


@query("r4_fill_rates", """
SELECT extraction_id, filing_id, fields_found, field_count, round(fields_found / field_count * 100, 0) AS fill_pct FROM {extractions} WHERE field_count > 0""")
def r4(spark, sf):
    return runs.fill_rates(table(spark, sf, "extractions"))


@query("r4_issuer_fill_rates", """
SELECT coalesce(issuer_name, 'Unknown') AS issuer_name, count(*) AS extractions, round(avg(fields_found / field_count) * 100, 2) AS avg_fill_pct
FROM {extractions} e LEFT JOIN {filings} f ON e.filing_id = f.filing_id GROUP BY 1""")
def r4b(spark, sf):
    return runs.issuer_fill_rates(table(spark, sf, "extractions"), table(spark, sf, "filings"))


@query("r5_work_list", """
SELECT filing_id, CASE status WHEN 'ingested' THEN 'classify' WHEN 'classified' THEN 'extract' ELSE 'reextract' END AS step FROM {filings}
WHERE status IN ('ingested', 'classified', 'extracted', 'approved', 'exported')""")
def r5(spark, sf):
    return runs.work_list(table(spark, sf, "filings"), reextract=True)


@query("r5_work_counts", """
SELECT count(*) FILTER (status = 'ingested') AS to_classify, count(*) AS to_extract_at_most FROM {filings} WHERE status IN ('ingested', 'classified')""")
def r5b(spark, sf):
    return runs.work_counts(table(spark, sf, "filings"))


@query("r6_manual_review", """
SELECT filing_id, cusip, issuer_name, CASE status WHEN 'ingested' THEN 'classify failed' ELSE 'needs review' END AS why FROM {filings}
WHERE status IN ('needs_review', 'ingested')""")
def r6(spark, sf):
    return runs.manual_review(table(spark, sf, "filings"))
