"""Intake, listings, exports, streams and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet import schemas
from termsheet.functions.text import normalise_accession
from termsheet.operators import export, htmlrows, quality, runs
from termsheet.plans import domain
from termsheet.plans.document_queries import _INDEX
from termsheet.plans.domain import AS_OF, DEFAULT_MODEL, PRICING, table, usd
from termsheet.plans.extract_queries import _NEST
from termsheet.plans.registry import query
from termsheet.plans.usage_queries import costed
from termsheet.plans.workflow_queries import _REPLAY
from termsheet.session import work_folder
from termsheet.sources import config_tables, ingest, sinks
from termsheet.sources.versioned import MergedTable
from termsheet.streaming import jobs

# Search hits in the newer form, two older forms, and the bare form.
domain.TABLES["hits"] = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN ' q' ELSE 'Z' END || lpad(cast(o_custkey AS string), 8, '0') AS query,
  '{{"_id":"' || cast(o_orderkey AS string) || ':main.htm","_source":{{"file_date":"' || cast(cast(o_orderdate AS date) AS string) || '"' || CASE o_orderkey % 4
    WHEN 0 THEN ',"adsh":"a-' || cast(o_orderkey AS string) || '","ciks":["000' || cast(o_custkey AS string) || '","1"],"display_names":["Issuer ' || o_orderstatus
      || ' Inc  (TKR)  (CIK 0001)","other"],"file_type":"424B2/A"'
    WHEN 1 THEN ',"accession_no":"b-' || cast(o_orderkey AS string) || '","file_num":"333-' || cast(o_custkey AS string) || '","entity_name":"Old Name","display_names":[]'
    WHEN 2 THEN ',"adsh":"","file_num":["77' || cast(o_custkey AS string) || '-01","x"],"form_type":"424B3"'
    ELSE ',"ciks":["0000"]' END || '}}}}' AS hit FROM {orders}"""


@query("s2_search_hits", """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'a-' || o_orderkey WHEN 1 THEN 'b-' || o_orderkey ELSE o_orderkey::varchar END AS accession_number,
  CASE o_orderkey % 4 WHEN 0 THEN 'Issuer ' || o_orderstatus || ' Inc' WHEN 1 THEN 'Old Name' ELSE '' END AS entity_name,
  o_orderdate::date::varchar AS filing_date, CASE o_orderkey % 4 WHEN 0 THEN '424B2/A' WHEN 2 THEN '424B3' ELSE '424B2' END AS form_type,
  CASE o_orderkey % 4 WHEN 0 THEN CASE o_custkey WHEN 0 THEN '0000' ELSE o_custkey::varchar END WHEN 1 THEN '333' WHEN 2 THEN '77' || o_custkey ELSE '0000' END AS cik,
  m.cusip AS cusip_hint, m.model AS known_model
FROM {orders} o LEFT JOIN {cusip_map} m ON o_orderkey % 2 = 0 AND m.cusip = 'Q' || lpad(o_custkey::varchar, 8, '0')""")
def s2(spark, sf):
    return ingest.search_hits(table(spark, sf, "hits"), table(spark, sf, "cusip_map"))


@query("s3_primary_document", _INDEX + """
SELECT page_id AS filing_id, seq::bigint AS seq, name, url, type FROM rows WHERE regexp_matches(name, '(?i)\\.html?$')
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN contains(lower(type), '424b2') THEN 0 ELSE 1 END, seq) = 1""")
def s3(spark, sf):
    index = htmlrows.index_rows(table(spark, sf, "index_pages")).withColumnRenamed("page_id", "filing_id")
    return ingest.primary_documents(index)


domain.TABLES["ingest_requests"] = """
SELECT accession_raw AS accession_number, cik, cusip, issuer_name, source_url, cast(accession_raw AS bigint) * 2 AS request_no FROM {filings}
UNION ALL SELECT ' ' || accession_number || ' ', cik, cusip, 'repeat', source_url, cast(accession_raw AS bigint) * 2 + 1 FROM {filings}"""


@query("s6_new_filings", """
SELECT accession_number, coalesce(nullif(ltrim(cik, '0'), ''), cik) AS cik, cusip, issuer_name, source_url, accession_raw::bigint * 2 AS request_no,
  accession_raw AS folder_path, 'ingested' AS status FROM {filings} WHERE status IN ('ingested', 'exported')""")
def s6(spark, sf):
    stored = table(spark, sf, "filings").filter("status NOT IN ('ingested', 'exported')")
    return ingest.new_filings(table(spark, sf, "ingest_requests"), stored)


@query("s6_committed_filings", """
SELECT accession_number, coalesce(nullif(ltrim(cik, '0'), ''), cik) AS cik, cusip, issuer_name, source_url, accession_raw::bigint * 2 AS request_no,
  accession_raw AS folder_path, 'ingested' AS status FROM {filings}""")
def s6_committed(spark, sf):
    """Requests into the stored table in two overlapping deliveries, the second one twice; each filing is stored once."""
    requests = table(spark, sf, "ingest_requests")
    ddl = "accession_number STRING, cik STRING, cusip STRING, issuer_name STRING, source_url STRING, request_no BIGINT, folder_path STRING, status STRING"
    stored = MergedTable(spark, work_folder(spark, "filings"), "accession_number", ddl, 16).create()
    early = F.floor(F.col("request_no") / 2) % 3 == 0
    for batch, delivery in ((0, requests.filter(early)), (1, requests), (1, requests)):
        keyed = delivery.withColumn("accession_number", normalise_accession(F.col("accession_number")))
        stored.merge(batch, keyed, lambda old, new: old.unionByName(ingest.new_filings(new, old)))
    return stored.read()


_TYPE = "CASE page_id % 3 WHEN 0 THEN 'application/PDF' WHEN 1 THEN 'text/html' END"


@query("s7_content_gate", "SELECT page_id, url FROM {pages} WHERE page_id % 3 <> 0")
def s7(spark, sf):
    return ingest.html_only(table(spark, sf, "pages").selectExpr("page_id", "url", f"{_TYPE} AS content_type"))[0].select("page_id", "url")


@query("s7_content_rejects", "SELECT page_id, 'PDF filing is not supported' AS reason FROM {pages} WHERE page_id % 3 = 0")
def s7b(spark, sf):
    return ingest.html_only(table(spark, sf, "pages").selectExpr("page_id", f"{_TYPE} AS content_type"))[1].select("page_id", "reason")


@query("s8_source_urls", """
SELECT filing_id, coalesce(f.source_url, CASE WHEN m.source_url LIKE '%.htm' THEN m.source_url END) AS resolved_url,
  CASE WHEN f.source_url IS NOT NULL THEN 'request' WHEN m.source_url LIKE '%.htm' THEN 'mapping' ELSE 'index' END AS url_source
FROM {filings} f LEFT JOIN {cusip_map} m ON f.cusip = m.cusip""")
def s8(spark, sf):
    out = ingest.source_urls(table(spark, sf, "filings"), table(spark, sf, "cusip_map"))
    return out.select("filing_id", "resolved_url", "url_source")


domain.TABLES["mapping_sheet"] = """
SELECT CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE ' Q' || cast(c_custkey % 500 AS string) || ' ' END AS cusip_text,
  CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_mktsegment || ' ' END AS spectrum_text, c_name AS source_text, c_custkey AS line_no FROM {customer}"""


@query("s9_cusip_map", """
SELECT trim(cusip_text) AS cusip, arg_max(trim(spectrum_text), line_no) AS model, arg_max(source_text, line_no) AS source_url
FROM {mapping_sheet} WHERE trim(cusip_text) <> '' AND trim(spectrum_text) <> '' GROUP BY 1""")
def s9(spark, sf):
    sheet = table(spark, sf, "mapping_sheet").selectExpr(
        "cusip_text AS ` CUSIP `", "spectrum_text AS Spectrum", "source_text AS SOURCE", "line_no")
    return ingest.cusip_map(sheet, "line_no")


domain.TABLES["section_rows"] = """
SELECT p_type || ' ' || p_brand AS name, min(p_name) || ',' || max(p_name) AS keys_text, min(p_brand) || ',' || max(p_name) || ',' || min(p_type) AS headers_text,
  1000 * min(p_size) AS max_chars FROM {part} GROUP BY p_type || ' ' || p_brand"""


@query("s12_section_listing", "SELECT name, 2 AS keys, 3 AS headers, max_chars FROM {section_rows}")
def s12(spark, sf):
    rows = table(spark, sf, "section_rows").select("name", F.split("keys_text", ",").alias("schema_keys"),
                                                   F.split("headers_text", ",").alias("search_headers"), "max_chars")
    return config_tables.section_listing(rows)


@query("s16_usage_rows", """
SELECT filing_id, call_type, model, prompt_tokens, completion_tokens, duration_seconds, nullif(cache_read_tokens, 0) AS cache_read_tokens,
  nullif(coalesce(cache_write_tokens, 0), 0) AS cache_write_tokens, called_at FROM {usage}""")
def s16(spark, sf):
    calls = table(spark, sf, "usage").selectExpr(
        "filing_id", "call_type", "model", "prompt_tokens AS input_tokens", "completion_tokens AS output_tokens",
        "duration_seconds", "cache_read_tokens", "coalesce(cache_write_tokens, 0) AS cache_write_tokens", "called_at")
    return ingest.usage_rows(calls)


def _approved(spark, sf):
    filings = table(spark, sf, "filings")
    runs = export.approved_runs(filings, table(spark, sf, "extractions"))
    return filings, runs, export.run_values(table(spark, sf, "fields"), runs)


@query("s17_export_documents", "WITH nested AS (" + _NEST + f"""),
st AS (SELECT e.filing_id, '{{{{' || string_agg('"' || field_path || '":"' || review_status || '"', ',' ORDER BY field_path) || '}}}}' AS s
  FROM {{effective}} e SEMI JOIN {{latest}} l ON e.extraction_id = l.extraction_id GROUP BY 1)
SELECT f.filing_id, l.model, f.cusip || '_' || l.model || '_2001-06-15' AS file_name,
  '{{{{"export_metadata":{{{{"cusip":"' || cusip || '","accession_number":"' || accession_number || '","issuer_name":"' || coalesce(issuer_name, '') || '","filing_date":"'
  || filing_date || '","filing_url":"' || coalesce(source_url, '') || '","model":"' || l.model || '","schema_version":"v1","extracted_at":"' || extracted_at
  || '","approved_at":"{AS_OF}","export_generated_at":"{AS_OF}"}}}},"fields":' || nested_json || ',"field_review_status":' || s || '}}}}' AS document
FROM {{filings}} f JOIN {{latest}} l ON f.filing_id = l.filing_id JOIN nested n ON n.filing_id = f.filing_id JOIN st ON st.filing_id = f.filing_id
WHERE f.status = 'approved'""".replace("{{{{", "{{").replace("}}}}", "}}"))
def s17(spark, sf):
    return sinks.export_documents(*_approved(spark, sf), AS_OF)


_FIELDS = ["identifiers.cusip", "identifiers.isin", "coupon.rate", "coupon.frequency", "structuredProductsGeneral.notional", "structuredProductsGeneral.maturityDate",
           "barrier.triggerDetails.triggerLevel", "barrier.triggerDetails.observationType", "autocall.callLevel", "parties.issuer.name", "product.denomination", "parties.guarantor.name"]


def _cell(path: str) -> str:
    return (f"coalesce(max(CASE WHEN field_path = '{path}' THEN CASE WHEN value_json LIKE '\"%' THEN json_extract_string(value_json, '$') "
            f"WHEN value_json = 'true' THEN 'True' WHEN value_json = 'false' THEN 'False' ELSE nullif(value_json, 'null') END END), '') AS {path.replace('.', '_')}")


@query("s18_flat_rows", f"""
SELECT f.filing_id, f.cusip, l.model AS payout_type_id, f.schema_version, f.filing_date, {', '.join(_cell(p) for p in _FIELDS)}
FROM {{filings}} f JOIN {{latest}} l ON f.filing_id = l.filing_id JOIN {{effective}} e ON e.extraction_id = l.extraction_id
WHERE f.status = 'approved' GROUP BY 1, 2, 3, 4, 5""")
def s18(spark, sf):
    filings, latest, values = _approved(spark, sf)
    rows = sinks.flat_rows(filings, latest, values, _FIELDS)
    return rows.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in rows.columns])


domain.TABLES["snapshots"] = """
SELECT filing_id, CASE cast(accession_raw AS bigint) % 5 WHEN 0 THEN '{{"images":["a.png"]}}' WHEN 1 THEN '{{"images":[]}}' WHEN 2 THEN '{{"cik":"1"}}'
  WHEN 3 THEN '{{broken' ELSE '{{"images":["a.png","b.png"]}}' END AS metadata_json FROM {filings} WHERE status <> 'ingested'"""


@query("s21_backfill_targets", """
SELECT f.filing_id FROM {filings} f LEFT JOIN {snapshots} s ON f.filing_id = s.filing_id
WHERE f.issuer_name IS NULL OR s.metadata_json IS NULL OR f.accession_raw::bigint % 5 IN (1, 2, 3)""")
def s21(spark, sf):
    filings = table(spark, sf, "filings").select("filing_id", F.when(F.col("issuer_name").isNotNull(), F.col("accession_raw")).alias("folder_path"))
    return runs.backfill_targets(filings, table(spark, sf, "snapshots"))


@query("s22_ingest_gap", """
SELECT issuer_name, cusip FROM (SELECT c_mktsegment AS issuer_name, unnest(['Q' || lpad(c_custkey::varchar, 8, '0'), 'R' || c_custkey]) AS cusip FROM {customer}) t
WHERE cusip NOT IN (SELECT cusip FROM {filings})""")
def s22(spark, sf):
    key = F.col("c_custkey").cast("string")
    targets = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("issuer_name"), F.array(
        F.concat(F.lit("Q"), F.lpad(key, 8, "0")), F.concat(F.lit("R"), key)).alias("cusips"))
    return runs.ingest_gap(targets, table(spark, sf, "filings"))


_RESULT = "CASE event_type WHEN 'view' THEN 'ingested' WHEN 'click' THEN 'already_exists' WHEN 'signup' THEN 'no_edgar_hits' ELSE event_type END"


@query("s22_ingest_outcomes", """
SELECT CASE WHEN event_type IN ('view', 'click') THEN 'ok' WHEN event_type = 'signup' THEN 'no_hits' ELSE 'failed' END AS outcome, count(*) AS filings
FROM {events} GROUP BY 1""")
def s22b(spark, sf):
    return runs.ingest_outcomes(table(spark, sf, "events").selectExpr(f"{_RESULT} AS result"))


domain.TABLES["filing_image_names"] = """
SELECT DISTINCT cast(l_orderkey AS string) AS filing_id, l_linenumber AS ord, 'img' || cast(l_linenumber AS string) || '.png' AS image_name FROM {lineitem}"""


def _member(name: str, column: str) -> str:
    return f"'\"{name}\":' || coalesce('\"' || {column} || '\"', 'null')"


@query("s23_metadata_snapshot", f"""
SELECT f.filing_id, '{{{{' || {" || ',' || ".join(_member(n, c) for n, c in (
    ("cusip", "cusip"), ("cik", "cik"), ("accession_number", "accession_number"), ("issuer_name", "issuer_name"),
    ("filing_date", "filing_date"), ("filing_url", "source_url"), ("ingest_timestamp", "ingest_timestamp")))}
  || ',"images":[' || coalesce(i.names, '') || ']}}}}' AS metadata_json FROM {{filings}} f
LEFT JOIN (SELECT filing_id, string_agg('"' || image_name || '"', ',' ORDER BY ord) AS names FROM {{filing_image_names}} GROUP BY 1) i ON f.filing_id = i.filing_id
""".replace("{{{{", "{{").replace("}}}}", "}}"))
def s23(spark, sf):
    return ingest.metadata_json(table(spark, sf, "filings"), table(spark, sf, "filing_image_names"))


@query("s24_migrated_table", """
SELECT field_id, filing_id, confidence, NULL::varchar AS reviewed_at, NULL::varchar AS validation_error, value_json FROM {fields}""")
def s24(spark, sf):
    older = table(spark, sf, "fields").select("field_id", "filing_id", "confidence", "value_json")
    return ingest.migrated(older, schemas.FIELDS).select(
        "field_id", "filing_id", "confidence", "reviewed_at", "validation_error", "value_json")


# ---- streams, run to the end of the given tables ----------------------------------------

def _stream(spark, sf, name):
    static = spark.read.parquet(f"{sf}/{name}.parquet")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run_to_end(spark, df, mode, out=None):
    """Run a stream over what is there; every batch is evaluated once, into one table."""
    out = out or work_folder(spark, "stream")
    stream = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
              .foreachBatch(lambda batch, batch_id: batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{out}/table"))
              .start())
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/table")


def _last_update(rows, *keys):
    """The newest row of every key that an update-mode stream wrote."""
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


@query("t1_unique_filings_stream", """
SELECT accession_number, accession_raw AS folder_path, 'ingested' AS status FROM {filings}""")
def t1(spark, sf):
    raw = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    requests = _stream(spark, sf, "orders").select(
        F.explode(F.array(raw, F.concat(F.lit(" "), raw))).alias("accession_number"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"))
    return _run_to_end(spark, jobs.unique_filings(requests), "append").select("accession_number", "folder_path", "status")


# Calls arrive in two deliveries; the second holds calls of long ago, which come too late.
_FIRST = "prompt_tokens % 2 = 0 AND coalesce(try_cast(called_at AS timestamp) < cast('1997-01-01' AS timestamp), true)"


@query("t2_live_spend_stream", f"""
WITH c AS (SELECT *, try_cast(called_at AS timestamp) AS ts, {_FIRST} AS early FROM {{priced}}),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM c WHERE early)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN call_type LIKE 'classify%' THEN 'classify' ELSE 'extract' END AS phase,
  count(*) AS calls, sum(cost)::double / 10000000000.0::double AS cost_usd FROM c, w
WHERE ts IS NOT NULL AND (early OR date_trunc('day', ts) + INTERVAL 1 DAY > mark) GROUP BY 1, 2""")
def t2(spark, sf):
    out = work_folder(spark, "stream")
    usage = table(spark, sf, "usage")
    for delivery in (F.expr(_FIRST), ~F.expr(_FIRST)):
        usage.filter(F.coalesce(delivery, F.lit(False))).write.mode("append").parquet(f"{out}/calls")
        calls = spark.readStream.schema(usage.schema).parquet(f"{out}/calls")
        rows = _run_to_end(spark, jobs.live_spend(calls, PRICING, DEFAULT_MODEL), "update", out)
    return _last_update(rows, "window_start", "phase").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "phase", "calls", (F.col("cost_units").cast("double") / 1e10).alias("cost_usd"))


@query("t3_action_stream_states", _REPLAY + """
SELECT filing_id, arg_max(status, n) AS status, arg_max_null(model, n) AS model, arg_max_null(confidence, n) AS confidence FROM r GROUP BY 1""")
def t3(spark, sf):
    # Actions arrive in two deliveries; the stream stops in between and goes on from its checkpoint.
    out = work_folder(spark, "stream")
    filings, todo = table(spark, sf, "filings"), table(spark, sf, "actions").drop("reason")
    middle = todo.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for delivery in (F.col("seq") <= middle, F.col("seq") > middle):
        todo.filter(delivery).write.mode("append").parquet(f"{out}/actions")
        actions = spark.readStream.schema(todo.schema).parquet(f"{out}/actions")
        rows = _run_to_end(spark, jobs.action_outcomes(actions, filings), "append", out)
    return jobs.latest_states(filings, rows).select("filing_id", "status", "model", "confidence")


@query("t4_miss_counts_stream", """
SELECT label_norm, count(*) AS occurrences, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM (
  SELECT lower(p_name) AS label_norm, p_type AS seen_at FROM {part}) t GROUP BY 1""")
def t4(spark, sf):
    misses = _stream(spark, sf, "part").selectExpr("lower(p_name) AS label_norm", "p_type AS seen_at")
    return _last_update(_run_to_end(spark, jobs.miss_counts(misses), "update"), "label_norm")


# ---- quality reports ---------------------------------------------------------------------

def _bits(n: int) -> str:
    return " || ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN '1' ELSE '0' END" for i in range(n))


def vectors(spark, sf):
    bits = F.array_join(F.transform(F.slice("embedding", 1, 22), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit("family"), (F.col("label") % 4).cast("string")).alias("family"), bits.alias("bits"))


domain.CHECK_TABLES["vectors"] = f"SELECT vec_id AS item_id, 'family' || (label % 4) AS family, {_bits(22)} AS bits FROM {{embeddings}}"
VARIANTS = [(f"family{i % 4}", format((i * 2654435761) % (1 << 22), "022b")) for i in range(24)]


@query("o2_nearest_variant", "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{b}')" for f, b in VARIANTS) + """) t(family, variant)),
d AS (SELECT item_id, x.family, variant, length(replace(array_to_string(list_transform(range(1, 23), lambda i: CASE WHEN substr(bits, i, 1) = substr(variant, i, 1)
  THEN '' ELSE '1' END), ''), ' ', ''))::int AS distance FROM {vectors} x JOIN v ON x.family = v.family)
SELECT *, CASE WHEN distance <= 2 THEN 'match' WHEN 1 - distance / 22.0::double < 0.6::double THEN 'no match' ELSE 'novel' END AS verdict FROM d
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY distance, variant) = 1""")
def o2(spark, sf):
    return quality.nearest_variant(vectors(spark, sf), VARIANTS)


@query("o4_vector_overlap", """
SELECT bits, count(*) AS items, string_agg(DISTINCT family, ',' ORDER BY family) AS families, count(DISTINCT family) > 1 AS overlaps
FROM {vectors} GROUP BY 1""")
def o4(spark, sf):
    return quality.vector_overlap(vectors(spark, sf))


@query("o5_fill_rate_drops", """
WITH m AS (SELECT issuer_name, substr(extracted_at, 1, 7) AS month, sum(fields_found) AS found, sum(field_count) AS total
  FROM {extractions} e JOIN {filings} f ON e.filing_id = f.filing_id WHERE issuer_name IS NOT NULL GROUP BY 1, 2),
b AS (SELECT issuer_name, month, round(found / total * 100, 2) AS fill_pct, round(sum(found) OVER w / sum(total) OVER w * 100, 2) AS baseline_pct
  FROM m WINDOW w AS (PARTITION BY issuer_name ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, coalesce(baseline_pct - fill_pct >= 10, false) AS dropped FROM b""")
def o5(spark, sf):
    return quality.fill_rate_drops(table(spark, sf, "extractions"), table(spark, sf, "filings"))


@query("o6_mode_comparison", f"""
WITH f AS (SELECT extraction_mode, sum(fields_found) / sum(field_count) * 100 AS fill, sum(field_count) AS total FROM {{extractions}} GROUP BY 1),
e AS (SELECT extraction_mode, count(*) FILTER (review_status = 'schema_error') AS errors
  FROM {{extractions}} x LEFT JOIN {{fields}} v ON x.extraction_id = v.extraction_id GROUP BY 1),
c AS (SELECT CASE call_type WHEN 'extract' THEN 'single' ELSE 'sectioned' END AS extraction_mode, sum(cost) AS u, count(DISTINCT filing_id) AS filings
  FROM {{priced}} WHERE call_type LIKE 'extract%' AND filing_id IS NOT NULL GROUP BY 1),
j AS (SELECT *, u::double / filings AS each FROM f JOIN e USING (extraction_mode) JOIN c USING (extraction_mode))
SELECT extraction_mode, round(fill, 2) AS fill_pct, {usd('u', 6)} AS cost_usd, filings, errors, round(each / 10000000000.0::double, 6) AS cost_per_filing_usd,
  CASE WHEN extraction_mode = 'sectioned' THEN (SELECT j.fill - s.fill >= 10 AND j.errors / j.total <= s.errors / s.total AND j.each <= 1.8::double * s.each
    FROM j s WHERE s.extraction_mode = 'single') END AS promote FROM j""")
def o6(spark, sf):
    return quality.mode_comparison(table(spark, sf, "extractions"), table(spark, sf, "fields"), costed(spark, sf))


@query("o7_mean_confidence", """
SELECT extraction_id, round(avg(confidence), 6) AS mean_confidence, count(confidence) AS fields FROM {fields} WHERE NOT not_found GROUP BY 1""")
def o7(spark, sf):
    return quality.mean_confidence(table(spark, sf, "fields"))


@query("o8_series_filings", r"""
SELECT doc_id, len(c)::int AS cusips, array_to_string(c, ',') AS codes FROM (
  SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'),
    lambda w: regexp_full_match(w, '[A-Z0-9]{{9}}')))) AS c FROM (
    SELECT doc_id, text || ' Q' || lpad(doc_id::varchar, 8, '0') || CASE doc_id % 3 WHEN 0 THEN ' R' || lpad(doc_id::varchar, 8, '0') ELSE '' END AS text
    FROM {documents}) a) t WHERE len(c) > 1""")
def o8(spark, sf):
    key = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(
        "text", F.lit(" Q"), key,
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" R"), key)).otherwise(F.lit(""))).alias("text"))
    return quality.series_filings(docs)
