"""Table schemas of the domain (DDL strings usable with ``spark.read.schema``)."""

FILINGS = """
    filing_id STRING, cusip STRING, cik STRING, accession_number STRING, issuer_name STRING,
    filing_date STRING, source_url STRING, folder_path STRING, html_path STRING,
    ingest_started_at STRING, ingest_timestamp STRING, status STRING, model STRING,
    confidence DOUBLE, schema_version STRING, classified_at STRING, title_excerpt STRING,
    product_features STRING
"""
EXTRACTIONS = """
    extraction_id STRING, filing_id STRING, model STRING, schema_version STRING,
    extracted_at STRING, field_count BIGINT, fields_found BIGINT, fields_null BIGINT,
    extraction_mode STRING
"""
FIELDS = """
    field_id STRING, extraction_id STRING, filing_id STRING, field_path STRING,
    value_json STRING, confidence DOUBLE, excerpt STRING, not_found BOOLEAN,
    reviewed_json STRING, review_status STRING, reviewed_at STRING,
    validation_error STRING, source STRING
"""
EDIT_LOG = """
    filing_id STRING, field_path STRING, old_value STRING, new_value STRING,
    action STRING, edited_at STRING
"""
FEEDBACK = """
    feedback_id STRING, filing_id STRING, original_model STRING, corrected_model STRING,
    reason STRING, corrected_by STRING, corrected_at STRING, used_as_example BOOLEAN
"""
LABEL_MISSES = """
    label_norm STRING, label_raw STRING, sample_value STRING, issuer_name STRING,
    filing_id STRING, occurrences BIGINT, first_seen_at STRING, last_seen_at STRING,
    dismissed BOOLEAN
"""
USAGE = """
    usage_id STRING, filing_id STRING, call_type STRING, model STRING, prompt_tokens BIGINT,
    completion_tokens BIGINT, duration_seconds DOUBLE, cache_read_tokens BIGINT,
    cache_write_tokens BIGINT, called_at STRING
"""
PRICING = """
    model_id STRING, display_name STRING, input_price DOUBLE, output_price DOUBLE,
    cache_write_price DOUBLE, cache_read_price DOUBLE
"""
DESCRIPTORS = """
    model STRING, field_path STRING, label STRING, data_type STRING, description STRING,
    required BOOLEAN, enum_values ARRAY<STRING>
"""
LABELS = "layer INT, issuer_key STRING, ord INT, label_raw STRING, field_path STRING"
REGISTRY = "field_path STRING, kind STRING"
