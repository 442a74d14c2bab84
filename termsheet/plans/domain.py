"""Domain tables derived from the test tables.

Each table is one SELECT written in the part of SQL that Spark and DuckDB share, so the Spark
query and its SQL check start from the same rows.  ``{{`` and ``}}`` stand for braces.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession


BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Prices differ per model here so that a wrong lookup shows.
PRICING = [
    {"model_id": "model-a", "display_name": "Model A", "input_price": 3.0, "output_price": 15.0,
     "cache_write_price": 3.75, "cache_read_price": 0.3},
    {"model_id": "model-b", "display_name": "Model B", "input_price": 1.0, "output_price": 5.0,
     "cache_write_price": 1.25, "cache_read_price": 0.1},
    {"model_id": "model-c", "display_name": "Model C", "input_price": 10.0, "output_price": 50.0,
     "cache_write_price": 12.5, "cache_read_price": 1.0},
]
DEFAULT_MODEL = "model-a"
AS_OF = "2001-06-15T00:00:00"

_MONTH = ("CASE month({c}) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' "
          "WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' "
          "WHEN 8 THEN 'Aug' WHEN 9 THEN 'September' WHEN 10 THEN 'Oct' WHEN 11 THEN 'November' "
          "ELSE 'December' END || ' ' || cast(day({c}) AS string) || ', ' || cast(year({c}) AS string)")
_SHIP_WORDS = _MONTH.format(c="l_shipdate")

TABLES: dict[str, str] = {}

TABLES["filings"] = """
SELECT cast(o_orderkey AS string) AS filing_id,
  'Q' || lpad(cast(o_custkey AS string), 8, '0') AS cusip,
  lpad(cast(o_custkey AS string), 10, '0') AS cik,
  lpad(cast(o_orderkey AS string), 18, '0') AS accession_raw,
  substr(lpad(cast(o_orderkey AS string), 18, '0'), 1, 10) || '-'
    || substr(lpad(cast(o_orderkey AS string), 18, '0'), 11, 2) || '-'
    || substr(lpad(cast(o_orderkey AS string), 18, '0'), 13, 6) AS accession_number,
  CASE o_custkey % 12 WHEN 0 THEN 'Bank of Montreal' WHEN 1 THEN 'BARCLAYS BANK PLC'
    WHEN 2 THEN 'BofA Finance LLC' WHEN 3 THEN 'Citigroup Global Markets Holdings Inc.'
    WHEN 4 THEN 'GS Finance Corp.' WHEN 5 THEN 'JPMorgan Chase & Co'
    WHEN 6 THEN 'JPMorgan Chase Financial Company LLC' WHEN 7 THEN 'UBS AG'
    WHEN 8 THEN 'Wells Fargo & Company/MN' WHEN 9 THEN 'citi'
    WHEN 10 THEN 'Unlisted Issuer SA' ELSE NULL END AS issuer_name,
  cast(cast(o_orderdate AS date) AS string) AS filing_date,
  CASE o_orderkey % 8 WHEN 0 THEN 'ingested' WHEN 1 THEN 'classified'
    WHEN 2 THEN 'needs_classification_review' WHEN 3 THEN 'needs_review'
    WHEN 4 THEN 'extracting' WHEN 5 THEN 'extracted' WHEN 6 THEN 'approved'
    ELSE 'exported' END AS status,
  CASE o_custkey % 10 WHEN 0 THEN 'yieldEnhancementCoupon'
    WHEN 1 THEN 'yieldEnhancementBarrierCoupon' WHEN 2 THEN 'yieldEnhancementAutocallCoupon'
    WHEN 3 THEN 'yieldEnhancementAutocallBarrierCoupon' WHEN 4 THEN 'yieldEnhancementAutocall'
    WHEN 5 THEN 'forwardKoStripEquity' WHEN 6 THEN 'equityShare' WHEN 7 THEN 'legacyNote'
    WHEN 8 THEN 'unknown' ELSE NULL END AS model,
  cast(o_orderkey % 101 AS double) / 100 AS confidence,
  cast(cast(o_orderdate AS date) AS string) || 'T08:00:00' AS ingest_started_at,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(cast(o_orderdate AS date) AS string)
    || 'T08:0' || cast(o_orderkey % 5 AS string) || ':' || lpad(cast(o_orderkey % 60 AS string), 2, '0')
    || '.250000' END AS ingest_timestamp,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'not json'
    ELSE '{{"type":"' || lower(o_orderpriority) || '","features":["barrier"]}}' END AS product_features,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL
    ELSE 'https://docs.example.com/' || cast(o_orderkey AS string)
      || CASE o_orderkey % 3 WHEN 0 THEN '.htm' WHEN 1 THEN '.HTML' ELSE '.pdf' END END AS source_url,
  'title ' || lower(o_orderpriority) AS title_excerpt,
  'v1' AS schema_version,
  cast(cast(o_orderdate AS date) AS string) || 'T09:00:00' AS classified_at
FROM {orders}
"""

TABLES["usage"] = """
SELECT cast(l_orderkey AS string) || '-' || cast(l_partkey AS string) || '-'
    || cast(l_suppkey AS string) || '-' || cast(l_linenumber AS string) || '-'
    || cast(cast(floor(l_extendedprice * 100) AS bigint) AS string) AS usage_id,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE cast(l_orderkey AS string) END AS filing_id,
  CASE l_linenumber WHEN 1 THEN 'classify_stage1' WHEN 2 THEN 'classify_stage2'
    WHEN 3 THEN 'extract' WHEN 4 THEN 'extract_coupon' WHEN 5 THEN 'extract_identifiers'
    WHEN 6 THEN 'extract_parties' ELSE 'extract_other' END AS call_type,
  CASE l_suppkey % 5 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' WHEN 2 THEN 'model-c'
    WHEN 3 THEN 'model-x' ELSE NULL END AS model,
  cast(floor(l_extendedprice) AS bigint) AS prompt_tokens,
  cast(floor(l_quantity * 20) AS bigint) AS completion_tokens,
  l_quantity / 4 AS duration_seconds,
  cast(floor(l_extendedprice * l_discount * 6) AS bigint) AS cache_read_tokens,
  nullif(cast(floor(l_extendedprice * l_tax * 8) AS bigint), 0) AS cache_write_tokens,
  CASE WHEN l_partkey % 97 = 0 THEN 'n/a' WHEN l_partkey % 89 = 0 THEN NULL
    ELSE cast(cast(l_shipdate AS date) AS string) || 'T'
      || lpad(cast(l_partkey % 24 AS string), 2, '0') || ':'
      || lpad(cast(l_suppkey % 60 AS string), 2, '0') || ':00' END AS called_at
FROM {lineitem}
"""

# Rows of one filing's key-terms table, in many label spellings and value forms.
TABLES["label_values"] = """
SELECT cast(l_orderkey AS string) AS filing_id,
  (cast(l_linenumber AS bigint) * 1000000 + l_partkey) * 10000 + l_suppkey AS row_no,
  CASE l_partkey % 16 WHEN 0 THEN 'Maturity Date:' WHEN 1 THEN 'CUSIP*'
    WHEN 2 THEN 'Contingent Coupon Rate(1)' WHEN 3 THEN ' Denomination '
    WHEN 4 THEN 'Initial  Value' WHEN 5 THEN 'Specified Currency' WHEN 6 THEN 'PAYMENT FREQUENCY'
    WHEN 7 THEN 'Barrier Level *' WHEN 8 THEN 'ISSUER:' WHEN 9 THEN 'CUSIP/ISIN'
    WHEN 10 THEN 'Calculation Agent' WHEN 11 THEN 'Observation Style'
    WHEN 12 THEN 'Settlement Notes' WHEN 13 THEN 'Fee Schedule:'
    WHEN 14 THEN 'Product Maturity' ELSE 'ISIN' END AS label_raw,
  CASE l_partkey % 16
    WHEN 0 THEN ' """ + "' || " + _SHIP_WORDS + """
    WHEN 1 THEN 'Q' || lpad(cast(l_partkey AS string), 8, '0')
      || CASE WHEN l_tax = 0 THEN 'Z' ELSE '(2)' END
    WHEN 2 THEN CASE l_linenumber % 3
      WHEN 0 THEN cast(l_linenumber AS string) || '.50% per annum or 0.25% per month'
      WHEN 1 THEN '$8.75 per $1,000, ' || cast(l_linenumber AS string) || '.125% (0.875% monthly)'
      ELSE 'at least ' || cast(l_linenumber * 10 AS string) || '.00% of face, 0.5% per month' END
    WHEN 3 THEN CASE WHEN l_tax = 0 THEN 'N/A' WHEN l_tax = 0.01 THEN 'US$ ' || cast(l_linenumber AS string) || '5,000,000'
      WHEN l_tax = 0.02 THEN cast(l_linenumber AS string) || ',234,567,890.25' WHEN l_tax = 0.03 THEN '$0.000' || cast(l_linenumber AS string)
      WHEN l_tax = 0.04 THEN '$' || cast(l_linenumber AS string) || '0,000,000,000' ELSE 'US$ ' || cast(l_linenumber AS string) || ','
      || lpad(cast(l_partkey % 1000 AS string), 3, '0') || '.50 per note' END
    WHEN 4 THEN CASE WHEN l_tax = 0.01 THEN '$' || cast(l_linenumber AS string) || '5,000,000.' WHEN l_tax = 0.02 THEN '0.000' || cast(l_linenumber AS string) ELSE
      '$' || cast(l_linenumber AS string) || ',' || lpad(cast(l_partkey % 1000 AS string), 3, '0') || '.25' END
    WHEN 5 THEN CASE l_linenumber % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'U.S. dollars'
      WHEN 2 THEN 'Pesos' ELSE ' eur (Euro) ' END
    WHEN 6 THEN CASE l_linenumber WHEN 1 THEN 'Monthly' WHEN 2 THEN 'every six months'
      WHEN 3 THEN 'Semi-annually' WHEN 4 THEN 'per year' WHEN 5 THEN 'each quarter'
      WHEN 6 THEN 'each day' ELSE 'ad hoc' END
    WHEN 7 THEN '$5,350.77 (' || cast(50 + l_linenumber AS string) || '.00% of its Initial Level)*'
    WHEN 8 THEN CASE WHEN l_tax = 0 THEN ' *(1)' ELSE 'Issuer ' || cast(l_suppkey AS string) || '* [3]' END
    WHEN 9 THEN 'Q' || lpad(cast(l_partkey AS string), 8, '0') || ' / USQ'
      || lpad(cast(l_partkey AS string), 8, '0') || '1'
    WHEN 10 THEN 'Agent ' || cast(l_suppkey AS string)
    WHEN 11 THEN CASE l_linenumber % 4 WHEN 0 THEN 'European' WHEN 1 THEN 'daily monitoring'
      WHEN 2 THEN 'on each Observation Date' ELSE 'n/a' END
    WHEN 12 THEN 'T+' || cast(l_linenumber AS string)
    WHEN 13 THEN CASE WHEN l_tax = 0 THEN '' ELSE 'fee ' || cast(l_suppkey AS string) END
    WHEN 14 THEN CASE l_linenumber % 3
      WHEN 0 THEN 'on or about """ + "' || " + _SHIP_WORDS + """ || '*'
      WHEN 1 THEN replace(cast(cast(l_shipdate AS date) AS string), '-', '/') ELSE 'TBD' END
    ELSE 'USQ' || lpad(cast(l_partkey AS string), 8, '0') || '1' END AS value_raw
FROM {lineitem}
"""

# Extracted fields: two extraction runs per filing, one row per (run, field path).
TABLES["fields"] = """
SELECT filing_id || '-' || cast(run AS string) || '-' || field_path AS field_id,
  filing_id || '-' || cast(run AS string) AS extraction_id, filing_id, field_path,
  CASE WHEN tax = 0 THEN NULL
    WHEN path_no = 8 THEN CASE flag WHEN 'A' THEN 'true' ELSE 'false' END
    WHEN path_no % 4 = 0 THEN cast(cast(qty AS bigint) AS string)
    WHEN path_no % 4 = 1 THEN '"' || flag || '"'
    WHEN path_no % 4 = 2 THEN 'raw ' || flag
    ELSE '{{"$type":"' || flag || '"}}' END AS value_json,
  CASE WHEN path_no % 11 = 0 THEN NULL ELSE round(discount * 10, 1) END AS confidence,
  tax = 0 AS not_found,
  CASE WHEN flag = 'R' AND path_no % 3 = 0 THEN '"' || status || '"'
    WHEN flag = 'R' AND path_no % 3 = 1 THEN '""' ELSE NULL END AS reviewed_json,
  CASE flag WHEN 'A' THEN 'pending' WHEN 'R' THEN CASE WHEN path_no % 5 = 0 THEN 'rejected' ELSE 'corrected' END
    ELSE CASE WHEN path_no % 7 = 0 THEN 'schema_error' WHEN path_no % 7 = 1 THEN NULL ELSE 'accepted' END
    END AS review_status,
  CASE WHEN flag = 'R' OR path_no % 4 = 1 THEN '2000-01-0' || cast(1 + path_no % 9 AS string) END AS reviewed_at,
  CASE WHEN path_no % 6 = 0 THEN NULL WHEN path_no % 6 = 1 THEN 'html_table' ELSE 'llm' END AS source
FROM (
  SELECT cast(l_orderkey AS string) AS filing_id, l_linenumber % 2 AS run, l_partkey % 12 AS path_no,
    CASE l_partkey % 12 WHEN 0 THEN 'identifiers.cusip' WHEN 1 THEN 'identifiers.isin'
      WHEN 2 THEN 'coupon.rate' WHEN 3 THEN 'coupon.frequency'
      WHEN 4 THEN 'structuredProductsGeneral.notional' WHEN 5 THEN 'structuredProductsGeneral.maturityDate'
      WHEN 6 THEN 'barrier.triggerDetails.triggerLevel'
      WHEN 7 THEN 'barrier.triggerDetails.observationType' WHEN 8 THEN 'autocall.callLevel'
      WHEN 9 THEN 'parties.issuer.name' WHEN 10 THEN 'product.denomination'
      ELSE 'parties.guarantor.name' END AS field_path,
    max(l_quantity) AS qty, max(l_tax) AS tax, max(l_returnflag) AS flag, max(l_linestatus) AS status,
    max(l_discount) AS discount
  FROM {lineitem} GROUP BY 1, 2, 3, 4) t
"""

TABLES["extractions"] = """
SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber % 2 AS string) AS extraction_id,
  cast(l_orderkey AS string) AS filing_id,
  cast(cast(max(l_shipdate) AS date) AS string) || 'T10:00:00' AS extracted_at,
  CASE WHEN l_linenumber % 2 = 0 THEN 'single' ELSE 'sectioned' END AS extraction_mode,
  CASE cast(floor(l_orderkey / 8) AS bigint) % 4 WHEN 0 THEN 'yieldEnhancementCoupon' WHEN 1 THEN 'yieldEnhancementAutocall'
    WHEN 2 THEN 'equityShare' ELSE 'index' END AS model,
  count(*) AS field_count, cast(sum(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) AS bigint) AS fields_found
FROM {lineitem} GROUP BY l_orderkey, l_linenumber % 2
"""




_TWELVE = """CASE {c} % 12 WHEN 0 THEN 'identifiers.cusip' WHEN 1 THEN 'identifiers.isin'
  WHEN 2 THEN 'coupon.rate' WHEN 3 THEN 'coupon.frequency'
  WHEN 4 THEN 'structuredProductsGeneral.notional' WHEN 5 THEN 'structuredProductsGeneral.maturityDate'
  WHEN 6 THEN 'barrier.triggerDetails.triggerLevel'
  WHEN 7 THEN 'barrier.triggerDetails.observationType' WHEN 8 THEN 'autocall.callLevel'
  WHEN 9 THEN 'parties.issuer.name' WHEN 10 THEN 'product.denomination'
  ELSE 'parties.guarantor.name' END"""

# Section-level model answers, already flattened.
TABLES["section_values"] = f"""
SELECT cast(l_orderkey AS string) AS filing_id,
  (cast(l_linenumber AS bigint) * 1000000 + l_partkey) * 10000 + l_suppkey AS ord,
  {_TWELVE.format(c="l_partkey")} AS field_path,
  CASE WHEN l_tax = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN '"' || l_returnflag || '"'
    WHEN l_partkey % 5 = 1 THEN 'true' ELSE cast(cast(l_quantity AS bigint) AS string) END AS value_json,
  CASE WHEN l_suppkey % 13 = 0 THEN -0.2 WHEN l_suppkey % 11 = 0 THEN NULL
    ELSE cast(l_discount * 10 + 0 AS double) END AS confidence,
  'excerpt ' || cast(l_suppkey AS string) AS excerpt
FROM {{lineitem}}"""

# Model answers as the payload text a batch inference run returns.
_GOOD_PAYLOAD = ("""'{{"_confidence":{{"coupon.rate":' || CASE l_linenumber % 4 WHEN 0 THEN '0.75' WHEN 1 THEN '1.5' """
    """WHEN 2 THEN '-0.3' ELSE 'null' END || ',"flag":true,"identifiers.cusip":" 0.8 ","schedule":"high"}},"""
    """"_excerpts":{{"coupon.rate":"at ' || cast(l_linenumber AS string) || '.25%"}},"data":{{"coupon":{{"frequency":{{"$type":"monthly"}},"""
    """"rate":' || cast(l_linenumber AS string) || '.25}},"empty":{{}},"flag":true,"identifiers":{{"cusip":"Q' || cast(l_partkey AS string) """
    """|| '","isin":null}},"list":[{{"a":1}}],"model":"m","named":{{"note":1.50,"2024-01-01T00:00:00Z":1e7,"2024-02-01T00:00:00Z":1.0,"2024-03-01T00:00:00Z":[2.0,1E3]}},"""
    """"schedule":{{"2024-01-01T00:00:00Z":{{"a":1}}}},""" + "".join(f'"k{i}":{{{{' for i in range(1, 12)) + """"k12":-0.00005""" + "}}" * 11 + """}}}}'""")
# Answers that a strict reader refuses, by the key that comes first: half a surrogate pair, equal keys, 1,500 levels, 5,000 digits, NaN.
ODD_ANSWERS = {
    1: r"""'{{"odd1":0,"data":{{"s":"a' || chr(92) || 'ud83db"}}}}'""", 2: """'{{"odd2":0,"data":{{"a":1,"b":3,"a":2}},"_confidence":{{"a":0.25}}}}'""",
    3: """'{{"odd3":0,"data":' || repeat('{{"x":', 1500) || '1' || repeat('}}', 1500) || '}}'""",
    4: """'{{"odd4":0,"data":{{"n":' || repeat('9', 5000) || '}}}}'""", 5: """'{{"odd5":0,"data":{{"n":NaN,"m":1}}}}'"""}
TABLES["answers"] = f"""
SELECT cast(l_orderkey AS string) AS filing_id,
  (cast(l_linenumber AS bigint) * 1000000 + l_partkey) * 10000 + l_suppkey AS ord,
  CASE l_partkey % 8 WHEN 7 THEN NULL WHEN 6 THEN 'other_tool' ELSE 'submit_extraction' END AS tool_name,
  CASE CASE WHEN l_partkey % 8 = 5 AND l_suppkey % 100 BETWEEN 1 AND 5 THEN l_suppkey % 100 + 10 ELSE l_partkey % 8 END
    {" ".join(f"WHEN {k + 10} THEN {text}" for k, text in ODD_ANSWERS.items())}
    WHEN 4 THEN '{{{{"_confidence":null,"_excerpts":[],"data":""}}}}'
    WHEN 5 THEN '{{{{"data": {{{{'
    WHEN 7 THEN '```json' || chr(10) || '{{{{"_confidence":{{{{"a.b":2}}}},"_excerpts":{{{{"c":"see ' || cast(l_suppkey AS string)
      || '"}}}},"a":{{{{"b":"x"}}}},"c":' || cast(l_suppkey AS string) || '}}}}' || chr(10) || '```'
    ELSE {_GOOD_PAYLOAD} END AS payload
FROM {{lineitem}}"""

# Field descriptors per model; allowed values are comma-separated text here.
TABLES["descriptors"] = f"""
SELECT model, field_path, max(p_type) AS label, 'string' AS data_type, max(p_name) AS description,
  model = 'index' AND field_path = 'identifiers.cusip' OR model LIKE '%Coupon' AND field_path = 'coupon.rate'
    OR max(p_size) = 50 AND field_path LIKE '%.blue' AND model = 'index' AS required,
  CASE WHEN min(p_size) % 2 = 0 THEN 'A,' || min(p_brand) || ',True,' || cast(min(p_size) AS string) END AS enum_text
FROM (SELECT *, CASE p_partkey % 9 WHEN 0 THEN 'yieldEnhancementCoupon' WHEN 1 THEN 'yieldEnhancementBarrierCoupon'
    WHEN 2 THEN 'yieldEnhancementAutocallCoupon' WHEN 3 THEN 'yieldEnhancementAutocallBarrierCoupon'
    WHEN 4 THEN 'yieldEnhancementAutocall' WHEN 5 THEN 'forwardKoStripEquity' WHEN 6 THEN 'equityShare'
    WHEN 7 THEN 'index' ELSE 'depositaryReceipt' END AS model,
  CASE WHEN p_size % 3 > 0 THEN {_TWELVE.format(c="p_size")}
    ELSE lower(p_type) || '.' || split_part(p_name, ' ', 1) END AS field_path FROM {{part}}) t
GROUP BY model, field_path"""


# Tables only the SQL checks use (Spark gets the same facts as literals or arguments).
CHECK_TABLES: dict[str, str] = {
    # Prices in units of 1e-4 USD per million tokens, so that sums are whole numbers.
    "pricing": "SELECT * FROM (VALUES " + ", ".join(
        f"('{p['model_id']}', '{p['display_name']}', {int(p['input_price'] * 10000)}, "
        f"{int(p['output_price'] * 10000)}, {int(p['cache_write_price'] * 10000)}, "
        f"{int(p['cache_read_price'] * 10000)})" for p in PRICING)
    + ") t(model_id, display_name, input_units, output_units, cache_write_units, cache_read_units)",
    "priced": f"""
      SELECT u.*,
        greatest(0, prompt_tokens - coalesce(cache_read_tokens, 0) - coalesce(cache_write_tokens, 0))
            * coalesce(p.input_units, d.input_units)
          + coalesce(cache_write_tokens, 0) * coalesce(p.cache_write_units, d.cache_write_units)
          + coalesce(cache_read_tokens, 0) * coalesce(p.cache_read_units, d.cache_read_units)
          + completion_tokens * coalesce(p.output_units, d.output_units) AS cost,
        coalesce(cache_read_tokens, 0) * (coalesce(p.input_units, d.input_units)
          - coalesce(p.cache_read_units, d.cache_read_units)) AS savings,
        coalesce(p.input_units, d.input_units) - coalesce(p.cache_read_units, d.cache_read_units) AS margin
      FROM {{usage}} u LEFT JOIN {{pricing}} p ON u.model = p.model_id
      JOIN {{pricing}} d ON d.model_id = '{DEFAULT_MODEL}'""",
}


def check_sql(name: str) -> str:
    return CHECK_TABLES.get(name) or TABLES[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or a test table by its own name."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    used = {n for _, n, _, _ in string.Formatter().parse(sql) if n}
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in used})


def usd(units: str, digits: int) -> str:
    """Check-side twin of the half-up conversion from 1e-10 USD units to a double."""
    step = 10 ** (10 - digits)
    return (f"(sign({units}) * ((abs({units})::hugeint + {step // 2}) // {step}) * {step})::double / 10000000000.0::double")
