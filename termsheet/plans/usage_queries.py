"""Usage and cost queries."""

from __future__ import annotations

from termsheet.config import STEP_LABELS
from termsheet.operators import usage as ops
from termsheet.plans.domain import AS_OF, DEFAULT_MODEL, PRICING, table, usd
from termsheet.plans.registry import query


def costed(spark, sf):
    return ops.call_cost(table(spark, sf, "usage"), PRICING, DEFAULT_MODEL)


@query("u1_call_cost", """
SELECT usage_id, filing_id, call_type, model, cost::double / 1e10::double AS cost_usd FROM {priced}""")
def u1(spark, sf):
    return costed(spark, sf).selectExpr("usage_id", "filing_id", "call_type", "model",
                                        "cost_usd")


@query("u2_cache_savings", """
SELECT usage_id, coalesce(model, '') AS model, savings::double / 1e10::double AS cache_savings_usd FROM {priced}""")
def u2(spark, sf):
    return costed(spark, sf).selectExpr("usage_id", "coalesce(model, '') AS model",
                                        "cache_savings_usd")


@query("u3_usage_with_filing", """
SELECT usage_id, u.filing_id, coalesce(f.model, 'unknown') AS filing_model,
  coalesce(f.issuer_name, 'Unknown') AS issuer_name
FROM {usage} u LEFT JOIN {filings} f ON u.filing_id = f.filing_id""")
def u3(spark, sf):
    return (ops.with_filing(table(spark, sf, "usage"), table(spark, sf, "filings"))
            .select("usage_id", "filing_id", "filing_model", "issuer_name"))


_SUMMARY = f"""
WITH a AS (SELECT *, called_at >= '2001-06-08T00:00:00' AS wk, called_at >= '2001-05-16T00:00:00' AS mo FROM {{priced}}),
s AS (SELECT sum(cost) AS cost_u, sum(savings) AS savings_u, count(*) AS calls,
  count(DISTINCT filing_id) AS filings, sum(prompt_tokens) AS tin, sum(completion_tokens) AS tout,
  sum(coalesce(cache_read_tokens, 0)) AS crd, sum(coalesce(cache_write_tokens, 0)) AS cwr,
  sum(CASE WHEN wk THEN cost ELSE 0 END) AS week_u, sum(CASE WHEN mo THEN cost ELSE 0 END) AS month_u,
  count(DISTINCT CASE WHEN wk THEN filing_id END) AS week_filings,
  count(DISTINCT CASE WHEN mo THEN filing_id END) AS month_filings,
  sum(CASE WHEN call_type LIKE 'classify%' THEN cost ELSE 0 END) AS classify_u,
  sum(CASE WHEN call_type = 'classify_stage2' THEN cost ELSE 0 END) AS stage2_u FROM a),
t AS (SELECT *, cost_u::double / 1e10::double AS cost, classify_u::double / 1e10::double AS classify_cost,
  stage2_u::double / 1e10::double AS stage2_cost FROM s),
f AS (SELECT count(*) AS found FROM {{fields}} WHERE NOT not_found)
"""


def _summary(spark, sf):
    return ops.summary(costed(spark, sf), AS_OF, table(spark, sf, "fields"))


@query("u4_totals", _SUMMARY + f"""
SELECT {usd('cost_u', 4)} AS total_cost_usd, {usd('savings_u', 6)} AS cache_savings_usd, calls AS total_calls,
  filings AS total_filings, tin::bigint AS input_tokens, tout::bigint AS output_tokens,
  crd::bigint AS cache_read_tokens, cwr::bigint AS cache_write_tokens FROM t""")
def u4(spark, sf):
    return _summary(spark, sf).select(
        "total_cost_usd", "cache_savings_usd", "total_calls", "total_filings", "input_tokens",
        "output_tokens", "cache_read_tokens", "cache_write_tokens")


@query("u5_rolling_spend", _SUMMARY + f"""
SELECT {usd('week_u', 4)} AS week_cost_usd, {usd('month_u', 4)} AS month_cost_usd, week_filings, month_filings FROM t""")
def u5(spark, sf):
    return _summary(spark, sf).select("week_cost_usd", "month_cost_usd", "week_filings", "month_filings")


@query("u6_by_step", f"""
WITH g AS (SELECT call_type, count(*) AS calls, sum(prompt_tokens)::bigint AS input_tokens,
  sum(completion_tokens)::bigint AS output_tokens, sum(coalesce(cache_read_tokens, 0))::bigint AS cache_read_tokens,
  sum(coalesce(cache_write_tokens, 0))::bigint AS cache_write_tokens, sum(cost) AS c, sum(savings) AS s
  FROM {{priced}} GROUP BY call_type)
SELECT call_type, CASE call_type WHEN 'classify_stage1' THEN 'Classify — stage 1'
    WHEN 'classify_stage2' THEN 'Classify — stage 2 (fallback overhead)' WHEN 'extract' THEN 'Extract — single call'
    WHEN 'extract_coupon' THEN 'Extract — coupon' WHEN 'extract_identifiers' THEN 'Extract — identifiers'
    WHEN 'extract_parties' THEN 'Extract — parties' ELSE call_type END AS label,
  calls, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, {usd('c', 6)} AS cost_usd,
  {usd('s', 6)} AS cache_savings_usd, round({usd('c', 6)} / (sum(c) OVER ()::double / 1e10::double) * 100, 1) AS pct_of_total,
  round({usd('c', 6)} / calls, 6) AS avg_cost_per_call FROM g""")
def u6(spark, sf):
    return ops.by_step(costed(spark, sf))


@query("u7_by_model", f"""
SELECT coalesce(f.model, 'unknown') AS model, count(*) AS calls, {usd('sum(cost)', 6)} AS cost_usd
FROM {{priced}} u LEFT JOIN {{filings}} f ON u.filing_id = f.filing_id GROUP BY 1""")
def u7(spark, sf):
    return ops.by_model(costed(spark, sf), table(spark, sf, "filings"))


@query("u8_by_issuer", f"""
SELECT coalesce(f.issuer_name, 'Unknown') AS issuer_name, count(*) AS calls, {usd('sum(cost)', 6)} AS cost_usd
FROM {{priced}} u LEFT JOIN {{filings}} f ON u.filing_id = f.filing_id GROUP BY 1""")
def u8(spark, sf):
    return ops.by_issuer(costed(spark, sf), table(spark, sf, "filings"))


def _breakdown(dimension: str, key: str, label: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {key} AS key, {label} AS label, count(*) AS calls, sum(prompt_tokens)::bigint AS input_tokens,
  sum(completion_tokens)::bigint AS output_tokens, sum(coalesce(cache_read_tokens, 0))::bigint AS cache_read_tokens,
  sum(coalesce(cache_write_tokens, 0))::bigint AS cache_write_tokens, sum(cost) AS c, sum(savings) AS s
FROM {{priced}} u LEFT JOIN {{filings}} f ON u.filing_id = f.filing_id GROUP BY 2, 3"""


_STEP_LABEL = "CASE call_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEP_LABELS.items()) + " ELSE coalesce(call_type, 'unknown') END"


@query("u6_u7_u8_breakdowns", "WITH b AS (" + " UNION ALL ".join((
    _breakdown("step", "coalesce(call_type, 'unknown')", _STEP_LABEL), _breakdown("model", "coalesce(f.model, 'unknown')", "coalesce(f.model, 'unknown')"),
    _breakdown("issuer", "coalesce(f.issuer_name, 'Unknown')", "coalesce(f.issuer_name, 'Unknown')"))) + f""")
SELECT * EXCLUDE (c, s), {usd('c', 6)} AS cost_usd, {usd('s', 6)} AS cache_savings_usd,
  round({usd('c', 6)} / (sum(c) OVER (PARTITION BY dimension)::double / 1e10::double) * 100, 1) AS pct_of_total, round({usd('c', 6)} / calls, 6) AS avg_cost_per_call FROM b""")
def u678(spark, sf):
    return ops.breakdowns(costed(spark, sf), table(spark, sf, "filings"))


@query("u9_unit_economics", _SUMMARY + f"""
SELECT found AS fields_found, round(cost / filings, 6) AS cost_per_filing,
  round(cost / found, 6) AS cost_per_field_found, round(tin / filings, 0) AS avg_input_per_filing,
  round(tout / tin * 100, 1) AS output_input_ratio_pct, round(classify_cost / cost * 100, 1) AS classify_overhead_pct,
  round(stage2_cost / classify_cost * 100, 1) AS stage2_overhead_pct, {usd('stage2_u', 6)} AS stage2_cost_usd,
  round(crd / tin * 100, 1) AS cache_hit_rate_pct FROM t, f""")
def u9(spark, sf):
    return _summary(spark, sf).select(
        "fields_found", "cost_per_filing", "cost_per_field_found", "avg_input_per_filing",
        "output_input_ratio_pct", "classify_overhead_pct", "stage2_overhead_pct", "stage2_cost_usd",
        "cache_hit_rate_pct")


@query("u10_projection", _SUMMARY + f"""
SELECT CASE WHEN month_filings > 0 THEN {usd('month_u', 4)} END AS monthly_run_rate_usd, month_filings,
  round(cost / filings * 100, 4) AS per_100_filings_usd,
  CASE WHEN month_filings > 0 THEN round({usd('month_u', 4)} * 12, 2) END AS annual_estimate_usd FROM t""")
def u10(spark, sf):
    return _summary(spark, sf).select("monthly_run_rate_usd", "month_filings", "per_100_filings_usd",
                                      "annual_estimate_usd")


@query("u11_model_comparison", f"""
WITH t AS (SELECT sum(prompt_tokens) AS tin, sum(completion_tokens) AS tout, sum(cost) AS cost FROM {{priced}}),
e AS (SELECT model_id, display_name, tin * input_units + tout * output_units AS est, cost FROM t, {{pricing}})
SELECT model_id, display_name, {usd('est', 4)} AS est_cost_usd, {usd('(est - cost)', 4)} AS delta_usd,
  round((est - cost)::double / cost::double * 100, 1) AS delta_pct FROM e""")
def u11(spark, sf):
    return ops.model_comparison(costed(spark, sf), PRICING)


def _timeline_sql(fmt: str) -> str:
    return f"""
SELECT strftime(try_cast(called_at AS timestamp), '{fmt}') AS label,
  {usd("sum(CASE WHEN call_type LIKE 'classify%' THEN cost ELSE 0 END)", 6)} AS classify_cost_usd,
  {usd("sum(CASE WHEN call_type LIKE 'classify%' THEN 0 ELSE cost END)", 6)} AS extract_cost_usd,
  {usd('sum(savings)', 6)} AS cache_savings_usd, {usd('sum(cost)', 6)} AS total_cost_usd,
  count(*) AS calls
FROM {{priced}} WHERE try_cast(called_at AS timestamp) IS NOT NULL GROUP BY 1"""


for _granularity, _fmt in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m")):
    def _timeline(spark, sf, granularity=_granularity):
        return ops.timeline(costed(spark, sf), granularity)
    query(f"u12_timeline_{_granularity}", _timeline_sql(_fmt))(_timeline)


def _phase_sql(phase: str) -> str:
    return f"""
  {phase} AS (SELECT filing_id, count(*) AS {phase}_calls,
    min_by(struct_pack(called_at := called_at, d := margin), struct_pack(a := called_at, b := usage_id)) AS w,
    round(nullif(sum(duration_seconds), 0), 2) AS {phase}_seconds, sum(prompt_tokens)::bigint AS {phase}_input_tokens,
    sum(completion_tokens)::bigint AS {phase}_output_tokens,
    sum(coalesce(cache_read_tokens, 0))::bigint AS {phase}_cache_read_tokens,
    sum(coalesce(cache_write_tokens, 0))::bigint AS {phase}_cache_write_tokens,
    {usd('sum(cost)', 6)} AS {phase}_cost_usd FROM p WHERE call_type LIKE '{phase}%' GROUP BY 1)"""


def _phase_columns(phase: str, alias: str) -> str:
    return ", ".join(
        [f"{alias}.w.called_at AS {phase}_called_at",
         f"{usd(f'({phase}_cache_read_tokens * {alias}.w.d)', 6)} AS {phase}_savings_usd"]
        + [f"{phase}_{c}" for c in ("seconds", "input_tokens", "output_tokens", "cache_read_tokens",
                                    "cache_write_tokens", "cost_usd", "calls")])


# A null call time sorts first in Spark and last in the check; an empty text keeps both alike.
@query("u13_filing_kpis", f"""
WITH p AS (SELECT * REPLACE (coalesce(called_at, '') AS called_at) FROM {{priced}}), {_phase_sql('classify')}, {_phase_sql('extract')}
SELECT f.filing_id, round(date_diff('microsecond', ingest_started_at::timestamp, ingest_timestamp::timestamp) / 1000000, 2)
  AS ingest_seconds, {_phase_columns('classify', 'c')}, {_phase_columns('extract', 'e')}
FROM {{filings}} f LEFT JOIN classify c ON f.filing_id = c.filing_id LEFT JOIN extract e ON f.filing_id = e.filing_id""")
def u13(spark, sf):
    calls = costed(spark, sf).selectExpr("* EXCEPT (called_at)", "coalesce(called_at, '') AS called_at")
    return ops.filing_kpis(calls, table(spark, sf, "filings"), PRICING, DEFAULT_MODEL)


@query("u14_recent_usage", """
SELECT usage_id, filing_id, call_type, model, prompt_tokens, completion_tokens, called_at FROM {usage}
ORDER BY called_at DESC NULLS LAST, usage_id LIMIT 100""")
def u14(spark, sf):
    return ops.recent_usage(table(spark, sf, "usage"), 100)


@query("u15_empty_summary", """
SELECT coalesce(sum(cost), 0)::double AS total_cost_usd, 0::double AS week_cost_usd, 0::double AS month_cost_usd,
  count(*) AS total_calls, count(DISTINCT filing_id) AS total_filings, NULL::double AS cost_per_filing
FROM {priced} WHERE call_type = 'archive'""")
def u15(spark, sf):
    nothing = costed(spark, sf).filter("call_type = 'archive'")      # no such step in the log
    return ops.summary(nothing, AS_OF).select(
        "total_cost_usd", "week_cost_usd", "month_cost_usd", "total_calls", "total_filings", "cost_per_filing")


@query("u16_field_counts", """
SELECT field_path, count(*) AS rows_found FROM {fields} WHERE NOT not_found GROUP BY 1""")
def u16a(spark, sf):
    return ops.field_counts(table(spark, sf, "fields"))


@query("u16_active_models", """
SELECT model, count(*) AS filings FROM {filings} WHERE model IS NOT NULL AND model <> 'unknown' GROUP BY 1""")
def u16b(spark, sf):
    return ops.active_models(table(spark, sf, "filings"))


@query("u17_spend_signals", _SUMMARY + f"""
SELECT round({usd('month_u', 4)} * 0.5, 4) AS batch_estimate_usd,
  round(round(stage2_cost / classify_cost * 100, 1) * round(classify_cost / cost * 100, 1) / 100, 4)
    AS stage2_share_of_total_pct FROM t""")
def u17(spark, sf):
    return _summary(spark, sf).select("batch_estimate_usd", "stage2_share_of_total_pct")


@query("u17_step_token_totals", """
SELECT sum(prompt_tokens)::bigint AS input_tokens, sum(completion_tokens)::bigint AS output_tokens,
  sum(coalesce(cache_read_tokens, 0))::bigint AS cache_read_tokens,
  sum(coalesce(cache_write_tokens, 0))::bigint AS cache_write_tokens FROM {usage}""")
def u17b(spark, sf):
    return ops.step_token_totals(ops.by_step(costed(spark, sf)))
