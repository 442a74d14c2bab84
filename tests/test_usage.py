"""Cost rules and additivity."""

import pytest
from pyspark.sql import functions as F

from termsheet.functions.times import week_label
from termsheet.operators import usage
from termsheet.plans.domain import DEFAULT_MODEL, PRICING, table

SF = "/root/testdata/sf0.001"
CALLS = "usage_id STRING, filing_id STRING, call_type STRING, model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, " \
        "duration_seconds DOUBLE, cache_read_tokens BIGINT, cache_write_tokens BIGINT, called_at STRING"


def test_cost_of_one_call(spark):
    rows = [("1", "f", "extract", "model-b", 1000, 10, 1.0, 300, 200, "2024-01-01T00:00:00"), ("2", "f", "extract", None, 100, 0, None, 300, None, None),
            ("3", None, None, "nobody", None, None, None, None, None, "bad")]
    got = {r["usage_id"]: (r["cost_usd"], r["cache_savings_usd"]) for r in usage.call_cost(spark.createDataFrame(rows, CALLS), PRICING, DEFAULT_MODEL).collect()}
    assert got["1"] == pytest.approx(((500 * 1 + 200 * 1.25 + 300 * 0.1 + 10 * 5) / 1e6, 300 * 0.9 / 1e6))
    assert got["2"] == pytest.approx((300 * 0.3 / 1e6, 300 * 2.7 / 1e6))         # plain input never below zero
    assert got["3"] == (0.0, 0.0)


def test_costs_add_up(spark):
    costed = usage.call_cost(table(spark, SF, "usage"), PRICING, DEFAULT_MODEL)
    filings = table(spark, SF, "filings")
    total = usage.summary(costed, "2001-06-15T00:00:00").first()["total_cost_usd"]
    for part in (usage.by_step(costed), usage.by_model(costed, filings), usage.by_issuer(costed, filings)):
        assert part.agg(F.sum("cost_usd")).first()[0] == pytest.approx(total, abs=1e-3)
    steps = usage.by_step(costed).agg(F.sum("pct_of_total")).first()[0]
    assert steps == pytest.approx(100, abs=0.5)


def test_empty_log_gives_a_zero_row(spark):
    costed = usage.call_cost(spark.createDataFrame([], CALLS), PRICING, DEFAULT_MODEL)
    row = usage.summary(costed, "2024-01-01T00:00:00").first()
    assert (row["total_cost_usd"], row["total_calls"], row["cost_per_filing"], row["monthly_run_rate_usd"]) == (0.0, 0, None, None)
    assert usage.by_step(costed).count() == 0 and usage.timeline(costed, "day").count() == 0


def test_prices_finer_than_the_unit_are_refused():
    with pytest.raises(ValueError):
        usage._price_units({"model_id": "x", "input_price": 0.00001}, "input_price")


def test_week_labels_match_strftime(spark):
    days = spark.sql("SELECT explode(sequence(date'2023-12-20', date'2027-01-10')) AS d")
    for r in days.select("d", week_label(F.col("d")).alias("w")).collect():
        assert r["w"] == r["d"].strftime("%Y-W%W")


def test_kpi_savings_use_the_first_call(spark):
    rows = [("1", "f", "classify_stage1", "model-a", 1000, 0, 2.0, 100, None, "2024-01-02T00:00:00"),
            ("2", "f", "classify_stage2", "model-c", 1000, 0, 3.5, 100, None, "2024-01-01T00:00:00")]
    filings = spark.createDataFrame([("f", "2024-01-01T00:00:00", "2024-01-01T00:00:01.5"), ("g", None, "x")],
                                    "filing_id STRING, ingest_started_at STRING, ingest_timestamp STRING")
    got = {r["filing_id"]: r for r in usage.filing_kpis(usage.call_cost(spark.createDataFrame(rows, CALLS), PRICING, DEFAULT_MODEL),
                                                        filings, PRICING, DEFAULT_MODEL).collect()}
    assert got["f"]["ingest_seconds"] == 1.5 and got["f"]["classify_seconds"] == 5.5 and got["f"]["classify_calls"] == 2
    assert got["f"]["classify_savings_usd"] == pytest.approx(200 * (10 - 1.0) / 1e6) and got["f"]["extract_calls"] is None
    assert got["g"]["ingest_seconds"] is None and got["g"]["classify_calls"] is None
