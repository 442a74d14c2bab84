"""Batch-run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from termsheet import config

_DONE = config.DONE_STATES


def status_snapshot(filings: DataFrame) -> DataFrame:
    """Filings per status."""
    return filings.groupBy("status").agg(F.count("*").alias("filings"))


def classify_outcome(gate: float = config.GATE_CONFIDENCE) -> Column:
    """R2: outcome of one classify call from ``error``, ``status``, ``model`` and ``confidence``."""
    return (F.when(F.col("error").isNotNull(), F.lit("failed"))
            .when((F.col("status") == "classified") & (F.col("confidence") >= gate), F.lit("ok"))
            .when(F.col("status") == "needs_review", F.lit("needs_review"))
            .when(F.col("model") == "unknown", F.lit("unknown")).otherwise(F.lit("ok")))


def extract_outcome() -> Column:
    """R2: outcome of one extract call; a refusal that names gate or confidence is gate-blocked."""
    text = F.lower("message")
    return (F.when(F.col("error").isNotNull(), F.lit("failed"))
            .when(text.contains("gate") | text.contains("confidence"), F.lit("gate_blocked"))
            .when(F.col("message").isNotNull(), F.lit("failed")).otherwise(F.lit("ok")))


def outcome_counts(calls: DataFrame) -> DataFrame:
    """R2: calls per phase and outcome (``phase`` is classify or extract)."""
    outcome = F.when(F.col("phase") == "classify", classify_outcome()).otherwise(extract_outcome())
    return calls.groupBy("phase", outcome.alias("outcome")).agg(F.count("*").alias("calls"))


def issuer_breakdown(calls: DataFrame) -> DataFrame:
    """Classified, needs_review, extracted and failed calls per issuer.

    A gate-blocked or refused extraction counts for no column; an extraction that raised is a
    failure.
    """
    bucket = F.when(F.col("phase") == "classify", F.when(classify_outcome() == "ok", F.lit("classified"))
                    .when(classify_outcome() == "failed", F.lit("failed")).otherwise(F.lit("needs_review"))
                    ).otherwise(F.when(F.col("error").isNotNull(), F.lit("failed"))
                                .when(F.col("message").isNull(), F.lit("extracted")))
    kinds = ["classified", "needs_review", "extracted", "failed"]
    return (calls.withColumn("bucket", bucket).filter("bucket IS NOT NULL")
            .groupBy(F.coalesce("issuer_name", F.lit("Unknown")).alias("issuer_name"))
            .agg(*[F.count_if(F.col("bucket") == k).alias(k) for k in kinds]).orderBy("issuer_name"))


def fill_rates(extractions: DataFrame) -> DataFrame:
    """Found over total per extraction with fields."""
    return (extractions.filter("field_count > 0")
            .select("extraction_id", "filing_id", "fields_found", "field_count",
                    F.round(F.col("fields_found") / F.col("field_count") * 100, 0).alias("fill_pct")))


def issuer_fill_rates(extractions: DataFrame, filings: DataFrame) -> DataFrame:
    """Mean fill rate per issuer."""
    rows = extractions.filter("field_count > 0").join(filings.select("filing_id", "issuer_name"), "filing_id", "left")
    rate = F.col("fields_found") / F.col("field_count")
    return (rows.groupBy(F.coalesce("issuer_name", F.lit("Unknown")).alias("issuer_name"))
            .agg(F.count("*").alias("extractions"), F.round(F.avg(rate) * 100, 2).alias("avg_fill_pct")))


def work_list(filings: DataFrame, reextract: bool = False) -> DataFrame:
    """Filings to classify and to extract in a run."""
    step = F.when(F.col("status") == "ingested", F.lit("classify")).when(F.col("status") == "classified", F.lit("extract"))
    if reextract:
        step = step.when(F.col("status").isin(_DONE), F.lit("reextract"))
    return filings.select("filing_id", step.alias("step")).filter("step IS NOT NULL")


def work_counts(filings: DataFrame, reextract: bool = False) -> DataFrame:
    """Sizes of the work list; extraction may also reach what is classified first."""
    rows = work_list(filings, reextract)
    return rows.agg(F.count_if(F.col("step") == "classify").alias("to_classify"), F.count("*").alias("to_extract_at_most"))


def manual_review(after: DataFrame) -> DataFrame:
    """Filings left for a person: in review, or still ingested after the run."""
    return (after.filter(F.col("status").isin("needs_review", "ingested"))
            .select("filing_id", "cusip", "issuer_name", F.when(F.col("status") == "ingested", F.lit("classify failed"))
                    .otherwise(F.lit("needs review")).alias("why")))


def backfill_targets(filings: DataFrame, metadata: DataFrame, force: bool = False) -> DataFrame:
    """Filings without folder, without readable metadata, or without images in it."""
    if force:
        return filings.select("filing_id")
    images = F.try_variant_get(F.try_parse_json("metadata_json"), "$.images", "array<string>")
    known = metadata.select("filing_id", F.coalesce(F.size(images), F.lit(0)).alias("images"))
    return (filings.join(known, "filing_id", "left")
            .filter((F.coalesce("folder_path", F.lit("")) == "") | (F.coalesce("images", F.lit(0)) <= 0)).select("filing_id"))


def ingest_gap(targets: DataFrame, filings: DataFrame) -> DataFrame:
    """Target CUSIPs (issuer_name, cusips ARRAY) that are not stored yet."""
    wanted = targets.select("issuer_name", F.explode("cusips").alias("cusip"))
    return wanted.join(filings.select("cusip").filter("cusip IS NOT NULL"), "cusip", "left_anti")


def ingest_outcomes(results: DataFrame) -> DataFrame:
    """Ingest results grouped as ok, no hits and failed."""
    outcome = (F.when(F.col("result").isin("ingested", "already_exists"), F.lit("ok"))
               .when(F.col("result") == "no_edgar_hits", F.lit("no_hits")).otherwise(F.lit("failed")))
    return results.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("filings"))
