"""Export sinks (S17, S18): nested JSON documents and flat CSV per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termsheet.functions.jsonvalues import scalar_text
from termsheet.functions.text import json_string
from termsheet.operators.export import nested

_ABOUT = ["cusip", "accession_number", "issuer_name", "filing_date", "filing_url", "model", "schema_version", "extracted_at"]


def export_documents(filings: DataFrame, extractions: DataFrame, values: DataFrame, at: str) -> DataFrame:
    """One JSON document per filing: metadata, nested fields, review status; and its file name.

    ``extractions`` is the latest run per exported filing, ``values`` its effective values.
    """
    tag = extractions.filter("model IS NOT NULL").select("filing_id", F.array(F.lit("model")).alias("path"), json_string(F.col("model")).alias("json"))
    written = F.col("value_json").isNotNull() & (F.col("value_json") != "null")
    rows = values.select("filing_id", "field_path", "review_status", F.when(written, F.split("field_path", r"\.")).alias("path"),
                         F.col("value_json").alias("json")).unionByName(tag, allowMissingColumns=True)
    grouped = rows.groupBy("filing_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "json")))).alias("leaves"),
        F.array_sort(F.collect_list(F.when(F.col("field_path").isNotNull(), F.struct("field_path", "review_status")))).alias("s"))
    fields = grouped.filter(F.size("leaves") > 0).select("filing_id", nested("leaves").alias("nested_json"), "s")
    about = (extractions.select("filing_id", "model", "extracted_at")
             .join(filings.select("filing_id", "cusip", "accession_number", "issuer_name", "filing_date",
                                  F.col("source_url").alias("filing_url"), "schema_version"), "filing_id"))
    known = about.withColumns({
        "cusip": F.coalesce("cusip", F.lit("UNKNOWN")),
        **{c: F.coalesce(c, F.lit("")) for c in ("issuer_name", "filing_date", "filing_url")}})
    stamped = F.to_json(F.struct(*_ABOUT, F.lit(at).alias("approved_at"), F.lit(at).alias("export_generated_at")))
    review = F.concat(F.lit("{"), F.array_join(F.transform("s", lambda r: F.concat(
        json_string(r["field_path"]), F.lit(":"), json_string(r["review_status"]))), ","), F.lit("}"))
    name = F.concat_ws("_", F.regexp_replace("cusip", "[^A-Za-z0-9]", ""),
                       F.regexp_replace("model", "[^A-Za-z0-9_]", "_"), F.lit(at[:10]))
    return (known.join(fields, "filing_id").select(
        "filing_id", "model", name.alias("file_name"), F.concat(
            F.lit('{"export_metadata":'), stamped, F.lit(',"fields":'), F.col("nested_json"),
            F.lit(',"field_review_status":'), F.coalesce(review, F.lit("{}")), F.lit("}")).alias("document")))


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as JSON lines, partitioned by model."""
    documents.select("model", F.col("document").alias("value")).write.mode("append").partitionBy("model").text(path)


def flat_rows(filings: DataFrame, extractions: DataFrame, values: DataFrame, field_paths: list[str]) -> DataFrame:
    """One row per filing; a column per field, sorted; missing values empty, truth values ``True`` and ``False``.

    The columns are the model's field list, given, so no pass over the data is spent on finding
    them and the pivot is a single grouped aggregate.
    """
    def cell(path: str):
        raw = F.max(F.when(F.col("field_path") == path, F.col("value_json")))
        return F.coalesce(F.when(raw != "null", scalar_text(raw)), F.lit("")).alias(path)
    wide = values.groupBy("filing_id").agg(*[cell(p) for p in sorted(field_paths)])
    about = filings.select("filing_id", F.coalesce("cusip", F.lit("UNKNOWN")).alias("cusip"), "schema_version",
                           F.coalesce("filing_date", F.lit("")).alias("filing_date"))
    return (extractions.select("filing_id", "model").join(about, "filing_id").join(wide, "filing_id")
            .select("filing_id", "cusip", F.col("model").alias("payout_type_id"), "schema_version", "filing_date",
                    *[F.col(f"`{p}`") for p in sorted(field_paths)]))


def write_flat(rows: DataFrame, path: str) -> None:
    rows.drop("filing_id").write.mode("append").csv(path, header=True, emptyValue="", quoteAll=False)
