"""Review values and export: effective value, gates, nesting, batch split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from termsheet import config
from termsheet.functions.text import json_string, let


def decode_json(text: Column) -> Column:
    """Stored JSON text as it is, numbers as written; text that is not JSON becomes a JSON string."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(json_string(text))


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """The newest extraction of each filing."""
    rest = [c for c in extractions.columns if c != "filing_id"]
    newest = F.max_by(F.struct(*rest), F.struct("extracted_at", "extraction_id"))
    return extractions.groupBy("filing_id").agg(newest.alias("e")).select("filing_id", "e.*")


def effective_values(fields: DataFrame) -> DataFrame:
    """The reviewed value if there is one, else the extracted one; rejected gives null."""
    chosen = F.coalesce("reviewed_json", "value_json")
    return fields.select(
        "filing_id", "extraction_id", "field_path",
        F.when(F.coalesce(F.col("review_status") != "rejected", F.lit(True)), decode_json(chosen)).alias("value_json"),
        F.coalesce("review_status", F.lit("accepted")).alias("review_status"))


def exportable(filings: DataFrame, extractions: DataFrame) -> DataFrame:
    """Approved filings that have an extraction."""
    return filings.filter("status = 'approved'").join(extractions, "filing_id", "left_semi")


def is_missing(value_json: Column) -> Column:
    """Empty in the reviewer's sense: null, 0, false, "", [] and {} all count as missing."""
    return value_json.isNull() | value_json.isin("null", "false", '""', "[]", "{}") | (
        F.coalesce(value_json.try_cast("double"), F.lit(1.0)) == 0.0)


def approved_runs(filings: DataFrame, extractions: DataFrame) -> DataFrame:
    """The latest run of every approved filing: what X3, X4 and S17 read, narrowed before anything is grouped."""
    approved = filings.filter("status = 'approved'").select("filing_id")
    return latest_extraction(extractions.join(approved, "filing_id", "left_semi"))


def run_values(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """X1 for the fields of the given runs."""
    return effective_values(fields.join(runs.select("extraction_id"), "extraction_id", "left_semi"))


def judge_runs(runs: DataFrame, fields: DataFrame, descriptors: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """filing_id, run, missing_paths (required ones without a value, sorted) and clash of every run's filing.

    Runs meet their fields once, by extraction, and one grouping by filing sets the paths held against the
    few that its model requires.  ``others`` are filings to be listed without a run.
    """
    held = runs.select("extraction_id", "filing_id", "model").join(effective_values(fields).drop("filing_id"), "extraction_id", "left")
    present = ~is_missing(F.col("value_json"))
    written = F.col("value_json").isNotNull() & (F.col("value_json") != "null")
    rows = held.select("filing_id", "extraction_id", "model", F.when(present, F.col("field_path")).alias("has"),
                       F.when(written, F.col("field_path")).alias("leaf"))
    if others is not None:
        rows = rows.unionByName(others.select("filing_id"), allowMissingColumns=True)
    held = rows.groupBy("filing_id").agg(F.max("extraction_id").alias("run"), F.max("model").alias("model"),
                                         F.collect_set("has").alias("has"), F.collect_set("leaf").alias("leaf"))
    needed = descriptors.filter("required").groupBy("model").agg(F.collect_set("field_path").alias("needed"))
    missing = F.array_sort(F.array_except("needed", "has"))
    return held.join(needed, "model", "left").select(
        "filing_id", "run", F.when(F.size(missing) > 0, missing).alias("missing_paths"), _both_leaf_and_parent(F.col("leaf")).alias("clash"))


def missing_required(runs: DataFrame, fields: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Filings blocked by required paths without a value, with the sorted list."""
    return judge_runs(runs, fields, descriptors).filter("missing_paths IS NOT NULL").select("filing_id", "missing_paths")


def _both_leaf_and_parent(paths: Column) -> Column:
    """The first path that is a value and the parent of another; such a filing cannot be nested."""
    ordered = F.array_sort(F.transform(paths, lambda p: F.split(p, r"\.")))
    return let(ordered, lambda o: F.get(F.transform(F.filter(
        F.transform(o, lambda p, i: F.struct(p.alias("p"), F.get(o, i + 1).alias("next"))),
        lambda e: F.coalesce(F.slice(e["next"], F.lit(1), F.size(e["p"])) == e["p"], F.lit(False))),
        lambda e: F.array_join(e["p"], ".")), F.lit(0)))


def batch_split(filings: DataFrame, extractions: DataFrame, fields: DataFrame,
                descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved filings split into exported ids and failures with their reason."""
    approved = filings.filter("status = 'approved'")
    judged = judge_runs(approved_runs(filings, extractions), fields, descriptors, approved)
    reason = (F.when(F.col("run").isNull(), F.lit(config.NO_RESULTS))
              .when(F.col("missing_paths").isNotNull(), F.concat(F.lit(config.EXPORT_BLOCKED), F.array_join("missing_paths", ", ")))
              .when(F.col("clash").isNotNull(), F.concat(F.lit("field path holds a value and other fields: "), F.col("clash"))))
    judged = judged.select("filing_id", reason.alias("reason"))
    return (judged.filter("reason IS NULL").select("filing_id"),
            judged.filter("reason IS NOT NULL"))


def mark_exported(filings: DataFrame, exported: DataFrame) -> DataFrame:
    """Exported filings move to status ``exported``."""
    done = exported.select("filing_id", F.lit(True).alias("done"))
    return (filings.join(done, "filing_id", "left")
            .withColumn("status", F.when(F.col("done"), F.lit("exported")).otherwise(F.col("status")))
            .drop("done"))


def export_audit(exported: DataFrame, at: str) -> DataFrame:
    """One audit row per exported filing."""
    return exported.select("filing_id", F.lit("__filing__").alias("field_path"),
                           F.lit("approved").alias("old_value"), F.lit("exported").alias("new_value"),
                           F.lit("exported").alias("action"), F.lit(at).alias("edited_at"))


def unflatten(values: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Dot paths back to one nested JSON object per filing; nulls dropped, ``model`` added.

    One grouping per filing sorts the leaves by path; each leaf then only has to close the
    objects it does not share with the leaf before it and open its own.  The group is one
    filing's fields, which its single output row holds anyway.  Nulls drop out there, as a filter on the values
    would be pushed down and read each of them again; filings without a row in ``models`` drop out with them.
    """
    segments, tagged = F.split("field_path", r"\."), F.lit(models is None)
    rows = values.select("filing_id", segments.alias("path"), F.col("value_json").alias("json"), tagged.alias("known"))
    if models is not None:
        tag = models.select("filing_id", F.array(F.lit("model")).alias("path"),
                            json_string(F.col("model")).alias("json"), F.lit(True).alias("known"))
        rows = rows.filter("filing_id IS NOT NULL").unionByName(tag)
    leaf = F.when(~F.col("json").isin("null"), F.struct("path", "json"))
    grouped = rows.repartition("filing_id").groupBy("filing_id").agg(
        F.array_sort(F.collect_list(leaf)).alias("leaves"), F.max("known").alias("known"))
    return grouped.filter(F.col("known") & (F.size("leaves") > 0)).select("filing_id", nested("leaves").alias("nested_json"))


def nested(name: str) -> Column:
    """The JSON object of a column of sorted leaves (path, json)."""

    def shared(before: Column, path: Column) -> Column:
        """How many parents of a leaf are open already."""
        nested = F.least(F.size(before), F.size(path)) - 1          # parents that could be shared
        return F.when(before.isNotNull() & (nested > 0), F.size(F.filter(
            F.sequence(F.lit(1), F.greatest(nested, F.lit(1))),
            lambda n: F.slice(before, F.lit(1), n) == F.slice(path, F.lit(1), n)))).otherwise(0)

    def piece(leaf: Column, i: Column) -> Column:
        path = leaf["path"]

        def text(before: Column, kept: Column) -> Column:
            opened = F.transform(F.slice(path, kept + 1, F.size(path) - 1 - kept),
                                 lambda s: F.concat(json_string(s), F.lit(":{")))
            return F.concat(
                F.when(i > 0, F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - kept), F.lit(",")))
                .otherwise(F.lit("{")),
                F.array_join(opened, ""), json_string(F.element_at(path, -1)), F.lit(":"), leaf["json"])

        return let(F.when(i > 0, F.get(F.col(name), i - 1)["path"]),
                   lambda before: let(shared(before, path), lambda kept: text(before, kept)))

    tail = F.repeat(F.lit("}"), F.size(F.element_at(name, -1)["path"]))
    return F.concat(F.array_join(F.transform(name, piece), ""), tail)
