"""Quality reports over extractions and product features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termsheet.operators.usage import _sum_units, _usd


def nearest_variant(vectors: DataFrame, variants: list[tuple[str, str]], match: int = 2, least: float = 0.60) -> DataFrame:
    """O2, O3: closest reference variant by Hamming distance of 0/1 texts, within the same family.

    If less than the share ``least`` of the bits agree with the closest one, or the family has none, there is no match.

    The reference list is a short constant, so it is compared inside the row.
    """
    rows = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(bits).alias("bits")) for family, bits in variants])

    def distance(bits: Column) -> Column:
        pairs = F.arrays_zip(F.split(F.col("bits"), "").alias("a"), F.split(bits, "").alias("b"))
        return F.size(F.filter(pairs, lambda p: p["a"] != p["b"]))
    own = F.filter(rows, lambda v: v["family"] == F.col("family"))
    best = F.array_min(F.transform(own, lambda v: F.struct(distance(v["bits"]).alias("distance"), v["bits"].alias("variant"))))
    return (vectors.withColumn("best", best)
            .select("item_id", "family", F.col("best.variant").alias("variant"), F.col("best.distance").alias("distance"), "bits")
            .withColumn("verdict", F.when(F.col("distance") <= match, "match")
                        .when(F.coalesce(1 - F.col("distance") / F.length("bits"), F.lit(0.0)) < least, "no match").otherwise("novel"))
            .drop("bits"))


def vector_overlap(vectors: DataFrame) -> DataFrame:
    """Items per feature vector; a vector shared by several families is flagged."""
    found = vectors.groupBy("bits").agg(F.count("*").alias("items"), F.collect_set("family").alias("f"))
    return found.select("bits", "items", F.array_join(F.array_sort("f"), ",").alias("families"), (F.size("f") > 1).alias("overlaps"))


def fill_rate_drops(extractions: DataFrame, filings: DataFrame, drop: float = 10.0) -> DataFrame:
    """Each issuer's monthly fill rate against the mean of its earlier months."""
    joined = extractions.filter("field_count > 0").join(filings.select("filing_id", "issuer_name"), "filing_id")
    monthly = joined.filter("issuer_name IS NOT NULL").groupBy(
        "issuer_name", F.substring("extracted_at", 1, 7).alias("month")).agg(
        F.sum("fields_found").alias("found"), F.sum("field_count").alias("total"))
    before = Window.partitionBy("issuer_name").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    base = F.sum("found").over(before) / F.sum("total").over(before) * 100
    rate = F.col("found") / F.col("total") * 100
    return (monthly.withColumns({"fill_pct": F.round(rate, 2), "baseline_pct": F.round(base, 2)})
            .withColumn("dropped", F.coalesce(F.col("baseline_pct") - F.col("fill_pct") >= drop, F.lit(False)))
            .select("issuer_name", "month", "fill_pct", "baseline_pct", "dropped"))


def mode_comparison(extractions: DataFrame, fields: DataFrame, costed: DataFrame, gain: float = 10.0, dearer: float = 1.8) -> DataFrame:
    """Single against sectioned extraction: fill rate, schema errors, cost per filing, and whether to
    promote the sectioned mode: fill rate up by ``gain`` points, no more errors per field, and cost per filing at most
    ``dearer`` times as high."""
    filled = extractions.groupBy("extraction_mode").agg(F.sum("fields_found").alias("found"), F.sum("field_count").alias("total"))
    wrong = fields.filter("review_status = 'schema_error'").groupBy("extraction_id").agg(F.count("*").alias("n"))
    errors = (extractions.select("extraction_id", "extraction_mode").join(wrong, "extraction_id", "left")
              .groupBy("extraction_mode").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors")))
    mode = F.when(F.col("call_type") == "extract", "single").otherwise("sectioned")
    spent = (costed.filter("call_type LIKE 'extract%' AND filing_id IS NOT NULL")
             .groupBy(mode.alias("extraction_mode"), "filing_id").agg(_sum_units("cost_units", "u"))
             .groupBy("extraction_mode").agg(F.sum("u").alias("units"), F.count("*").alias("filings")))
    both = filled.join(errors, "extraction_mode").join(spent, "extraction_mode").withColumns({
        "fill": F.col("found") / F.col("total") * 100, "wrong": F.col("errors") / F.col("total"),
        "each": F.col("units").cast("double") / F.col("filings")})
    single = lambda c: F.max(F.when(F.col("extraction_mode") == "single", F.col(c))).over(Window.partitionBy())  # noqa: E731  two rows
    better = ((F.col("fill") - single("fill") >= gain) & (F.col("wrong") <= single("wrong")) & (F.col("each") <= dearer * single("each")))
    return both.select(
        "extraction_mode", F.round("fill", 2).alias("fill_pct"), _usd("units", 6).alias("cost_usd"), "filings", "errors",
        F.round(F.col("each") / 1e10, 6).alias("cost_per_filing_usd"), F.when(F.col("extraction_mode") == "sectioned", better).alias("promote"))


def mean_confidence(fields: DataFrame) -> DataFrame:
    """Mean confidence of found fields per extraction."""
    return (fields.filter(~F.col("not_found")).groupBy("extraction_id")
            .agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("confidence").alias("fields")))


def series_filings(docs: DataFrame) -> DataFrame:
    """Documents that name more than one CUSIP."""
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Z0-9]{9}\b"), F.lit(0))))
    found = docs.select("doc_id", codes.alias("codes"))
    return found.filter(F.size("codes") > 1).select("doc_id", F.size("codes").alias("cusips"), F.array_join("codes", ",").alias("codes"))


def profile_scores(items: DataFrame, features: DataFrame, profiles: DataFrame) -> DataFrame:
    """O1: item_id, model, score, rank: how well each item's features fit each model's profile.

    ``features``: item_id, feature, value, a row for each feature that is known of an item.  ``profiles``: model, kind (required, typical
    or counter), feature, value, weight; an entry with several values, in a row each, is met by any of them
    and has the largest of their weights.  A score
    starts at 1: a required entry that is not met takes its weight away, a typical one that is met adds it, a counter one that is
    met takes it away; it stays between 0 and 1.  Equal scores rank by model.

    Only features that some profile names meet a row; what an item misses is counted by putting the weights of the required
    entries into a row that every item meets, and giving them back where they are met.
    """
    entries = profiles.groupBy("model", "kind", "feature").agg(F.max("weight").alias("weight"))
    missed = entries.groupBy("model").agg((1 - F.coalesce(F.sum(F.when(F.col("kind") == "required", F.col("weight"))), F.lit(0.0))).alias("weight"))
    start = missed.select("model", F.lit("start").alias("kind"), F.lit("").alias("feature"), F.lit("").alias("value"), "weight")
    rules = profiles.filter("feature <> ''").select("model", "kind", "feature", "value").join(entries, ["model", "kind", "feature"]).unionByName(start)
    have = features.filter("feature <> ''").select("item_id", "feature", "value").unionByName(
        items.select("item_id", F.lit("").alias("feature"), F.lit("").alias("value")))
    met = have.join(rules, ["feature", "value"]).groupBy("item_id", "model").agg(F.sort_array(F.collect_set(F.struct(
        "kind", "feature", F.when(F.col("kind") == "counter", -F.col("weight")).otherwise(F.col("weight")).alias("w")))).alias("met"))
    total = F.round(F.aggregate("met", F.lit(0.0), lambda so_far, e: so_far + e["w"]), 6)
    scored = met.select("item_id", "model", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "model")
    return scored.withColumn("rank", F.row_number().over(best))


def profile_bands(scores: DataFrame, sure: float = 0.80, likely: float = 0.60) -> DataFrame:
    """O1: item_id, model, score, lead (over the next model), band: the best model of each item and what follows from its score."""
    both = scores.filter("rank <= 2").groupBy("item_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("model", "score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    score = F.col("first.score")
    band = F.when(score >= sure, "classified").when(score >= likely, "needs_classification_review").otherwise("needs_review")
    return both.select("item_id", "first.model", "first.score", F.round(score - F.coalesce("next", F.lit(0.0)), 6).alias("lead"), band.alias("band"))
