"""Classification as two batch-inference rounds: requests out, answers in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from termsheet import config
from termsheet.functions.jsonvalues import members
from termsheet.functions.text import blank_to_null, drop_code_fences


def model_descriptions(entries: DataFrame) -> DataFrame:
    """One description per model entry (``model``, ``entry`` VARIANT).

    Classification hints give description, up to 4 key features, 3 counter-indicators and 6
    title terms; without hints the plain description is used.
    """
    def words(key: str, label: str, most: int, joiner: str) -> Column:
        found = F.try_variant_get("entry", f"$.classificationHints.{key}", "array<string>")
        return F.when(F.size(found) > 0, F.concat(
            F.lit(label), F.array_join(F.slice(found, 1, most), joiner), F.lit(".")))

    hinted = F.concat_ws(" | ", blank_to_null(F.try_variant_get(
        "entry", "$.classificationHints.description", "string")),
        words("discriminating_features", "Key features: ", 4, "; "),
        words("counter_indicators", "Not this model if: ", 3, "; "),
        words("title_keywords", "Typical title terms: ", 6, ", "))
    has_hints = F.size(members(F.try_variant_get("entry", "$.classificationHints", "variant"))) > 0
    plain = F.coalesce(F.try_variant_get("entry", "$.description", "string"), F.lit(""))
    rest = [c for c in entries.columns if c != "entry"]
    return entries.select(*rest, F.when(has_hints, hinted).otherwise(plain).alias("description"))


UNKNOWN_LINE = "  - unknown  — when no listed model fits with confidence of at least 0.60"


def model_list(descriptions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The list of models as text (in ``ord`` order), one row per key; models are few."""
    line = F.concat(F.lit("  - "), F.col("model"), F.when(
        F.col("description") != "", F.concat(F.lit("  — "), F.col("description"))).otherwise(F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return descriptions.groupBy(*keys).agg(F.concat(F.array_join(
        F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n" + UNKNOWN_LINE)).alias("model_list"))


def few_shot(feedback: DataFrame, filings: DataFrame, count: int = 3) -> DataFrame:
    """The newest unused corrections, with the filing's CUSIP."""
    usable = feedback.filter(~F.col("used_as_example") & F.col("corrected_model").isNotNull())
    newest = usable.orderBy(F.desc("corrected_at"), F.desc("feedback_id")).limit(count)
    return newest.join(filings.select("filing_id", "cusip"), "filing_id", "left")


def few_shot_block(examples: DataFrame) -> DataFrame:
    """The examples as one text block, newest first; empty text without examples."""
    def optional(prefix: str, c: str, suffix: str = "") -> Column:
        given = F.coalesce(F.col(c), F.lit("")) != ""
        return F.when(given, F.concat(F.lit(prefix), F.col(c), F.lit(suffix))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), optional("CUSIP ", "cusip", " | "), F.lit("Predicted: "),
                    F.col("original_model"), F.lit(" | Corrected: "), F.col("corrected_model"),
                    optional(" | Reason: ", "reason"))
    rows = F.sort_array(F.collect_list(F.struct("corrected_at", "feedback_id", line.alias("line"))), asc=False)
    text = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    return examples.agg(F.when(F.size(rows) > 0, F.concat(
        F.lit("## Recent corrections\n"), text, F.lit("\n"))).otherwise(F.lit("")).alias("few_shot_block"))


def mark_used(feedback: DataFrame, examples: DataFrame) -> DataFrame:
    """The selected examples are not offered again."""
    chosen = examples.select("feedback_id", F.lit(True).alias("chosen"))
    return (feedback.join(chosen, "feedback_id", "left")
            .withColumn("used_as_example", F.col("used_as_example") | F.coalesce("chosen", F.lit(False)))
            .drop("chosen"))


HINT_KNOWN = "A mapping file links this CUSIP to {hint}; treat it as weak background only.\n"
HINT_UNLISTED = "A mapping file links this CUSIP to {hint}, which is not a listed model; ignore it.\n"


def cusip_hints(filings: DataFrame, cusip_map: DataFrame, models: list[str]) -> DataFrame:
    """C4: mapped model by upper-case CUSIP, whether it is in the schema, and the hint text."""
    mapped = cusip_map.select(F.col("cusip").alias("map_cusip"), F.col("model").alias("cusip_hint"))
    joined = filings.join(mapped, F.upper("cusip") == F.col("map_cusip"), "left").drop("map_cusip")
    listed = F.col("cusip_hint").isin(models)
    text = (F.when(F.col("cusip_hint").isNull(), F.lit(""))
            .when(listed, F.replace(F.lit(HINT_KNOWN), F.lit("{hint}"), F.col("cusip_hint")))
            .otherwise(F.replace(F.lit(HINT_UNLISTED), F.lit("{hint}"), F.col("cusip_hint"))))
    return joined.withColumns({"hint_in_schema": F.coalesce(listed, F.lit(False)), "hint_text": text})


STAGE1_TEMPLATE = ("Classify this filing as one of the models below.\n{hint}{examples}\nModels:\n{models}\n\n"
                   "Answer as JSON: payout_type_id, confidence_score, reasoning, title_excerpt, "
                   "product_features.\n\nCOVER:\n{cover}\n")
STAGE2_TEMPLATE = ("A first pass on the cover was not conclusive.\n{hint}{prior}\nModels:\n{models}\n\n"
                   "Answer as JSON: payout_type_id, confidence_score, reasoning, title_excerpt, "
                   "product_features.\n\nCOVER:\n{cover}\n\nSECTIONS:\n{sections}\n")


def _fill(template: str, **parts: Column) -> Column:
    """Put Columns into a template in one pass (a part's own braces are never looked at)."""
    pieces, rest = [], template
    while rest:
        at = {f"{{{k}}}": rest.find(f"{{{k}}}") for k in parts if f"{{{k}}}" in rest}
        if not at:
            pieces.append(F.lit(rest))
            break
        slot = min(at, key=at.get)
        head, rest = rest.split(slot, 1)
        pieces += [F.lit(head), F.coalesce(parts[slot[1:-1]], F.lit(""))]
    return F.concat(*pieces)


def stage1_requests(filings: DataFrame, models_text: str | Column, examples_text: str | Column = "",
                    template: str = STAGE1_TEMPLATE) -> DataFrame:
    """First-round input rows from (filing_id, cover, hint_text)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x                          # noqa: E731
    return filings.select("filing_id", _fill(
        template, hint=F.col("hint_text"), examples=lit(examples_text), models=lit(models_text),
        cover=F.col("cover")).alias("prompt"))


def stage2_requests(escalated: DataFrame, models_text: str | Column,
                    template: str = STAGE2_TEMPLATE) -> DataFrame:
    """Second-round input: adds the targeted sections and what the first round said."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x                          # noqa: E731
    features = F.try_parse_json("product_features")
    prior = F.when(F.size(members(features)) > 0, F.concat(
        F.lit("Cover: type="), F.coalesce(F.try_variant_get(features, "$.type", "string"), F.lit("")),
        F.lit(", features="), F.coalesce(F.to_json(F.try_variant_get(features, "$.features", "variant")), F.lit("[]")),
        F.lit(", underlyings="), F.coalesce(F.to_json(F.try_variant_get(features, "$.underlyings", "variant")), F.lit("[]")),
        F.lit(". Reasoning: "), F.coalesce("reasoning", F.lit("")), F.lit("\n")))
    return escalated.select("filing_id", _fill(
        template, hint=F.col("hint_text"), prior=prior, models=lit(models_text), cover=F.col("cover"),
        sections=F.col("targeted")).alias("prompt"))


def validate_answers(responses: DataFrame, models: list[str],
                     floor: float = config.UNKNOWN_BELOW) -> DataFrame:
    """(filing_id, stage, payload) to a checked classification.

    Fences are dropped; an answer that is not a JSON object, names an unlisted model or is less
    confident than ``floor`` becomes ``unknown``; confidence is cut to [0, 1].
    """
    parsed = responses.withColumn("body", F.try_parse_json(drop_code_fences(F.col("payload"))))

    def text(key: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get("body", f"$.{key}", "string"), F.lit(default))

    ok = members(F.col("body")).isNotNull()
    given = F.when(ok, text("payout_type_id", "unknown")).otherwise(F.lit("unknown"))
    score = F.coalesce(text("confidence_score", "0").try_cast("double"), F.lit(0.0))
    score = F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)) + F.lit(0.0)).otherwise(F.lit(0.0))
    checked = parsed.withColumns({"given": given, "confidence": score})
    features = F.coalesce(F.to_json(F.try_variant_get("body", "$.product_features", "variant")), F.lit("{}"))
    return checked.select(
        "filing_id", "stage",
        F.when((F.col("confidence") >= floor) & F.col("given").isin(models), F.col("given"))
        .otherwise(F.lit("unknown")).alias("model"), "confidence",
        F.when(ok, text("reasoning", "")).otherwise(F.lit("Failed to parse answer.")).alias("reasoning"),
        F.when(ok, F.substring(text("title_excerpt", ""), 1, config.TITLE_CHARS)).otherwise(F.lit("")).alias("title_excerpt"),
        F.when(ok, features).otherwise(F.lit("{}")).alias("product_features"))


def escalate(stage1: DataFrame, threshold: float = config.STAGE_TWO_BELOW) -> tuple[DataFrame, DataFrame]:
    """First-round answers that stand, and those to ask again (low, and sections found)."""
    again = (F.col("confidence") < threshold) & (F.coalesce("targeted", F.lit("")) != "")
    return stage1.filter(~again), stage1.filter(again)


def choose_stage(stage1: DataFrame, stage2: DataFrame) -> DataFrame:
    """The second answer if it is at least as confident as the first."""
    names = [c for c in stage1.columns if c != "filing_id"]
    first = stage1.select("filing_id", F.struct(*names).alias("first"))
    second = stage2.select("filing_id", F.struct(*names).alias("second"))
    take = F.col("second.confidence") >= F.col("first.confidence")
    return (first.join(second, "filing_id", "left")
            .select("filing_id", F.when(take, F.col("second")).otherwise(F.col("first")).alias("r"))
            .select("filing_id", "r.*"))


def gate(results: DataFrame, threshold: float = config.GATE_CONFIDENCE,
         low: float = config.STAGE_TWO_BELOW) -> DataFrame:
    """Lifecycle state of a classification and its low-confidence flag."""
    status = (F.when(F.col("model") == "unknown", F.lit("needs_review"))
              .when(F.col("confidence") >= threshold, F.lit("classified"))
              .otherwise(F.lit("needs_classification_review")))
    return results.withColumns({"status": status, "low_confidence": F.col("confidence") < low})
