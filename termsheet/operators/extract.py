"""Field extraction: registry and table tiers, answer parsing, merging, coverage, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from termsheet import config, schemas
from termsheet.functions.answers import answer_leaves, answer_parts
from termsheet.functions.jsonvalues import scalar_text
from termsheet.functions.text import blank_to_null, drop_code_fences, json_string, let, strip
from termsheet.functions.values import typed_json
from termsheet.session import small_table


def parser_registry(spark: SparkSession, aliases: bool = False) -> DataFrame:
    """Field path -> value kind; ``aliases`` adds the typed rows for the Generic paths."""
    kinds = {**config.PARSER_KINDS, **(config.PARSER_KIND_ALIASES if aliases else {})}
    return small_table(spark, sorted(kinds.items()), schemas.REGISTRY)


def registry_fields(filings: DataFrame) -> DataFrame:
    """Filing metadata as fields with confidence 1.0."""
    def field(path: str, column: str, what: str) -> Column:
        text = strip(F.col(column))
        return F.struct(F.lit(path).alias("field_path"), blank_to_null(text).alias("text"),
                        F.concat(F.lit(f"EDGAR registry {what}: "), text).alias("excerpt"))
    rows = F.explode(F.array(field("identifiers.cusip", "cusip", "CUSIP"),
                             field("parties.issuer.name", "issuer_name", "issuer")))
    return (filings.select("filing_id", rows.alias("r")).filter("r.text IS NOT NULL")
            .select("filing_id", "r.field_path", json_string(F.col("r.text")).alias("value_json"),
                    F.lit(1.0).alias("confidence"), "r.excerpt", F.lit("registry").alias("source")))


def table_fields(resolved: DataFrame, registry: DataFrame) -> DataFrame:
    """Typed fields from resolved label/value rows; the first row that parses wins.

    A path without a registry row keeps its stripped text.  The first row is taken with a
    partial aggregate, so a filing with very many rows is reduced before the shuffle.  Rows that do not parse
    drop out in the aggregate: a filter on the parsed value would be pushed down and parse every row twice.
    """
    typed = (resolved.filter("field_path IS NOT NULL").join(registry, "field_path", "left")
             .withColumn("value_json", typed_json(F.col("kind"), F.col("value_raw"))))
    parsed = F.col("value_json").isNotNull()
    first = F.min_by(F.struct("value_json", "label_raw", "value_raw"), F.when(parsed, F.col("row_no")))
    excerpt = F.concat(F.col("f.label_raw"), F.lit(": "),
                       F.substring("f.value_raw", 1, config.SAMPLE_CHARS))
    return (typed.groupBy("filing_id", "field_path").agg(first.alias("f"), F.count("value_json").alias("n"))
            .filter("n > 0").select("filing_id", "field_path", "f.value_json",
                    F.lit(config.TABLE_CONFIDENCE).alias("confidence"), excerpt.alias("excerpt"),
                    F.lit("html_table").alias("source")))


def issuer_fill_rate(fields: DataFrame, filings_by_issuer: DataFrame, expected: int) -> DataFrame:
    """Share of ``expected`` fields found per filing, averaged by issuer."""
    found = fields.groupBy("filing_id").agg(F.count("*").alias("found"))
    joined = filings_by_issuer.join(found, "filing_id", "left")
    return (joined.groupBy(F.coalesce("issuer_key", F.lit("other")).alias("issuer"))
            .agg(F.count("*").alias("filings"), F.sum(F.coalesce("found", F.lit(0))).alias("fields_found"))
            .withColumn("fill_rate_pct",
                        F.round(F.col("fields_found") / (F.col("filings") * expected) * 100, 2)))


# ---- model answers ------------------------------------------------------------------------

def _written(tool: str) -> tuple[Column, Column]:
    """The text of an answer, null where there is none to read, and whether it came from the tool."""
    is_tool, is_text = F.coalesce(F.col("tool_name") == tool, F.lit(False)), F.col("tool_name").isNull()
    return F.when(is_tool, F.col("payload")).when(is_text, drop_code_fences(strip(F.col("payload")))), is_tool


def parse_answers(responses: DataFrame, tool: str = "submit_extraction", data_key: str = "data") -> DataFrame:
    """Answer payloads as three objects, ``data``, ``confidences`` and ``excerpts``: maps from key to JSON text.

    A row whose ``tool_name`` is the expected tool holds the three parts side by side; each
    part that is not an object becomes empty.  A row without a tool name is plain text: code
    fences are dropped and the whole object is the data (flattening skips the side maps in it);
    text that is not JSON gives three empty objects, as does another tool's answer.
    """
    parsed = responses.withColumn("parts", answer_parts(*_written(tool), data_key))
    keys = [c for c in responses.columns if c not in ("payload", "tool_name")]
    return parsed.select(*keys, "parts.*")


def flatten_answers(responses: DataFrame, tool: str = "submit_extraction", data_key: str = "data") -> DataFrame:
    """E5: one row per answered field path, with its confidence and excerpt still as answered.

    A payload is read once, whatever it holds (:func:`parse_answers` tells which part is the data).
    """
    keys = [c for c in responses.columns if c not in ("payload", "tool_name")]
    opened = responses.select(*keys, answer_leaves(*_written(tool), data_key).alias("leaves")).select(*keys, F.inline("leaves"))
    return opened.select(*keys, F.col("path").alias("field_path"), "raw_confidence", "raw_excerpt", "value_json")


def clamp_confidence(raw: Column, default: Column | float) -> Column:
    """A number, or text that is one, cut to [0, 1]; anything else gives the default."""
    # least/greatest skip nulls, so text that is no number has to be told apart first.
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    return let(strip(raw).try_cast("double"), lambda n: F.when(n.isNull(), fallback).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), n)) + F.lit(0.0)))


def answer_fields(flat: DataFrame) -> DataFrame:
    """Flattened answers with clamped confidence and the excerpt cut to 500 characters."""
    default = F.when(F.col("value_json").isNotNull(), F.lit(0.5)).otherwise(F.lit(0.0))
    excerpt = F.substring(F.coalesce("raw_excerpt", F.lit("")), 1, config.EXCERPT_CHARS)
    return (flat.withColumns({"confidence": clamp_confidence(F.col("raw_confidence"), default), "excerpt": excerpt})
            .drop("raw_confidence", "raw_excerpt"))


def merge_sections(sections: DataFrame, delta: float = config.SECTION_MERGE_DELTA) -> DataFrame:
    """Fold section answers per (filing, path) in section order.

    The first non-null value stands until a later one is at least ``delta`` more confident;
    its excerpt goes with it.  A missing confidence counts as 0.5.

    Only the first row of each distinct confidence can ever win (the standing value is always
    at least as confident as everything before it), so rows are first reduced to one per
    (filing, path, confidence) by a partial aggregate.  The fold then sees distinct confidences
    only, whatever the number of answers.  Below zero every next row replaces the standing one;
    such rows matter only when no row is at or above zero, and then the last one wins.
    """
    conf = F.coalesce("confidence", F.lit(0.5)).cast("double") + F.lit(0.0)
    rows = (sections.filter("value_json IS NOT NULL").withColumn("confidence", conf)
            .withColumn("level", F.when(F.col("confidence") >= 0, F.col("confidence"))))
    row = F.struct("ord", "confidence", "value_json", "excerpt")
    if isinstance(sections.schema["ord"].dataType, IntegralType):  # one state instead of two: ~ord runs the other way
        kept = F.min_by(row, F.when(F.col("level").isNull(), F.bitwise_not("ord")).otherwise(F.col("ord")))
    else:
        kept = F.when(F.col("level").isNull(), F.max_by(row, "ord")).otherwise(F.min_by(row, "ord"))
    reduced = rows.groupBy("filing_id", "field_path", "level").agg(kept.alias("row"))
    per_field = reduced.groupBy("filing_id", "field_path").agg(
        F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.col("row")))).alias("levels"),
        F.max(F.when(F.col("level").isNull(), F.col("row"))).alias("negative"))
    better = lambda held, new: F.when(                                             # noqa: E731
        held.isNull() | (new["confidence"] - held["confidence"] >= F.lit(delta)), new).otherwise(held)
    nothing = F.lit(None).cast(per_field.schema["levels"].dataType.elementType)
    winner = F.coalesce(F.aggregate("levels", nothing, better), F.col("negative"))
    return (per_field.select("filing_id", "field_path", winner.alias("w"))
            .select("filing_id", "field_path", "w.value_json", "w.confidence",
                    F.coalesce("w.excerpt", F.lit("")).alias("excerpt")))


# ---- tiers, coverage, validation ----------------------------------------------------------

_FIELD = ["filing_id", "field_path", "value_json", "confidence", "excerpt", "source"]


def _tiers(registry: DataFrame, table: DataFrame, answered: DataFrame) -> DataFrame:
    ranked = [(table, 0), (registry, 1), (answered.withColumn("source", F.lit("llm")), 2)]
    parts = [t.select(*_FIELD, F.lit(rank).alias("rank")) for t, rank in ranked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _by_path(tiers: DataFrame) -> DataFrame:
    """Tiers dealt out for their grouping: with a row or two to a key, sorting them first for a partial aggregate gains nothing."""
    return tiers.repartition("filing_id", "field_path").groupBy("filing_id", "field_path")


def merge_tiers(registry: DataFrame, table: DataFrame, answered: DataFrame) -> DataFrame:
    """One value per (filing, path): document table over registry over model answer."""
    best = F.min_by(F.struct(*_FIELD[2:]), "rank").alias("b")
    return _by_path(_tiers(registry, table, answered)).agg(best).select(
        "filing_id", "field_path", "b.*")


def tier_conflicts(registry: DataFrame, table: DataFrame, answered: DataFrame) -> DataFrame:
    """Paths where tiers disagree: table against registry, and either against the model."""
    def of(rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value_json")))
    values = _by_path(_tiers(registry, table, answered)).agg(
        of(0).alias("table_value"), of(1).alias("registry_value"), of(2).alias("model_value"))
    trusted = F.coalesce("table_value", "registry_value")
    kinds = F.array(
        F.when(F.col("table_value") != F.col("registry_value"), F.struct(
            F.lit("table_over_registry").alias("kind"), F.col("table_value").alias("kept"),
            F.col("registry_value").alias("dropped"))),
        F.when(trusted != F.col("model_value"), F.struct(
            F.lit("trusted_over_model").alias("kind"), trusted.alias("kept"),
            F.col("model_value").alias("dropped"))))
    return values.select("filing_id", "field_path", F.inline(F.array_compact(kinds)))


def extractable(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filings with a real model, and the rejected rest."""
    ok = F.col("model").isNotNull() & (F.col("model") != "") & (F.col("model") != "unknown")
    reason = F.lit("filing must be classified before extraction")
    return filings.filter(ok), filings.filter(~ok | F.col("model").isNull()).withColumn("reason", reason)


def covered_fields(filings: DataFrame, descriptors: DataFrame, registry: DataFrame, table: DataFrame,
                   answered: DataFrame) -> DataFrame:
    """E8 and E10 in one grouping: a row for every path described for the filing's model or found.

    ``enum_values`` holds the allowed values of a path, for E11; looked up once the rows are made, and not at all where nobody reads them.
    """
    rows = _covered(_tiers(registry, table, answered), filings, descriptors)
    return _with_rules(rows, descriptors).withColumn("enum_values", _allowed()).drop("models", "_rules")


def complete_fields(filings: DataFrame, descriptors: DataFrame, registry: DataFrame, table: DataFrame,
                    answered: DataFrame) -> DataFrame:
    """Covered and checked fields; where there is no value, no rule is asked for."""
    rows = _covered(_tiers(registry, table, answered), filings, descriptors)
    rule = F.when(F.col("value_json").isNotNull(), _allowed())
    return _checked(_with_rules(rows, descriptors).withColumn("enum_values", rule)).drop("enum_values", "models", "_rules")


def cover_all(filings: DataFrame, descriptors: DataFrame, values: DataFrame) -> DataFrame:
    """A row for every described path of the filing's model and every path found."""
    return _covered(values.select(*_FIELD).withColumn("rank", F.lit(0)), filings, descriptors).drop("models")


def _covered(found: DataFrame, filings: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The covered fields and ``models``, the models of their filing.

    Described paths are many times the values found, so they never move: a filing's values and models meet in one row, which then
    unfolds into its paths.  That row holds a value for each path found and each tier.  What models
    describe is configuration, looked up in one map.
    """
    marks = filings.select("filing_id", F.lit(True).alias("wanted"), "model")
    rows = found.unionByName(marks, allowMissingColumns=True).filter("filing_id IS NOT NULL").repartition("filing_id")
    value = F.struct("field_path", "rank", *_FIELD[2:])
    whole = rows.groupBy("filing_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("wanted").isNull(), value))).alias("found"),
        F.collect_set("model").alias("models"), F.max("wanted").alias("wanted")).filter("wanted").drop("wanted")
    paths = (descriptors.filter("model IS NOT NULL").groupBy("model").agg(F.collect_list(F.struct("field_path")).alias("p"))
             .select("model", F.array_distinct(F.transform("p", lambda p: p["field_path"])).alias("paths")))
    by_model = paths.select(F.map_from_entries(F.collect_list(F.struct("model", "paths")))).scalar()
    # Of a path's values the first one stands, as they are in order of path and rank.
    best = F.filter("found", lambda v, i: (i == 0) | ~v["field_path"].eqNullSafe(F.get(F.col("found"), i - 1)["field_path"]))
    whole = whole.withColumns({"best": best, "_by_model": by_model}).withColumn("described", F.array_distinct(F.flatten(F.transform(
        "models", lambda m: F.coalesce(F.try_element_at("_by_model", m), F.array().cast("array<string>"))))))
    missing = F.array_except("described", F.transform("best", lambda v: v["field_path"]))
    nothing = F.lit(None)
    both = F.concat(
        F.transform("best", lambda v: F.struct(v["field_path"].alias("field_path"), *[v[c].alias(c) for c in _FIELD[2:]])),
        F.transform(missing, lambda p: F.struct(p.alias("field_path"), *[nothing.cast(found.schema[c].dataType).alias(c) for c in _FIELD[2:]])))
    return whole.select("filing_id", "models", F.inline(both)).select(
        "filing_id", "field_path", "value_json", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("excerpt", F.lit("")).alias("excerpt"), F.coalesce("source", F.lit("llm")).alias("source"),
        F.col("value_json").isNull().alias("not_found"), "models")


def _rule_key(path: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), path), F.lit(""))                      # keys of a map cannot be null


def _with_rules(rows: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Covered rows with the allowed values of all models and paths."""
    rules = (descriptors.filter("model IS NOT NULL").groupBy("model", "field_path").agg(F.max("enum_values").alias("allowed")).filter("allowed IS NOT NULL")
             .groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(_rule_key(F.col("field_path")), "allowed"))).alias("rules")))
    return rows.withColumn("_rules", rules.select(F.map_from_entries(F.collect_list(F.struct("model", "rules")))).scalar())


def _allowed() -> Column:
    """The allowed values of a covered field, from its ``models`` and ``field_path``."""
    of = lambda model: F.try_element_at(F.try_element_at("_rules", model), _rule_key(F.col("field_path")))
    return F.when(F.size("models") == 1, of(F.get("models", F.lit(0)))).otherwise(F.array_max(F.transform("models", of)))


def check_enums(fields: DataFrame, filings: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Values outside a descriptor's allowed list get an error, confidence 0 and schema_error."""
    rules = descriptors.select("model", "field_path", "enum_values")
    joined = (fields.join(filings.select("filing_id", "model"), "filing_id", "left")
              .join(rules, ["model", "field_path"], "left"))
    return _checked(joined).select(*fields.columns, "validation_error", "review_status")


def _quoted(text: Column) -> Column:
    """A text in single quotes, or in double ones if it holds single quotes alone."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).when(text.contains("'"), F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(
        F.concat(F.lit("'"), text, F.lit("'")))


def _checked(fields: DataFrame) -> DataFrame:
    text = scalar_text(F.col("value_json"))
    bad = (F.col("value_json").isNotNull() & (F.size("enum_values") > 0) & ~F.array_contains("enum_values", text))
    listed = F.array_join(F.transform("enum_values", _quoted), ", ")
    message = F.concat(F.lit(config.SCHEMA_VIOLATION), text, F.lit(config.SCHEMA_ALLOWED), listed, F.lit("]"))
    flagged = F.coalesce(bad, F.lit(False))
    return fields.withColumns({
        "validation_error": F.when(flagged, message),
        "confidence": F.when(flagged, F.lit(0.0)).otherwise(F.col("confidence")),
        "review_status": F.when(flagged, F.lit("schema_error")).otherwise(F.lit("pending"))})


def extraction_summary(fields: DataFrame, mode: str = "single") -> DataFrame:
    """Counts per filing."""
    return fields.groupBy("filing_id").agg(
        F.count("*").alias("field_count"), F.count_if(~F.col("not_found")).alias("fields_found"),
        F.count_if(F.col("not_found")).alias("fields_null")).withColumn("extraction_mode", F.lit(mode))


# ---- requests -----------------------------------------------------------------------------

def section_table(spark: SparkSession, sections: dict = config.SECTIONS) -> DataFrame:
    rows = [(name, s["schema_keys"], s["search_headers"], s["max_chars"], s.get("note", ""))
            for name, s in sections.items()]
    return small_table(spark, 
        rows, "name STRING, schema_keys ARRAY<STRING>, search_headers ARRAY<STRING>, max_chars INT, note STRING")


def route_sections(filings: DataFrame, routes: dict[str, list[str]] = config.MODEL_SECTIONS,
                   default: list[str] = config.ALL_SECTIONS,
                   defined: list[str] | None = None) -> DataFrame:
    """(filing, section, ord) in run order; an unrouted model runs all sections."""
    defined = list(config.SECTIONS) if defined is None else defined

    def names(route: list[str]) -> Column:
        return F.array(*[F.lit(s) for s in route if s in defined])
    chosen = F.coalesce(*[F.when(F.col("model") == m, names(r)) for m, r in routes.items()], names(default))
    return filings.select("filing_id", "model", F.posexplode(chosen).alias("ord", "section"))


def section_descriptors(descriptors: DataFrame, sections: DataFrame) -> DataFrame:
    """The descriptors each section asks for, matched on the path's top segment."""
    keys = sections.select(F.col("name").alias("section"), F.explode("schema_keys").alias("top"))
    top = F.substring_index("field_path", ".", 1)
    return (descriptors.withColumn("top", top).join(keys, "top")
            .select("model", "section", "field_path", "data_type", "required"))


def hint_blocks(issuers: DataFrame, field_hints: DataFrame, shared_rules: DataFrame,
                guide: list[str]) -> DataFrame:
    """One text block per issuer: output rules, shared field rules, issuer guidance.

    Limits: 6 headings, 800 characters of notes, 150 of format, 100 of location.
    """
    def bullet(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    def lines(df: DataFrame, keys: list[str], line: Column) -> DataFrame:
        kept = df.withColumn("line", line).filter("line IS NOT NULL")
        return kept.groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("field_path", "line"))), lambda r: r["line"]), "\n").alias("block"))

    def rule(prefix: str, parts: list[Column]) -> Column:
        text = F.concat_ws(" | ", *parts)
        return F.when(text != "", F.concat(F.lit(prefix), F.col("field_path"), F.lit(": "), text))

    shared = lines(shared_rules, [], rule("- ", [
        blank_to_null(F.col("description")), bullet("synonyms: ", F.col("synonyms")),
        bullet("format: ", F.col("value_format")), bullet("caution: ", F.col("caution"))]))
    own = lines(field_hints, ["issuer_key"], rule("  - ", [
        bullet("synonyms: ", F.col("synonyms")), bullet("label: ", F.col("label_in_doc")),
        bullet("format: ", F.substring("format", 1, 150)),
        bullet("location: ", F.substring("location", 1, 100))])).withColumnRenamed("block", "own_block")
    head = "\n".join(["## Output rules", *guide, ""]) if guide else None
    about = F.concat_ws("\n", F.lit("## Issuer guidance"),
                        bullet("Key terms: ", F.col("key_terms_position")),
                        bullet("Layout: ", F.col("document_structure")),
                        bullet("Headings: ", F.array_join(F.slice("section_headings", 1, 6), ", ")),
                        bullet("Notes: ", F.substring("general_notes", 1, 800)),
                        bullet("Field aliases:\n", F.col("own_block")))
    shared_text = shared.select(F.concat(F.lit("## Shared field rules\n"), F.col("block"))).scalar()
    return (issuers.join(own, "issuer_key", "left")
            .select("issuer_key", F.concat_ws("\n", F.lit(head), shared_text, about).alias("hints_block")))


EMPTY_SLICE = "[No matching section in this filing: answer null for every field]"
REQUEST_TEMPLATE = ("Extract the fields of the schema below from the filing text.\nModel: {model}\n"
                    "Section: {section}\nInstruction: {note}\nSchema:\n{schema}\n{hints}")


def extraction_requests(slices: DataFrame, schemas_text: DataFrame, hints: DataFrame,
                        sections: DataFrame, template: str = REQUEST_TEMPLATE) -> DataFrame:
    """The batch-inference input: a preamble shared by issuer and model, and the filing text.

    ``slices`` is (filing_id, model, section, issuer_key, slice); the wording is the caller's.
    """
    joined = (slices.join(schemas_text, ["model", "section"], "left")
              .join(hints, "issuer_key", "left")
              .join(sections.selectExpr("name AS section", "note"), "section", "left"))
    text = F.lit(template)
    for name, c in (("model", F.col("model")), ("section", F.col("section")), ("note", F.col("note")),
                    ("schema", F.col("schema_text")), ("hints", F.col("hints_block"))):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    body = F.when(F.col("slice") == "", F.lit(EMPTY_SLICE)).otherwise(F.col("slice"))
    return joined.select("filing_id", "section", text.alias("preamble"),
                         F.concat(F.lit("FILING TEXT:\n"), body).alias("filing_part"))
