"""Label mapping: normalise, layer, resolve, and keep the log of labels nobody mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termsheet import config, schemas
from termsheet.functions.text import blank_to_null, normalise_label, slug, strip
from termsheet.session import small_table


def label_table(spark: SparkSession, user: list[tuple[str, str]] = (),
                issuer: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Label layers as a table: shared (1), user (2), per issuer (3); later rows win."""
    rows = [(1, None, i, label, path) for i, (label, path) in enumerate(config.shared_label_rows())]
    rows += [(2, None, i, label, path) for i, (label, path) in enumerate(user)]
    rows += [(3, key, i, label, path) for i, (key, label, path) in enumerate(issuer)]
    return small_table(spark, rows, schemas.LABELS)


def merge_layers(labels: DataFrame) -> DataFrame:
    """L2: one path per (issuer or shared, normalised label); higher layer, then later row, wins."""
    return (labels.withColumn("label_norm", normalise_label(F.col("label_raw")))
            .groupBy("issuer_key", "label_norm")
            .agg(F.max_by("field_path", F.struct("layer", "ord")).alias("field_path")))


def resolve(pairs: DataFrame, label_map: DataFrame) -> DataFrame:
    """L3: add ``label_norm`` and ``field_path``; an issuer's own label beats the shared one.

    ``pairs`` needs ``label_raw`` and, for issuer labels, ``issuer_key``.  The maps are small
    next to the pairs, so Catalyst broadcasts them by their size; no hint is forced.
    """
    keyed = pairs.withColumn("label_norm", normalise_label(F.col("label_raw")))
    shared = label_map.filter("issuer_key IS NULL").selectExpr("label_norm", "field_path AS shared_path")
    out = keyed.join(shared, "label_norm", "left")
    if "issuer_key" not in pairs.columns:
        return out.withColumnRenamed("shared_path", "field_path")
    own = label_map.filter("issuer_key IS NOT NULL").selectExpr(
        "issuer_key", "label_norm", "field_path AS own_path")
    return (out.join(own, ["issuer_key", "label_norm"], "left")
            .withColumn("field_path", F.coalesce("own_path", "shared_path"))
            .drop("own_path", "shared_path"))


def issuer_match(name: Column, issuers: list[dict] = config.ISSUERS) -> Column:
    """Key of the first issuer one of whose patterns contains, or is contained in, the name.

    The issuer list is short and fixed, so it becomes a chain of conditions evaluated in the
    scan: no join, no shuffle.
    """
    lowered = F.lower(F.nullif(name, F.lit("")))
    keys = []
    for issuer in issuers:
        hit = F.lit(False)
        for pattern in sorted({p.lower() for p in issuer["patterns"]}):
            hit = hit | lowered.contains(pattern) | F.lit(pattern).contains(lowered)
        keys.append(F.when(hit, F.lit(issuer["issuer_key"])))
    return F.coalesce(*keys)


def misses_per_filing(resolved: DataFrame) -> DataFrame:
    """Each unmapped label once per filing, with the first value seen (200 characters)."""
    first = F.min_by(F.struct("label_raw", F.substring("value_raw", 1, config.SAMPLE_CHARS)
                              .alias("sample_value")), "row_no")
    return (resolved.filter("field_path IS NULL")
            .groupBy("filing_id", "label_norm").agg(first.alias("first"))
            .select("filing_id", "label_norm", "first.label_raw", "first.sample_value"))


def upsert_misses(log: DataFrame, misses: DataFrame) -> DataFrame:
    """Add a batch of per-filing misses to the miss log.

    ``misses`` carries ``issuer_name`` and ``seen_at`` per filing.  Counts go up by one per
    filing; issuer, filing and time follow the last filing; the first non-empty sample stays;
    a dismissed label stays dismissed.
    """
    when = F.struct("seen_at", "filing_id")
    batch = misses.groupBy("label_norm").agg(
        F.count("*").alias("n"), F.min_by("label_raw", when).alias("b_raw"),
        F.min_by("sample_value", F.when(F.col("sample_value") != "", when)).alias("b_sample"),
        F.max_by(F.struct("issuer_name", "filing_id"), when).alias("b_last"),
        F.min("seen_at").alias("b_first_seen"), F.max("seen_at").alias("b_last_seen"))
    seen = F.col("n").isNotNull()
    return log.join(batch, "label_norm", "full_outer").select(
        "label_norm", F.coalesce("label_raw", "b_raw").alias("label_raw"),
        F.coalesce(blank_to_null(F.col("sample_value")), "b_sample").alias("sample_value"),
        F.when(seen, F.col("b_last.issuer_name")).otherwise(F.col("issuer_name")).alias("issuer_name"),
        F.when(seen, F.col("b_last.filing_id")).otherwise(F.col("filing_id")).alias("filing_id"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"),
        F.coalesce("first_seen_at", "b_first_seen").alias("first_seen_at"),
        F.coalesce("b_last_seen", "last_seen_at").alias("last_seen_at"),
        F.coalesce("dismissed", F.lit(False)).alias("dismissed"))


def merged_entries(shared: DataFrame, user: DataFrame) -> DataFrame:
    """L4: shared and user entries by normalised label; the user's entry replaces the shared one."""
    def last(entries: DataFrame, source: str) -> DataFrame:
        return (entries.withColumn("label_norm", normalise_label(F.col("label_raw")))
                .groupBy("label_norm")
                .agg(F.max_by(F.struct(F.col("label_raw").alias("label"), "field_path",
                                       F.lit(source).alias("source")), "ord").alias(source)))
    return (last(shared, "cross_issuer").join(last(user, "user"), "label_norm", "full_outer")
            .select("label_norm", F.coalesce("user", "cross_issuer").alias("e"))
            .select("e.label", "label_norm", "e.field_path", "e.source").orderBy("label_norm"))


def filter_entries(entries: DataFrame, text: str = "", source: str | None = None) -> DataFrame:
    """Entries whose label or path contains the text, optionally of one source."""
    out = entries
    if text.strip():
        needle = text.strip().lower()
        out = out.filter(F.lower("label").contains(needle) | F.lower("field_path").contains(needle))
    return out.filter(F.col("source") == source) if source else out


def count_user_entries(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"),
                       F.count_if(F.col("source") == "user").alias("user_entries"))


def list_misses(log: DataFrame, include_dismissed: bool = False) -> DataFrame:
    """Open misses, most frequent first."""
    rows = log if include_dismissed else log.filter(~F.col("dismissed"))
    count = F.when(F.coalesce("occurrences", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("occurrences"))
    return (rows.orderBy(F.desc_nulls_last("occurrences"), "label_norm")
            .withColumn("occurrences", count.cast("bigint")))


def apply_miss_actions(log: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``resolve`` and ``dismiss`` actions (label_norm, action, field_path, seq) on the log.

    Returns the updated log, the user label rows that resolving adds, and rejected actions.
    """
    blank = F.coalesce(strip(F.col("field_path")), F.lit("")) == ""
    bad = (F.col("action") == "resolve") & blank
    known = actions.join(log.select("label_norm", "label_raw"), "label_norm", "left")
    reason = (F.when(bad, F.lit("field_path must not be empty"))
              .when(F.col("label_raw").isNull(), F.lit("miss entry not found")))
    judged = known.withColumn("reason", reason)
    good = judged.filter("reason IS NULL")
    touched = good.groupBy("label_norm").agg(F.lit(True).alias("touched"))
    updated = (log.join(touched, "label_norm", "left")
               .withColumn("dismissed", F.col("dismissed") | F.coalesce("touched", F.lit(False)))
               .drop("touched"))
    added = (good.filter("action = 'resolve'").groupBy("label_raw")
             .agg(F.max_by(strip(F.col("field_path")), "seq").alias("field_path"),
                  F.max("seq").alias("seq"))
             .select(strip(F.col("label_raw")).alias("label_raw"), "field_path", "seq"))
    rejected = judged.filter("reason IS NOT NULL").select("label_norm", "action", "reason")
    return updated, added, rejected


def dismiss_all(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dismiss every open miss; also how many there were."""
    return (log.withColumn("dismissed", F.lit(True)),
            log.agg(F.count_if(~F.col("dismissed")).alias("dismissed_count")))


def edit_user_labels(current: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay ``add`` / ``remove`` edits (seq, action, label_raw, field_path) on user labels.

    An add overwrites the same raw label; a remove drops every raw label that normalises to
    the given key.  Returns the labels and the rejected edits.
    """
    text = strip(F.coalesce("label_raw", F.lit("")))
    path = strip(F.coalesce("field_path", F.lit("")))
    judged = edits.withColumn("reason", F.when(
        F.col("action") == "add",
        F.when(text == "", F.lit("label must not be empty"))
        .when(path == "", F.lit("field_path must not be empty"))))
    base = current.select(text.alias("label_raw"), path.alias("field_path"), F.lit(-1).cast("bigint").alias("seq"))
    adds = judged.filter("action = 'add' AND reason IS NULL").select(
        text.alias("label_raw"), path.alias("field_path"), F.col("seq").cast("bigint").alias("seq"))
    latest = (base.unionByName(adds).groupBy("label_raw")
              .agg(F.max_by("field_path", "seq").alias("field_path"), F.max("seq").alias("seq"))
              .withColumn("label_norm", normalise_label(F.col("label_raw"))))
    removed = (judged.filter("action = 'remove'")
               .groupBy(F.col("label_raw").alias("label_norm")).agg(F.max("seq").alias("removed_at")))
    kept = (latest.join(removed, "label_norm", "left")
            .filter("removed_at IS NULL OR seq > removed_at")
            .select("label_raw", "label_norm", "field_path"))
    return kept, judged.filter("reason IS NOT NULL").select("seq", "label_raw", "reason")


def issuer_summary(issuers: DataFrame, field_hints: DataFrame) -> DataFrame:
    """Slug, name, field-hint count and headings per issuer, by name."""
    counts = field_hints.groupBy("issuer_key").agg(F.countDistinct("field_path").alias("n"))
    return (issuers.join(counts, "issuer_key", "left")
            .select(slug(F.col("issuer_key")).alias("slug"), F.col("issuer_key").alias("name"),
                    F.coalesce("n", F.lit(0)).alias("field_hints_count"), "section_headings")
            .orderBy("name"))


def parser_catalogue(registry: DataFrame) -> DataFrame:
    """Paths that have a typed parser, sorted."""
    return registry.select("field_path").distinct().orderBy("field_path")


def update_hints(hints: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Partial update; given values overwrite, missing ones keep what was there."""
    values = [c for c in hints.columns if c not in keys]
    renamed = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values])
    return hints.join(renamed, keys, "full_outer").select(
        *keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in values])
