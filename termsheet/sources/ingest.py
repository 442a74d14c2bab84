"""Filing intake: search hits, primary documents, de-duplication, URL choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termsheet.functions.text import (
    accession_folder, blank_to_null, drop_leading_zeros, normalise_accession, strip)
from termsheet.session import small_table


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per HTML file; bytes that are not UTF-8 become replacement characters.

    The filing key is the name of the folder a file lies in.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder_key"), "path", "length", "modificationTime",
                        F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of the files in a folder, by name; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"),
                        F.col("modificationTime").alias("modified_at")).orderBy("filename")


def search_hits(hits: DataFrame, cusip_map: DataFrame) -> DataFrame:
    """Search hits (query, hit JSON) as rows, whichever response form they came in.

    Newer hits carry ``adsh``, ``ciks`` and ``display_names``; older ones ``accession_no``,
    ``file_num`` and ``entity_name``.  The query's CUSIP, if mapped, adds its model.
    """
    hit = F.try_parse_json("hit")

    def text(path: str) -> Column:
        return blank_to_null(F.try_variant_get("h", path, "string"))

    def first(path: str) -> Column:
        return F.get(F.try_variant_get("h", path, "array<string>"), F.lit(0))

    rows = hits.withColumn("h", hit)
    accession = F.coalesce(text("$._source.adsh"), text("$._source.accession_no"),
                           F.substring_index(F.coalesce(text("$._id"), F.lit("")), ":", 1))
    shown = first("$._source.display_names")
    entity = F.when(shown.isNotNull(), strip(F.substring_index(shown, "  (", 1))).otherwise(
        F.coalesce(F.try_variant_get("h", "$._source.entity_name", "string"), F.lit("")))
    number = F.coalesce(first("$._source.file_num"), F.try_variant_get("h", "$._source.file_num", "string"), F.lit(""))
    cik = F.coalesce(drop_leading_zeros(first("$._source.ciks")), F.substring_index(number, "-", 1))
    known = cusip_map.select(F.col("cusip").alias("map_cusip"), F.col("cusip").alias("cusip_hint"),
                             F.col("model").alias("known_model"))
    return (rows.join(known, F.upper(strip(F.col("query"))) == F.col("map_cusip"), "left").select(
        accession.alias("accession_number"), entity.alias("entity_name"),
        F.coalesce(F.try_variant_get("h", "$._source.file_date", "string"), F.lit("")).alias("filing_date"),
        F.coalesce(text("$._source.file_type"), text("$._source.form_type"), F.lit("424B2")).alias("form_type"),
        cik.alias("cik"), "cusip_hint", "known_model"))


def primary_documents(index: DataFrame) -> DataFrame:
    """S3: of each filing's index rows the first HTML file typed 424B2, else the first HTML file."""
    html = index.filter(F.col("name").rlike(r"(?i)\.html?$"))
    other = F.when(F.lower("type").contains("424b2"), 0).otherwise(1)
    best = F.min_by(F.struct("seq", "name", "url", "type"), F.struct(other, F.col("seq")))
    return html.groupBy("filing_id").agg(best.alias("d")).select("filing_id", "d.*")


def html_only(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that are not PDF by content type, and the rejected ones."""
    pdf = F.lower(F.coalesce("content_type", F.lit(""))).contains("pdf")
    return docs.filter(~pdf), docs.filter(pdf).withColumn("reason", F.lit("PDF filing is not supported"))


def cusip_map(rows: DataFrame, order: str) -> DataFrame:
    """The mapping sheet: header names in any case, cells trimmed, blanks dropped, last row wins."""
    named = {c.strip().lower(): c for c in rows.columns}
    if "cusip" not in named or "spectrum" not in named:
        return small_table(rows.sparkSession, [], "cusip STRING, model STRING, source_url STRING")

    def cell(name: str) -> Column:
        return strip(F.coalesce(F.col(f"`{named[name]}`").cast("string"), F.lit(""))) if name in named else F.lit("")
    cells = rows.select(cell("cusip").alias("cusip"), cell("spectrum").alias("model"),
                        cell("source").alias("source_url"), F.col(order).alias("_order"))
    last = F.max_by(F.struct("model", "source_url"), "_order")
    return (cells.filter((F.col("cusip") != "") & (F.col("model") != "")).groupBy("cusip")
            .agg(last.alias("m")).select("cusip", "m.model", "m.source_url"))


def read_cusip_map(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return cusip_map(rows.withColumn("_line", F.monotonically_increasing_id()), "_line")


def source_urls(requests: DataFrame, cusips: DataFrame) -> DataFrame:
    """The request's URL, else the mapped URL if it is an HTML page, else an index lookup."""
    mapped = cusips.select(F.col("cusip").alias("map_cusip"), F.col("source_url").alias("mapped_url"))
    joined = requests.join(mapped, F.upper(strip(F.coalesce("cusip", F.lit("")))) == F.col("map_cusip"), "left").drop("map_cusip")
    given = blank_to_null(F.col("source_url"))
    page = F.when(F.col("mapped_url").rlike(r"(?i)\.html?$"), F.col("mapped_url"))
    return joined.withColumns({
        "resolved_url": F.coalesce(given, page),
        "url_source": F.when(given.isNotNull(), F.lit("request")).when(page.isNotNull(), F.lit("mapping")).otherwise(F.lit("index"))
    }).drop("mapped_url")


def new_filings(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests not stored yet, one per normalised accession number, ready to append."""
    keyed = requests.withColumns({"accession_number": normalise_accession(F.col("accession_number")),
                                  "cik": drop_leading_zeros(F.col("cik"))})
    fresh = keyed.join(stored.select("accession_number"), "accession_number", "left_anti")
    rest = [c for c in fresh.columns if c != "accession_number"]
    first = F.min_by(F.struct(*rest), "request_no")
    return (fresh.groupBy("accession_number").agg(first.alias("r")).select("accession_number", "r.*")
            .withColumns({"folder_path": accession_folder(F.col("accession_number")), "status": F.lit("ingested")}))


def metadata_json(filings: DataFrame, images: DataFrame) -> DataFrame:
    """The metadata snapshot of each filing: ids, dates, URL and the list of images."""
    listed = images.groupBy("filing_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "image_name"))), lambda r: r["image_name"]).alias("images"))
    snapshot = F.to_json(F.struct("cusip", "cik", "accession_number", "issuer_name", "filing_date",
                                  F.col("source_url").alias("filing_url"), "ingest_timestamp",
                                  F.coalesce("images", F.array().cast("array<string>")).alias("images")),
                         {"ignoreNullFields": "false"})
    return filings.join(listed, "filing_id", "left").select("filing_id", snapshot.alias("metadata_json"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Call-log rows from model responses; zero cache tokens are stored as null."""
    return calls.select(
        "filing_id", "call_type", "model", F.col("input_tokens").alias("prompt_tokens"),
        F.col("output_tokens").alias("completion_tokens"), "duration_seconds",
        F.nullif("cache_read_tokens", F.lit(0)).alias("cache_read_tokens"),
        F.nullif("cache_write_tokens", F.lit(0)).alias("cache_write_tokens"), "called_at")


def migrated(table: DataFrame, ddl: str) -> DataFrame:
    """An older table in today's schema: missing columns are null, extra ones stay."""
    empty = small_table(table.sparkSession, [], ddl)
    return empty.unionByName(table, allowMissingColumns=True)
