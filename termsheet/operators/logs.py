"""Application log analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termsheet import config
from termsheet.functions.ordered import previous_known
from termsheet.functions.text import literal_map

_LINE = r"(?U)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\s+(\w+)\s+(\S+)\s+(.*)"


def parse_log(lines: DataFrame, block: int = 50_000, part_lines: int | None = None) -> DataFrame:
    """G1: log entries (file, line_no, ts, level, name, message) from raw lines.

    A line that does not look like an entry belongs to the entry before it; lines before the
    first entry are dropped.  The entry a line belongs to is found block by block, so one huge
    file is still shared out over many tasks.

    A message is one text, however many lines go on.  With ``part_lines``, an entry of more lines goes on in further rows, so that
    one that goes on for a third of the file is no row of its own: ``part`` counts them from 0.
    """
    is_head = F.col("line").rlike(_LINE)
    head = F.struct("line_no", *[F.regexp_extract("line", _LINE, i + 1).alias(n) for i, n in enumerate(("ts", "level", "name"))])
    marked = previous_known(lines.withColumn("is_head", is_head), ["file"], "line_no", F.when(is_head, head), "before", block)
    text = F.when(F.col("is_head"), F.regexp_extract("line", _LINE, 4)).otherwise(F.col("line"))
    told = marked.withColumn("h", F.when(F.col("is_head"), head).otherwise(F.col("before"))).filter("h IS NOT NULL")
    part = [] if part_lines is None else [F.floor((F.col("line_no") - F.col("h.line_no")) / part_lines).cast("int").alias("part")]
    grouped = told.groupBy("file", F.col("h.line_no").alias("entry"), *part).agg(
        F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))).alias("parts"))
    return grouped.select("file", F.col("entry").alias("line_no"), *(["part"] if part else []), "h.ts", "h.level", "h.name",
                          F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("message"))


def filter_log(entries: DataFrame, level: str = "ALL", module: str = "", text: str = "") -> DataFrame:
    """Entries of at least a level, with a part of the logger name and of the message."""
    rows = entries
    least = config.LOG_LEVELS.get(level.upper(), 0)
    if least > 0:
        rank = F.coalesce(F.try_element_at(literal_map(config.LOG_LEVELS), F.col("level")), F.lit(0))
        rows = rows.filter(rank >= least)
    if module.strip():
        rows = rows.filter(F.lower("name").contains(module.strip().lower()))
    return rows.filter(F.lower("message").contains(text.lower())) if text else rows


def tail_log(entries: DataFrame, lines: int = 200) -> tuple[DataFrame, DataFrame]:
    """The last entries, and how many matched in all."""
    newest = entries.orderBy(F.desc("file"), F.desc("line_no")).limit(lines)
    return newest, entries.agg(F.count("*").alias("total_matched"))
