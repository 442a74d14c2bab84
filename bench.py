"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose the input
and the local session.  Each query is run once to warm up and timed on its second run, written
to the no-op sink so that every row is produced but none is moved to the driver.

The given tables are single row groups, which one core would read alone.  Tables of the size the queries are
meant for are written in many; so the input is first written to a scratch folder with a file per
core, outside the timed part, and no query deals out its input by itself.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from pathlib import Path

from termsheet.plans import catalog
from termsheet.session import local_session

HEADLINES = [
    "u4_totals", "u6_by_step", "u7_by_model", "u8_by_issuer", "u12_timeline_week", "u13_filing_kpis",
    "l3_resolve_labels", "l7_miss_upsert", "l11_issuer_match", "v2_date", "v3_percentage", "v12_typed_values",
    "e2_table_fields", "e2_fill_rate_by_issuer", "e5_flatten_answers", "e7_merge_sections", "e8_merge_tiers",
    "e11_enum_validation", "h1_strip_to_text", "h2_key_terms_rows", "h5_key_terms_window", "h6_section_slices",
    "h8_targeted_sections", "h9_excerpt_anchor", "c7_validate_answers", "w0_action_outcomes", "w5_review_audit",
    "x3_required_gate", "x5_unflatten", "s17_export_documents", "d4_field_changes", "g1_parse_log", "r3_issuer_breakdown", "s2_search_hits",
]


def staged(spark, sf_dir: str, files: int, folder: str) -> str:
    for path in Path(sf_dir).glob("*.parquet"):
        table = spark.read.parquet(str(path))
        parts = files if path.stat().st_size > 1 << 20 else 1
        table.repartition(parts).write.parquet(f"{folder}/{path.name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    partitions = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = local_session("bench", cpus, partitions)
    scratch = tempfile.TemporaryDirectory(prefix="termsheet-bench-")
    data = staged(spark, sf_dir, partitions, scratch.name)
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
