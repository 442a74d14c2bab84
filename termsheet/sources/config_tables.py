"""Configuration files as tables (S10-S12): YAML in, small DataFrames or literals out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from termsheet import schemas
from termsheet.session import small_table

try:
    import yaml
except ImportError:                                    # only needed to read YAML files
    yaml = None


def _load(path: str | Path) -> dict:
    if yaml is None:
        raise RuntimeError("reading configuration files needs PyYAML")
    file = Path(path)
    return (yaml.safe_load(file.read_text(encoding="utf-8")) or {}) if file.exists() else {}


def _strings(pairs: dict | None) -> list[tuple[str, str]]:
    return [(k, v) for k, v in (pairs or {}).items() if isinstance(k, str) and isinstance(v, str)]


def read_labels(spark: SparkSession, shared: str, user: str | None = None, hints_dir: str | None = None) -> DataFrame:
    """Label layers from a shared file, a user file and per-issuer files."""
    rows = [(1, None, i, a, b) for i, (a, b) in enumerate(_strings(_load(shared).get("labels")))]
    if user:
        rows += [(2, None, i, a, b) for i, (a, b) in enumerate(_strings(_load(user).get("labels")))]
    if hints_dir:
        for block in issuer_blocks(hints_dir):
            rows += [(3, block["issuer_key"], i, a, b) for i, (a, b) in enumerate(_strings(block.get("table_labels")))]
    return small_table(spark, rows, schemas.LABELS)


def issuer_blocks(hints_dir: str) -> list[dict]:
    """Issuer files in name order; a file without ``issuer_key`` is left out."""
    blocks = [_load(p) for p in sorted(Path(hints_dir).glob("issuer_*.yaml"))]
    return [b for b in blocks if b.get("issuer_key")]


def issuer_list(hints_dir: str) -> list[dict]:
    """Issuers in the form the matching and window operators take."""
    return [{"issuer_key": b["issuer_key"], "patterns": (b.get("aliases") or {}).get("name_match_patterns", []),
             "headings": b.get("section_headings", []), "table_heading": b.get("key_terms_table_heading")}
            for b in issuer_blocks(hints_dir)]


def read_issuer_hints(spark: SparkSession, hints_dir: str) -> tuple[DataFrame, DataFrame]:
    """(issuers, field hints) tables for the summary and the hint blocks."""
    blocks = issuer_blocks(hints_dir)
    issuers = [(b["issuer_key"], b.get("section_headings") or [], b.get("key_terms_position"),
                b.get("document_structure"), b.get("general_notes")) for b in blocks]
    hints = [(b["issuer_key"], path, ", ".join(h.get("synonyms") or []), h.get("label_in_doc"), h.get("format"),
              h.get("typical_location")) for b in blocks for path, h in (b.get("field_hints") or {}).items()]
    return (small_table(spark, issuers, "issuer_key STRING, section_headings ARRAY<STRING>, key_terms_position STRING, "
                                           "document_structure STRING, general_notes STRING"),
            small_table(spark, hints, "issuer_key STRING, field_path STRING, synonyms STRING, label_in_doc STRING, "
                                         "format STRING, location STRING"))


def read_sections(path: str) -> dict[str, dict]:
    """Section name -> keys, headers, slice length and note."""
    return {name: {"schema_keys": s.get("schema_keys", []), "search_headers": s.get("search_headers", []),
                   "max_chars": s.get("max_chars", 10_000), "note": (s.get("system_note") or "").strip(),
                   "required_for": s.get("required_for", [])} for name, s in _load(path).items()}


def section_listing(sections: DataFrame) -> DataFrame:
    """Sections with the number of their headers and keys, by name."""
    return sections.select("name", F.size("schema_keys").alias("keys"), F.size("search_headers").alias("headers"),
                           "max_chars").orderBy("name")
