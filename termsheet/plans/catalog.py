"""Imports every query module so that the registry is complete."""

from termsheet.plans import document_queries, extract_queries, label_queries, schedule_queries, schema_queries, source_queries, usage_queries, workflow_queries  # noqa: F401
from termsheet.plans.registry import ORACLES, QUERIES  # noqa: F401
