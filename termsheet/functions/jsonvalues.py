"""JSON values: objects held as VARIANT or as maps, text form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from termsheet.functions.text import json_string


def json_text(v: Column) -> Column:
    """JSON text of a variant; JSON null and SQL null both give null."""
    return F.when(~F.is_variant_null(v), F.to_json(v))


def members(v: Column) -> Column:
    """An object variant as map<string, variant>; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def object_text(parts: Column) -> Column:
    """JSON text of an object held as a map from key to JSON text."""
    pairs = F.transform(F.map_entries(parts), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def scalar_text(json: Column) -> Column:
    """Text of a JSON scalar the way allowed values are written: bare strings, ``True``, ``1.0``."""
    return (F.when(json.startswith('"'), F.try_variant_get(F.try_parse_json(json), "$", "string"))
            .when(json == "true", F.lit("True")).when(json == "false", F.lit("False")).otherwise(json))
