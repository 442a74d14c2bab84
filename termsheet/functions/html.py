"""HTML to plain text with built-in expressions (H1)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from termsheet.functions.text import let, literal_map, strip

_SEPARATOR = "\u0001"
# One left-to-right pass: comments, whole script/style/head elements, then any single tag.
_MARKUP = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
           r"|<head\b.*?</head\s*>|</?[a-z](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>")


def _entity(chunk: Column) -> Column:
    """Text after an ``&``: the entity it starts with, decoded, and the rest."""
    def number(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(
            F.substring(name, F.lit(2), F.length(name))).try_cast("bigint")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    named = literal_map({name: chr(code) for name, code in sorted(name2codepoint.items())})

    def decoded(name: Column) -> Column:
        char = F.when(name.startswith("#"), number(name)).otherwise(
            F.when(name == "apos", F.lit("'")).otherwise(F.try_element_at(named, name)))
        return let(char, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), chunk)).otherwise(
            F.concat(c, F.substring(chunk, F.length(name) + 2, F.length(chunk)))))

    return let(F.regexp_extract(chunk, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1),
               lambda name: F.when(name == "", F.concat(F.lit("&"), chunk)).otherwise(decoded(name)))


def unescape(c: Column) -> Column:
    """Decode numeric and HTML 4 named entities; anything else stays as written."""
    parts = F.split(c, "&")
    return F.when(~c.contains("&"), c).otherwise(let(parts, lambda p: F.concat(
        F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), _entity), ""))))


def strip_html(html: Column) -> Column:
    """Visible text: each text node stripped, empty ones dropped, joined by line feeds."""
    nodes = F.split(F.regexp_replace(html, _MARKUP, _SEPARATOR), _SEPARATOR)
    texts = F.filter(F.transform(nodes, lambda t: strip(unescape(t))), lambda t: t != "")
    return F.regexp_replace(F.array_join(texts, "\n"), r"\n{3,}", "\n\n")


def image_sources(html: Column) -> Column:
    """``src`` of every image tag in document order."""
    found = F.regexp_extract_all(
        html, F.lit(r"""(?is)<img\b(?:[^'">]*?\s)??src\s*=\s*("[^"]*"|'[^']*'|[^\s'">]+)"""), F.lit(1))
    return F.transform(found, lambda s: strip(unescape(F.regexp_replace(s, r"""^["']|["']$""", ""))))
