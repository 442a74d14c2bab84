"""Text normalisation as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters of (?U)\s, under which \s, \d, \w and \b follow Unicode, so a no-break space counts as white space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SIGNS = "*†‡§¶"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A Column used twice is evaluated twice inside a CASE branch; for a chain of regular
    expressions that adds up.  Binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null if there is none."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def strip_footnotes(c: Column) -> Column:
    """Drop footnote signs, ``(1)`` and ``[1]`` marks, and outer white space (V0)."""
    bare = F.regexp_replace(c, f"[{_SIGNS}]", "")
    bare = F.regexp_replace(bare, r"(?U)\s*\(\d+\)", "")
    bare = F.regexp_replace(bare, r"(?U)\s*\[\d+\]", "")
    # Most texts hold no sign and no closing bracket, and one look tells.
    return strip(F.when(c.rlike(rf"[{_SIGNS})\]]"), bare).otherwise(c))


def normalise_label(c: Column) -> Column:
    """Lookup key of a table label: case, spacing, tail marks, ``(1)``, colon (L1).

    Each tail pattern takes the white space before it along, so one outer strip is enough.
    Single spaces stay as they are, and only labels that end in ``)`` or ``:`` meet the tail patterns.
    """
    c = F.regexp_replace(F.lower(strip(c)), r"(?U)\s{2,}|[\s&&[^ ]]", " ")
    c = F.rtrim(c, F.lit(" " + _SIGNS))
    tail = F.regexp_replace(F.regexp_replace(c, r"\s*\((?U:\d+)\)$", ""), r"\s*:+$", "")
    return F.when(c.endswith(")") | c.endswith(":"), tail).otherwise(c)


def normalise_accession(c: Column) -> Column:
    """18 bare digits become ``XXXXXXXXXX-YY-ZZZZZZ``."""
    return F.regexp_replace(strip(c), r"^([^-]{10})([^-]{2})([^-]{6})$", "$1-$2-$3")


def accession_folder(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def drop_leading_zeros(c: Column) -> Column:
    """Company number without leading zeros; an all-zero number stays as it is."""
    return F.coalesce(blank_to_null(F.ltrim(c, F.lit("0"))), c)


def camel_label(c: Column) -> Column:
    """``maturityDate`` -> ``Maturity Date``."""
    return F.initcap(F.trim(F.regexp_replace(c, "([A-Z])", " $1")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def drop_code_fences(c: Column) -> Column:
    """Remove Markdown code fences around a JSON answer."""
    c = F.regexp_replace(c, r"(?m)^```[a-z]*\n?", "")
    return strip(F.regexp_replace(c, r"(?m)```$", ""))


def json_string(c: Column) -> Column:
    """A string Column as a JSON string literal; null stays null.

    Plain ASCII stands for itself between quotes; only other texts go through the JSON writer.
    """
    def quoted(x: Column) -> Column:
        written = let(F.to_json(F.array(x)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
        return F.when(x.rlike(r"^[ !#-\[\]-~]*+\z"), F.concat(F.lit('"'), x, F.lit('"'))).when(x.isNotNull(), written)

    return let(c, quoted)


def literal_map(pairs: dict) -> Column:
    """A small constant lookup table as a map literal."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
