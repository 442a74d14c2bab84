"""Typed value expressions: raw cell text -> date, rate, amount, code, ....

Each function maps a string Column to a Column, null where the text does not parse.  They
are built-in expressions only, so one projection evaluates them inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from termsheet import config
from termsheet.functions.text import (
    blank_to_null, first_match, json_string, let, literal_map, strip, strip_footnotes)

# The patterns that values are read by.
_NUMBER = r"(?U)[\d,]+\.?\d*"
_SPELLED_DATE = r"(?U)\b([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b"
_ISO_DATE = r"(?U)^\d{4}-\d{2}-\d{2}$"
_DIGIT_DATE = r"(?U)\b\d{4}[/\-]\d{2}[/\-]\d{2}\b"
_YEARLY_RATE = r"(?iU)([\d,]+\.?\d*)\s*%\s*(?:per\s+annum|p\.a\.|per\s+year|annually)\b"
_ANY_RATE = r"(?iU)[\d,]+\.?\d*\s*%(?:\s*(?:per\s+month|monthly)\b)?"
_AMOUNT_SIGNS, _NUMBER_SIGNS, _CELL_SIGNS = "[US$£€¥]", "[,$£€¥]", r"(?U)[,$£€¥\s]"
_CUSIP = r"(?U)\b[A-Z0-9]{9}\b"
_ISIN = r"(?U)\b[A-Z]{2}[A-Z0-9]{10}\b"


def _to_double(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def text_value(raw: Column) -> Column:
    return blank_to_null(strip_footnotes(raw))


def date_value(raw: Column) -> Column:
    """ISO text, else the first ``Month D, YYYY``, else ``YYYY/MM/DD``; not calendar-checked."""
    def spelled(phrase: Column) -> Column:           # "March 21, 2029"; null month -> null
        month = F.try_element_at(literal_map(config.MONTHS), F.lower(F.regexp_extract(phrase, _SPELLED_DATE, 1)))
        return F.concat(F.substring(phrase, -4, 4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"),
                        F.lit("-"), F.lpad(F.regexp_extract(phrase, _SPELLED_DATE, 2), 2, "0"))

    return let(strip_footnotes(raw), lambda text: F.coalesce(
        F.when(text.rlike(_ISO_DATE), text),
        let(first_match(text, _SPELLED_DATE), spelled),
        F.translate(first_match(text, _DIGIT_DATE), "/", "-")))


def rate_value(raw: Column) -> Column:
    """Percent text as a fraction: yearly rate first, else the last rate that is not monthly.

    A figure of at most 1 is kept as it stands (``0.875%`` -> 0.875).  A text without a percent sign has no rate, which
    is seen before any pattern is tried.
    """
    yearly = _to_double(first_match(raw, _YEARLY_RATE, 1))
    found = F.regexp_extract_all(raw, F.lit(_ANY_RATE), F.lit(0))
    last = let(found, lambda all_: F.coalesce(
        F.try_element_at(F.filter(all_, lambda m: m.endswith("%")), F.lit(-1)),
        F.try_element_at(all_, F.lit(-1))))
    number = F.coalesce(yearly, _to_double(F.regexp_extract(last, _NUMBER, 0)))
    rate = let(number, lambda n: F.round(F.when(n > 1.0, n / 100.0).otherwise(n), 6))
    return F.when(raw.contains("%"), rate)


def amount_value(raw: Column) -> Column:
    """First number after currency signs and the letters U and S are removed."""
    return _to_double(F.regexp_extract(F.regexp_replace(raw, _AMOUNT_SIGNS, ""), _NUMBER, 0))


def number_value(raw: Column) -> Column:
    return _to_double(F.regexp_extract(F.regexp_replace(strip(raw), _NUMBER_SIGNS, ""), _NUMBER, 0))


def plain_number(raw: Column) -> Column:
    """Whole cell as a number once currency signs, commas, spaces and percent are gone."""
    return F.regexp_replace(F.regexp_replace(raw, _CELL_SIGNS, ""), "%+$", "").try_cast("double")


def cusip_value(raw: Column) -> Column:
    return first_match(strip_footnotes(raw), _CUSIP)


def isin_value(raw: Column) -> Column:
    return first_match(strip_footnotes(raw), _ISIN)


def currency_value(raw: Column) -> Column:
    codes = r"(?U)\b(?:" + "|".join(config.CURRENCY_CODES) + r")\b"
    spelled = "|".join(s.replace(".", r"\.") for s in config.DOLLAR_SPELLINGS)
    return let(F.upper(raw), lambda text: F.coalesce(
        first_match(text, codes), F.when(text.rlike(spelled), F.lit("USD"))))


def _keyword(raw: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Name of the first table row any of whose words occurs in the text."""
    def pick(text: Column) -> Column:
        rows = []
        for name, words in table:
            hit = F.lit(False)
            for word in words:
                hit = hit | text.contains(word)
            rows.append(F.when(hit, F.lit(name)))
        return F.coalesce(*rows)
    return let(F.lower(raw), pick)


def frequency_value(raw: Column) -> Column:
    return _keyword(raw, config.FREQUENCY_WORDS)


def observation_value(raw: Column) -> Column:
    return _keyword(raw, config.OBSERVATION_WORDS)


def number_text(value: Column) -> Column:
    """A double as JSON text: shortest digits, at least one decimal, an exponent only from 1e16 up and below 1e-4."""
    def text(n: Column) -> Column:
        digits = n.cast("string")
        plain = F.regexp_replace(digits.cast("decimal(38,20)").cast("string"), "0+$", "")
        power = F.substring_index(digits, "E", -1).cast("int")
        scientific = F.concat(F.regexp_replace(F.substring_index(digits, "E", 1), r"\.0$", ""), F.lit("e"),
                              F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                              F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
        return (F.when(~digits.contains("E"), digits)
                .when((F.abs(n) >= 1e-4) & (F.abs(n) < 1e16), F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))
                .otherwise(scientific))

    return let(value, text)


def _tagged_json(name: Column) -> Column:
    return F.concat(F.lit('{"$type":"'), name, F.lit('"}'))


# kind -> (expression, how its value is written as JSON)
_KINDS = {
    "text": (text_value, json_string),
    "date": (date_value, json_string),
    "percentage": (rate_value, number_text),
    "amount": (amount_value, number_text),
    "number": (number_value, number_text),
    "cusip": (cusip_value, json_string),
    "isin": (isin_value, json_string),
    "currency": (currency_value, json_string),
    "frequency": (frequency_value, _tagged_json),
    "observation": (observation_value, json_string),
}


def typed_json(kind: Column, raw: Column) -> Column:
    """JSON text of ``raw`` read as ``kind``; a null kind keeps the stripped text."""
    out = F.when(kind.isNull(), json_string(blank_to_null(strip(raw))))
    for name, (parse, to_json) in _KINDS.items():
        out = out.when(kind == name, to_json(parse(raw)))
    return out


def typed_number(kind: Column, raw: Column) -> Column:
    """The numeric value for the numeric kinds, else null."""
    out = F.when(kind == "percentage", rate_value(raw))
    out = out.when(kind == "amount", amount_value(raw))
    return out.when(kind == "number", number_value(raw))
