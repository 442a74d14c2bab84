"""Literal cases for the typed values and label keys."""

import json
import time

import pytest
from pyspark.sql import functions as F

from termsheet import config
from termsheet.functions import text, values
from termsheet.operators.extract import clamp_confidence, parser_registry

CASES = {
    values.text_value: [("Goldman Sachs*", "Goldman Sachs"), ("Value(1)", "Value"), ("Value[2]", "Value"), ("Value†", "Value"),
                        ("", None), ("   ", None), ("*(1)", None), ("\u00a0x\u00a0", "x"), (None, None)],
    values.date_value: [("March 21, 2029", "2029-03-21"), ("Mar 21, 2029", "2029-03-21"), ("March 21, 2029*", "2029-03-21"),
                        ("on or about March 21, 2029", "2029-03-21"), ("2029/03/21", "2029-03-21"), ("2029-03-21", "2029-03-21"),
                        ("December 1, 2030", "2030-12-01"), ("TBD", None), ("", None), ("February 31, 2029", "2029-02-31"),
                        ("Smarch 3, 2029 or 2029-04-05", "2029-04-05"), ("may 7 2031", "2031-05-07")],
    values.rate_value: [("70%", 0.7), ("70.00%", 0.7), ("70.00% of Initial Underlier Value", 0.7), ("0.70%", 0.7),
                        ("8.50% per annum or 0.7083% per month", 0.085), ("1,949.187, 80.00% of its Initial Level", 0.8),
                        ("$5,350.77 (80.00% of its Initial Level)", 0.8), ("none", None), ("1%", 1.0), ("0.875%", 0.875),
                        ("0.5% monthly", 0.5), ("2% monthly and 9%", 0.09), ("9% p.a.", 0.09), (", % 7%", 0.07)],
    values.amount_value: [("$1,372,000.00", 1372000.0), ("1,372,000", 1372000.0), ("$1,000 per note", 1000.0),
                          ("US$ 2,000,000", 2000000.0), ("N/A", None), (", 5", None)],
    values.number_value: [("5,350.77", 5350.77), ("$150.00", 150.0), ("n/a", None), ("7.", 7.0)],
    values.plain_number: [("$1,234.5%", 1234.5), ("abc", None), ("€ 7", 7.0)],
    values.cusip_value: [("06749FWA3 / US06749FWA31", "06749FWA3"), ("N/A", None), ("CERTAINLY", "CERTAINLY")],
    values.isin_value: [("06749FWA3 / US06749FWA31", "US06749FWA31"), ("N/A", None)],
    values.currency_value: [("USD", "USD"), ("EUR", "EUR"), ("U.S. dollars", "USD"), ("US dollars", "USD"),
                            ("United States dollars", "USD"), ("USD (United States Dollars)", "USD"), ("Pesos", None)],
    values.frequency_value: [("monthly", "monthly"), ("per month", "monthly"), ("quarterly", "quarterly"),
                             ("semi-annual", "semiAnnually"), ("semiannual", "semiAnnually"), ("annually", "annually"),
                             ("per year", "annually"), ("ad hoc", None), ("every six months", "monthly"), ("each week", "weekly")],
    values.observation_value: [("European", "european"), ("observed at maturity", "european"), ("American", "american"),
                               ("daily monitoring", "american"), ("on each Observation Date", "periodic"), ("n/a", None)],
    text.normalise_label: [("Maturity Date:", "maturity date"), ("Maturity Date*", "maturity date"), ("Maturity Date †", "maturity date"),
                           ("Maturity Date(1)", "maturity date"), ("Maturity  Date", "maturity date"), ("Label*(1)", "label*"),
                           ("Label : †", "label"), ("A\u00a0B ::", "a b"), ("Label: :", "label:")],
    text.normalise_accession: [("000114036124000001", "0001140361-24-000001"), ("0001140361-24-000001", "0001140361-24-000001"),
                               (" 12 ", "12")],
    text.drop_leading_zeros: [("0000123", "123"), ("000", "000")],
    text.camel_label: [("maturityDate", "Maturity Date"), ("name", "Name")],
    text.slug: [("JPMorgan Chase & Co.", "jpmorgan_chase_co")],
    text.json_string: [('a"b\\c', '"a\\"b\\\\c"'), ("null", '"null"'), (None, None), ("[null]", '"[null]"')],
    text.drop_code_fences: [("```json\n{}\n```", "{}"), ("{}", "{}")],
}


@pytest.mark.parametrize("fn,cases", list(CASES.items()), ids=lambda x: getattr(x, "__name__", None))
def test_literal_cases(spark, fn, cases):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i INT, raw STRING")
    got = {r["i"]: r["v"] for r in df.select("i", fn(F.col("raw")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


@pytest.mark.parametrize("raw,default,want", [
    ("0.75", 0.5, 0.75), ("0.0", 0.5, 0.0), ("1", 0.5, 1.0), ("1.5", 0.5, 1.0), ("100", 0.5, 1.0), ("-0.3", 0.5, 0.0),
    (" 0.9 ", 0.5, 0.9), ("high", 0.5, 0.5), ("0.85 (estimated)", 0.0, 0.0), (None, 0.5, 0.5), ("", 0.0, 0.0)])
def test_clamp(one, raw, default, want):
    assert one(lambda c: clamp_confidence(c, default), raw) == want


def test_registry_kinds_are_known(spark):
    rows = parser_registry(spark, aliases=True).collect()
    assert len(rows) == len(config.PARSER_KINDS) + len(config.PARSER_KIND_ALIASES)
    assert {r["kind"] for r in rows} <= set(values._KINDS)


def test_generic_paths_stay_text_without_alias(one):
    assert one(lambda c: values.typed_json(F.lit(None).cast("string"), c), " March 1, 2030 ") == '"March 1, 2030"'
    assert one(lambda c: values.typed_json(F.lit("date"), c), " March 1, 2030 ") == '"2030-03-01"'


def test_number_text_is_plain(spark):
    numbers = [25_000_000.0, 1_234_567_890.0, 0.0005, 0.00001234, 0.0001, 1e15, 9999999999999998.0, 1e16, 1.5e300, 2.5e-7, 0.0, 100000.5,
               0.1 + 0.2, 12345678.901234567, -3e7, 1e7]
    df = spark.createDataFrame([(n,) for n in numbers], "n DOUBLE")
    assert [r[0] for r in df.select(values.number_text(df.n)).collect()] == [repr(n) for n in numbers]


def test_a_text_without_percent_sign_is_not_searched_for_rates(one):
    began = time.monotonic()
    assert one(values.rate_value, "1" * 5000) is None
    assert time.monotonic() - began < 30


def test_space_of_every_kind_is_stripped_and_collapsed(one):
    spaces = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    assert one(text.strip, f"{spaces}a{spaces}b\u200b{spaces}") == f"a{spaces}b\u200b"
    assert one(text.normalise_label, f"{spaces}A{spaces}b c *{spaces}†(12) ::{spaces}") == "a b c * †(12)"
    assert one(text.strip_footnotes, f" a* (1) [2] b) {spaces}") == "a b)"


def test_json_strings_are_those_of_the_json_writer(one):
    for raw in ("", "plain ~!#[]", 'a"b', "back\\slash", "tab\t", "line\n", "line ", "é", "\x7f", "\x00", "😀"):
        assert json.loads(one(text.json_string, raw)) == raw
        assert one(text.json_string, raw) == one(lambda c: F.expr("regexp_replace(to_json(array(raw)), '^.|.$', '')"), raw)
