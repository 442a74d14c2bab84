"""Answers, section merge, tiers, coverage and validation."""

import json
import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from termsheet.functions import answers
from termsheet.operators import export, extract


def _flat(spark, payload, tool="submit_extraction"):
    df = spark.createDataFrame([("f", tool, payload)], "filing_id STRING, tool_name STRING, payload STRING")
    return extract.answer_fields(extract.flatten_answers(df))


def test_flatten_rules(spark):
    data = {"model": "m", "a": {"b": {"c": 1, "model": "x"}, "e": {}}, "l": [{"x": 1}], "n": None,
            "s": {"2024-01-01T00:00:00Z": {"v": 1}}, "_confidence": {"z": 1}}
    got = {r["field_path"]: r["value_json"] for r in _flat(spark, json.dumps({"data": data})).collect()}
    assert got == {"a.b.c": "1", "l": '[{"x":1}]', "n": None, "s": '{"2024-01-01T00:00:00Z":{"v":1}}'}


def test_depth_order_and_numbers(spark):
    deep = {"v": 1}
    for i in range(40):
        deep = {f"k{i}": deep}
    text = json.dumps({"data": {"deep": deep, "z": {"note": 0, "2024-01-01T00:00:00Z": 1, "2024-02-01T00:00:00Z": 1, "2024-03-01T00:00:00Z": 1},
                                "s": {"2024-01-01T": 1, "2024-01-02T": 1, "2024-01-03T": 1, "note": 0}, "a": [1.0, {"b": "é\n"}], "big": 12345678901234567890}})
    text = text[:-2] + ',"f": 1.0, "g": 1e7, "h": 1.50, "i": 1e-7, "q": 2E0}}'
    got = [(r["field_path"], r["value_json"]) for r in _flat(spark, text).collect()]
    assert got == [("deep." + ".".join(f"k{i}" for i in range(39, -1, -1)) + ".v", "1"), ("z.note", "0"), ("z.2024-01-01T00:00:00Z", "1"),
                   ("z.2024-02-01T00:00:00Z", "1"), ("z.2024-03-01T00:00:00Z", "1"),
                   ("s", '{"2024-01-01T":1,"2024-01-02T":1,"2024-01-03T":1,"note":0}'), ("a", '[1.0,{"b":"é\\n"}]'), ("big", "12345678901234567890"),
                   ("f", "1.0"), ("g", "10000000.0"), ("h", "1.5"), ("i", "1e-07"), ("q", "2.0")]


@pytest.mark.parametrize("tool,payload", [("submit_extraction", '{"data":"","_confidence":null,"_excerpts":[]}'), ("other", '{"data":{"a":1}}'),
                                          ("submit_extraction", "{broken"), (None, "not json"), ("submit_extraction", None)])
def test_bad_answers_give_no_fields(spark, tool, payload):
    assert _flat(spark, payload, tool).count() == 0


ODD = [('{"s":"a\\ud83db","t":"\\ud83d\\ude00","\\udc00":1}', {"s": '"a?b"', "t": '"😀"', "?": "1"}),
       ('{"a":1,"b":3,"a":{"c":2}}', {"a.c": "2", "b": "3"}),
       ('{"a":{"b":1},"a.b":2}', {"a.b": "2"}),
       ('{"x":' * 1500 + '"é"' + "}" * 1500, {".".join("x" * 1500): '"é"'}),
       ('{"l":' + "[" * 3000 + '{"k":[1,"a",null]}' + "]" * 3000 + ',"m":{}}', {"l": "[" * 3000 + '{"k":[1,"a",null]}' + "]" * 3000}),
       ('{"n":-' + "9" * 5000 + ',"f":1.50,"g":1e7,"s":"\\n"}', {"n": "-" + "9" * 5000, "f": "1.5", "g": "10000000.0", "s": '"\\n"'}),
       ('{"n":NaN,"i":-Infinity,"m":1}', {"n": "NaN", "i": "-Infinity", "m": "1"})]


@pytest.mark.parametrize("data,fields", ODD)
def test_answers_that_strict_readers_refuse(spark, data, fields):
    for tool, payload in (("submit_extraction", f'{{"data":{data}}}'), (None, f"```json\n{data}\n```")):
        good = ("g", "submit_extraction", '{"data":{"k":1}}')
        df = spark.createDataFrame([good, ("f", tool, payload)], "filing_id STRING, tool_name STRING, payload STRING")
        got = extract.answer_fields(extract.flatten_answers(df)).collect()
        assert {r["field_path"]: r["value_json"] for r in got if r["filing_id"] == "f"} == fields
        assert [r["value_json"] for r in got if r["filing_id"] == "g"] == ["1"]
        parts = extract.parse_answers(df).collect()
        assert all(r["data"] for r in parts) and not any(r["confidences"] for r in parts)


@pytest.mark.parametrize("text", ["{" * 2000, '{"a":' * 2000 + "1" + "}" * 1999, "[" * 2000 + "]" * 2000, '{"a":1,}' + " " * 9, '{"x":' * 1500 + "01" + "}" * 1500,
                                  '{"x":' * 1500 + "[1,]" + "}" * 1500, '{"x":' * 1500 + '{"a" 1}' + "}" * 1500, '{"x":' * 1500 + '"\n"' + "}" * 1500,
                                  '{"x":' * 1500 + "1" + "}" * 1500 + "x"])
def test_deep_texts_that_are_no_answers(spark, text):
    assert _flat(spark, text, None).count() == 0


def test_an_answer_is_read_once(spark):
    df = spark.createDataFrame([("f", "submit_extraction", '{"data":{"a":1}}')], "filing_id STRING, tool_name STRING, payload STRING")
    plan = extract.answer_fields(extract.flatten_answers(df)).filter("confidence > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_confidence_defaults_and_excerpt_cut(spark):
    payload = {"data": {"a": 1, "b": None, "c": 2, "d": 3, "e": 4}, "_confidence": {"a": "high", "c": 7, "d": " 0.25 ", "e": True},
               "_excerpts": {"a": "x" * 600}}
    got = {r["field_path"]: (r["confidence"], len(r["excerpt"])) for r in _flat(spark, json.dumps(payload)).collect()}
    assert got == {"a": (0.5, 500), "b": (0.0, 0), "c": (1.0, 0), "d": (0.25, 0), "e": (1.0, 0)}


def _fold(rows, delta=0.15):
    best = None
    for ord_, conf, value in sorted(rows):
        if value is None:
            continue
        conf = 0.5 if conf is None else conf
        if best is None or best[0] < 0 or conf - best[0] >= delta:
            best = (conf, value)
    return best


def test_section_merge_against_plain_fold(spark):
    rng = random.Random(7)
    levels = [None, -0.4, -0.1, 0.0, 0.1, 0.25, 0.3, 0.45, 0.5, 0.65, 0.8, 0.95, 1.0]
    rows = [(f"f{g}", "p", i, rng.choice(levels if g % 3 else levels[1:4]), rng.choice([None, "1", "2", "3", "4"]), "x")
            for g in range(120) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "filing_id STRING, field_path STRING, ord INT, confidence DOUBLE, value_json STRING, excerpt STRING")
    got = {r["filing_id"]: (r["confidence"], r["value_json"]) for r in extract.merge_sections(df).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        best = _fold([(r[2], r[3], r[4]) for r in rows if r[0] == g])
        if best:
            want[g] = best
    assert got == want


def test_merge_boundaries(spark):
    df = spark.createDataFrame([("a", "p", 1, 0.5, "1", "e1"), ("a", "p", 2, 0.65, "2", "e2"), ("b", "p", 1, 0.8, "1", "e1"),
                                ("b", "p", 2, 0.95, "2", "e2")],
                               "filing_id STRING, field_path STRING, ord INT, confidence DOUBLE, value_json STRING, excerpt STRING")
    got = {r["filing_id"]: (r["value_json"], r["excerpt"]) for r in extract.merge_sections(df).collect()}
    assert got == {"a": ("2", "e2"), "b": ("1", "e1")}        # 0.95 - 0.8 is just below 0.15 in doubles


def test_first_row_that_parses_wins(spark):
    rows = spark.createDataFrame([("f", 1, "Denomination", "N/A", "product.denomination"), ("f", 2, "Denomination", "$1,000", "product.denomination"),
                                  ("f", 3, "Denomination", "$5", "product.denomination")],
                                 "filing_id STRING, row_no INT, label_raw STRING, value_raw STRING, field_path STRING")
    got = extract.table_fields(rows, extract.parser_registry(spark)).first()
    assert (got["value_json"], got["excerpt"], got["confidence"]) == ("1000.0", "Denomination: $1,000", 0.97)


def test_coverage_and_enums(spark):
    filings = spark.createDataFrame([("f", "m"), ("g", "unknown"), ("h", None)], "filing_id STRING, model STRING")
    ready, rejected = extract.extractable(filings)
    assert rejected.count() == 2
    rules = spark.createDataFrame([("m", "a", ["x"]), ("m", "b", ["True", "1.5"]), ("m", "c", None), ("m", "d", ["True"])],
                                  "model STRING, field_path STRING, enum_values ARRAY<STRING>")
    values = spark.createDataFrame([("f", "a", '"y"', 0.9, "", "llm"), ("f", "b", "1.5", 0.9, "", "llm"), ("f", "z", "1", 0.9, "", "llm"),
                                    ("f", "d", "true", 0.9, "", "llm")],
                                   "filing_id STRING, field_path STRING, value_json STRING, confidence DOUBLE, excerpt STRING, source STRING")
    covered = extract.cover_all(ready, rules, values)
    got = {r["field_path"]: r for r in extract.check_enums(covered, ready, rules).collect()}
    assert set(got) == {"a", "b", "c", "d", "z"}
    assert got["a"]["validation_error"] == "Schema violation: 'y' is not a valid value. Allowed: ['x']"
    assert (got["a"]["confidence"], got["a"]["review_status"]) == (0.0, "schema_error")
    assert got["b"]["validation_error"] is None and got["d"]["validation_error"] is None and got["c"]["not_found"]
    summary = extract.extraction_summary(covered).first()
    assert (summary["field_count"], summary["fields_found"], summary["fields_null"]) == (5, 4, 1)


def test_unflatten_inverts_flatten(spark):
    nested = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}, "z": [1, 2]}, "aa": 'q"uote', "a.b": 1, "u[*]": {"n": "x"}}
    flat = {"a.b.c.d.e.f": "1", "a.z": "[1,2]", "aa": json.dumps('q"uote'), "u[*].n": '"x"', "gone": None}
    df = spark.createDataFrame([("f", k, v) for k, v in flat.items()], "filing_id STRING, field_path STRING, value_json STRING")
    models = spark.createDataFrame([("f", "m")], "filing_id STRING, model STRING")
    got = json.loads(export.unflatten(df, models).first()["nested_json"])
    nested.pop("a.b")
    assert got == {**nested, "model": "m"}


def test_missing_in_the_reviewers_sense(spark):
    cases = [(None, True), ("0", True), ("0.0", True), ("false", True), ('""', True), ("[]", True), ("{}", True), ('"0"', False),
             ("1", False), ("true", False), ('"x"', False)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i INT, v STRING")
    got = {r["i"]: r["m"] for r in df.select("i", export.is_missing(F.col("v")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_allowed_values_are_quoted_as_written(spark):
    rules = spark.createDataFrame([("m", "a", ["it's", 'q"', "b\\c"])], "model STRING, field_path STRING, enum_values ARRAY<STRING>")
    values = spark.createDataFrame([("f", "a", '"y"', 0.9, "", "llm")], "filing_id STRING, field_path STRING, value_json STRING, confidence DOUBLE, excerpt STRING, source STRING")
    filings = spark.createDataFrame([("f", "m")], "filing_id STRING, model STRING")
    got = extract.check_enums(values, filings, rules).first()["validation_error"]
    assert got == "Schema violation: 'y' is not a valid value. Allowed: " + repr(["it's", 'q"']).rstrip("]") + ", 'b\\c']"


def test_a_path_that_is_value_and_parent_fails_its_filing(spark):
    filings = spark.createDataFrame([(f, "approved", "m") for f in "fgh"], "filing_id STRING, status STRING, model STRING")
    runs = spark.createDataFrame([(f"{f}1", f, "m", "t") for f in "fg"], "extraction_id STRING, filing_id STRING, model STRING, extracted_at STRING")
    fields = spark.createDataFrame([("f1", "f", "a", "1"), ("f1", "f", "a.b", "2"), ("g1", "g", "a", "1"), ("g1", "g", "aa.b", "2"), ("g1", "g", "aa", None)],
                                   "extraction_id STRING, filing_id STRING, field_path STRING, value_json STRING")
    fields = fields.withColumns({"reviewed_json": F.lit(None).cast("string"), "review_status": F.lit("accepted")})
    rules = spark.createDataFrame([("m", "a", True)], "model STRING, field_path STRING, required BOOLEAN")
    exported, failed = export.batch_split(filings, runs, fields, rules)
    assert [r[0] for r in exported.collect()] == ["g"]
    assert {tuple(r) for r in failed.collect()} == {("f", "field path holds a value and other fields: a"), ("h", "No extraction results found")}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_parsed_once(spark):
    resolved = spark.createDataFrame([("f", 1, "CUSIP", "bad", "p"), ("f", 2, "CUSIP", "06749FWA3", "p"), ("f", 3, "CUSIP", "06749FWA4", "p"),
                                      ("f", 1, "CUSIP", "bad", "q"), ("g", None, "CUSIP", "06749FWA3", "p")],
                                     "filing_id STRING, row_no INT, label_raw STRING, value_raw STRING, field_path STRING")
    registry = spark.createDataFrame([("p", "cusip"), ("q", "cusip")], "field_path STRING, kind STRING")
    fields = extract.table_fields(resolved, registry)
    assert _plan(fields).count("isnull(kind") == 1
    got = {(r["filing_id"], r["field_path"]): r["value_json"] for r in fields.collect()}
    assert got == {("f", "p"): '"06749FWA3"', ("g", "p"): None}


@pytest.mark.parametrize("kind", ["INT", "DOUBLE"])
def test_section_merge_orders_rows_by_any_number(spark, kind):
    rows = [("f", "p", 1, -0.2, "a"), ("f", "p", 2, -0.1, "b"), ("f", "q", 1, -0.2, "a"), ("f", "q", 2, 0.5, "b"), ("f", "q", 3, 0.6, "c"), ("f", "q", 4, 0.5, "d")]
    df = spark.createDataFrame(rows, "filing_id STRING, field_path STRING, ord INT, confidence DOUBLE, value_json STRING").selectExpr(
        "filing_id", "field_path", f"CAST(ord AS {kind}) AS ord", "confidence", "value_json", "CAST(NULL AS STRING) AS excerpt")
    merged = extract.merge_sections(df)
    assert {r["field_path"]: r["value_json"] for r in merged.collect()} == {"p": "b", "q": "b"}
    assert ("max_by(" in _plan(merged)) == (kind == "DOUBLE")


def test_tiers_are_dealt_out_before_they_are_grouped(spark):
    field = "filing_id STRING, field_path STRING, value_json STRING, confidence DOUBLE, excerpt STRING, source STRING"
    one = lambda v: spark.createDataFrame([("f", "p", v, 1.0, "", "s")], field)          # noqa: E731
    for made in (extract.merge_tiers(one("1"), one("2"), one("3")), extract.tier_conflicts(one("1"), one("2"), one("3"))):
        assert "RepartitionByExpression [filing_id" in _plan(made)
    assert [r["value_json"] for r in extract.merge_tiers(one("1"), one("2"), one("3")).collect()] == ["2"]
    assert sorted((r["kept"], r["dropped"]) for r in extract.tier_conflicts(one("1"), one("2"), one("3")).collect()) == [("2", "1"), ("2", "3")]


def test_export_reads_a_value_once(spark):
    fields = spark.createDataFrame([("f", "r", "a.b", "1", None, None), ("f", "r", "a.c.d", "null", None, None), ("f", "r", "c", "x", None, "rejected"),
                                    ("g", "r", "a", "1", None, None), (None, "r", "a", "1", None, None)],
                                   "filing_id STRING, extraction_id STRING, field_path STRING, value_json STRING, reviewed_json STRING, review_status STRING")
    models = spark.createDataFrame([("f", "m"), ("h", None), (None, "n")], "filing_id STRING, model STRING")
    nested = export.unflatten(export.effective_values(fields), models)
    assert _plan(nested).count("parseJson") == 1
    assert {r["filing_id"]: r["nested_json"] for r in nested.collect()} == {"f": '{"a":{"b":1},"model":"m"}', None: '{"model":"n"}'}


def test_one_encoder_writes_a_batch():
    write, deep = answers._batch_writer(), None
    for _ in range(200_000):
        deep = [deep]
    for value in ("é\n\"", 1, 1.5, -5e-05, float("nan"), True, None, [], {}, [2.0, 1000.0], {"a": {"b": ["x"]}}, 10 ** 30, deep):
        assert write(value) == answers._write(value)
    with mock.patch.object(answers, "_dumps", side_effect=AssertionError("an encoder for every value")):
        assert answers.parts('{"data":{"a":[1]}}', True, "data", write)[3]([1]) == "[1]"


def test_described_paths_are_not_shuffled(spark):
    """A filing has many more described paths than values: they are made from its row, after it has met its values."""
    filings = spark.createDataFrame([(str(i), "m") for i in range(20)], "filing_id STRING, model STRING")
    rules = spark.createDataFrame([("m", f"p{i}", None) for i in range(50)], "model STRING, field_path STRING, enum_values ARRAY<STRING>")
    values = spark.createDataFrame([(str(i % 20), f"p{i % 60}", '"v"', 0.5, "e", "llm") for i in range(60)],
                                   "filing_id STRING, field_path STRING, value_json STRING, confidence DOUBLE, excerpt STRING, source STRING")
    covered = extract.cover_all(filings, rules, values)
    plan = covered._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan.split("Exchange hashpartitioning(filing_id")[0]
    assert covered.count() == 20 * 50 + 10 and covered.filter("NOT not_found").count() == 60


def test_coverage_of_filings_with_several_models_and_paths_without_name(spark):
    """Repeated filings count once with the paths of all their models; unnamed paths are paths; a filing without a model keeps what was found."""
    filings = spark.createDataFrame([("a", "m"), ("a", "n"), ("a", "m"), ("b", None), ("c", "x"), (None, "m")], "filing_id STRING, model STRING")
    rules = spark.createDataFrame([("m", "p", ["A"]), ("m", None, ["N"]), ("m", "q", None), ("n", "p", ["B"]), ("n", "r", ["A"]), ("n", "r", ["C"]), (None, "s", ["A"])],
                                  "model STRING, field_path STRING, enum_values ARRAY<STRING>")
    ddl = "filing_id STRING, field_path STRING, value_json STRING, confidence DOUBLE, excerpt STRING, source STRING"
    table = spark.createDataFrame([("a", "p", '"B"', 0.97, "t", "html_table"), ("b", "z", "1", 0.97, "t", "html_table"), ("d", "p", "1", 0.97, "t", "html_table")], ddl)
    registry = spark.createDataFrame([("a", "p", '"A"', 1.0, "r", "registry"), ("a", "r", '"B"', 1.0, "r", "registry")], ddl)
    answered = spark.createDataFrame([("a", None, '"x"', 0.6, "l", "llm"), ("c", "u", "2", None, None, "llm")], ddl).drop("source")
    covered = extract.covered_fields(filings, rules, registry, table, answered)
    got = {(r["filing_id"], r["field_path"]): (r["value_json"], r["source"], r["not_found"], r["enum_values"]) for r in covered.collect()}
    assert got == {("a", "p"): ('"B"', "html_table", False, ["B"]), ("a", "q"): (None, "llm", True, None), ("a", "r"): ('"B"', "registry", False, ["C"]),
                   ("a", None): ('"x"', "llm", False, ["N"]), ("b", "z"): ("1", "html_table", False, None), ("c", "u"): ("2", "llm", False, None)}
    checked = {(r["filing_id"], r["field_path"]): (r["review_status"], r["confidence"]) for r in extract.complete_fields(filings, rules, registry, table, answered).collect()}
    assert checked == {("a", "p"): ("pending", 0.97), ("a", "q"): ("pending", 0.0), ("a", "r"): ("schema_error", 0.0), ("a", None): ("schema_error", 0.0),
                       ("b", "z"): ("pending", 0.97), ("c", "u"): ("pending", 0.0)}
