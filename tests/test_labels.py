"""Label layers, issuer match and miss log."""

from pyspark.sql import functions as F

from termsheet.operators import labels


def test_layers_and_issuer_override(spark):
    table = labels.label_table(spark, [("Maturity Date", "user.path")], [("UBS AG", "maturity date:", "issuer.path")])
    pairs = spark.createDataFrame([("UBS AG", "MATURITY DATE *"), (None, "Maturity Date(1)"), ("UBS AG", "Trade Date"),
                                   ("UBS AG", "No Such")], "issuer_key STRING, label_raw STRING")
    got = {(r["issuer_key"], r["label_raw"]): r["field_path"] for r in labels.resolve(pairs, labels.merge_layers(table)).collect()}
    assert got == {("UBS AG", "MATURITY DATE *"): "issuer.path", (None, "Maturity Date(1)"): "user.path",
                   ("UBS AG", "Trade Date"): "structuredProductsGeneric.tradeDate", ("UBS AG", "No Such"): None}


def test_issuer_match_is_bidirectional_and_ordered(one):
    assert one(labels.issuer_match, "Citigroup Global Markets") == "Citigroup Inc"
    assert one(labels.issuer_match, "citi") == "Citigroup Inc"
    assert one(labels.issuer_match, "JPMorgan Chase & Co") == "JPMorgan Chase & Co"
    assert one(labels.issuer_match, "Nobody") is None
    assert one(labels.issuer_match, "") is None
    assert one(labels.issuer_match, None) is None


def test_miss_log_keeps_dismissed_and_first_sample(spark):
    log = spark.createDataFrame([("a", "A", "", "i0", "f0", 2, "t0", "t0", True)],
                                "label_norm STRING, label_raw STRING, sample_value STRING, issuer_name STRING, filing_id STRING, "
                                "occurrences BIGINT, first_seen_at STRING, last_seen_at STRING, dismissed BOOLEAN")
    misses = spark.createDataFrame([("f1", "a", "A:", "", "i1", "t1"), ("f2", "a", "a", "s2", "i2", "t2"), ("f3", "b", "B", "s3", None, "t3")],
                                   "filing_id STRING, label_norm STRING, label_raw STRING, sample_value STRING, issuer_name STRING, seen_at STRING")
    got = {r["label_norm"]: r.asDict() for r in labels.upsert_misses(log, misses).collect()}
    assert got["a"] == {"label_norm": "a", "label_raw": "A", "sample_value": "s2", "issuer_name": "i2", "filing_id": "f2",
                        "occurrences": 4, "first_seen_at": "t0", "last_seen_at": "t2", "dismissed": True}
    assert got["b"]["occurrences"] == 1 and got["b"]["dismissed"] is False and got["b"]["issuer_name"] is None


def test_user_label_edits_in_order(spark):
    current = spark.createDataFrame([("Old One", "p0")], "label_raw STRING, field_path STRING")
    edits = spark.createDataFrame([(1, "add", "New", "p1"), (2, "remove", "new", None), (3, "add", "NEW ", "p3"), (4, "remove", "old one", ""),
                                   (5, "add", " ", "p"), (6, "add", "x", " ")], "seq INT, action STRING, label_raw STRING, field_path STRING")
    kept, rejected = labels.edit_user_labels(current, edits)
    assert [tuple(r) for r in kept.collect()] == [("NEW", "new", "p3")]
    assert sorted(r["seq"] for r in rejected.collect()) == [5, 6]


def test_hint_update_keeps_what_is_not_given(spark):
    hints = spark.createDataFrame([("a", "x", "y")], "field_path STRING, label STRING, format STRING")
    updates = spark.createDataFrame([("a", None, "z"), ("b", "n", None)], "field_path STRING, label STRING, format STRING")
    got = sorted(tuple(r) for r in labels.update_hints(hints, updates, ["field_path"]).collect())
    assert got == [("a", "x", "z"), ("b", "n", None)]
    assert labels.issuer_match(F.lit("x")) is not None
