"""Filing actions, reviews, ordered lookups, logs."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from termsheet.functions.ordered import previous_known
from termsheet.operators import classify, logs, schemas, workflow
from termsheet.streaming import jobs


def _act(spark, status, action, model="", confidence=0.9, present="index"):
    filings = spark.createDataFrame([("f", status, present, confidence)], "filing_id STRING, status STRING, model STRING, confidence DOUBLE")
    actions = spark.createDataFrame([("f", 1, action, model)], "filing_id STRING, seq BIGINT, action STRING, model STRING")
    moved, outcomes = workflow.apply_actions(filings, actions)
    row = moved.first()
    return row["status"], row["model"], row["confidence"], outcomes.first()["reason"]


@pytest.mark.parametrize("args,want", [
    (("needs_classification_review", "confirm"), ("classified", "index", 1.0, None)),
    (("needs_classification_review", "confirm", "nope"), ("needs_classification_review", "index", 0.9, "unknown model nope")),
    (("classified", "confirm"), ("classified", "index", 0.9, "not allowed from classified")),
    (("extracted", "override", "any"), ("extracted", "any", 1.0, None)),
    (("approved", "override", "any"), ("approved", "index", 0.9, "not allowed from approved")),
    (("classified", "reset"), ("ingested", None, None, None)),
    (("classified", "extract", "", 0.80), ("extracting", "index", 0.80, None)),
    (("classified", "extract", "", 0.79), ("classified", "index", 0.79, "classification confidence is below the gate")),
    (("extracted", "extract", "", 0.1), ("extracting", "index", 0.1, None)),
    (("extracting", "extract"), ("extracting", "index", 0.9, "extraction already in progress")),
    (("ingested", "extract"), ("ingested", "index", 0.9, "not allowed from ingested")),
    (("approved", "reextract", "", 0.5), ("classified", "index", 0.5, "classification confidence is below the gate")),
    (("needs_review", "approve"), ("approved", "index", 0.9, None)),
    (("approved", "unapprove"), ("extracted", "index", 0.9, None)),
    (("extracted", "export"), ("extracted", "index", 0.9, "not allowed from extracted"))])
def test_action_rules(spark, args, want):
    assert _act(spark, *args) == want


def test_blocks_give_the_same_result(spark):
    rng = random.Random(5)
    names = ["confirm", "override", "reset", "extract", "finish", "approve", "unapprove", "export", "reextract", "fail", None]
    start = [("classified", "index", 0.9), ("needs_classification_review", "odd", 0.3), ("odd", None, None), (None, "index", 0.9), ("extracting", "index", 0.8)]
    filings = spark.createDataFrame([(str(i), *s) for i, s in enumerate(start)], "filing_id STRING, status STRING, model STRING, confidence DOUBLE")
    acts = [(str(rng.choice([0, 0, 1, 2, 3, 4, 9])), i, rng.choice(names), rng.choice(["", "index", "bad", None])) for i in range(400)]
    actions = spark.createDataFrame(acts, "filing_id STRING, seq BIGINT, action STRING, model STRING")
    whole, blocks = workflow.apply_actions(filings, actions), workflow.apply_actions(filings, actions, block=3, stretch=50)
    for a, b in zip(whole, blocks):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def test_many_actions_of_one_filing(spark):
    """A third of a million actions: more blocks than one level of the scan holds."""
    size = 333_000
    filings = spark.createDataFrame([("f", "classified", "index", 0.9)], "filing_id STRING, status STRING, model STRING, confidence DOUBLE")
    names = F.array(*map(F.lit, ["extract", "finish", "approve", "unapprove", "extract", "fail", "override"]))
    actions = spark.range(size).select(F.lit("f").alias("filing_id"), F.col("id").alias("seq"),
                                       F.get(names, (F.col("id") % 7).cast("int")).alias("action"), F.lit("index").alias("model"))
    moved, outcomes = workflow.apply_actions(filings, actions, fan=16)
    assert outcomes.filter("reason IS NULL").count() == size
    assert moved.first()["status"] == ["extracting", "extracted", "approved", "extracted", "extracting", "classified", "classified"][(size - 1) % 7]


def _random_actions(spark, n=400):
    rng = random.Random(5)
    names = ["confirm", "override", "reset", "extract", "finish", "approve", "unapprove", "export", "reextract", "fail", "odd", None]
    start = [("classified", "index", 0.9), ("needs_classification_review", "odd", 0.3), ("odd", None, None), (None, "index", 0.9), ("extracting", "index", 0.8)]
    filings = spark.createDataFrame([(str(i), *s) for i, s in enumerate(start)], "filing_id STRING, status STRING, model STRING, confidence DOUBLE")
    acts = [(str(rng.choice([0, 0, 1, 2, 3, 4, 9])), i, rng.choice(names), rng.choice(["", "index", "unknown", "bad", None])) for i in range(n)]
    return filings, spark.createDataFrame(acts, "filing_id STRING, seq BIGINT, action STRING, model STRING")


@pytest.mark.parametrize("block,stretch,fan", [(1, 7, 2), (3, 50, 2), (2, 400, 5)])
def test_levels_of_blocks_give_the_same_result(spark, block, stretch, fan):
    filings, actions = _random_actions(spark)
    for a, b in zip(workflow.apply_actions(filings, actions), workflow.apply_actions(filings, actions, block=block, stretch=stretch, fan=fan), strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def test_blocks_are_dealt_out_by_number(spark):
    """Actions on a few neighbouring filings of many: their replay is not left to the task that reads these filings."""
    filings = spark.range(4000).coalesce(1).selectExpr("cast(id AS string) AS filing_id", "'classified' AS status", "'index' AS model", "0.9D AS confidence")
    actions = spark.range(4000).selectExpr("cast(id % 40 AS string) AS filing_id", "id AS seq", "'override' AS action", "'m' AS model")
    _, outcomes = workflow.apply_actions(filings, actions)
    assert outcomes.select("seq", F.spark_partition_id().alias("p")).groupBy("p").count().filter("count > 0").count() > 4


def test_long_blocks_of_several_filings_replay_alike(spark):
    """Blocks of many actions end as the whole does, with the model and confidence that each start keeps."""
    filings, actions = _random_actions(spark, 600)
    for a, b in zip(workflow.apply_actions(filings, actions), workflow.apply_actions(filings, actions, block=45, fan=2), strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def test_tables_of_blocks_take_little_disk(spark, tmp_path, monkeypatch):
    """A table has 54 starts; what is kept of it and of the actions is a few hundred bytes a block, not thousands."""
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    filings = spark.createDataFrame([(str(i), "classified", "index", 0.9) for i in range(300)], "filing_id STRING, status STRING, model STRING, confidence DOUBLE")
    names = F.array(*map(F.lit, ["extract", "finish", "override", "approve", "confirm", "reset", "reextract"]))
    actions = spark.range(9000).select((F.col("id") % 300).cast("string").alias("filing_id"), F.col("id").alias("seq"),
                                       F.get(names, (F.hash("id") % 7 + 6).cast("int") % 7).alias("action"), F.concat(F.lit("model "), F.col("id") % 11).alias("model"))
    moved, _ = workflow.apply_actions(filings, actions, block=3)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < 3000 * 400
    whole, _ = workflow.apply_actions(filings, actions)
    assert sorted(map(tuple, moved.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_a_table_names_no_more_models_than_it_has_starts(spark):
    """Long blocks that give many models keep those that some start ends with."""
    filings, _ = _random_actions(spark)
    names = F.array(*map(F.lit, ["override", "extract", "finish", "approve", "unapprove", "reset", "confirm"]))
    actions = spark.range(900).select((F.col("id") % 5).cast("string").alias("filing_id"), F.col("id").alias("seq"),
                                      F.get(names, F.abs(F.hash("id")) % 7).alias("action"), F.concat(F.lit("given "), "id").alias("model"))
    for a, b in zip(workflow.apply_actions(filings, actions), workflow.apply_actions(filings, actions, block=80, fan=2), strict=True):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def test_rules_as_a_table_decide_like_the_batch(spark):
    filings, actions = _random_actions(spark, 300)
    _, outcomes = workflow.apply_actions(filings, actions)
    want = {(r["filing_id"], r["seq"]): (r["reason"], r["new_status"], r["new_model"]) for r in outcomes.collect()}
    rules, states = workflow.Rules(spark), {r["filing_id"]: tuple(r)[1:] for r in filings.collect()}
    for r in sorted(actions.collect(), key=lambda r: r["seq"]):
        if r["filing_id"] in states:
            reason, states[r["filing_id"]] = rules(states[r["filing_id"]], r["action"], r["model"])
            assert (reason, *states[r["filing_id"]][:2]) == want[r["filing_id"], r["seq"]]


def test_a_stream_of_actions_goes_on_after_a_restart(spark, tmp_path):
    """Stopped in mid-stream, with batches of one file: every action once, and the states of the batch."""
    filings, actions = _random_actions(spark, 120)
    for k in range(4):
        actions.filter(f"seq BETWEEN {k * 30} AND {k * 30 + 29}").coalesce(1).write.mode("append").parquet(str(tmp_path / "actions"))
        if k in (1, 3):
            stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "actions"))
            run = (jobs.action_outcomes(stream, filings).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
                   .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
            run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    moved, outcomes = workflow.apply_actions(filings, actions)
    assert sorted(map(tuple, got.select(outcomes.columns).collect()), key=str) == sorted(map(tuple, outcomes.collect()), key=str)
    states = jobs.latest_states(filings, got)
    assert sorted(map(tuple, states.collect()), key=str) == sorted(map(tuple, moved.collect()), key=str)


@pytest.mark.parametrize("status,action,reason", [
    (None, "approve", "filing has no status"), (None, None, "filing has no status"), ("extracted", None, "no such action null")])
def test_nulls_are_not_accepted(spark, status, action, reason):
    assert _act(spark, status, action) == (status, "index", 0.9, reason)


def test_previous_known_across_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k STRING, n BIGINT, v BIGINT")
    got = {(r["k"], r["n"]): r["before"] for r in previous_known(df, ["k"], "n", F.col("v"), "before", block=7).collect()}
    last = {}
    for k, n, v in rows:
        assert got[k, n] == last.get(k)
        if v is not None:
            last[k] = v
    assert len(got) == 400


def test_log_folding(spark):
    lines = ["orphan", "2026-03-21 09:00:27,546  ERROR     main  boom", "  File x", "", "2026-03-21 09:00:28,000 INFO a.b  ok done", "2026-03-21 09:00 bad"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file STRING, line_no BIGINT, line STRING")
    got = [(r["line_no"], r["level"], r["name"], r["message"]) for r in logs.parse_log(df, block=2).orderBy("line_no").collect()]
    assert got == [(1, "ERROR", "main", "boom\n  File x\n"), (4, "INFO", "a.b", "ok done\n2026-03-21 09:00 bad")]


def test_field_reviews_and_audit(spark):
    fields = spark.createDataFrame([("x", "f", "p", '"v"', None, "pending", "t0"), ("y", "f", "q", '"v"', None, "accepted", "t0")],
                                   "field_id STRING, filing_id STRING, field_path STRING, value_json STRING, reviewed_json STRING, review_status STRING, reviewed_at STRING")
    reviews = spark.createDataFrame([("f", "x", 1, "corrected", '"a"', "t1"), ("f", "x", 2, "accepted", None, "t2"), ("g", "x", 3, "accepted", None, "t3"),
                                     ("f", "x", 4, "maybe", None, "t4"), ("f", "x", 5, None, '"z"', "t5"), (None, "x", 6, "accepted", None, "t6")],
                                    "filing_id STRING, field_id STRING, seq BIGINT, review_status STRING, reviewed_json STRING, reviewed_at STRING")
    updated, audit, rejected = workflow.review_fields(fields, reviews)
    got = [tuple(r) for r in updated.orderBy("field_id").select("reviewed_json", "review_status", "reviewed_at").collect()]
    assert got == [('"v"', "accepted", "t2"), (None, "accepted", "t0")]
    assert [(r["old_value"], r["new_value"], r["action"]) for r in audit.orderBy("seq").collect()] == [(None, '"a"', "corrected"), ('"a"', '"v"', "accepted")]
    assert sorted(r["seq"] for r in rejected.collect()) == [3, 4, 5, 6]


@pytest.mark.parametrize("payload,want", [
    ('{"payout_type_id":"index","confidence_score":0.6}', ("index", 0.6)), ('{"payout_type_id":"index","confidence_score":0.59}', ("unknown", 0.59)),
    ('{"payout_type_id":"nope","confidence_score":0.9}', ("unknown", 0.9)), ('{"payout_type_id":"index","confidence_score":5}', ("index", 1.0)),
    ("oops", ("unknown", 0.0)), ("[1]", ("unknown", 0.0)), ('```json\n{"payout_type_id":"index","confidence_score":"0.8"}\n```', ("index", 0.8))])
def test_classification_answers(spark, payload, want):
    row = classify.validate_answers(spark.createDataFrame([("f", 1, payload)], "filing_id STRING, stage INT, payload STRING"), ["index"]).first()
    assert (row["model"], row["confidence"]) == want


def test_gate_and_stage_boundaries(spark):
    rows = spark.createDataFrame([("a", "index", 0.80), ("b", "index", 0.75), ("c", "unknown", 0.99)], "filing_id STRING, model STRING, confidence DOUBLE")
    got = {r["filing_id"]: (r["status"], r["low_confidence"]) for r in classify.gate(rows).collect()}
    assert got == {"a": ("classified", False), "b": ("needs_classification_review", False), "c": ("needs_review", False)}
    final, again = classify.escalate(rows.withColumn("targeted", F.lit("x")))
    assert again.count() == 0 and final.count() == 3


def test_greedy_renames(spark):
    ddl = "model STRING, field_path STRING, data_type STRING, description STRING, required BOOLEAN, enum_values ARRAY<STRING>"
    old = spark.createDataFrame([("m", "a.level", "number", "barrier level", False, []), ("m", "b.level", "number", "barrier level", False, [])], ddl)
    new = spark.createDataFrame([("m", "x.level", "number", "barrier level of note", False, []), ("m", "y.other", "string", "barrier level", False, []),
                                 ("m", "z.tier", "number", "", False, [])], ddl)
    got = [tuple(r) for r in schemas.rename_suggestions(old, new).collect()]
    assert got == [("m", "a.level", "x.level", 0.75)]


def test_schema_pointers_chains_and_circles(spark):
    chain = ",".join(f'"c{i}":{{"$ref":"#/$defs/c{i + 1}"}}' for i in range(30))
    text = ('{"$defs":{' + chain + ',"c30":{"type":"number"},"A":{"properties":{"q":{"type":"integer"}}},"loop":{"$ref":"#/$defs/loop"},'
            '"tree":{"type":"object","properties":{"v":{"type":"string"},"sub":{"$ref":"#/$defs/tree"}}}},"oneOf":[{"properties":{"model":{"const":"m"},'
            '"far":{"$ref":"#/$defs/c0"},"inner":{"$ref":"#/$defs/A/properties/q"},"gone":{"$ref":"#/$defs/none"},"me":{"$ref":"#/$defs/loop"},'
            '"t":{"$ref":"#/$defs/tree"}}}]}')
    docs = schemas.documents(spark.createDataFrame([("d", text)], "doc_id STRING, json STRING"))
    kinds = {"far": "number", "inner": "integer"}
    got = {r["field_path"]: r["data_type"] for r in schemas.descriptors(docs).collect()}
    assert {p: got[p] for p in kinds} == kinds and got["gone"] == "string" and got["t.v"] == "string"
    got = {r["field_path"]: r["data_type"] for r in schemas.diff_fields(docs).collect()}
    assert got == {**kinds, "gone": "any", "me": "any", "t.v": "string", "t.sub": "object"}
