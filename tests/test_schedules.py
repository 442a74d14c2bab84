"""Coupon schedules, profile scores, stored tables, excerpts, breakdowns."""

import datetime
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termsheet import config
from termsheet.functions.excerpts import Searched, anchor_excerpts
from termsheet.operators import documents, labels, logs, quality, schedules, usage
from termsheet.plans import catalog
from termsheet.sources.versioned import MergedTable

D = datetime.date
DDL = "schedule_id INT, start_date DATE, end_date DATE, frequency STRING, day_count STRING, roll STRING, calendar STRING, end_of_month BOOLEAN"


def _schedule(spark, *rows, holidays=()):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DDL)
    free = spark.createDataFrame(list(holidays), "calendar STRING, holiday DATE")
    return schedules.coupon_schedule(table, free, config.SCHEDULE_FREQUENCIES, config.SCHEDULE_SPELLINGS)


def test_grids_are_counted_from_the_start(spark):
    rows = _schedule(spark, (D(2023, 10, 31), D(2024, 4, 30), "monthly", "ACT/360", None, None, None),
                     (D(2024, 2, 29), D(2024, 8, 31), "Quarterly", "30/360", None, None, True),
                     (D(2024, 2, 29), D(2024, 9, 10), "quarterly", "30/360", None, None, False),
                     (D(2024, 1, 30), D(2024, 1, 30), "monthly", None, None, None, None), (D(2024, 1, 30), None, "monthly", None, None, None, None),
                     (D(2024, 1, 1), D(2024, 1, 15), "weekly", "odd", "odd", "", None)).orderBy("schedule_id", "period_no").collect()
    ends = {i: [r["period_end"] for r in rows if r["schedule_id"] == i] for i in range(6)}
    assert ends[0] == [D(2023, 11, 30), D(2023, 12, 31), D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]
    assert ends[1] == [D(2024, 5, 31), D(2024, 8, 31)]
    assert ends[2] == [D(2024, 5, 29), D(2024, 8, 29), D(2024, 9, 10)]       # a short last period
    assert ends[3] == ends[4] == [] and ends[5] == [D(2024, 1, 8), D(2024, 1, 15)]
    assert all(r["period_start"] < r["period_end"] and r["payment_date"] == r["period_end"] for r in rows)
    assert {r["coupon_factor"] for r in rows if r["schedule_id"] == 5} == {None}


@pytest.mark.parametrize("roll,paid", [("following", D(2024, 4, 2)), ("Modified  Following", D(2024, 3, 28)), ("preceding", D(2024, 3, 28)),
                                       ("unadjusted", D(2024, 3, 31)), (None, D(2024, 3, 31))])
def test_rolls_over_a_long_weekend_at_a_month_end(spark, roll, paid):
    """Easter 2024: Good Friday on the 29th of March, Easter Monday on the 1st of April."""
    easter = [("LON", D(2024, 3, 29)), ("LON", D(2024, 4, 1)), ("LON", D(2024, 4, 1)), ("NYC", D(2024, 4, 2))]
    row = _schedule(spark, (D(2023, 12, 31), D(2024, 3, 31), "quarterly", "act/365", roll, "LON", None), holidays=easter).collect()
    assert [r["payment_date"] for r in row] == [paid]


@pytest.mark.parametrize("basis,start,end,days,factor", [
    ("Actual/360", D(2024, 1, 31), D(2024, 2, 29), 29, 29 / 360), ("act/365", D(2023, 2, 28), D(2024, 2, 29), 366, 366 / 365),
    ("30/360", D(2024, 1, 31), D(2024, 3, 31), 60, 60 / 360), ("30/360", D(2024, 1, 15), D(2024, 3, 31), 76, 76 / 360), ("30/360", D(2024, 2, 29), D(2024, 3, 31), 32, 32 / 360),
    ("Actual/Actual", D(2023, 7, 1), D(2024, 7, 1), 366, 184 / 365 + 182 / 366), ("act/act", D(1900, 2, 1), D(1900, 3, 1), 28, 28 / 365)])
def test_day_counts(spark, basis, start, end, days, factor):
    row = spark.createDataFrame([(start, end)], "s DATE, e DATE").select(
        schedules.accrual_days(F.col("s"), F.col("e"), schedules.coded(F.lit(basis), config.SCHEDULE_SPELLINGS)).alias("d"),
        schedules.year_fraction(F.col("s"), F.col("e"), schedules.coded(F.lit(basis), config.SCHEDULE_SPELLINGS)).alias("f")).first()
    assert row["d"] == days and row["f"] == pytest.approx(factor, abs=1e-9)


def test_mismatches_are_named(spark):
    made = _schedule(spark, (D(2024, 1, 1), D(2024, 6, 30), "quarterly", "30/360", "following", None, None),
                     (D(2024, 1, 1), D(2024, 6, 30), "quarterly", "30/360", "following", None, None))
    said = spark.createDataFrame([(0, D(2024, 4, 1)), (0, D(2024, 4, 1)), (0, D(2024, 6, 30)), (0, D(2024, 5, 5)), (0, None), (9, D(2024, 1, 1))], "schedule_id INT, stated_date DATE")
    got = {tuple(r) for r in schedules.schedule_mismatches(made, said).collect()}
    assert got == {(0, D(2024, 6, 30), "unrolled"), (0, D(2024, 7, 1), "missing"), (0, D(2024, 5, 5), "unexpected"), (9, D(2024, 1, 1), "unexpected")}


def test_profile_scores_and_bands(spark):
    profiles = spark.createDataFrame([
        ("auto", "required", "CALL", "AUTO", 0.5), ("auto", "required", "CALL", "STEP", 0.5), ("auto", "typical", "MEMORY", "true", 0.2),
        ("auto", "counter", "FLOOR", "true", 0.3), ("plain", "required", "COUPON", "true", 0.3), ("free", "typical", "MEMORY", "true", 0.1)],
        "model STRING, kind STRING, feature STRING, value STRING, weight DOUBLE")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id STRING")
    features = spark.createDataFrame([("a", "CALL", "STEP"), ("a", "COUPON", "false"), ("a", "MEMORY", "true"), ("b", "MEMORY", "true"), ("b", "FLOOR", "true"), ("b", "ODD", "1")],
                                     "item_id STRING, feature STRING, value STRING")
    scores = quality.profile_scores(items, features, profiles)
    got = {(r["item_id"], r["model"]): (r["score"], r["rank"]) for r in scores.collect()}
    assert got == {("a", "auto"): (1.0, 1), ("a", "free"): (1.0, 2), ("a", "plain"): (0.7, 3), ("b", "auto"): (0.4, 3), ("b", "free"): (1.0, 1), ("b", "plain"): (0.7, 2),
                   ("c", "auto"): (0.5, 3), ("c", "free"): (1.0, 1), ("c", "plain"): (0.7, 2)}
    strict = quality.profile_bands(scores.filter("model <> 'free'").withColumn("rank", F.when(F.col("model") == "plain", F.when(F.col("item_id") == "a", 2).otherwise(1)).otherwise(
        F.when(F.col("item_id") == "a", 1).otherwise(2))))
    assert {r["item_id"]: (r["model"], r["lead"], r["band"]) for r in strict.collect()} == {
        "a": ("auto", 0.3, "classified"), "b": ("plain", 0.3, "needs_classification_review"), "c": ("plain", 0.2, "needs_classification_review")}


# ---- stored tables

def _files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("data/**/*.parquet")}


def test_batches_rewrite_touched_buckets_once(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path), "k", "k BIGINT, n BIGINT", 8).create()
    add = lambda old, new: old.join(new.withColumnRenamed("n", "m"), "k", "full_outer").selectExpr("k", "coalesce(n, 0) + coalesce(m, 0) AS n")
    rows = lambda: {r["k"]: r["n"] for r in table.read().collect()}
    assert rows() == {}
    first = spark.createDataFrame([(i, 1) for i in range(100)], "k BIGINT, n BIGINT")
    assert table.merge(0, first, add) and rows() == dict.fromkeys(range(100), 1)
    before = _files(tmp_path)
    second = spark.createDataFrame([(5, 10)], "k BIGINT, n BIGINT")
    assert table.merge(3, second, add) and rows()[5] == 11 and sum(rows().values()) == 110
    assert before < _files(tmp_path) and len({f.split("/")[2] for f in _files(tmp_path) - before}) == 1
    assert not table.merge(3, second, add) and not table.merge(1, second, add) and rows()[5] == 11     # delivered again
    assert table.merge(4, first.limit(0), add) and sum(rows().values()) == 110
    drop = lambda old, new: old.join(new, "k", "left_anti")
    assert table.merge(5, first.select("k"), drop) and rows() == {}


def test_a_run_that_ends_half_way_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = MergedTable(spark, str(tmp_path), "k", "k BIGINT, n BIGINT", 4).create()
    rows = spark.createDataFrame([(i, i) for i in range(20)], "k BIGINT, n BIGINT")
    table.merge(0, rows, lambda old, new: new)
    commit = table._commit
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(1, rows, lambda old, new: old.withColumn("n", F.col("n") + 100))
    assert sum(r["n"] for r in table.read().collect()) == 190                  # written, but not committed
    monkeypatch.setattr(table, "_commit", commit)
    assert table.merge(1, rows, lambda old, new: old.withColumn("n", F.col("n") + 1))
    assert sum(r["n"] for r in table.read().collect()) == 210
    with pytest.raises(Exception, match="(?i)already exists"):
        table._commit(2, 9, {0: 0})                                            # another writer's version


def test_miss_log_in_batches_equals_one_log(spark, tmp_path):
    rng = random.Random(3)
    misses = [(f"label {rng.randrange(9)}", f"Label {i}", rng.choice(["", "v"]), f"i{i % 3}", f"f{i:03}", f"2026-01-{i % 28 + 1:02}") for i in range(60)]
    ddl = "label_norm STRING, label_raw STRING, sample_value STRING, issuer_name STRING, filing_id STRING, seen_at STRING"
    log = spark.createDataFrame([], "label_norm STRING, label_raw STRING, sample_value STRING, issuer_name STRING, filing_id STRING, occurrences BIGINT, first_seen_at STRING, last_seen_at STRING, dismissed BOOLEAN")
    stored = MergedTable(spark, str(tmp_path), "label_norm", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema), 4).create()
    for batch in range(3):
        part = spark.createDataFrame(misses[batch * 20:batch * 20 + 20], ddl)
        stored.merge(batch, part, labels.upsert_misses)
        stored.merge(batch, part, labels.upsert_misses)
        log = spark.createDataFrame(labels.upsert_misses(log, part).collect(), log.schema)
    assert sorted(map(tuple, stored.read().collect())) == sorted(map(tuple, log.collect()))


# ---- excerpts

def test_many_excerpts_are_found_like_single_ones(spark):
    rng = random.Random(8)
    blanks = [" ", "  ", "\n", " \t ", " "]
    rows = []
    for _ in range(12):
        text = "".join(rng.choice(["alpha", "beta", "gam.ma", "(delta)", "é"]) + rng.choice(blanks) for _ in range(120))
        cuts = [text[a:a + rng.randrange(3, 130)] for a in (rng.randrange(300) for _ in range(20))]
        cuts += [re.sub(r"\s+", rng.choice(blanks), c) for c in cuts[:10]] + [c + " and then something else entirely" for c in cuts[:5]] + ["nowhere at all in the text", "", None]
        rows.append((text, cuts))
    df = spark.createDataFrame(rows, "text STRING, excerpts ARRAY<STRING>")
    many = df.select(anchor_excerpts(F.col("text"), F.col("excerpts")).alias("a"), anchor_excerpts(F.col("text"), F.col("excerpts"), loose=True).alias("b")).collect()
    one = df.select(F.transform("excerpts", lambda e: documents.anchor_excerpt(F.col("text"), e)).alias("a"),
                    F.transform("excerpts", lambda e: documents.anchor_excerpt_loose(F.col("text"), e)).alias("b")).collect()
    assert sorted(map(str, many)) == sorted(map(str, one))
    assert Searched("a b").exact("x") is None


def test_texts_of_many_excerpts_do_not_move(spark):
    df = spark.createDataFrame([(1, None, ["x"]), (2, "text", None)], "doc_id INT, text STRING, excerpts ARRAY<STRING>")
    found = df.select("doc_id", anchor_excerpts(F.col("text"), F.col("excerpts")).alias("a"))
    assert {r["doc_id"]: r["a"] for r in found.collect()} == {1: [None], 2: []}
    assert "Exchange" not in catalog.QUERIES["h9_excerpts_of_document"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


# ---- breakdowns, logs

def test_breakdowns_read_and_shuffle_the_calls_once(spark):
    plan = catalog.QUERIES["u6_u7_u8_breakdowns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet .*l_", plan)) == 1
    calls = plan[:plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "Expand" in plan and len(re.findall(r"Exchange hashpartitioning\((?!dimension)", calls)) <= 2


def test_breakdowns_equal_the_single_reports(spark):
    both = {name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect() for name in ("u6_u7_u8_breakdowns", "u6_by_step", "u7_by_model", "u8_by_issuer")}
    rows = both["u6_u7_u8_breakdowns"]
    of = lambda d, *c: sorted(tuple(r[x] for x in c) for r in rows if r["dimension"] == d)
    same = ("label", "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost_usd", "cache_savings_usd", "pct_of_total", "avg_cost_per_call")
    assert of("step", "key", *same) == sorted(tuple(r[x] for x in ("call_type", *same)) for r in both["u6_by_step"])
    assert of("model", "key", "calls", "cost_usd") == sorted((r["model"], r["calls"], r["cost_usd"]) for r in both["u7_by_model"])
    assert of("issuer", "key", "calls", "cost_usd") == sorted((r["issuer_name"], r["calls"], r["cost_usd"]) for r in both["u8_by_issuer"])
    assert json.dumps(rows[0].asDict()) and usage.breakdowns


def test_long_log_entries_go_on_in_further_rows(spark):
    lines = ["2026-03-21 09:00:27,546 ERROR main boom"] + [f"  line {i}" for i in range(10)] + ["2026-03-21 09:00:28,000 INFO a.b ok"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file STRING, line_no BIGINT, line STRING")
    got = [tuple(r) for r in logs.parse_log(df, block=3, part_lines=4).orderBy("line_no", "part").select("line_no", "part", "level", "message").collect()]
    assert [g[:3] for g in got] == [(0, 0, "ERROR"), (0, 1, "ERROR"), (0, 2, "ERROR"), (11, 0, "INFO")]
    whole = {r["line_no"]: r["message"] for r in logs.parse_log(df).collect()}
    assert "\n".join(g[3] for g in got[:3]) == whole[0] and got[3][3] == whole[11]


def test_the_grid_is_not_held_in_memory(spark):
    """The planner does not count what a schedule's dates come to; the side kept in memory is that of the calendars' days."""
    rows = spark.range(100).selectExpr("id AS schedule_id", "date '2020-01-01' AS start_date", "date '2021-01-01' AS end_date", "'daily' AS frequency",
                                       "'act/360' AS day_count", "'following' AS roll", "'NYC' AS calendar")
    free = spark.sql("SELECT 'NYC' AS calendar, date '2020-07-03' AS holiday")
    made = schedules.coupon_schedule(rows, free, config.SCHEDULE_FREQUENCIES, config.SCHEDULE_SPELLINGS)
    plan = made._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "period_end" in line.split("Inner")[0]]
    assert joins and all("BuildRight" in line for line in joins)
    assert made.count() == 36_600


def test_spellings_are_read_once_a_schedule_and_grids_are_spread(spark):
    """A schedule has thousands of periods: what is the same in all of them is worked out before they are made, and not in the task that read the file."""
    rows = spark.range(0, 64, 1, 1).selectExpr("id AS schedule_id", "date '2020-01-01' AS start_date", "date '2021-01-01' AS end_date", "' DAILY' AS frequency",
                                               "'Actual/360' AS day_count", "'Following' AS roll", "'NYC' AS calendar")
    made = schedules.coupon_schedule(rows, spark.sql("SELECT 'NYC' AS calendar, date '2020-07-03' AS holiday"), config.SCHEDULE_FREQUENCIES, config.SCHEDULE_SPELLINGS)
    above = made._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    assert "period_end" in above and "regexp_replace" not in above
    assert made.groupBy(F.spark_partition_id()).count().count() > 1
    assert [tuple(r) for r in made.filter("period_end = date '2020-07-03'").select("payment_date", "accrual_days").distinct().collect()] == [(D(2020, 7, 6), 1)]
