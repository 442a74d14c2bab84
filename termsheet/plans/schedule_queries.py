"""Coupon schedules (O9) and profile scoring (O1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from termsheet import config
from termsheet.operators import quality, schedules as ops
from termsheet.plans import domain
from termsheet.plans.domain import table
from termsheet.plans.registry import query
from termsheet.session import small_table

# Starts on month ends and leap days, ends on and off the grid, spellings as documents have them, some rows without a schedule.
domain.TABLES["schedules"] = """
SELECT schedule_id, start_date, CASE WHEN schedule_id % 97 = 0 THEN start_date
    WHEN schedule_id % 5 = 0 THEN make_date(year(start_date) + 2, month(start_date), least(day(start_date), 28))
    WHEN kind IN (4, 5) THEN start_date + cast(1 + schedule_id % 150 AS int) ELSE start_date + cast(40 + schedule_id % 1500 AS int) END AS end_date,
  CASE kind WHEN 0 THEN 'Monthly' WHEN 1 THEN ' quarterly ' WHEN 2 THEN 'Semi-Annually' WHEN 3 THEN 'per annum' WHEN 4 THEN 'weekly'
    WHEN 5 THEN 'DAILY' WHEN 6 THEN 'every  month' WHEN 7 THEN 'at the issuer''s whim' END AS frequency,
  CASE schedule_id % 6 WHEN 0 THEN 'Actual/360' WHEN 1 THEN 'act/365' WHEN 2 THEN '30/360' WHEN 3 THEN 'Actual/Actual' WHEN 4 THEN 'other' END AS day_count,
  CASE kind2 WHEN 0 THEN 'Following Business Day Convention' WHEN 1 THEN 'Modified  Following' WHEN 2 THEN 'preceding' WHEN 3 THEN 'unadjusted' END AS roll,
  CASE schedule_id % 3 WHEN 0 THEN 'NYC' WHEN 1 THEN 'LON' END AS calendar, schedule_id % 14 = 0 AS end_of_month
FROM (SELECT o_orderkey AS schedule_id, o_custkey % 9 AS kind, (o_custkey + o_orderkey) % 5 AS kind2,
    CASE o_orderkey % 7 WHEN 0 THEN last_day(cast(o_orderdate AS date)) WHEN 1 THEN make_date(1996, 2, 29) ELSE cast(o_orderdate AS date) END AS start_date
  FROM {orders}) t"""
domain.TABLES["holidays"] = """
SELECT DISTINCT 'NYC' AS calendar, cast(o_orderdate AS date) AS holiday FROM {orders} WHERE month(o_orderdate) * 100 + day(o_orderdate) IN (101, 704, 1111, 1225)
UNION ALL SELECT DISTINCT 'LON', cast(o_orderdate AS date) FROM {orders} WHERE month(o_orderdate) * 100 + day(o_orderdate) IN (101, 501, 1225, 1226)"""
domain.TABLES["stated_dates"] = """
SELECT schedule_id, start_date + cast(31 AS int) AS stated_date FROM {schedules} WHERE schedule_id % 4 = 0
UNION ALL SELECT schedule_id, end_date FROM {schedules} WHERE schedule_id % 4 < 2
UNION ALL SELECT schedule_id, start_date + cast(7 * (schedule_id % 5) AS int) FROM {schedules} WHERE schedule_id % 4 = 1"""

_SPELLED = ", ".join(f"('{k}', '{v}')" for k, v in config.SCHEDULE_SPELLINGS.items())
_UNITS = ", ".join(f"('{k}', '{u}', {n})" for k, (u, n) in config.SCHEDULE_FREQUENCIES.items())
_PLAIN = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _grid(k: str) -> str:
    month = f"(start_date + to_months(({k} * step)::int))::date"
    return f"CASE WHEN unit = 'day' THEN start_date + ({k} * step)::int WHEN sticky THEN last_day({month}) ELSE {month} END"


def _place(d: str) -> str:
    return f"(year({d}) + (dayofyear({d}) - 1) / dayofyear(make_date(year({d}), 12, 31))::double)"


_GENERATED = f"""
WITH RECURSIVE s AS (SELECT s.*, unit, step, r.code AS rule, b.code AS basis, coalesce(s.calendar, '') AS cal,
    end_of_month AND start_date = last_day(start_date) AS sticky FROM {{schedules}} s
  JOIN (VALUES {_SPELLED}) q(spelling, code) ON {_PLAIN.format('frequency')} = q.spelling JOIN (VALUES {_UNITS}) u(code, unit, step) ON u.code = q.code
  LEFT JOIN (VALUES {_SPELLED}) r(spelling, code) ON {_PLAIN.format('roll')} = r.spelling
  LEFT JOIN (VALUES {_SPELLED}) b(spelling, code) ON {_PLAIN.format('day_count')} = b.spelling WHERE start_date < end_date),
g AS (SELECT *, 0 AS k, start_date AS d FROM s UNION ALL SELECT * EXCLUDE (k, d), k + 1, {_grid('(k + 1)')} FROM g WHERE {_grid('(k + 1)')} < end_date),
p AS (SELECT *, (k + 1)::int AS period_no, d AS period_start, coalesce(lead(d) OVER (PARTITION BY schedule_id ORDER BY k), end_date) AS period_end FROM g),
near AS (SELECT cal, period_end, x.n, period_end + x.n AS day FROM (SELECT DISTINCT cal, period_end FROM p) c, (SELECT unnest(range(-12, 13))::int AS n) x),
open AS (SELECT near.* FROM near LEFT JOIN {{holidays}} h ON h.calendar = cal AND h.holiday = day WHERE h.holiday IS NULL AND isodow(day) < 6),
roll AS (SELECT cal, period_end, min(day) FILTER (n >= 0) AS up, max(day) FILTER (n <= 0) AS down FROM open GROUP BY 1, 2),
a AS (SELECT p.*, up, down, CASE WHEN basis = '30/360' THEN (year(period_end) - year(period_start)) * 360 + (month(period_end) - month(period_start)) * 30
    + CASE WHEN day(period_end) = 31 AND day(period_start) >= 30 THEN 30 ELSE day(period_end) END - least(day(period_start), 30)
    ELSE period_end - period_start END AS days FROM p JOIN roll USING (cal, period_end)),
generated AS (SELECT schedule_id, period_no, period_start, period_end,
  CASE rule WHEN 'following' THEN up WHEN 'modified' THEN CASE WHEN month(up) = month(period_end) THEN up ELSE down END WHEN 'preceding' THEN down
    ELSE period_end END AS payment_date, days::int AS accrual_days,
  round(CASE WHEN basis IN ('30/360', 'act/360') THEN days / 360::double WHEN basis = 'act/365' THEN days / 365::double
    WHEN basis = 'act/act' THEN {_place('period_end')} - {_place('period_start')} END, 10) AS coupon_factor FROM a)
"""


def generated(spark, sf):
    return ops.coupon_schedule(table(spark, sf, "schedules"), table(spark, sf, "holidays"), config.SCHEDULE_FREQUENCIES, config.SCHEDULE_SPELLINGS)


@query("o9_schedule", _GENERATED + "SELECT * FROM generated")
def o9(spark, sf):
    return generated(spark, sf)


@query("o9_mismatches", _GENERATED + """, said AS (SELECT DISTINCT schedule_id, stated_date AS date FROM {stated_dates}),
paid AS (SELECT DISTINCT schedule_id, payment_date AS date FROM generated WHERE schedule_id IN (SELECT schedule_id FROM said))
SELECT coalesce(s.schedule_id, p.schedule_id) AS schedule_id, coalesce(s.date, p.date) AS date,
  CASE WHEN s.date IS NULL THEN 'missing' WHEN EXISTS (FROM generated g WHERE g.schedule_id = s.schedule_id AND g.period_end = s.date) THEN 'unrolled' ELSE 'unexpected' END AS kind
FROM said s FULL JOIN paid p ON s.schedule_id = p.schedule_id AND s.date = p.date WHERE s.date IS NULL OR p.date IS NULL""")
def o9_mismatches(spark, sf):
    return ops.schedule_mismatches(generated(spark, sf), table(spark, sf, "stated_dates"))


# Profiles over the 22 features of the reference vectors: what a model needs, what it often has, what speaks against it.
PROFILES = [row for m, model in enumerate(config.MODELS) for row in [
    *[(model, "required", f"F{(m * 2 + i * 5) % 22 + 1}", "true" if i else "false", 0.25) for i in range(2)],
    *[(model, "typical", f"F{(m * 3 + i * 4 + 1) % 22 + 1}", str((m + i) % 2 == 0).lower(), 0.0625) for i in range(4)],
    *[(model, "typical", "F22", value, 0.03125) for value in ("true", "false")],
    *[(model, "counter", f"F{(m * 5 + i * 3 + 2) % 22 + 1}", str((m + i) % 2 == 1).lower(), 0.125) for i in range(3)]]]
domain.CHECK_TABLES["profiles"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{k}', '{f}', '{v}', {w}::double)" for m, k, f, v, w in PROFILES) + ") t(model, kind, feature, value, weight)"
domain.CHECK_TABLES["known_features"] = """
SELECT vec_id AS item_id, 'F' || i AS feature, CASE WHEN embedding[i] > 0 THEN 'true' ELSE 'false' END AS value
FROM {embeddings}, (SELECT unnest(range(1, 23)) AS i) n WHERE abs(embedding[i]) > 0.02"""
_SCORED = """
WITH e AS (SELECT model, kind, feature, max(weight) AS w FROM {profiles} GROUP BY ALL),
met AS (SELECT DISTINCT k.item_id, p.model, p.kind, p.feature FROM {known_features} k JOIN {profiles} p ON k.feature = p.feature AND k.value = p.value),
t AS (SELECT i.vec_id AS item_id, e.model, 1 + sum(CASE WHEN e.kind = 'required' THEN CASE WHEN m.item_id IS NULL THEN -w ELSE 0 END
    WHEN m.item_id IS NULL THEN 0 WHEN e.kind = 'typical' THEN w ELSE -w END) AS total
  FROM {embeddings} i JOIN e ON true LEFT JOIN met m ON m.item_id = i.vec_id AND m.model = e.model AND m.kind = e.kind AND m.feature = e.feature GROUP BY 1, 2),
scored AS (SELECT item_id, model, round(least(1.0, greatest(0.0, total)), 6) AS score FROM t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, model)::int AS rank FROM scored)
"""


def scores(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    known = vectors.select("item_id", F.posexplode(F.slice("embedding", 1, 22)).alias("at", "x")).filter("abs(x) > 0.02").select(
        "item_id", F.concat(F.lit("F"), (F.col("at") + 1).cast("string")).alias("feature"), (F.col("x") > 0).cast("string").alias("value"))
    profiles = small_table(spark, PROFILES, "model STRING, kind STRING, feature STRING, value STRING, weight DOUBLE")
    return quality.profile_scores(vectors.select("item_id"), known, profiles)


@query("o1_profile_scores", _SCORED + "SELECT * FROM ranked")
def o1(spark, sf):
    return scores(spark, sf)


@query("o1_bands", _SCORED + """SELECT a.item_id, a.model, a.score, round(a.score - coalesce(b.score, 0), 6) AS lead,
  CASE WHEN a.score >= 0.8::double THEN 'classified' WHEN a.score >= 0.6::double THEN 'needs_classification_review' ELSE 'needs_review' END AS band
FROM ranked a LEFT JOIN ranked b ON a.item_id = b.item_id AND b.rank = 2 WHERE a.rank = 1""")
def o1_bands(spark, sf):
    return quality.profile_bands(scores(spark, sf))
