"""Coupon schedules: date grids, business days, day counts, and the check against stated dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from termsheet.functions.text import literal_map, strip

#: Days around a schedule that its rolled dates may fall in.
_MARGIN = 31


def coded(c: Column, spellings: dict[str, str]) -> Column:
    """The code of a spelling, whatever its case and spacing; null if it is not listed."""
    return F.try_element_at(literal_map(spellings), F.coalesce(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "), F.lit("")))


def periods(schedules: DataFrame, frequencies: dict[str, tuple[str, int]], spellings: dict[str, str]) -> DataFrame:
    """The coupon periods of each schedule: schedule_id, period_no (from 1), period_start, period_end, and the other columns.

    ``schedules`` has schedule_id, start_date, end_date and frequency, a spelling of a code in ``frequencies``: code -> (month
    or day, how many).  Dates are counted from the start, so a period that begins on the 31st comes back to it after
    a shorter month; a start on the last day of a month keeps to last days if the column ``end_of_month`` is true.  The last
    period ends on the end date, and is short if that is not on the grid.  Schedules of unknown frequency, without dates, or
    that end before they start have no periods.
    """
    unit, step = ({code: value[k] for code, value in frequencies.items()} for k in (0, 1))
    code = coded(F.col("frequency"), spellings)
    rows = schedules.withColumns({"_unit": F.try_element_at(literal_map(unit), F.coalesce(code, F.lit(""))),
                                  "_step": F.try_element_at(literal_map(step), F.coalesce(code, F.lit("")))})
    rows = rows.filter("_unit IS NOT NULL AND start_date < end_date")
    sticky = F.coalesce("end_of_month", F.lit(False)) if "end_of_month" in schedules.columns else F.lit(False)
    sticky = sticky & (F.col("start_date") == F.last_day("start_date"))

    def on_grid(k: Column) -> Column:
        months = F.add_months("start_date", (k * F.col("_step")).cast("int"))
        return F.when(F.col("_unit") == "day", F.date_add("start_date", (k * F.col("_step")).cast("int"))).otherwise(
            F.when(sticky, F.last_day(months)).otherwise(months))

    months = (F.year("end_date") - F.year("start_date")) * 12 + F.month("end_date") - F.month("start_date")
    whole = F.when(F.col("_unit") == "day", F.floor((F.datediff("end_date", "start_date") - 1) / F.col("_step"))).otherwise(F.floor(months / F.col("_step")))
    # The last date of the grid before the end; by months it is this one or the one before.
    inside = rows.withColumn("_n", whole).withColumn("_n", F.when(on_grid(F.col("_n")) < F.col("end_date"), F.col("_n")).otherwise(F.col("_n") - 1))
    each = inside.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), "_n")))
    end = F.when(F.col("_k") == F.col("_n"), F.col("end_date")).otherwise(on_grid(F.col("_k") + 1))
    return (each.withColumns({"period_no": (F.col("_k") + 1).cast("int"), "period_start": on_grid(F.col("_k")), "period_end": end})
            .drop("_unit", "_step", "_n", "_k", "start_date", "end_date", "frequency", "end_of_month"))


def business_days(ranges: DataFrame, holidays: DataFrame) -> DataFrame:
    """calendar, date, next_day, previous_day: the business day on or after, and on or before, each date.

    ``ranges``: calendar, first, last.  Saturdays, Sundays and the calendar's ``holidays`` (calendar, holiday) are none.  A
    calendar is a few hundred rows a year, looked up by windows once for all schedules that use it.
    """
    days = ranges.select("calendar", F.explode(F.sequence("first", "last")).alias("date"))
    free = holidays.select("calendar", F.col("holiday").cast("date").alias("date"), F.lit(True).alias("free")).distinct()
    open_ = days.join(free, ["calendar", "date"], "left").withColumn(
        "open", F.when(F.col("free").isNull() & (F.weekday("date") < 5), F.col("date")))
    on = Window.partitionBy("calendar").orderBy("date")
    return open_.select("calendar", "date",
                        F.first("open", ignorenulls=True).over(on.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("next_day"),
                        F.last("open", ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("previous_day"))


def rolled(date: Column, next_day: Column, previous_day: Column, rule: Column) -> Column:
    """A date moved to a business day: following, modified (not into the next month), preceding; else as it is."""
    return (F.when(rule == "following", next_day)
            .when(rule == "modified", F.when(F.month(next_day) == F.month(date), next_day).otherwise(previous_day))
            .when(rule == "preceding", previous_day).otherwise(date))


def accrual_days(start: Column, end: Column, basis: Column) -> Column:
    """Days between two dates: actual ones, or of months of 30 days."""
    first = F.least(F.day(start), F.lit(30))
    last = F.when((F.day(end) == 31) & (first == 30), 30).otherwise(F.day(end))
    months = (F.year(end) - F.year(start)) * 360 + (F.month(end) - F.month(start)) * 30 + last - first
    return F.when(basis == "30/360", months).otherwise(F.datediff(end, start))


def year_fraction(start: Column, end: Column, basis: Column) -> Column:
    """The share of a year between two dates; ``act/act`` counts each day by the length of its own year."""
    def place(date: Column) -> Column:
        length = F.when(F.month(F.date_add(F.make_date(F.year(date), F.lit(2), F.lit(28)), 1)) == 2, 366).otherwise(365)
        return F.year(date) + (F.dayofyear(date) - 1) / length

    days = accrual_days(start, end, basis)
    return F.round(F.when(basis.isin("30/360", "act/360"), days / 360).when(basis == "act/365", days / 365)
                   .when(basis == "act/act", place(end) - place(start)), 10)


def coupon_schedule(schedules: DataFrame, holidays: DataFrame, frequencies: dict[str, tuple[str, int]], spellings: dict[str, str]) -> DataFrame:
    """schedule_id, period_no, period_start, period_end, payment_date, accrual_days, coupon_factor.

    ``schedules``: schedule_id, start_date, end_date, frequency, day_count, roll, calendar and, if wanted, end_of_month; the
    conventions are as a document spells them, ``spellings`` maps them to codes.  Days accrue between the
    unrolled dates; payment is on the period's end, rolled in its calendar (none: weekends only).  An unlisted roll leaves
    the date, an unlisted day count no factor.  Grids are made inside the row; business days come from one small table.
    """
    spelled = schedules.withColumns({
        "calendar": F.coalesce("calendar", F.lit("")), "rule": F.coalesce(coded(F.col("roll"), spellings), F.lit("")),
        "basis": F.coalesce(coded(F.col("day_count"), spellings), F.lit(""))}).drop("roll", "day_count")
    # Few bytes make many periods, so schedules are dealt out by number, not by the splits of their files.
    tasks = int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = periods(spelled.filter("start_date < end_date").repartition(tasks, "schedule_id", "start_date", "end_date"), frequencies, spellings)
    ranges = (schedules.filter("start_date < end_date").groupBy(F.coalesce("calendar", F.lit("")).alias("calendar"))
              .agg(F.date_sub(F.min("start_date"), _MARGIN).alias("first"), F.date_add(F.max("end_date"), _MARGIN).alias("last")))
    days = business_days(ranges, holidays).withColumnRenamed("date", "period_end")
    # The days are few and bounded by calendars and years; the planner does not see that the grid is many times its schedules.
    dated = grid.join(F.broadcast(days), ["calendar", "period_end"])
    start, end = F.col("period_start"), F.col("period_end")
    return dated.select("schedule_id", "period_no", "period_start", "period_end",
                        rolled(end, F.col("next_day"), F.col("previous_day"), F.col("rule")).alias("payment_date"),
                        accrual_days(start, end, F.col("basis")).cast("int").alias("accrual_days"),
                        year_fraction(start, end, F.col("basis")).alias("coupon_factor"))


def schedule_mismatches(generated: DataFrame, stated: DataFrame) -> DataFrame:
    """schedule_id, date, kind for every date that only one side has, of the schedules that state any.

    ``stated``: schedule_id, stated_date.  ``unrolled`` is a stated period end whose payment date is another; ``unexpected`` any
    other stated date that was not generated; ``missing`` a payment date that is not stated.
    """
    both = F.inline(F.array(*[F.struct(F.col(date).alias("date"), F.lit(paid).alias("paid"), F.lit(1 - paid).alias("ends"))
                              for date, paid in (("payment_date", 1), ("period_end", 0))]))
    known = generated.select("schedule_id", both).withColumn("said", F.lit(0))
    said = stated.select("schedule_id", F.col("stated_date").cast("date").alias("date"), F.lit(0).alias("paid"), F.lit(0).alias("ends"), F.lit(1).alias("said"))
    asked = stated.select("schedule_id").distinct()
    every = known.join(asked, "schedule_id", "left_semi").unionByName(said.filter("date IS NOT NULL"))
    found = every.groupBy("schedule_id", "date").agg(*[F.max(c).alias(c) for c in ("paid", "ends", "said")]).filter("paid <> said")
    kind = F.when(F.col("paid") == 1, "missing").when(F.col("ends") == 1, "unrolled").otherwise("unexpected")
    return found.select("schedule_id", "date", kind.alias("kind"))
