"""Usage and cost analytics over the model-call log.

The call log is a large fact table.  Prices and step labels are short constant lists, so
they enter as literals and add no join.  Anything per filing is first rolled up by
``filing_id`` (partial aggregation before the shuffle keeps one hot filing cheap), and only
that roll-up is joined or counted.

Money is summed in whole units of 1e-10 USD (a token times a price in 1e-4 USD per million),
so totals do not depend on the order in which partitions arrive; it becomes a double once, at
the end, rounded half up.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, Window

from termsheet import config
from termsheet.functions.text import literal_map
from termsheet.functions.times import bucket_label, seconds_between, wall_clock

_TOKENS = ["prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens"]


_UNITS_PER_USD = 1e10


def _price_units(row: dict, name: str) -> int:
    units = round(float(row[name]) * 10_000)
    if abs(units - float(row[name]) * 10_000) > 1e-6:
        raise ValueError(f"{name} of {row['model_id']} has more than four decimals")
    return units


def _price(model: Column, pricing: list[dict], default_model: str, name: str) -> Column:
    """Price of a million tokens in units of 1e-4 USD; unlisted models pay the default's."""
    by_model = {row["model_id"]: _price_units(row, name) for row in pricing}
    known = F.try_element_at(literal_map(by_model), F.coalesce(model, F.lit("")))
    return F.coalesce(known, F.lit(by_model[default_model])).cast("bigint")


def _usd(units: Column | str, digits: int) -> Column:
    """Units of 1e-10 USD as a double rounded half up to ``digits`` decimals."""
    units = F.col(units) if isinstance(units, str) else units
    return F.round(units.cast("decimal(38,0)"), digits - 10).cast("double") / _UNITS_PER_USD


def _sum(c: str | Column, name: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).alias(name)


def _sum_units(c: str | Column, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias(name)


def call_cost(usage: DataFrame, pricing: list[dict], default_model: str) -> DataFrame:
    """Add cost and cache savings to each call, in units and in USD.

    A missing or unlisted model pays the default model's price; plain input is what is left
    of the prompt after cache reads and writes, never below zero.
    """
    tokens = {name: F.coalesce(F.col(name), F.lit(0)) for name in _TOKENS}
    price = {name: _price(F.col("model"), pricing, default_model, name)
             for name in ("input_price", "output_price", "cache_write_price", "cache_read_price")}
    plain = F.greatest(F.lit(0), tokens["prompt_tokens"] - tokens["cache_read_tokens"]
                       - tokens["cache_write_tokens"])
    cost = (plain * price["input_price"]
            + tokens["cache_write_tokens"] * price["cache_write_price"]
            + tokens["cache_read_tokens"] * price["cache_read_price"]
            + tokens["completion_tokens"] * price["output_price"])
    saved = tokens["cache_read_tokens"] * (price["input_price"] - price["cache_read_price"])
    return (usage.withColumns({"cost_units": cost, "savings_units": saved})
            .withColumns({"cost_usd": F.col("cost_units") / _UNITS_PER_USD,
                          "cache_savings_usd": F.col("savings_units") / _UNITS_PER_USD}))


def with_filing(costed: DataFrame, filings: DataFrame) -> DataFrame:
    """Calls left-joined to their filing; no filing gives ``unknown`` / ``Unknown``."""
    about = filings.select("filing_id", F.col("model").alias("filing_model"), "issuer_name")
    return (costed.join(about, "filing_id", "left")
            .withColumns({"filing_model": F.coalesce("filing_model", F.lit("unknown")),
                          "issuer_name": F.coalesce("issuer_name", F.lit("Unknown"))}))


_MONEY = ["cost", "savings", "classify_cost", "stage2_cost", "week_cost", "month_cost"]


def _filing_rollup(costed: DataFrame, week_ago: str, month_ago: str) -> DataFrame:
    """One row per filing_id (null included) with every total the summary needs."""
    ts = F.coalesce(F.col("called_at"), F.lit(""))
    in_week, in_month = ts >= week_ago, ts >= month_ago
    step = F.coalesce(F.col("call_type"), F.lit(""))
    return costed.groupBy("filing_id").agg(
        F.count("*").alias("calls"), *[_sum(t, t) for t in _TOKENS],
        _sum_units("cost_units", "cost"), _sum_units("savings_units", "savings"),
        _sum_units(F.when(step.startswith("classify"), F.col("cost_units")), "classify_cost"),
        _sum_units(F.when(step == "classify_stage2", F.col("cost_units")), "stage2_cost"),
        _sum_units(F.when(in_week, F.col("cost_units")), "week_cost"),
        _sum_units(F.when(in_month, F.col("cost_units")), "month_cost"),
        F.max(in_week).alias("in_week"), F.max(in_month).alias("in_month"))


def summary(costed: DataFrame, as_of: str, found_fields: DataFrame | None = None) -> DataFrame:
    """One row of totals, rolling spend, unit economics, projection.

    ``as_of`` is an ISO timestamp.  ``found_fields`` is the field table; its found rows are
    counted for the cost per field.  An empty log gives a zero row.
    """
    moment = datetime.fromisoformat(as_of)
    week_ago, month_ago = [(moment - timedelta(days=d)).isoformat() for d in (7, 30)]
    known = F.col("filing_id").isNotNull()
    totals = _filing_rollup(costed, week_ago, month_ago).agg(
        _sum("calls", "total_calls"), _sum("prompt_tokens", "input_tokens"),
        _sum("completion_tokens", "output_tokens"), _sum("cache_read_tokens", "cache_read_tokens"),
        _sum("cache_write_tokens", "cache_write_tokens"),
        *[_sum_units(c, c) for c in _MONEY],
        F.count("filing_id").alias("total_filings"),
        F.count_if(known & F.col("in_week")).alias("week_filings"),
        F.count_if(known & F.col("in_month")).alias("month_filings"),
        F.lit(0).cast("bigint").alias("fields_found"))
    if found_fields is not None:
        # Both sides are one row; adding them up avoids a join without keys.
        counted = found_fields.agg(F.count_if(~F.col("not_found")).alias("fields_found"))
        both = totals.unionByName(counted, allowMissingColumns=True)
        totals = both.agg(*[(_sum_units if c in _MONEY else _sum)(c, c) for c in totals.columns])
    t = {c: F.col(c).cast("double") / _UNITS_PER_USD if c in _MONEY else F.col(c)
         for c in totals.columns}
    some = t["total_filings"] > 0
    total_in = F.greatest(t["input_tokens"], F.lit(1))
    run_rate = F.when(t["month_filings"] > 0, _usd("month_cost", 4))
    classify_pct = F.when(t["cost"] != 0, F.round(t["classify_cost"] / t["cost"] * 100, 1)).otherwise(0.0)
    stage2_pct = F.round(t["stage2_cost"] / F.greatest(t["classify_cost"], F.lit(0.000001)) * 100, 1)
    return totals.select(
        _usd("cost", 4).alias("total_cost_usd"), _usd("week_cost", 4).alias("week_cost_usd"),
        _usd("month_cost", 4).alias("month_cost_usd"), "total_calls", "total_filings",
        "week_filings", "month_filings", "input_tokens", "output_tokens", "cache_read_tokens",
        "cache_write_tokens", "fields_found",
        _usd("savings", 6).alias("cache_savings_usd"),
        F.when(some, F.round(t["cost"] / t["total_filings"], 6)).alias("cost_per_filing"),
        F.when(t["fields_found"] > 0, F.round(t["cost"] / t["fields_found"], 6)).alias("cost_per_field_found"),
        F.when(some, F.round(t["input_tokens"] / t["total_filings"], 0)).alias("avg_input_per_filing"),
        F.round(t["output_tokens"] / total_in * 100, 1).alias("output_input_ratio_pct"),
        classify_pct.alias("classify_overhead_pct"), stage2_pct.alias("stage2_overhead_pct"),
        _usd("stage2_cost", 6).alias("stage2_cost_usd"),
        F.round(t["cache_read_tokens"] / total_in * 100, 1).alias("cache_hit_rate_pct"),
        run_rate.alias("monthly_run_rate_usd"),
        F.when(some, F.round(t["cost"] / t["total_filings"] * 100, 4)).alias("per_100_filings_usd"),
        F.when(run_rate != 0, F.round(run_rate * 12, 2)).alias("annual_estimate_usd"),
        F.round(run_rate * 0.5, 4).alias("batch_estimate_usd"),
        F.round(stage2_pct * classify_pct / 100, 4).alias("stage2_share_of_total_pct"))


def by_step(costed: DataFrame, labels: dict[str, str] = config.STEP_LABELS) -> DataFrame:
    """Tokens, cost, savings, share and mean cost per pipeline step."""
    step = F.coalesce(F.col("call_type"), F.lit("unknown"))
    grouped = costed.groupBy(step.alias("call_type")).agg(
        F.count("*").alias("calls"), _sum("prompt_tokens", "input_tokens"),
        _sum("completion_tokens", "output_tokens"), _sum("cache_read_tokens", "cache_read_tokens"),
        _sum("cache_write_tokens", "cache_write_tokens"), _sum_units("cost_units", "raw_cost"),
        _sum_units("savings_units", "raw_savings"))
    total = F.sum("raw_cost").over(Window.partitionBy()).cast("double") / _UNITS_PER_USD   # few rows
    cost = _usd("raw_cost", 6)
    return grouped.select(
        "call_type",
        F.coalesce(F.try_element_at(literal_map(labels), F.col("call_type")), "call_type").alias("label"),
        "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
        cost.alias("cost_usd"), _usd("raw_savings", 6).alias("cache_savings_usd"),
        F.when(total != 0, F.round(cost / total * 100, 1)).otherwise(0.0).alias("pct_of_total"),
        F.round(cost / F.col("calls"), 6).alias("avg_cost_per_call"),
    ).orderBy(F.desc("cost_usd"), "call_type")


def step_token_totals(steps: DataFrame) -> DataFrame:
    """Token totals over the step table."""
    return steps.agg(*[_sum(c, c) for c in
                       ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])


def by_filing_attribute(costed: DataFrame, filings: DataFrame, attribute: str,
                        missing: str) -> DataFrame:
    """Calls and cost per filing attribute (model or issuer).

    Calls are summed per filing before the join, so the join carries one row per filing
    however many calls a filing made, and only filing rows cross the second shuffle.
    """
    per_filing = costed.groupBy("filing_id").agg(
        F.count("*").alias("calls"), _sum_units("cost_units", "cost"))
    named = per_filing.join(filings.select("filing_id", attribute), "filing_id", "left")
    return (named.groupBy(F.coalesce(F.col(attribute), F.lit(missing)).alias(attribute))
            .agg(F.sum("calls").alias("calls"), _usd(F.sum("cost"), 6).alias("cost_usd"))
            .orderBy(F.desc("cost_usd"), attribute))


def by_model(costed: DataFrame, filings: DataFrame) -> DataFrame:
    return by_filing_attribute(costed, filings, "model", "unknown")


def by_issuer(costed: DataFrame, filings: DataFrame) -> DataFrame:
    return by_filing_attribute(costed, filings, "issuer_name", "Unknown")


def breakdowns(costed: DataFrame, filings: DataFrame, labels: dict[str, str] = config.STEP_LABELS) -> DataFrame:
    """U6, U7, U8 at once: dimension (step, model, issuer), key, label, and calls, tokens, cost, savings, share and mean cost.

    Grouping sets: the calls are read once and, where filings are small enough to be broadcast, shuffled once, already
    summed.  Beyond that, the join moves calls; :func:`by_model` and :func:`by_issuer` then sum per filing first.
    """
    step = F.coalesce(F.col("call_type"), F.lit("unknown"))
    named = with_filing(costed, filings).select(
        step.alias("step"), F.col("filing_model").alias("model"), F.col("issuer_name").alias("issuer"), *_TOKENS, "cost_units", "savings_units")
    dimensions = ["step", "model", "issuer"]
    grouped = named.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("calls"), _sum("prompt_tokens", "input_tokens"), _sum("completion_tokens", "output_tokens"),
        _sum("cache_read_tokens", "cache_read_tokens"), _sum("cache_write_tokens", "cache_write_tokens"), _sum_units("cost_units", "raw_cost"),
        _sum_units("savings_units", "raw_savings"))
    # A bit is 0 where its column is grouped by: 011 for the first.
    dimension = F.element_at(F.create_map(*[F.lit(x) for k, d in enumerate(dimensions) for x in (7 - (4 >> k), d)]), F.col("gid").cast("int"))
    cost = _usd("raw_cost", 6)
    total = F.sum("raw_cost").over(Window.partitionBy("dimension")).cast("double") / _UNITS_PER_USD
    return grouped.withColumn("dimension", dimension).withColumn("key", F.coalesce(*dimensions)).select(
        "dimension", "key", F.when(F.col("dimension") == "step", F.try_element_at(literal_map(labels), F.col("key"))).alias("label"),
        "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", cost.alias("cost_usd"),
        _usd("raw_savings", 6).alias("cache_savings_usd"), F.when(total != 0, F.round(cost / total * 100, 1)).otherwise(0.0).alias("pct_of_total"),
        F.round(cost / F.col("calls"), 6).alias("avg_cost_per_call")).withColumn("label", F.coalesce("label", "key"))


def model_comparison(costed: DataFrame, pricing: list[dict]) -> DataFrame:
    """What all tokens would cost at each listed model's price, without the cache."""
    totals = costed.agg(_sum("prompt_tokens", "tokens_in"), _sum("completion_tokens", "tokens_out"),
                        _sum_units("cost_units", "cost"))
    rows = F.array(*[F.struct(
        F.lit(p["model_id"]).alias("model_id"), F.lit(p["display_name"]).alias("display_name"),
        F.lit(_price_units(p, "input_price")).alias("input_price"),
        F.lit(_price_units(p, "output_price")).alias("output_price")) for p in pricing])
    wide = "decimal(20,0)"
    estimate = (F.col("tokens_in").cast(wide) * F.col("p.input_price").cast("decimal(12,0)")
                + F.col("tokens_out").cast(wide) * F.col("p.output_price").cast("decimal(12,0)"))
    delta = F.col("estimate") - F.col("cost")
    return (totals.select("*", F.explode(rows).alias("p")).withColumn("estimate", estimate)
            .select("p.model_id", "p.display_name", _usd("estimate", 4).alias("est_cost_usd"),
                    _usd(delta, 4).alias("delta_usd"),
                    F.when(F.col("cost") != 0, F.round(
                        delta.cast("double") / F.col("cost").cast("double") * 100, 1))
                    .otherwise(0.0).alias("delta_pct")))


def timeline(costed: DataFrame, granularity: str = "week") -> DataFrame:
    """Spend per day, week or month, split into classify and extract; bad times skipped."""
    is_classify = F.coalesce(F.col("call_type"), F.lit("")).startswith("classify")
    timed = costed.withColumn("at", wall_clock(F.col("called_at"))).filter(F.col("at").isNotNull())
    return (timed.groupBy(bucket_label(F.col("at"), granularity).alias("label")).agg(
                _sum_units(F.when(is_classify, F.col("cost_units")), "classify"),
                _sum_units(F.when(~is_classify, F.col("cost_units")), "extract"),
                _sum_units("savings_units", "savings"), F.count("*").alias("calls"))
            .select("label", _usd("classify", 6).alias("classify_cost_usd"),
                    _usd("extract", 6).alias("extract_cost_usd"),
                    _usd("savings", 6).alias("cache_savings_usd"),
                    _usd(F.col("classify") + F.col("extract"), 6).alias("total_cost_usd"), "calls")
            .orderBy("label"))


def filing_kpis(costed: DataFrame, filings: DataFrame, pricing: list[dict],
                default_model: str) -> DataFrame:
    """Ingest time and, per phase, tokens, time, cost and call count of each filing.

    Savings here are priced at the phase's first call, unlike the summary, which prices each
    call by its own model.
    """
    order = F.struct("called_at", "usage_id")
    step = F.coalesce(F.col("call_type"), F.lit(""))
    aggregates, outputs = [], []
    for phase in ("classify", "extract"):
        mine = step.startswith(phase)

        def of(c: str, mine=mine) -> Column:
            return F.when(mine, F.coalesce(F.col(c), F.lit(0)))

        aggregates += [
            F.count_if(mine).alias(f"{phase}_calls"),
            F.min_by(F.struct("called_at", "model"), F.when(mine, order)).alias(f"{phase}_first"),
            F.sum(of("duration_seconds")).alias(f"{phase}_seconds"),
            *[F.sum(of(t)).alias(f"{phase}_{t}") for t in _TOKENS],
            F.sum(F.when(mine, F.col("cost_units")).cast("decimal(28,0)")).alias(f"{phase}_cost")]
        first_model = F.col(f"{phase}_first.model")
        margin = (_price(first_model, pricing, default_model, "input_price")
                  - _price(first_model, pricing, default_model, "cache_read_price"))
        seconds = F.col(f"{phase}_seconds")
        outputs += [
            F.col(f"{phase}_first.called_at").alias(f"{phase}_called_at"),
            F.when(seconds != 0, F.round(seconds, 2)).alias(f"{phase}_seconds"),
            F.col(f"{phase}_prompt_tokens").alias(f"{phase}_input_tokens"),
            F.col(f"{phase}_completion_tokens").alias(f"{phase}_output_tokens"),
            F.col(f"{phase}_cache_read_tokens"), F.col(f"{phase}_cache_write_tokens"),
            _usd(f"{phase}_cost", 6).alias(f"{phase}_cost_usd"),
            _usd(F.col(f"{phase}_cache_read_tokens") * margin, 6).alias(f"{phase}_savings_usd"),
            F.when(F.col(f"{phase}_calls") > 0, F.col(f"{phase}_calls")).alias(f"{phase}_calls")]
    per_filing = costed.filter("filing_id IS NOT NULL").groupBy("filing_id").agg(*aggregates)
    ingest = F.round(seconds_between(F.col("ingest_started_at"), F.col("ingest_timestamp")), 2)
    about = filings.select("filing_id", ingest.alias("ingest_seconds"))
    return about.join(per_filing, "filing_id", "left").select("filing_id", "ingest_seconds", *outputs)


def recent_usage(usage: DataFrame, limit: int = 100) -> DataFrame:
    """The newest calls."""
    return (usage.orderBy(F.desc("called_at"), "usage_id").limit(limit)
            .select("usage_id", "filing_id", "call_type", "model", "prompt_tokens",
                    "completion_tokens", "called_at"))


def field_counts(fields: DataFrame) -> DataFrame:
    """U16: found rows per field path."""
    return (fields.filter(~F.col("not_found")).groupBy("field_path")
            .agg(F.count("*").alias("rows_found")))


def active_models(filings: DataFrame) -> DataFrame:
    """U16: filings per known model."""
    return (filings.filter(F.col("model").isNotNull() & (F.col("model") != "unknown"))
            .groupBy("model").agg(F.count("*").alias("filings")))
