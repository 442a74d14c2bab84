"""Streaming forms of batch operators (T1-T4): the same rules on unbounded input.

A checkpoint location is the caller's: a folder every executor can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termsheet import config
from termsheet.functions.text import accession_folder, normalise_accession
from termsheet.functions.times import wall_clock
from termsheet.operators.usage import call_cost
from termsheet.operators.workflow import Rules, apply_actions


def unique_filings(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """T1 (S6): each accession number once within the delay; state older than that is dropped."""
    keyed = requests.withColumn("accession_number", normalise_accession(F.col("accession_number")))
    return (keyed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["accession_number"])
            .withColumns({"folder_path": accession_folder(F.col("accession_number")), "status": F.lit("ingested")}))


def live_spend(calls: DataFrame, pricing: list[dict], default_model: str, delay: str = "1 hour",
               width: str = "1 day") -> DataFrame:
    """T2 (U12): spend per window and phase, for update or append mode; calls whose window ended more than the
    delay before the latest call are dropped, and so is the state of those windows."""
    timed = call_cost(calls, pricing, default_model).withColumn(
        "at", wall_clock(F.col("called_at")).cast("timestamp")).filter("at IS NOT NULL")
    phase = F.when(F.coalesce("call_type", F.lit("")).startswith("classify"), "classify").otherwise("extract")
    return (timed.withWatermark("at", delay).groupBy(F.window("at", width), phase.alias("phase"))
            .agg(F.count("*").alias("calls"), F.sum(F.col("cost_units").cast("decimal(28,0)")).alias("cost_units"))
            .select(F.col("window.start").alias("window_start"), "phase", "calls", "cost_units"))


def miss_counts(misses: DataFrame) -> DataFrame:
    """T4 (L7): running number of filings, first and last time per unmapped label, for update mode: a batch gives
    the labels that it changed."""
    return misses.groupBy("label_norm").agg(
        F.count("*").alias("occurrences"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


_STATE = "status STRING, model STRING, confidence DOUBLE"
_OUTCOME = ("filing_id STRING, seq BIGINT, action STRING, reason STRING, old_status STRING, new_status STRING, "
            "old_model STRING, new_model STRING, confidence DOUBLE")


def action_outcomes(actions: DataFrame, filings: DataFrame, models: list[str] = config.MODELS) -> DataFrame:
    """T3 (W0): one outcome per action of a stream, in append mode, with the state after it.

    Each filing's state is kept in the stream's state store, so the checkpoint holds it and a restart goes on
    where the last committed batch ended.  The first action of a filing takes its state from ``filings``, a static
    table; an action without a filing is refused and leaves no state.  A batch's actions on one filing are
    applied in the order of ``seq`` by one task, so the trigger's limit on a batch bounds its memory.
    """
    rules = Rules(actions.sparkSession, models)
    columns = [c.split()[0] for c in _OUTCOME.split(", ")]
    start = filings.select("filing_id", *[F.col(c).cast(t).alias(f"start_{c}") for c, t in (p.split() for p in _STATE.split(", "))], F.lit(True).alias("known"))

    def apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.seq)
        plain = lambda v: None if v is None or v != v else v  # noqa: E731  missing numbers come as NaN
        now, found = (state.get, True) if state.exists else ((rows[0].start_status, rows[0].start_model, plain(rows[0].start_confidence)), rows[0].known in (True,))
        out = []
        for r in rows:
            if not found:
                out.append((*key, r.seq, r.action, "filing not found", None, None, None, None, None))
                continue
            reason, after = rules(now, r.action, r.model)
            out.append((*key, r.seq, r.action, reason, now[0], after[0], now[1], after[1], after[2]))
            now = after
        if found:
            state.update(now)
        yield pd.DataFrame(out, columns=columns, dtype=object)

    return (actions.select("filing_id", "seq", "action", "model").join(start, "filing_id", "left").groupBy("filing_id")
            .applyInPandasWithState(apply, _OUTCOME, _STATE, "append", GroupStateTimeout.NoTimeout))


def latest_states(filings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The filings as the outcomes of a stream leave them."""
    last = outcomes.filter("new_status IS NOT NULL").groupBy("filing_id").agg(F.max_by(F.struct("new_status", "new_model", "confidence"), "seq").alias("after"))
    moved, changed = filings.join(last, "filing_id", "left"), F.col("after").isNotNull()
    for column, source in (("status", "new_status"), ("model", "new_model"), ("confidence", "confidence")):
        moved = moved.withColumn(column, F.when(changed, F.col(f"after.{source}")).otherwise(F.col(column)))
    return moved.drop("after")


def follow_actions(actions: DataFrame, read_state: Callable[[], DataFrame], last_batch: Callable[[], int],
                   write_state: Callable[[DataFrame, int], None], write_outcomes: Callable[[DataFrame, int], None],
                   checkpoint: str, **trigger) -> StreamingQuery:
    """T3 (W0) for states that others write too: apply each micro-batch of actions to the caller's table.

    ``read_state`` gives the present state of all filings, ``last_batch`` the id of
    the last batch committed to it (-1 for none), and ``write_state`` commits the filings that a batch
    touched, and only those, under its id.  A batch that is replayed after it was committed is passed over;
    outcomes are written first, under the same id, so a replay before that writes them again, not twice.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= last_batch():
            return
        batch.persist()
        touched = batch.select("filing_id").distinct()
        moved, outcomes = apply_actions(read_state().join(touched, "filing_id", "left_semi"), batch)
        write_outcomes(outcomes, batch_id)
        write_state(moved, batch_id)
        batch.unpersist()
    return (actions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
