"""Review workflow: actions on filings, field reviews, listings and deletes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from termsheet import config
from termsheet.functions.ordered import previous_known
from termsheet.functions.text import let
from termsheet.operators.export import decode_json, latest_extraction
from termsheet.session import drop_folder, reliable_checkpoint, small_table, written

_STATE_TYPES = {"status": "string", "model": "string", "confidence": "double"}
_STATE = "struct<" + ",".join(f"{c}:{t}" for c, t in _STATE_TYPES.items()) + ">"


def _decide(state: Column, act: Column, models: list[str]) -> Column:
    """One action on one filing state: struct<reason, status, model, confidence>.

    The rules, by action:
      confirm    from needs_classification_review, to a listed model (given, else the present one)
      override   not from approved/exported; extracted stays extracted
      reset      not from extracted/approved/exported; clears the classification
      extract    from classified/needs_review at gate confidence, or from extracted
      reextract  from any state: back to classified, then as extract
      finish / fail   of a running extraction
      approve    from extracted/needs_review;  unapprove and export from approved
    """
    status, model, conf = state["status"], state["model"], state["confidence"]
    name = F.coalesce(act["action"], F.lit("null"))
    present = F.coalesce(model, F.lit("unknown"))
    target = F.coalesce(F.when(act["model"] != "", act["model"]), present)
    confident = F.coalesce(conf, F.lit(0.0)) >= config.GATE_CONFIDENCE
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def result(reason: Column, status_: Column = status, model_: Column = model, conf_: Column = conf) -> Column:
        return F.struct(reason.alias("reason"), status_.alias("status"), model_.alias("model"),
                        conf_.alias("confidence"))

    def only(allowed: Column, refused: Column, accepted: Column) -> Column:
        return F.when(allowed, accepted).otherwise(result(refused))

    ok, low = null_text, F.lit("classification confidence is below the gate")
    wrong = F.concat(F.lit("not allowed from "), status)
    start = (F.when(status == "extracting", result(F.lit("extraction already in progress")))
             .when(~status.isin("classified", "needs_review", "extracted"), result(wrong))
             .when(~confident & (status != "extracted"), result(low))
             .otherwise(result(ok, F.lit("extracting"))))
    again = F.when(confident, result(ok, F.lit("extracting"))).otherwise(result(low, F.lit("classified")))
    return (
        F.when(status.isNull(), result(F.lit("filing has no status")))
        .when(name == "confirm", F.when(status != "needs_classification_review", result(wrong))
               .when(~target.isin([*models, "unknown"]), result(F.concat(F.lit("unknown model "), target)))
               .otherwise(result(ok, F.lit("classified"), target, F.lit(1.0))))
        .when(name == "override", only(~status.isin("approved", "exported"), wrong, result(
            ok, F.when(status == "extracted", status).otherwise(F.lit("classified")), act["model"], F.lit(1.0))))
        .when(name == "reset", only(~status.isin(*config.DONE_STATES), wrong, result(
            ok, F.lit("ingested"), null_text, null_number)))
        .when(name == "extract", start)
        .when(name == "reextract", again)
        .when(name == "finish", only(status == "extracting", wrong, result(ok, F.lit("extracted"))))
        .when(name == "fail", only(status == "extracting", wrong, result(ok, F.lit("classified"))))
        .when(name == "approve", only(status.isin("extracted", "needs_review"), wrong, result(ok, F.lit("approved"))))
        .when(name == "unapprove", only(status == "approved", wrong, result(ok, F.lit("extracted"))))
        .when(name == "export", only(status == "approved", wrong, result(ok, F.lit("exported"))))
        .otherwise(result(F.concat(F.lit("no such action "), name))))


# A block of actions maps every state it may start from to the state it ends in.  What it keeps of the start is
# written with these marks: the status of a filing in none of the known ones, a model that confirm accepts or
# not, and a confidence above or below the gate.
_OTHER, _LISTED, _UNLISTED = "\u0001other", "\u0001listed", "\u0001unlisted"
_HIGH, _LOW = 2.0, -1.0
_STARTS = [(s, m, c) for s in [*config.FILING_STATES, _OTHER] for m in (_LISTED, _UNLISTED, None) for c in (_HIGH, _LOW)]


# A table holds a whole number for each of these starts: the place of the end state in the list (6 bits), whether the
# confidence is kept, null or 1 (2 bits), and whether the model is kept, null, unknown, or which of the given ones.
_PLACE, _MODEL_BIT, _FIRST_GIVEN = 63, 8, 3


def _moves(decided: dict, names: list) -> list[list[list[int]]]:
    """The numbers of one action for every start, by its name and by what model it gives: none, an empty text, a listed or an unlisted one."""
    def number(start: tuple, end: tuple) -> int:
        status, model, confidence = end
        kind = 2 if model is None else 0 if model in (_LISTED, _GIVEN_LISTED, "unknown") else 1
        sure = 0 if (confidence or 0.0) >= config.GATE_CONFIDENCE else 1
        place = _STARTS.index((status, (_LISTED, _UNLISTED, None)[kind], (_HIGH, _LOW)[sure]))
        of_confidence = 0 if confidence == start[2] else 1 if confidence is None else 2
        of_model = 0 if model == start[1] else 1 if model is None else 2 if model == "unknown" else _FIRST_GIVEN
        return place | of_confidence << 6 | of_model << _MODEL_BIT

    return [[[number(s, decided[(*s, name, given)][1:]) for s in _STARTS] for given in (None, "", _GIVEN_LISTED, _GIVEN_UNLISTED)] for name in names]


def _action_table(act: Column, moves: Column, models: list[str]) -> Column:
    """The table of a single action."""
    name = F.when(act["action"].isNull(), len(_NAMES) + 1).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _NAMES)), act["action"]).cast("int"), F.lit(0)), F.lit(len(_NAMES) + 1)) - 1)
    given = F.when(act["model"].isNull(), 0).when(act["model"] == "", 1).when(act["model"].isin([*models, "unknown"]), 2).otherwise(3)
    # Only these two name the model they give.
    named = F.when(act["action"].isin("confirm", "override"), F.array(act["model"])).otherwise(F.array().cast("array<string>"))
    return F.struct(F.get(F.get(moves, name), given).alias("codes"), named.alias("given"))


def _composed(tables: Column) -> Column:
    """One table for several that follow one another; it names one model for each start at most."""
    def joined(first: Column, code: Column, before: Column) -> Column:
        confidence = F.when(code.bitwiseAND(192) == 0, first.bitwiseAND(192)).otherwise(code.bitwiseAND(192))
        model = (F.when(code < 1 << _MODEL_BIT, first - first.bitwiseAND(255)).when(code < _FIRST_GIVEN << _MODEL_BIT, code - code.bitwiseAND(255))
                 .otherwise(code - code.bitwiseAND(255) + F.shiftleft(before, _MODEL_BIT)))
        return F.when(code <= _PLACE, code + first - first.bitwiseAND(_PLACE)).otherwise(code.bitwiseAND(_PLACE) + confidence + model)

    def onward(acc: Column, table: Column) -> Column:
        after = F.transform(acc["codes"], lambda c: F.get(table["codes"], c.bitwiseAND(_PLACE)).cast("int"))
        return F.struct(F.zip_with(acc["codes"], after, lambda c, code: joined(c, code, acc["before"])).alias("codes"),
                        (acc["before"] + F.size(table["given"])).alias("before"))

    def model(code: Column, given: Column) -> Column:
        return F.when(code >= _FIRST_GIVEN << _MODEL_BIT, F.get(given, F.shiftright(code, _MODEL_BIT) - _FIRST_GIVEN))

    def short(codes: Column, given: Column) -> Column:
        return let(F.array_compact(F.array_distinct(F.transform(codes, lambda c: model(c, given)))), lambda kept: F.struct(
            F.transform(codes, lambda c: F.when(c < _FIRST_GIVEN << _MODEL_BIT, c).otherwise(c.bitwiseAND(255) + F.shiftleft(
                F.array_position(kept, model(c, given)).cast("int") + (_FIRST_GIVEN - 1), _MODEL_BIT))).alias("codes"), kept.alias("given")))

    def several(tables: Column) -> Column:
        first = F.get(tables, F.lit(0))
        codes = F.aggregate(F.slice(tables, F.lit(2), F.size(tables)), F.struct(first["codes"].cast("array<int>").alias("codes"), F.size(first["given"]).alias("before")),
                            onward, lambda acc: acc["codes"])
        whole = F.struct(codes.alias("codes"), F.flatten(F.transform(tables, lambda t: t["given"])).alias("given"))
        shortened = let(whole, lambda t: F.when(F.size(t["given"]) > len(_STARTS), short(t["codes"], t["given"])).otherwise(t))
        return let(shortened, lambda t: F.struct(t["codes"].cast("array<smallint>").alias("codes"), t["given"].alias("given")))

    return let(tables, lambda t: F.when(F.size(t) == 1, F.get(t, F.lit(0))).otherwise(several(t)))


def _after_block(table: Column, now: Column, models: list[str]) -> Column:
    """The state after a block: its table at the present state, with what is kept filled in."""
    known = [*config.FILING_STATES]
    at_status = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), now["status"]), F.lit(0)), F.lit(len(known) + 1)) - 1
    at_model = F.when(now["model"].isNull(), 2).when(now["model"].isin([*models, "unknown"]), 0).otherwise(1)
    at_confidence = F.when(F.coalesce(now["confidence"], F.lit(0.0)) >= config.GATE_CONFIDENCE, 0).otherwise(1)
    of_model = lambda code: F.shiftright(code, _MODEL_BIT)
    return F.when(now["status"].isNull(), now).otherwise(let(
        F.get(table["codes"], (at_status * 6 + at_model * 2 + at_confidence).cast("int")).cast("int"), lambda code: F.struct(
            F.coalesce(F.get(F.array(*map(F.lit, known)), F.floor(code.bitwiseAND(_PLACE) / 6).cast("int")), now["status"]).alias("status"),
            F.when(of_model(code) == 0, now["model"]).when(of_model(code) == 2, F.lit("unknown"))
            .when(of_model(code) >= _FIRST_GIVEN, F.get(table["given"], of_model(code) - _FIRST_GIVEN)).alias("model"),
            F.when(code.bitwiseAND(192) == 0, now["confidence"]).when(code.bitwiseAND(192) == 128, F.lit(1.0)).alias("confidence"))))


def _in_turn(tables: Column, first: Column, models: list[str]) -> Column:
    """The state before each of some blocks that follow one another (at, table): array of (at, start)."""
    none = F.array().cast(f"array<struct<at:bigint,start:{_STATE}>>")

    def onward(acc: Column, b: Column) -> Column:
        start = F.struct(b["at"].alias("at"), acc["now"].alias("start"))
        return F.struct(_after_block(b["table"], acc["now"], models).alias("now"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    return F.aggregate(tables, F.struct(first.alias("now"), none.alias("starts")), onward, lambda acc: acc["starts"])


def _block_starts(blocks: DataFrame, now: DataFrame, models: list[str], fan: int) -> DataFrame | None:
    """filing_id, at, start: the state before each block of the filings that have several; None if no filing has.

    A prefix scan in levels.  Upwards, the tables of ``fan`` neighbouring blocks become one, level by level, until a
    filing has one left; downwards, each table's start gives those of the tables it was made of.  No
    row holds more than ``fan`` tables.  Each level is written before the next is made.
    """
    several = blocks.groupBy("filing_id").agg(F.count("*").alias("n")).filter("n > 1").select("filing_id")
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))       # by number, as few bytes make much work
    rules = Rules(blocks.sparkSession, models).decided
    moves = F.from_json(F.lit(json.dumps(_moves(rules, [*_NAMES, _ODD_NAME, None]))), "array<array<array<smallint>>>")
    level, folder = written(blocks.join(several, "filing_id", "left_semi").repartition(tasks, "filing_id", "at")
                            .select("filing_id", "at", _composed(F.transform("todo", lambda act: _action_table(act, moves, models))).alias("table")), "block-tables")
    if level.isEmpty():
        return None
    levels = []
    while not level.groupBy("filing_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        inside = level.withColumn("above", F.expr(f"at DIV {fan}")).repartition(tasks, "filing_id", "above").groupBy("filing_id", "above").agg(
            F.array_sort(F.collect_list(F.struct("at", "table"))).alias("inside"))
        upper, further = written(inside.withColumnRenamed("above", "at").withColumn("table", _composed(F.transform("inside", lambda b: b["table"]))), "block-tables")
        if not levels:
            drop_folder(blocks.sparkSession, folder)              # the first level's tables are all in the second
        levels.append(upper)
        level = upper.select("filing_id", "at", "table")
    starts = level.select("filing_id", "at").join(now.withColumnRenamed("now", "start"), "filing_id")
    for upper in reversed(levels):
        starts = upper.repartition(tasks, "filing_id", "at").join(starts, ["filing_id", "at"]).select("filing_id", F.inline(_in_turn(F.col("inside"), F.col("start"), models)))
    return starts


def apply_actions(filings: DataFrame, actions: DataFrame, models: list[str] = config.MODELS, block: int = 256,
                  stretch: int = 1_000_000, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """W0 (C12-C14, W1, W2, W6): replay actions in order on the filings' states.

    ``actions`` is (filing_id, seq, action, model); ``seq`` is a whole number, unique per filing.  Returns
    the filings after the batch and one outcome row per action, whose ``reason`` is null when it was
    accepted.  A filing without a status accepts nothing, nor is a null action accepted.

    Actions are numbered in stretches of the sequence and cut into blocks, so a filing with any number
    of them is spread over many tasks.  Only of filings with several blocks, each block is reduced to the
    table of its possible start and end states; :func:`_block_starts` gives every block its start, and all blocks are
    replayed side by side.  Blocks are written once, as whether there are such filings decides the plan.
    """
    number = F.row_number().over(Window.partitionBy("filing_id", "_stretch").orderBy("seq"))
    at = F.col("_stretch") * -(-stretch // block) + F.col("_part")
    blocks, _ = written(
        actions.select("filing_id", "seq", "action", "model", F.floor(F.col("seq") / stretch).alias("_stretch"))
        .withColumn("_part", F.floor((number - 1) / block)).groupBy("filing_id", "_stretch", "_part")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "action", "model"))).alias("todo"))
        .select("filing_id", at.alias("at"), "todo"), "blocks")
    now = filings.select("filing_id", F.struct(*[F.col(c).cast(t).alias(c) for c, t in _STATE_TYPES.items()]).alias("now"))
    starts = _block_starts(blocks, now, models, fan)

    def step(acc: Column, act: Column) -> Column:
        def entry(decided: Column) -> Column:
            return F.struct(act["seq"].alias("seq"), act["action"].alias("action"), acc["now"].alias("before"), decided.alias("after"))

        return let(_decide(acc["now"], act, models), lambda decided: F.struct(
            F.struct(*[decided[c].alias(c) for c in _STATE_TYPES]).alias("now"), F.concat(acc["log"], F.array(entry(decided))).alias("log")))

    log_type = (f"array<struct<seq:bigint,action:string,before:{_STATE},after:struct<reason:string,"
                "status:string,model:string,confidence:double>>>")
    joined = blocks.join(now, "filing_id", "left")
    if starts is not None:
        joined = joined.join(starts, ["filing_id", "at"], "left").withColumn("now", F.coalesce("start", "now")).drop("start")
    # Whatever side a join puts in memory, blocks are dealt out by number, or those of neighbouring filings meet in one task.
    joined = joined.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "filing_id", "at")
    first = F.struct("now", F.array().cast(log_type).alias("log"))
    folded = joined.filter("now IS NOT NULL").select("filing_id", "at", F.aggregate("todo", first, step).alias("r"))
    missing = (joined.filter("now IS NULL").select("filing_id", F.inline("todo"))
               .select("filing_id", "seq", "action", F.lit("filing not found").alias("reason")))
    outcomes = (folded.select("filing_id", F.inline("r.log"))
                .select("filing_id", "seq", "action", F.col("after.reason").alias("reason"),
                        F.col("before.status").alias("old_status"), F.col("after.status").alias("new_status"),
                        F.col("before.model").alias("old_model"), F.col("after.model").alias("new_model"))
                .unionByName(missing, allowMissingColumns=True))
    if starts is None:
        ended = folded.select("filing_id", F.col("r.now").alias("ended"))
    else:
        ended = folded.groupBy("filing_id").agg(F.max_by("r.now", "at").alias("ended"))
    moved = filings.join(ended, "filing_id", "left")
    for c in _STATE_TYPES:
        moved = moved.withColumn(c, F.when(F.col("ended").isNotNull(), F.col(f"ended.{c}")).otherwise(F.col(c)))
    return moved.drop("ended"), outcomes


# ---- the same rules, one action at a time ---------------------------------------------------

_NAMES = ["confirm", "override", "reset", "extract", "reextract", "finish", "fail", "approve", "unapprove", "export"]
_ODD_NAME, _GIVEN_LISTED, _GIVEN_UNLISTED = "\u0001odd", "\u0001given listed", "\u0001given unlisted"


class Rules:
    """All decisions of :func:`_decide` as a table, for code that holds one filing's state in Python.

    States and actions are told apart as in block tables; what a decision takes from them is filled in.
    """

    def __init__(self, spark: SparkSession, models: list[str] = config.MODELS):
        self.listed = {*models, "unknown"}
        cases = [(s, m, c, a, g) for s, m, c in [*_STARTS, (None, None, _LOW)] for a in [*_NAMES, _ODD_NAME, None]
                 for g in (None, "", _GIVEN_LISTED, _GIVEN_UNLISTED)]
        table = small_table(spark, cases, "status STRING, model STRING, confidence DOUBLE, action STRING, given STRING")
        decided = _decide(F.struct("status", "model", "confidence"), F.struct("action", F.col("given").alias("model")), [*models, _LISTED, _GIVEN_LISTED])
        self.decided = {tuple(r[:5]): tuple(r["d"]) for r in table.withColumn("d", decided).collect()}

    def _kind(self, model: str | None, listed: str, unlisted: str) -> str | None:
        return None if model is None else listed if model in self.listed else unlisted

    def __call__(self, state: tuple, action: str | None, given: str | None) -> tuple[str | None, tuple]:
        """The reason of refusal, if any, and the state after the action."""
        status, model, confidence = state
        sure = _HIGH if (confidence or 0.0) >= config.GATE_CONFIDENCE else _LOW
        start = (None, None, _LOW) if status is None else (
            status if status in config.FILING_STATES else _OTHER, self._kind(model, _LISTED, _UNLISTED), sure)
        name = action if action is None or action in _NAMES else _ODD_NAME
        wish = self._kind(given, _GIVEN_LISTED, _GIVEN_UNLISTED) if given else given
        reason, *after = self.decided[(*start, name, wish)]
        marks = {_OTHER: status, _LISTED: model, _UNLISTED: model, _GIVEN_LISTED: given, _GIVEN_UNLISTED: given, _ODD_NAME: action}
        if reason is not None and "\u0001" in reason:
            mark = reason[reason.index("\u0001"):]
            reason = reason.replace(mark, marks[mark])
        if status is None:
            return reason, state
        return reason, (marks.get(after[0], after[0]), marks.get(after[1], after[1]), confidence if after[2] in (_HIGH, _LOW) else after[2])


def feedback_rows(outcomes: DataFrame, actions: DataFrame, at: str) -> DataFrame:
    """Feedback rows of accepted confirmations and overrides."""
    done = outcomes.filter("reason IS NULL AND action IN ('confirm', 'override')")
    why = actions.select("filing_id", "seq", F.col("reason").alias("given"))
    default = F.when(F.col("action") == "confirm", F.lit(config.CONFIRM_REASON)
                     ).otherwise(F.coalesce(F.when(F.col("given") != "", F.col("given")),
                                            F.lit(config.OVERRIDE_REASON)))
    return done.join(why, ["filing_id", "seq"], "left").select(
        "filing_id", "seq", F.coalesce("old_model", F.lit("unknown")).alias("original_model"),
        F.col("new_model").alias("corrected_model"), default.alias("reason"), F.lit(at).alias("corrected_at"))


def filing_audit(outcomes: DataFrame, at: str) -> DataFrame:
    """Audit rows of accepted approve, unapprove and export actions."""
    names = {"approve": ("extracted", "approved", "approved"),
             "unapprove": ("approved", "extracted", "unapproved"),
             "export": ("approved", "exported", "exported")}
    done = outcomes.filter(F.col("reason").isNull() & F.col("action").isin(*names))

    def pick(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("action") == k, F.lit(v[i])) for k, v in names.items()])
    return done.select("filing_id", "seq", F.lit("__filing__").alias("field_path"), pick(0).alias("old_value"),
                       pick(1).alias("new_value"), pick(2).alias("action"), F.lit(at).alias("edited_at"))


def drop_results(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Results of re-extracted filings go, whether or not the gate then let them through."""
    gone = outcomes.filter("action = 'reextract' AND old_status IS NOT NULL").select("filing_id").distinct()
    return table.join(gone, "filing_id", "left_anti")


def accept_pending(fields: DataFrame, extractions: DataFrame, approved: DataFrame, at: str) -> DataFrame:
    """Pending fields of an approved filing's latest extraction become accepted."""
    latest = (latest_extraction(extractions).join(approved.select("filing_id").distinct(), "filing_id", "left_semi")
              .select("extraction_id", F.lit(True).alias("hit")))
    joined = fields.join(latest, "extraction_id", "left")
    accept = F.coalesce(F.col("hit") & (F.col("review_status") == "pending"), F.lit(False))
    return joined.withColumns({
        "reviewed_at": F.when(accept, F.lit(at)).otherwise(F.col("reviewed_at")),
        "review_status": F.when(accept, F.lit("accepted")).otherwise(F.col("review_status"))}).drop("hit")


def field_view(fields: DataFrame, threshold: float = config.LOW_FIELD_CONFIDENCE) -> DataFrame:
    """Decoded values, defaults, and the low-confidence flag (0 and null count as 1)."""
    conf = F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(1.0))
    return fields.select(
        "field_id", "field_path", decode_json(F.col("value_json")).alias("value_json"), "confidence",
        "not_found", decode_json(F.col("reviewed_json")).alias("reviewed_json"),
        F.coalesce("review_status", F.lit("pending")).alias("review_status"),
        (conf < threshold).alias("low_confidence"), F.coalesce("source", F.lit("llm")).alias("source"))


def review_fields(fields: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviews (filing_id, field_id, seq, review_status, reviewed_json, reviewed_at) on fields.

    Returns updated fields, audit rows, and rejected reviews.  A review without a value accepts
    the extracted one; the audit's old value is what the review before it left.
    """
    known = fields.select("field_id", F.col("filing_id").alias("owner"), "field_path", "value_json",
                          F.col("reviewed_json").alias("first_reviewed"))
    judged = reviews.join(known, "field_id", "left").withColumn(
        "problem", F.when(~F.coalesce(F.col("review_status").isin("accepted", "corrected", "rejected"), F.lit(False)),
                          F.lit("review_status must be accepted | corrected | rejected"))
        .when(~F.col("owner").eqNullSafe(F.col("filing_id")) | F.col("owner").isNull(), F.lit("field result not found")))
    # All three results read this; without it the join of reviews and fields would run for each of them.
    judged = reliable_checkpoint(judged.drop("owner"))
    good = judged.filter("problem IS NULL").withColumn("new_value", F.coalesce("reviewed_json", "value_json"))
    latest = good.groupBy("field_id").agg(F.max_by(
        F.struct("new_value", "review_status", "reviewed_at"), "seq").alias("r"))
    updated = fields.join(latest, "field_id", "left").withColumns({
        "reviewed_json": F.when(F.col("r").isNotNull(), F.col("r.new_value")).otherwise(F.col("reviewed_json")),
        "review_status": F.coalesce("r.review_status", "review_status"),
        "reviewed_at": F.when(F.col("r").isNotNull(), F.col("r.reviewed_at")).otherwise(F.col("reviewed_at"))}).drop("r")
    with_old = previous_known(good, ["field_id"], "seq", F.struct("new_value"), "before")
    audit = with_old.select(
        "filing_id", "field_path", "seq",
        F.when(F.col("before").isNotNull(), F.col("before.new_value")).otherwise(F.col("first_reviewed")).alias("old_value"),
        "new_value", F.col("review_status").alias("action"), F.col("reviewed_at").alias("edited_at"))
    rejected = judged.filter("problem IS NOT NULL").select("field_id", "seq", F.col("problem").alias("reason"))
    return updated, audit, rejected


def list_filings(filings: DataFrame, status: str | None = None, model: str | None = None,
                 cusip: str | None = None) -> DataFrame:
    """Filings by status, model and CUSIP, newest first, features decoded where they are JSON."""
    rows = filings
    if status:
        rows = rows.filter(F.col("status") == status)
    if model:
        rows = rows.filter(F.col("model") == model)
    if cusip:
        rows = rows.filter(F.col("cusip") == cusip.upper())
    features = F.try_parse_json("product_features")
    return rows.withColumn("product_features", F.when(features.isNotNull(), F.to_json(features))).orderBy(
        F.desc_nulls_last("ingest_timestamp"), "filing_id")


def facets(filings: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values, sorted."""
    return filings.filter(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column)


def search_filings(filings: DataFrame, status: str = "", issuer: str = "", model: str = "",
                   cusip: str = "") -> DataFrame:
    """All given filters at once; the CUSIP is matched as a part, in any case."""
    rows = filings
    for column, wanted in (("status", status), ("issuer_name", issuer), ("model", model)):
        if wanted:
            rows = rows.filter(F.col(column) == wanted)
    return rows.filter(F.lower("cusip").contains(cusip.lower())) if cusip else rows


def filter_fields(fields: DataFrame, name: str = "", hide_missing: bool = False) -> DataFrame:
    """Fields whose path contains the text, optionally only those found."""
    view = fields.filter(F.lower("field_path").contains(name.lower())) if name else fields
    return view.filter(~F.col("not_found")) if hide_missing else view


def field_stats(fields: DataFrame, threshold: float = config.LOW_FIELD_CONFIDENCE) -> DataFrame:
    """Total, found, found with low confidence, and reviewed fields per extraction."""
    conf = F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(1.0))
    return fields.groupBy("extraction_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("not_found")).alias("found"),
        F.count_if(~F.col("not_found") & (conf < threshold)).alias("low_confidence"),
        F.count_if(F.col("review_status").isin("accepted", "corrected")).alias("reviewed"))


def delete_filings(deleted: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Remove filings and everything that belongs to them from each table."""
    gone = deleted.select("filing_id").distinct()
    return [t.join(gone, "filing_id", "left_anti") for t in tables]


def lookup(table: DataFrame, **keys: str) -> DataFrame:
    """Rows by key; an absent key gives an empty result.  The filter reaches the scan."""
    rows = table
    for column, value in keys.items():
        rows = rows.filter(F.col(column) == value)
    return rows
