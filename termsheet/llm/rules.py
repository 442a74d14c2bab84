"""Quality rules with risk-controlled thresholds (operator 9); DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termsheet.functions.text import let
from termsheet.llm import common

SYMBOLS = "#*$%&|<>"
#: Rule, numerator, denominator and the cutoffs that are tested: a text fails where numerator > cutoff * denominator.
RULES = [
    ("symbols", "n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    ("lines", "n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    ("repeats", "n_repeat_words", "n_words", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5)),
    ("capitals", "n_capitals", "word_chars", (0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    ("shouts", "n_shouts", "n_words", (0.1, 0.2, 0.3, 0.5, 0.75, 1.0)),
]


def _repeat_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more, the first one included."""
    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(v: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(v, j)["h"] == e["h"], F.lit(False))
            flagged = F.transform(v, lambda e, j: F.when(same(e, j + 1) | ((j > 0) & same(e, F.greatest(j - 1, F.lit(0)))), e["i"]))
            return F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(ordered, lambda v: let(starts(v), length))

    windows = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 3),
                                    lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
    return let(w, lambda v: F.when(F.size(v) < 4, F.lit(0)).otherwise(
        let(windows(v), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))))


def measures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang and the counts that the rules compare; a null text counts as empty."""
    dropped = lambda t, chars: F.length(F.translate(t, chars, ""))
    t, length = F.col("t"), F.length("t")
    lines = F.filter(F.split(t, "\n"), lambda l: F.translate(l, " \t\n\x0b\f\r", "") != "")
    counts = let(common.words(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    kept = lambda l, kind: F.size(kind(l))
    by_line = let(lines, lambda l: F.struct(F.size(l).alias("n"), kept(l, F.array_distinct).alias("d")))
    return (
        docs.select("doc_id", "lang", common.text_or_empty().alias("t"))
        .select(
            "doc_id", "lang", counts.alias("c"), by_line.alias("l"),
            dropped(t, " \t\n\x0b\f\r").cast("long").alias("word_chars"),
            (length - dropped(t, SYMBOLS)).cast("long").alias("n_symbols"),
            (length - dropped(t, "!")).cast("long").alias("n_shouts"),
            (length - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        )
        .select(
            "doc_id", "lang", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
            (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"), F.col("c.r").cast("long").alias("n_repeat_words"),
            F.col("l.n").cast("long").alias("n_lines"), "n_capitals", "n_shouts",
        )
    )


def _fails(numerator: str, denominator: str, cutoff: Column) -> Column:
    return F.col(numerator) > cutoff * F.col(denominator)


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """Logarithm of P(X <= k) for n draws with chance p, summed term by term in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(state["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(state["sum"], term) - top))).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), step, lambda s: s["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, rules=None, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per (lang, rule, cutoff): good labelled texts, those that fail, and whether the cutoff is safe.

    ``risk`` bounds the share of good texts of a stratum that all rules together may reject, so a rule may
    reject risk / rules.  A cutoff is safe if the exact binomial (Clopper-Pearson) upper bound of its false
    rejections is at most that, at confidence 1 - delta / tests; tests counts every stratum, rule and cutoff
    (Bonferroni), so all guarantees hold together with probability 1 - delta.  ``chosen`` marks the
    strictest safe cutoff.  Texts with several labels count as good only if all of them say so.
    """
    rules = RULES if rules is None else rules
    share = risk / len(rules)
    good = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    found = measured.where(~base_failed()).join(good, "doc_id", "left_semi")
    tests = [(name, c, f"_{i}_{j}", _fails(a, b, F.lit(c))) for i, (name, a, b, cs) in enumerate(rules) for j, c in enumerate(cs)]
    sums = found.groupBy("lang").agg(F.count("*").alias("n_good"), *[F.sum(f.cast("long")).alias(key) for *_, key, f in tests])
    rows = sums.select("lang", "n_good", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(key).alias("n_failed")) for name, c, key, _ in tests
    ])).alias("t")).select("lang", "n_good", "t.*")
    n, k = F.col("n_good"), F.col("n_failed")
    limit = F.log(F.lit(float(delta)) / F.count("*").over(Window.partitionBy()))
    rows = rows.withColumn("_limit", limit)
    safe = F.when(k > n * F.lit(share), F.lit(False)).otherwise(log_binomial_cdf(k, n, share) <= F.col("_limit"))
    rows = rows.withColumn("safe", safe).drop("_limit")
    strictest = F.min(F.when(F.col("safe"), F.col("cutoff"))).over(Window.partitionBy("lang", "rule"))
    return rows.withColumn("chosen", F.coalesce(F.col("cutoff") == strictest, F.lit(False)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, chosen: DataFrame, rules=None) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the names of the rules that a text fails (``failed_rules``).

    A rule without a safe cutoff in a text's stratum rejects nothing there.  One row per stratum is
    joined, at most as many as there are languages.
    """
    rules = RULES if rules is None else rules
    mark = F.col("lang").isNull().alias("_no_lang"), F.coalesce("lang", F.lit("")).alias("_lang")
    per_lang = chosen.where("chosen").groupBy(*mark).agg(*[
        F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_cut_{name}") for name, *_ in rules])
    joined = measured.select("*", *mark).join(per_lang, ["_no_lang", "_lang"], "left")
    failed = F.filter(F.array(*[F.when(_fails(a, b, F.col(f"_cut_{name}")), F.lit(name)) for name, a, b, _ in rules]), lambda r: r.isNotNull())
    return (
        joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_no_lang", "_lang", *[f"_cut_{name}" for name, *_ in rules])
    )


def risk_controlled(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Base checks and rules whose cutoffs provably reject few good texts, per language.

    All labelled texts that pass the base checks are the holdout: the grid of cutoffs is fixed beforehand,
    so nothing else is learnt from them.  One row per document: doc_id, lang, the counts, ``base_failed``,
    ``failed_rules``, ``kept``.  Null texts count as empty (they fail the base checks), a null language is
    a stratum, ids without labels and labels without texts are ignored, repeated rows are judged alike, no
    labels means no safe cutoff, an empty table gives an empty result; extra columns are not looked at.
    The counts are checkpointed, because thresholds and verdicts both need them.
    """
    from termsheet.session import reliable_checkpoint

    measured = reliable_checkpoint(measures(docs))
    return judge(measured, cutoffs(measured, labels, risk=risk, delta=delta))
