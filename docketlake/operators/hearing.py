"""Hearings: claims, citations, attempts, rewards and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import squeeze


def claim_problems(claims: DataFrame, record: DataFrame, visible: DataFrame) -> DataFrame:
    """(session_id, claim_id, problem, detail): record ids that aren't in the record, statutes that aren't visible.

    claims: session_id, claim_id, record_ids, statute_id; record: session_id, record_id; visible: session_id, statute_id.
    """
    ids = claims.select("session_id", "claim_id", F.explode("record_ids").alias("record_id")).join(record, ["session_id", "record_id"], "left_anti")
    law = claims.filter("statute_id is not null").join(visible, ["session_id", "statute_id"], "left_anti")
    key = ["session_id", "claim_id"]
    return ids.select(*key, F.lit("UNKNOWN_RECORD").alias("problem"), F.col("record_id").alias("detail")).unionByName(law.select(*key, F.lit("STATUTE_NOT_VISIBLE").alias("problem"), F.col("statute_id").alias("detail"))).distinct()


def confirmed_points(points: DataFrame, turns: DataFrame) -> DataFrame:
    """Points (session_id, turn, side, quote) whose turn is that side's, holds the quote, and has a later opposing turn."""
    t = turns.select("session_id", "turn", F.col("side").alias("speaker"), "text")
    last = turns.groupBy("session_id", "side").agg(F.max("turn").alias("last"))
    j = points.join(t, ["session_id", "turn"]).filter((F.col("speaker") == F.col("side")) & F.contains(squeeze(F.col("text")), squeeze(F.col("quote"))))
    other = last.withColumnRenamed("side", "other")
    return j.join(other, "session_id").filter((F.col("other") != F.col("side")) & (F.col("last") > F.col("turn"))).select("session_id", "turn", "side", "quote").distinct()


def confirmed_contradictions(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs (session_id, claim_a, claim_b) of existing claims of one side from different turns."""
    c = claims.select("session_id", "claim_id", "side", "turn")
    a, b = (c.select("session_id", *[F.col(x).alias(f"{x}_{s}") for x in ("claim_id", "side", "turn")]) for s in "ab")
    j = pairs.select("session_id", F.col("claim_a").alias("claim_id_a"), F.col("claim_b").alias("claim_id_b")).join(a, ["session_id", "claim_id_a"]).join(b, ["session_id", "claim_id_b"])
    return j.filter("side_a = side_b and turn_a <> turn_b").select("session_id", F.col("side_a").alias("side"), F.col("claim_id_a").alias("claim_a"), F.col("claim_id_b").alias("claim_b"))


def context(turns: DataFrame) -> DataFrame:
    """(session_id, turn, n_before, last_opposing): what had been said before each turn; closings don't count.

    A session's turns are few, so the self-join is bounded by the square of a session's length.
    """
    said = turns.filter("kind <> 'CLOSING'").select(F.col("session_id").alias("sid"), F.col("turn").alias("t"), F.col("side").alias("s"))
    j = turns.join(said, (F.col("session_id") == F.col("sid")) & (F.col("t") < F.col("turn")), "left")
    return j.groupBy("session_id", "turn", "side").agg(F.count("t").alias("n_before"), F.max(F.when(F.col("s") != F.col("side"), F.col("t"))).alias("last_opposing")).drop("side")


def side_metrics(private: DataFrame) -> DataFrame:
    """(session_id, side, turns, attempts, hard_errors, first_try_rate, flagged, warnings) over private turns.

    private: session_id, side, outcome, attempts, hard_errors_by_attempt (array of arrays), warnings.
    """
    return private.groupBy("session_id", "side").agg(
        F.count("*").alias("turns"), F.sum("attempts").alias("attempts"), F.sum(F.size(F.flatten("hard_errors_by_attempt"))).alias("hard_errors"),
        F.avg((F.col("attempts") == 1).cast("int")).alias("first_try_rate"), F.count_if(F.col("outcome") == "FLAGGED").alias("flagged"), F.sum(F.size("warnings")).alias("warnings"),
    )


def rebuttal_depth(points: DataFrame) -> DataFrame:
    """(session_id, side, depth, statuses): the answered share of points by centrality, null without any weight."""
    n = points.groupBy("session_id", "side", "status").agg(F.count("*").alias("n"), F.sum("centrality").alias("w"))
    return n.groupBy("session_id", "side").agg(
        F.try_divide(F.sum(F.when(F.col("status") == "ANSWERED", F.col("w")).otherwise(0)), F.sum("w")).alias("depth"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses")
    )


def consistency(contradictions: Column, claims: Column) -> Column:
    """1 less the contradictions a claim, not below 0; null without claims."""
    return F.when(claims > 0, 1 - F.least(F.lit(1.0), contradictions / claims))


def mean_of_available(*parts: Column) -> Column:
    """The mean of the parts that are not null; null if all are."""
    there = F.array_compact(F.array(*parts))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def grounded(values: DataFrame) -> DataFrame:
    """Adds `kept`: a value is kept only if its quote stands in the text word for word and holds the value's digits."""
    digits = F.regexp_replace(F.col("value").cast("string"), "[^0-9]", "")
    held = F.contains(F.regexp_replace("quote", "[^0-9]", ""), digits)
    return values.withColumn("kept", F.coalesce(F.contains(F.col("text"), F.col("quote")) & held & (F.length("quote") > 0), F.lit(False)))


def citation_tiers(assessments: DataFrame) -> DataFrame:
    """(session_id, claim_id, tier, entailment) of claims with citations (entailment, verbatim).

    A verdict counts only with its own quote, verbatim; without it, it is neutral. tier is VERIFIED if every citation
    supports, else UNVERIFIABLE; entailment is CONTRADICTS if any contradicts, SUPPORTS if all support, else NEUTRAL.
    """
    said = F.when(F.coalesce("verbatim", F.lit(False)), F.col("entailment")).otherwise("NEUTRAL")
    g = assessments.groupBy("session_id", "claim_id").agg(F.bool_or(said == "CONTRADICTS").alias("bad"), F.bool_and(said == "SUPPORTS").alias("good"))
    return g.select(
        "session_id", "claim_id", F.when(F.col("good"), "VERIFIED").otherwise("UNVERIFIABLE").alias("tier"),
        F.when(F.col("bad"), "CONTRADICTS").when(F.col("good"), "SUPPORTS").otherwise("NEUTRAL").alias("entailment"),
    )


def attempt_fold(attempts: DataFrame, cap: int) -> DataFrame:
    """(session_id, turn, attempts, outcome): until an attempt is clean, or cap + 1 attempts; the last one decides.

    attempts: session_id, turn, attempt, hard_errors, warnings. Attempts after the first clean one never happened.
    """
    clean = F.min(F.when(F.size("hard_errors") == 0, F.col("attempt")))
    first = attempts.groupBy("session_id", "turn").agg(clean.alias("clean"), F.max("attempt").alias("top"))
    last = first.withColumn("attempt", F.least(F.coalesce("clean", "top"), F.lit(cap + 1)))
    j = last.join(attempts, ["session_id", "turn", "attempt"])
    outcome = F.when(F.size("hard_errors") > 0, "FLAGGED").when(F.size("warnings") > 0, "PASS_WITH_NOTES").otherwise("PASS")
    return j.select("session_id", "turn", F.col("attempt").alias("attempts"), outcome.alias("outcome"))


def prerequisites_left(addressed: DataFrame, required: DataFrame) -> DataFrame:
    """(session_id, statute_id, left): places of a statute's prerequisites no turn addressed. required: statute_id, n."""
    got = addressed.select("session_id", "statute_id", F.explode_outer("places").alias("p")).groupBy("session_id", "statute_id").agg(F.collect_set("p").alias("got"))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return got.join(required, "statute_id").select("session_id", "statute_id", F.array_sort(F.array_except(every, "got")).alias("left"))


def rule_coverage(addressed: DataFrame) -> DataFrame:
    """(session_id, coverage): addressed prerequisites of all, 1 where there is none. addressed: session_id, n_addressed, n_items."""
    return addressed.groupBy("session_id").agg(F.coalesce(F.try_divide(F.sum("n_addressed"), F.sum("n_items")), F.lit(1.0)).alias("coverage"))


def dedupe_errors(errors: DataFrame, excused: DataFrame) -> DataFrame:
    """(session_id, code, statute_id, detail, record_ids): first per code and statute, record ids united; excused values drop.

    errors: session_id, ord, code, statute_id, field, value, detail, record_ids; excused: session_id, field, value.
    """
    left = errors.join(excused, ["session_id", "field", "value"], "left_anti")
    return left.groupBy("session_id", "code", "statute_id").agg(F.min_by("detail", "ord").alias("detail"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("record_ids")))).alias("record_ids"))


def closed_codes(errors: DataFrame, codes: DataFrame) -> DataFrame:
    """Errors whose code is not on the closed list."""
    return errors.join(codes.select("code").distinct(), "code", "left_anti")


def baseline_predictions(predicted: DataFrame, framed: DataFrame) -> DataFrame:
    """Predictions (case_id, issue_id, favours) of framed issues that were predicted exactly once."""
    once = predicted.groupBy("case_id", "issue_id").agg(F.count("*").alias("n"), F.min("favours").alias("favours")).filter("n = 1").drop("n")
    return once.join(framed.select("case_id", "issue_id").distinct(), ["case_id", "issue_id"], "left_semi")


def grounds_balance(grounds: DataFrame, most: float) -> DataFrame:
    """(case_id, unbalanced): whether one side has more than `most` times the other's grounds, or their length (floor 1)."""
    g = grounds.groupBy("case_id").agg(*[f(s) for s in "AB" for f in (lambda s: F.count_if(F.col("side") == s).alias(f"n_{s}"), lambda s: F.sum(F.when(F.col("side") == s, F.length("text")).otherwise(0)).alias(f"l_{s}"))])
    ratio = lambda a, b: F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))
    return g.select("case_id", ((ratio(F.col("n_A"), F.col("n_B")) > most) | (ratio(F.col("l_A"), F.col("l_B")) > most)).alias("unbalanced"))


def condense(entries: DataFrame, budget: int) -> DataFrame:
    """(session_id, shown, n_short, n_dropped): the fullest form of a transcript that fits.

    entries: session_id, turn, full, short (lengths). The oldest turns are shortened first, one by one; only then are
    the oldest dropped. All 2N + 1 forms of a session follow from running sums; the first that fits counts.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("turn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = entries.withColumn("i", F.row_number().over(w)).withColumn("saved", F.sum(F.col("full") - F.col("short")).over(upto)).withColumn("gone", F.sum("short").over(upto))
    total = entries.groupBy("session_id").agg(F.sum("full").alias("f"), F.sum("short").alias("s"), F.count("*").alias("n"))
    forms = (
        total.select("session_id", F.lit(0).alias("k"), F.col("f").alias("shown"))
        .unionByName(t.join(total, "session_id").select("session_id", F.col("i").alias("k"), (F.col("f") - F.col("saved")).alias("shown")))
        .unionByName(t.join(total, "session_id").select("session_id", (F.col("n") + F.col("i")).cast("int").alias("k"), (F.col("s") - F.col("gone")).alias("shown")))
    )
    best = forms.filter(F.col("shown") <= budget).groupBy("session_id").agg(F.min(F.struct("k", "shown")).alias("b"))
    return total.join(best, "session_id").select("session_id", "b.shown", F.least(F.col("b.k").cast("long"), F.col("n")).alias("n_short"), F.greatest(F.col("b.k") - F.col("n"), F.lit(0)).alias("n_dropped"))
