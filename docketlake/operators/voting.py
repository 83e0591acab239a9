"""Judges' votes: folding orders, findings, verdicts and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_judges(opinions: DataFrame, means: Sequence[str] = ()) -> DataFrame:
    """(session_id, judge, winner, reason, means): one vote a judge. opinions: session_id, judge, ord, valid, result; the
    columns `means` are averaged over the judge's opinions.

    Any invalid opinion: no winner, INVALID. One order decides alone. Two orders that agree decide; that differ:
    no winner, ORDER_SWAP_DISAGREEMENT.
    """
    g = opinions.groupBy("session_id", "judge").agg(F.bool_and("valid").alias("ok"), F.count_distinct("result").alias("n"), F.min("result").alias("result"), F.count("*").alias("orders"), *[F.avg(c).alias(c) for c in means])
    return g.select(
        "session_id", "judge", F.when(F.col("ok") & (F.col("n") == 1), F.col("result")).alias("winner"),
        F.when(~F.col("ok"), "INVALID").when(F.col("n") != 1, "ORDER_SWAP_DISAGREEMENT").when(F.col("orders") == 1, "ONE_ORDER").otherwise("AGREED").alias("reason"), *means,
    )


def issue_findings(votes: DataFrame, least: int) -> DataFrame:
    """(session_id, issue_id, finding): the side a strict majority of deciding judges upholds, if at least `least` decide.

    votes: session_id, issue_id, judge, upholds (null: undecided). Otherwise finding is null.
    """
    n = votes.filter("upholds is not null").groupBy("session_id", "issue_id", "upholds").agg(F.count("*").alias("n"))
    g = n.groupBy("session_id", "issue_id").agg(F.sum("n").alias("all"), F.max(F.struct("n", "upholds")).alias("top"))
    every = votes.select("session_id", "issue_id").distinct().join(g, ["session_id", "issue_id"], "left")
    won = (F.col("top.n") * 2 > F.col("all")) & (F.col("all") >= least)
    return every.select("session_id", "issue_id", F.when(won, F.col("top.upholds")).alias("finding"))


def verdicts(votes: DataFrame, least: int, margin: float | None = None) -> DataFrame:
    """(session_id, winner, status) of folded votes (session_id, judge, winner, score, accuracy by side as maps).

    Fewer than `least` deciding judges: UNSTABLE_TOO_FEW. The side with most votes wins: MAJORITY (of two sides, as
    hearings have; of more sides it may be a plurality). A tie is EVEN_SPLIT unless
    `margin` is given; then the side whose mean score, or else accuracy, is ahead by the margin or more wins
    (TIE_SCORE, TIE_ACCURACY), otherwise UNBROKEN_TIE.
    """
    d = votes.filter("winner is not null")
    n = d.groupBy("session_id", "winner").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("accuracy"), 6).alias("accuracy"))
    ranked = n.groupBy("session_id").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "winner", "score", "accuracy"))).alias("v"))
    out = votes.select("session_id").distinct().join(ranked, "session_id", "left")
    a, b = F.try_element_at("v", F.lit(1)), F.try_element_at("v", F.lit(2))
    few = F.coalesce("all", F.lit(0)) < least
    tied = b.isNotNull() & (a["n"] == b["n"])
    if margin is None:
        return out.select("session_id", F.when(~few & ~tied, a["winner"]).alias("winner"), F.when(few, "UNSTABLE_TOO_FEW").when(tied, "EVEN_SPLIT").otherwise("MAJORITY").alias("status"))
    by_score = F.abs(a["score"] - b["score"]) >= margin
    by_accuracy = F.abs(a["accuracy"] - b["accuracy"]) >= margin
    ahead = lambda f: F.when(a[f] > b[f], a["winner"]).otherwise(b["winner"])
    return out.select(
        "session_id",
        F.when(few, None).when(~tied, a["winner"]).when(by_score, ahead("score")).when(by_accuracy, ahead("accuracy")).alias("winner"),
        F.when(few, "UNSTABLE_TOO_FEW").when(~tied, "MAJORITY").when(by_score, "TIE_SCORE").when(by_accuracy, "TIE_ACCURACY").otherwise("UNBROKEN_TIE").alias("status"),
    )


def order_gap(scores: DataFrame) -> DataFrame:
    """(session_id, judge, gap): the greatest difference of a score between two orders, over issues and sides in both.

    scores: session_id, judge, ord, issue_id, side, score.
    """
    per = scores.groupBy("session_id", "judge", "issue_id", "side").agg(F.count_distinct("ord").alias("orders"), (F.max("score") - F.min("score")).alias("gap"))
    return per.filter("orders > 1").groupBy("session_id", "judge").agg(F.max("gap").alias("gap"))


def bench_metrics(opinions: DataFrame) -> DataFrame:
    """(order_flips, issue_flips, first_wins) over valid opinions (session_id, judge, ord, result, issues, first).

    An issue that one order lacks counts as equal. first: the side presented first in that order.
    """
    ok = opinions.filter("valid")
    by_judge = ok.groupBy("session_id", "judge").agg(F.count_distinct("result").alias("n"))
    issues = ok.select("session_id", "judge", "ord", F.inline("issues")).groupBy("session_id", "judge", "issue_id").agg(F.count_distinct("upholds").alias("n"))
    return (
        by_judge.agg(F.count_if(F.col("n") > 1).alias("order_flips"))
        .join(issues.agg(F.count_if(F.col("n") > 1).alias("issue_flips")))
        .join(ok.agg(F.count_if(F.col("result") == F.col("first")).alias("first_wins")))
    )


def verdict_histogram(verdict: DataFrame) -> DataFrame:
    """(key, n): winners, and undecided ones by their status."""
    return verdict.groupBy(F.coalesce("winner", F.concat(F.lit("UNSTABLE_"), "status")).alias("key")).agg(F.count("*").alias("n"))


def single_order(case_id, orders: tuple[str, str] = ("AB", "BA")):
    """The order a case starts with: by the parity of the last digit of its sha256."""
    digit = F.conv(F.substring(F.sha2(case_id, 256), 64, 1), 16, 10).cast("int")
    return F.when(digit % 2 == 0, orders[0]).otherwise(orders[1])


def opinion_problems(opinions: DataFrame, issues: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a problem (session_id, judge, ord, problem, detail): missing, unknown or repeated issues, unknown rules.

    opinions: session_id, judge, ord, issues (issue_id, upholds, rules); issues: session_id, issue_id; rules:
    session_id, rule.
    """
    key = ["session_id", "judge", "ord"]
    said = opinions.select(*key, F.inline_outer("issues")).filter("issue_id is not null")
    asked = opinions.select(*key).distinct().join(issues, "session_id")
    problem = lambda df, name, detail: df.select(*key, F.lit(name).alias("problem"), F.col(detail).alias("detail"))
    missing = problem(asked.join(said, [*key, "issue_id"], "left_anti"), "MISSING_ISSUE", "issue_id")
    unknown = problem(said.join(issues, ["session_id", "issue_id"], "left_anti"), "UNKNOWN_ISSUE", "issue_id")
    repeated = problem(said.groupBy(*key, "issue_id").count().filter("count > 1"), "REPEATED_ISSUE", "issue_id")
    cited = said.select(*key, F.explode("rules").alias("rule"))
    bad_rule = problem(cited.join(rules, ["session_id", "rule"], "left_anti"), "UNKNOWN_RULE", "rule")
    empty = problem(said.filter("size(rules) = 0"), "NO_RULE", "issue_id")
    return missing.unionByName(unknown).unionByName(repeated).unionByName(bad_rule).unionByName(empty).distinct()
