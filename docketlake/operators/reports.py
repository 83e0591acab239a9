"""Reports over corpora, benches, runs and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_audit(rows: DataFrame, id: str, digest: str, label: str) -> DataFrame:
    """(measure, n): rows, distinct contents, contents that stand more than once, with unlike labels, ids of unlike contents."""
    by_text = rows.groupBy(digest).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    by_id = rows.groupBy(id).agg(F.count_distinct(digest).alias("n"))
    a = by_text.agg(F.sum("n").alias("rows"), F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(F.col("labels") > 1).alias("conflicting_labels"))
    b = by_id.agg(F.count_if(F.col("n") > 1).alias("id_collisions"))
    names = ["rows", "contents", "duplicated", "conflicting_labels", "id_collisions"]
    return a.join(b).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("long") for n in names]))).alias("measure", "n"))


def format_audit(problems: DataFrame) -> DataFrame:
    """(rule, n, example): how often each rule is broken, and the first row that does."""
    return problems.groupBy("rule").agg(F.count("*").alias("n"), F.min("row_key").alias("example"))


def persona_report(decisions: DataFrame, least_cases: int, bias: float, disagreement: float, widest: float) -> DataFrame:
    """One row a judge of its decisions (judge, case_id, result, abstain_reason, gap, both_valid, issues_abstained, issues).

    cases; decided; disagreement_rate: abstentions because the two orders disagreed, of the cases with both opinions
    valid, and whether that is over `disagreement`; issue_disagreement_rate over those cases; gaps: count, smallest,
    median, greatest and how many are over `widest`; top_wins: the wins of the role that won more; biased: that role, once `least_cases` are
    decided, has won more than `bias` of the decided ones. A rate without a case is null.
    """
    valid = F.coalesce("both_valid", F.lit(False))
    wins = decisions.filter("result is not null").groupBy("judge", "result").agg(F.count("*").alias("n")).groupBy("judge").agg(F.max("n").alias("top"))
    g = decisions.groupBy("judge").agg(
        F.count("*").alias("cases"), F.count("result").alias("decided"), F.count_if(valid).alias("valid"), F.count_if(F.col("abstain_reason") == "ORDER_SWAP_DISAGREEMENT").alias("swapped"),
        F.sum(F.when(valid, F.col("issues_abstained"))).alias("ia"), F.sum(F.when(valid, F.col("issues"))).alias("i"),
        F.count("gap").alias("gaps"), F.min("gap").alias("gap_min"), F.median("gap").alias("gap_median"), F.max("gap").alias("gap_max"), F.count_if(F.col("gap") > widest).alias("gaps_over"),
    )
    rate = F.try_divide("swapped", "valid")
    return g.join(wins, "judge", "left").select(
        "judge", "cases", "decided", rate.alias("disagreement_rate"), F.coalesce(rate > disagreement, F.lit(False)).alias("over_limit"), F.try_divide("ia", "i").alias("issue_disagreement_rate"),
        "gaps", "gap_min", "gap_median", "gap_max", "gaps_over", F.coalesce("top", F.lit(0)).alias("top_wins"),
        F.coalesce((F.col("decided") >= least_cases) & (F.try_divide(F.col("top"), F.col("decided")) > bias), F.lit(False)).alias("biased"),
    )


def advocacy(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(session_id, side, score): weighted dimensions, averaged over issues and orders; 0 for a side without scores."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return scores.groupBy("session_id", "side").agg(F.coalesce(F.avg(total), F.lit(0.0)).alias("score"))


def memory_proof(snapshots: DataFrame) -> DataFrame:
    """(run_id, frozen): whether every case left the memory as it found it. snapshots: run_id, case_id, before, after."""
    return snapshots.groupBy("run_id").agg(F.bool_and(F.col("before").eqNullSafe(F.col("after"))).alias("frozen"))


def evidence_available(points: DataFrame, record: DataFrame) -> DataFrame:
    """(case_id, issue_id, available): every point is IN_RECORD with an id that is in the record.

    points: case_id, issue_id, place, ids; record: case_id, record_id.
    """
    p = points.withColumn("p", F.monotonically_increasing_id() if "point_id" not in points.columns else F.col("point_id"))
    ids = p.select("p", "case_id", F.explode("ids").alias("record_id")).join(record.distinct(), ["case_id", "record_id"], "left_semi").select("p").distinct().withColumn("held", F.lit(True))
    ok = (F.col("place") == "IN_RECORD") & F.coalesce("held", F.lit(False))
    return p.join(ids, "p", "left").groupBy("case_id", "issue_id").agg(F.bool_and(ok).alias("available"))


def route_histogram(rows: DataFrame, by: Sequence[str], route: str) -> DataFrame:
    return rows.groupBy(*by, route).agg(F.count("*").alias("n"))


def run_listing(ledgers: DataFrame) -> DataFrame:
    """(run_id, seq, case_id, stages, session_id): a ledger's jobs in order with their stages as a map."""
    j = ledgers.select("run_id", F.posexplode("jobs").alias("seq", "j"))
    return j.select("run_id", F.col("seq").cast("long").alias("seq"), F.col("j.case_id").alias("case_id"), F.map_from_entries(F.transform("j.stages", lambda s: F.struct(s["stage"], s["status"]))).alias("stages"), F.col("j.session_id").alias("session_id"))


def arm_rates(drafts: DataFrame) -> DataFrame:
    """(arm, rejected_real, caught_mutations, mean_seconds) of drafts (arm, mutated, rejected, seconds)."""
    share = lambda mutated: F.avg(F.when(F.col("mutated") == mutated, F.col("rejected").cast("int")))
    return drafts.groupBy("arm").agg(share(False).alias("rejected_real"), share(True).alias("caught_mutations"), F.avg("seconds").alias("mean_seconds"))


def arm_differences(a: DataFrame, b: DataFrame, ordinal: str, errors: str) -> DataFrame:
    """Rows whose sorted errors differ between two arms, by ordinal; a row only one arm has differs too."""
    x, y = a.select(ordinal, F.array_sort(errors).alias("a")), b.select(ordinal, F.array_sort(errors).alias("b"))
    return x.join(y, ordinal, "full").filter(~F.col("a").eqNullSafe(F.col("b")))


def served_lessons(pinned: DataFrame, lessons: DataFrame) -> DataFrame:
    """(session_id, side, lesson_id): lessons a side was given, by its pinned map; without one by its family.

    pinned: session_id, side, family, pins (map of side to lesson ids, or null); lessons: lesson_id, family.
    """
    by_pin = pinned.filter("pins is not null").select("session_id", "side", F.explode(F.try_element_at("pins", F.col("side"))).alias("lesson_id"))
    by_family = pinned.filter("pins is null").join(lessons, "family").select("session_id", "side", "lesson_id")
    return by_pin.unionByName(by_family).distinct()


def lessons_from_the_future(plan: DataFrame, lessons: DataFrame) -> DataFrame:
    """One row (first_case, newest_source, undated, refused): a run is refused if a lesson's source is newer than its first
    case, or has no date. plan: decided; lessons: source_decided."""
    first = plan.agg(F.min("decided").alias("first_case"))
    new = lessons.agg(F.max("source_decided").alias("newest_source"), F.count_if(F.col("source_decided").isNull()).alias("undated"))
    return first.join(new).withColumn("refused", F.coalesce(F.col("first_case") < F.col("newest_source"), F.lit(False)) | (F.col("undated") > 0))


def trace_records(parts: dict[str, DataFrame], cache: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, ts, kind, payload): stores shaped as one trace, numbered by time within a session.

    parts: kind to a DataFrame (session_id, ts, payload[, key]); with a cache (key, answer) calls carry their answer.
    """
    out = None
    for kind, df in parts.items():
        key = F.col("key") if "key" in df.columns else F.lit(None).cast("string")
        one = df.select("session_id", "ts", F.lit(kind).alias("kind"), "payload", key.alias("key"))
        out = one if out is None else out.unionByName(one)
    if cache is not None:
        out = out.join(cache, "key", "left")
    w = Window.partitionBy("session_id").orderBy("ts", "kind", "payload")
    return out.withColumn("seq", F.row_number().over(w)).drop("key")


def threshold_agreement(readings: DataFrame) -> DataFrame:
    """(case_id, statute_id, parameter, usable): a dated value is usable only if every reading of the dates gives it."""
    g = readings.groupBy("case_id", "statute_id", "parameter").agg(F.count_distinct("value").alias("n"), F.count_if(F.col("value").isNull()).alias("lost"))
    return g.select("case_id", "statute_id", "parameter", ((F.col("n") == 1) & (F.col("lost") == 0)).alias("usable"))


def alternative_dates(dates: DataFrame, readings: DataFrame) -> DataFrame:
    """(reading, case_id, label, day): a case's dates under each reading, which replaces one label's date (null: absent).

    readings: reading, case_id, label, day.
    """
    base = dates.join(readings.select("reading", "case_id").distinct(), "case_id").select("reading", "case_id", "label", "day")
    kept = base.join(readings.select("reading", "case_id", "label"), ["reading", "case_id", "label"], "left_anti")
    return kept.unionByName(readings.select("reading", "case_id", "label", "day").filter("day is not null"))


def law_fingerprint(law: DataFrame, applied: Column) -> DataFrame:
    """(statute_id, version): sha256 of the record's JSON and what applies to it; this engine's own encoding."""
    content = F.to_json(F.struct(*[c for c in law.columns if c != "statute_id"]), {"ignoreNullFields": "false"})
    return law.select("statute_id", F.sha2(F.concat_ws("|", content, F.coalesce(applied, F.lit(""))), 256).alias("version"))


def recovered_union(sessions: DataFrame, recovered: DataFrame) -> DataFrame:
    """(session_id, lesson_ids): recovered lessons added, sorted and each once, to sessions in state REFLECTED only."""
    r = recovered.groupBy("session_id").agg(F.collect_set("lesson_id").alias("more"))
    add = F.when(F.col("state") == "REFLECTED", F.coalesce("more", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return sessions.join(r, "session_id", "left").select("session_id", F.array_sort(F.array_union(F.coalesce("lesson_ids", F.array().cast("array<string>")), add)).alias("lesson_ids"))


def period_rule(applied: DataFrame) -> DataFrame:
    """(statute_id, years, excluded_from, excluded_to, minimum_days): the limitation rule in a statute's applied parameters.

    applied: statute_id, parameter, kind (int, bool, range, other), n, from, to. No rule without an int period.
    """
    pick = lambda p, k, c: F.max(F.when((F.col("parameter") == p) & (F.col("kind") == k), F.col(c)))
    g = applied.groupBy("statute_id").agg(
        pick("period_years", "int", "n").alias("years"), pick("excluded_window", "range", "from").alias("excluded_from"), pick("excluded_window", "range", "to").alias("excluded_to"), pick("minimum_days", "int", "n").alias("minimum_days")
    )
    return g.filter("years is not null")


def held_cards(chosen: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, uid): chosen ids that a returned card carries, by uid, else by a bare id only one of them carries."""
    by_id = cards.groupBy("query_id", "precedent_id").agg(F.count_distinct("uid").alias("n"), F.min("uid").alias("one")).filter("n = 1").select("query_id", F.col("precedent_id").alias("id"), F.col("one").alias("uid"))
    by_uid = cards.select("query_id", F.col("uid").alias("id"), "uid")
    return chosen.join(by_uid.unionByName(by_id).distinct(), ["query_id", "id"]).select("query_id", "uid").distinct()


def desk_answers(hits: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, n_new, note): cards of an answer that aren't held already."""
    new = hits.join(held.select("uid").distinct().withColumn("h", F.lit(True)), "uid", "left").groupBy("query_id").agg(F.count_if(F.col("h").isNull()).alias("n_new"), F.count("*").alias("n"))
    return new.select("query_id", "n_new", F.when(F.col("n_new") == 0, "NOTHING_NEW").otherwise("NEW").alias("note"))
