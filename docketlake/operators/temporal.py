"""Dated rules: as-of resolution, overlaps, limitation periods, splits, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covers(start: Column, end: Column, day: Column) -> Column:
    """Inclusive at both ends; a null bound is open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def windows_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1.isNull() | e2.isNull() | (s1 <= e2)) & (s2.isNull() | e1.isNull() | (s2 <= e1))


def case_dates(cases: DataFrame) -> DataFrame:
    """(case_id, label, day): the key dates of a case and its decision date under the label DECISION."""
    key = cases.select("case_id", F.explode_outer("key_dates").alias("d")).filter("d is not null").select("case_id", "d.label", "d.day")
    return key.unionByName(cases.select("case_id", F.lit("DECISION").alias("label"), F.col("decided_on").alias("day")).filter("day is not null"))


def resolve_statutes(law: DataFrame, overlay: DataFrame, dates: DataFrame, asked: DataFrame) -> DataFrame:
    """(case_id, statute_id, status, applied, unresolved) of the statutes a case asks for, as of the case's dates.

    asked: case_id, statute_id; statutes that `law` lacks give nothing. dates: case_id, label, day. overlay: statute_id,
    parameter, value_bool, value, keyed_on, effective_from, effective_to, status. Only APPROVED rows count. A row keyed
    on a label the case lacks is `unresolved` and says nothing about force. status: CONFLICT if two rows of a parameter
    cover the date; else HIDDEN if rows on section_in_force had a date and none that covers it is true; UNVERIFIED if
    none had a date; else CONFIRMED. applied: the covering values, by parameter.

    Only what is asked for meets overlay rows, by statute, and only dates of the labels they are keyed on are looked
    up, by case and label: two equi-joins, no product of cases and statutes.
    """
    pairs = asked.select("case_id", "statute_id").distinct().join(law.select("statute_id").distinct(), "statute_id", "left_semi")
    due = overlay.filter("status = 'APPROVED'").select("statute_id", "parameter", "value_bool", "value", "keyed_on", "effective_from", "effective_to")
    seen = pairs.join(due, "statute_id").join(dates.withColumnRenamed("label", "keyed_on"), ["case_id", "keyed_on"], "left")
    hit = F.coalesce(covers(F.col("effective_from"), F.col("effective_to"), F.col("day")) & F.col("day").isNotNull(), F.lit(False))
    force = F.col("parameter") == "section_in_force"
    per = seen.groupBy("case_id", "statute_id", "parameter").agg(
        F.count_if(hit).alias("hits"), F.max(F.when(hit, F.col("value"))).alias("value"), F.count_if(force & F.col("day").isNotNull()).alias("dated"),
        F.coalesce(F.bool_or(force & hit & F.col("value_bool")), F.lit(False)).alias("true_now"), F.count_if(F.col("day").isNull()).alias("lost"),
    )
    out = per.groupBy("case_id", "statute_id").agg(
        F.max("hits").alias("most"), F.sum("dated").alias("dated"), F.bool_or("true_now").alias("on"), F.sum("lost").alias("unresolved"),
        F.array_sort(F.collect_list(F.when((F.col("hits") == 1) & (F.col("parameter") != "section_in_force"), F.struct("parameter", "value")))).alias("applied"),
    )
    status = (
        F.when(F.coalesce("most", F.lit(0)) > 1, "CONFLICT").when((F.coalesce("dated", F.lit(0)) > 0) & ~F.col("on"), "HIDDEN")
        .when(F.coalesce("dated", F.lit(0)) == 0, "UNVERIFIED").otherwise("CONFIRMED")
    )
    empty = F.array().cast("array<struct<parameter:string,value:string>>")
    return pairs.join(out, ["case_id", "statute_id"], "left").select(
        "case_id", "statute_id", status.alias("status"), F.coalesce("applied", empty).alias("applied"), F.coalesce("unresolved", F.lit(0)).alias("unresolved")
    )


def records_as_of(asked: DataFrame, records: DataFrame) -> DataFrame:
    """What stood at a time: asked (ask_id, key, at) against records (rec_no, key, start, end), end exclusive, null open.

    status CONFIRMED with its rec_no if one record covers the time, CONFLICT if several do, HIDDEN if the key has
    records but none then, UNVERIFIED if it has none. An equi-join on the key with a range condition.
    """
    hit = (F.col("start") <= F.col("at")) & (F.col("end").isNull() | (F.col("at") < F.col("end")))
    j = asked.join(records, "key", "left")
    n = F.count_distinct(F.when(hit, F.col("rec_no")))
    out = j.groupBy("ask_id").agg(n.alias("n"), F.max(F.when(hit, F.col("rec_no"))).alias("rec_no"), F.count("rec_no").alias("known"))
    status = F.when(F.col("n") > 1, "CONFLICT").when(F.col("n") == 1, "CONFIRMED").when(F.col("known") > 0, "HIDDEN").otherwise("UNVERIFIED")
    return out.select("ask_id", status.alias("status"), F.when(F.col("n") == 1, F.col("rec_no")).alias("rec_no"))


def overlapping(records: DataFrame) -> DataFrame:
    """Records (rec_no, key, start, end) that begin before an earlier one of their key ends.

    A running maximum over the key's records in order of start, not a self-join of the key's group.
    """
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    w = Window.partitionBy("key").orderBy("start", "rec_no").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("until", F.max(F.coalesce("end", far)).over(w)).filter(F.col("until") > F.col("start")).select("rec_no", "key", "start", "until")


def limitation_expiry(rows: DataFrame) -> DataFrame:
    """Adds needs_review, first_expiry and expiry to rows (default_day, acks, period_years, excluded, minimum_days).

    The period runs from the default day; each acknowledgment, in order, that falls on or before the expiry so far
    starts it anew. An acknowledgment inside the excluded window needs review, and then the expiry is that of the
    default day alone. Otherwise, if the running period and the window meet, the period stops at the window's start (or
    at the default day, if that is later) and what is left of it, at least minimum_days, runs from the day after it.
    """
    months = F.col("period_years") * 12
    first = F.add_months("default_day", months)
    # The fold sees the sorted acknowledgments; add_months keeps 29 February on 28 February, as a calendar does.
    chain = F.expr("aggregate(array_sort(coalesce(acks, cast(array() as array<date>))), add_months(default_day, period_years * 12), (e, a) -> if(a <= e, greatest(e, add_months(a, period_years * 12)), e))")
    out = rows.withColumn("run_to", chain)
    a, b = F.col("excluded.from"), F.col("excluded.to")
    meets = F.coalesce((F.col("default_day") <= b) & (F.col("run_to") >= a), F.lit(False))
    left = F.greatest(F.datediff("run_to", F.greatest(F.col("default_day"), a)), F.coalesce("minimum_days", F.lit(0)))
    review = F.coalesce(F.expr("exists(coalesce(acks, cast(array() as array<date>)), x -> x between excluded.from and excluded.to)"), F.lit(False))
    expiry = F.when(F.col("needs_review"), first).when(meets, F.date_add(F.date_add(b, 1), left)).otherwise(F.col("run_to"))
    return out.withColumn("needs_review", review).withColumn("first_expiry", first).withColumn("expiry", expiry).drop("run_to")


def limitation_conclusions(stated: DataFrame, dates: DataFrame, rules: DataFrame, default_label: str, filing_label: str) -> DataFrame:
    """(case_id, turn, problem, expiry) where an argument's conclusion on limitation is at odds with the case's dates.

    stated: case_id, turn, statute_id, ord, asserts_within, acks; dates: case_id, label, day; rules: statute_id,
    period_years, excluded, minimum_days. Of the statutes an argument offers, the first (by ord) with a rule counts, and
    an argument is checked once. An argument without a conclusion, a rule or one of the two dates says nothing. problem:
    UNMAPPED if an acknowledgment needs review, INCONSISTENT if (filed <= expiry) is not what is asserted.
    """
    offered = stated.join(rules.withColumn("has_rule", F.lit(True)), "statute_id", "left")
    one = offered.groupBy("case_id", "turn").agg(
        F.min_by("asserts_within", F.when(F.col("asserts_within").isNotNull(), F.col("ord"))).alias("asserts_within"), F.min_by("acks", F.when(F.col("asserts_within").isNotNull(), F.col("ord"))).alias("acks"),
        F.min(F.when(F.col("has_rule"), F.struct("ord", "period_years", "excluded", "minimum_days"))).alias("r"),
    )
    at = dates.groupBy("case_id").agg(F.max(F.when(F.col("label") == default_label, F.col("day"))).alias("default_day"), F.max(F.when(F.col("label") == filing_label, F.col("day"))).alias("filed"))
    known = one.join(at, "case_id").filter("r is not null and asserts_within is not null and default_day is not null and filed is not null")
    ran = limitation_expiry(known.select("case_id", "turn", "asserts_within", "acks", "default_day", "filed", "r.period_years", "r.excluded", "r.minimum_days"))
    problem = F.when(F.col("needs_review"), "UNMAPPED").when((F.col("filed") <= F.col("expiry")) != F.col("asserts_within"), "INCONSISTENT")
    return ran.select("case_id", "turn", problem.alias("problem"), "expiry").filter("problem is not null")


def split_assignment(cases: DataFrame, test: int, validation: int) -> DataFrame:
    """(case_id, split): the newest `test` cases are TEST, the `validation` before them VALIDATION, the rest TRAIN; then
    every case of a dispute takes the latest split of any of them. cases: case_id, decided, dispute. Ties by case_id.

    The cut dates come from a bounded top-n, so no task ranks all cases.
    """
    order = [F.desc("decided"), F.desc("case_id")]
    top = cases.select("case_id", "decided").orderBy(*order).limit(test + validation)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(*order))).select("case_id", F.when(F.col("rn") <= test, 2).otherwise(1).alias("own"))
    own = cases.join(ranked, "case_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    group = own.groupBy("dispute").agg(F.max("own").alias("latest"))
    latest = F.when(F.col("latest") == 2, "TEST").when(F.col("latest") == 1, "VALIDATION").otherwise("TRAIN")
    return own.join(group, "dispute").select("case_id", latest.alias("split"))


def lesson_weight(severity: Column, frequency: Column, confidence: Column, decay: float, now: Column, last_seq: Column) -> Column:
    return severity * F.log1p(frequency) * confidence * F.pow(F.lit(decay), F.greatest(F.lit(0), now - F.coalesce(last_seq, now)))


def confidence_step(confidence: Column, last: Column, reward: Column, step: float = 0.05, floor: float = 0.2) -> tuple[Column, Column]:
    """(new confidence, retired). The first use only records its reward; then up if the reward rose or is 1, else down."""
    moved = F.when(last.isNull() | reward.isNull(), confidence).when((reward > last) | (reward >= 1.0), confidence + step).otherwise(confidence - step)
    new = F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))
    return new, new < floor


def checklist_moves(predicates: DataFrame, items: DataFrame) -> DataFrame:
    """Where the item behind a predicate stands now: (predicate_id, new_index, status).

    predicates: predicate_id, statute_id, field, item_index, item_hash, status; items: statute_id, field, pos, hash.
    Still there (at the first place): APPROVED with its index; gone: STALE.
    """
    first = items.groupBy("statute_id", "field", F.col("hash").alias("item_hash")).agg(F.min("pos").alias("new_index"))
    return predicates.join(first, ["statute_id", "field", "item_hash"], "left").select("predicate_id", "new_index", F.when(F.col("new_index").isNull(), "STALE").otherwise("APPROVED").alias("status"))
