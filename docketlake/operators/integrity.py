"""Integrity of records, placements of lessons, shares of repetition, folds of copies and counters of an ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.operators.quality import problems


def lesson_routing(lessons: DataFrame, key: str) -> DataFrame:
    """Problems of lessons by where each kind may live: JUDGE_TYPE (a judge's memory takes legal rules only), ADVOCACY_MEMORY,
    LAWYER_WITHOUT_STATUS, JUDGE_WITH_STATUS, ERROR_WITHOUT_CODE."""
    c = F.col
    none = F.lit("")
    return problems(
        lessons, "lessons", key,
        {
            "JUDGE_TYPE": ((c("memory") == "JUDGE") & (c("lesson_type") != "LEGAL_RULE"), c("lesson_type")), "ADVOCACY_MEMORY": ((c("lesson_type") == "ADVOCACY") & (c("memory") != "LAWYER"), c("memory")),
            "LAWYER_WITHOUT_STATUS": ((c("memory") == "LAWYER") & c("party_status").isNull(), none), "JUDGE_WITH_STATUS": ((c("memory") == "JUDGE") & c("party_status").isNotNull(), c("party_status")),
            "ERROR_WITHOUT_CODE": ((c("lesson_type") == "PROCEDURAL_ERROR") & c("error_code").isNull(), none),
        },
    )


def record_rules(law: DataFrame, acts: DataFrame) -> DataFrame:
    """Problems of law records: ID_MISMATCH (statute_id does not begin with its act's prefix or end with its section number),
    RANGE_ORDER (removed before it was loaded), THRESHOLD_WITHOUT_CURRENCY, NEGATIVE_WINDOW, UNKNOWN_ACT.

    law: rec_no, statute_id, act_prefix, section_number, loaded_at, removed_at, minimum_amount, currency,
    adjudication_window_days; acts: act_prefix.
    """
    known = acts.select("act_prefix").distinct().withColumn("act", F.lit(True))
    j = law.join(known, "act_prefix", "left")
    c = F.col
    plain = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    return problems(
        j, "law", "rec_no",
        {
            "ID_MISMATCH": (~F.startswith(plain(c("statute_id")), plain(c("act_prefix"))) | ~F.endswith(plain(c("statute_id")), plain(c("section_number"))), c("statute_id")), "RANGE_ORDER": (c("removed_at") < c("loaded_at"), c("removed_at").cast("date")),
            "THRESHOLD_WITHOUT_CURRENCY": (c("minimum_amount").isNotNull() & c("currency").isNull(), F.lit("")), "NEGATIVE_WINDOW": (c("adjudication_window_days") < 0, c("adjudication_window_days")), "UNKNOWN_ACT": (c("act_prefix").isNotNull() & c("act").isNull(), c("act_prefix")),
        },
    )


def outcome_rules(turns: DataFrame) -> DataFrame:
    """(session_id, turn, rule): turns (session_id, turn, claim_id, outcome, hard_errors, winner, status) whose outcome and errors
    are at odds: PASS_WITH_ERRORS, FLAGGED_WITHOUT_ERROR, DECIDED_WITHOUT_WINNER, UNDECIDED_WITH_WINNER, TURN_ID (not Tnn-Cn)."""
    n, won = F.size("hard_errors"), F.col("winner").isNotNull()
    rules = {
        "PASS_WITH_ERRORS": (F.col("outcome") != "FLAGGED") & (n > 0), "FLAGGED_WITHOUT_ERROR": (F.col("outcome") == "FLAGGED") & (n == 0), "DECIDED_WITHOUT_WINNER": (F.col("status") == "DECIDED") & ~won,
        "UNDECIDED_WITH_WINNER": (F.col("status") != "DECIDED") & won, "TURN_ID": ~F.col("claim_id").rlike("^T[0-9]{2,}-C[0-9]+$"),
    }
    return turns.select("session_id", "turn", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(r)) for r, bad in rules.items()]))).alias("rule"))


def alias_rules(aliases: DataFrame) -> DataFrame:
    """(cited_prefix, rule) of aliases (cited_prefix, law_db_prefix): SELF, REPEATED, CHAINED (a target that is aliased itself)."""
    own = aliases.filter("cited_prefix = law_db_prefix").select("cited_prefix", F.lit("SELF").alias("rule"))
    repeated = aliases.groupBy("cited_prefix").count().filter("count > 1").select("cited_prefix", F.lit("REPEATED").alias("rule"))
    chained = aliases.filter("cited_prefix <> law_db_prefix").join(aliases.select(F.col("cited_prefix").alias("law_db_prefix")).distinct(), "law_db_prefix", "left_semi").select("cited_prefix", F.lit("CHAINED").alias("rule"))
    return own.unionByName(repeated).unionByName(chained).distinct()


def settle(placed: DataFrame, relations: DataFrame, lessons: DataFrame, weaken: float) -> DataFrame:
    """(lesson_id, outcome, match_id, frequency, severity, match_confidence): what a placement writes.

    placed: see vector.placement; relations: lesson_id, match_id, relation (SAME, OPPOSITE, DIFFERENT) of the pairs that were
    compared; lessons: lesson_id, frequency, severity, confidence. SAME merges: the old one's frequency goes up by one and
    it takes the greater severity. OPPOSITE inserts the new one and weakens the old one's confidence by `weaken`, not
    below 0. Anything else inserts.
    """
    old = lessons.select(F.col("lesson_id").alias("match_id"), F.col("frequency").alias("f"), F.col("severity").alias("s"), F.col("confidence").alias("c"))
    j = placed.join(relations, ["lesson_id", "match_id"], "left").join(lessons.select("lesson_id", "frequency", "severity"), "lesson_id").join(old, "match_id", "left")
    merged, opposite = F.coalesce(F.col("relation") == "SAME", F.lit(False)), F.coalesce(F.col("relation") == "OPPOSITE", F.lit(False))
    return j.select(
        "lesson_id", F.when(merged, "MERGED").when(opposite, "INSERTED_OPPOSITE").otherwise("INSERTED").alias("outcome"), F.when(merged | opposite, F.col("match_id")).alias("match_id"),
        F.when(merged, F.col("f") + 1).otherwise(F.col("frequency")).alias("frequency"), F.when(merged, F.greatest("s", "severity")).otherwise(F.col("severity")).alias("severity"), F.when(opposite, F.greatest(F.col("c") - weaken, F.lit(0.0))).alias("match_confidence"),
    )


def repetition_share(copied: DataFrame, warn: float, hard: float | None) -> DataFrame:
    """(session_id, turn, share, flag) of sentences (session_id, turn, closing, copied): the share of a turn's sentences that copy
    an earlier one; WARN from `warn`, HARD above `hard` if it is given. A closing sums up by design: no flag."""
    g = copied.groupBy("session_id", "turn", "closing").agg(F.avg(F.col("copied").cast("int")).alias("share"))
    flag = F.when(F.col("closing"), None)
    if hard is not None:
        flag = flag.when(F.col("share") > hard, "HARD")
    return g.select("session_id", "turn", "share", flag.when(F.col("share") >= warn, "WARN").alias("flag"))


def folded_copies(rows: DataFrame, id: str, digest: str) -> DataFrame:
    """(id, kept_id): ids whose content another id has too; the least of them is kept and the others fold into it."""
    one = rows.groupBy(digest, id).agg(F.lit(1).alias("__one")).select(digest, id)
    least = one.groupBy(digest).agg(F.min(id).alias("kept_id"), F.count("*").alias("n")).filter("n > 1").select(digest, "kept_id")
    return one.join(least, digest).filter(F.col(id) != F.col("kept_id")).groupBy(id).agg(F.min("kept_id").alias("kept_id"))


def local_scores(verified: DataFrame, rule: float, llm: float) -> DataFrame:
    """(session_id, turn, score): rule coverage and responsiveness, weighted; without an answer on responsiveness it is 1."""
    return verified.select("session_id", "turn", (F.col("rule_coverage") * rule + F.coalesce("responsiveness", F.lit(1.0)) * llm).alias("score"))


def predicate_errors(outcomes: DataFrame, facts: DataFrame, inputs: dict[str, Sequence[str]]) -> DataFrame:
    """(case, predicate_id, kind, detail) of predicate outcomes (case, predicate_id, outcome, missing): a FAIL is an ERROR with
    the record ids behind its inputs, sorted; a SKIPPED is a WARNING that names what is missing.

    facts: case, input, record_id; inputs: predicate_id to the names it reads.
    """
    pairs = [(p, n) for p, names in inputs.items() for n in names]
    of = outcomes.sparkSession.createDataFrame(pairs, "predicate_id string, input string")
    behind = outcomes.filter("outcome = 'FAIL'").join(of, "predicate_id").join(facts, ["case", "input"]).groupBy("case", "predicate_id").agg(F.array_join(F.array_sort(F.collect_set("record_id")), ",").alias("ids"))
    j = outcomes.filter("outcome <> 'PASS'").join(behind, ["case", "predicate_id"], "left")
    failed = F.col("outcome") == "FAIL"
    return j.select("case", "predicate_id", F.when(failed, "ERROR").otherwise("WARNING").alias("kind"), F.when(failed, F.coalesce("ids", F.lit(""))).otherwise(F.array_join(F.array_sort("missing"), ",")).alias("detail"))


def truth_problems(truth: DataFrame, view: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(case_id, problem, detail) of a ground truth against the view it belongs to.

    truth: case_id, findings (array of struct<issue_id, paras>), reliefs, decided; view: case_id, issues, reliefs, decided;
    paragraphs: case_id, para_id. NOT_FRAMED and NO_FINDING, both ways; RELIEF_NOT_SHOWN; UNKNOWN_PARAGRAPH; DATE_DIFFERS.
    """
    v = view.select("case_id", F.col("issues").alias("v_issues"), F.col("reliefs").alias("v_reliefs"), F.col("decided").alias("v_decided"))
    j = truth.join(v, "case_id")
    mine = F.transform("findings", lambda f: f["issue_id"])
    row = lambda problem, items: F.transform(items, lambda d: F.struct(F.lit(problem).alias("problem"), d.alias("detail")))
    dates = F.when(F.col("decided").eqNullSafe(F.col("v_decided")), F.array().cast("array<string>")).otherwise(F.array(F.coalesce(F.col("decided").cast("string"), F.lit(""))))
    own = j.select("case_id", F.inline(F.concat(row("NOT_FRAMED", F.array_except(mine, "v_issues")), row("NO_FINDING", F.array_except("v_issues", mine)), row("RELIEF_NOT_SHOWN", F.array_except("reliefs", "v_reliefs")), row("DATE_DIFFERS", dates))))
    cited = truth.select("case_id", F.explode("findings").alias("f")).select("case_id", F.explode("f.paras").alias("para_id")).distinct()
    lost = cited.join(paragraphs, ["case_id", "para_id"], "left_anti").select("case_id", F.lit("UNKNOWN_PARAGRAPH").alias("problem"), F.col("para_id").alias("detail"))
    return own.unionByName(lost)


def turn_model(events: DataFrame) -> DataFrame:
    """(session_id, turn, attempt, kinds, last_payload, n) of trace events (session_id, turn, attempt, seq, kind, payload): for each
    attempt the kinds of its events in order, and the payload that was written last."""
    g = events.groupBy("session_id", "turn", "attempt").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("k"), F.max_by("payload", "seq").alias("last_payload"), F.count("*").alias("n"))
    return g.select("session_id", "turn", "attempt", F.array_join(F.transform("k", lambda x: x["kind"]), ">").alias("kinds"), "last_payload", "n")


def refused_memory(incoming: DataFrame, memory: str) -> tuple[DataFrame, DataFrame]:
    """(rows for the store of this memory, refused rows): a lesson of another memory is never written; null is another."""
    own = F.coalesce(F.col("memory") == memory, F.lit(False))
    return incoming.filter(own), incoming.filter(~own)


def over_budget(calls: DataFrame, caps: DataFrame) -> DataFrame:
    """(stage, spent, cap): stages that have spent more than their cap. calls: stage, cost; caps: stage, cap."""
    return calls.groupBy("stage").agg(F.sum("cost").alias("spent")).join(caps, "stage").filter(F.col("spent") > F.col("cap")).select("stage", "spent", "cap")


def point_read(rows: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows of these ids: a filter that reaches the scan, and one row an id that there is."""
    return rows.filter(F.col(key).isin(*ids))


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(columns, side): rows one side has more often than the other, as often as the surplus."""
    gone, come = old.exceptAll(new), new.exceptAll(old)
    return gone.withColumn("side", F.lit("gone")).unionByName(come.withColumn("side", F.lit("come")))


def ingest_counters(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(counter, label, n): the counts of an ingest report, several tables by their labels in one."""
    out = None
    for name, (df, label) in parts.items():
        one = df.groupBy(label.cast("string").alias("label")).agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "label", "n")
        out = one if out is None else out.unionByName(one)
    return out


def continued(events: DataFrame, session: str, order: Sequence[str], stored: DataFrame) -> DataFrame:
    """Events numbered on from the last number stored for their session (session, last_seq); 1 where none is."""
    w = Window.partitionBy(session).orderBy(*order)
    return events.withColumn("seq", F.row_number().over(w).cast("long")).join(stored, session, "left").withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def check_vocabulary(families: dict[str, Sequence[str]], known: Sequence[str], weights: dict[str, float]) -> None:
    """Raises unless the families hold known words only, none twice, and the weights sum to 1."""
    words = [w for f in families.values() for w in f]
    if len(words) != len(set(words)):
        raise ValueError("a word stands in two families")
    if set(words) - set(known):
        raise ValueError(f"unknown words: {sorted(set(words) - set(known))}")
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("the weights do not sum to 1")
