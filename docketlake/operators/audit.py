"""Audits: checklists against the law, leakage into a view, drafts before loading, lessons before storing, opinions before they count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators.checks import date_written


def _rows(df: DataFrame, keep: Sequence[str], *rules: tuple[str, Column, Column]) -> DataFrame:
    """One row for each rule (name, condition, detail) that a row breaks; a null condition breaks none."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("code"), detail.cast("string").alias("detail"))) for name, bad, detail in rules]))
    return df.select(*keep, F.inline(found))


def first_failing(df: DataFrame, keep: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """(keep, reason): the first rule, in the order given, whose condition holds; null where none does."""
    reason = reduce(lambda out, r: out.when(F.coalesce(r[1], F.lit(False)), r[0]), rules.items(), F.when(F.lit(False), ""))
    return df.select(*keep, reason.alias("reason"))


def checklist_audit(claims: DataFrame, law: DataFrame, amounts: DataFrame, items: DataFrame, currency: str, least: float) -> DataFrame:
    """(claim_id, code, detail): where a stated checklist is at odds with the law that applies.

    claims: claim_id, case_id, statute_id, minimum, currency, asserts_met, amount_id, adjudication_days,
    rectification_days, stance. law: case_id, statute_id, minimum (the dated threshold, null: none covers the date),
    readings_agree, adjudication_days, rectification_days, undated (names of timelines whose date can't be resolved),
    counts (map of list field to its number of items). amounts: case_id, amount_id, value. items: claim_id, field,
    law_index, confidence, quote.

    Threshold: THRESHOLD_NOT_VERIFIABLE without one value in every reading; else ERR_THRESHOLD_MISSTATED if another sum is
    stated (UNMAPPED in another currency) and ERR_THRESHOLD_APPLICATION if met or not met is wrong of the named amount
    (UNMAPPED if there is none). Timelines: ERR_TIMELINE_MISSTATED, UNMAPPED if undated; the law's null says nothing.
    Items: UNMAPPED below `least` confidence or without quote or beyond the law's list; WARN_CONDITION_NOT_IN_STATUTE
    without an index. Under ASSERT_CLAIM, prerequisites that no trusted item addresses: PREREQUISITE_UNADDRESSED.
    """
    lw = law.select("case_id", "statute_id", F.col("minimum").alias("law_min"), "readings_agree", *[F.col(f"{k}_days").alias(f"law_{k}") for k in ("adjudication", "rectification")], "undated", "counts")
    sums = amounts.select("case_id", "amount_id", F.col("value").alias("amount"))
    j = claims.join(lw, ["case_id", "statute_id"]).join(sums, ["case_id", "amount_id"], "left")
    stated = F.col("minimum").isNotNull() | F.col("asserts_met").isNotNull()
    firm = F.col("law_min").isNotNull() & F.coalesce("readings_agree", F.lit(True))
    foreign = F.coalesce(F.col("currency") != currency, F.lit(False))
    d = lambda x: x.cast("decimal(38,4)")
    rules = [
        ("THRESHOLD_NOT_VERIFIABLE", stated & ~firm, F.lit("financial_threshold")),
        ("UNMAPPED", firm & F.col("minimum").isNotNull() & foreign, F.lit("currency")),
        ("ERR_THRESHOLD_MISSTATED", firm & ~foreign & (d(F.col("minimum")) != d(F.col("law_min"))), F.lit("financial_threshold")),
        ("UNMAPPED", firm & F.col("asserts_met").isNotNull() & F.col("amount").isNull(), F.lit("amount")),
        ("ERR_THRESHOLD_APPLICATION", firm & (F.col("asserts_met") != (d(F.col("amount")) >= d(F.col("law_min")))), F.col("amount_id")),
    ]
    for k in ("adjudication", "rectification"):
        lost = F.coalesce(F.array_contains("undated", f"{k}_days"), F.lit(False))
        rules += [("UNMAPPED", F.col(f"{k}_days").isNotNull() & lost, F.lit(f"{k}_days")), ("ERR_TIMELINE_MISSTATED", ~lost & (F.col(f"{k}_days") != F.col(f"law_{k}")), F.lit(f"{k}_days"))]
    own = _rows(j, ["claim_id"], *rules)
    trusted = F.coalesce((F.col("confidence") >= least) & (F.trim("quote") != ""), F.lit(False))
    there = F.coalesce(F.try_element_at("counts", F.col("field")), F.lit(0))
    i = items.join(j.select("claim_id", "counts"), "claim_id")
    of_items = _rows(
        i, ["claim_id"], ("UNMAPPED", ~trusted, F.col("field")), ("WARN_CONDITION_NOT_IN_STATUTE", trusted & F.col("law_index").isNull(), F.col("field")), ("UNMAPPED", trusted & (F.col("law_index") >= there), F.concat("field", F.lit("["), F.col("law_index").cast("string"), F.lit("]")))
    )
    got = i.filter(trusted & (F.col("field") == "mandatory_prerequisites") & F.col("law_index").isNotNull()).groupBy("claim_id").agg(F.collect_set(F.col("law_index").cast("int")).alias("got"))
    n = F.coalesce(F.try_element_at("counts", F.lit("mandatory_prerequisites")), F.lit(0)).cast("int")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    left = j.filter("stance = 'ASSERT_CLAIM'").join(got, "claim_id", "left").withColumn("left", F.array_sort(F.array_except(every, F.coalesce("got", F.array().cast("array<int>")))))
    open_ = _rows(left, ["claim_id"], ("PREREQUISITE_UNADDRESSED", F.size("left") > 0, F.array_join(F.col("left").cast("array<string>"), ",")))
    return own.unionByName(of_items).unionByName(open_)


def leakage_report(views: DataFrame, names: DataFrame, grams: DataFrame, markers: Sequence[str], evaluative: Sequence[str], generic: Sequence[str]) -> DataFrame:
    """(view_id, scan, hits): what a finished view gives away, one row a scan that found anything.

    views: view_id, text, case_number, decided, issues (array of questions); names: view_id, name, role (BENCH, PARTY or
    AUTHORITY); grams: view_id, n_leaked (see overlap.leakage). Scans: the case's own number, any registration number,
    e-mail addresses and web domains, words of bench members' and of parties' names, the decision date, case citations
    and pleaded authorities, the court's own voice (markers), evaluative words in an issue, copied runs of words.
    """
    c, low = F.col("text"), T.squeeze(F.col("text"))
    count = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    held = lambda words: sum((F.contains(low, F.lit(" ".join(w.lower().split()))).cast("int") for w in words), F.lit(0))
    questions = F.lower(F.array_join(F.coalesce("issues", F.array().cast("array<string>")), "\n"))
    rated = sum((questions.rlike(rf"\b{w.lower()}\b").cast("int") for w in evaluative), F.lit(0))
    per_view = {
        "CASE_NUMBER": F.coalesce((F.col("case_number") != "") & F.contains(low, T.squeeze(F.col("case_number"))), F.lit(False)).cast("int"),
        "REGISTRATION_NUMBER": F.size(T.registration_hits(c)),
        "MAIL_OR_DOMAIN": count(r"(?i)[\w.+-]+@[\w-]+\.[\w.-]+|\bwww\.[\w.-]+"),
        "DECISION_DATE": F.coalesce(date_written(c, F.col("decided")), F.lit(False)).cast("int"),
        "CITATION": F.size(T.citation_hits(c)),
        "COURT_VOICE": held(markers),
        "EVALUATIVE": rated,
    }
    out = views.select("view_id", F.inline(F.array(*[F.struct(F.lit(k).alias("scan"), v.cast("long").alias("hits")) for k, v in per_view.items()])))
    # Words of names meet the words of their own view only.
    words = F.filter(F.split("name", "[^A-Za-z]+"), lambda w: (F.length(w) >= 3) & w.rlike("^[A-Z]") & ~F.lower(w).isin(*generic))
    wanted = names.filter("role <> 'AUTHORITY'").select("view_id", F.concat("role", F.lit("_NAME")).alias("scan"), F.explode(F.array_distinct(words)).alias("w")).distinct()
    said = views.select("view_id", F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("w"))
    named = wanted.join(said, ["view_id", "w"]).groupBy("view_id", "scan").agg(F.count("*").alias("hits"))
    pleaded = names.filter("role = 'AUTHORITY'").join(views.select("view_id", low.alias("low")), "view_id").filter((T.squeeze(F.col("name")) != "") & F.contains("low", T.squeeze(F.col("name"))))
    pleaded = pleaded.groupBy("view_id").agg(F.count_distinct("name").alias("hits")).select("view_id", F.lit("CITATION").alias("scan"), "hits")
    copied = grams.select("view_id", F.lit("COPIED_RUNS").alias("scan"), F.col("n_leaked").alias("hits"))
    return out.unionByName(named).unionByName(pleaded).unionByName(copied).groupBy("view_id", "scan").agg(F.sum("hits").alias("hits")).filter("hits > 0")


def load_approved(drafts: DataFrame, sources: DataFrame, items: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(draft_id, reason): why an approved draft can't be loaded now, or null; nothing stored with a draft is believed.

    drafts: draft_id, status, kind (OVERLAY or PREDICATE), source, quote, term, day, statute_id, field, item_index,
    item_hash; sources: source, text, sha256 (pinned), found (of the file); items: statute_id, field, pos, hash. Only
    APPROVED drafts come. In order: NO_SOURCE, SOURCE_CHANGED, NOT_VERBATIM, NOT_UNIQUE, UNKNOWN_TERM and DATE_NOT_IN_QUOTE
    (overlays), NO_STATUTE and ITEM_CHANGED (predicates).
    """
    j = drafts.filter("status = 'APPROVED'").join(sources, "source", "left")
    at = items.select("statute_id", "field", F.col("pos").alias("item_index"), F.col("hash").alias("now"))
    j = j.join(at, ["statute_id", "field", "item_index"], "left").join(items.select("statute_id").distinct().withColumn("statute", F.lit(True)), "statute_id", "left")
    places, overlay = T.quote_places(F.col("text"), F.coalesce("quote", F.lit(""))), F.col("kind") == "OVERLAY"
    return first_failing(
        j, ["draft_id"],
        {
            "NO_SOURCE": F.col("text").isNull(), "SOURCE_CHANGED": ~F.col("sha256").eqNullSafe(F.col("found")), "NOT_VERBATIM": places == 0, "NOT_UNIQUE": places > 1,
            "UNKNOWN_TERM": overlay & F.col("term").isNotNull() & ~F.col("term").isin(*terms), "DATE_NOT_IN_QUOTE": overlay & F.col("day").isNotNull() & ~F.coalesce(F.array_contains(T.dates(F.col("quote")), F.col("day")), F.lit(False)),
            "NO_STATUTE": ~overlay & F.col("statute").isNull(), "ITEM_CHANGED": ~overlay & ~F.col("item_hash").eqNullSafe(F.col("now")),
        },
    )


#: Fixed value: what names a provision, a precedent, a figure or a date.
SPECIFIC = r"(?i)\b(?:section|article|rule|regulation|order)\s+[0-9]|[0-9]|₹|\bRs\b|%"


def lesson_rules(candidates: DataFrame, findings: DataFrame, names: DataFrame, base_rates: Sequence[str], conclusions: Sequence[str], stored: DataFrame) -> DataFrame:
    """(candidate_id, reason): the first rule a proposed lesson breaks, or null.

    candidates: candidate_id, case_id, issues, paras, trigger, lesson, digest; findings: case_id, issue_id, driver, paras;
    names: case_id, name; stored: digest of the lessons there are. In order: NO_ISSUE, UNKNOWN_ISSUE, EVIDENCE_DRIVEN,
    FOREIGN_PARAGRAPH (none, or not the court's for these issues), NAMES_A_PARTY, BASE_RATE, SPECIFIC, CONCLUSION (in
    the advice only), STORED_ALREADY.
    """
    c = candidates.withColumn("text", F.concat_ws("\n", "trigger", "lesson")).withColumn("issues", F.array_distinct(F.coalesce("issues", F.array().cast("array<string>"))))
    by_issue = c.select("candidate_id", "case_id", F.explode("issues").alias("issue_id")).join(findings, ["case_id", "issue_id"], "left")
    g = by_issue.groupBy("candidate_id").agg(F.bool_or(F.col("driver").isNull()).alias("unknown"), F.bool_or(F.col("driver") == "EVIDENCE").alias("evidence"), F.array_distinct(F.flatten(F.collect_list("paras"))).alias("allowed"))
    said = c.join(names, "case_id").filter(F.contains(F.lower("text"), F.lower("name"))).select("candidate_id", F.lit(True).alias("named")).distinct()
    old = stored.select("digest", F.lit(True).alias("old")).distinct()
    j = c.join(g, "candidate_id", "left").join(said, "candidate_id", "left").join(old, "digest", "left")
    held = lambda col, words: reduce(lambda a, w: a | F.contains(F.lower(col), F.lit(w.lower())), words, F.lit(False))
    paras = F.coalesce("paras", F.array().cast("array<string>"))
    return first_failing(
        j, ["candidate_id"],
        {
            "NO_ISSUE": F.size("issues") == 0, "UNKNOWN_ISSUE": F.col("unknown"), "EVIDENCE_DRIVEN": F.col("evidence"), "FOREIGN_PARAGRAPH": (F.size(paras) == 0) | (F.size(F.array_except(paras, F.coalesce("allowed", F.array().cast("array<string>")))) > 0),
            "NAMES_A_PARTY": F.col("named"), "BASE_RATE": held("text", base_rates), "SPECIFIC": F.col("text").rlike(SPECIFIC), "CONCLUSION": held("lesson", conclusions), "STORED_ALREADY": F.col("old"),
        },
    )


def drop_contradicted(cited: DataFrame, problems: DataFrame) -> DataFrame:
    """(opinion_id, issue_id, rule): the cited rules of opinions once the contradicted ones are dropped.

    cited: opinion_id, issue_id, rule; problems: opinion_id, code, rule. An opinion is mended only if every problem it has
    is CONTRADICTED_RULE and each of its issues keeps a rule; one that can't be mended, or has no problem, is left out.
    """
    p = problems.groupBy("opinion_id").agg(F.bool_and(F.col("code") == "CONTRADICTED_RULE").alias("only"))
    bad = problems.filter("code = 'CONTRADICTED_RULE'").select("opinion_id", "rule").distinct().withColumn("bad", F.lit(True))
    c = cited.join(p.filter("only").select("opinion_id"), "opinion_id", "left_semi").join(bad, ["opinion_id", "rule"], "left")
    left = c.groupBy("opinion_id", "issue_id").agg(F.count_if(F.col("bad").isNull()).alias("left"))
    whole = left.groupBy("opinion_id").agg(F.min("left").alias("least")).filter("least > 0").select("opinion_id")
    return c.filter("bad is null").join(whole, "opinion_id", "left_semi").select("opinion_id", "issue_id", "rule").distinct()


def finalise(opinions: DataFrame, problems: DataFrame) -> DataFrame:
    """(opinion_id, valid, problems): an opinion counts if it has no problem and its shape holds (a result, and a finding
    on every issue); otherwise its problems are kept, sorted. opinions: opinion_id, result, issues, findings; problems:
    opinion_id, problem."""
    p = problems.groupBy("opinion_id").agg(F.array_sort(F.collect_set("problem")).alias("p"))
    shape = F.array_compact(F.array(F.when(F.col("result").isNull(), F.lit("NO_RESULT")), F.when(F.col("findings") < F.col("issues"), F.lit("ISSUE_WITHOUT_FINDING"))))
    every = F.coalesce("p", shape)
    return opinions.join(p, "opinion_id", "left").select("opinion_id", (F.size(every) == 0).alias("valid"), every.alias("problems"))


def record_facts(picked: DataFrame, sentences: DataFrame, markers: Sequence[str], evaluative: Sequence[str]) -> DataFrame:
    """(case_id, source_id, flag): sentences picked for a record, kept (null), or dropped and why.

    picked: case_id, source_id; sentences: case_id, source_id, text. UNKNOWN_ID fails; COURT_VOICE holds a marker of the
    court's own voice; EVALUATIVE a word that judges. The first that fits counts.
    """
    j = picked.distinct().join(sentences, ["case_id", "source_id"], "left")
    low = T.squeeze(F.col("text"))
    voice = reduce(lambda a, m: a | F.contains(low, F.lit(m.lower())), markers, F.lit(False))
    rated = reduce(lambda a, w: a | low.rlike(rf"\b{w.lower()}\b"), evaluative, F.lit(False))
    return first_failing(j, ["case_id", "source_id"], {"UNKNOWN_ID": F.col("text").isNull(), "COURT_VOICE": voice, "EVALUATIVE": rated}).withColumnRenamed("reason", "flag")


def ledger_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, seq, case_id, path): outcome files of evaluated jobs that exist, in the ledger's order.

    jobs: run_id, jobs (array of struct<case_id, stages array<struct<stage, status>>>); outcomes: run_id, case_id, path.
    """
    j = jobs.select("run_id", F.posexplode("jobs").alias("seq", "j"))
    done = j.filter(F.exists("j.stages", lambda s: (s["stage"] == "EVALUATE") & (s["status"] == "DONE"))).select("run_id", "seq", F.col("j.case_id").alias("case_id"))
    return done.join(outcomes, ["run_id", "case_id"]).select("run_id", F.col("seq").cast("long").alias("seq"), "case_id", "path")


def stop_reasons(steps: DataFrame) -> DataFrame:
    """(run_id, stage, status, reason, n): why jobs of a run stopped, over ledger rows (run_id, job, seq, stage, status,
    reason): the last row of a job counts."""
    last = steps.groupBy("run_id", "job").agg(F.max(F.struct("seq", "stage", "status", "reason")).alias("l"))
    return last.groupBy("run_id", "l.stage", "l.status", "l.reason").agg(F.count("*").alias("n"))


def decided_drafts(reviews: DataFrame) -> DataFrame:
    """(draft_id, status, by, refused): review files as rows (draft_id, ord, status, by). The first file of a draft is the
    draft; after it the first decision (APPROVED or REJECTED) counts, and the later ones are refused."""
    w = Window.partitionBy("draft_id").orderBy("ord")
    d = reviews.filter("status <> 'DRAFT'").withColumn("r", F.row_number().over(w))
    first = d.filter("r = 1").select("draft_id", "status", "by")
    every = reviews.groupBy("draft_id").agg(F.greatest(F.count_if(F.col("status") != "DRAFT") - 1, F.lit(0)).alias("refused"))
    return every.join(first, "draft_id", "left").select("draft_id", F.coalesce("status", F.lit("DRAFT")).alias("status"), "by", "refused")
