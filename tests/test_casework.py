"""Stated cases of the case-record and hearing operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketlake.operators import hearing, records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_views(spark):
    c = spark.createDataFrame([("c", "x", None)], "case_id string, secret string, title string")
    assert records.allow(c, ["case_id"]).columns == ["case_id"] and records.agent_view(c, ["secret"], c.columns).columns == ["case_id", "title"]
    for bad in (lambda: records.allow(c, ["nope"]), lambda: records.agent_view(c, [], ["case_id"])):
        with pytest.raises(ValueError):
            bad()
    assert rows(records.part(c, "case_id", {"p": ["title", "secret"]}, "p")) == [("c", "x")]


def test_access(spark):
    truth = spark.createDataFrame([("a",), ("b",), ("z",)], "case_id string")
    sessions = spark.createDataFrame([("s1", "a", "VERDICT"), ("s2", "b", "RUNNING")], "session_id string, case_id string, state string")
    assert rows(records.unsealed(truth, sessions)) == [("a",)] and rows(records.reviewable(truth, sessions)) == [("z",)]
    private = spark.createDataFrame([("s1", "A", 2), ("s1", "A", 1), ("s1", "B", 1), ("s2", "A", 1)], "session_id string, side string, turn int")
    assert [(r.session_id, r.turn) for r in records.own_turns(private, sessions, "A").collect()] == [("s1", 1), ("s1", 2)]
    ask = spark.createDataFrame([("judge", "truth", "read"), ("clerk", "truth", "read")], "role string, store string, op string")
    policy = spark.createDataFrame([("clerk", "truth", "read", "ALL")], "role string, store string, op string, scope string")
    assert {(r.role, r.allowed) for r in records.permitted(ask, policy).collect()} == {("judge", False), ("clerk", True)}
    texts = spark.createDataFrame([("p", "exact"), ("q", "other")], "name string, text string")
    ok = texts.select("name", F.sha2("text", 256).alias("sha256"), F.when(F.col("name") == "p", "APPROVED").otherwise("DRAFT").alias("status"))
    assert rows(records.approved_text(texts, ok)) == [("p", True), ("q", False)]


def test_items(spark):
    kind = "array<struct<id:string,claim:string,sources:array<string>>>"
    c = spark.createDataFrame([("c", [("F1", "x", ["P1"])], None)], f"case_id string, facts {kind}, exhibits {kind}")
    assert rows(records.flatten_items(c, {"facts": "FACT", "exhibits": "EXHIBIT"})) == [("c", "F1", "FACT", "x", ["P1"])]
    d = spark.createDataFrame([("c", [("FILED", dt.date(2020, 1, 1))])], "case_id string, key_dates array<struct<label:string,day:date>>")
    got = records.without_dates(d, ["FILED", "LOST"]).first()
    assert got.key_dates == [] and got.absent == ["LOST"]
    p = spark.createDataFrame([("u#1", "A"), ("u#2", "A"), ("v#1", "B")], "uid string, precedent_id string")
    assert rows(records.ambiguous_lookup(spark.createDataFrame([("A",), ("B",), ("u#2",), ("x#9",)], "wanted string"), p)) == [("A", None), ("B", "v#1"), ("u#2", "u#2"), ("x#9", None)]
    para = spark.createDataFrame([("c", "P4", ["one.", "two."])], "case_id string, para_id string, sentences array<string>")
    ids = spark.createDataFrame([("c", s) for s in ("P4", "P4.S2", "P4.S3", "P9")], "case_id string, source_id string")
    assert rows(records.source_text(ids, para)) == [("c", "P4", "one. two."), ("c", "P4.S2", "two."), ("c", "P4.S3", "(not found)"), ("c", "P9", "(not found)")]
    items = spark.createDataFrame([("c", "F1", ["P1", "P2"])], "case_id string, item_id string, sources array<string>")
    assert rows(records.invisible_sources(items, spark.createDataFrame([("c", "P1")], "case_id string, source_id string"))) == [("c", "F1", "P2")]


def test_lists_and_guards(spark):
    f = spark.createDataFrame([("c", "a"), ("c", "b")], "case_id string, issue_id string")
    assert rows(records.reconcile(f, spark.createDataFrame([("c", "b"), ("c", "d")], "case_id string, issue_id string"))) == [("c", "a", "NOT_FRAMED"), ("c", "d", "NO_FINDING")]
    ex = records.exclusion_closure(spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("x", "y"), ("q", "r")], "old_id string, new_id string"))
    assert rows(ex) == [("x",), ("y",)]
    r = spark.createDataFrame([("i", "h1", 1), ("i", "h2", 2), ("i", "h1", 3), ("j", "h1", 9)], "id string, h string, at int")
    assert rows(records.suffixes(r, "id", "h", ["at"]).select("at", "new_id")) == [(1, "i"), (2, "i_B"), (3, "i"), (9, "j")]
    plan = spark.createDataFrame([("c", "TEST"), ("d", "OLD"), ("d", "OLD")], "case_id string, split string")
    assert rows(records.plan_guards(plan, "LEARN", ["OLD"])) == [("c", "TEST_IN_LEARN"), ("d", "BARRED_SPLIT"), ("d", "PLANNED_TWICE")]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["7. no", "1. yes", "2) yes", "9. no", "text", "4. yes", "3. no"])], "doc_id string, line int, text string")
    assert [r.number for r in records.court_numbering(lines, 2, 3).orderBy("line").collect()] == [1, 2, 4]
    pred = spark.createDataFrame([("p", "S", "f", 0, "h", "APPROVED"), ("q", "S", "f", 0, "old", "APPROVED")], "predicate_id string, statute_id string, field string, item_index int, item_hash string, status string")
    assert [r.predicate_id for r in records.current_predicates(pred, spark.createDataFrame([("S", "f", 0, "h")], "statute_id string, field string, pos int, hash string")).collect()] == ["p"]


def test_claims_and_points(spark):
    claims = spark.createDataFrame([("s", "T01-C1", ["E1", "E9"], "S1", "A", 1), ("s", "T03-C1", [], "S9", "A", 3)], "session_id string, claim_id string, record_ids array<string>, statute_id string, side string, turn int")
    got = hearing.claim_problems(claims, spark.createDataFrame([("s", "E1")], "session_id string, record_id string"), spark.createDataFrame([("s", "S1")], "session_id string, statute_id string"))
    assert rows(got) == [("s", "T01-C1", "UNKNOWN_RECORD", "E9"), ("s", "T03-C1", "STATUTE_NOT_VISIBLE", "S9")]
    pairs = spark.createDataFrame([("s", "T01-C1", "T03-C1"), ("s", "T01-C1", "T01-C1"), ("s", "T01-C1", "T09-C1")], "session_id string, claim_a string, claim_b string")
    assert rows(hearing.confirmed_contradictions(pairs, claims)) == [("s", "A", "T01-C1", "T03-C1")]
    turns = spark.createDataFrame([("s", 1, "A", "The  Debt is due", "OPENING"), ("s", 2, "B", "no", "OPENING"), ("s", 3, "A", "yes", "CLOSING")], "session_id string, turn int, side string, text string, kind string")
    points = spark.createDataFrame([("s", 1, "A", "debt IS due"), ("s", 1, "B", "debt is due"), ("s", 3, "A", "yes"), ("s", 1, "A", "not said")], "session_id string, turn int, side string, quote string")
    assert rows(hearing.confirmed_points(points, turns)) == [("s", 1, "A", "debt IS due")]
    assert rows(hearing.context(turns)) == [("s", 1, 0, None), ("s", 2, 1, 1), ("s", 3, 2, 2)]


def test_scores(spark):
    p = spark.createDataFrame([("s", "A", "FLAGGED", 2, [["E"], ["E", "F"]], []), ("s", "A", "PASS", 1, [[]], ["W"])], "session_id string, side string, outcome string, attempts int, hard_errors_by_attempt array<array<string>>, warnings array<string>")
    assert rows(hearing.side_metrics(p)) == [("s", "A", 2, 3, 3, 0.5, 1, 1)]
    d = spark.createDataFrame([("s", "A", "ANSWERED", 0.5), ("s", "A", "EVADED", 1.5), ("s", "B", "EVADED", 0.0)], "session_id string, side string, status string, centrality double")
    assert [(r.side, r.depth) for r in hearing.rebuttal_depth(d).orderBy("side").collect()] == [("A", 0.25), ("B", None)]
    got = spark.range(1).select(hearing.consistency(F.lit(3), F.lit(2)), hearing.consistency(F.lit(0), F.lit(0)), hearing.mean_of_available(F.lit(None).cast("double"), F.lit(0.5)), hearing.mean_of_available(F.lit(None).cast("double"))).first()
    assert list(got) == [0.0, None, 0.5, None]
    v = spark.createDataFrame([(90, "within 90 days", "paid within 90 days of"), (91, "within 90 days", "paid within 90 days of"), (9, "", "x"), (9, None, "x")], "value int, quote string, text string")
    assert [r.kept for r in hearing.grounded(v).collect()] == [True, False, False, False]
    c = spark.createDataFrame([(1, 3), (2, 0)], "n_addressed int, n_items int").withColumn("session_id", F.col("n_items"))
    assert rows(hearing.rule_coverage(c)) == [(0, 1.0), (3, 1 / 3)]


def test_decisions(spark):
    a = spark.createDataFrame([("s", 1, 1, ["E"], []), ("s", 1, 2, [], ["W"]), ("s", 1, 3, [], []), ("s", 2, 1, ["E"], []), ("s", 2, 2, ["E"], []), ("s", 2, 3, ["E"], [])], "session_id string, turn int, attempt int, hard_errors array<string>, warnings array<string>")
    assert rows(hearing.attempt_fold(a, 1)) == [("s", 1, 2, "PASS_WITH_NOTES"), ("s", 2, 2, "FLAGGED")]
    t = spark.createDataFrame([("s", "c", "SUPPORTS", True), ("s", "c", "SUPPORTS", False), ("s", "d", "SUPPORTS", True), ("s", "e", "CONTRADICTS", True), ("s", "e", "SUPPORTS", True)], "session_id string, claim_id string, entailment string, verbatim boolean")
    assert rows(hearing.citation_tiers(t)) == [("s", "c", "UNVERIFIABLE", "NEUTRAL"), ("s", "d", "VERIFIED", "SUPPORTS"), ("s", "e", "UNVERIFIABLE", "CONTRADICTS")]
    unquoted = t.filter("claim_id = 'e'").withColumn("verbatim", F.lit(False))
    assert rows(hearing.citation_tiers(unquoted)) == [("s", "e", "UNVERIFIABLE", "NEUTRAL")]
    left = hearing.prerequisites_left(spark.createDataFrame([("s", "S", [0]), ("s", "S", [2]), ("s", "T", None)], "session_id string, statute_id string, places array<int>"), spark.createDataFrame([("S", 4), ("T", 0)], "statute_id string, n int"))
    assert rows(left) == [("s", "S", [1, 3]), ("s", "T", [])]
    e = spark.createDataFrame([("s", 2, "E1", "S", "f", "v", "late", ["b"]), ("s", 1, "E1", "S", "f", "w", "early", ["a"]), ("s", 3, "E2", "S", "f", "x", "gone", [])], "session_id string, ord int, code string, statute_id string, field string, value string, detail string, record_ids array<string>")
    assert rows(hearing.dedupe_errors(e, spark.createDataFrame([("s", "f", "x")], "session_id string, field string, value string"))) == [("s", "E1", "S", "early", ["a", "b"])]
    assert [r.code for r in hearing.closed_codes(e, spark.createDataFrame([("E1",)], "code string")).collect()] == ["E2"]
    p = spark.createDataFrame([("c", "a", "P"), ("c", "b", "P"), ("c", "b", "R"), ("c", "z", "P")], "case_id string, issue_id string, favours string")
    assert rows(hearing.baseline_predictions(p, p.filter("issue_id <> 'z'"))) == [("c", "a", "P")]
    s = spark.createDataFrame([("s", 1, 10, 4), ("s", 2, 10, 4), ("s", 3, 10, 4)], "session_id string, turn int, full int, short int")
    assert [rows(hearing.condense(s, b)) for b in (30, 24, 12, 8, 0)] == [[("s", 30, 0, 0)], [("s", 24, 1, 0)], [("s", 12, 3, 0)], [("s", 8, 3, 1)], [("s", 0, 3, 3)]]
