"""Stated cases of the reports and checks."""

import datetime as dt
import difflib
import re

from pyspark.sql import functions as F

from docketlake.operators import checks, reports
from docketlake.plans import casework

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_corpus(spark):
    r = spark.createDataFrame([(1, "h", "a"), (2, "h", "b"), (3, "g", "a"), (3, "k", "a")], "id int, h string, label string")
    assert dict(rows(reports.corpus_audit(r, "id", "h", "label"))) == {"rows": 4, "contents": 3, "duplicated": 1, "conflicting_labels": 1, "id_collisions": 1}
    p = spark.createDataFrame([("A", "2"), ("A", "1")], "rule string, row_key string")
    assert rows(reports.format_audit(p)) == [("A", 2, "1")]


def test_bench_reports(spark):
    kind = "judge string, case_id string, result string, abstain_reason string, gap double, both_valid boolean, issues_abstained int, issues int"
    o = spark.createDataFrame([("j", "c1", "P", None, 0.1, True, 1, 2), ("j", "c2", "P", None, 0.3, True, 0, 2), ("j", "c3", None, "ORDER_SWAP_DISAGREEMENT", None, True, 2, 2), ("j", "c4", None, "INVALID", None, False, 9, 9), ("k", "c1", None, None, None, None, None, None)], kind)
    got = {r.judge: r for r in reports.persona_report(o, 2, 0.9, 0.3, 0.2).collect()}
    j = got["j"]
    assert (j.cases, j.decided, j.over_limit, j.issue_disagreement_rate, j.gaps, j.gap_median, j.gaps_over, j.top_wins, j.biased) == (4, 2, True, 0.5, 2, 0.2, 1, 2, True) and abs(j.disagreement_rate - 1 / 3) < 1e-12
    assert (got["k"].decided, got["k"].disagreement_rate, got["k"].biased) == (0, None, False) and not reports.persona_report(o.filter("judge = 'j'"), 3, 0.9, 0.3, 0.2).first().biased
    s = spark.createDataFrame([("s", "A", 1.0, 0.0), ("s", "A", 0.0, 0.0)], "session_id string, side string, x double, y double")
    assert rows(reports.advocacy(s, {"x": 3.0, "y": 1.0})) == [("s", "A", 0.375)]
    m = spark.createDataFrame([("r", "c", "1", "1"), ("r", "d", None, None), ("q", "c", "1", "2")], "run_id string, case_id string, before string, after string")
    assert rows(reports.memory_proof(m)) == [("q", False), ("r", True)]
    d = spark.createDataFrame([("x", False, True, 1.0), ("x", False, False, 3.0), ("x", True, True, 2.0)], "arm string, mutated boolean, rejected boolean, seconds double")
    assert rows(reports.arm_rates(d)) == [("x", 0.5, 1.0, 2.0)]
    a, b = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "i int, e array<string>"), spark.createDataFrame([(1, ["y", "x"]), (3, [])], "i int, e array<string>")
    assert [r.i for r in reports.arm_differences(a, b, "i", "e").orderBy("i").collect()] == [2, 3]


def test_evidence_and_runs(spark):
    p = spark.createDataFrame([("c", "i", "IN_RECORD", ["E1"]), ("c", "i", "IN_RECORD", ["E9"]), ("c", "j", "IN_RECORD", ["E1", "E9"]), ("c", "k", "ELSEWHERE", ["E1"])], "case_id string, issue_id string, place string, ids array<string>")
    assert rows(reports.evidence_available(p, spark.createDataFrame([("c", "E1")], "case_id string, record_id string"))) == [("c", "i", False), ("c", "j", True), ("c", "k", False)]
    led = spark.createDataFrame([("r", [("c", [("plan", "DONE")], "s1"), ("d", [], None)])], "run_id string, jobs array<struct<case_id:string,stages:array<struct<stage:string,status:string>>,session_id:string>>")
    assert [(r.seq, r.case_id, r.stages, r.session_id) for r in reports.run_listing(led).orderBy("seq").collect()] == [(0, "c", {"plan": "DONE"}, "s1"), (1, "d", {}, None)]
    pin = spark.createDataFrame([("s", "A", "f", {"A": ["l1"]}), ("t", "A", "f", None)], "session_id string, side string, family string, pins map<string,array<string>>")
    assert rows(reports.served_lessons(pin, spark.createDataFrame([("l2", "f")], "lesson_id string, family string"))) == [("s", "A", "l1"), ("t", "A", "l2")]
    plan = spark.createDataFrame([(D(2020, 1, 1),)], "decided date")
    src = lambda *v: spark.createDataFrame([(x,) for x in v], "source_decided date")
    assert [reports.lessons_from_the_future(plan, src(*v)).first().refused for v in ((D(2019, 1, 1),), (D(2021, 1, 1),), (None,))] == [False, True, True]
    t = lambda h: dt.datetime(2020, 1, 1, h)
    turns = spark.createDataFrame([("s", t(2), "x")], "session_id string, ts timestamp, payload string")
    calls = spark.createDataFrame([("s", t(1), "y", "k")], "session_id string, ts timestamp, payload string, key string")
    got = reports.trace_records({"turn": turns, "call": calls}, spark.createDataFrame([("k", "answer")], "key string, answer string")).orderBy("seq").collect()
    assert [(r.kind, r.answer) for r in got] == [("call", "answer"), ("turn", None)]


def test_readings_and_rules(spark):
    r = spark.createDataFrame([("c", "S", "p", "1"), ("c", "S", "p", "1"), ("c", "S", "q", "1"), ("c", "S", "q", "2"), ("c", "T", "p", None)], "case_id string, statute_id string, parameter string, value string")
    assert rows(reports.threshold_agreement(r)) == [("c", "S", "p", True), ("c", "S", "q", False), ("c", "T", "p", False)]
    dates = spark.createDataFrame([("c", "FILED", D(2020, 1, 1)), ("c", "DECISION", D(2021, 1, 1))], "case_id string, label string, day date")
    alt = spark.createDataFrame([("late", "c", "FILED", D(2020, 6, 1)), ("none", "c", "FILED", None)], "reading string, case_id string, label string, day date")
    assert rows(reports.alternative_dates(dates, alt)) == [("late", "c", "DECISION", D(2021, 1, 1)), ("late", "c", "FILED", D(2020, 6, 1)), ("none", "c", "DECISION", D(2021, 1, 1))]
    law = spark.createDataFrame([("S", "t", None)], "statute_id string, title string, note string")
    v = [reports.law_fingerprint(law, F.lit(a)).first().version for a in ("1", "1", "2")]
    assert v[0] == v[1] != v[2] and reports.law_fingerprint(law.fillna(""), F.lit("1")).first().version != v[0]
    s = spark.createDataFrame([("s", "REFLECTED", ["b"]), ("t", "VERDICT", ["b"])], "session_id string, state string, lesson_ids array<string>")
    rec = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "session_id string, lesson_id string")
    assert rows(reports.recovered_union(s, rec)) == [("s", ["a", "b"]), ("t", ["b"])]
    ap = spark.createDataFrame([("S", "period_years", "int", 3, None, None), ("S", "excluded_window", "range", None, D(2020, 3, 1), D(2020, 9, 1)), ("T", "period_years", "bool", 1, None, None)], "statute_id string, parameter string, kind string, n int, from date, to date")
    assert rows(reports.period_rule(ap)) == [("S", 3, D(2020, 3, 1), D(2020, 9, 1), None)]
    cards = spark.createDataFrame([(1, "u#1", "A"), (1, "v#1", "B"), (1, "v#2", "B")], "query_id int, uid string, precedent_id string")
    chosen = spark.createDataFrame([(1, "A"), (1, "B"), (1, "v#2"), (1, "x#1")], "query_id int, id string")
    assert rows(reports.held_cards(chosen, cards)) == [(1, "u#1"), (1, "v#2")]
    assert rows(reports.desk_answers(cards, spark.createDataFrame([("u#1",)], "uid string"))) == [(1, 2, "NEW")]


def test_drafts(spark):
    d = spark.createDataFrame([(1, "due on 4 March 2020", "It was due  on 4 March 2020.", D(2020, 3, 4), "OK"), (2, "x", "x and x", D(2020, 3, 4), "ODD"), (3, None, "text", None, None)], "draft_id int, quote string, source_text string, value_date date, term string")
    assert rows(checks.draft_checks(d, ["OK"])) == [(2, "DATE_NOT_IN_QUOTE"), (2, "NOT_UNIQUE"), (2, "UNKNOWN_TERM"), (3, "NOT_VERBATIM")]
    lit = spark.createDataFrame([(1, "on March 4, 2020 paid ₹1 lakh", D(2020, 3, 4), 100000.0), (2, "nothing", D(2020, 3, 4), 5.0), (3, None, None, None)], "fact_id int, source_text string, day date, amount double")
    assert rows(checks.literal_problems(lit)) == [(2, "AMOUNT_NOT_WRITTEN"), (2, "DATE_NOT_WRITTEN")]
    assert spark.createDataFrame([("2 crore or 3",)], "t string").select(checks.units(F.col("t"), {"crore": 10**7, "lakh": 10**5})).first()[0] == [2.0, 3.0, 2e7, 3e7]
    c = spark.createDataFrame([(1, "The debt  is due", "debt is due", True, False, None, 0.9, None), (2, "x", "y", True, True, False, 0.1, False)], "claim_id int, text string, quote string, known boolean, exhibit_kind boolean, has_exhibit boolean, confidence double, second boolean")
    assert rows(checks.fidelity(c, 0.5)) == [(1, False, []), (2, True, ["NOT_VERBATIM", "NO_EXHIBIT", "LOW_CONFIDENCE", "DENIED"])]
    z = spark.createDataFrame([("some text", [("a", "text", 0.9), ("a", "none", 0.9), ("q", "text", 0.9)])], "t string, r array<struct<name:string,quote:string,confidence:double>>")
    assert [tuple(x) for x in z.select(checks.zero_confidence(F.col("r"), F.col("t"), ["a"])).first()[0]] == [("a", "text", 0.9), ("a", "none", 0.0)]
    cl = spark.createDataFrame([(1, "k", 0.3), (2, "k", 0.31), (3, "z", 1.0)], "claim_id int, key string, claimed double")
    assert rows(checks.tracked_equality(cl, spark.createDataFrame([("k", 0.3)], "key string, value double"))) == [(1, "k", "HOLDS"), (2, "k", "FAILS"), (3, "z", "UNKNOWN")]


def test_names_and_lines(spark):
    t = spark.createDataFrame([(1, "Kappa met kappa; ABC and abc, KAPPA OMEGA Ltd")], "doc_id int, text string")
    assert checks.pseudonyms(t, {"Kappa": "N1", "ABC": "N2", "Kappa Omega": "N3"}).first().text == "N1 met N1; N2 and abc, N3 Ltd"
    assert rows(checks.residual_names(t, spark.createDataFrame([("Kappa Ltd",)], "name string"))) == [(1, "Kappa", 0)]
    l = spark.createDataFrame([(1, ["HEAD LINE", "x"], "HEAD LINE a HEAD LINE b"), (2, None, "b"), (3, ["ONCE HERE"], "ONCE HERE")], "doc_id int, header array<string>, body string")
    assert rows(checks.remove_running_text(l, 5)) == [(1, " a  b"), (2, "b"), (3, "ONCE HERE")]
    h = spark.createDataFrame([(1, 1, "the JUDGMENT of"), (1, 5, " j u d g m e n t "), (2, 3, "a JUDGMENT b")], "doc_id int, line int, text string")
    assert rows(checks.header_line(h, "Judgment")) == [(1, 5), (2, 3)]
    j = spark.createDataFrame([('{"a": {"b": 1}, "c": [1]}',)], "j string")
    assert [j.select(checks.json_value(F.col("j"), p)).first()[0] for p in ("a.b", "a", "c", "z")] == ["1", None, None, None]
    r = spark.createDataFrame([("i", 1, "the same long text here"), ("i", 2, "the same long text there"), ("i", 3, "unlike")], "id string, k int, t string")
    assert [(x.k, x.kept_key) for x in checks.same_id_copies(r, "id", "k", "t", 0.9).collect()] == [(2, 1)]


def test_copies_of_any_kept_row_of_an_id(spark):
    a, b = "the tenant paid rent for the yard each month", "an appeal against the order was filed too late"
    data = [("i", 1, a), ("i", 2, b), ("i", 3, b + "!"), ("i", 4, b), ("i", 5, a), ("i", 6, a + "s"), ("j", 7, b), ("j", 8, b), ("k", 9, None), ("k", 10, None)]
    got = checks.same_id_copies(spark.createDataFrame(data, "id string, k int, t string"), "id", "k", "t", 0.9)
    assert rows(got.select("k", "kept_key")) == sorted([(3, 2), (4, 2), (5, 1), (6, 1), (8, 7)], key=repr)


def test_likely_copies_equal_the_reference_rule(spark, sf):
    p = spark.read.parquet(f"{sf}/precedents.parquet").filter("precedent_id is not null").orderBy("row_no").collect()
    kept, want = {}, []
    for r in p:
        joined = " ".join([r.ratio_text or "", *(x for x in r.facts_texts or () if x is not None), r.final_order or ""])
        t = re.sub(r"[^a-z0-9]+", " ", joined.lower()).strip()
        mine = kept.setdefault(r.precedent_id, [])
        like = next((k for k, u in mine if u == t or difflib.SequenceMatcher(None, u, t).ratio() >= 0.9), None)
        if like is None:
            mine.append((r.row_no, t))
        else:
            want.append((r.row_no, like))
    assert rows(casework.likely_copies(spark, sf).select("row_no", "kept_key")) == sorted(want, key=repr) and want
