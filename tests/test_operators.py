"""Known values and stated cases of the library operators."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import evaluation, memory, overlap, predicates, quality, resolve, runlog, sync, temporal, vector, voting
from docketlake.plans import library
from docketlake.sources import files
from docketlake.streaming import logs

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


OVERLAY = "statute_id string, parameter string, value_bool boolean, value string, keyed_on string, effective_from date, effective_to date, status string"


def status(spark, overlay, day, label="DECISION"):
    law = spark.createDataFrame([("S",), ("T",)], "statute_id string")
    dates = spark.createDataFrame([("c", label, day)], "case_id string, label string, day date")
    asked = spark.createDataFrame([("c", "S"), ("c", "S"), ("c", "Z")], "case_id string, statute_id string")
    got = temporal.resolve_statutes(law, spark.createDataFrame(overlay, OVERLAY), dates, asked).collect()
    assert len(got) == 1 and got[0].statute_id == "S"
    got = got[0]
    return got.status, got.unresolved, [tuple(a) for a in got.applied]


def test_statutes_as_of_a_day(spark):
    since = [("S", "section_in_force", True, None, "DECISION", D(2001, 1, 1), None, "APPROVED")]
    assert status(spark, since, D(2000, 12, 31))[0] == "HIDDEN" and status(spark, since, D(2001, 1, 1))[0] == "CONFIRMED"
    until = [("S", "section_in_force", True, None, "DECISION", None, D(2004, 12, 31), "APPROVED"), ("S", "section_in_force", False, None, "DECISION", D(2005, 1, 1), None, "APPROVED")]
    assert status(spark, until, D(2004, 12, 31))[0] == "CONFIRMED" and status(spark, until, D(2005, 1, 1))[0] == "HIDDEN"
    lacking = [("S", "section_in_force", True, None, "FILING", None, None, "APPROVED")]
    assert status(spark, lacking, D(2005, 1, 1))[:2] == ("UNVERIFIED", 1)
    two = [("S", "limit", None, "1", "DECISION", None, None, "APPROVED"), ("S", "limit", None, "2", "DECISION", D(2000, 1, 1), None, "APPROVED")]
    assert status(spark, two, D(2005, 1, 1))[0] == "CONFLICT" and status(spark, two, D(1999, 1, 1)) == ("UNVERIFIED", 0, [("limit", "1")])
    assert status(spark, [(*since[0][:-1], "DRAFT")], D(2000, 1, 1))[0] == "UNVERIFIED"


def test_limitation(spark):
    kind = "default_day date, acks array<date>, period_years int, excluded struct<from:date,to:date>, minimum_days int"
    data = [
        (D(2000, 2, 29), [], 3, (None, None), 0), (D(2001, 6, 1), [D(2005, 6, 1), D(2003, 1, 1)], 3, (None, None), 0), (D(2007, 4, 1), None, 3, (D(2010, 3, 15), D(2012, 2, 28)), 90),
        (D(2001, 6, 1), [D(2009, 1, 1)], 3, (D(2009, 1, 1), D(2009, 2, 1)), 0), (D(2010, 1, 1), [], 3, (D(2010, 3, 15), D(2012, 2, 28)), 0), (D(2012, 1, 1), [], 3, (D(2010, 3, 15), D(2012, 2, 28)), 0),
        (D(2012, 3, 1), [], 3, (D(2010, 3, 15), D(2012, 2, 28)), 0),
    ]
    got = temporal.limitation_expiry(spark.createDataFrame(data, kind)).select("expiry", "needs_review").collect()
    assert [r.expiry for r in got] == [D(2003, 2, 28), D(2008, 6, 1), D(2012, 2, 29) + dt.timedelta(days=90), D(2004, 6, 1), D(2012, 2, 29) + (D(2013, 1, 1) - D(2010, 3, 15)), D(2012, 2, 29) + (D(2015, 1, 1) - D(2012, 1, 1)), D(2015, 3, 1)] and [r.needs_review for r in got] == [False, False, False, True, False, False, False]


def test_windows_and_overlaps(spark):
    a = lambda s: F.lit(s).cast("date")
    got = spark.range(1).select(
        temporal.windows_overlap(a("2020-01-01"), a(None), a(None), a("2020-01-01")), temporal.windows_overlap(a("2020-01-02"), a(None), a(None), a("2020-01-01")),
        temporal.covers(a(None), a("2020-01-01"), a("2020-01-01")), temporal.covers(a("2020-01-02"), a(None), a("2020-01-01")),
    ).first()
    assert list(got) == [True, False, True, False]
    t = lambda m: dt.datetime(2020, m, 1)
    rec = spark.createDataFrame([(1, "k", t(1), t(3)), (2, "k", t(2), None), (3, "k", t(9), None), (4, "o", t(1), None)], "rec_no int, key string, start timestamp_ntz, end timestamp_ntz")
    assert [r[0] for r in rows(temporal.overlapping(rec).select("rec_no"))] == [2, 3]
    asked = spark.createDataFrame([(1, "k", t(1)), (2, "k", t(2)), (3, "o", dt.datetime(2019, 1, 1)), (4, "z", t(1))], "ask_id int, key string, at timestamp_ntz")
    assert rows(temporal.records_as_of(asked, rec)) == [(1, "CONFIRMED", 1), (2, "CONFLICT", None), (3, "HIDDEN", None), (4, "UNVERIFIED", None)]


def test_confidence_and_weight(spark):
    c, df = 0.5, spark.range(1)
    retired = []
    for _ in range(7):
        new, out = temporal.confidence_step(F.lit(c), F.lit(0.9), F.lit(0.1))
        c, r = df.select(new, out).first()
        retired.append(r)
    assert retired == [False] * 6 + [True]
    assert df.select(temporal.confidence_step(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.1))[0]).first()[0] == 0.5


def test_moves_and_dates(spark):
    p = spark.createDataFrame([("p1", "S", "bars", 0, "h1", "APPROVED"), ("p2", "S", "bars", 1, "gone", "APPROVED")], "predicate_id string, statute_id string, field string, item_index int, item_hash string, status string")
    items = spark.createDataFrame([("S", "bars", 2, "h1"), ("S", "bars", 3, "h1")], "statute_id string, field string, pos int, hash string")
    assert rows(temporal.checklist_moves(p, items)) == [("p1", 2, "APPROVED"), ("p2", None, "STALE")]
    cases = spark.createDataFrame([("c", D(2020, 1, 1), [("FILED", D(2019, 1, 1))]), ("d", None, None)], "case_id string, decided_on date, key_dates array<struct<label:string,day:date>>")
    assert rows(temporal.case_dates(cases)) == [("c", "DECISION", D(2020, 1, 1)), ("c", "FILED", D(2019, 1, 1))]


def test_evaluation_values(spark):
    t = spark.createDataFrame([("P", "P")] * 8 + [("R", "P")] * 2, "truth string, prediction string")
    assert evaluation.balanced_accuracy(t).first()[0] == 0.5
    f = spark.createDataFrame([("P", "P"), ("P", "R"), ("R", "P"), ("R", "R")], "truth string, prediction string")
    assert evaluation.macro_f1(f, spark.createDataFrame([("P",), ("R",)], "label string")).first()[0] == 0.5
    m = spark.createDataFrame([(0, 0), (0, 6), (3, 3), (1, 9)], "a long, b long").select(evaluation.mcnemar(F.col("a"), F.col("b")))
    assert [r[0] for r in m.collect()] == pytest.approx([1.0, 2 / 64, 1.0, 22 / 1024])
    big = spark.createDataFrame([(40_000, 40_100)], "a long, b long").select(evaluation.mcnemar(F.col("a"), F.col("b"))).first()[0]
    assert big == pytest.approx(0.7264, abs=2e-3)
    e = spark.createDataFrame([(1, "g", "R"), (2, "g", "R"), (3, "g", "P")], "seq int, g string, truth string")
    assert [r.prediction for r in evaluation.expanding_majority(e, ["P", "R"], ["g"], ["seq"], "truth").orderBy("seq").collect()] == [None, "R", "R"]
    none = evaluation.accuracy(spark.createDataFrame([("P", None)], "truth string, prediction string")).first()
    assert (none.coverage, none.accuracy) == (0.0, None)
    tie = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "g string, v string")
    assert rows(evaluation.majority(tie, ["g"], "v")) == [("a", None), ("b", "x")]


def test_alignment_and_quality(spark):
    framed = spark.createDataFrame([("c", i) for i in "abcd"], "case_id string, issue_id string")
    truth = spark.createDataFrame([("c", "a", "P", "LAW"), ("c", "b", "P", "MIXED"), ("c", "d", "P", "EVIDENCE")], "case_id string, issue_id string, favours string, driver string")
    bench = spark.createDataFrame([("c", "a", "P"), ("c", "b", "R"), ("c", "d", "P")], "case_id string, issue_id string, favours string")
    assert rows(evaluation.issue_alignment(framed, truth, bench)) == [("c", 2, 0.5)]
    assert evaluation.issue_alignment(framed, truth, bench, framed).first().compared == 3
    f = spark.createDataFrame([("c", "x")], "k string, i string")
    r = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "k string, i string")
    assert rows(evaluation.set_precision_recall(f, r, "k", "i")) == [("c", 1.0, 0.5), ("d", None, 0.0)]
    q = evaluation.retrieval_quality(spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 9)], "query_id int, found_at int"), 5).first()
    assert (q.recall_at_k, q.mrr) == (0.5, 1.25 / 4)


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(20)], "g string, i int, v double")
    run = lambda seed: evaluation.bootstrap(df, ["g"], "v", ["i"], lambda v: sum(v) / len(v), 200, seed=seed).first()
    assert run(7) == run(7) != run(8) and run(7).low < 9.5 < run(7).high


def test_votes(spark):
    o = spark.createDataFrame([("s", "j1", "AB", True, "P"), ("s", "j1", "BA", True, "P"), ("s", "j2", "AB", True, "P"), ("s", "j2", "BA", True, "R"), ("s", "j3", "AB", False, "P"), ("s", "j3", "BA", True, "P"), ("s", "j4", "AB", True, "R")], "session_id string, judge string, ord string, valid boolean, result string")
    folded = voting.fold_judges(o)
    assert rows(folded) == [("s", "j1", "P", "AGREED"), ("s", "j2", None, "ORDER_SWAP_DISAGREEMENT"), ("s", "j3", None, "INVALID"), ("s", "j4", "R", "ONE_ORDER")]
    votes = folded.withColumn("score", F.when(F.col("winner") == "P", 0.9).otherwise(0.1)).withColumn("accuracy", F.lit(0.5))
    assert rows(voting.verdicts(votes, 2)) == [("s", None, "EVEN_SPLIT")] and rows(voting.verdicts(votes, 3)) == [("s", None, "UNSTABLE_TOO_FEW")]
    assert rows(voting.verdicts(votes, 2, 0.2)) == [("s", "P", "TIE_SCORE")] and rows(voting.verdicts(votes, 2, 0.9)) == [("s", None, "UNBROKEN_TIE")]
    v = spark.createDataFrame([("s", "i", "a", "P"), ("s", "i", "b", "P"), ("s", "i", "c", "R"), ("s", "k", "a", "P"), ("s", "k", "b", "R"), ("s", "m", "a", None)], "session_id string, issue_id string, judge string, upholds string")
    assert rows(voting.issue_findings(v, 2)) == [("s", "i", "P"), ("s", "k", None), ("s", "m", None)]


def test_bench_metrics_and_problems(spark):
    kind = "session_id string, judge string, ord string, valid boolean, result string, first string, issues array<struct<issue_id:string,upholds:string,rules:array<string>>>"
    steady = [("s", "j", o, True, "P", f, [("i", "P", ["r1"])]) for o, f in (("AB", "P"), ("BA", "R"))]
    flip = [("s", "k", "AB", True, "P", "P", [("i", "P", ["r1"])]), ("s", "k", "BA", True, "R", "R", [("i", "R", []), ("i", "R", ["r9"]), ("x", "P", ["r1"])])]
    df = spark.createDataFrame(steady + flip, kind)
    assert tuple(voting.bench_metrics(df).first()) == (1, 1, 3)
    issues, rules = spark.createDataFrame([("s", "i"), ("s", "h")], "session_id string, issue_id string"), spark.createDataFrame([("s", "r1")], "session_id string, rule string")
    got = {tuple(r)[1:] for r in voting.opinion_problems(df, issues, rules).collect() if r.ord == "BA" and r.judge == "k"}
    assert got == {("k", "BA", "MISSING_ISSUE", "h"), ("k", "BA", "REPEATED_ISSUE", "i"), ("k", "BA", "UNKNOWN_ISSUE", "x"), ("k", "BA", "UNKNOWN_RULE", "r9"), ("k", "BA", "NO_RULE", "i")}


def test_sync(spark):
    s = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", "1", None), ("d", "1", "1")], "k string, content_hash string, derived_hash string")
    n = spark.createDataFrame([("a", "1", "1"), ("b", "2", "1"), ("c", "1", "1"), ("e", "1", "1")], "k string, content_hash string, derived_hash string")
    assert rows(sync.incremental_sync(s, n, "k")) == [("a", "unchanged"), ("b", "update"), ("c", "refresh"), ("d", "remove"), ("e", "insert")]
    assert {r.action for r in sync.incremental_sync(n, n, "k").collect()} == {"unchanged"}
    assert sync.upsert(s, n, "k").count() == 5 and sync.delete_ids(s, n, "k").count() == 1
    stored, refused = sync.append_only(s, n.union(n.filter("k = 'e'")), "k")
    assert stored.count() == 4 and refused.count() == 5
    h = lambda d: sync.snapshot_hash(d, "k", "content_hash").first()[0]
    assert h(s) == h(s.orderBy(F.desc("k")).repartition(3)) != h(n)
    f = spark.createDataFrame([("u", "x", 2), ("u", "y", 1), ("v", "x", 1)], "uid string, c string, at int")
    assert rows(sync.first_seen(f, "uid", "c", ["at"])) == [("u", 2, 2, "y", True)]


def test_citations(spark):
    known = spark.createDataFrame([(x,) for x in ("CODE_2016_SEC_7", "CODE_2016_SEC_5_2", "CODE_2016_SEC_12", "ACT_1999_PART_SEC_3")], "statute_id string")
    cited = spark.createDataFrame([(x,) for x in ("CODE_2016_SEC_7", "CODE_2016_SEC_5(2)", "CODE_2016_SEC_12(3)", "CODE_2016_SEC_7_1", "ACT_1999_SEC_3", "code 2016 sec 7", "OLD_2016_SEC_7", "NONE", None)], "citation string")
    aliases = spark.createDataFrame([("OLD_2016", "CODE_2016"), ("OLD", "X"), ("LOST", "GONE")], "cited_prefix string, law_db_prefix string")
    got = {r.citation: (r.statute_id, r.rule) for r in resolve.resolve(cited, known, aliases).collect()}
    assert got == {
        "CODE_2016_SEC_7": ("CODE_2016_SEC_7", "exact"), "CODE_2016_SEC_5(2)": ("CODE_2016_SEC_5_2", "bracket"), "CODE_2016_SEC_12(3)": ("CODE_2016_SEC_12", "stripped"), "CODE_2016_SEC_7_1": ("CODE_2016_SEC_7", "prefix"),
        "ACT_1999_SEC_3": ("ACT_1999_PART_SEC_3", "spelling"), "code 2016 sec 7": ("CODE_2016_SEC_7", "normal_exact"), "OLD_2016_SEC_7": ("CODE_2016_SEC_7", "alias_exact"), "NONE": (None, None),
    }
    assert [r.cited_prefix for r in resolve.unmatched_targets(aliases, known).collect()] == ["OLD", "LOST"]
    law = spark.createDataFrame([(1, "A", ["B", "X", "B", None, "A"]), (2, "B", None)], "rec_no int, statute_id string, intersecting_statute_ids array<string>")
    assert rows(resolve.related(law)) == [(1, ["B", "A"])]
    assert rows(resolve.rewrite_references(law, spark.createDataFrame([("X", "A")], "missing_id string, suggestion string"))) == [(1, ["B", "A"])]
    a, b = spark.createDataFrame([("k", "S_1"), ("k", "T")], "k string, a string"), spark.createDataFrame([("k", "S_1_2"), ("k", "S_10"), ("k", "T")], "k string, b string")
    assert rows(resolve.contained(a, b, "k")) == [("k", "S_1", "S_1_2"), ("k", "T", "T")]


def test_overlap(spark):
    titles = spark.createDataFrame([("P-1", "Kappa Omega Steels Ltd vs State"), ("P-2", "Kappa Omega Bank vs X"), ("P-3", "Kappa Delta Ltd")], "title_id string, text string")
    kind = "name_id string, text string, variants array<string>, kind string, role string"
    names = spark.createDataFrame([("n", "Kappa Omega Holdings Limited", None, "COMPANY", None), ("m", "Ltd", [], "COMPANY", None), ("p", "Omega Kappa", ["Delta, Kappa"], "PERSON", "APPELLANT"), ("q", "Omega Kappa", None, "PERSON", None), ("b", "Omega Bank", None, "BANK", None)], kind)
    got = rows(overlap.shared_names(titles, names, 2))
    assert got == [("P-1", "n", 2, "NAME"), ("P-1", "p", 2, "NAME"), ("P-2", "n", 2, "NAME"), ("P-2", "p", 2, "NAME"), ("P-3", "p", 2, "NAME")]
    numbers = spark.createDataFrame([("b", "7/2019")], "name_id string, number string")
    numbered = titles.withColumn("numbers", F.when(F.col("title_id") != "P-1", F.array(F.lit("7/2019"))))
    assert rows(overlap.shared_names(numbered, names.filter("name_id = 'b'"), 2, case_numbers=numbers)) == [("P-2", "b", 1, "NUMBER")]
    asked = spark.createDataFrame([("c", "It is Kappa against Omega"), ("d", "No. 07 of 2019"), ("e", "unsure")], "case_id string, text string")
    known = overlap.identified(asked, spark.createDataFrame([("c", "Kappa Omega Ltd"), ("e", "Ltd")], "case_id string, name string"), spark.createDataFrame([("d", "7/2019")], "case_id string, number string"))
    assert rows(known) == [("c", True), ("d", True), ("e", False)]
    v = spark.createDataFrame([("k", "one two three four five"), ("z", "one two three")], "key string, text string")
    s = spark.createDataFrame([("k", 1, "zero one two three four"), ("k", 2, "short"), ("k", 3, None)], "key string, source_id int, text string")
    assert rows(overlap.leakage(v, s, None, 3)) == [("k", 1, 2)] and rows(overlap.leakage(v, s, v.filter("key = 'k'"), 3)) == []
    lines = spark.createDataFrame([("d", p, t) for p in (1, 2, 3) for t in (f"Page {p} of 3", f"text {'abc'[p - 1]}")], "doc_id string, page int, text string")
    assert rows(overlap.furniture(lines, 0.5)) == [("d", "Page # of #", 3)]
    spans = spark.createDataFrame([("d", 0, 5), ("d", 4, 9), ("d", 20, 22), ("d", 30, 31)], "doc_id string, start int, end int")
    assert rows(overlap.merge_spans(spans, 2)) == [("d", 0, 9), ("d", 20, 22)]
    answers = spark.createDataFrame([("c", "It was Kappa, with Omega beside it")], "case_id string, text string")
    assert rows(overlap.recalled_names(answers, spark.createDataFrame([("c", "Kappa Omega Ltd"), ("c", "Delta Omega Ltd")], "case_id string, name string"))) == [("c", "Kappa Omega Ltd")]


def test_vectors(spark):
    v = spark.createDataFrame([("a", D(2020, 1, 1), [1.0, 0.0], ["S"], "A"), ("b", D(2021, 1, 1), [0.0, 2.0], ["T"], "B"), ("c", D(2022, 1, 1), [1.0, 1.0], [], "A"), ("d", None, [1.0, 1.0], None, "D")], "uid string, decided date, vec array<double>, statutes array<string>, precedent_id string")
    scope = lambda **k: [r.uid for r in vector.scoped(v, F.lit(D(2022, 1, 1)), **k).orderBy("uid").collect()]
    assert scope() == ["a", "b"] and scope(statutes=["S", "Z"]) == ["a"] and scope(statutes=[]) == [] and scope(excluded=v.filter("uid = 'c'")) == ["b"]
    q = v.filter("uid in ('b', 'c')").withColumnRenamed("uid", "query_id")
    got = vector.top_k(v.filter("decided is not null"), q, 2, before=True).select("query_id", "uid", "rank")
    assert rows(got) == [("b", "a", 1), ("c", "a", 1), ("c", "b", 2)]
    zero = v.select(vector.cosine(F.col("vec"), F.array(F.lit(0.0), F.lit(0.0)))).first()[0]
    assert zero == 0.0 and v.select(vector.cosine(F.col("vec"), F.array(F.lit(1.0)))).first()[0] is None
    turns = spark.createDataFrame([("s", "A", 1, [1.0, 0.0]), ("s", "A", 3, [2.0, 0.0]), ("s", "B", 2, [1.0, 0.0])], "session_id string, side string, turn int, vec array<double>")
    assert rows(vector.repetition(turns, 0.92)) == [("s", "A", 3, 1.0, True)]
    c = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3)], "query_id int, uid string, score double, rank int")
    p = spark.createDataFrame([(1, "b", 0, 0.5), (1, "b", 1, 0.5), (1, "a", 0, 0.4)], "query_id int, uid string, position int, passage_score double")
    assert [(r.uid, r.best_position) for r in vector.rerank(c, p, 3).orderBy("new_rank").collect()] == [("b", 0), ("a", 0), ("c", None)]


def test_memory(spark):
    l = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1), (5, 1)], "id int, t int").withColumn("g", F.lit("g"))
    assert memory.budget_pick(l, ["g"], [F.col("id")], "id", "t", 10, 3).first().picked == [1, 3, 4]
    assert memory.exploration(l, ["g"], "id", 2, "7").first() == memory.exploration(l.repartition(3), ["g"], "id", 2, "7").first()
    k = "lesson_id int, status string, party_status string, statute_ids array<string>, law_versions map<string,string>"
    u = spark.createDataFrame([(1, "ACTIVE", "A", ["S"], {"S": "2"}), (2, "ACTIVE", "A", None, {}), (3, "ACTIVE", "A", ["Z"], {}), (4, "RETIRED", "A", [], {}), (5, "ACTIVE", "A", ["S"], {"S": "1", "Q": "9"})], k)
    assert [r.lesson_id for r in memory.usable_lessons(u, "A", ["S"], {"S": "1"}).orderBy("lesson_id").collect()] == [2, 5]


def test_runlog(spark):
    t = lambda h: dt.datetime(2020, 1, 1, h)
    e = spark.createDataFrame([("s", 1, "OPEN", t(1)), ("s", 2, "RUN", t(2)), ("s", 3, "RUN", t(3)), ("s", 4, "OPEN", t(9))], "s string, i int, k string, ts timestamp_ntz")
    got = runlog.trace_summary(e, "s", ["ts", "i"], "k").first()
    assert (got.n_events, got.first_kind, got.last_kind, got.kinds) == (4, "OPEN", "OPEN", {"OPEN": 2, "RUN": 2})
    assert rows(runlog.bad_transitions(e, spark.createDataFrame([("OPEN", "RUN")], "old string, new string"), "s", ["i"], "k")) == [("s", "RUN", "OPEN", 1)]
    assert [r.seq for r in runlog.number_events(e, "s", ["i"], spark.createDataFrame([("s", 10)], "s string, last_seq long")).orderBy("i").collect()] == [11, 12, 13, 14]
    turns = runlog.turn_schedule(spark.createDataFrame([("s", 3)], "session_id string, turns int")).orderBy("turn").collect()
    assert [(r.side, r.kind) for r in turns] == [("A", "OPENING"), ("B", "OPENING"), ("A", "ARGUMENT"), ("B", "CLOSING"), ("A", "CLOSING")]
    calls = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "m string, units double")
    assert rows(runlog.spend(calls, spark.createDataFrame([("a", 0.5)], "m string, price double"), ["m"])) == [("a", 1, 2.0, 1.0, True), ("b", 1, 3.0, None, False)]
    jobs = spark.createDataFrame([(1, [("x", "DONE"), ("y", "DRY")]), (2, [("x", "DONE")])], "job_id int, stages array<struct<stage:string,status:string>>")
    assert rows(runlog.stage_matrix(jobs)) == [("x", "DONE", 2), ("y", "DRY", 1)]


V, C = lambda n: {"var": n}, lambda v, s=None: {"const": v, **({"sort": s} if s else {})}
INPUTS = {"n": "number", "d": "date", "b": "bool"}


@pytest.mark.parametrize(
    "tree, want",
    [
        ({"op": "==", "args": [{"op": "+", "args": [C(0.1), C(0.2)]}, C(0.3)]}, "PASS"),
        ({"op": "<", "args": [V("n"), C(5)]}, "PASS"), ({"op": ">=", "args": [V("n"), C(5)]}, "FAIL"),
        ({"op": "or", "args": [C(True), V("b")]}, "SKIPPED"), ({"op": "<", "args": [V("n"), V("d")]}, "SKIPPED"), ({"op": "nand", "args": [C(True)]}, "SKIPPED"),
        ({"op": "==", "args": [{"op": "days_between", "args": [V("d"), C("2020-03-01", "date")]}, C(1)]}, "PASS"),
        ({"op": "==", "args": [{"op": "add_years", "args": [V("d"), C(1)]}, C("2021-02-28", "date")]}, "PASS"),
        ({"op": "if", "args": [{"op": ">", "args": [V("n"), C(9)]}, C(False), C(True)]}, "PASS"),
        ({"choose": "r", "options": {"x": {"op": "<", "args": [V("n"), C(5)]}, "y": V("b")}}, "PASS"),
        (V("n"), "SKIPPED"),
    ],
)
def test_predicates(spark, tree, want):
    df = spark.createDataFrame([(1, 4.0, D(2020, 2, 29), None)], "id int, n double, d date, b boolean")
    got = predicates.evaluate(df, "p", json.dumps(tree), INPUTS, "ERR", ["id"], {"r": "x"}).first()
    assert got.outcome == want and got.error_code == ("ERR" if want == "FAIL" else None)


def test_quality(spark):
    law = spark.createDataFrame([(1, "A", ["X", "x", "X"], ["A", "B", "B"]), (2, "B", None, None)], "rec_no int, statute_id string, audit_error_codes array<string>, intersecting_statute_ids array<string>")
    got = {(r.row_key, r.rule) for r in quality.law_hygiene(law).collect()}
    assert got == {("1", "CODE_NOT_UPPER"), ("1", "REPEATED_CODE"), ("1", "SELF_REFERENCE"), ("1", "REPEATED_REFERENCE"), ("2", "NO_CODES")}
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert rows(quality.exactly_one(k("a", "a", "z"), k("a", "b"), "k")) == [("a", "REPEATED"), ("b", "MISSING"), ("z", "UNKNOWN")]
    assert rows(quality.dangling(k("a", "a", None), k("b"), "k", "k")) == [("a", 2)]
    pair = lambda *v: spark.createDataFrame(list(v), "slot string, key string")
    got = rows(quality.agreement(pair(("s", "1"), ("s", "1"), ("t", "2")), pair(("s", "1"), ("t", "3"), ("u", "4")), "slot", "key"))
    assert got == [("s", "1", "AGREED"), ("s", "1", "PRIMARY_ONLY"), ("t", "2", "DISAGREED"), ("t", "3", "DISAGREED"), ("u", "4", "SECONDARY_ONLY")]


def test_text_functions(spark):
    assert one(spark, "paid ₹1,00,000.50 and Rs. 2 lakh, ₹1.5 crore", T.amounts) == [100000, 200000, 15000000]
    assert one(spark, "6 lacs, 5/- , 2 CR and 3 crafts", T.amounts) == [3, 5, 600000, 20000000]
    assert one(spark, "on 2020-02-30, 01.02.2020 and 4 March 2019", T.dates) == [D(2019, 3, 4), D(2020, 2, 1)]
    assert one(spark, "1/2/2021, 3rd day of MAY, 2021; June 5th 2021, 30-02-2021", T.dates) == [D(2021, 2, 1), D(2021, 5, 3), D(2021, 6, 5)]
    assert one(spark, "No. 972 of 2020 & I.A. No. 31/2021", T.appeal_numbers) == ["31/2021", "972/2020"]
    assert one(spark, "nos 007 / 2019, 8 / 1999, 9/3001", T.appeal_numbers) == ["7/2019", "8/1999"]
    assert [one(spark, x, T.iso_date) for x in ("2020-02-29", "2019-02-29", "20200101", None)] == [D(2020, 2, 29), None, None, None]
    assert one(spark, "aa bb cccccccc d e", lambda c: T.token_windows(c, 5)) == ["aa bb", "cccccccc", "d e"]
    assert one(spark, "x", lambda c: T.greedy_batches(c, F.array(F.lit(3), F.lit(3), F.lit(9), F.lit(1)), 5)) == [0, 1, 2, 3]
    assert one(spark, "one two", lambda c: T.n_grams(T.words(c), 3)) == [] and one(spark, "a b a b a", lambda c: T.n_grams(T.words(c), 2)) == ["a b", "b a"]
    four = "1. ABSTRACT RULE: first. 2. PARTY IDENTITIES: A 3. TEST/STANDARD - APPLIED: second 4. LAST ONE: d"
    assert [tuple(s) for s in one(spark, four, T.sections)] == [("ABSTRACT RULE", "first."), ("PARTY IDENTITIES", "A"), ("TEST/STANDARD - APPLIED", "second"), ("LAST ONE", "d")]
    assert one(spark, four, T.facts_sections) == ["ABSTRACT RULE: first.", "TEST/STANDARD - APPLIED: second", "LAST ONE: d"] and len(one(spark, four, T.ratio_parts)) == 3
    assert one(spark, "no label", T.sections) == [] and one(spark, " no label ", T.facts_sections) == ["no label"] and one(spark, " ", T.ratio_parts) == [] and one(spark, " ", T.core_rule) == ""
    assert one(spark, "As in Kappa v. Omega and AIR 1999 (Supra)", lambda c: F.size(T.citation_hits(c))) == 3 and one(spark, "No. 177/ABC/XYZ/2020 and Respondent No. 1", T.registration_hits) == ["No. 177/ABC/XYZ/2020"]
    assert one(spark, 'x\n{"a": 1}\n{"b": "2"}\nend', T.last_json_object) == {"b": "2"}
    assert one(spark, "P14(v)", T.clean_source_id) == "P14" and one(spark, "[P4.S1]", T.clean_source_id) == "P4.S1"
    assert one(spark, "abc", lambda c: T.cap(c, 2)) == "ab…" and one(spark, "x", lambda c: T.cap_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == "a, b +1 more"
    assert one(spark, "the ﬁrm’s “A–B” ­x", T.source_normal) == "the firm's \"A-B\" x" and one(spark, "€1,00,000 and €5", T.rupee_fix) == "₹1,00,000 and €5"
    assert one(spark, "A b. a B", lambda c: T.quote_places(c, F.lit("a  b"))) == 2 and one(spark, "text [cite: 1, 2].", T.strip_cite_marks) == "text."
    assert one(spark, "v", lambda c: T.template("say {a} {b}", {"a": c, "b": F.lit(None)})) == "say v "
    assert one(spark, "Mr. A came. He left No. 5 there. (End.)", T.sentences_protected) == ["Mr. A came.", "He left No. 5 there.", "(End.)"]
    assert one(spark, "[IIR1]", lambda c: T.doubled_i(c, F.array(F.lit("IR1")))) == "IR1" and one(spark, "x", lambda c: T.claim_id(F.lit(3), F.lit(12))) == "T03-C12"


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text('{"x": 3}\n{"x": bad}\n{"x": 4}{"x": 5}\n{"x"')
    got = files.tolerant_json(spark, str(tmp_path)).orderBy("file", "idx").collect()
    assert [r.value for r in got if r.error is None] == ['{"x": 1}', '{"x": 2}', '{"x": 3}', '{"x": 4}', '{"x": 5}'] and sum(r.error is not None for r in got) == 2
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.json").write_text('{"x": 1}\n{"x": 2, "y": "z"}\n{"x": 3')
    assert files.log_lines(spark, str(tmp_path / "log"), "x int, y string").count() == 2
    raw = spark.createDataFrame([('{"x": 1, "extra": 2}',)], "j string")
    assert rows(files.undocumented_fields(raw, "j", ["x"])) == [("extra", 1)]
    pinned = spark.createDataFrame([("l.json", "0")], "file string, sha256 string")
    assert files.registry(spark, str(tmp_path / "log"), pinned).first().ok is False
    path = files.write_snapshot(raw, str(tmp_path / "snap"), "1")
    assert spark.read.parquet(path).count() == 1 and files.markdown_table(raw.select(F.lit(1).alias("a")), ["a"]) == "| a |\n| --- |\n| 1 |\n"


def test_streams_equal_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    events = logs.event_stream(spark, str(tmp_path / "in"))
    q = logs.session_states(logs.deduplicated(events)).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = runlog.trace_summary(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "n_events", "last_kind")
    assert rows(spark.table("states").select("user_id", "n_events", "last_kind")) == rows(want)
    w = logs.windowed_usage(events).writeStream.format("memory").queryName("usage").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("usage").count() > 0
    said = []
    logs.guard(events, {"click": 1.0}, 1.0, said.append, str(tmp_path / "cp")).awaitTermination()
    assert said and said[0] > 1


def test_max_sim_asks_every_stated_precedent(spark, sf):
    asked = spark.read.parquet(f"{sf}/precedents.parquet").filter("row_no % 20 = 0").select("precedent_uid").distinct()
    held = library._vectors(spark, sf).select(F.col("uid").alias("precedent_uid")).distinct()
    got = library.maxsim_precedents(spark, sf)
    want = {r[0] for r in asked.join(held, "precedent_uid", "left_semi").collect()}
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == want and len(want) > 3
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_sync_sees_every_content_column(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/law_snapshots.parquet").filter("diagnostic_checklist is not null and procedural_timelines is not null").limit(1).cache()
    base = one.withColumn("statute_id", F.explode(F.array(*map(F.lit, (*library.LAW_CONTENT, "source_file"))))).withColumn("snapshot_no", F.lit(1))
    other = {"array<string>": F.array(F.lit("new")), "string": F.lit("new")}
    new = base.withColumn("snapshot_no", F.lit(2)).withColumns(
        {c: F.when(F.col("statute_id") == c, other.get(t, F.lit(None).cast(t))).otherwise(F.col(c)) for c, t in base.dtypes if c in (*library.LAW_CONTENT, "source_file")}
    )
    base.unionByName(new).write.parquet(str(tmp_path / "law_snapshots.parquet"))
    want = {c: "refresh" if c in library.LAW_DERIVED else "update" for c in library.LAW_CONTENT} | {"source_file": "unchanged"}
    assert dict(rows(library.incremental_sync(spark, str(tmp_path)))) == want


def test_title_keys_are_of_whole_titles(spark, tmp_path):
    head = "The same long opening of two case titles, longer than sixty signs: "
    spark.createDataFrame([(1, head + "A v. B"), (2, head + "A v. C"), (3, None)], "row_no long, case_title string").write.parquet(str(tmp_path / "precedents.parquet"))
    got = dict(rows(library.title_keys(spark, str(tmp_path))))
    assert got.keys() == {1, 2} and got[1].endswith("sixty signs a v b") and got[2].endswith("sixty signs a v c")


def test_max_sim_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [(f"d{rng.integers(40)}", rng.normal(size=4).tolist()) for _ in range(150)]
    asks = [(f"q{rng.integers(120)}", int(rng.integers(3)), rng.normal(size=4).tolist()) for _ in range(700)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    score = {}
    for q, part, a in asks:
        for d, b in docs:
            score[q, d, part] = max(score.get((q, d, part), -2.0), float(unit(a) @ unit(b)))
    total = {}
    for (q, d, _), s in score.items():
        total[q, d] = total.get((q, d), 0.0) + s
    want = {q: sorted((-round(s, 9), d) for (x, d), s in total.items() if x == q)[:5] for q in {q for q, _, _ in asks}}
    got = vector.max_sim(spark.createDataFrame(docs, "uid string, vec array<double>"), spark.createDataFrame(asks, "query_id string, part int, vec array<double>"), 5)
    assert [(r.query_id, r["rank"], r.uid) for r in got.orderBy("query_id", "rank").collect()] == [(q, i + 1, d) for q in sorted(want) for i, (_, d) in enumerate(want[q])]
