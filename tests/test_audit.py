"""Stated cases of audits, lookups and integrity rules: nulls, empties, ties and refusals."""

import json

import pytest
from pyspark.sql import functions as F

from docketlake.operators import audit, integrity, lookup, memory, vector
from docketlake.plans.session import BROADCAST, checkpoint_bytes, cut
from docketlake.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cut_keeps_large_tables_out_of_broadcasts(spark):
    big = cut(spark.range(1_200_000).select("id", (F.col("id") % 7).alias("k")))
    assert 0 < checkpoint_bytes(cut(spark.range(10))) < BROADCAST
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    other = spark.range(50).select(F.col("id").alias("k"))
    assert "BroadcastHashJoin" not in plan(big.filter("id < 3").join(big.select("k").distinct(), "k"))
    assert "BroadcastHashJoin" in plan(cut(other).join(spark.range(9).withColumnRenamed("id", "k"), "k"))


def test_first_failing_and_lessons(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "i int, v int")
    assert rows(audit.first_failing(df, ["i"], {"BIG": F.col("v") > 10, "ANY": F.col("v") > 1})) == [(1, None), (2, "ANY"), (3, "BIG")]
    routing = spark.createDataFrame([(1, "LEGAL_RULE", "JUDGE", None, None), (2, "ADVOCACY", "JUDGE", "APPELLANT", None), (3, "PROCEDURAL_ERROR", "LAWYER", None, None), (4, None, None, None, None)], "n int, lesson_type string, memory string, party_status string, error_code string")
    assert {(r.row_key, r.rule) for r in integrity.lesson_routing(routing, "n").collect()} == {("2", "JUDGE_TYPE"), ("2", "ADVOCACY_MEMORY"), ("2", "JUDGE_WITH_STATUS"), ("3", "LAWYER_WITHOUT_STATUS"), ("3", "ERROR_WITHOUT_CODE")}


def test_checklist_items_and_short_ids(spark):
    law = spark.createDataFrame([(1, ["a", "b"], 9), (2, None, None)], "rec_no int, bars array<string>, days int")
    asked = spark.createDataFrame([(1, "bars", 1), (1, "bars", 2), (1, "bars", -1), (1, "bars", None), (1, "days", None), (1, "days", 0), (1, "odd", None), (2, "bars", 0), (2, "days", None)], "rec_no int, field string, item_index int")
    got = {(r.rec_no, r.field, r.item_index): (r.item, r.problem) for r in lookup.checklist_items(asked, law, ["bars"], {"days": F.col("days")}).collect()}
    assert got == {(1, "bars", 1): ("b", None), (1, "bars", 2): (None, "NO_ITEM"), (1, "bars", -1): (None, "NO_ITEM"), (1, "bars", None): (None, "NO_INDEX"), (1, "days", None): ("9", None), (1, "days", 0): (None, "INDEX_REFUSED"), (1, "odd", None): (None, "UNKNOWN_FIELD"), (2, "bars", 0): (None, "NO_ITEM"), (2, "days", None): (None, None)}
    a, b = spark.range(1).select(lookup.short_id(F.lit("a"), F.lit(None).cast("string")), lookup.short_id(F.lit("a"), F.lit(""))).first()
    assert len(a) == 10 and a != b


def test_redaction(spark):
    text = json.dumps({"a": 'He said "no" to Ann', "b": ["Ann Lee", None]})
    views = spark.createDataFrame([(1, text), (2, None)], "view_id int, j string")
    r = spark.createDataFrame([(1, "Ann Lee", "X", "clerk"), (1, "Ann", "Y", "clerk"), (1, '"no"', '"yes"', "clerk"), (1, "absent", "z", "clerk"), (1, "said", "z", "other"), (1, "", "z", "clerk")], "view_id int, old string, new string, by string")
    out, refused = lookup.redacted(views, r, ["clerk"], "j")
    assert json.loads(out.filter("view_id = 1").first().j) == {"a": 'He said "yes" to Y', "b": ["X", None]} and out.filter("view_id = 2").first().j is None
    assert rows(refused.select("old", "reason")) == [("", "ABSENT"), ("absent", "ABSENT"), ("said", "NOT_ALLOWED")]


def test_budgets_layout_and_reports(spark, tmp_path):
    a = spark.createDataFrame([("q", 1, "abc"), ("q", 2, "defgh"), ("q", 3, "i"), ("p", 1, None)], "query_id string, ord int, text string")
    assert rows(lookup.lookup_budget(a, 3, 5)) == [("p", 1, None), ("q", 1, "abc"), ("q", 2, "de…")]
    d = spark.createDataFrame([("x", "2020-01-02", "One two"), ("y", None, None)], "k string, d string, t string").withColumn("d", F.col("d").cast("date"))
    lookup.laid_out(d, str(tmp_path / "out"), "d", "t", "k")
    assert rows(spark.read.parquet(str(tmp_path / "out/words"))) == [("one", "x"), ("two", "x")] and spark.read.parquet(str(tmp_path / "out/rows")).filter("year = 2020").count() == 1
    many = spark.range(450).select(F.col("id").alias("n"), F.lit("a|b").alias("t"))
    lines = files.markdown_table(many, ["n"]).splitlines()
    assert len(lines) == 452 and lines[2] == "| 0 | a\\|b |" and lines[-1].startswith("| 449 |")


def test_folds_and_settlements(spark):
    r = spark.createDataFrame([("B", "h"), ("A", "h"), ("A", "h"), ("C", "g"), ("D", None)], "id string, d string")
    assert rows(integrity.folded_copies(r, "id", "d")) == [("B", "A")]
    placed = spark.createDataFrame([(1, "merge", 2, 0.95), (3, "merge", 2, 0.91), (4, "insert", None, None)], "lesson_id int, action string, match_id int, similarity double")
    rel = spark.createDataFrame([(1, 2, "SAME"), (3, 2, "OPPOSITE")], "lesson_id int, match_id int, relation string")
    held = spark.createDataFrame([(1, 1, 5, 0.5), (2, 7, 3, 0.05), (3, 1, 1, 0.5), (4, 1, 1, 0.5)], "lesson_id int, frequency int, severity int, confidence double")
    assert rows(integrity.settle(placed, rel, held, 0.1)) == [(1, "MERGED", 2, 8, 5, None), (3, "INSERTED_OPPOSITE", 2, 1, 1, 0.0), (4, "INSERTED", None, 1, 1, None)]
    with pytest.raises(ValueError):
        integrity.check_vocabulary({"a": ["x"], "b": ["x"]}, ["x"], {"w": 1.0})
    with pytest.raises(ValueError):
        integrity.check_vocabulary({"a": ["x"]}, ["x"], {"w": 0.9})
    integrity.check_vocabulary({"a": ["x"]}, ["x", "y"], {"w": 0.5, "v": 0.5})


def test_draws_and_nearest_rows(spark):
    import random

    rest = spark.createDataFrame([("g", i) for i in range(40)] + [(None, 1)], "g string, i int")
    got = {r.g: r.drawn for r in memory.exploration(rest, ["g"], "i", 5, "7").collect()}
    assert got["g"] == sorted(random.Random("7:g").sample(range(40), 5)) and got[None] == [1]
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 1.0])], "uid int, vec array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, vec array<double>")
    top = rows(vector.top_k(v, q, 3).select("query_id", "uid", "rank"))
    assert top == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 2), ("b", 1, 3), ("b", 99, 1)]
    assert vector.top_k(v.limit(0), q, 3).count() == 0 and vector.top_k(v, q.limit(0), 3).count() == 0
