"""Queries of hearings, opinions, evaluation and audits. Orders stand for sessions, their lines for turns, claims and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import audit, evaluation, hearing, overlap, records, reports, runlog, vector, voting
from docketlake.plans.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


L = "SELECT l_orderkey AS s, l_linenumber AS n, min(l_returnflag) AS f, min(l_linestatus) AS w, sum(l_quantity)::BIGINT AS q, min(l_suppkey) AS j, min(l_discount) AS d FROM lineitem GROUP BY 1, 2"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line number of an order: its flag, status, quantity, supplier and discount."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("n")).agg(
        F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("w"), F.sum("l_quantity").cast("long").alias("q"), F.min("l_suppkey").alias("j"), F.min("l_discount").alias("d")
    )


# Turns and claims


@query("""WITH a AS (SELECT DISTINCT case_id AS session_id, analysis_id AS claim_id, source_paras, statute_id FROM statutory_analysis WHERE case_id IS NOT NULL), r AS (SELECT DISTINCT case_id AS session_id, unnest(source_paras) AS record_id FROM statutory_analysis WHERE act_prefix LIKE 'C%'), v AS (SELECT DISTINCT case_id AS session_id, unnest(statutes_cited) AS statute_id FROM precedents)
    SELECT DISTINCT session_id, claim_id, 'UNKNOWN_RECORD' AS problem, record_id AS detail FROM (SELECT session_id, claim_id, unnest(source_paras) AS record_id FROM a) ANTI JOIN r USING (session_id, record_id)
    UNION ALL SELECT DISTINCT session_id, claim_id, 'STATUTE_NOT_VISIBLE', statute_id FROM a ANTI JOIN v USING (session_id, statute_id) WHERE statute_id IS NOT NULL""")
def claim_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses as claims: paragraphs no analysis under an act with C shows, statutes no precedent of the case cites."""
    a = table(spark, sf_dir, "statutory_analysis").filter("case_id is not null").select(F.col("case_id").alias("session_id"), F.col("analysis_id").alias("claim_id"), F.col("source_paras").alias("record_ids"), "statute_id", "act_prefix").distinct()
    record = a.filter("act_prefix like 'C%'").select("session_id", F.explode("record_ids").alias("record_id")).distinct()
    visible = table(spark, sf_dir, "precedents").select(F.col("case_id").alias("session_id"), F.explode("statutes_cited").alias("statute_id")).distinct()
    return hearing.claim_problems(a.drop("act_prefix"), record, visible)


_SAID = """WITH t AS (SELECT case_id AS session_id, doc_id AS turn, doc_kind AS side, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sq FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL AND doc_kind IN ('order', 'submission')),
    p AS (SELECT session_id, turn, CASE WHEN turn % 7 = 0 THEN 'submission' ELSE side END AS side, CASE WHEN turn % 5 = 0 THEN 'never said' ELSE substr(sq, 5, 20) END AS quote FROM t)
"""


@query(_SAID + """SELECT DISTINCT p.session_id, p.turn, p.side, p.quote FROM p JOIN t ON t.session_id = p.session_id AND t.turn = p.turn AND t.side = p.side AND contains(t.sq, lower(trim(regexp_replace(p.quote, '\\s+', ' ', 'g'))))
    WHERE EXISTS (SELECT 1 FROM t u WHERE u.session_id = p.session_id AND u.side <> p.side AND u.turn > p.turn)""")
def confirmed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from a case's documents as points: kept if the turn is the side's, holds them, and the other side spoke later."""
    t = table(spark, sf_dir, "documents").filter("case_id is not null and text is not null and doc_kind in ('order', 'submission')").select(F.col("case_id").alias("session_id"), F.col("doc_id").alias("turn"), F.col("doc_kind").alias("side"), "text")
    points = t.select("session_id", "turn", F.when(F.col("turn") % 7 == 0, "submission").otherwise(F.col("side")).alias("side"), F.when(F.col("turn") % 5 == 0, "never said").otherwise(F.substring(T.squeeze(F.col("text")), 5, 20)).alias("quote"))
    return hearing.confirmed_points(points, t)


@query(f"""WITH l AS ({L}) SELECT a.s AS session_id, a.f AS side, a.n AS claim_a, b.n AS claim_b FROM l a JOIN l b ON a.s = b.s AND b.n = a.n + 1 WHERE a.f = b.f AND a.q % 3 <> b.q % 3""")
def confirmed_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    claims = l.select(F.col("s").alias("session_id"), F.col("n").alias("claim_id"), F.col("f").alias("side"), (F.col("q") % 3).alias("turn"))
    return hearing.confirmed_contradictions(l.select(F.col("s").alias("session_id"), F.col("n").alias("claim_a"), (F.col("n") + 1).alias("claim_b")), claims)


@query(f"""WITH l AS ({L}) SELECT s AS session_id, f AS side, count(*) AS turns, sum(n) AS attempts, sum(CASE WHEN w = 'O' THEN 2 ELSE 0 END) AS hard_errors, round(avg((n = 1)::INT), 9) AS first_try_rate, count(*) FILTER (q > 40) AS flagged, sum(CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END) AS warnings FROM l GROUP BY ALL""")
def side_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    p = _lines(spark, sf_dir).select(
        F.col("s").alias("session_id"), F.col("f").alias("side"), F.when(F.col("q") > 40, "FLAGGED").otherwise("PASS").alias("outcome"), F.col("n").alias("attempts"),
        F.when(F.col("w") == "O", F.array(F.array(F.lit("E1")), F.array(F.lit("E2")))).otherwise(F.array(none)).alias("hard_errors_by_attempt"), F.when(F.col("q") % 2 == 0, F.array(F.lit("W"))).otherwise(none).alias("warnings"),
    )
    out = hearing.side_metrics(p)
    return out.withColumn("first_try_rate", F.round("first_try_rate", 9))


@query(f"""WITH l AS ({L}), g AS (SELECT s, count(*) FILTER (f = 'R') AS bad, count(*) FILTER (f <> 'N') AS claims, avg(d) FILTER (f = 'A') AS a FROM l GROUP BY s), c AS (SELECT s, a, CASE WHEN claims > 0 THEN 1 - least(1.0, bad / claims) END AS c FROM g)
    SELECT s AS session_id, round(c, 9) AS consistency, round(CASE WHEN c IS NULL THEN a WHEN a IS NULL THEN c ELSE (a + c) / 2 END, 9) AS reward FROM c""")
def side_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of an order's lines, and its mean with a second part where both are there."""
    g = _lines(spark, sf_dir).groupBy(F.col("s").alias("session_id")).agg(F.count_if(F.col("f") == "R").alias("bad"), F.count_if(F.col("f") != "N").alias("claims"), F.avg(F.when(F.col("f") == "A", F.col("d"))).alias("a"))
    c = hearing.consistency(F.col("bad"), F.col("claims"))
    return g.select("session_id", F.round(c, 9).alias("consistency"), F.round(hearing.mean_of_available(c, F.col("a")), 9).alias("reward"))


@query(f"""WITH l AS ({L}), r(f, k) AS (VALUES ('A', 3), ('N', 2), ('R', 0)), g AS (SELECT s, f, list(DISTINCT (n % 4)) AS got FROM l GROUP BY ALL)
    SELECT s AS session_id, g.f AS statute_id, array_to_string(list_filter(range(0, k), lambda i: NOT list_contains(got, i)), ',') AS left_open FROM g JOIN r ON r.f = g.f""")
def prerequisites_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lines(spark, sf_dir).select(F.col("s").alias("session_id"), F.col("f").alias("statute_id"), F.array((F.col("n") % 4).cast("int")).alias("places"))
    need = spark.createDataFrame([("A", 3), ("N", 2), ("R", 0)], "statute_id string, n int")
    return hearing.prerequisites_left(a, need).select("session_id", "statute_id", F.array_join(F.col("left").cast("array<string>"), ",").alias("left_open"))


@query(f"WITH l AS ({L}) SELECT s AS session_id, round(coalesce(sum(n % 2) / nullif(sum(n % 3), 0), 1.0), 9) AS coverage FROM l GROUP BY s")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _lines(spark, sf_dir).select(F.col("s").alias("session_id"), (F.col("n") % 2).alias("n_addressed"), (F.col("n") % 3).alias("n_items"))
    return hearing.rule_coverage(a).withColumn("coverage", F.round("coverage", 9))


@query(f"""WITH l AS (SELECT *, 'E' || (q % 3) AS code FROM ({L})), k AS (SELECT * FROM l WHERE NOT (w = 'O' AND q % 5 = 0)), d AS (SELECT s, code, f, arg_min('d' || n, n) AS detail, list_sort(list(DISTINCT 'R' || j)) AS r FROM k GROUP BY ALL)
    SELECT s AS session_id, code, f AS statute_id, detail, array_to_string(r, ',') AS record_ids, code NOT IN ('E0', 'E1') AS unlisted FROM d""")
def deduped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of an order's lines: one for each code and statute, excused values dropped, codes that are on no list marked."""
    l = _lines(spark, sf_dir).select(F.col("s").alias("session_id"), F.col("n").alias("ord"), F.concat(F.lit("E"), (F.col("q") % 3).cast("string")).alias("code"), F.col("f").alias("statute_id"), F.col("w").alias("field"), F.col("q").alias("value"), F.concat(F.lit("d"), F.col("n").cast("string")).alias("detail"), F.array(F.concat(F.lit("R"), F.col("j").cast("string"))).alias("record_ids"))
    excused = l.filter("field = 'O' and value % 5 = 0").select("session_id", "field", "value").distinct()
    out = hearing.dedupe_errors(l, excused)
    bad = hearing.closed_codes(out, spark.createDataFrame([("E0",), ("E1",)], "code string")).select("session_id", "code", "statute_id").withColumn("u", F.lit(True))
    return out.join(bad, ["session_id", "code", "statute_id"], "left").select("session_id", "code", "statute_id", "detail", F.array_join("record_ids", ",").alias("record_ids"), F.coalesce("u", F.lit(False)).alias("unlisted"))


@query("""WITH p AS (SELECT l_orderkey AS c, l_returnflag AS i, l_linestatus AS f FROM lineitem), o AS (SELECT c, i, min(f) AS favours FROM p GROUP BY ALL HAVING count(*) = 1) SELECT c AS case_id, i AS issue_id, favours FROM o WHERE c IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("issue_id"), F.col("l_linestatus").alias("favours"))
    framed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(*map(F.lit, "ANR"))).alias("issue_id"))
    return hearing.baseline_predictions(p, framed)


@query(f"WITH l AS ({L}) SELECT s AS session_id, n AS turn, 'T' || lpad(n::VARCHAR, 2, '0') || '-C' || (q % 9) AS claim, f AS side FROM l WHERE f = 'A' AND s IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def own_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side's turns of sessions past the verdict, with claim ids."""
    private = _lines(spark, sf_dir).select(F.col("s").alias("session_id"), F.col("n").alias("turn"), F.col("f").alias("side"), T.claim_id(F.col("n"), F.col("q") % 9).alias("claim"))
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "EVALUATED").otherwise("RUNNING").alias("state"))
    return records.own_turns(private, sessions, "A").select("session_id", "turn", "claim", "side")


@query("""WITH s AS (SELECT o_orderkey AS session_id, (o_orderkey % 5)::INT AS turns FROM orders), t AS (SELECT session_id, turns, unnest(range(1, turns + 3)) AS turn FROM s)
    SELECT session_id, turn, CASE WHEN turn % 2 = 1 THEN 'A' ELSE 'B' END AS side, CASE WHEN turn > turns THEN 'CLOSING' WHEN turn <= 2 THEN 'OPENING' ELSE 'ARGUMENT' END AS kind FROM t""")
def turn_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.turn_schedule(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 5).cast("int").alias("turns")))


# Opinions


@query("""WITH s AS (SELECT l_orderkey AS session_id, l_suppkey % 3 AS judge, l_linenumber % 2 AS ord, l_returnflag AS i, l_linestatus AS side, l_quantity AS score FROM lineitem), p AS (SELECT session_id, judge, i, side, count(DISTINCT ord) AS o, max(score) - min(score) AS gap FROM s GROUP BY ALL) SELECT session_id, judge, max(gap) AS gap FROM p WHERE o > 1 GROUP BY ALL""")
def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_suppkey") % 3).alias("judge"), (F.col("l_linenumber") % 2).alias("ord"), F.col("l_returnflag").alias("issue_id"), F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("score"))
    return voting.order_gap(s)


def _opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges of an order, two orders of hearing; an opinion's issues are its lines."""
    issue = F.struct(F.col("f").alias("issue_id"), F.col("w").alias("upholds"), F.when(F.col("q") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), (F.col("q") % 6).cast("string")))).alias("rules"))
    g = _lines(spark, sf_dir).withColumn("judge", F.col("j") % 3).withColumn("ord", F.col("n") % 2).groupBy(F.col("s").alias("session_id"), "judge", "ord")
    return g.agg(F.bool_and(F.col("q") > 3).alias("valid"), F.min("w").alias("result"), F.max("w").alias("first"), F.collect_list(issue).alias("issues"))


_OPINIONS = f"""WITH l AS (SELECT *, j % 3 AS judge, n % 2 AS ord, CASE WHEN q % 4 <> 0 THEN 'r' || (q % 6) END AS rule FROM ({L})), o AS (SELECT s, judge, ord, bool_and(q > 3) AS valid, min(w) AS result, max(w) AS first FROM l GROUP BY ALL)
"""


@query(_OPINIONS + """SELECT (SELECT count(*) FROM (SELECT s, judge FROM o WHERE valid GROUP BY ALL HAVING count(DISTINCT result) > 1)) AS order_flips, (SELECT count(*) FROM (SELECT l.s, l.judge, l.f FROM l JOIN o ON o.s = l.s AND o.judge = l.judge AND o.ord = l.ord WHERE o.valid GROUP BY ALL HAVING count(DISTINCT l.w) > 1)) AS issue_flips, (SELECT count(*) FROM o WHERE valid AND result = first) AS first_wins""")
def bench_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.bench_metrics(_opinions(spark, sf_dir))


@query(_OPINIONS + """, k AS (SELECT DISTINCT s, f FROM l WHERE n = 1 UNION SELECT o_orderkey, 'Z' FROM orders WHERE o_orderkey % 40 = 0)
    SELECT o.s AS session_id, o.judge, o.ord, 'MISSING_ISSUE' AS problem, k.f AS detail FROM o JOIN k ON k.s = o.s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s = o.s AND l.judge = o.judge AND l.ord = o.ord AND l.f = k.f)
    UNION ALL SELECT DISTINCT s, judge, ord, 'UNKNOWN_ISSUE', f FROM l ANTI JOIN k USING (s, f) UNION ALL SELECT s, judge, ord, 'REPEATED_ISSUE', f FROM l GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT DISTINCT s, judge, ord, 'UNKNOWN_RULE', rule FROM l WHERE rule IN ('r3', 'r5') UNION ALL SELECT DISTINCT s, judge, ord, 'NO_RULE', f FROM l WHERE rule IS NULL""")
def opinion_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions against the issues framed (those of an order's first line) and the rules it may cite."""
    l = _lines(spark, sf_dir)
    issues = l.filter("n = 1").select(F.col("s").alias("session_id"), F.col("f").alias("issue_id")).unionByName(table(spark, sf_dir, "orders").filter("o_orderkey % 40 = 0").select(F.col("o_orderkey").alias("session_id"), F.lit("Z").alias("issue_id"))).distinct()
    rules = l.select(F.col("s").alias("session_id"), F.explode(F.array(*map(F.lit, ("r0", "r1", "r2", "r4")))).alias("rule")).distinct()
    return voting.opinion_problems(_opinions(spark, sf_dir), issues, rules)


_CITED = f"SELECT s AS opinion_id, f AS issue_id, 'r' || (q % 6) AS rule FROM ({L})"


@query(f"""WITH c AS ({_CITED}), p AS (SELECT DISTINCT opinion_id, 'CONTRADICTED_RULE' AS code, rule FROM c WHERE rule = 'r3' UNION SELECT opinion_id, 'NO_RULE', NULL FROM c WHERE opinion_id % 9 = 0), o AS (SELECT opinion_id FROM p GROUP BY 1 HAVING bool_and(code = 'CONTRADICTED_RULE')),
    k AS (SELECT opinion_id FROM (SELECT opinion_id, issue_id, count(*) FILTER (rule <> 'r3') AS n FROM c WHERE opinion_id IN (SELECT opinion_id FROM o) GROUP BY ALL) GROUP BY 1 HAVING min(n) > 0)
    SELECT DISTINCT opinion_id, issue_id, rule FROM c WHERE opinion_id IN (SELECT opinion_id FROM k) AND rule <> 'r3'""")
def dropped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _lines(spark, sf_dir).select(F.col("s").alias("opinion_id"), F.col("f").alias("issue_id"), F.concat(F.lit("r"), (F.col("q") % 6).cast("string")).alias("rule"))
    p = c.filter("rule = 'r3'").select("opinion_id", F.lit("CONTRADICTED_RULE").alias("code"), "rule").unionByName(c.filter("opinion_id % 9 = 0").select("opinion_id", F.lit("NO_RULE").alias("code"), F.lit(None).cast("string").alias("rule"))).distinct()
    return audit.drop_contradicted(c, p)


@query("""WITH p AS (SELECT l_orderkey AS o, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS p FROM lineitem WHERE l_quantity > 48 GROUP BY 1), s AS (SELECT o_orderkey AS o, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'NO_RESULT' END, CASE WHEN o_orderkey % 3 < o_orderkey % 4 THEN 'ISSUE_WITHOUT_FINDING' END) AS s FROM orders)
    SELECT s.o AS opinion_id, coalesce(p, s) = '' AS valid, coalesce(p, s) AS problems FROM s LEFT JOIN p ON p.o = s.o""")
def final_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("opinion_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("result"), (F.col("o_orderkey") % 4).alias("issues"), (F.col("o_orderkey") % 3).alias("findings"))
    p = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("opinion_id"), F.col("l_returnflag").alias("problem"))
    return audit.finalise(o, p).select("opinion_id", "valid", F.array_join("problems", ",").alias("problems"))


# Evaluation


@query(f"""WITH l AS ({L}), t AS (SELECT s, n, w AS real, CASE WHEN q % 3 = 0 THEN 'EVIDENCE' ELSE 'LAW' END AS driver, CASE WHEN q % 7 <> 0 THEN CASE WHEN f = 'A' THEN 'F' ELSE 'O' END END AS found, q % 2 = 0 AS shown FROM l)
    SELECT s AS case_id, count(*) FILTER (ok) AS compared, round(avg((real = found)::INT) FILTER (ok), 9) AS aligned FROM (SELECT *, (driver <> 'EVIDENCE' OR shown) AND found IS NOT NULL AS ok FROM t) GROUP BY s""")
def issue_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as issues: what was really decided against what the bench found; evidence only where it was in the record."""
    l = _lines(spark, sf_dir).select(F.col("s").alias("case_id"), F.col("n").alias("issue_id"), "w", "q", "f")
    truth = l.select("case_id", "issue_id", F.col("w").alias("favours"), F.when(F.col("q") % 3 == 0, "EVIDENCE").otherwise("LAW").alias("driver"))
    bench = l.filter("q % 7 <> 0").select("case_id", "issue_id", F.when(F.col("f") == "A", "F").otherwise("O").alias("favours"))
    out = evaluation.issue_alignment(l.select("case_id", "issue_id"), truth, bench, l.filter("q % 2 = 0").select("case_id", "issue_id"))
    return out.withColumn("aligned", F.round("aligned", 9))


@query(f"""WITH l AS ({L}), r AS (SELECT DISTINCT s, j FROM l WHERE q > 10) SELECT l.s AS case_id, l.f AS issue_id, bool_and(l.w = 'F' AND r.j IS NOT NULL) AS available FROM l LEFT JOIN r ON r.s = l.s AND r.j = l.j GROUP BY ALL""")
def evidence_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    points = l.select(F.concat_ws("/", "s", "n").alias("point_id"), F.col("s").alias("case_id"), F.col("f").alias("issue_id"), F.when(F.col("w") == "F", "IN_RECORD").otherwise("OUTSIDE").alias("place"), F.array("j").alias("ids"))
    return reports.evidence_available(points, l.filter("q > 10").select(F.col("s").alias("case_id"), F.col("j").alias("record_id")))


@query("""WITH p AS (SELECT DISTINCT row_no, 'NO_RATIO' AS rule FROM precedents WHERE ratio_text IS NULL OR trim(ratio_text) = '' UNION SELECT row_no, 'UNDATED' FROM precedents WHERE decision_date IS NULL) SELECT rule, count(*) AS n, min(row_no::VARCHAR) AS example FROM p GROUP BY rule""")
def format_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "precedents")
    rules = p.filter("ratio_text is null or trim(ratio_text) = ''").select(F.col("row_no").cast("string").alias("row_key"), F.lit("NO_RATIO").alias("rule")).unionByName(p.filter("decision_date is null").select(F.col("row_no").cast("string").alias("row_key"), F.lit("UNDATED").alias("rule"))).distinct()
    return reports.format_audit(rules)


@query("""SELECT o_orderpriority AS arm, round(avg((o_totalprice > 200000)::INT) FILTER (o_orderstatus <> 'F'), 9) AS rejected_real, round(avg((o_totalprice > 200000)::INT) FILTER (o_orderstatus = 'F'), 9) AS caught_mutations, round(avg(o_custkey), 6) AS mean_seconds FROM orders GROUP BY 1""")
def arm_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("mutated"), (F.col("o_totalprice") > 200000).alias("rejected"), F.col("o_custkey").alias("seconds"))
    out = reports.arm_rates(d)
    return out.select("arm", F.round("rejected_real", 9).alias("rejected_real"), F.round("caught_mutations", 9).alias("caught_mutations"), F.round("mean_seconds", 6).alias("mean_seconds"))


@query(f"""WITH l AS ({L}), a AS (SELECT s, list_sort(list(f)) AS a FROM l WHERE n < 4 GROUP BY s), b AS (SELECT s, list_sort(list(f)) AS b FROM l WHERE n > 1 GROUP BY s) SELECT coalesce(a.s, b.s) AS ordinal, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b FROM a FULL JOIN b ON a.s = b.s WHERE a IS DISTINCT FROM b""")
def arm_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    arm = lambda c: l.filter(c).groupBy(F.col("s").alias("ordinal")).agg(F.collect_list("f").alias("errors"))
    out = reports.arm_differences(arm("n < 4"), arm("n > 1"), "ordinal", "errors")
    return out.select("ordinal", F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"))


_OK = "vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"


@query(f"""WITH v AS (SELECT DISTINCT lesson_no, party_status, status, vec::DOUBLE[] AS vec FROM lessons WHERE {_OK}), s AS (SELECT q.lesson_no AS query_id, v.lesson_no AS uid, round(list_cosine_similarity(v.vec, q.vec), 9) AS score FROM v q JOIN v ON v.status = 'ACTIVE' WHERE q.lesson_no % 20 = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM s QUALIFY rank <= 10),
    p AS (SELECT query_id, uid, max((uid * 7 + k * 13) % 11) AS best, arg_max(k, ((uid * 7 + k * 13) % 11) * 10 - k) AS at_ FROM c, range(0, 3) r(k) WHERE uid % 5 <> 0 GROUP BY ALL)
    SELECT c.query_id, c.uid, p.best::BIGINT AS rerank_score, at_::BIGINT AS best_position, row_number() OVER (PARTITION BY c.query_id ORDER BY p.best DESC NULLS LAST, score DESC, rank) AS new_rank FROM c LEFT JOIN p USING (query_id, uid) QUALIFY new_rank <= 5""")
def reranked_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active lessons nearest to every lesson divisible by 20, put in a new order by the best of three passage scores."""
    l = table(spark, sf_dir, "lessons").filter(vector.usable(F.col("vec"), 64)).dropDuplicates(["lesson_no"])
    found = vector.top_k(l.filter("status = 'ACTIVE'").select(F.col("lesson_no").alias("uid"), "vec"), l.filter("lesson_no % 20 = 0").select(F.col("lesson_no").alias("query_id"), "vec"), 10)
    passages = found.filter("uid % 5 <> 0").select("query_id", "uid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position")).withColumn("passage_score", (F.col("uid") * 7 + F.col("position") * 13) % 11)
    return vector.rerank(found, passages, 5).select("query_id", "uid", "rerank_score", F.col("best_position").cast("long").alias("best_position"), "new_rank")


@query("""WITH n AS (SELECT DISTINCT case_id, list_distinct(list_filter(regexp_split_to_array(lower(party_name), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in overlap.GENERIC) + """))) AS n FROM parties WHERE party_name IS NOT NULL AND case_id IS NOT NULL),
    a AS (SELECT case_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL AND doc_kind = 'order'), c AS (SELECT DISTINCT case_id, regexp_extract(appeal_number, 'No\\. ([0-9]+) of', 1) || ' of ' || regexp_extract(appeal_number, 'of ([0-9]{4})', 1) AS x FROM precedents WHERE case_id IS NOT NULL),
    k AS (SELECT a.case_id FROM a JOIN n ON n.case_id = a.case_id WHERE len(n) > 0 AND len(list_intersect(t, n)) >= least(2, len(n)) UNION SELECT a.case_id FROM a JOIN c ON c.case_id = a.case_id WHERE x <> ' of ' AND (contains(text, 'No. ' || x) OR contains(text, 'Nos. ' || x) OR regexp_matches(text, '(^|[^0-9/])0*' || replace(x, ' of ', '\\s*/\\s*') || '\\b')))
    SELECT DISTINCT case_id, case_id IN (SELECT case_id FROM k) AS known FROM a""")
def memorised_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents as answers to 'which case is this?': whether they name a party or a number of the case."""
    a = table(spark, sf_dir, "documents").filter("case_id is not null and text is not null and doc_kind = 'order'").select("case_id", "text")
    names = table(spark, sf_dir, "parties").filter("party_name is not null and case_id is not null").select("case_id", F.col("party_name").alias("name"))
    numbers = table(spark, sf_dir, "precedents").filter("case_id is not null").select("case_id", F.explode(T.appeal_numbers(F.col("appeal_number"))).alias("number"))
    return overlap.identified(a, names, numbers)


# Audits


_AUDIT = """WITH a AS (SELECT analysis_id AS claim_id, any_value(case_id) AS case_id, any_value(statute_id) AS statute_id FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IS NOT NULL GROUP BY 1),
    l AS (SELECT statute_id, max(diagnostic_checklist.financial_threshold.minimum_amount) AS law_min, bool_and(rec_no % 6 <> 0) AS agree, max(procedural_timelines.adjudication_window_days) AS la, max(procedural_timelines.rectification_window_days) AS lr, max(len(diagnostic_checklist.mandatory_prerequisites)) AS np, max(len(diagnostic_checklist.statutory_bars)) AS nb FROM law WHERE statute_id IS NOT NULL GROUP BY 1),
    c AS (SELECT a.*, CASE WHEN claim_id % 3 <> 0 THEN 100000.0 * (claim_id % 4) END AS m, CASE WHEN claim_id % 5 = 0 THEN 'USD' ELSE 'INR' END AS cur, CASE WHEN claim_id % 2 = 0 THEN claim_id % 4 = 0 END AS met, claim_id % 7 AS amt, CASE WHEN claim_id % 4 = 1 THEN 90 END AS ad, CASE WHEN claim_id % 4 = 2 THEN 3 END AS rd, law_min, agree, la, lr, coalesce(np, 0) AS np, coalesce(nb, 0) AS nb, claim_id % 11 = 0 AS undated FROM a JOIN l USING (statute_id)),
    x AS (SELECT *, CASE WHEN amt < 5 THEN amt * 100000.0 END AS amount, law_min IS NOT NULL AND agree AS firm FROM c),
    i AS (SELECT claim_id, CASE WHEN claim_id % 2 = 0 THEN 'mandatory_prerequisites' ELSE 'statutory_bars' END AS field, CASE WHEN claim_id % 3 <> 1 THEN claim_id % 3 END AS ix, claim_id % 8 <> 0 AS trusted, CASE WHEN claim_id % 2 = 0 THEN np ELSE nb END AS n, np FROM x)
"""


@query(
    _AUDIT
    + """SELECT claim_id, 'THRESHOLD_NOT_VERIFIABLE' AS code, 'financial_threshold' AS detail FROM x WHERE (m IS NOT NULL OR met IS NOT NULL) AND NOT firm
    UNION ALL SELECT claim_id, 'UNMAPPED', 'currency' FROM x WHERE firm AND m IS NOT NULL AND cur <> 'INR' UNION ALL SELECT claim_id, 'ERR_THRESHOLD_MISSTATED', 'financial_threshold' FROM x WHERE firm AND cur = 'INR' AND m <> law_min
    UNION ALL SELECT claim_id, 'UNMAPPED', 'amount' FROM x WHERE firm AND met IS NOT NULL AND amount IS NULL UNION ALL SELECT claim_id, 'ERR_THRESHOLD_APPLICATION', 'A' || amt FROM x WHERE firm AND met <> (amount >= law_min)
    UNION ALL SELECT claim_id, 'UNMAPPED', 'adjudication_days' FROM x WHERE ad IS NOT NULL AND undated UNION ALL SELECT claim_id, 'ERR_TIMELINE_MISSTATED', 'adjudication_days' FROM x WHERE NOT undated AND ad <> la UNION ALL SELECT claim_id, 'ERR_TIMELINE_MISSTATED', 'rectification_days' FROM x WHERE rd <> lr
    UNION ALL SELECT claim_id, 'UNMAPPED', field FROM i WHERE NOT trusted UNION ALL SELECT claim_id, 'WARN_CONDITION_NOT_IN_STATUTE', field FROM i WHERE trusted AND ix IS NULL UNION ALL SELECT claim_id, 'UNMAPPED', field || '[' || ix || ']' FROM i WHERE trusted AND ix >= n
    UNION ALL SELECT i.claim_id, 'PREREQUISITE_UNADDRESSED', array_to_string(list_filter(range(0, np), lambda k: NOT (field = 'mandatory_prerequisites' AND trusted AND k = coalesce(ix, -1))), ',') FROM i WHERE claim_id % 6 = 0 AND len(list_filter(range(0, np), lambda k: NOT (field = 'mandatory_prerequisites' AND trusted AND k = coalesce(ix, -1)))) > 0"""
)
def checklist_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklists that analyses state (made from their number) against those of the law."""
    a = table(spark, sf_dir, "statutory_analysis").filter("case_id is not null and statute_id is not null").groupBy(F.col("analysis_id").alias("claim_id")).agg(F.first("case_id").alias("case_id"), F.first("statute_id").alias("statute_id"))
    law = table(spark, sf_dir, "law").filter("statute_id is not null")
    size = lambda f: F.max(F.when(F.col(f"diagnostic_checklist.{f}").isNotNull(), F.size(f"diagnostic_checklist.{f}")))
    l = law.groupBy("statute_id").agg(
        F.max("diagnostic_checklist.financial_threshold.minimum_amount").alias("minimum"), F.bool_and(F.col("rec_no") % 6 != 0).alias("readings_agree"), F.max("procedural_timelines.adjudication_window_days").alias("adjudication_days"), F.max("procedural_timelines.rectification_window_days").alias("rectification_days"),
        size("mandatory_prerequisites").alias("np"), size("statutory_bars").alias("nb"),
    )
    i = F.col("claim_id")
    # What is undated depends on the claim here, so a claim's law is its own row: the claim number joins the case id.
    own = a.withColumn("case_id", F.concat_ws("/", "case_id", "claim_id"))
    dated = own.select("claim_id", "case_id", "statute_id").join(l, "statute_id").withColumn("undated", F.when(i % 11 == 0, F.array(F.lit("adjudication_days"))).otherwise(F.array().cast("array<string>")))
    dated = dated.withColumn("counts", F.create_map(F.lit("mandatory_prerequisites"), F.coalesce("np", F.lit(0)), F.lit("statutory_bars"), F.coalesce("nb", F.lit(0)))).drop("claim_id", "np", "nb")
    claims = own.select(
        "claim_id", "case_id", "statute_id", F.when(i % 3 != 0, 100000.0 * (i % 4)).alias("minimum"), F.when(i % 5 == 0, "USD").otherwise("INR").alias("currency"), F.when(i % 2 == 0, i % 4 == 0).alias("asserts_met"), F.concat(F.lit("A"), (i % 7).cast("string")).alias("amount_id"),
        F.when(i % 4 == 1, 90).alias("adjudication_days"), F.when(i % 4 == 2, 3).alias("rectification_days"), F.when(i % 6 == 0, "ASSERT_CLAIM").otherwise("DENY_CLAIM").alias("stance"),
    )
    amounts = own.filter(i % 7 < 5).select("case_id", F.concat(F.lit("A"), (i % 7).cast("string")).alias("amount_id"), (i % 7 * 100000.0).alias("value"))
    items = own.select("claim_id", F.when(i % 2 == 0, "mandatory_prerequisites").otherwise("statutory_bars").alias("field"), F.when(i % 3 != 1, i % 3).alias("law_index"), F.when(i % 8 != 0, 0.9).otherwise(0.1).alias("confidence"), F.lit("so it stands").alias("quote"))
    return audit.checklist_audit(claims, dated, amounts, items, "INR", 0.5)


@query("""WITH v AS (SELECT doc_id AS view_id, case_id, text, decided, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low FROM documents WHERE text IS NOT NULL AND doc_kind IN ('summary', 'note', 'transcript')),
    n AS (SELECT v.view_id, v.text, p.kind, unnest(list_distinct(list_filter(regexp_split_to_array(p.party_name, '[^A-Za-z]+'), lambda w: len(w) >= 3 AND regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN (""" + ", ".join(f"'{w}'" for w in overlap.GENERIC) + """)))) AS w FROM v JOIN (SELECT DISTINCT case_id, party_name, kind FROM parties WHERE party_name IS NOT NULL) p ON p.case_id = v.case_id),
    s AS (SELECT view_id, 'PARTY_NAME' AS scan, count(DISTINCT w) AS hits FROM n WHERE list_contains(regexp_split_to_array(text, '[^A-Za-z]+'), w) GROUP BY 1
      UNION ALL SELECT view_id, 'COURT_VOICE', contains(low, 'we are of the view')::INT + contains(low, 'on a careful reading')::INT FROM v
      UNION ALL SELECT view_id, 'MAIL_OR_DOMAIN', len(regexp_extract_all(text, '(?i)[a-z0-9_.+-]+@[a-z0-9_-]+\\.[a-z0-9_.-]+|\\bwww\\.[a-z0-9_.-]+')) FROM v UNION ALL SELECT view_id, 'EVALUATIVE', regexp_matches(low, '\\bwrongly\\b')::INT + regexp_matches(low, '\\bstrangely\\b')::INT FROM v)
    SELECT view_id, scan, sum(hits)::BIGINT AS hits FROM s GROUP BY ALL HAVING sum(hits) > 0""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries, notes and transcripts as views: names of parties, mail addresses, the court's voice, words that judge.
    The scans for numbers, dates and citations are left to citation_hits and unwritten_dates."""
    v = table(spark, sf_dir, "documents").filter("text is not null and doc_kind in ('summary', 'note', 'transcript')").select(F.col("doc_id").alias("view_id"), "case_id", "text", "decided")
    views = v.select("view_id", "text", F.lit("").alias("case_number"), F.lit(None).cast("date").alias("decided"), F.array("text").alias("issues"))
    names = v.select("view_id", "case_id").join(table(spark, sf_dir, "parties").filter("party_name is not null").select("case_id", F.col("party_name").alias("name")).distinct(), "case_id").select("view_id", "name", F.lit("PARTY").alias("role"))
    grams = v.limit(0).select("view_id", F.lit(0).cast("long").alias("n_leaked"))
    out = audit.leakage_report(views, names, grams, ["we are of the view", "on a careful reading"], ["wrongly", "strangely"], overlap.GENERIC)
    return out.filter("scan in ('PARTY_NAME', 'COURT_VOICE', 'MAIL_OR_DOMAIN', 'EVALUATIVE')")


_SOURCES = """WITH t AS (SELECT doc_id, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sq FROM documents WHERE text IS NOT NULL AND length(text) > 60)"""


@query(_SOURCES + """, d AS (SELECT doc_id::VARCHAR AS draft_id, CASE WHEN doc_id % 6 = 0 THEN 'PREDICATE' ELSE 'OVERLAY' END AS kind, sq, doc_id % 9 = 0 AS lost, doc_id % 8 = 0 AS changed, CASE WHEN doc_id % 7 = 0 THEN 'never said so' ELSE substr(sq, 1, 30) END AS q, doc_id % 5 = 0 AS odd FROM t WHERE doc_id % 4 <> 0)
    SELECT draft_id, CASE WHEN lost THEN 'NO_SOURCE' WHEN changed THEN 'SOURCE_CHANGED' WHEN (length(sq) - length(replace(sq, trim(q), ''))) / length(trim(q)) = 0 THEN 'NOT_VERBATIM' WHEN (length(sq) - length(replace(sq, trim(q), ''))) / length(trim(q)) > 1 THEN 'NOT_UNIQUE' WHEN kind = 'OVERLAY' AND odd THEN 'UNKNOWN_TERM' WHEN kind = 'PREDICATE' THEN 'NO_STATUTE' END AS reason FROM d""")
def loaded_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts on the documents, checked again before loading: sources lost or changed, quotes not there or there twice."""
    t = table(spark, sf_dir, "documents").filter("text is not null and length(text) > 60").select("doc_id", "text", T.squeeze(F.col("text")).alias("sq"))
    i, none = F.col("doc_id"), F.lit(None)
    drafts = t.select(
        i.cast("string").alias("draft_id"), F.when(i % 4 == 0, "DRAFT").otherwise("APPROVED").alias("status"), F.when(i % 6 == 0, "PREDICATE").otherwise("OVERLAY").alias("kind"), i.alias("source"), F.when(i % 7 == 0, "never said so").otherwise(F.substring("sq", 1, 30)).alias("quote"),
        F.when(i % 5 == 0, "odd").otherwise("window").alias("term"), none.cast("date").alias("day"), F.lit("S").alias("statute_id"), F.lit("statutory_bars").alias("field"), F.lit(0).alias("item_index"), F.lit("h").alias("item_hash"),
    )
    sources = t.filter("doc_id % 9 <> 0").select(i.alias("source"), "text", F.lit("a").alias("sha256"), F.when(i % 8 == 0, "b").otherwise("a").alias("found"))
    items = spark.createDataFrame([], "statute_id string, field string, pos int, hash string")
    return audit.load_approved(drafts, sources, items, ["window"])


@query("""WITH l AS (SELECT lesson_no, any_value(lesson_id) AS lesson_id, any_value(error_code) AS e FROM lessons GROUP BY 1), c AS (SELECT lesson_no AS candidate_id, lesson_no % 9 AS k FROM l)
    SELECT candidate_id, CASE WHEN k = 0 THEN 'NO_ISSUE' WHEN k = 1 THEN 'UNKNOWN_ISSUE' WHEN k = 2 THEN 'EVIDENCE_DRIVEN' WHEN k = 3 THEN 'FOREIGN_PARAGRAPH' WHEN k = 4 THEN 'NAMES_A_PARTY' WHEN k = 5 THEN 'BASE_RATE' WHEN k = 6 THEN 'SPECIFIC' WHEN k = 7 THEN 'CONCLUSION' WHEN candidate_id % 2 = 0 THEN 'STORED_ALREADY' END AS reason FROM c""")
def lesson_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made from the lessons' numbers, each to break one rule; those of the last kind are sound unless stored."""
    l = table(spark, sf_dir, "lessons").select("lesson_no").distinct()
    i, k = F.col("lesson_no"), F.col("lesson_no") % 9
    texts = F.element_at(F.array(*map(F.lit, ("Ask early.", "Ask early.", "Ask early.", "Ask early.", "Tell Marin Kallova early.", "Courts usually grant it.", "See section 7 first.", "The claim must fail.", "Ask early."))), (k + 1).cast("int"))
    c = l.select(
        i.alias("candidate_id"), F.lit("c").alias("case_id"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("i9"))).when(k == 2, F.array(F.lit("i2"))).otherwise(F.array(F.lit("i1"), F.lit("i1"))).alias("issues"),
        F.when(k == 3, F.array(F.lit("P9"))).otherwise(F.array(F.lit("P1"))).alias("paras"), F.lit("When the notice is late").alias("trigger"), texts.alias("lesson"), F.concat(F.lit("d"), i.cast("string")).alias("digest"),
    )
    findings = spark.createDataFrame([("c", "i1", "LAW", ["P1"]), ("c", "i2", "EVIDENCE", ["P1"])], "case_id string, issue_id string, driver string, paras array<string>")
    names = spark.createDataFrame([("c", "Marin Kallova")], "case_id string, name string")
    return audit.lesson_rules(c, findings, names, ["usually grant"], ["must fail"], l.filter("lesson_no % 2 = 0").select(F.concat(F.lit("d"), i.cast("string")).alias("digest")))


@query("""WITH s AS (SELECT case_id, 'P' || doc_id AS source_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL), p AS (SELECT case_id, source_id FROM s UNION SELECT case_id, 'P0' FROM s)
    SELECT p.case_id, p.source_id, CASE WHEN low IS NULL THEN 'UNKNOWN_ID' WHEN contains(low, 'on a careful reading') OR contains(low, 'we are of the view') THEN 'COURT_VOICE' WHEN regexp_matches(low, '\\bstrangely\\b') THEN 'EVALUATIVE' END AS flag FROM p LEFT JOIN s USING (case_id, source_id)""")
def record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").filter("case_id is not null and text is not null").select("case_id", F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("source_id"), "text")
    return audit.record_facts(s.select("case_id", F.explode(F.array("source_id", F.lit("P0"))).alias("source_id")), s, ["on a careful reading", "we are of the view"], ["strangely"])
