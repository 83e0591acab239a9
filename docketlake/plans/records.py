"""Queries of record integrity, placements, folds and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import integrity, resolve, vector
from docketlake.plans.hearings import L, _lines
from docketlake.plans.library import LESSONS
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


@query("""WITH l AS (SELECT DISTINCT lesson_no, lesson_type AS t, memory AS m, party_status AS p, error_code AS e FROM lessons), r AS (SELECT lesson_no, 'JUDGE_TYPE' AS rule, t AS detail FROM l WHERE m = 'JUDGE' AND t <> 'LEGAL_RULE' UNION ALL SELECT lesson_no, 'ADVOCACY_MEMORY', m FROM l WHERE t = 'ADVOCACY' AND m <> 'LAWYER' UNION ALL SELECT lesson_no, 'LAWYER_WITHOUT_STATUS', '' FROM l WHERE m = 'LAWYER' AND p IS NULL
      UNION ALL SELECT lesson_no, 'JUDGE_WITH_STATUS', p FROM l WHERE m = 'JUDGE' AND p IS NOT NULL UNION ALL SELECT lesson_no, 'ERROR_WITHOUT_CODE', '' FROM l WHERE t = 'PROCEDURAL_ERROR' AND e IS NULL) SELECT 'lessons' AS table_name, lesson_no::VARCHAR AS row_key, rule, detail FROM r""")
def lesson_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.lesson_routing(table(spark, sf_dir, "lessons").select("lesson_no", "lesson_type", "memory", "party_status", "error_code").distinct(), "lesson_no")


@query("""WITH l AS (SELECT DISTINCT rec_no, statute_id AS s, act_prefix AS a, section_number AS n, loaded_at AS f, removed_at AS t, diagnostic_checklist.financial_threshold.minimum_amount AS m, diagnostic_checklist.financial_threshold.currency AS c, procedural_timelines.adjudication_window_days AS w FROM law), x AS (SELECT *, regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') AS ps, regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') AS pa, regexp_replace(upper(n), '[^A-Z0-9]', '', 'g') AS pn FROM l),
    r AS (SELECT rec_no, 'ID_MISMATCH' AS rule, s AS detail FROM x WHERE NOT starts_with(ps, pa) OR NOT ends_with(ps, pn) UNION ALL SELECT rec_no, 'RANGE_ORDER', t::DATE::VARCHAR FROM x WHERE t < f UNION ALL SELECT rec_no, 'THRESHOLD_WITHOUT_CURRENCY', '' FROM x WHERE m IS NOT NULL AND c IS NULL UNION ALL SELECT rec_no, 'NEGATIVE_WINDOW', w::VARCHAR FROM x WHERE w < 0
      UNION ALL SELECT rec_no, 'UNKNOWN_ACT', a FROM x WHERE a IS NOT NULL AND a NOT IN (SELECT act_prefix FROM acts)) SELECT 'law' AS table_name, rec_no::VARCHAR AS row_key, rule, detail FROM r""")
def law_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("diagnostic_checklist.financial_threshold.minimum_amount").alias("minimum_amount"), F.col("diagnostic_checklist.financial_threshold.currency").alias("currency"), F.col("procedural_timelines.adjudication_window_days").alias("adjudication_window_days")
    law = table(spark, sf_dir, "law").select("rec_no", "statute_id", "act_prefix", "section_number", "loaded_at", "removed_at", *t).distinct()
    return integrity.record_rules(law, table(spark, sf_dir, "acts"))


@query(f"""WITH t AS (SELECT s, n, CASE WHEN q > 30 THEN 'FLAGGED' ELSE 'PASS' END AS o, CASE WHEN q % 4 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN f <> 'N' THEN f END AS w, CASE WHEN w = 'F' THEN 'DECIDED' ELSE 'UNSTABLE' END AS st FROM ({L}))
    SELECT s AS session_id, n AS turn, 'PASS_WITH_ERRORS' AS rule FROM t WHERE o <> 'FLAGGED' AND e > 0 UNION ALL SELECT s, n, 'FLAGGED_WITHOUT_ERROR' FROM t WHERE o = 'FLAGGED' AND e = 0 UNION ALL SELECT s, n, 'DECIDED_WITHOUT_WINNER' FROM t WHERE st = 'DECIDED' AND w IS NULL UNION ALL SELECT s, n, 'UNDECIDED_WITH_WINNER' FROM t WHERE st <> 'DECIDED' AND w IS NOT NULL UNION ALL SELECT s, n, 'TURN_ID' FROM t WHERE n = 7""")
def outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as turns; the seventh has an id of another shape."""
    t = _lines(spark, sf_dir).select(
        F.col("s").alias("session_id"), F.col("n").alias("turn"), F.when(F.col("n") == 7, "T7").otherwise(T.claim_id(F.col("n"), F.lit(1))).alias("claim_id"), F.when(F.col("q") > 30, "FLAGGED").otherwise("PASS").alias("outcome"),
        F.when(F.col("q") % 4 == 0, F.array(F.lit("E"))).otherwise(F.array().cast("array<string>")).alias("hard_errors"), F.when(F.col("f") != "N", F.col("f")).alias("winner"), F.when(F.col("w") == "F", "DECIDED").otherwise("UNSTABLE").alias("status"),
    )
    return integrity.outcome_rules(t)


@query("""WITH a(cited_prefix, law_db_prefix) AS (SELECT DISTINCT act_prefix, CASE WHEN act_year % 3 = 0 THEN act_prefix WHEN act_year % 3 = 1 THEN 'X' || act_prefix ELSE (SELECT min(act_prefix) FROM acts) END FROM acts)
    SELECT cited_prefix, 'SELF' AS rule FROM a WHERE cited_prefix = law_db_prefix UNION SELECT cited_prefix, 'REPEATED' FROM a GROUP BY 1 HAVING count(*) > 1 UNION SELECT cited_prefix, 'CHAINED' FROM a WHERE cited_prefix <> law_db_prefix AND law_db_prefix IN (SELECT cited_prefix FROM a)""")
def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = table(spark, sf_dir, "acts")
    least = F.broadcast(acts.agg(F.min("act_prefix").alias("least")))  # one row
    y = F.col("act_year") % 3
    a = acts.join(least).select(F.col("act_prefix").alias("cited_prefix"), F.when(y == 0, F.col("act_prefix")).when(y == 1, F.concat(F.lit("X"), "act_prefix")).otherwise(F.col("least")).alias("law_db_prefix")).distinct()
    return integrity.alias_rules(a)


@query(f"""WITH l AS (SELECT *, coalesce(error_code, '') || '/' || coalesce(party_status, '') AS k FROM ({LESSONS}) WHERE status = 'ACTIVE' AND error_code IS NOT NULL AND party_status IS NOT NULL), z AS (SELECT lesson_no, any_value(frequency) AS f, any_value(severity) AS s, any_value(confidence) AS c FROM lessons GROUP BY 1),
    p AS (SELECT a.lesson_no, b.lesson_no AS m, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM l a JOIN l b ON a.k = b.k AND a.lesson_no <> b.lesson_no WHERE list_cosine_similarity(a.vec, b.vec) >= 0.8999999), r AS (SELECT *, row_number() OVER (PARTITION BY lesson_no ORDER BY s DESC, m) AS rn FROM p WHERE s >= 0.9),
    o AS (SELECT l.lesson_no, r.m, CASE (l.lesson_no + r.m) % 3 WHEN 0 THEN 'SAME' WHEN 1 THEN 'OPPOSITE' ELSE 'DIFFERENT' END AS rel FROM l LEFT JOIN r ON l.lesson_no = r.lesson_no AND r.rn = 1)
    SELECT o.lesson_no AS lesson_id, CASE WHEN m IS NULL OR rel = 'DIFFERENT' THEN 'INSERTED' WHEN rel = 'SAME' THEN 'MERGED' ELSE 'INSERTED_OPPOSITE' END AS outcome, CASE WHEN rel IN ('SAME', 'OPPOSITE') AND m IS NOT NULL THEN m END AS match_id, CASE WHEN m IS NOT NULL AND rel = 'SAME' THEN b.f + 1 ELSE a.f END AS frequency,
      CASE WHEN m IS NOT NULL AND rel = 'SAME' THEN greatest(a.s, b.s) ELSE a.s END AS severity, round(CASE WHEN m IS NOT NULL AND rel = 'OPPOSITE' THEN greatest(b.c - 0.1, 0) END, 6) AS match_confidence FROM o JOIN z a ON a.lesson_no = o.lesson_no LEFT JOIN z b ON b.lesson_no = m""")
def settled_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the placements of lesson_placement write, with relations made from the pair's numbers."""
    lessons = table(spark, sf_dir, "lessons")
    usable = lessons.filter(vector.usable(F.col("vec"), 64)).dropDuplicates(["lesson_no"]).filter("status = 'ACTIVE' and error_code is not null and party_status is not null")
    keyed = usable.select(F.col("lesson_no").alias("lesson_id"), F.concat_ws("/", "error_code", "party_status").alias("key"), "vec")
    placed = vector.placement(keyed, keyed, 0.9)
    k = (F.col("lesson_id") + F.col("match_id")) % 3
    relations = placed.filter("match_id is not null").select("lesson_id", "match_id", F.when(k == 0, "SAME").when(k == 1, "OPPOSITE").otherwise("DIFFERENT").alias("relation"))
    held = lessons.groupBy(F.col("lesson_no").alias("lesson_id")).agg(F.first("frequency").alias("frequency"), F.first("severity").alias("severity"), F.first("confidence").alias("confidence"))
    return integrity.settle(placed, relations, held, 0.1).withColumn("match_confidence", F.round("match_confidence", 6))


@query(f"""WITH t AS (SELECT s, n % 3 AS t, w = 'O' AS c, q % 3 = 0 AS k FROM ({L})) SELECT s AS session_id, t AS turn, round(avg(k::INT), 9) AS share, CASE WHEN c THEN NULL WHEN avg(k::INT) > 0.6 THEN 'HARD' WHEN avg(k::INT) >= 0.25 THEN 'WARN' END AS flag FROM t GROUP BY s, t, c""")
def repetition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _lines(spark, sf_dir).select(F.col("s").alias("session_id"), (F.col("n") % 3).alias("turn"), (F.col("w") == "O").alias("closing"), (F.col("q") % 3 == 0).alias("copied"))
    return integrity.repetition_share(c, 0.25, 0.6).withColumn("share", F.round("share", 9))


@query("""WITH r AS (SELECT DISTINCT precedent_id AS id, md5(coalesce(ratio_text, '') || '|' || trim(regexp_replace(lower(case_title), '[^a-z0-9]+', ' ', 'g'))) AS d FROM precedents WHERE precedent_id IS NOT NULL AND case_title IS NOT NULL), k AS (SELECT d, min(id) AS kept FROM r GROUP BY d HAVING count(*) > 1) SELECT id, min(kept) AS kept_id FROM r JOIN k USING (d) WHERE id <> kept GROUP BY id""")
def folded_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents with the ratio and title of another id."""
    p = table(spark, sf_dir, "precedents").filter("precedent_id is not null and case_title is not null")
    return integrity.folded_copies(p.select(F.col("precedent_id").alias("id"), F.md5(F.concat(F.coalesce("ratio_text", F.lit("")), F.lit("|"), T.title_key(F.col("case_title")))).alias("d")), "id", "d")


@query(f"SELECT s AS session_id, n AS turn, round(0.7 * q / 50.0 + 0.3 * CASE WHEN f = 'N' THEN 1.0 ELSE d END, 9) AS score FROM ({L})")
def local_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lines(spark, sf_dir).select(F.col("s").alias("session_id"), F.col("n").alias("turn"), (F.col("q") / 50.0).alias("rule_coverage"), F.when(F.col("f") != "N", F.col("d")).alias("responsiveness"))
    return integrity.local_scores(v, 0.7, 0.3).withColumn("score", F.round("score", 9))


@query("""WITH o AS (SELECT o_orderkey AS c, 'P' || (o_orderkey % 2) AS p, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'SKIPPED' END AS r FROM orders), i(p, n) AS (VALUES ('P0', 'A'), ('P0', 'N'), ('P1', 'R')), b AS (SELECT o.c, o.p, string_agg(DISTINCT 'S' || l_suppkey, ',' ORDER BY 'S' || l_suppkey) AS ids FROM o JOIN i ON i.p = o.p JOIN lineitem ON l_orderkey = o.c AND l_returnflag = i.n WHERE r = 'FAIL' GROUP BY ALL)
    SELECT o.c AS "case", o.p AS predicate_id, CASE WHEN r = 'FAIL' THEN 'ERROR' ELSE 'WARNING' END AS kind, CASE WHEN r = 'FAIL' THEN coalesce(ids, '') ELSE 'price' END AS detail FROM o LEFT JOIN b USING (c, p) WHERE r <> 'PASS'""")
def predicate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.concat(F.lit("P"), (F.col("o_orderkey") % 2).cast("string")).alias("predicate_id"), F.when(s == "F", "PASS").when(s == "O", "FAIL").otherwise("SKIPPED").alias("outcome"), F.array(F.lit("price")).alias("missing"))
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("input"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("record_id"))
    return integrity.predicate_errors(o, facts, {"P0": ["A", "N"], "P1": ["R"]})


@query("""WITH a AS (SELECT case_id, list(DISTINCT (statute_id, source_paras)) AS f, list(DISTINCT statute_id) AS i FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IS NOT NULL GROUP BY 1), d AS (SELECT case_id, max(recorded_at)::DATE AS d FROM statutory_analysis WHERE case_id IS NOT NULL GROUP BY 1),
    p AS (SELECT case_id, list(DISTINCT x) AS v, max(ingested_at)::DATE AS e FROM (SELECT case_id, unnest(statutes_cited) AS x, ingested_at FROM precedents WHERE case_id IS NOT NULL) WHERE x IS NOT NULL GROUP BY 1), j AS (SELECT a.case_id, i, v, d, e FROM a JOIN p USING (case_id) JOIN d USING (case_id)), k AS (SELECT DISTINCT case_id, x FROM (SELECT case_id, unnest(source_paras) AS x FROM statutory_analysis WHERE act_prefix LIKE 'C%'))
    SELECT case_id, 'NOT_FRAMED' AS problem, unnest(list_filter(i, lambda x: NOT list_contains(v, x))) AS detail FROM j UNION ALL SELECT case_id, 'NO_FINDING', unnest(list_filter(v, lambda x: NOT list_contains(i, x))) FROM j UNION ALL SELECT case_id, 'DATE_DIFFERS', d::VARCHAR FROM j WHERE d IS DISTINCT FROM e
    UNION ALL SELECT case_id, 'RELIEF_NOT_SHOWN', 'R1' FROM j WHERE len(v) > 1 UNION ALL SELECT DISTINCT q.case_id, 'UNKNOWN_PARAGRAPH', q.x FROM (SELECT DISTINCT case_id, unnest(source_paras) AS x FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IS NOT NULL) q ANTI JOIN k ON k.case_id = q.case_id AND k.x = q.x WHERE q.x IS NOT NULL""")
def truth_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's analyses as its truth, what its precedents cite as the view."""
    s = table(spark, sf_dir, "statutory_analysis").filter("case_id is not null")
    finding = F.struct(F.col("statute_id").alias("issue_id"), F.coalesce("source_paras", F.array().cast("array<string>")).alias("paras"))
    decided = s.groupBy("case_id").agg(F.max("recorded_at").cast("date").alias("decided"))
    truth = s.filter("statute_id is not null").groupBy("case_id").agg(F.collect_set(finding).alias("findings")).join(decided, "case_id").withColumn("reliefs", F.array(F.lit("R1")))
    p = table(spark, sf_dir, "precedents").filter("case_id is not null").select("case_id", "ingested_at", F.explode("statutes_cited").alias("x")).filter("x is not null")
    view = p.groupBy("case_id").agg(F.collect_set("x").alias("issues"), F.max("ingested_at").cast("date").alias("decided")).withColumn("reliefs", F.when(F.size("issues") > 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("R1"))))
    paragraphs = s.filter("act_prefix like 'C%'").select("case_id", F.explode("source_paras").alias("para_id")).distinct()
    return integrity.truth_problems(truth, view, paragraphs).filter("detail is not null")


@query("""WITH e AS (SELECT user_id AS s, event_id % 5 AS t, event_id % 2 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS k, props AS p FROM events) SELECT s AS session_id, t AS turn, a AS attempt, string_agg(k, '>' ORDER BY seq) AS kinds, arg_max(p, seq) AS last_payload, count(*) AS n FROM e GROUP BY ALL""")
def turn_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketlake.operators import runlog

    e = runlog.number_events(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return integrity.turn_model(e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 5).alias("turn"), (F.col("event_id") % 2).alias("attempt"), "seq", F.col("event_type").alias("kind"), F.col("props").alias("payload")))


@query("""WITH e AS (SELECT * FROM events WHERE event_type <> 'view'), s AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) + coalesce(n, 0) AS seq FROM e LEFT JOIN s ON s.user_id = e.user_id""")
def continued_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events numbered on from what is stored: a session's views."""
    e = table(spark, sf_dir, "events")
    stored = e.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("last_seq"))
    return integrity.continued(e.filter("event_type <> 'view'"), "user_id", ["ts", "event_id"], stored).select("event_id", "seq")


@query("SELECT DISTINCT lesson_no, CASE WHEN memory = 'JUDGE' THEN 'written' ELSE 'refused' END AS part FROM lessons")
def refused_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = integrity.refused_memory(table(spark, sf_dir, "lessons").select("lesson_no", "memory").distinct(), "JUDGE")
    return own.select("lesson_no", F.lit("written").alias("part")).unionByName(other.select("lesson_no", F.lit("refused").alias("part"))).distinct()


@query("""WITH c(stage, cap) AS (VALUES ('click', 1000.0::DOUBLE), ('view', 100000000.0::DOUBLE), ('gone', 1.0::DOUBLE)), s AS (SELECT event_type AS stage, sum(value) AS spent FROM events GROUP BY 1) SELECT stage, round(spent, 4) AS spent, cap FROM s JOIN c USING (stage) WHERE spent > cap""")
def stages_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([("click", 1000.0), ("view", 1e8), ("gone", 1.0)], "stage string, cap double")
    return integrity.over_budget(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("cost")), caps).withColumn("spent", F.round("spent", 4))


@query("SELECT DISTINCT rec_no, statute_id, section_title FROM law WHERE statute_id IN ('CREVC_1999_SEC_1', 'MEDC_1990_SEC_1', 'NOWHERE_1900_SEC_1')")
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.point_read(table(spark, sf_dir, "law").select("rec_no", "statute_id", "section_title"), "statute_id", ["CREVC_1999_SEC_1", "MEDC_1990_SEC_1", "NOWHERE_1900_SEC_1"]).distinct()


@query("""WITH m AS (SELECT min(snapshot_no) AS a, max(snapshot_no) AS b FROM law_snapshots), o AS (SELECT statute_id, jurisdiction_type AS j FROM law_snapshots, m WHERE snapshot_no = a), n AS (SELECT statute_id, jurisdiction_type AS j FROM law_snapshots, m WHERE snapshot_no = b) SELECT statute_id, j, 'gone' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT statute_id, j, 'come' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)""")
def delivery_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first and the last delivery as multisets: what one has more often."""
    s = table(spark, sf_dir, "law_snapshots")
    ends = F.broadcast(s.agg(F.min("snapshot_no").alias("a"), F.max("snapshot_no").alias("b")))  # one row
    s = s.select("snapshot_no", "statute_id", F.col("jurisdiction_type").alias("j")).join(ends)
    return integrity.multiset_difference(s.filter("snapshot_no = a").select("statute_id", "j"), s.filter("snapshot_no = b").select("statute_id", "j"))


@query("""WITH c AS (SELECT DISTINCT x FROM (SELECT unnest(statutes_cited) AS x FROM precedents) WHERE x IS NOT NULL), p AS (SELECT DISTINCT row_no, precedent_uid AS u, ratio_text FROM precedents), f AS (SELECT k FROM (SELECT unnest(json_keys(raw_json)) AS k FROM law_files WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT') WHERE k NOT IN ('statute_id', 'act_name'))
    SELECT 'resolved' AS counter, (x IN (SELECT statute_id FROM law WHERE statute_id IS NOT NULL))::VARCHAR AS label, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'repeated_uids', (n > 1)::VARCHAR, count(*) FROM (SELECT u, count(*) AS n FROM p GROUP BY u) GROUP BY ALL UNION ALL SELECT 'ratio', CASE WHEN ratio_text IS NULL THEN 'none' WHEN contains(ratio_text, ':') THEN 'labelled' ELSE 'plain' END, count(*) FROM p GROUP BY ALL
    UNION ALL SELECT 'undocumented', k, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'windows', w::VARCHAR, count(*) FROM (SELECT ceil(len(list_filter(regexp_split_to_array(ratio_text, '[\\s\\x0B]+'), lambda w: w <> '')) / 100)::BIGINT AS w FROM p WHERE ratio_text IS NOT NULL) GROUP BY ALL""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five counters of an ingest: resolved citations, repeated uids, labelled ratios, undocumented fields, windows a ratio takes."""
    p = table(spark, sf_dir, "precedents").select("row_no", F.col("precedent_uid").alias("u"), "ratio_text", "statutes_cited")
    rows = p.select("row_no", "u", "ratio_text").distinct()
    cited = resolve.resolve(p.select(F.explode("statutes_cited").alias("citation")), table(spark, sf_dir, "law").filter("statute_id is not null"))
    keys = table(spark, sf_dir, "law_files").select(F.explode(F.json_object_keys("raw_json")).alias("k")).filter("k not in ('statute_id', 'act_name')")
    return integrity.ingest_counters({
        "resolved": (cited, F.coalesce(F.col("rule") == "exact", F.lit(False))), "repeated_uids": (rows.groupBy("u").agg(F.count("*").alias("n")), F.col("n") > 1),
        "ratio": (rows, F.when(F.col("ratio_text").isNull(), "none").when(F.contains("ratio_text", F.lit(":")), "labelled").otherwise("plain")), "undocumented": (keys, F.col("k")), "windows": (rows.filter("ratio_text is not null"), F.size(T.window_places(F.col("ratio_text"), 100))),
    })
