"""Queries of the case-record and hearing operators. Where the project has no such table, order lines stand for turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import text
from docketlake.operators import checks, evaluation, hearing, overlap, quality, records, reports, resolve, runlog
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


PRECEDENTS = "SELECT DISTINCT row_no, precedent_uid AS uid, precedent_id, case_id, upper(final_order) AS state, content_hash, ingested_at FROM precedents"


def _precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "precedents")
    return p.select("row_no", F.col("precedent_uid").alias("uid"), "precedent_id", "case_id", F.upper("final_order").alias("state"), "content_hash", "ingested_at").distinct()


@query("""WITH s AS (SELECT DISTINCT case_id FROM precedents WHERE upper(final_order) = 'DISMISSED') SELECT a.analysis_id, a.case_id FROM (SELECT DISTINCT analysis_id, case_id FROM statutory_analysis) a SEMI JOIN s ON a.case_id = s.case_id""")
def unsealed_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of cases whose precedent is decided as dismissed: the seal opens with the verdict."""
    truth = table(spark, sf_dir, "statutory_analysis").select("analysis_id", "case_id").distinct()
    sessions = _precedents(spark, sf_dir).select("case_id", F.when(F.col("state") == "DISMISSED", "VERDICT").otherwise("RUNNING").alias("state"))
    return records.unsealed(truth, sessions)


@query("""SELECT a.analysis_id, a.case_id FROM (SELECT DISTINCT analysis_id, case_id FROM statutory_analysis) a WHERE NOT EXISTS (SELECT 1 FROM precedents p WHERE p.case_id = a.case_id)""")
def reviewable_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "statutory_analysis").select("analysis_id", "case_id").distinct()
    return records.reviewable(truth, _precedents(spark, sf_dir))


@query("""SELECT DISTINCT row_no, array_to_string(list_filter([case_title, appeal_number, final_order], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS text FROM precedents""")
def precedent_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head part of each precedent as one text."""
    p = table(spark, sf_dir, "precedents").select("row_no", "case_title", "appeal_number", "final_order").distinct()
    return records.part(p, "row_no", {"head": ["case_title", "appeal_number", "final_order"]}, "head")


@query(
    f"""WITH p AS ({PRECEDENTS}), r AS (SELECT DISTINCT uid, precedent_id FROM p WHERE uid IS NOT NULL), w AS (SELECT DISTINCT precedent_id AS wanted FROM p UNION SELECT DISTINCT uid FROM p),
    n AS (SELECT precedent_id, count(*) AS n, min(uid) AS one FROM r GROUP BY 1)
    SELECT w.wanted, CASE WHEN contains(w.wanted, '#') THEN (SELECT min(uid) FROM r WHERE uid = w.wanted) ELSE (SELECT one FROM n WHERE n.precedent_id = w.wanted AND n.n = 1) END AS uid FROM w WHERE w.wanted IS NOT NULL"""
)
def bare_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and uids resolved to uids; a bare id that several precedents carry resolves to none."""
    p = _precedents(spark, sf_dir)
    wanted = p.select(F.col("precedent_id").alias("wanted")).union(p.select("uid")).filter("wanted is not null").distinct()
    return records.ambiguous_lookup(wanted, p.select("uid", "precedent_id").filter("uid is not null").distinct())


@query(f"""WITH p AS ({PRECEDENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ingested_at, row_no) AS rn FROM p) SELECT row_no, uid FROM r WHERE rn = 1""")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_occurrence(_precedents(spark, sf_dir), "uid", ["ingested_at", "row_no"]).select("row_no", "uid")


@query(
    f"""WITH p AS ({PRECEDENTS}), f AS (SELECT precedent_id, content_hash, min((ingested_at, row_no)) AS a FROM p GROUP BY 1, 2),
    n AS (SELECT precedent_id, content_hash, row_number() OVER (PARTITION BY precedent_id ORDER BY a) AS n FROM f)
    SELECT p.row_no, p.precedent_id || CASE WHEN n = 1 THEN '' WHEN n <= 26 THEN '_' || chr(n::INT + 64) ELSE '_' || n END AS new_id FROM p JOIN n USING (precedent_id, content_hash)"""
)
def id_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlike contents under one precedent id told apart by suffixes, in order of arrival."""
    return records.suffixes(_precedents(spark, sf_dir), "precedent_id", "content_hash", ["ingested_at", "row_no"]).select("row_no", "new_id")


@query(
    """WITH f AS (SELECT DISTINCT case_id, statute_id AS i FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IS NOT NULL), g AS (SELECT DISTINCT case_id, x AS i FROM (SELECT case_id, unnest(statutes_cited) AS x FROM precedents) WHERE case_id IS NOT NULL AND x IS NOT NULL)
    SELECT coalesce(f.case_id, g.case_id) AS case_id, coalesce(f.i, g.i) AS issue_id, CASE WHEN g.i IS NULL THEN 'NOT_FRAMED' ELSE 'NO_FINDING' END AS problem FROM f FULL JOIN g ON f.case_id = g.case_id AND f.i = g.i WHERE f.i IS NULL OR g.i IS NULL"""
)
def truth_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes analysed in a case that its precedents don't cite, and the other way round."""
    f = table(spark, sf_dir, "statutory_analysis").select("case_id", F.col("statute_id").alias("issue_id")).filter("case_id is not null and issue_id is not null")
    g = table(spark, sf_dir, "precedents").select("case_id", F.explode("statutes_cited").alias("issue_id")).filter("case_id is not null and issue_id is not null")
    return records.reconcile(f, g)


@query("""SELECT l_orderkey AS case_id, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1""")
def done_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose lines are ticked."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("item_id"), (F.col("l_linestatus") == "F").alias("ok"))
    items, ticked = line.select("case_id", "item_id").distinct(), line.groupBy("case_id", "item_id").agg(F.bool_and("ok").alias("ok"))
    return records.ticks(items, ticked)


@query("""WITH d AS (SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'R' THEN 'EVIDENCE' ELSE 'LAW' END AS d FROM lineitem) SELECT case_id, CASE WHEN bool_and(d = 'LAW') THEN 'LAW_ONLY' WHEN bool_and(d = 'EVIDENCE') THEN 'EVIDENCE_DECIDED' ELSE 'MIXED' END AS class FROM d GROUP BY 1""")
def evidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return records.evidence_class(line.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_returnflag") == "R", "EVIDENCE").otherwise("LAW").alias("driver")))


@query()
def court_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs of the documents (each number hangs on the one accepted before, so without SQL)."""
    lines = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return records.court_numbering(lines, 2, 3)


TURNS = "SELECT DISTINCT l_orderkey AS session_id, l_linenumber AS turn, min(l_returnflag) AS side, CASE WHEN min(l_linestatus) = 'F' AND l_linenumber > 5 THEN 'CLOSING' ELSE 'ARGUMENT' END AS kind, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("turn")).agg(F.min("l_returnflag").alias("side"), F.min("l_linestatus").alias("s"), F.sum("l_quantity").cast("long").alias("q"))
    return line.withColumn("kind", F.when((F.col("s") == "F") & (F.col("turn") > 5), "CLOSING").otherwise("ARGUMENT")).drop("s")


@query(
    f"""WITH t AS ({TURNS}) SELECT t.session_id, t.turn, count(b.turn) AS n_before, max(CASE WHEN b.side <> t.side THEN b.turn END) AS last_opposing
    FROM t LEFT JOIN t b ON b.session_id = t.session_id AND b.turn < t.turn AND b.kind <> 'CLOSING' GROUP BY ALL"""
)
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stood before each line of an order, and the last line of another return flag."""
    return hearing.context(_turns(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT session_id, turn, q AS f, q // 2 AS s FROM ({TURNS})), n AS (SELECT session_id, sum(f) AS f, sum(s) AS s, count(*) AS n FROM t GROUP BY 1),
    w AS (SELECT session_id, row_number() OVER x AS i, sum(f - s) OVER x AS saved, sum(s) OVER x AS gone FROM t WINDOW x AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    a AS (SELECT session_id, 0 AS k, f AS shown FROM n UNION ALL SELECT w.session_id, i, f - saved FROM w JOIN n USING (session_id) UNION ALL SELECT w.session_id, n + i, s - gone FROM w JOIN n USING (session_id)),
    b AS (SELECT session_id, min(k) AS k, arg_min(shown, k) AS shown FROM a WHERE shown <= 60 GROUP BY 1)
    SELECT session_id, shown::BIGINT AS shown, least(k, n) AS n_short, greatest(k - n, 0) AS n_dropped FROM b JOIN n USING (session_id)"""
)
def condensed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest form of an order's lines that fits into 60, shortening and then dropping the oldest."""
    t = _turns(spark, sf_dir).select("session_id", "turn", F.col("q").alias("full"), F.floor(F.col("q") / 2).alias("short"))
    return hearing.condense(t, 60)


@query(
    """SELECT l_orderkey AS session_id, l_linestatus AS side, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 9) AS depth,
      concat_ws(' ', CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'ANSWERED=' || count(*) FILTER (l_returnflag = 'A') END, CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'N=' || count(*) FILTER (l_returnflag = 'N') END, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'R=' || count(*) FILTER (l_returnflag = 'R') END) AS statuses FROM lineitem GROUP BY ALL"""
)
def rebuttal_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    points = line.select(F.col("l_orderkey").alias("session_id"), F.col("l_linestatus").alias("side"), F.when(F.col("l_returnflag") == "A", "ANSWERED").otherwise(F.col("l_returnflag")).alias("status"), F.col("l_quantity").alias("centrality"))
    return hearing.rebuttal_depth(points).select("session_id", "side", F.round("depth", 9).alias("depth"), F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("statuses"))


@query(
    """WITH a AS (SELECT l_orderkey AS session_id, l_suppkey AS claim_id, CASE WHEN l_quantity > 5 THEN l_returnflag ELSE 'N' END AS e FROM lineitem)
    SELECT session_id, claim_id, CASE WHEN bool_and(e = 'A') THEN 'VERIFIED' ELSE 'UNVERIFIABLE' END AS tier, CASE WHEN bool_or(e = 'R') THEN 'CONTRADICTS' WHEN bool_and(e = 'A') THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS entailment FROM a GROUP BY ALL"""
)
def citation_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    a = line.select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("claim_id"), F.when(F.col("l_returnflag") == "R", "CONTRADICTS").when(F.col("l_returnflag") == "A", "SUPPORTS").otherwise("NEUTRAL").alias("entailment"), (F.col("l_quantity") > 5).alias("verbatim"))
    return hearing.citation_tiers(a)


@query(
    """WITH a AS (SELECT l_orderkey AS s, l_suppkey AS t, l_linenumber AS a, min(l_returnflag) AS f, min(l_linestatus) AS w FROM lineitem GROUP BY ALL), f AS (SELECT s, t, min(CASE WHEN f <> 'R' THEN a END) AS c, max(a) AS m FROM a GROUP BY ALL)
    SELECT s AS session_id, t AS turn, least(coalesce(c, m), 4) AS attempts, CASE WHEN f = 'R' THEN 'FLAGGED' WHEN w = 'O' THEN 'PASS_WITH_NOTES' ELSE 'PASS' END AS outcome FROM f JOIN a USING (s, t) WHERE a = least(coalesce(c, m), 4)"""
)
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order and supplier as attempts: the first clean one, or the last allowed, decides."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("turn"), F.col("l_linenumber").alias("attempt")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("w"))
    none = F.array().cast("array<string>")
    a = line.select("session_id", "turn", "attempt", F.when(F.col("f") == "R", F.array(F.lit("E"))).otherwise(none).alias("hard_errors"), F.when(F.col("w") == "O", F.array(F.lit("W"))).otherwise(none).alias("warnings"))
    return hearing.attempt_fold(a, 3)


@query(
    """WITH g AS (SELECT case_id, count(CASE WHEN doc_kind = 'order' THEN 1 END) AS a, count(CASE WHEN doc_kind = 'submission' THEN 1 END) AS b, coalesce(sum(CASE WHEN doc_kind = 'order' THEN length(text) ELSE 0 END), 0) AS la, coalesce(sum(CASE WHEN doc_kind = 'submission' THEN length(text) ELSE 0 END), 0) AS lb
      FROM documents WHERE case_id IS NOT NULL AND doc_kind IN ('order', 'submission') AND text IS NOT NULL GROUP BY 1)
    SELECT case_id, greatest(a, b) / greatest(least(a, b), 1) > 3 OR greatest(la, lb) / greatest(least(la, lb), 1) > 3 AS unbalanced FROM g"""
)
def grounds_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose orders and submissions are out of balance by more than three to one."""
    d = table(spark, sf_dir, "documents").filter("case_id is not null and doc_kind in ('order', 'submission') and text is not null")
    return hearing.grounds_balance(d.select("case_id", F.when(F.col("doc_kind") == "order", "A").otherwise("B").alias("side"), "text"), 3)


@query(
    """WITH n AS (SELECT DISTINCT case_id, party_name AS name FROM parties WHERE case_id IS NOT NULL AND party_name IS NOT NULL), a AS (SELECT DISTINCT case_id, text FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL)
    SELECT DISTINCT a.case_id, name FROM a JOIN n USING (case_id) WHERE contains(text, name) OR len(list_filter(list_distinct(list_filter(regexp_split_to_array(name, '[^A-Za-z0-9]+'), lambda w: len(w) >= 4 AND lower(w) NOT IN ("""
    + ", ".join(f"'{w}'" for w in overlap.GENERIC)
    + """))), lambda w: contains(text, w))) >= 2"""
)
def recalled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party names that a document of their case gives in full or by two distinctive words."""
    a = table(spark, sf_dir, "documents").select("case_id", "text").filter("case_id is not null and text is not null")
    n = table(spark, sf_dir, "parties").select("case_id", F.col("party_name").alias("name")).filter("case_id is not null and name is not null")
    return overlap.recalled_names(a, n)


@query(
    """WITH o AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, o_orderstatus AS s FROM orders), f AS (SELECT q, min(CASE WHEN s = 'P' THEN r END) AS f FROM o GROUP BY q)
    SELECT round(avg((f <= 10)::INT::DOUBLE * (f IS NOT NULL)::INT + 0), 9) AS recall_at_k, round(avg(CASE WHEN f <= 10 THEN 1.0 / f ELSE 0 END), 9) AS mrr FROM (SELECT coalesce(f, 9999) AS f FROM f)"""
)
def known_item_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of customers with a pending order among their ten dearest."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    o = table(spark, sf_dir, "orders").withColumn("r", r).groupBy(F.col("o_custkey").alias("query_id")).agg(F.min(F.when(F.col("o_orderstatus") == "P", F.col("r"))).alias("found_at"))
    return evaluation.retrieval_quality(o, 10).select(F.round("recall_at_k", 9).alias("recall_at_k"), F.round("mrr", 9).alias("mrr"))


@query(
    """WITH a(cited_prefix, law_db_prefix) AS (VALUES ('CREVC', 'REVIVAL'), ('CREVC_1999', 'CRC_1999'), ('MEDC', 'MEDIATION')), c AS (SELECT DISTINCT x AS citation FROM (SELECT unnest(statutes_cited) AS x FROM precedents) WHERE x IS NOT NULL),
    h AS (SELECT citation, cited_prefix, law_db_prefix, row_number() OVER (PARTITION BY citation ORDER BY length(cited_prefix) DESC) AS rn FROM c JOIN a ON citation = cited_prefix OR starts_with(citation, cited_prefix || '_'))
    SELECT c.citation, h.law_db_prefix || substr(c.citation, length(h.cited_prefix) + 1) AS aliased FROM c LEFT JOIN h ON c.citation = h.citation AND rn = 1"""
)
def alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with their longest aliased prefix replaced."""
    c = table(spark, sf_dir, "precedents").select(F.explode("statutes_cited").alias("citation")).filter("citation is not null").distinct()
    aliases = spark.createDataFrame([("CREVC", "REVIVAL"), ("CREVC_1999", "CRC_1999"), ("MEDC", "MEDIATION")], "cited_prefix string, law_db_prefix string")
    return resolve.rewrite_alias(c, aliases)


# Reports and checks


@query(
    """WITH r AS (SELECT DISTINCT row_no, precedent_id AS id, content_hash AS h, coalesce(final_order, '~') AS l FROM precedents), t AS (SELECT h, count(*) AS n, count(DISTINCT l) AS k FROM r GROUP BY h), i AS (SELECT id, count(DISTINCT h) AS n FROM r GROUP BY id)
    SELECT 'rows' AS measure, count(*) AS n FROM r UNION ALL SELECT 'contents', count(*) FROM t UNION ALL SELECT 'duplicated', count(*) FROM t WHERE n > 1 UNION ALL SELECT 'conflicting_labels', count(*) FROM t WHERE k > 1 UNION ALL SELECT 'id_collisions', count(*) FROM i WHERE n > 1"""
)
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate contents, conflicting outcomes and id collisions among the precedents."""
    rows = table(spark, sf_dir, "precedents").select("row_no", F.col("precedent_id").alias("id"), F.col("content_hash").alias("h"), F.coalesce("final_order", F.lit("~")).alias("l")).distinct()
    return reports.corpus_audit(rows, "id", "h", "l")


@query("""SELECT coalesce(source, '~') AS source, coalesce(lang, '~') AS lang, doc_kind, count(*) AS n FROM documents GROUP BY ALL""")
def route_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("~")).alias("source"), F.coalesce("lang", F.lit("~")).alias("lang"), "doc_kind")
    return reports.route_histogram(docs, ["source", "lang"], "doc_kind")


@query(
    """WITH d AS (SELECT l_suppkey AS judge, l_orderkey AS case_id, CASE WHEN l_quantity > 5 AND l_returnflag <> 'N' THEN l_returnflag END AS result, l_returnflag = 'N' AS swapped, CASE WHEN l_linestatus = 'F' THEN l_discount END AS gap, l_quantity > 5 AS ok, l_linenumber % 3 AS ia, 3 AS i FROM lineitem),
    w AS (SELECT judge, max(n) AS top FROM (SELECT judge, result, count(*) AS n FROM d WHERE result IS NOT NULL GROUP BY ALL) GROUP BY judge),
    g AS (SELECT judge, count(*) AS cases, count(result) AS decided, count(*) FILTER (swapped) / nullif(count(*) FILTER (ok), 0) AS rate, sum(ia) FILTER (ok) / nullif(sum(i) FILTER (ok), 0) AS ir, count(gap) AS gaps, min(gap) AS a, median(gap) AS m, max(gap) AS z, count(*) FILTER (gap > 0.05) AS o FROM d GROUP BY judge)
    SELECT g.judge, cases, decided, round(rate, 9) AS disagreement_rate, coalesce(rate > 0.35, false) AS over_limit, round(ir, 9) AS issue_disagreement_rate, gaps, a AS gap_min, round(m, 9) AS gap_median, z AS gap_max, o AS gaps_over, coalesce(top, 0) AS top_wins, coalesce(decided >= 100 AND top / decided > 0.52, false) AS biased FROM g LEFT JOIN w ON w.judge = g.judge"""
)
def persona_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a judge: disagreement between orders, gaps, and whether one return flag wins too often."""
    line, ok = table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 5
    d = line.select(
        F.col("l_suppkey").alias("judge"), F.col("l_orderkey").alias("case_id"), F.when(ok & (F.col("l_returnflag") != "N"), F.col("l_returnflag")).alias("result"), F.when(F.col("l_returnflag") == "N", "ORDER_SWAP_DISAGREEMENT").alias("abstain_reason"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("gap"), ok.alias("both_valid"), (F.col("l_linenumber") % 3).alias("issues_abstained"), F.lit(3).alias("issues"),
    )
    r = reports.persona_report(d, 100, 0.52, 0.35, 0.05)
    return r.select("judge", "cases", "decided", *[F.round(c, 9).alias(c) if c in ("disagreement_rate", "issue_disagreement_rate", "gap_median") else F.col(c) for c in r.columns[3:]])


@query("""SELECT l_orderkey AS session_id, l_returnflag AS side, round(avg((3 * l_discount + l_tax) / 4), 9) AS score FROM lineitem GROUP BY ALL""")
def advocacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("side"), "l_discount", "l_tax")
    return reports.advocacy(line, {"l_discount": 3.0, "l_tax": 1.0}).select("session_id", "side", F.round("score", 9).alias("score"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""")
def numbered_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.number_events(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query(
    """WITH s AS (SELECT row_no AS fact_id, any_value(coalesce(array_to_string(list_filter(facts_texts, lambda x: x IS NOT NULL), ' '), '')) AS t, any_value(decision_date) AS d FROM precedents GROUP BY row_no),
    x AS (SELECT fact_id, t, CASE WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(d, '%Y-%m-%d')::DATE END AS x FROM s),
    p AS (SELECT fact_id, t, x, day(x)::VARCHAR AS d, month(x)::VARCHAR AS m, year(x)::VARCHAR AS y, substr(strftime(x, '%B'), 1, 3) AS w FROM x),
    a AS (SELECT fact_id, list(DISTINCT v) AS v FROM (SELECT fact_id, TRY_CAST(floor(TRY_CAST(replace(regexp_extract(m, '^([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DECIMAL(24,4)) * CASE WHEN lower(m) LIKE '%cr%' THEN 10000000 WHEN lower(m) LIKE '%la%' THEN 100000 ELSE 1 END) AS BIGINT) AS v
      FROM (SELECT fact_id, unnest(regexp_extract_all(t, '(?i)([0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:/-)?\\s*(?:crores?|cr\\b|lakhs?|lacs?)?)', 1)) AS m FROM s)) GROUP BY 1)
    SELECT fact_id, 'DATE_NOT_WRITTEN' AS problem FROM p WHERE x IS NOT NULL AND NOT regexp_matches(lower(t), lower('(?:^|[^0-9])0?' || d || '\\s*[./-]\\s*0?' || m || '\\s*[./-]\\s*' || y || '(?:[^0-9]|$)|(?:^|[^0-9])0?' || d || '(?:st|nd|rd|th)?\\s+(?:of\\s+)?' || w || '[a-z]*\\.?,?\\s+' || y || '|' || w || '[a-z]*\\.?\\s+0?' || d || '(?:st|nd|rd|th)?,?\\s+' || y || '|' || strftime(x, '%Y-%m-%d')))
    UNION ALL SELECT p.fact_id, 'AMOUNT_NOT_WRITTEN' FROM p LEFT JOIN a ON a.fact_id = p.fact_id WHERE NOT coalesce(list_contains(v, (p.fact_id % 400)::BIGINT), false)"""
)
def unwritten_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents whose decision date stands in none of their facts, in any form, and those whose number, as an amount, doesn't."""
    p = table(spark, sf_dir, "precedents").select("row_no", "decision_date", "facts_texts").distinct()
    s = p.groupBy(F.col("row_no").alias("fact_id")).agg(F.first(F.concat_ws(" ", "facts_texts")).alias("source_text"), F.first("decision_date").alias("d"))
    return checks.literal_problems(s.select("fact_id", "source_text", text.iso_date(F.col("d")).alias("day"), (F.col("fact_id") % 400).cast("double").alias("amount")))


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(party_name, '[^A-Za-z]+')) AS word FROM parties WHERE kind = 'PERSON'), s AS (SELECT doc_id, words, unnest(words) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-z]+') AS words FROM documents WHERE text IS NOT NULL))
    SELECT DISTINCT s.doc_id, s.word, list_position(s.words, s.word) - 1 AS first_at FROM s JOIN w ON w.word = s.word WHERE length(s.word) >= 4 AND regexp_matches(s.word, '^[A-Z]')"""
)
def residual_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of persons' names that still stand in a document, with their first place."""
    names = table(spark, sf_dir, "parties").filter("kind = 'PERSON'").select(F.col("party_name").alias("name")).distinct()
    return checks.residual_names(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"), names)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def event_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", checks.json_value(F.col("props"), "k").alias("k"))


@query(
    """WITH t AS (SELECT l_orderkey AS c, l_partkey AS s, l_returnflag AS p, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY ALL) SELECT c AS case_id, s AS statute_id, p AS parameter, n = 1 AS usable FROM t"""
)
def threshold_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return reports.threshold_agreement(line.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("statute_id"), F.col("l_returnflag").alias("parameter"), F.col("l_linestatus").alias("value")))


@query(
    """WITH a AS (SELECT DISTINCT statute_id, lower(trim(jurisdiction_type)) AS k FROM law_snapshots WHERE snapshot_no = (SELECT min(snapshot_no) FROM law_snapshots)), b AS (SELECT DISTINCT statute_id, lower(trim(jurisdiction_type)) AS k FROM law_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM law_snapshots)),
    j AS (SELECT coalesce(a.statute_id, b.statute_id) AS slot, coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'AGREED' WHEN a.k IS NOT NULL THEN 'PRIMARY_ONLY' ELSE 'SECONDARY_ONLY' END AS s FROM a FULL JOIN b ON a.statute_id = b.statute_id AND a.k = b.k),
    c AS (SELECT slot, count(DISTINCT s) = 2 AS clash FROM j WHERE s <> 'AGREED' GROUP BY slot)
    SELECT j.slot AS statute_id, key, CASE WHEN s <> 'AGREED' AND clash THEN 'DISAGREED' ELSE s END AS state FROM j LEFT JOIN c ON c.slot = j.slot WHERE key IS NOT NULL"""
)
def delivery_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each statute in the first and the last delivery: agreed, only in one, or disagreed."""
    s = table(spark, sf_dir, "law_snapshots").filter("jurisdiction_type is not null").select("snapshot_no", "statute_id", F.lower(F.trim("jurisdiction_type")).alias("key")).distinct()
    ends = F.broadcast(table(spark, sf_dir, "law_snapshots").agg(F.min("snapshot_no").alias("a"), F.max("snapshot_no").alias("b")))  # one row
    s = s.join(ends)
    return quality.agreement(s.filter("snapshot_no = a"), s.filter("snapshot_no = b"), "statute_id", "key")


@query()
def likely_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows of a precedent id whose ratio, facts and order are like those of a kept row by 0.9 (matching blocks, so without SQL)."""
    whole = text.title_key(F.concat_ws(" ", "ratio_text", "facts_texts", "final_order"))
    p = table(spark, sf_dir, "precedents").filter("precedent_id is not null").select("row_no", "precedent_id", whole.alias("text")).distinct()
    return checks.same_id_copies(p, "precedent_id", "row_no", "text", 0.9)
