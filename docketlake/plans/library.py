"""Queries of the engine's own operators over the project's tables, each beside its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import evaluation, memory, overlap, predicates, quality, references, resolve, runlog, sync, temporal, vector, voting
from docketlake.plans.session import table
from docketlake.plans.training import LAW_CONTENT

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Vectors

OK = "vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"
UNIT = f"SELECT DISTINCT vec_id, uid, section_no, decided, statutes, vec::DOUBLE[] AS vec FROM vectors WHERE {OK}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vectors").filter(vector.usable(F.col("vec"), 64)).dropDuplicates(["vec_id"])


@query(
    f"""WITH v AS ({UNIT}), q AS (SELECT * FROM v WHERE vec_id % 20 = 0 AND decided IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS uid, round(list_cosine_similarity(v.vec, q.vec), 9) AS score FROM q JOIN v ON v.decided < q.decided),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM s)
    SELECT query_id, uid, rank, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors decided strictly before, for every vector whose id is divisible by 20."""
    v = _vectors(spark, sf_dir)
    rows = v.select(F.col("vec_id").alias("uid"), "vec", "decided").filter("decided is not null")
    asks = v.filter((F.col("vec_id") % 20 == 0) & F.col("decided").isNotNull()).select(F.col("vec_id").alias("query_id"), "vec", "decided")
    return vector.top_k(rows, asks, 5, before=True).select("query_id", "uid", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH v AS ({UNIT}), q AS (SELECT uid AS query_id, section_no AS part, vec FROM v WHERE uid IN (SELECT precedent_uid FROM precedents WHERE row_no % 20 = 0)),
    b AS (SELECT query_id, part, v.uid, max(list_cosine_similarity(v.vec, q.vec)) AS best FROM v, q GROUP BY ALL),
    t AS (SELECT query_id, uid, round(sum(best), 9) AS score FROM b GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM t)
    SELECT query_id, uid, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def maxsim_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents of several vectors by the summed best section, for the sections of every precedent with a row whose number is divisible by 20."""
    v = _vectors(spark, sf_dir)
    asked = table(spark, sf_dir, "precedents").filter("row_no % 20 = 0").select(F.col("precedent_uid").alias("uid")).distinct()
    asks = v.join(asked, "uid", "left_semi").select(F.col("uid").alias("query_id"), F.col("section_no").alias("part"), "vec")
    return vector.max_sim(v.select("uid", "vec"), asks, 10).select("query_id", "uid", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH v AS (SELECT DISTINCT vec_id, uid, section_no, vec::DOUBLE[] AS vec FROM vectors WHERE {OK} AND uid IS NOT NULL),
    p AS (SELECT a.uid, a.section_no, a.vec_id, max(CASE WHEN b.section_no < a.section_no THEN list_cosine_similarity(a.vec, b.vec) END) AS best
      FROM v a JOIN v b ON a.uid = b.uid WHERE b.section_no < a.section_no GROUP BY ALL)
    SELECT uid, section_no, vec_id, round(best, 6) AS best, best >= 0.92 AS copied FROM p"""
)
def repetition_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section of a precedent against all earlier ones: the greatest similarity, and whether it is a copy."""
    v = _vectors(spark, sf_dir).filter("uid is not null")
    turns = v.select(F.col("uid").alias("session_id"), F.lit("").alias("side"), F.col("section_no").alias("turn"), "vec_id", "vec")
    out = vector.repetition(turns, 0.92, ["vec_id"])
    return out.select(F.col("session_id").alias("uid"), F.col("turn").alias("section_no"), "vec_id", F.round("best", 6).alias("best"), "copied")


LESSONS = f"SELECT DISTINCT lesson_no, status, party_status, error_code, vec::DOUBLE[] AS vec FROM lessons WHERE {OK}"


@query(
    f"""WITH l AS (SELECT *, coalesce(error_code, '') || '/' || coalesce(party_status, '') AS k FROM ({LESSONS}) WHERE status = 'ACTIVE' AND error_code IS NOT NULL AND party_status IS NOT NULL),
    p AS (SELECT a.lesson_no, b.lesson_no AS m, round(list_cosine_similarity(a.vec, b.vec), 9) AS s FROM l a JOIN l b ON a.k = b.k AND a.lesson_no <> b.lesson_no WHERE list_cosine_similarity(a.vec, b.vec) >= 0.8999999),
    r AS (SELECT *, row_number() OVER (PARTITION BY lesson_no ORDER BY s DESC, m) AS rn FROM p WHERE s >= 0.9)
    SELECT l.lesson_no AS lesson_id, CASE WHEN r.m IS NULL THEN 'insert' ELSE 'merge' END AS action, r.m AS match_id, round(r.s, 6) AS similarity
    FROM l LEFT JOIN r ON l.lesson_no = r.lesson_no AND r.rn = 1"""
)
def lesson_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each active lesson against the others of its error code and party status: merge at 0.90 or more, else insert."""
    lessons = table(spark, sf_dir, "lessons").filter(vector.usable(F.col("vec"), 64)).dropDuplicates(["lesson_no"])
    active = lessons.filter("status = 'ACTIVE' and error_code is not null and party_status is not null")
    keyed = active.select(F.col("lesson_no").alias("lesson_id"), F.concat_ws("/", "error_code", "party_status").alias("key"), "vec")
    return vector.placement(keyed, keyed, 0.9).withColumn("similarity", F.round("similarity", 6))


# Dated rules

HELD = "SELECT DISTINCT rec_no, upper(trim(statute_id)) AS key, loaded_at AS start, removed_at AS stop FROM law WHERE statute_id IS NOT NULL"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = table(spark, sf_dir, "law").filter("statute_id is not null")
    return law.select("rec_no", references.normal_id(F.col("statute_id")).alias("key"), F.col("loaded_at").alias("start"), F.col("removed_at").alias("end")).distinct()


@query(
    f"""WITH r AS ({HELD}), a AS (SELECT DISTINCT analysis_id AS ask_id, upper(trim(statute_id)) AS key, recorded_at AS t FROM statutory_analysis WHERE statute_id IS NOT NULL),
    j AS (SELECT ask_id, count(DISTINCT CASE WHEN start <= t AND (stop IS NULL OR t < stop) THEN rec_no END) AS n, max(CASE WHEN start <= t AND (stop IS NULL OR t < stop) THEN rec_no END) AS rec_no, count(rec_no) AS known
      FROM a LEFT JOIN r ON a.key = r.key GROUP BY ask_id)
    SELECT ask_id, CASE WHEN n > 1 THEN 'CONFLICT' WHEN n = 1 THEN 'CONFIRMED' WHEN known > 0 THEN 'HIDDEN' ELSE 'UNVERIFIED' END AS status, CASE WHEN n = 1 THEN rec_no END AS rec_no FROM j"""
)
def asof_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law record that held when each analysis was recorded, with CONFIRMED, CONFLICT, HIDDEN or UNVERIFIED."""
    asked = table(spark, sf_dir, "statutory_analysis").filter("statute_id is not null").select(F.col("analysis_id").alias("ask_id"), references.normal_id(F.col("statute_id")).alias("key"), F.col("recorded_at").alias("at")).distinct()
    return temporal.records_as_of(asked, _held(spark, sf_dir))


@query(
    f"""WITH r AS ({HELD}), w AS (SELECT *, max(coalesce(stop, TIMESTAMP '9999-12-31')) OVER (PARTITION BY key ORDER BY start, rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM r)
    SELECT rec_no, key, start, until FROM w WHERE until > start"""
)
def overlay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law records that begin while an earlier record of their statute still holds."""
    return temporal.overlapping(_held(spark, sf_dir))


@query(
    """WITH c AS (SELECT o_orderkey AS case_id, o_orderdate AS decided, o_custkey AS dispute FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY decided DESC, case_id DESC) AS rn FROM c),
    g AS (SELECT dispute, max(CASE WHEN rn <= 100 THEN 2 WHEN rn <= 300 THEN 1 ELSE 0 END) AS l FROM r GROUP BY dispute)
    SELECT case_id, CASE l WHEN 2 THEN 'TEST' WHEN 1 THEN 'VALIDATION' ELSE 'TRAIN' END AS split FROM c JOIN g USING (dispute)"""
)
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("decided"), F.col("o_custkey").alias("dispute"))
    return temporal.split_assignment(orders, 100, 200)


_LIMITS = """WITH k AS (SELECT l_orderkey AS c, list_sort(list(DISTINCT l_shipdate::DATE)) AS acks FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS c, o_orderdate::DATE AS d, coalesce(acks, []) AS acks, (o_orderkey % 3 + 1)::INT AS y,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE DATE '1997-03-15' END AS f, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE DATE '1998-02-28' END AS t, CASE WHEN o_orderpriority = '1-URGENT' THEN 90 END AS m FROM orders LEFT JOIN k ON k.c = o_orderkey),
    z AS (SELECT *, (d + to_months(12 * y))::DATE AS one, coalesce(len(list_filter(acks, lambda x: x BETWEEN f AND t)) > 0, false) AS review FROM o),
    w AS (SELECT *, list_reduce(list_prepend(one, acks), lambda e, x: CASE WHEN x <= e THEN greatest(e, (x + to_months(12 * y))::DATE) ELSE e END) AS e FROM z),
    x AS (SELECT c AS case_id, review AS needs_review, CASE WHEN review THEN one WHEN f IS NOT NULL AND d <= t AND e >= f THEN t + 1 + greatest(e - greatest(d, f), coalesce(m, 0))::INT ELSE e END AS expiry FROM w)
"""


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as debts: the ship dates of their lines are acknowledgments, and a window without courts is excluded for all but pending ones."""
    acks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_set(F.col("l_shipdate").cast("date"))).alias("acks"))
    day = lambda d: F.when(F.col("o_orderstatus") != "P", F.lit(d).cast("date"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("default_day"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("period_years"),
        F.struct(day("1997-03-15").alias("from"), day("1998-02-28").alias("to")).alias("excluded"), F.when(F.col("o_orderpriority") == "1-URGENT", 90).alias("minimum_days"),
    )
    return orders.join(acks, "case_id", "left")


@query(_LIMITS + "SELECT case_id, needs_review, expiry::VARCHAR AS expiry FROM x")
def limitation_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each order's period runs out, with acknowledgments, an excluded window and a least balance."""
    return temporal.limitation_expiry(_limits(spark, sf_dir)).select("case_id", "needs_review", F.col("expiry").cast("string").alias("expiry"))


@query(
    _LIMITS
    + """SELECT case_id, CASE WHEN needs_review THEN 'UNMAPPED' ELSE 'INCONSISTENT' END AS problem, expiry::VARCHAR AS expiry FROM x JOIN orders ON o_orderkey = case_id
    WHERE needs_review OR (o_orderdate::DATE + (700 + o_custkey % 900)::INT <= expiry) <> (o_orderstatus = 'F')"""
)
def limitation_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose state F claims that they were filed in time, against the dates."""
    l = _limits(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("asserts_within"), F.date_add(F.col("o_orderdate").cast("date"), (700 + F.col("o_custkey") % 900).cast("int")).alias("filed"))
    stated = l.select("case_id", F.lit(1).alias("turn"), F.col("case_id").cast("string").alias("statute_id"), F.lit(0).alias("ord"), "acks").join(orders, "case_id").drop("filed")
    dates = l.select("case_id", F.lit("DEFAULT").alias("label"), F.col("default_day").alias("day")).unionByName(orders.select("case_id", F.lit("FILED").alias("label"), F.col("filed").alias("day")))
    rules = l.select(F.col("case_id").cast("string").alias("statute_id"), "period_years", "excluded", "minimum_days")
    return temporal.limitation_conclusions(stated, dates, rules, "DEFAULT", "FILED").select("case_id", "problem", F.col("expiry").cast("string").alias("expiry"))


@query(
    """WITH l AS (SELECT DISTINCT lesson_no, severity, frequency, confidence, last_seq FROM lessons), m AS (SELECT max(last_seq) AS now FROM l),
    w AS (SELECT lesson_no, severity * ln(1 + frequency) * confidence * pow(0.98, greatest(0, now - coalesce(last_seq, now))) AS weight FROM l, m)
    SELECT lesson_no, round(weight, 6) AS weight FROM w"""
)
def lesson_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, frequency and confidence of each lesson, decayed by the cases since its last use."""
    lessons = table(spark, sf_dir, "lessons").select("lesson_no", "severity", "frequency", "confidence", "last_seq").distinct()
    now = lessons.agg(F.max("last_seq").alias("now"))
    weight = temporal.lesson_weight(F.col("severity"), F.col("frequency"), F.col("confidence"), 0.98, F.col("now"), F.col("last_seq"))
    return lessons.join(F.broadcast(now)).select("lesson_no", F.round(weight, 6).alias("weight"))  # now is one row


@query(
    """WITH l AS (SELECT DISTINCT lesson_no, confidence, last_reward FROM lessons),
    s AS (SELECT *, CASE WHEN isnan(last_reward) OR last_reward IS NULL THEN confidence WHEN 0.5 > last_reward THEN confidence + 0.05 ELSE confidence - 0.05 END AS c FROM l)
    SELECT lesson_no, round(least(greatest(c, 0), 1), 6) AS confidence, least(greatest(c, 0), 1) < 0.2 AS retired FROM s"""
)
def confidence_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lesson's confidence after a reward of 0.5, and whether it retires."""
    lessons = table(spark, sf_dir, "lessons").select("lesson_no", "confidence", "last_reward").distinct()
    new, retired = temporal.confidence_step(F.col("confidence"), F.col("last_reward"), F.lit(0.5))
    return lessons.select("lesson_no", F.round(new, 6).alias("confidence"), retired.alias("retired"))


# Text

DOCS = "documents WHERE text IS NOT NULL"


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)([0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:/-)?\\s*(?:crores?|cr\\b|lakhs?|lacs?)?)', 1)) AS m FROM {DOCS}),
    v AS (SELECT doc_id, TRY_CAST(floor(TRY_CAST(replace(regexp_extract(m, '^([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DECIMAL(24,4)) * CASE WHEN lower(m) LIKE '%cr%' THEN 10000000 WHEN lower(m) LIKE '%la%' THEN 100000 ELSE 1 END) AS BIGINT) AS v FROM m)
    SELECT doc_id, array_to_string(list_sort(list(DISTINCT v)), ',') AS amounts FROM v WHERE v IS NOT NULL GROUP BY doc_id""")
def amounts_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.amounts(F.col("text")).alias("x"))
    return docs.filter("size(x) > 0").select("doc_id", F.array_join(F.col("x").cast("array<string>"), ",").alias("amounts"))


_MONTHS = "|".join(T.MONTHS)
_MONTH_NO = "list_position([" + ", ".join(f"'{m}'" for m in T.MONTHS) + f"], regexp_extract(m, '({_MONTHS})', 1))::VARCHAR"
_DAY = "TRY_CAST(regexp_extract(m, '([0-9]{{4}})$', 1) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


@query(f"""WITH d AS (SELECT doc_id, list_concat(list_concat(
      list_transform(regexp_extract_all(lower(text), '\\b[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}\\b'), lambda m: {_DAY.format(m="regexp_extract(m, '^[0-9]+[./-]([0-9]+)', 1)", d="regexp_extract(m, '^([0-9]+)', 1)")}),
      list_transform(regexp_extract_all(lower(text), '\\b[0-9]{{1,2}}(?:st|nd|rd|th)?\\s+(?:day\\s+of\\s+)?(?:{_MONTHS}),?\\s+[0-9]{{4}}\\b'), lambda m: {_DAY.format(m=_MONTH_NO, d="regexp_extract(m, '^([0-9]+)', 1)")})),
      list_transform(regexp_extract_all(lower(text), '\\b(?:{_MONTHS})\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+[0-9]{{4}}\\b'), lambda m: {_DAY.format(m=_MONTH_NO, d="regexp_extract(m, '^[a-z]+[ \\s]+([0-9]+)', 1)")})) AS ds FROM {DOCS})
    SELECT doc_id, array_to_string(x::VARCHAR[], ',') AS dates FROM (SELECT doc_id, list_sort(list_distinct(list_filter(ds, lambda z: z IS NOT NULL))) AS x FROM d) WHERE len(x) > 0""")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.dates(F.col("text")).alias("x"))
    return docs.filter("size(x) > 0").select("doc_id", F.array_join(F.col("x").cast("array<string>"), ",").alias("dates"))


@query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?'), lambda m: replace(m, ',', '')), ' ') AS numbers, CASE WHEN contains(lower(text), 'appeal') THEN 'Appeal' WHEN contains(lower(text), 'petition') THEN 'petition' END AS marker FROM {DOCS}""")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in digits and the first configured marker of each document."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    c = F.col("text")
    return docs.select("doc_id", F.array_join(T.numbers(c), " ").alias("numbers"), T.first_marker(c, ["Appeal", "petition"]).alias("marker"))


@query("""SELECT DISTINCT row_no, trim(regexp_replace(lower(case_title), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM precedents WHERE case_title IS NOT NULL""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole title of each precedent, normalised."""
    return table(spark, sf_dir, "precedents").filter("case_title is not null").select("row_no", T.title_key(F.col("case_title")).alias("title_key")).distinct()


@query("""SELECT DISTINCT row_no, CASE WHEN regexp_matches(decision_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN strftime(try_strptime(decision_date, '%Y-%m-%d'), '%Y-%m-%d') END AS decided FROM precedents""")
def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "precedents").select("row_no", T.iso_date(F.col("decision_date")).cast("string").alias("decided")).distinct()


@query(f"""WITH t AS (SELECT DISTINCT doc_id, text FROM {DOCS}), m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?i)\\bNos?\\.?\\s*[0-9]{{1,6}}\\s*(?:of|/)\\s*(?:19|20)[0-9]{{2}}\\b'),
      regexp_extract_all(text, '(?:^|[^0-9/])([0-9]{{1,6}}\\s*/\\s*(?:19|20)[0-9]{{2}})\\b', 1))) AS m FROM t),
    n AS (SELECT DISTINCT doc_id, CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END || '/' || y AS n FROM (SELECT doc_id, regexp_extract(m, '([0-9]{{1,6}})\\s*(?:[oO][fF]|/)', 1) AS x, regexp_extract(m, '([0-9]{{4}})$', 1) AS y FROM m))
    SELECT doc_id, array_to_string(list_sort(list(n)), ' ') AS numbers FROM n GROUP BY doc_id""")
def appeal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of appeals and petitions in each document."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.appeal_numbers(F.col("text")).alias("n"))
    return docs.filter("size(n) > 0").select("doc_id", F.array_join("n", " ").alias("numbers"))


_NUMBERED = "regexp_replace(ratio_text, '([A-Z]{4,}(?: [A-Z]+)*):', '7. \\1:', 'g')"
_PARTS = f"""WITH t AS (SELECT DISTINCT row_no, regexp_replace({_NUMBERED}, 'STATUTORY INTERPRETATION', 'PARTY IDENTITIES', 'g') AS t FROM precedents WHERE ratio_text IS NOT NULL),
    s AS (SELECT row_no, t, regexp_extract_all(t, '(?:^|\\s)[0-9]+\\.\\s+([A-Z][A-Z /&-]*[A-Z]):\\s*', 1) AS k, list_transform(string_split_regex(t, '(?:^|\\s)[0-9]+\\.\\s+[A-Z][A-Z /&-]*[A-Z]:\\s*')[2:], lambda x: trim(x)) AS v FROM t),
    p AS (SELECT row_no, t, k, list_transform(range(1, len(k) + 1), lambda i: struct_pack(l := k[i], t := v[i])) AS p FROM s)
"""


@query(
    _PARTS
    + """SELECT row_no, array_to_string(list_transform(list_filter(p, lambda x: x.l <> 'PARTY IDENTITIES' AND x.t <> ''), lambda x: x.l || ': ' || x.t), chr(10)) AS facts,
    array_to_string(list_transform(list_filter(p[1:3], lambda x: x.t <> ''), lambda x: x.l || ': ' || x.t), chr(10)) AS parts, array_to_string(list_transform(p[1:3], lambda x: x.l || ': ' || x.t), ' ') AS passage,
    coalesce(list_transform(list_filter(p[1:3], lambda x: x.t <> ''), lambda x: x.l || ': ' || x.t)[1], '') AS core FROM p WHERE len(k) > 0
    UNION ALL SELECT row_no, trim(t), trim(t), trim(t), trim(t) FROM p WHERE len(k) = 0"""
)
def ratio_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled parts of ratio texts as facts, as ratio parts, as one passage and the core rule. The tables have labels
    without numbers, so numbers are put before them, and one label stands for the one that is left out."""
    numbered = F.regexp_replace(F.regexp_replace("ratio_text", r"([A-Z]{4,}(?: [A-Z]+)*):", "7. $1:"), "STATUTORY INTERPRETATION", "PARTY IDENTITIES")
    rows = table(spark, sf_dir, "precedents").filter("ratio_text is not null").select("row_no", numbered.alias("t")).distinct()
    c = F.col("t")
    return rows.select("row_no", F.array_join(T.facts_sections(c), "\n").alias("facts"), F.array_join(T.ratio_parts(c), "\n").alias("parts"), T.ratio_passage(c).alias("passage"), T.core_rule(c).alias("core"))


@query()
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of six words or more, and greedy windows of 400 signs, of each document (look-behind, so without SQL)."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.size(T.sentences_protected(F.col("text"))).alias("n_protected"), F.size(T.token_windows(F.col("text"), 400)).alias("n_windows"))


@query("""SELECT row_no, precedent_uid, precedent_id || '#' || substr(sha256(regexp_replace(lower(case_title), '[^a-z0-9]+', '', 'g') || '|' || coalesce(decision_date, '')), 1, 12) AS computed FROM (SELECT DISTINCT row_no, precedent_uid, precedent_id, case_title, decision_date FROM precedents)""")
def precedent_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "precedents").select("row_no", "precedent_uid", "precedent_id", "case_title", "decision_date").distinct()
    return rows.select("row_no", "precedent_uid", sync.precedent_uid(F.col("precedent_id"), F.col("case_title"), F.col("decision_date")).alias("computed"))


# Overlap

GRAM = "list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))"
WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(
    f"""WITH v AS (SELECT DISTINCT key, unnest({GRAM.format(n=6)}) AS g FROM (SELECT case_id AS key, {WORDS} AS w FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL)),
    k AS (SELECT DISTINCT key, unnest({GRAM.format(n=6)}) AS g FROM (SELECT case_id AS key, {WORDS} AS w FROM (SELECT case_id, unnest(facts_texts) AS text FROM precedents) WHERE case_id IS NOT NULL AND text IS NOT NULL)),
    s AS (SELECT DISTINCT key, source_id, unnest({GRAM.format(n=6)}) AS g FROM (SELECT case_id AS key, analysis_id AS source_id, {WORDS} AS w FROM (SELECT case_id, analysis_id, interpretation AS text FROM statutory_analysis WHERE case_id IS NOT NULL AND interpretation IS NOT NULL)))
    SELECT key, source_id, count(*) AS n_leaked FROM s SEMI JOIN v USING (key, g) ANTI JOIN k USING (key, g) GROUP BY ALL"""
)
def leakage_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-word runs of an analysis that stand in a document of its case and not in the facts of its precedents."""
    views = table(spark, sf_dir, "documents").select(F.col("case_id").alias("key"), "text")
    visible = table(spark, sf_dir, "precedents").select(F.col("case_id").alias("key"), F.explode("facts_texts").alias("text"))
    sealed = table(spark, sf_dir, "statutory_analysis").select(F.col("case_id").alias("key"), F.col("analysis_id").alias("source_id"), F.col("interpretation").alias("text"))
    return overlap.leakage(views, sealed, visible, 6)


TRADES = "steels papers shipping foods power realty agro infra polymers minerals motors textiles chemicals logistics pharma ceramics cables seeds".split()
_GENERIC = (*overlap.GENERIC, *TRADES)
_GEN = ", ".join(f"'{w}'" for w in _GENERIC)
_DIST = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN (" + _GEN + ")))"


@query(
    f"""WITH t AS (SELECT DISTINCT row_no AS title_id, list_distinct(list_filter(regexp_split_to_array(lower(case_title), '[^a-z0-9]+'), lambda w: w <> '')) AS t,
      regexp_extract(appeal_number, 'No\\. ([0-9]+) of', 1) || '/' || regexp_extract(appeal_number, 'of ([0-9]{{4}})', 1) AS number FROM precedents WHERE case_title IS NOT NULL),
    n AS (SELECT DISTINCT case_id || '/' || ord AS name_id, kind, cause_title_role AS role, {_DIST.format(c='party_name')} AS n, coalesce(variants, []) AS variants FROM parties WHERE party_name IS NOT NULL),
    f AS (SELECT *, list_prepend(n, list_transform(variants, lambda v: {_DIST.format(c='v')})) AS forms FROM n),
    m AS (SELECT DISTINCT name_id, x AS must, x AS every, len(x) AS needed FROM (SELECT name_id, unnest(forms) AS x FROM f WHERE kind = 'PERSON' AND role IS NOT NULL) WHERE len(x) >= 2
      UNION SELECT DISTINCT name_id, n[1:1], list_distinct(flatten(forms)), 2 FROM f WHERE kind NOT IN ('PERSON', 'BANK', 'AUTHORITY') AND len(n) > 0),
    j AS (SELECT title_id, name_id, max(len(list_intersect(t, every))) AS n_shared FROM (SELECT *, unnest(must) AS w FROM m WHERE len(must) > 0) m JOIN (SELECT title_id, t, unnest(t) AS w FROM t) t ON t.w = m.w
      WHERE list_has_all(t, must) AND len(list_intersect(t, every)) >= needed GROUP BY ALL),
    c AS (SELECT DISTINCT p.case_id || '/' || p.ord AS name_id, regexp_extract(d.appeal_number, 'No\\. ([0-9]+) of', 1) || '/' || regexp_extract(d.appeal_number, 'of ([0-9]{{4}})', 1) AS number FROM parties p JOIN precedents d ON d.case_id = p.case_id WHERE p.party_name IS NOT NULL),
    b AS (SELECT title_id, f.name_id, max(len(list_intersect(t, list_distinct(flatten(forms))))) AS n_shared FROM t JOIN c USING (number) JOIN f ON f.name_id = c.name_id WHERE len(list_intersect(t, list_distinct(flatten(forms)))) > 0 AND number <> '/' GROUP BY ALL)
    SELECT *, 'NAME' AS reason FROM j UNION ALL SELECT *, 'NUMBER' FROM b ANTI JOIN j USING (title_id, name_id)"""
)
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents that seem to concern the same dispute as a party: by its name in the title, or by a number and a word."""
    number = F.concat(F.regexp_extract("appeal_number", r"No\. ([0-9]+) of", 1), F.lit("/"), F.regexp_extract("appeal_number", "of ([0-9]{4})", 1))
    p = table(spark, sf_dir, "precedents").withColumn("numbers", F.filter(F.array(number), lambda x: x != "/"))
    titles = p.select(F.col("row_no").alias("title_id"), F.col("case_title").alias("text"), "numbers").filter("text is not null").distinct()
    q = table(spark, sf_dir, "parties").filter("party_name is not null").withColumn("name_id", F.concat("case_id", F.lit("/"), F.col("ord").cast("string")))
    names = q.select("name_id", F.col("party_name").alias("text"), "variants", "kind", F.col("cause_title_role").alias("role")).distinct()
    numbers = q.select("name_id", "case_id").join(p.select("case_id", F.explode("numbers").alias("number")), "case_id").select("name_id", "number").distinct()
    return overlap.shared_names(titles, names, 2, _GENERIC, numbers)


@query(
    """WITH l AS (SELECT doc_id, row_number() OVER () AS x, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)),
    k AS (SELECT DISTINCT doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS pattern FROM l WHERE line <> '')
    SELECT pattern, count(*) AS n_docs FROM k GROUP BY pattern HAVING count(*) >= 5"""
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand, digits aside, in five documents or more."""
    lines = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    pattern = F.regexp_replace(F.trim("line"), "[0-9]+", "#")
    return lines.select("doc_id", pattern.alias("pattern")).filter("pattern <> ''").distinct().groupBy("pattern").agg(F.count("*").alias("n_docs")).filter("n_docs >= 5")


# References and resolution


@query(
    """WITH r AS (SELECT rec_no, pos, id FROM (SELECT rec_no, unnest(intersecting_statute_ids) AS id, generate_subscripts(intersecting_statute_ids, 1) AS pos FROM law) WHERE id IS NOT NULL AND id IN (SELECT statute_id FROM law)),
    f AS (SELECT rec_no, id, min(pos) AS pos FROM r GROUP BY rec_no, id)
    SELECT rec_no, list(id ORDER BY pos, id) AS related FROM f GROUP BY rec_no"""
)
def related_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.related(table(spark, sf_dir, "law"))


@query(
    """WITH n AS (SELECT id AS missing_id, count(*) AS n_rows FROM (SELECT unnest(statutes_cited) AS id FROM precedents) WHERE id IS NOT NULL GROUP BY id)
    SELECT * FROM n WHERE missing_id NOT IN (SELECT statute_id FROM law WHERE statute_id IS NOT NULL)"""
)
def dangling_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes that precedents cite, as they stand, and the law never held."""
    cited = table(spark, sf_dir, "precedents").select(F.explode("statutes_cited").alias("id"))
    return quality.dangling(cited, table(spark, sf_dir, "law"), "id", "statute_id")


_FORMS = """WITH c AS (SELECT DISTINCT x AS citation FROM (SELECT unnest(statutes_cited) AS x FROM precedents) WHERE x IS NOT NULL),
    k AS (SELECT DISTINCT statute_id AS id FROM law WHERE statute_id IS NOT NULL),
    n AS (SELECT citation, regexp_replace(upper(trim(citation)), '[\\s.-]+', '_', 'g') AS normal FROM c),
    t AS (SELECT citation, 0 AS rank, 'exact' AS rule, citation AS id FROM n
      UNION ALL SELECT citation, 1, 'bracket', regexp_replace(regexp_replace(citation, '\\)\\(|\\(', '_', 'g'), '\\)', '', 'g') FROM n
      UNION ALL SELECT citation, 2, 'stripped', regexp_replace(citation, '\\([^)]*\\)', '', 'g') FROM n
      UNION ALL SELECT citation, 10, 'prefix', array_to_string(list_slice(string_split(citation, '_'), 1, i), '_') FROM n, range(2, 12) r(i) WHERE i <= len(string_split(citation, '_'))
      UNION ALL SELECT citation, 20, 'normal_exact', normal FROM n
      UNION ALL SELECT citation, 21, 'normal_bracket', regexp_replace(regexp_replace(normal, '\\)\\(|\\(', '_', 'g'), '\\)', '', 'g') FROM n
      UNION ALL SELECT citation, 22, 'normal_stripped', regexp_replace(normal, '\\([^)]*\\)', '', 'g') FROM n),
    h AS (SELECT t.citation, t.rank, t.rule, k.id FROM t JOIN k ON k.id = t.id),
    s AS (SELECT c.citation, min(k.id) AS id, count(*) AS n FROM c JOIN k ON string_split(k.id, '_')[-1] = string_split(c.citation, '_')[-1] AND k.id <> c.citation
      AND len(list_filter(string_split(c.citation, '_'), lambda x: NOT list_contains(string_split(k.id, '_'), x))) = 0 AND len(string_split(c.citation, '_')) > 1 GROUP BY c.citation HAVING count(*) = 1),
    a AS (SELECT * FROM h UNION ALL SELECT citation, 11, 'spelling', id FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY citation ORDER BY rank, len(id) DESC) AS rn FROM a),
    f AS (SELECT c.citation, b.id AS statute_id, b.rule FROM c LEFT JOIN b ON b.citation = c.citation AND b.rn = 1)
"""


@query(_FORMS + "SELECT * FROM f")
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct citation of a precedent with the law id it resolves to and the rule that found it."""
    cited = table(spark, sf_dir, "precedents").select(F.explode("statutes_cited").alias("citation"))
    return resolve.resolve(cited, table(spark, sf_dir, "law"))


@query(_FORMS + "SELECT coalesce(rule, 'unresolved') AS rule, count(*) AS n FROM f GROUP BY ALL")
def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_citations(spark, sf_dir).groupBy(F.coalesce("rule", F.lit("unresolved")).alias("rule")).agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT case_id AS k, x AS a FROM (SELECT case_id, unnest(statutes_cited) AS x FROM precedents) WHERE case_id IS NOT NULL AND x IS NOT NULL),
    b AS (SELECT DISTINCT case_id AS k, statute_id AS b FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IS NOT NULL)
    SELECT a.k AS case_id, a, b FROM a JOIN b ON a.k = b.k AND (a = b OR starts_with(a, b || '_') OR starts_with(b, a || '_'))"""
)
def statute_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes cited by a case's precedents and analysed in it: equal, or one within the other."""
    a = table(spark, sf_dir, "precedents").select("case_id", F.explode("statutes_cited").alias("a")).filter("case_id is not null and a is not null").distinct()
    b = table(spark, sf_dir, "statutory_analysis").select("case_id", F.col("statute_id").alias("b")).filter("case_id is not null and b is not null").distinct()
    return resolve.contained(a, b, "case_id")


@query(
    """WITH f AS (SELECT DISTINCT case_id, statute_id FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IS NOT NULL),
    r AS (SELECT DISTINCT case_id, x AS statute_id FROM (SELECT case_id, unnest(statutes_cited) AS x FROM precedents) WHERE case_id IS NOT NULL AND x IS NOT NULL),
    j AS (SELECT coalesce(f.case_id, r.case_id) AS case_id, f.statute_id AS f, r.statute_id AS r FROM f FULL JOIN r ON f.case_id = r.case_id AND f.statute_id = r.statute_id)
    SELECT case_id, round(count(CASE WHEN f = r THEN 1 END) / nullif(count(f), 0), 9) AS precision, round(count(CASE WHEN f = r THEN 1 END) / nullif(count(r), 0), 9) AS recall FROM j GROUP BY case_id"""
)
def citation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the statutes analysed in a case against those its precedents cite."""
    found = table(spark, sf_dir, "statutory_analysis").filter("case_id is not null and statute_id is not null")
    real = table(spark, sf_dir, "precedents").filter("case_id is not null").select("case_id", F.explode("statutes_cited").alias("statute_id")).filter("statute_id is not null")
    return evaluation.set_precision_recall(found, real, "case_id", "statute_id").select("case_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


# Synchronisation and quality

#: References and codes are derived fields: a change of these alone needs no new embedding.
LAW_DERIVED = ("intersecting_statute_ids", "audit_error_codes")
LAW_TEXT = tuple(c for c in LAW_CONTENT if c not in LAW_DERIVED)


@query(
    """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, statute_id ORDER BY received_at DESC) AS rn FROM law_snapshots WHERE statute_id IS NOT NULL) WHERE rn = 1),
    m AS (SELECT min(snapshot_no) AS a, max(snapshot_no) AS b FROM law_snapshots),
    o AS (SELECT s.* FROM s, m WHERE snapshot_no = a), n AS (SELECT s.* FROM s, m WHERE snapshot_no = b)
    SELECT coalesce(o.statute_id, n.statute_id) AS statute_id, CASE WHEN o.statute_id IS NULL THEN 'insert' WHEN n.statute_id IS NULL THEN 'remove'
      WHEN """ + " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in LAW_TEXT) + """ THEN 'update' WHEN """ + " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in LAW_DERIVED) + """ THEN 'refresh' ELSE 'unchanged' END AS action
    FROM o FULL JOIN n ON o.statute_id = n.statute_id"""
)
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do to bring the first law delivery to the last, by all content columns, the derived ones apart."""
    rows = table(spark, sf_dir, "law_snapshots")
    hashed = rows.filter("statute_id is not null").select("snapshot_no", "statute_id", sync.content_hash(*LAW_TEXT).alias("content_hash"), sync.content_hash(*LAW_DERIVED).alias("derived_hash"), "received_at")
    last = hashed.groupBy("snapshot_no", "statute_id").agg(F.max(F.struct("received_at", "content_hash", "derived_hash")).alias("x")).select("snapshot_no", "statute_id", "x.content_hash", "x.derived_hash")
    ends = F.broadcast(rows.agg(F.min("snapshot_no").alias("a"), F.max("snapshot_no").alias("b")))  # one row
    return sync.incremental_sync(last.join(ends).filter("snapshot_no = a"), last.join(ends).filter("snapshot_no = b"), "statute_id")


@query(
    """WITH l AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '~')) AS h FROM documents),
    g4 AS (SELECT substr(md5(doc_id::VARCHAR), 1, 4) AS g, sha256(string_agg(doc_id::VARCHAR || ':' || h, chr(10) ORDER BY doc_id::VARCHAR || ':' || h)) AS h FROM l GROUP BY 1),
    g2 AS (SELECT substr(g, 1, 2) AS g, sha256(string_agg(g || ':' || h, chr(10) ORDER BY g || ':' || h)) AS h FROM g4 GROUP BY 1)
    SELECT sha256(string_agg(g || ':' || h, chr(10) ORDER BY g || ':' || h)) AS snapshot_hash FROM g2"""
)
def content_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all documents, whatever their order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("~")), 256).alias("h")).distinct()
    return sync.snapshot_hash(docs, "doc_id", "h")


@query("""SELECT md5(text) AS h, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("h"))
    return sync.duplicate_groups(docs, "h", "doc_id")


@query(
    """WITH r AS (SELECT DISTINCT row_no, precedent_uid, content_hash, ingested_at FROM precedents WHERE precedent_uid IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY precedent_uid ORDER BY ingested_at, row_no) AS rn FROM r)
    SELECT precedent_uid, count(*) AS n_rows, count(DISTINCT content_hash) AS n_contents, max(CASE WHEN rn = 1 THEN content_hash END) AS kept, count(DISTINCT content_hash) > 1 AS conflict FROM o GROUP BY precedent_uid HAVING count(*) > 1"""
)
def first_seen_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents ingested more than once: the first counts, unlike contents are a conflict."""
    rows = table(spark, sf_dir, "precedents").filter("precedent_uid is not null").select("row_no", "precedent_uid", "content_hash", "ingested_at").distinct()
    return sync.first_seen(rows, "precedent_uid", "content_hash", ["ingested_at", "row_no"])


@query(
    """WITH l AS (SELECT DISTINCT rec_no, statute_id, list_filter(coalesce(audit_error_codes, []), lambda c: c IS NOT NULL) AS c, list_filter(coalesce(intersecting_statute_ids, []), lambda c: c IS NOT NULL) AS r FROM law),
    p AS (SELECT rec_no, 'NO_CODES' AS rule, '' AS detail FROM l WHERE len(c) = 0
      UNION ALL SELECT rec_no, 'CODE_NOT_UPPER', array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x <> upper(x)))), ',') FROM l WHERE len(list_filter(c, lambda x: x <> upper(x))) > 0
      UNION ALL SELECT rec_no, 'REPEATED_CODE', (len(c) - len(list_distinct(c)))::VARCHAR FROM l WHERE len(list_distinct(c)) < len(c)
      UNION ALL SELECT rec_no, 'SELF_REFERENCE', statute_id FROM l WHERE list_contains(r, statute_id)
      UNION ALL SELECT rec_no, 'REPEATED_REFERENCE', (len(r) - len(list_distinct(r)))::VARCHAR FROM l WHERE len(list_distinct(r)) < len(r))
    SELECT 'law' AS table_name, rec_no::VARCHAR AS row_key, rule, detail FROM p"""
)
def law_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.law_hygiene(table(spark, sf_dir, "law").select("rec_no", "statute_id", "audit_error_codes", "intersecting_statute_ids").distinct())


@query(
    """WITH r AS (SELECT DISTINCT row_no, precedent_id, decision_date, forum, facts_texts, ratio_text FROM precedents),
    p AS (SELECT row_no, 'UNDATED' AS rule, coalesce(decision_date, '') AS detail FROM r WHERE decision_date IS NULL OR NOT regexp_matches(decision_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
      UNION ALL SELECT row_no, 'FORUM_NOT_UPPER', forum FROM r WHERE forum <> upper(forum)
      UNION ALL SELECT row_no, 'NO_FACTS', '' FROM r WHERE facts_texts IS NULL OR len(facts_texts) = 0
      UNION ALL SELECT row_no, 'NO_RATIO', '' FROM r WHERE ratio_text IS NULL OR trim(ratio_text) = ''
      UNION ALL SELECT row_no, 'BAD_ID', precedent_id FROM r WHERE NOT regexp_matches(precedent_id, '^[0-9]{4}_'))
    SELECT 'precedents' AS table_name, row_no::VARCHAR AS row_key, rule, detail FROM p"""
)
def precedent_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "precedents").select("row_no", "precedent_id", "decision_date", "forum", "facts_texts", "ratio_text").distinct()
    return quality.problems(
        rows, "precedents", "row_no",
        {
            "UNDATED": (F.col("decision_date").isNull() | ~F.col("decision_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.coalesce("decision_date", F.lit(""))),
            "FORUM_NOT_UPPER": (F.col("forum") != F.upper("forum"), F.col("forum")),
            "NO_FACTS": (F.col("facts_texts").isNull() | (F.size("facts_texts") == 0), F.lit("")),
            "NO_RATIO": (F.col("ratio_text").isNull() | (F.trim("ratio_text") == ""), F.lit("")),
            "BAD_ID": (~F.col("precedent_id").rlike("^[0-9]{4}_"), F.col("precedent_id")),
        },
    )


@query(
    """WITH n AS (SELECT doc_id, count(*) AS n FROM documents WHERE case_id IS NOT NULL GROUP BY doc_id), l AS (SELECT case_id, count(*) AS n FROM documents WHERE case_id IS NOT NULL AND doc_kind = 'order' GROUP BY case_id),
    e AS (SELECT DISTINCT case_id FROM parties WHERE case_id IS NOT NULL)
    SELECT coalesce(l.case_id, e.case_id) AS case_id, CASE WHEN e.case_id IS NULL THEN 'UNKNOWN' WHEN l.n IS NULL THEN 'MISSING' ELSE 'REPEATED' END AS problem FROM l FULL JOIN e ON l.case_id = e.case_id WHERE e.case_id IS NULL OR l.n IS NULL OR l.n > 1"""
)
def one_order_a_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the parties table with no order document or several, and orders of unknown cases."""
    orders = table(spark, sf_dir, "documents").filter("case_id is not null and doc_kind = 'order'")
    return quality.exactly_one(orders, table(spark, sf_dir, "parties").filter("case_id is not null"), "case_id")


@query(
    """WITH p AS (SELECT DISTINCT case_id, ord, cause_title_role AS r FROM parties WHERE cause_title_role IS NOT NULL)
    SELECT case_id, ord, list_sort(list(DISTINCT r)) AS roles FROM p GROUP BY case_id, ord HAVING count(DISTINCT r) > 1"""
)
def role_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a cause title with more than one role."""
    p = table(spark, sf_dir, "parties").filter("cause_title_role is not null")
    return quality.unlike(p, ["case_id", "ord"], "cause_title_role").withColumnRenamed("values", "roles")


# Evaluation

_OUTCOMES = "SELECT o_orderkey AS seq, o_custkey AS g, o_orderdate AS d, o_orderstatus AS truth, o_orderpriority AS p FROM orders"
_EXPANDING = f"""WITH o AS ({_OUTCOMES}),
    c AS (SELECT *, coalesce(sum((truth = 'F')::INT) OVER w, 0) AS f, coalesce(sum((truth = 'O')::INT) OVER w, 0) AS o2, coalesce(sum((truth = 'P')::INT) OVER w, 0) AS p2 FROM o
      WINDOW w AS (PARTITION BY g ORDER BY d, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT seq, truth, p, CASE WHEN greatest(f, o2, p2) = 0 OR (f = greatest(f, o2, p2))::INT + (o2 = greatest(f, o2, p2))::INT + (p2 = greatest(f, o2, p2))::INT > 1 THEN NULL
      WHEN f = greatest(f, o2, p2) THEN 'F' WHEN o2 = greatest(f, o2, p2) THEN 'O' ELSE 'P' END AS prediction FROM c)
"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("g"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("truth"), F.col("o_orderpriority").alias("p"))
    return evaluation.expanding_majority(o, ["F", "O", "P"], ["g"], ["d", "seq"], "truth")


@query(_EXPANDING + "SELECT seq, truth, prediction FROM e")
def expanding_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of a customer's earlier order states, as a baseline prediction of each order's state."""
    return _outcomes(spark, sf_dir).select("seq", "truth", "prediction")


@query(_EXPANDING + "SELECT p AS level, count(*) AS n, count(prediction) AS predicted, round(count(prediction) / count(*), 9) AS coverage, round(avg(CASE WHEN prediction IS NOT NULL THEN (prediction = truth)::INT END), 9) AS accuracy FROM e GROUP BY p")
def accuracy_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.accuracy(_outcomes(spark, sf_dir).withColumnRenamed("p", "level"), ["level"])
    return out.select("level", "n", "predicted", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query(
    _EXPANDING
    + """, r AS (SELECT p, truth, avg(coalesce((prediction = truth)::INT, 0)) AS recall FROM e GROUP BY p, truth),
    l AS (SELECT DISTINCT p, x AS label FROM e, (SELECT unnest(['F', 'O', 'P']) AS x)),
    f AS (SELECT l.p, l.label, coalesce(2.0 * (SELECT count(*) FROM e WHERE e.p = l.p AND truth = label AND prediction = label) / nullif((SELECT count(*) FROM e WHERE e.p = l.p AND truth = label) + (SELECT count(*) FROM e WHERE e.p = l.p AND prediction = label), 0), 0) AS f1 FROM l)
    SELECT p AS level, round(b, 9) AS balanced_accuracy, round(m, 9) AS macro_f1 FROM (SELECT p, avg(recall) AS b FROM r GROUP BY p) JOIN (SELECT p, avg(f1) AS m FROM f GROUP BY p) USING (p)"""
)
def balanced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).withColumnRenamed("p", "level")
    labels = spark.createDataFrame([("F",), ("O",), ("P",)], "label string")
    out = evaluation.balanced_accuracy(rows, ["level"]).join(evaluation.macro_f1(rows, labels, ["level"]), "level")
    return out.select("level", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(_EXPANDING + ", s AS (SELECT count(*) AS pairs, count(CASE WHEN prediction = truth AND truth <> 'O' THEN 1 END) AS only_a, count(CASE WHEN prediction <> truth AND truth = 'O' THEN 1 END) AS only_b FROM e WHERE prediction IS NOT NULL), q AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k FROM s) SELECT pairs, only_a, only_b, round(least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) * 2 FROM range(0, 1000000) r(i) WHERE i <= k)), 6) AS p FROM q")
def paired_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running majority against always answering O, over the orders both predict."""
    return evaluation.paired(_outcomes(spark, sf_dir).select("truth", F.col("prediction").alias("a"), F.lit("O").alias("b"))).select("pairs", "only_a", "only_b", F.round("p", 6).alias("p"))


@query(
    _EXPANDING + """, x AS (SELECT *, unnest(['ALL', 'URGENT', 'DECIDED']) AS subset FROM e)
    SELECT subset, count(*) AS n FROM x WHERE subset = 'ALL' OR (subset = 'URGENT' AND p = '1-URGENT') OR (subset = 'DECIDED' AND truth <> 'O') GROUP BY subset"""
)
def subset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping subsets of the outcomes, counted."""
    rows = evaluation.subsets(_outcomes(spark, sf_dir), {"ALL": F.lit(True), "URGENT": F.col("p") == "1-URGENT", "DECIDED": F.col("truth") != "O"})
    return rows.groupBy("subset").agg(F.count("*").alias("n"))


@query()
def bootstrap_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the mean confidence of lessons by type (seeded draws, so without SQL)."""
    lessons = table(spark, sf_dir, "lessons").select("lesson_no", "lesson_type", "confidence").distinct()
    return evaluation.bootstrap(lessons, ["lesson_type"], "confidence", ["lesson_no"], lambda v: sum(v) / len(v))


@query(
    """WITH n AS (SELECT forum, bench, final_order, count(*) AS n FROM (SELECT DISTINCT row_no, upper(forum) AS forum, bench, final_order FROM precedents) WHERE final_order IS NOT NULL GROUP BY ALL),
    m AS (SELECT forum, bench, max(n) AS n FROM n GROUP BY ALL)
    SELECT n.forum, n.bench, CASE WHEN count(*) = 1 THEN max(final_order) END AS majority FROM n JOIN m ON n.forum IS NOT DISTINCT FROM m.forum AND n.bench IS NOT DISTINCT FROM m.bench AND n.n = m.n GROUP BY ALL"""
)
def majority_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common final order of each bench; none on a tie."""
    rows = table(spark, sf_dir, "precedents").select("row_no", F.upper("forum").alias("forum"), "bench", "final_order").distinct()
    return evaluation.majority(rows, ["forum", "bench"], "final_order")


# Votes: orders as sessions, line items as judges' opinions, return flag as the side upheld

_VOTES = "SELECT l_orderkey AS session_id, l_suppkey AS judge, l_linenumber AS ord, l_linestatus = 'F' OR l_quantity > 5 AS valid, CASE WHEN l_returnflag = 'A' THEN 'P' ELSE 'R' END AS result, l_quantity AS score, l_discount AS accuracy FROM lineitem"
_FOLD = f"""WITH o AS ({_VOTES}), g AS (SELECT session_id, judge, bool_and(valid) AS ok, count(DISTINCT result) AS n, count(*) AS orders, min(result) AS r, avg(score) AS score, avg(accuracy) AS accuracy FROM o GROUP BY ALL),
    f AS (SELECT session_id, judge, CASE WHEN ok AND n = 1 THEN r END AS winner, CASE WHEN NOT ok THEN 'INVALID' WHEN n <> 1 THEN 'ORDER_SWAP_DISAGREEMENT' WHEN orders = 1 THEN 'ONE_ORDER' ELSE 'AGREED' END AS reason, score, accuracy FROM g),
    s AS (SELECT session_id, count(winner) AS total, count(*) FILTER (winner = 'P') AS p, count(*) FILTER (winner = 'R') AS r, round(avg(score) FILTER (winner = 'P'), 6) AS ps, round(avg(score) FILTER (winner = 'R'), 6) AS rs, round(avg(accuracy) FILTER (winner = 'P'), 6) AS pa, round(avg(accuracy) FILTER (winner = 'R'), 6) AS ra FROM f GROUP BY 1),
    v AS (SELECT session_id, CASE WHEN total < 2 THEN NULL WHEN p <> r THEN CASE WHEN p > r THEN 'P' ELSE 'R' END WHEN abs(ps - rs) >= 20 THEN CASE WHEN ps > rs THEN 'P' ELSE 'R' END WHEN abs(pa - ra) >= 20 THEN CASE WHEN pa > ra THEN 'P' ELSE 'R' END END AS winner,
      CASE WHEN total < 2 THEN 'UNSTABLE_TOO_FEW' WHEN p <> r THEN 'MAJORITY' WHEN abs(ps - rs) >= 20 THEN 'TIE_SCORE' WHEN abs(pa - ra) >= 20 THEN 'TIE_ACCURACY' ELSE 'UNBROKEN_TIE' END AS status FROM s)
"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    opinions = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("judge"), F.col("l_linenumber").alias("ord"), ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 5)).alias("valid"),
        F.when(F.col("l_returnflag") == "A", "P").otherwise("R").alias("result"), F.col("l_quantity").alias("score"), F.col("l_discount").alias("accuracy"),
    )
    return voting.fold_judges(opinions, ["score", "accuracy"])


@query(_FOLD + "SELECT session_id, judge, winner, reason FROM f")
def fold_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("session_id", "judge", "winner", "reason")


@query(_FOLD + "SELECT * FROM v")
def bench_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with a tie ladder: most votes, then the score, then the accuracy, ahead by twenty or more."""
    return voting.verdicts(_folded(spark, sf_dir), 2, 20)


@query(_FOLD + "SELECT coalesce(winner, 'UNSTABLE_' || status) AS key, count(*) AS n FROM v GROUP BY ALL")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.verdict_histogram(bench_verdicts(spark, sf_dir))


@query(
    """WITH n AS (SELECT l_orderkey AS s, l_returnflag AS i, l_linestatus AS u, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT s, i, sum(n) AS total, max(n) AS m, arg_max(u, n) AS u FROM n GROUP BY s, i)
    SELECT s AS session_id, i AS issue_id, CASE WHEN 2 * m > total AND total >= 2 THEN u END AS finding FROM t"""
)
def issue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return voting.issue_findings(line.select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("issue_id"), F.col("l_suppkey").alias("judge"), F.col("l_linestatus").alias("upholds")), 2)


@query("""SELECT o_orderkey::VARCHAR AS case_id, CASE WHEN ('0x' || substr(sha256(o_orderkey::VARCHAR), 64, 1))::INT % 2 = 0 THEN 'AB' ELSE 'BA' END AS first_order FROM orders""")
def order_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"))
    return orders.select("case_id", voting.single_order(F.col("case_id")).alias("first_order"))


# Memory


@query(
    """WITH l AS (SELECT DISTINCT lesson_no, party_status, severity, frequency, confidence, error_code FROM lessons WHERE status = 'ACTIVE'),
    r AS (SELECT *, row_number() OVER (PARTITION BY party_status ORDER BY round(severity * ln(1 + frequency) * confidence, 9) DESC, lesson_no) AS rn FROM l)
    SELECT party_status, lesson_no, rn AS rank FROM r WHERE rn <= 10"""
)
def lesson_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten weightiest active lessons of each party status."""
    l = table(spark, sf_dir, "lessons").filter("status = 'ACTIVE'").select("lesson_no", "party_status", "severity", "frequency", "confidence", "error_code").distinct()
    score = F.round(F.col("severity") * F.log1p("frequency") * F.col("confidence"), 9)
    return memory.ranked(l, ["party_status"], score, "lesson_no", 10).select("party_status", "lesson_no", "rank")


@query()
def lesson_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons picked by rank within a budget of 60 keys and tokens for each error code (a skipping fold, so without SQL)."""
    l = table(spark, sf_dir, "lessons").filter("status = 'ACTIVE'").withColumn("tokens", F.size(F.coalesce("statute_ids", F.array().cast("array<string>"))) * 5 + 3)
    l = l.select("lesson_no", "error_code", "confidence", "tokens").distinct()
    return memory.budget_pick(l, ["error_code"], [F.desc("confidence"), F.col("lesson_no")], "lesson_no", "tokens", 60, 8)


@query(
    """SELECT DISTINCT lesson_no FROM (SELECT *, list_filter(coalesce(statute_ids, []), lambda k: k IS NOT NULL AND k <> 'CAFFG_1978_SEC_2') AS k FROM lessons) WHERE status = 'ACTIVE' AND party_status IN ('APPELLANT', 'PETITIONER') AND
    (len(k) = 0 OR list_has_any(k, ['CREVC_1999_SEC_1', 'CREVC_1999_SEC_2', 'MEDC_1990_SEC_1']))"""
)
def usable_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"APPELLANT": "MOVING", "PETITIONER": "MOVING", "RESPONDENT": "ANSWERING"}
    got = memory.usable_lessons(table(spark, sf_dir, "lessons"), "APPELLANT", ["CREVC_1999_SEC_1", "CREVC_1999_SEC_2", "MEDC_1990_SEC_1"], families=families, unkeyed=["CAFFG_1978_SEC_2"])
    return got.select("lesson_no").distinct()


# Run logs: events as calls and traces

_PRICES = [("click", 0.5), ("view", 0.1), ("purchase", 2.0)]


@query(
    """WITH p(event_type, price) AS (VALUES ('click', 0.5), ('view', 0.1), ('purchase', 2.0)), u AS (SELECT event_type, count(*) AS calls, round(sum(value), 4) AS units FROM events GROUP BY event_type)
    SELECT u.event_type, calls, units, round(units * price, 4) AS cost, price IS NOT NULL AS priced FROM u LEFT JOIN p ON u.event_type = p.event_type"""
)
def spend_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("units"))
    prices = spark.createDataFrame(_PRICES, "event_type string, price double")
    out = runlog.spend(calls, prices, ["event_type"])
    return out.select("event_type", "calls", "units", F.round("cost", 4).alias("cost"), "priced")


@query("""SELECT user_id, event_type, count(*) AS requests, round(sum(value), 4) AS units FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY ALL""")
def trailing_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user and type within the last 24 hours of the log."""
    events = table(spark, sf_dir, "events").withColumn("units", F.col("value"))
    last = F.broadcast(events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since")))  # one row
    return runlog.trailing_usage(events.join(last), ["user_id", "event_type"], F.col("since")).withColumn("units", F.round("units", 4))


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
    SELECT user_id, count(*) AS n_events, max(CASE WHEN a = 1 THEN event_type END) AS first_kind, max(CASE WHEN z = 1 THEN event_type END) AS last_kind,
      (SELECT string_agg(k || '=' || n, ' ' ORDER BY k) FROM (SELECT user_id AS u, event_type AS k, count(*) AS n FROM events GROUP BY ALL) WHERE u = e.user_id) AS kinds FROM e GROUP BY user_id"""
)
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runlog.trace_summary(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", "n_events", "first_kind", "last_kind", F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("kinds"))


@query(
    """WITH e AS (SELECT user_id, event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
    SELECT user_id, old, new, count(*) AS n FROM e WHERE old IS NOT NULL AND old <> new AND NOT (old = 'view' AND new = 'click') AND NOT (old = 'click' AND new = 'purchase') GROUP BY ALL"""
)
def bad_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase")], "old string, new string")
    return runlog.bad_transitions(table(spark, sf_dir, "events"), allowed, "user_id", ["ts", "event_id"], "event_type")


@query(
    """WITH e AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS o FROM events),
    i AS (SELECT *, sum(o::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e)
    SELECT user_id, island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY ALL"""
)
def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap of six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    out = runlog.islands(e, "user_id", ["ts", "event_id"], F.col("ts") > F.col("before") + F.expr("INTERVAL 6 HOURS"))
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, 60 - n AS left, 10 - (60 - n) AS short FROM u WHERE 10 - (60 - n) > 0""")
def quota_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who would pass a quota of 60 calls with ten more."""
    events = table(spark, sf_dir, "events")
    usage = events.groupBy("user_id").agg(F.count("*").alias("requests"))
    quotas = events.select("user_id").distinct().withColumn("quota", F.lit(60).cast("bigint"))
    return runlog.quota_shortfall(usage, quotas, ["user_id"], F.lit(10).cast("bigint"))


# Predicates over the law's checklist

_RULES = [
    {"predicate_id": "P1", "tree": {"op": "implies", "args": [{"op": ">=", "args": [{"var": "minimum"}, {"const": 100000}]}, {"op": "<=", "args": [{"var": "window"}, {"const": 90}]}]}, "inputs": {"minimum": "number", "window": "number"}, "error": "ERR_WINDOW"},
    {"predicate_id": "P2", "tree": {"op": "and", "args": [{"op": "==", "args": [{"var": "currency"}, {"const": "INR"}]}, {"op": ">", "args": [{"op": "+", "args": [{"var": "window"}, {"var": "rectify"}]}, {"const": 20}]}]}, "inputs": {"currency": "string", "window": "number", "rectify": "number"}, "error": "ERR_THRESHOLD"},
]


@query(
    """WITH l AS (SELECT DISTINCT rec_no, diagnostic_checklist.financial_threshold.minimum_amount AS m, diagnostic_checklist.financial_threshold.currency AS c, procedural_timelines.adjudication_window_days AS w, procedural_timelines.rectification_window_days AS r FROM law),
    o AS (SELECT rec_no, 'P1' AS predicate_id, CASE WHEN m IS NULL OR w IS NULL THEN 'SKIPPED' WHEN NOT (m >= 100000) OR w <= 90 THEN 'PASS' ELSE 'FAIL' END AS outcome, array_to_string(list_sort(list_filter([CASE WHEN m IS NULL THEN 'minimum' END, CASE WHEN w IS NULL THEN 'window' END], lambda x: x IS NOT NULL)), ',') AS missing, 'ERR_WINDOW' AS e FROM l
      UNION ALL SELECT rec_no, 'P2', CASE WHEN c IS NULL OR w IS NULL OR r IS NULL THEN 'SKIPPED' WHEN c = 'INR' AND w + r > 20 THEN 'PASS' ELSE 'FAIL' END, array_to_string(list_sort(list_filter([CASE WHEN c IS NULL THEN 'currency' END, CASE WHEN w IS NULL THEN 'window' END, CASE WHEN r IS NULL THEN 'rectify' END], lambda x: x IS NOT NULL)), ','), 'ERR_THRESHOLD' FROM l)
    SELECT rec_no, predicate_id, outcome, CASE WHEN outcome = 'FAIL' THEN e END AS error_code, missing FROM o"""
)
def predicate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two compiled rules over every law record: PASS, FAIL or SKIPPED with what is missing."""
    law = table(spark, sf_dir, "law").select(
        "rec_no", F.col("diagnostic_checklist.financial_threshold.minimum_amount").alias("minimum"), F.col("diagnostic_checklist.financial_threshold.currency").alias("currency"),
        F.col("procedural_timelines.adjudication_window_days").alias("window"), F.col("procedural_timelines.rectification_window_days").alias("rectify"),
    ).distinct()
    return predicates.run_all(law, _RULES, ["rec_no"]).select("rec_no", "predicate_id", "outcome", "error_code", F.array_join(F.array_sort("missing"), ",").alias("missing"))
