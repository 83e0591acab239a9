"""Queries of texts and drafts: quotes, normal forms, furniture, pseudonyms, citations, literals and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import checks, hearing, overlap, predicates, temporal
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


DOCS = "documents WHERE text IS NOT NULL"
SQ = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null")


@query(f"""SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS capped, CASE WHEN regexp_matches(text, '^[\x00-\x7F]*$') THEN md5({SQ}) END AS squeezed, 'Doc ' || doc_id || ' in ' || coalesce(lang, '') AS titled FROM {DOCS}""")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut with a mark, squeezed, and a title from a template."""
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.cap(c, 40).alias("capped"), F.when(c.rlike(r"^[\x00-\x7F]*$"), F.md5(T.squeeze(c))).alias("squeezed"), T.template("Doc {id} in {lang}", {"id": F.col("doc_id"), "lang": F.col("lang")}).alias("titled"))


@query("""WITH p AS (SELECT DISTINCT row_no, precedent_uid, list_filter(coalesce(statutes_cited, []), lambda x: x IS NOT NULL) AS s FROM precedents)
    SELECT row_no, CASE WHEN len(s) > 2 THEN s[1] || ', ' || s[2] || ' +' || (len(s) - 2) || ' more' ELSE array_to_string(s, ', ') END AS cited, contains(precedent_uid, '#') OR regexp_matches(precedent_uid, '^[0-9]{4}') AS is_precedent FROM p""")
def cited_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "precedents").select("row_no", "precedent_uid", F.array_compact(F.coalesce("statutes_cited", F.array().cast("array<string>"))).alias("s")).distinct()
    return p.select("row_no", T.cap_list(F.col("s"), 2).alias("cited"), T.is_precedent(F.col("precedent_uid")).alias("is_precedent"))


@query()
def normal_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in compatibility form with plain quotes and single blanks (NFKC, which DuckDB lacks, so without SQL)."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.source_normal(F.col("text"))).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, text, {SQ} AS sq FROM {DOCS}), q AS (SELECT *, trim(substr(sq, 11, 25)) AS q FROM t)
    SELECT doc_id, CASE WHEN q = '' THEN 0 ELSE (length(sq) - length(replace(sq, q, ''))) // length(q) END::INT AS n, CASE WHEN q = '' THEN 0 ELSE instr(sq, q) END::INT AS first_at, CASE WHEN q = '' OR instr(sq, q) = 0 THEN '' ELSE substr(sq, greatest(instr(sq, q) - 8, 1), instr(sq, q) - greatest(instr(sq, q) - 8, 1) + length(q) + 8) END AS around,
      array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p, i: CASE WHEN q <> '' AND contains(lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))), q) THEN i END), lambda x: x IS NOT NULL), ',') AS pages FROM q""")
def quotes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote from the middle of each text: how often and where it stands, around what, on which pages (paragraphs here)."""
    t = _docs(spark, sf_dir).select("doc_id", "text", F.trim(F.substring(T.squeeze(F.col("text")), 11, 25)).alias("q"))
    c, q = F.col("text"), F.col("q")
    paged = F.regexp_replace("text", "\n\n", "\f")
    return t.select("doc_id", T.quote_places(c, q).cast("int").alias("n"), T.quote_at(c, q).cast("int").alias("first_at"), T.quote_context(c, q, 8).alias("around"), F.array_join(T.quote_pages(paged, q).cast("array<string>"), ",").alias("pages"))


@query(f"""WITH n AS (SELECT doc_id, text, unnest(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?'), lambda m: replace(m, ',', '')::DOUBLE)) AS x FROM {DOCS}), v AS (SELECT doc_id, x AS v FROM n UNION SELECT doc_id, x * 100000 FROM n WHERE contains(lower(text), 'lakh') UNION SELECT doc_id, x * 10000000 FROM n WHERE contains(lower(text), 'crore'))
    SELECT doc_id, count(DISTINCT v) AS n, round(max(v), 2) AS top FROM v GROUP BY doc_id""")
def numbers_in_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of a text, alone and times each unit word the text holds."""
    u = _docs(spark, sf_dir).select("doc_id", checks.units(F.col("text"), {"lakh": T.LAKH, "crore": T.CRORE}).alias("u")).filter("size(u) > 0")
    return u.select("doc_id", F.size("u").cast("long").alias("n"), F.round(F.array_max("u"), 2).alias("top"))


@query(f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][\\w.&''-]*(?:\\s+[A-Z&][\\w.&''-]*)*\\s+(?:v\\.|vs\\.?|versus)\\s+[A-Z]')) AS hit FROM {DOCS} UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\([0-9]{{4}}\\)\\s*[0-9]+\\s*SCC\\b')) FROM {DOCS} UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\bAIR\\s+[0-9]{{4}}\\b')) FROM {DOCS}
      UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b[0-9]{{4}}\\s+SCC\\s+OnLine\\b')) FROM {DOCS} UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\(\\s*supra\\s*\\)')) FROM {DOCS}),
    r AS (SELECT doc_id, unnest(regexp_extract_all(text, '""" + T.REGISTRATION + f"""')) AS hit FROM {DOCS})
    SELECT doc_id, 'CITATION' AS kind, count(*) AS n, min(hit) AS first FROM h GROUP BY 1 UNION ALL SELECT doc_id, 'REGISTRATION', count(*), min(hit) FROM r GROUP BY 1""")
def citation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case citations and registration numbers in each document."""
    d, c = _docs(spark, sf_dir), F.col("text")
    hits = d.select("doc_id", F.inline(F.array(F.struct(F.lit("CITATION").alias("kind"), T.citation_hits(c).alias("h")), F.struct(F.lit("REGISTRATION").alias("kind"), T.registration_hits(c).alias("h")))))
    return hits.filter("size(h) > 0").select("doc_id", "kind", F.size("h").cast("long").alias("n"), F.array_min("h").alias("first"))


_PAGES = f"""WITH p AS (SELECT doc_id, page, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS pattern FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS page FROM (SELECT doc_id, string_split(text, '. ') AS p FROM {DOCS})), unnest(string_split(t, ', ')) u(line))"""


@query(_PAGES + """, n AS (SELECT doc_id, count(DISTINCT page) AS n FROM p GROUP BY 1) SELECT p.doc_id, pattern, count(DISTINCT page) AS pages FROM p JOIN n USING (doc_id) WHERE pattern <> '' GROUP BY p.doc_id, pattern, n HAVING count(DISTINCT page) >= greatest(2, ceil(n * 0.3))""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as pages, their clauses as lines: those that stand, digits aside, on a third of them."""
    pages = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("page", "t"))
    return overlap.furniture(pages.select("doc_id", "page", F.explode(F.split("t", ", ")).alias("text")), 0.3)


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {DOCS}), r AS (SELECT doc_id, i, CASE WHEN regexp_replace(upper(trim(line)), '\\s+', '', 'g') = 'INTHEMATTEROF:' THEN 0 WHEN contains(line, 'IN THE MATTER OF:') THEN 1 END AS p FROM l)
    SELECT doc_id, arg_min(i, p * 100000 + i)::INT AS line FROM r WHERE p IS NOT NULL GROUP BY doc_id""")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return checks.header_line(lines, "IN THE MATTER OF:")


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM {DOCS}), h AS (SELECT doc_id, l[1] AS h, array_to_string(l[2:], chr(10)) AS body FROM d)
    SELECT doc_id, md5(CASE WHEN length(h) >= 12 AND (length(body) - length(replace(body, h, ''))) // length(h) >= 2 THEN replace(body, h, '') ELSE body END) AS digest FROM h""")
def running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a document, where it stands twice in the rest, is cut out of it."""
    l = F.split("text", "\n")
    rows = _docs(spark, sf_dir).select("doc_id", F.slice(l, 1, 1).alias("header"), F.array_join(F.slice(l, F.lit(2), F.greatest(F.size(l) - 1, F.lit(0))), "\n").alias("body"))
    return checks.remove_running_text(rows, 12).select("doc_id", F.md5("text").alias("digest"))


_TERM = "regexp_replace(regexp_replace({x}, '{f}(^|[^A-Za-z]){t}($|[^A-Za-z])', '\\1{n}\\2', 'g'), '{f}(^|[^A-Za-z]){t}($|[^A-Za-z])', '\\1{n}\\2', 'g')"


@query("SELECT doc_id, md5(" + _TERM.format(x=_TERM.format(x=_TERM.format(x="text", f="(?i)", t="committee of creditors", n="Panel One"), f="(?i)", t="liquidator", n="Officer"), f="", t="SECTION", n="PART") + f") AS digest FROM {DOCS}")
def pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three terms replaced, longest first; the one in capitals only in capitals."""
    return checks.pseudonyms(_docs(spark, sf_dir), {"committee of creditors": "Panel One", "liquidator": "Officer", "SECTION": "PART"}).select("doc_id", F.md5("text").alias("digest"))


@query("""WITH a AS (SELECT DISTINCT analysis_id, unnest(source_paras) AS p FROM statutory_analysis) SELECT analysis_id, p, regexp_extract(regexp_replace('[' || p || '] (v)', '[\\[\\]\\s]', '', 'g'), '^([A-Za-z]+[0-9]+(?:\\.S[0-9]+)?)', 1) AS clean, CASE WHEN analysis_id % 2 = 0 THEN 'I' || p ELSE 'II' || p END AS repaired FROM a WHERE p IS NOT NULL""")
def repaired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids in brackets made clean; ids with one leading I too many, where the one with less is shown."""
    a = table(spark, sf_dir, "statutory_analysis").select("analysis_id", F.explode("source_paras").alias("p")).filter("p is not null").distinct()
    doubled = F.concat(F.lit("[II"), F.col("p"), F.lit("]"))
    shown = F.when(F.col("analysis_id") % 2 == 0, F.array(F.concat(F.lit("I"), F.col("p")))).otherwise(F.array(F.lit("X")))
    return a.select("analysis_id", "p", T.clean_source_id(F.concat(F.lit("["), F.col("p"), F.lit("] (v)"))).alias("clean"), T.doubled_i(doubled, shown).alias("repaired"))


@query("""SELECT event_id, event_type AS text, json_extract_string(props, '$.k') AS k, '{"key": ' || json_extract_string(props, '$.k') || '}' AS renamed FROM events""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with chatter around a JSON line: citation marks stripped, the last JSON line read, a key renamed."""
    e = table(spark, sf_dir, "events").withColumn("answer", F.concat(F.lit('So:\n{"k": "0"}\n'), F.col("props"), F.lit("\nend")))
    marked = F.concat(F.col("event_type"), F.lit(" [cite: 1, 2]"))
    return e.select("event_id", T.strip_cite_marks(marked).alias("text"), F.try_element_at(T.last_json_object(F.col("answer")), F.lit("k")).alias("k"), T.renamed_keys(F.col("props"), "k", "key").alias("renamed"))


@query("""WITH t AS (SELECT l_orderkey AS o, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), r AS (SELECT o, q, list_reduce(list_prepend({'u': 0::BIGINT, 'b': 0, 'n': 0}, list_transform(q, lambda x: {'u': x, 'b': 0, 'n': 1})), lambda s, x: CASE WHEN s.n > 0 AND s.u + x.u > 60 THEN {'u': x.u, 'b': s.b + 1, 'n': 1} ELSE {'u': s.u + x.u, 'b': s.b, 'n': s.n + 1} END) AS z FROM t)
    SELECT o AS batch_of, z.b + 1 AS n_batches, z.u AS last_used FROM r""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines packed in order into batches of sixty."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_of")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("x"))
    q = F.transform("x", lambda s: s["q"])
    b = t.select("batch_of", q.alias("q"), T.greedy_batches(F.col("x"), q, 60).alias("b"))
    last = F.aggregate(F.zip_with("q", "b", lambda v, i: F.when(i == F.array_max("b"), v).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda s, v: s + v)
    return b.select("batch_of", (F.array_max("b") + 1).alias("n_batches"), last.alias("last_used"))


@query(f"""SELECT doc_id, ceil(len(list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> '')) / 50)::BIGINT AS n_windows FROM {DOCS}""")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty words, the tokens of a word-count tokenizer."""
    return _docs(spark, sf_dir).select("doc_id", F.size(T.window_places(F.col("text"), 50)).cast("long").alias("n_windows"))


# Windows of time, literals and claims


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE DATE '1996-06-30' END AS e, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE DATE '1996-01-01' END AS s FROM orders)
    SELECT k AS case_id, (s IS NULL OR s <= d) AND (e IS NULL OR d <= e) AS covered, (s IS NULL OR s <= d + 30) AND (e IS NULL OR d <= e) AS overlapping FROM o""")
def covered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a window, open where a bound is null, covers the day of an order, and whether it meets the month from it."""
    day = F.col("o_orderdate").cast("date")
    end, start = F.when(F.col("o_orderstatus") != "P", F.lit("1996-06-30").cast("date")), F.when(F.col("o_orderkey") % 5 != 0, F.lit("1996-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), temporal.covers(start, end, day).alias("covered"), temporal.windows_overlap(start, end, day, F.date_add(day, 30)).alias("overlapping"))


@query("""WITH s AS (SELECT l_orderkey AS d, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS b FROM lineitem), o AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY d ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS n FROM s),
    i AS (SELECT *, sum(n::INT) OVER (PARTITION BY d ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM o) SELECT d AS doc_id, min(a) AS start, max(b) AS "end" FROM i WHERE i <= 2 GROUP BY d, i""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"))
    return overlap.merge_spans(s, 2)


_CLAIMS = "SELECT doc_id AS k, text, substr(text, 20, 15) AS q FROM documents WHERE text IS NOT NULL AND length(text) > 40"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("length(text) > 40").select(F.col("doc_id").alias("k"), "text", F.substring("text", 20, 15).alias("q"))


@query(f"""WITH c AS ({_CLAIMS}), v AS (SELECT k, text, CASE WHEN k % 6 = 0 THEN 'not there' ELSE q END AS quote, (k % 10)::VARCHAR AS value FROM c) SELECT k AS claim_id, contains(text, quote) AND quote <> '' AND contains(regexp_replace(quote, '[^0-9]', '', 'g'), value) AS kept FROM v""")
def grounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _claims(spark, sf_dir).select(F.col("k").alias("claim_id"), "text", F.when(F.col("k") % 6 == 0, "not there").otherwise(F.col("q")).alias("quote"), (F.col("k") % 10).alias("value"))
    return hearing.grounded(v).select("claim_id", "kept")


@query(f"""WITH c AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sq FROM ({_CLAIMS})), v AS (SELECT k, contains(sq, CASE WHEN k % 6 = 0 THEN 'never said' ELSE lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) END) AS there, k % 5 <> 0 AS known, k % 4 = 0 AS ex, k % 8 = 0 AS has, (k % 10) / 10.0 AS conf, CASE WHEN k % 7 = 0 THEN false WHEN k % 7 = 1 THEN true END AS second FROM c)
    SELECT k AS claim_id, x <> '' AS rejected, x AS reasons FROM (SELECT k, concat_ws(',', CASE WHEN NOT there THEN 'NOT_VERBATIM' END, CASE WHEN NOT known THEN 'UNKNOWN_ID' END, CASE WHEN ex AND NOT has THEN 'NO_EXHIBIT' END, CASE WHEN conf < 0.35 THEN 'LOW_CONFIDENCE' END, CASE WHEN NOT second THEN 'DENIED' END) AS x FROM v)""")
def fidelity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    c = _claims(spark, sf_dir).select(
        k.alias("claim_id"), "text", F.when(k % 6 == 0, "never said").otherwise(F.col("q")).alias("quote"), (k % 5 != 0).alias("known"), (k % 4 == 0).alias("exhibit_kind"), (k % 8 == 0).alias("has_exhibit"),
        ((k % 10) / 10.0).alias("confidence"), F.when(k % 7 == 0, False).when(k % 7 == 1, True).alias("second"),
    )
    return checks.fidelity(c, 0.35).select("claim_id", "rejected", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH c AS ({_CLAIMS}) SELECT k AS claim_id, CASE WHEN contains(text, q) AND q <> '' THEN (k % 10) / 10.0 ELSE 0.0 END::DOUBLE AS a, (CASE WHEN contains(text, 'zz' || q) THEN 1.0 ELSE 0.0 END)::DOUBLE AS b FROM c""")
def zeroed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of a text: one verbatim, one not, one of an unknown name, which is dropped."""
    one = lambda n, q, c: F.struct(F.lit(n).alias("name"), q.alias("quote"), c.cast("double").alias("confidence"))
    c = _claims(spark, sf_dir).withColumn("r", F.array(one("a", F.col("q"), (F.col("k") % 10) / 10.0), one("b", F.concat(F.lit("zz"), "q"), F.lit(1.0)), one("odd", F.col("q"), F.lit(1.0))))
    z = c.select("k", checks.zero_confidence(F.col("r"), F.col("text"), ["a", "b"]).alias("z"))
    return z.select(F.col("k").alias("claim_id"), F.col("z")[0]["confidence"].alias("a"), F.col("z")[1]["confidence"].alias("b"))


@query(f"""WITH c AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sq, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS z FROM ({_CLAIMS})), v AS (SELECT k, CASE WHEN k % 6 = 0 THEN 0 WHEN z = '' THEN 0 ELSE (length(sq) - length(replace(sq, z, ''))) // length(z) END AS n, k % 5 = 0 AS odd FROM c)
    SELECT k AS draft_id, unnest(list_filter([CASE WHEN n = 0 THEN 'NOT_VERBATIM' END, CASE WHEN n > 1 THEN 'NOT_UNIQUE' END, 'DATE_NOT_IN_QUOTE', CASE WHEN odd THEN 'UNKNOWN_TERM' END], lambda x: x IS NOT NULL)) AS problem FROM v""")
def draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = _claims(spark, sf_dir).select(k.alias("draft_id"), F.when(k % 6 == 0, "never ever said").otherwise(F.col("q")).alias("quote"), F.col("text").alias("source_text"), F.lit("1801-01-02").cast("date").alias("value_date"), F.when(k % 5 == 0, "odd").otherwise("window").alias("term"))
    return checks.draft_checks(d, ["window"])


@query("""WITH c AS (SELECT l_orderkey || '/' || l_linenumber AS claim_id, l_partkey AS key, round(l_extendedprice / l_quantity, 2) AS claimed FROM lineitem), h AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS value FROM part WHERE p_partkey % 11 <> 0)
    SELECT DISTINCT claim_id, c.key, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN claimed::DECIMAL(38,9) = value::DECIMAL(38,9) THEN 'HOLDS' ELSE 'FAILS' END AS state FROM c LEFT JOIN h ON h.key = c.key""")
def tracked_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices claimed by order lines against those that are held."""
    c = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_partkey").alias("key"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("claimed"))
    held = table(spark, sf_dir, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("value"))
    return checks.tracked_equality(c, held).distinct()


_V = lambda n: {"var": n}
_N = lambda v: {"const": v}
_DATED = [
    {"predicate_id": "D1", "tree": {"op": "<=", "args": [_V("filed"), {"op": "add_years", "args": [_V("due"), _N(2)]}]}, "inputs": {"filed": "date", "due": "date"}, "error": "LATE"},
    {"predicate_id": "D2", "tree": {"op": "or", "args": [{"op": "<", "args": [{"op": "days_between", "args": [_V("due"), _V("filed")]}, _N(400)]}, {"op": "not", "args": [{"op": "!=", "args": [_V("state"), _N("F")]}]}]}, "inputs": {"filed": "date", "due": "date", "state": "string"}, "error": "FAR"},
    {"predicate_id": "D3", "tree": {"op": ">", "args": [{"op": "if", "args": [{"op": "==", "args": [_V("state"), _N("F")]}, _V("price"), {"op": "-", "args": [_V("price"), _N(1000)]}]}, _N(100000)]}, "inputs": {"state": "string", "price": "number"}, "error": "LOW"},
    {"predicate_id": "D4", "tree": {"choose": "from", "options": {"notice": {"op": ">=", "args": [{"op": "add_days", "args": [_V("due"), _N(30)]}, _V("filed")]}, "default": _N(True)}}, "inputs": {"filed": "date", "due": "date"}, "error": "NOTICE", "choices": {"from": "notice"}},
    {"predicate_id": "D5", "tree": {"op": "+", "args": [_V("state"), _N(1)]}, "inputs": {"state": "string"}, "error": "X"},
]


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS due, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE + (o_custkey % 1000)::INT END AS filed, o_orderstatus AS s, o_totalprice::DECIMAL(38,9) AS p FROM orders)
    SELECT k AS case_id, 'D1' AS predicate_id, CASE WHEN filed IS NULL THEN 'SKIPPED' WHEN filed <= (due + INTERVAL 24 MONTH)::DATE THEN 'PASS' ELSE 'FAIL' END AS outcome FROM o UNION ALL SELECT k, 'D2', CASE WHEN filed IS NULL THEN 'SKIPPED' WHEN filed - due < 400 OR s = 'F' THEN 'PASS' ELSE 'FAIL' END FROM o
    UNION ALL SELECT k, 'D3', CASE WHEN CASE WHEN s = 'F' THEN p ELSE p - 1000 END > 100000 THEN 'PASS' ELSE 'FAIL' END FROM o UNION ALL SELECT k, 'D4', CASE WHEN filed IS NULL THEN 'SKIPPED' WHEN due + 30 >= filed THEN 'PASS' ELSE 'FAIL' END FROM o UNION ALL SELECT k, 'D5', 'SKIPPED' FROM o""")
def dated_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with dates, branches and a chosen reading over every order; one of wrong sorts skips every row."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("due"), F.when(F.col("o_orderkey") % 10 != 0, F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 1000).cast("int"))).alias("filed"),
        F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"),
    )
    return predicates.run_all(o, _DATED, ["case_id"]).select("case_id", "predicate_id", "outcome")
