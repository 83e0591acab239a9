"""Queries of stores: reads, writes as new snapshots, views, access, references between records and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators import audit, evaluation, lookup, memory, quality, records, reports, resolve, runlog, sync, temporal, vector
from docketlake.plans.session import cut, table
from docketlake.sources import files
from docketlake.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DOCS = "SELECT DISTINCT doc_id, case_id, doc_kind, source, lang, coalesce(n_chars, 0) AS n FROM documents"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "case_id", "doc_kind", "source", "lang", F.coalesce("n_chars", F.lit(0)).alias("n"))


# Stores: a stored side and an incoming one, cut from the documents by their kind


@query(f"WITH d AS ({DOCS}), i AS (SELECT doc_id, case_id, n + 1 AS n FROM d WHERE doc_kind <> 'order') SELECT doc_id, case_id, n FROM d WHERE doc_id NOT IN (SELECT doc_id FROM i) AND doc_kind <> 'note' UNION ALL SELECT * FROM i")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but notes are stored; all but orders come in, one sign longer, and take the place of what is stored."""
    d = _docs(spark, sf_dir)
    return sync.upsert(d.filter("doc_kind <> 'note'").select("doc_id", "case_id", "n"), d.filter("doc_kind <> 'order'").select("doc_id", "case_id", (F.col("n") + 1).alias("n")), "doc_id")


@query(f"WITH d AS ({DOCS}), s AS (SELECT doc_id, n FROM d WHERE doc_kind = 'order'), i AS (SELECT doc_id, n FROM d WHERE doc_kind IN ('order', 'note')) SELECT doc_id, 'stored' AS part FROM s UNION ALL SELECT doc_id, 'stored' FROM i WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT doc_id, 'refused' FROM i WHERE doc_id IN (SELECT doc_id FROM s)")
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are stored; orders and notes come in, and what is there already is refused."""
    d = _docs(spark, sf_dir)
    every, refused = sync.append_only(d.filter("doc_kind = 'order'").select("doc_id", "n"), d.filter("doc_kind in ('order', 'note')").select("doc_id", "n"), "doc_id")
    return every.select("doc_id", F.lit("stored").alias("part")).unionByName(refused.select("doc_id", F.lit("refused").alias("part")))


@query(f"SELECT doc_id, n FROM ({DOCS}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return sync.delete_ids(d.select("doc_id", "n"), d.filter("lang = 'en'"), "doc_id")


@query("""WITH v AS (SELECT vec_id, min(uid) AS uid, len(any_value(vec)) AS d FROM vectors GROUP BY vec_id) SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN upper(uid) ELSE uid END AS uid, d::BIGINT AS dims FROM v""")
def refreshed_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector gets a new payload (its uid in capitals) and keeps its vector."""
    v = table(spark, sf_dir, "vectors").groupBy("vec_id").agg(F.min("uid").alias("uid"), F.first("vec").alias("vec"))
    out = sync.refresh_payload(v, v.filter("vec_id % 3 = 0").select("vec_id", F.upper("uid").alias("uid")), "vec_id")
    return out.select("vec_id", "uid", F.when(F.col("vec").isNotNull(), F.size("vec")).cast("long").alias("dims"))


@query("SELECT count(*) AS n_rows, count(DISTINCT precedent_uid) AS n_uids, count(*) FILTER (forum = 'NCLAT') > 0 AS has_appeals FROM (SELECT DISTINCT row_no, precedent_uid, forum FROM precedents)")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "precedents").select("row_no", "precedent_uid", "forum").distinct()
    return p.agg(F.count("*").alias("n_rows"), F.count_distinct("precedent_uid").alias("n_uids"), (F.count_if(F.col("forum") == "NCLAT") > 0).alias("has_appeals"))


@query("SELECT DISTINCT row_no, case_id, final_order FROM precedents")
def allowed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.allow(table(spark, sf_dir, "precedents"), ["row_no", "case_id", "final_order"]).distinct()


@query("SELECT DISTINCT row_no, precedent_id, case_id, forum FROM precedents")
def agent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent sees of a precedent: all known columns but the hidden ones."""
    p = table(spark, sf_dir, "precedents").select("row_no", "precedent_id", "case_id", "forum", "final_order", "ratio_text")
    return records.agent_view(p, ["final_order", "ratio_text"], ["row_no", "precedent_id", "case_id", "forum", "final_order", "ratio_text"]).distinct()


@query("""WITH v AS (SELECT DISTINCT vec_id, uid, decided, statutes FROM vectors), x AS (SELECT DISTINCT precedent_uid AS uid FROM precedents WHERE upper(final_order) = 'DISMISSED' AND precedent_uid IS NOT NULL)
    SELECT vec_id FROM v WHERE decided < DATE '2018-01-01' AND uid NOT IN (SELECT uid FROM x) AND list_has_any(statutes, ['CREVC_1999_SEC_1', 'CREVC_1999_SEC_2', 'MEDC_1990_SEC_1'])""")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors a search of 2018 may see: decided before, not of dismissed precedents, on one of three statutes."""
    v = table(spark, sf_dir, "vectors").select("vec_id", F.col("uid").alias("precedent_id"), "decided", "statutes").filter("precedent_id is not null").distinct()
    excluded = table(spark, sf_dir, "precedents").filter("upper(final_order) = 'DISMISSED'").select(F.col("precedent_uid").alias("precedent_id"))
    return vector.scoped(v, F.lit("2018-01-01").cast("date"), excluded, ["CREVC_1999_SEC_1", "CREVC_1999_SEC_2", "MEDC_1990_SEC_1"]).select("vec_id").distinct()


@query("SELECT DISTINCT statute_id FROM law WHERE jurisdiction_type IN ('SAVING_PROVISION', 'PROCEDURAL_TIMELINE')")
def statutes_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.of_types(table(spark, sf_dir, "law"), ["SAVING_PROVISION", "PROCEDURAL_TIMELINE"])


_POLICY = [("order", "en", "read", "ALL"), ("order", "hi", "read", "OWN"), ("note", "en", "write", "OWN"), ("summary", "fr", "read", "ALL")]


@query(f"""WITH p(role, store, op, scope) AS (VALUES {", ".join(map(str, _POLICY))}), r AS (SELECT DISTINCT doc_id, doc_kind AS role, lang AS store, CASE WHEN doc_id % 2 = 0 THEN 'read' ELSE 'write' END AS op FROM documents)
    SELECT doc_id, p.scope, p.scope IS NOT NULL AS allowed FROM r LEFT JOIN p ON p.role = r.role AND p.store = r.store AND p.op = r.op""")
def access_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _docs(spark, sf_dir).select("doc_id", F.col("doc_kind").alias("role"), F.col("lang").alias("store"), F.when(F.col("doc_id") % 2 == 0, "read").otherwise("write").alias("op"))
    return records.permitted(r, spark.createDataFrame(_POLICY, "role string, store string, op string, scope string")).select("doc_id", "scope", "allowed")


@query("""SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(raw_json)) AS k FROM law_files WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT') WHERE k NOT IN ('statute_id', 'act_name', 'section_number', 'section_title') GROUP BY k""")
def undocumented_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level keys of the raw law records that four documented ones don't cover."""
    return files.undocumented_fields(table(spark, sf_dir, "law_files").filter("raw_json is not null"), "raw_json", ["statute_id", "act_name", "section_number", "section_title"])


_LISTS = ("applicant_eligibility", "mandatory_prerequisites", "statutory_bars", "saving_exceptions")
_ITEMS = "WITH l AS (SELECT DISTINCT rec_no, statute_id, diagnostic_checklist AS c FROM law), i AS (" + " UNION ALL ".join(f"SELECT rec_no, statute_id, '{f}' AS field, generate_subscripts(c.{f}, 1) - 1 AS pos, unnest(c.{f}) AS item FROM l" for f in _LISTS) + ")\n"


def _law_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = table(spark, sf_dir, "law").select("rec_no", "statute_id", *[F.col(f"diagnostic_checklist.{f}").alias(f) for f in _LISTS]).distinct()
    parts = [law.select("rec_no", "statute_id", F.lit(f).alias("field"), F.posexplode(f).alias("pos", "item")) for f in _LISTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _as_items(field: str) -> Column:
    item = lambda x, i: F.struct(F.concat(F.lit(field + "/"), i.cast("string")).alias("id"), x.alias("claim"), F.array().cast("array<string>").alias("sources"))
    return F.transform(f"diagnostic_checklist.{field}", item).alias(field)


@query(_ITEMS + "SELECT rec_no AS case_id, field || '/' || pos AS item_id, field AS kind, item AS claim FROM i")
def flattened_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist lists of each law record as one list of items."""
    law = table(spark, sf_dir, "law").select(F.col("rec_no").alias("case_id"), *[_as_items(f) for f in _LISTS]).distinct()
    return records.flatten_items(law, {f: f for f in _LISTS}).drop("sources")


@query(_ITEMS + "SELECT a.case_id, a.item_id, i.field AS kind, i.item AS claim FROM (SELECT DISTINCT rec_no AS case_id, unnest(['statutory_bars/0', 'statutory_bars/9', 'saving_exceptions/1']) AS item_id FROM l) a LEFT JOIN i ON i.rec_no = a.case_id AND i.field || '/' || i.pos = a.item_id")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = flattened_items(spark, sf_dir)
    asked = table(spark, sf_dir, "law").select(F.col("rec_no").alias("case_id"), F.explode(F.array(*map(F.lit, ("statutory_bars/0", "statutory_bars/9", "saving_exceptions/1")))).alias("item_id"))
    return lookup.record_items(asked, items)


_ASKED = [("statutory_bars", 0), ("statutory_bars", 7), ("saving_exceptions", None), ("adjudication_window_days", None), ("adjudication_window_days", 0), ("verdict", None)]


@query("WITH l AS (SELECT DISTINCT rec_no, diagnostic_checklist AS c, procedural_timelines.adjudication_window_days AS w FROM law), a(field, item_index) AS (VALUES " + ", ".join(f"('{f}', {'NULL' if i is None else i})" for f, i in _ASKED) + """),
    j AS (SELECT rec_no, field, item_index, CASE field WHEN 'statutory_bars' THEN c.statutory_bars WHEN 'saving_exceptions' THEN c.saving_exceptions END AS x, w FROM l, a),
    p AS (SELECT *, CASE WHEN field LIKE '%s' AND field <> 'adjudication_window_days' AND item_index IS NULL THEN 'NO_INDEX' WHEN field IN ('statutory_bars', 'saving_exceptions') AND item_index >= coalesce(len(x), 0) THEN 'NO_ITEM'
      WHEN field = 'adjudication_window_days' AND item_index IS NOT NULL THEN 'INDEX_REFUSED' WHEN field = 'verdict' THEN 'UNKNOWN_FIELD' END AS problem FROM j)
    SELECT rec_no, field, item_index, CASE WHEN problem IS NULL THEN CASE WHEN field = 'adjudication_window_days' THEN w::VARCHAR ELSE x[item_index + 1] END END AS item, problem FROM p""")
def checklist_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ways to name an item of every law record's checklist."""
    law = table(spark, sf_dir, "law").select("rec_no", F.col("diagnostic_checklist.statutory_bars").alias("statutory_bars"), F.col("diagnostic_checklist.saving_exceptions").alias("saving_exceptions"), F.col("procedural_timelines.adjudication_window_days").alias("w")).distinct()
    ways = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).cast("int").alias("item_index")) for f, i in _ASKED])
    asked = law.select("rec_no", F.inline(ways))
    return lookup.checklist_items(asked, law, ["statutory_bars", "saving_exceptions"], {"adjudication_window_days": F.col("w")})


_MARKED = "SELECT DISTINCT 'P' || (rec_no % 7) || '/' || rec_no AS predicate_id, statute_id, field, pos::INT AS item_index, CASE WHEN rec_no % 5 = 0 THEN sha256('gone') ELSE sha256(item) END AS item_hash, CASE WHEN rec_no % 4 = 0 THEN 'DRAFT' ELSE 'APPROVED' END AS status FROM i WHERE pos = 0 AND item IS NOT NULL AND field = 'statutory_bars'"
_NOW = "SELECT DISTINCT statute_id, field, pos::INT AS pos, sha256(item) AS hash FROM i WHERE item IS NOT NULL"


def _predicates(items: DataFrame) -> DataFrame:
    own = items.filter("pos = 0 and item is not null and field = 'statutory_bars'")
    return own.select(
        F.concat(F.lit("P"), (F.col("rec_no") % 7).cast("string"), F.lit("/"), F.col("rec_no").cast("string")).alias("predicate_id"), "statute_id", "field", F.col("pos").alias("item_index"),
        F.when(F.col("rec_no") % 5 == 0, F.sha2(F.lit("gone"), 256)).otherwise(F.sha2("item", 256)).alias("item_hash"), F.when(F.col("rec_no") % 4 == 0, "DRAFT").otherwise("APPROVED").alias("status"),
    ).distinct()


def _hashed(items: DataFrame) -> DataFrame:
    return items.filter("item is not null").select("statute_id", "field", "pos", F.sha2("item", 256).alias("hash")).distinct()


@query(_ITEMS + f"SELECT DISTINCT p.predicate_id FROM ({_MARKED}) p JOIN ({_NOW}) n ON n.statute_id = p.statute_id AND n.field = p.field AND n.pos = p.item_index AND n.hash = p.item_hash WHERE p.status = 'APPROVED'")
def current_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved predicates on the first bar of each record whose item still reads as it did."""
    items = _law_items(spark, sf_dir)
    return records.current_predicates(_predicates(items), _hashed(items)).select("predicate_id").distinct()


@query(_ITEMS + f"SELECT p.predicate_id, min(n.pos) AS new_index, CASE WHEN min(n.pos) IS NULL THEN 'STALE' ELSE 'APPROVED' END AS status FROM ({_MARKED}) p LEFT JOIN ({_NOW}) n ON n.statute_id = p.statute_id AND n.field = p.field AND n.hash = p.item_hash GROUP BY p.predicate_id, p.item_hash")
def moved_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _law_items(spark, sf_dir)
    return temporal.checklist_moves(_predicates(items), _hashed(items))


@query("""WITH a AS (SELECT DISTINCT doc_id::VARCHAR AS name, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 4 = 0 THEN 'DRAFT' ELSE 'APPROVED' END AS status FROM documents WHERE text IS NOT NULL)
    SELECT d.doc_id::VARCHAR AS name, coalesce(bool_or(a.status = 'APPROVED' AND a.h = sha256(d.text)), false) AS usable FROM documents d LEFT JOIN a ON a.name = d.doc_id::VARCHAR WHERE d.text IS NOT NULL GROUP BY 1""")
def approved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose exact hash is approved: every third has changed since, every fourth was never approved."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("name"), "doc_id", "text")
    ok = d.select("name", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"), F.when(F.col("doc_id") % 4 == 0, "DRAFT").otherwise("APPROVED").alias("status"))
    return records.approved_text(d.select("name", "text"), ok)


_CASES = "SELECT o_orderkey AS case_id, o_orderdate::DATE AS decided_on, coalesce(k, []) AS k FROM orders LEFT JOIN (SELECT l_orderkey AS c, list(DISTINCT (l_returnflag, l_shipdate::DATE)) AS k FROM lineitem GROUP BY 1) ON c = o_orderkey"


def _dated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: the ship dates of their lines are key dates, labelled by return flag."""
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.struct(F.col("l_returnflag").alias("label"), F.col("l_shipdate").cast("date").alias("day"))).alias("key_dates"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("decided_on"))
    return o.join(k, "case_id", "left").withColumn("key_dates", F.coalesce("key_dates", F.array().cast("array<struct<label:string,day:date>>")))


@query("SELECT DISTINCT l_orderkey AS case_id, l_returnflag AS label, l_shipdate::DATE AS day FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 'DECISION', o_orderdate::DATE FROM orders")
def case_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.case_dates(_dated_cases(spark, sf_dir))


@query("""SELECT o_orderkey AS case_id, coalesce(n, 0)::BIGINT AS n_left, CASE WHEN coalesce(r, false) THEN '' ELSE 'R' END AS absent FROM orders LEFT JOIN (SELECT l_orderkey AS c, count(DISTINCT (l_returnflag, l_shipdate)) FILTER (l_returnflag <> 'R') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON c = o_orderkey""")
def dates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.without_dates(_dated_cases(spark, sf_dir), ["R"])
    return out.select("case_id", F.size("key_dates").cast("long").alias("n_left"), F.array_join("absent", ",").alias("absent"))


_OVERLAY = """WITH pairs AS (SELECT DISTINCT case_id, statute_id FROM statutory_analysis WHERE case_id IS NOT NULL AND statute_id IN (SELECT statute_id FROM law)),
    dates AS (SELECT case_id, 'DECISION' AS label, max(recorded_at)::DATE AS day FROM statutory_analysis WHERE case_id IS NOT NULL GROUP BY 1 UNION ALL SELECT case_id, 'FILING', min(recorded_at)::DATE FROM statutory_analysis WHERE case_id IS NOT NULL AND act_prefix LIKE 'C%' GROUP BY 1),
    overlay AS (SELECT DISTINCT rec_no, statute_id, 'section_in_force' AS parameter, jurisdiction_type <> 'SAVING_PROVISION' AS value_bool, NULL AS value, CASE WHEN rec_no % 3 = 0 THEN 'FILING' ELSE 'DECISION' END AS keyed_on, loaded_at::DATE AS f, removed_at::DATE AS t FROM law
      UNION ALL SELECT DISTINCT rec_no, statute_id, 'window', NULL, procedural_timelines.adjudication_window_days::VARCHAR, 'DECISION', loaded_at::DATE, NULL FROM law),
    seen AS (SELECT p.case_id, p.statute_id, o.parameter, o.value, o.value_bool, d.day, d.day IS NOT NULL AND (f IS NULL OR f <= d.day) AND (t IS NULL OR d.day <= t) AS hit FROM pairs p JOIN overlay o ON o.statute_id = p.statute_id LEFT JOIN dates d ON d.case_id = p.case_id AND d.label = o.keyed_on),
    per AS (SELECT case_id, statute_id, parameter, count(*) FILTER (hit) AS hits, max(value) FILTER (hit) AS value, count(*) FILTER (parameter = 'section_in_force' AND day IS NOT NULL) AS dated, coalesce(bool_or(parameter = 'section_in_force' AND hit AND value_bool), false) AS on_, count(*) FILTER (day IS NULL) AS lost FROM seen GROUP BY ALL),
    g AS (SELECT case_id, statute_id, max(hits) AS most, sum(dated) AS dated, bool_or(on_) AS on_, sum(lost) AS lost, string_agg(parameter || '=' || coalesce(value, ''), ',' ORDER BY parameter) FILTER (hits = 1 AND parameter <> 'section_in_force') AS applied FROM per GROUP BY ALL)
"""


def _overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Law records as dated rules (in force, and a window), analyses as what cases ask for and when."""
    law, a = table(spark, sf_dir, "law"), table(spark, sf_dir, "statutory_analysis").filter("case_id is not null")
    force = law.select("rec_no", "statute_id", F.lit("section_in_force").alias("parameter"), (F.col("jurisdiction_type") != "SAVING_PROVISION").alias("value_bool"), F.lit(None).cast("string").alias("value"), F.when(F.col("rec_no") % 3 == 0, "FILING").otherwise("DECISION").alias("keyed_on"), F.col("loaded_at").cast("date").alias("effective_from"), F.col("removed_at").cast("date").alias("effective_to")).distinct()
    window = law.select("rec_no", "statute_id", F.lit("window").alias("parameter"), F.lit(None).cast("boolean").alias("value_bool"), F.col("procedural_timelines.adjudication_window_days").cast("string").alias("value"), F.lit("DECISION").alias("keyed_on"), F.col("loaded_at").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to")).distinct()
    dates = a.groupBy("case_id").agg(F.max("recorded_at").cast("date").alias("day")).select("case_id", F.lit("DECISION").alias("label"), "day")
    dates = dates.unionByName(a.filter("act_prefix like 'C%'").groupBy("case_id").agg(F.min("recorded_at").cast("date").alias("day")).select("case_id", F.lit("FILING").alias("label"), "day"))
    return law, force.unionByName(window).withColumn("status", F.lit("APPROVED")), dates, a.select("case_id", "statute_id")


@query(
    _OVERLAY
    + """SELECT p.case_id, p.statute_id, CASE WHEN coalesce(most, 0) > 1 THEN 'CONFLICT' WHEN coalesce(dated, 0) > 0 AND NOT on_ THEN 'HIDDEN' WHEN coalesce(dated, 0) = 0 THEN 'UNVERIFIED' ELSE 'CONFIRMED' END AS status, coalesce(applied, '') AS applied, coalesce(lost, 0)::BIGINT AS unresolved
    FROM pairs p LEFT JOIN g USING (case_id, statute_id)"""
)
def resolve_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statutes each case asks for, as of its dates: status, values that apply, rules whose date it lacks."""
    law, overlay, dates, asked = _overlay(spark, sf_dir)
    out = temporal.resolve_statutes(law, overlay, dates, asked)
    return out.select("case_id", "statute_id", "status", F.array_join(F.transform("applied", lambda a: F.concat(a["parameter"], F.lit("="), F.coalesce(a["value"], F.lit("")))), ",").alias("applied"), "unresolved")


@query("""WITH d AS (SELECT o_orderkey AS case_id, 'DECISION' AS label, o_orderdate::DATE AS day FROM orders UNION ALL SELECT o_orderkey, 'FILED', (o_orderdate - INTERVAL 90 DAY)::DATE FROM orders),
    r AS (SELECT o_orderstatus AS reading, o_orderkey AS case_id, 'FILED' AS label, CASE WHEN o_orderstatus = 'O' THEN (o_orderdate - INTERVAL 30 DAY)::DATE END AS day FROM orders WHERE o_orderstatus <> 'F')
    SELECT r.reading, d.case_id, d.label, d.day FROM d JOIN r ON r.case_id = d.case_id WHERE d.label <> r.label UNION ALL SELECT * FROM r WHERE day IS NOT NULL""")
def alternative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contested filing date: read as later for open orders, as absent for pending ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").cast("date").alias("d"))
    dates = o.select("case_id", F.lit("DECISION").alias("label"), F.col("d").alias("day")).unionByName(o.select("case_id", F.lit("FILED").alias("label"), F.date_sub("d", 90).alias("day")))
    readings = o.filter("s <> 'F'").select(F.col("s").alias("reading"), "case_id", F.lit("FILED").alias("label"), F.when(F.col("s") == "O", F.date_sub("d", 30)).alias("day"))
    return reports.alternative_dates(dates, readings)


@query("SELECT count(DISTINCT x)::BIGINT AS n_versions, count(*)::BIGINT AS n FROM (SELECT (section_title, forum_level, CASE WHEN rec_no % 2 = 0 THEN 'a' ELSE 'b' END, statute_id) AS x FROM (SELECT DISTINCT rec_no, statute_id, section_title, forum_level FROM law))")
def law_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law records told apart by a fingerprint of content and of what applies: as many as there are unlike ones."""
    law = table(spark, sf_dir, "law").select("rec_no", "statute_id", "section_title", "forum_level").distinct()
    even = reports.law_fingerprint(law.filter("rec_no % 2 = 0").drop("rec_no"), F.lit("a"))
    odd = reports.law_fingerprint(law.filter("rec_no % 2 <> 0").drop("rec_no"), F.lit("b"))
    both = even.unionByName(odd)
    return both.agg(F.count_distinct("statute_id", "version").alias("n_versions"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey AS s, l_returnflag AS p, CASE WHEN l_linestatus = 'F' THEN 'int' ELSE 'bool' END AS k, l_quantity::INT AS n FROM lineitem),
    w AS (SELECT s, max(n) FILTER (p = 'A' AND k = 'int') AS years, max(n) FILTER (p = 'N' AND k = 'int') AS minimum_days FROM a GROUP BY s) SELECT s AS statute_id, years, minimum_days FROM w WHERE years IS NOT NULL""")
def period_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limitation rules from applied parameters: an int period makes one, a floor of days may go with it."""
    name = F.when(F.col("l_returnflag") == "A", "period_years").when(F.col("l_returnflag") == "N", "minimum_days").otherwise("other")
    none = F.lit(None).cast("date")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("statute_id"), name.alias("parameter"), F.when(F.col("l_linestatus") == "F", "int").otherwise("bool").alias("kind"), F.col("l_quantity").cast("int").alias("n"), none.alias("from"), none.alias("to"))
    return reports.period_rule(a).select("statute_id", "years", "minimum_days")


# References


@query("""WITH a(cited_prefix, law_db_prefix) AS (VALUES ('CREVC', 'REVIVAL'), ('MEDC', 'MEDC_1990'), ('X', 'CAFFG_1978')) SELECT * FROM a WHERE law_db_prefix NOT IN (SELECT array_to_string(list_slice(string_split(statute_id, '_'), 1, i), '_') FROM (SELECT DISTINCT statute_id FROM law WHERE statute_id IS NOT NULL), range(1, 12) r(i) WHERE i <= len(string_split(statute_id, '_')))""")
def unmatched_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("CREVC", "REVIVAL"), ("MEDC", "MEDC_1990"), ("X", "CAFFG_1978")], "cited_prefix string, law_db_prefix string")
    return resolve.unmatched_targets(aliases, table(spark, sf_dir, "law").filter("statute_id is not null")).select("cited_prefix", "law_db_prefix")


@query("""WITH k AS (SELECT DISTINCT statute_id AS id FROM law), r AS (SELECT rec_no, pos, id FROM (SELECT rec_no, unnest(x) AS id, generate_subscripts(x, 1) AS pos FROM (SELECT DISTINCT rec_no, intersecting_statute_ids AS x FROM law)) WHERE id IS NOT NULL),
    n AS (SELECT rec_no, pos, CASE WHEN id NOT IN (SELECT id FROM k WHERE id IS NOT NULL) THEN upper(trim(id)) ELSE id END AS id FROM r), f AS (SELECT rec_no, id, min(pos) AS pos FROM n GROUP BY ALL)
    SELECT rec_no, string_agg(id, ',' ORDER BY pos, id) AS refs FROM f GROUP BY rec_no""")
def rewritten_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references rewritten to their normal spelling, each once."""
    law = table(spark, sf_dir, "law").select("rec_no", "statute_id", "intersecting_statute_ids").distinct()
    ids = law.select(F.explode("intersecting_statute_ids").alias("missing_id")).filter("missing_id is not null").distinct()
    lost = ids.join(law.select(F.col("statute_id").alias("missing_id")), "missing_id", "left_anti")
    out = resolve.rewrite_references(law, lost.select("missing_id", F.upper(F.trim("missing_id")).alias("suggestion")))
    return out.select("rec_no", F.array_join("references", ",").alias("refs"))


@query("""SELECT id AS missing_id, analysis_id AS referenced_by, count(*) AS n_rows FROM (SELECT DISTINCT analysis_id, unnest(interacts_with) AS id FROM statutory_analysis) WHERE id IS NOT NULL AND id NOT IN (SELECT statute_id FROM law WHERE statute_id IS NOT NULL) GROUP BY ALL""")
def dangling_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which analysis refers, as it stands there, to a statute that the law never held."""
    refs = table(spark, sf_dir, "statutory_analysis").select("analysis_id", F.explode("interacts_with").alias("id")).distinct()
    return quality.dangling_by(refs, table(spark, sf_dir, "law").filter("statute_id is not null"), "id", "statute_id", "analysis_id")


@query("""WITH x AS (SELECT DISTINCT precedent_id AS id FROM precedents WHERE upper(final_order) = 'DISMISSED' AND precedent_id IS NOT NULL), r AS (SELECT DISTINCT precedent_id AS old_id, precedent_uid AS new_id FROM precedents WHERE precedent_uid IS NOT NULL) SELECT id FROM x UNION SELECT new_id FROM r JOIN x ON x.id = r.old_id""")
def exclusion_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "precedents")
    return records.exclusion_closure(p.filter("upper(final_order) = 'DISMISSED' and precedent_id is not null").select(F.col("precedent_id").alias("id")), p.filter("precedent_uid is not null").select(F.col("precedent_id").alias("old_id"), F.col("precedent_uid").alias("new_id")))


_PARAS = "SELECT case_id, 'P' || doc_id AS para_id, list_filter(string_split_regex(text, '[.]\\s+'), lambda s: s <> '') AS s FROM documents WHERE case_id IS NOT NULL AND text IS NOT NULL"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("case_id is not null and text is not null")
    return d.select("case_id", F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("para_id"), F.filter(F.split("text", r"[.]\s+"), lambda s: s != "").alias("sentences"))


@query(f"""WITH p AS ({_PARAS}), i AS (SELECT case_id, unnest([para_id, para_id || '.S1', para_id || '.S40', 'Q1']) AS source_id FROM p)
    SELECT DISTINCT i.case_id, source_id, coalesce(CASE WHEN contains(source_id, '.S') THEN s[string_split(source_id, '.S')[2]::INT] ELSE array_to_string(s, ' ') END, '(not found)') AS text FROM i LEFT JOIN p ON p.case_id = i.case_id AND p.para_id = string_split(i.source_id, '.S')[1]""")
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and single sentences of a case's documents by their source ids."""
    p = _paragraphs(spark, sf_dir)
    ids = p.select("case_id", F.explode(F.array("para_id", F.concat("para_id", F.lit(".S1")), F.concat("para_id", F.lit(".S40")), F.lit("Q1"))).alias("source_id")).distinct()
    return records.source_text(ids, p)


@query("""WITH i AS (SELECT DISTINCT case_id, analysis_id AS item_id, unnest(source_paras) AS source_id FROM statutory_analysis WHERE case_id IS NOT NULL), v AS (SELECT DISTINCT case_id, x AS source_id FROM (SELECT case_id, unnest(source_paras) AS x FROM statutory_analysis WHERE act_prefix LIKE 'C%'))
    SELECT case_id, item_id, source_id FROM i ANTI JOIN v USING (case_id, source_id)""")
def invisible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of analyses that no analysis under an act with C shows."""
    a = table(spark, sf_dir, "statutory_analysis").filter("case_id is not null")
    visible = a.filter("act_prefix like 'C%'").select("case_id", F.explode("source_paras").alias("source_id")).distinct()
    return records.invisible_sources(a.select("case_id", F.col("analysis_id").alias("item_id"), F.col("source_paras").alias("sources")), visible)


@query("""WITH c AS (SELECT case_id AS q, precedent_id, precedent_uid AS uid FROM precedents WHERE case_id IS NOT NULL AND precedent_uid IS NOT NULL), n AS (SELECT q, precedent_id AS id, min(uid) AS uid FROM c GROUP BY ALL HAVING count(DISTINCT uid) = 1),
    k AS (SELECT DISTINCT q AS query_id, id, uid FROM (SELECT q, uid AS id, uid FROM c UNION SELECT q, id, uid FROM n)), w AS (SELECT DISTINCT q AS query_id, precedent_id AS id FROM c) SELECT DISTINCT w.query_id, k.uid FROM w JOIN k ON k.query_id = w.query_id AND k.id = w.id""")
def held_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare ids chosen in a case, matched to the cards of that case."""
    c = table(spark, sf_dir, "precedents").filter("case_id is not null and precedent_uid is not null").select(F.col("case_id").alias("query_id"), "precedent_id", F.col("precedent_uid").alias("uid"))
    return reports.held_cards(c.select("query_id", F.col("precedent_id").alias("id")).distinct(), c)


@query("""WITH h AS (SELECT DISTINCT case_id AS query_id, precedent_uid AS uid FROM precedents WHERE case_id IS NOT NULL), k AS (SELECT DISTINCT uid FROM vectors WHERE vec_id % 2 = 0 AND uid IS NOT NULL)
    SELECT query_id, count(*) FILTER (h.uid IS NULL OR h.uid NOT IN (SELECT uid FROM k)) AS n_new, CASE WHEN count(*) FILTER (h.uid IS NULL OR h.uid NOT IN (SELECT uid FROM k)) = 0 THEN 'NOTHING_NEW' ELSE 'NEW' END AS note FROM h GROUP BY query_id""")
def desk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "precedents").filter("case_id is not null").select(F.col("case_id").alias("query_id"), F.col("precedent_uid").alias("uid")).distinct()
    return reports.desk_answers(hits, table(spark, sf_dir, "vectors").filter("vec_id % 2 = 0 and uid is not null"))


@query("""WITH c AS (SELECT case_id AS session_id, uid, min(a) AS a FROM (SELECT case_id, row_no AS a, precedent_uid AS uid FROM precedents WHERE case_id IS NOT NULL AND precedent_uid IS NOT NULL) GROUP BY ALL)
    SELECT session_id, uid, row_number() OVER (PARTITION BY session_id ORDER BY a, uid) AS ord, uid IN (SELECT uid FROM vectors WHERE uid IS NOT NULL) AS found FROM c""")
def fetched_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The precedents a case cites, each once in order, and whether they are embedded."""
    c = table(spark, sf_dir, "precedents").filter("case_id is not null and precedent_uid is not null").select(F.col("case_id").alias("session_id"), F.col("row_no").alias("at"), F.col("precedent_uid").alias("uid"))
    return lookup.fetched(c, table(spark, sf_dir, "vectors").filter("uid is not null"))


@query("""WITH l AS (SELECT row_no AS case_id, list_concat(coalesce(statutes_cited, []), [upper(coalesce(bench, ''))]) AS x FROM (SELECT DISTINCT row_no, statutes_cited, bench FROM precedents)), k AS (SELECT DISTINCT statute_id FROM law WHERE statute_id IS NOT NULL),
    e AS (SELECT case_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM l), f AS (SELECT case_id, s, min(i) AS i FROM e WHERE s IN (SELECT statute_id FROM k) GROUP BY ALL)
    SELECT l.case_id, coalesce(string_agg(s, ',' ORDER BY i), '') AS statutes FROM l LEFT JOIN f ON f.case_id = l.case_id GROUP BY l.case_id""")
def bench_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes that precedents cite, united with another list, those the law holds."""
    p = table(spark, sf_dir, "precedents").select(F.col("row_no").alias("case_id"), "statutes_cited", F.array(F.upper(F.coalesce("bench", F.lit("")))).alias("more")).distinct()
    known = p.select("case_id", F.explode("statutes_cited").alias("statute_id")).distinct().join(table(spark, sf_dir, "law").select("statute_id").distinct(), "statute_id", "left_semi")
    return lookup.bench_statutes(p, ["statutes_cited", "more"], known).select("case_id", F.array_join("statutes", ",").alias("statutes"))


@query("""WITH t AS (SELECT l_orderkey AS query_id, l_linenumber AS ord, repeat('x', (l_quantity + 1)::INT) AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_quantity) = 1),
    w AS (SELECT *, row_number() OVER p AS r, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t WINDOW p AS (PARTITION BY query_id ORDER BY ord))
    SELECT query_id, ord, CASE WHEN length(text) > 60 - b THEN substr(text, 1, (60 - b)::INT) || '…' ELSE text END AS text FROM w WHERE r <= 3 AND b < 60""")
def lookup_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of as many signs as a line's quantity: three, within sixty signs."""
    from pyspark.sql import Window

    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey", "l_quantity"))
    t = table(spark, sf_dir, "lineitem").withColumn("r", one).filter("r = 1").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("ord"), F.expr("repeat('x', cast(l_quantity + 1 as int))").alias("text"))
    return lookup.lookup_budget(t, 3, 60)


@query("SELECT o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate NULLS LAST, o_orderkey) AS seq, o_orderkey AS case_id FROM orders")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.run_order(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderdate").alias("decided"), F.col("o_orderkey").alias("case_id")))


@query("SELECT lesson_no, lesson_type FROM (SELECT DISTINCT lesson_no, lesson_type, severity FROM lessons) QUALIFY row_number() OVER (PARTITION BY lesson_type ORDER BY severity DESC, lesson_no) <= 5")
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest lessons of each type."""
    l = table(spark, sf_dir, "lessons").select("lesson_no", "lesson_type", "severity").distinct()
    return lookup.capped(l, "lesson_type", [F.desc("severity"), F.col("lesson_no")], 5).select("lesson_no", "lesson_type")


@query("""SELECT case_id, concat_ws(chr(10), 'Case ' || case_id, string_agg(ord || '. ' || party_name || ' (' || coalesce(cause_title_role, '-') || ')', chr(10) ORDER BY ord, party_name, coalesce(cause_title_role, '-'))) AS text FROM (SELECT DISTINCT case_id, ord, party_name, cause_title_role FROM parties WHERE case_id IS NOT NULL AND party_name IS NOT NULL) GROUP BY case_id""")
def rendered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's parties as a text."""
    p = table(spark, sf_dir, "parties").filter("case_id is not null and party_name is not null").select("case_id", "ord", "party_name", F.coalesce("cause_title_role", F.lit("-")).alias("role")).distinct()
    line = F.concat(F.col("ord").cast("string"), F.lit(". "), F.col("party_name"), F.lit(" ("), F.col("role"), F.lit(")"))
    return lookup.rendered(p, "case_id", ["ord", "party_name", "role"], F.concat(F.lit("Case "), F.col("case_id")), line)


@query("""SELECT line FROM (SELECT '| source | n |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || coalesce(source, '') || ' | ' || n || ' |' FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source as the lines of a Markdown report."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return files.markdown_rows(n, ["source"]).select("line")


@query("""WITH d AS (SELECT doc_id AS line_no, source AS key, coalesce(text, '') AS value FROM documents), w AS (SELECT source AS key FROM mix_targets WHERE max_repeats > 1) SELECT line_no, md5(value) AS digest, CASE WHEN key IN (SELECT key FROM w) THEN 'moved' ELSE 'kept' END AS part FROM d""")
def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sources that may be repeated move, bytes unchanged, with where they came from."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("file"), F.col("doc_id").alias("line_no"), F.coalesce("text", F.lit("")).alias("value"), F.col("source").alias("key"))
    kept, moved = lookup.moved_lines(d, table(spark, sf_dir, "mix_targets").filter("max_repeats > 1").select(F.col("source").alias("key")))
    return kept.select("line_no", F.md5("value").alias("digest"), F.lit("kept").alias("part")).unionByName(moved.select("line_no", F.md5("value").alias("digest"), F.lit("moved").alias("part")))


@query("SELECT doc_id, substr(sha256(to_json([doc_id::VARCHAR, doc_kind, case_id])), 1, 10) AS short FROM documents")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lookup.short_id(F.col("doc_id"), F.col("doc_kind"), F.col("case_id")).alias("short"))


@query("""WITH i AS (SELECT l_orderkey AS c, l_returnflag AS k, min(l_quantity) AS v FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey AS c, l_linestatus AS k, min(l_shipdate::DATE) AS v FROM lineitem GROUP BY ALL)
    SELECT coalesce(a.c, b.c) AS case_id, a.s AS amounts, b.s AS dates FROM (SELECT c, string_agg(k || '=' || v::INT, ',' ORDER BY k) AS s FROM i GROUP BY c) a FULL JOIN (SELECT c, string_agg(k || '=' || v, ',' ORDER BY k) AS s FROM d GROUP BY c) b ON a.c = b.c""")
def case_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by return flag and dates by line status of each order, as maps."""
    line = table(spark, sf_dir, "lineitem")
    pad = F.lpad(F.col("l_quantity").cast("int").cast("string"), 6, "0")
    items = line.select(F.col("l_orderkey").alias("case_id"), F.lit("AMOUNT").alias("kind"), F.col("l_returnflag").alias("key"), pad.alias("value")).unionByName(line.select(F.col("l_orderkey").alias("case_id"), F.lit("DATE").alias("kind"), F.col("l_linestatus").alias("key"), F.col("l_shipdate").cast("date").cast("string").alias("value")))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(e["value"], "^0+(?=[0-9])", ""))), ",")
    return lookup.case_facts(items).select("case_id", shown("amounts").alias("amounts"), shown("dates").alias("dates"))


@query("""WITH v AS (SELECT doc_id AS view_id, to_json({'a': text, 'b': [lang, source]}) AS j FROM documents WHERE text IS NOT NULL), r AS (SELECT view_id, o, n, ok FROM v, (VALUES ('the', 'THE', true), ('court', 'CRT', false), ('zzqx', 'q', true)) t(o, n, ok))
    SELECT view_id, md5(replace(j, 'the', 'THE')) AS digest, (SELECT count(*) FROM r WHERE r.view_id = v.view_id AND (NOT ok OR NOT contains(v.j, o)))::BIGINT AS refused FROM v""")
def redacted_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word replaced in every nested string of a view; a replacement by a stranger and one that stands nowhere are refused."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    v = d.select(F.col("doc_id").alias("view_id"), F.to_json(F.struct(F.col("text").alias("a"), F.array("lang", "source").alias("b")), {"ignoreNullFields": "false"}).alias("j"))
    r = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"), F.lit(b).alias("by")) for o, n, b in (("the", "THE", "clerk"), ("court", "CRT", "other"), ("zzqx", "q", "clerk"))])
    out, refused = lookup.redacted(v, v.select("view_id", F.inline(r)), ["clerk"], "j")
    n = refused.groupBy("view_id").agg(F.count("*").alias("refused"))
    return out.join(n, "view_id", "left").select("view_id", F.md5("j").alias("digest"), F.coalesce("refused", F.lit(0)).alias("refused"))


# Ledgers and runs, from order lines as stages


@query("SELECT l_returnflag AS stage, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def stage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("status"))).alias("stages"))
    return runlog.stage_matrix(j)


@query("""WITH p AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'TEST' WHEN o_orderstatus = 'O' THEN 'VALIDATION' ELSE 'TRAIN' END AS split FROM orders UNION ALL SELECT o_orderkey, 'TRAIN' FROM orders WHERE o_orderkey % 50 = 0)
    SELECT DISTINCT case_id, 'BARRED_SPLIT' AS rule FROM p WHERE split = 'VALIDATION' UNION ALL SELECT DISTINCT case_id, 'TEST_IN_LEARN' FROM p WHERE split = 'TEST' UNION ALL SELECT case_id, 'PLANNED_TWICE' FROM p GROUP BY 1 HAVING count(*) > 1""")
def plan_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "TEST").when(F.col("o_orderstatus") == "O", "VALIDATION").otherwise("TRAIN").alias("split"))
    return records.plan_guards(o.unionByName(o.filter("case_id % 50 = 0").select("case_id", F.lit("TRAIN").alias("split"))), "LEARN", ["VALIDATION"])


_LEDGER = "SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey AS case_id, o_orderstatus AS s FROM orders"


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, their orders as jobs whose evaluation is done if the order is filled."""
    stages = F.array(F.struct(F.lit("HEAR").alias("stage"), F.lit("DONE").alias("status")), F.struct(F.lit("EVALUATE").alias("stage"), F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("PAUSED").alias("status")))
    job = F.struct(F.col("o_orderkey").alias("case_id"), stages.alias("stages"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("session_id"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))


@query(_LEDGER.replace("SELECT o_custkey", "SELECT run_id, seq, case_id, CASE WHEN s = 'F' THEN 'DONE' ELSE 'PAUSED' END AS evaluated, 'S' || case_id AS session_id FROM (SELECT o_custkey", 1) + ")")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.run_listing(_ledgers(spark, sf_dir))
    return out.select("run_id", "seq", "case_id", F.try_element_at("stages", F.lit("EVALUATE")).alias("evaluated"), "session_id")


@query(f"SELECT run_id, seq, case_id, 'out/' || case_id AS path FROM ({_LEDGER}) WHERE s = 'F' AND case_id % 2 = 0")
def ledger_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome files that exist (of even orders) of the jobs that were evaluated."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("case_id"), F.concat(F.lit("out/"), F.col("o_orderkey").cast("string")).alias("path"))
    return audit.ledger_outcomes(_ledgers(spark, sf_dir), o)


@query("""WITH l AS (SELECT l_suppkey AS run_id, l_orderkey AS job, (l_linenumber, l_returnflag, l_linestatus, l_quantity > 25) AS x, l_returnflag AS stage, l_linestatus AS status, CASE WHEN l_quantity > 25 THEN 'QUOTA' ELSE 'ERROR' END AS reason, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC, l_linestatus DESC, CASE WHEN l_quantity > 25 THEN 'QUOTA' ELSE 'ERROR' END DESC) AS r FROM lineitem)
    SELECT run_id, stage, status, reason, count(*) AS n FROM l WHERE r = 1 GROUP BY ALL""")
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("status"), F.when(F.col("l_quantity") > 25, "QUOTA").otherwise("ERROR").alias("reason"))
    return audit.stop_reasons(s)


@query("""WITH d AS (SELECT l_orderkey AS draft_id, l_linenumber AS o, l_suppkey AS b, CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'REJECTED' ELSE 'DRAFT' END AS s FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY o, b, s) AS r FROM d WHERE s <> 'DRAFT') SELECT d.draft_id, coalesce(max(f.s), 'DRAFT') AS status, max(f.b) AS "by", greatest(count(*) FILTER (d.s <> 'DRAFT') - 1, 0) AS refused FROM d LEFT JOIN f ON f.draft_id = d.draft_id AND f.r = 1 GROUP BY d.draft_id""")
def decided_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.struct("l_linenumber", "l_suppkey", F.when(F.col("l_returnflag") == "A", "APPROVED").otherwise("REJECTED")).alias("ord"), F.when(F.col("l_returnflag") == "A", "APPROVED").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("DRAFT").alias("status"), F.col("l_suppkey").alias("by"))
    return audit.decided_drafts(r)


@query("SELECT user_id AS run_id, bool_and(b IS NOT DISTINCT FROM a) AS frozen FROM (SELECT user_id, event_type AS b, CASE WHEN value > 60 THEN 'x' ELSE event_type END AS a FROM events) GROUP BY 1")
def memory_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("case_id"), F.col("event_type").alias("before"), F.when(F.col("value") > 60, "x").otherwise(F.col("event_type")).alias("after"))
    return reports.memory_proof(e)


@query("""WITH p AS (SELECT min(decided) AS f FROM documents), l AS (SELECT max(created_at::DATE) AS m, count(*) FILTER (created_at IS NULL) AS u FROM lessons) SELECT f::VARCHAR AS first_case, m::VARCHAR AS newest_source, u AS undated, coalesce(f < m, false) OR u > 0 AS refused FROM p, l""")
def lessons_from_the_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.lessons_from_the_future(table(spark, sf_dir, "documents").select("decided"), table(spark, sf_dir, "lessons").select(F.col("created_at").cast("date").alias("source_decided")))
    return out.select(F.col("first_case").cast("string").alias("first_case"), F.col("newest_source").cast("string").alias("newest_source"), "undated", "refused")


@query("""WITH l AS (SELECT DISTINCT lesson_id, party_status AS family FROM lessons WHERE lesson_id IS NOT NULL AND party_status IS NOT NULL), s AS (SELECT DISTINCT user_id AS session_id, CASE user_id % 3 WHEN 0 THEN 'APPELLANT' WHEN 1 THEN 'RESPONDENT' END AS family FROM events)
    SELECT session_id, 'A' AS side, l.lesson_id FROM s JOIN l ON l.family = s.family WHERE session_id % 2 = 0 UNION ALL SELECT session_id, 'A', 'L_' || session_id FROM s WHERE session_id % 2 = 1""")
def served_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions: odd ones have a pinned lesson, even ones those of their family."""
    l = table(spark, sf_dir, "lessons").filter("lesson_id is not null and party_status is not null").select("lesson_id", F.col("party_status").alias("family")).distinct()
    i = F.col("user_id")
    s = table(spark, sf_dir, "events").select(
        i.alias("session_id"), F.lit("A").alias("side"), F.when(i % 3 == 0, "APPELLANT").when(i % 3 == 1, "RESPONDENT").alias("family"), F.when(i % 2 == 1, F.create_map(F.lit("A"), F.array(F.concat(F.lit("L_"), i.cast("string"))))).alias("pins")
    ).dropDuplicates(["session_id"])
    return reports.served_lessons(s, l)


@query("""WITH r AS (SELECT l_orderkey AS s, list_sort(list(DISTINCT 'L' || l_suppkey)) AS m FROM lineitem GROUP BY 1) SELECT o_orderkey AS session_id, array_to_string(list_sort(list_distinct(list_concat(['L1'], CASE WHEN o_orderstatus = 'F' THEN coalesce(m, []) ELSE [] END))), ',') AS lessons FROM orders LEFT JOIN r ON r.s = o_orderkey""")
def recovered_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "REFLECTED").otherwise("RUNNING").alias("state"), F.array(F.lit("L1")).alias("lesson_ids"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("L"), F.col("l_suppkey").cast("string")).alias("lesson_id"))
    return reports.recovered_union(s, r).select("session_id", F.array_join("lesson_ids", ",").alias("lessons"))


@query("""WITH e AS (SELECT user_id AS session_id, ts, 'event' AS kind, event_id::VARCHAR AS payload, NULL AS answer FROM events WHERE event_type <> 'click' UNION ALL SELECT e.user_id, e.ts, 'call', e.event_id::VARCHAR, 'seen ' || event_type FROM events e WHERE event_type = 'click')
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, kind, payload) AS seq, kind, payload, answer FROM e""")
def rebuilt_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores put together as one numbered trace; calls carry the answer the cache holds for them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").cast("string").alias("payload"), "event_type")
    calls = e.filter("event_type = 'click'").select("session_id", "ts", "payload", F.col("event_type").alias("key"))
    cache = calls.select("key").distinct().withColumn("answer", F.concat(F.lit("seen "), "key"))
    return reports.trace_records({"event": e.filter("event_type <> 'click'").drop("event_type"), "call": calls}, cache).select("session_id", "seq", "kind", "payload", "answer")


@query()
def explored_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lessons drawn in each type (seeded draws of Python's generator, so without SQL)."""
    return memory.exploration(table(spark, sf_dir, "lessons").select("lesson_type", "lesson_no").distinct(), ["lesson_type"], "lesson_no", 5, "7")


@query("""SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS requests, round(sum(value), 4) AS units FROM events GROUP BY ALL""".replace("date_trunc('hour', ts) AS h", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h"))
def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by hour and type, read as a stream to its end; no event is late within one read."""
    return cut(logs.drained(logs.windowed_usage(logs.event_stream(spark, f"{sf_dir}/event[s].parquet"), length="1 hour", slide="1 hour"), "streamed_usage")).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("h"), "event_type", "requests", F.round("units", 4).alias("units")
    )


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, count(*) AS n_events, max(event_type) FILTER (r = 1) AS last_kind FROM e GROUP BY user_id""")
def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each session, from the stream."""
    return cut(logs.drained(logs.session_states(logs.event_stream(spark, f"{sf_dir}/event[s].parquet")), "streamed_states")).select("user_id", "n_events", "last_kind")


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS c, o_orderdate AS d, 'issue' || l_linenumber AS i, l_returnflag AS truth FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT g, c, d, count(*) FILTER (truth = 'A') AS a, count(*) FILTER (truth = 'N') AS n, count(*) FILTER (truth = 'R') AS r FROM o GROUP BY ALL),
    w AS (SELECT g, c, coalesce(sum(a) OVER x, 0) AS a, coalesce(sum(n) OVER x, 0) AS n, coalesce(sum(r) OVER x, 0) AS r FROM k WINDOW x AS (PARTITION BY g ORDER BY d, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o.c AS case_id, o.i AS issue_id, truth, CASE WHEN greatest(a, n, r) = 0 OR (a = greatest(a, n, r))::INT + (n = greatest(a, n, r))::INT + (r = greatest(a, n, r))::INT > 1 THEN NULL WHEN a = greatest(a, n, r) THEN 'A' WHEN n = greatest(a, n, r) THEN 'N' ELSE 'R' END AS prediction FROM o JOIN w USING (g, c)""")
def issue_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues (lines) of a case (order) share the majority of a customer's earlier cases."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("d"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("issue"), F.col("l_linenumber").cast("string")).alias("issue_id"), F.col("l_returnflag").alias("truth"))
    out = evaluation.expanding_majority(o.join(l, "case_id"), ["A", "N", "R"], ["g"], ["d", "case_id"], "truth", ["case_id"])
    return out.select("case_id", "issue_id", "truth", "prediction")

