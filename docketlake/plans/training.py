"""Queries of the general training-data problems, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators import drift, references, snapshots
from docketlake.plans.session import table

SNAPSHOT_META = ("snapshot_date", "source_file")
LAW_CONTENT = (
    "act_name", "section_number", "section_title", "jurisdiction_type", "forum_level", "statutory_summary", "core_judicial_inquiry",
    "intersecting_statute_ids", "diagnostic_checklist", "procedural_timelines", "audit_error_codes",
)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "law_snapshots"), "statute_id", "snapshot_no", "received_at", SNAPSHOT_META)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_records"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    law, analyses = table(spark, sf_dir, "law"), table(spark, sf_dir, "statutory_analysis")
    ours = law.select(F.lit("law").alias("ref_table"), F.col("rec_no").alias("ref_id"), F.explode("intersecting_statute_ids").alias("id"), F.col("loaded_at").alias("t"))
    theirs = analyses.select(F.lit("statutory_analysis").alias("ref_table"), F.col("analysis_id").alias("ref_id"), F.explode("interacts_with").alias("id"), F.col("recorded_at").alias("t"))
    refs = ours.unionByName(theirs).withColumn("id", references.normal_id(F.col("id")))
    parents = law.select(references.normal_id(F.col("statute_id")).alias("id"), F.col("loaded_at").alias("start"), F.col("removed_at").alias("end"))
    return refs, parents


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_references(*_references(spark, sf_dir))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and reason. Counts references; distinct ids beside them."""
    return p3_found(spark, sf_dir).groupBy("ref_table", "ref_month", "reason").agg(
        F.count("*").alias("n_references"), F.countDistinct("missing_id").alias("n_ids")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "law_files"), "statute_id")


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified_records(table(spark, sf_dir, "law_files"), "statute_id")


_LATEST = """WITH s AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, statute_id ORDER BY received_at DESC) AS rn FROM law_snapshots
    WHERE snapshot_no IS NOT NULL AND statute_id IS NOT NULL) WHERE rn = 1),
v AS (SELECT snapshot_no AS newer, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS older FROM (SELECT DISTINCT snapshot_no FROM s)),
o AS (SELECT v.newer AS snapshot_no, s.* EXCLUDE (snapshot_no) FROM v JOIN s ON s.snapshot_no = v.older),
n AS (SELECT s.* FROM v JOIN s ON s.snapshot_no = v.newer WHERE v.older IS NOT NULL),
c AS (SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.statute_id, o.statute_id) AS statute_id,
  CASE WHEN o.statute_id IS NULL THEN 'inserted' WHEN n.statute_id IS NULL THEN 'removed'
       WHEN """ + " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in LAW_CONTENT) + """ THEN 'updated' END AS change_kind
  FROM n FULL JOIN o ON n.snapshot_no = o.snapshot_no AND n.statute_id = o.statute_id)
"""

_ORPHANS = """WITH r AS (
  SELECT DISTINCT ref_table, ref_id, upper(trim(id)) AS id, t FROM (
    SELECT 'law' AS ref_table, rec_no AS ref_id, unnest(intersecting_statute_ids) AS id, loaded_at AS t FROM law
    UNION ALL SELECT 'statutory_analysis', analysis_id, unnest(interacts_with), recorded_at FROM statutory_analysis)
  WHERE id IS NOT NULL AND trim(id) <> ''),
p AS (SELECT DISTINCT upper(trim(statute_id)) AS id, loaded_at, removed_at FROM law),
k AS (SELECT r.ref_table, r.ref_id, r.id, r.t, count(p.id) AS known,
    coalesce(bool_or(p.loaded_at <= r.t AND (p.removed_at IS NULL OR r.t < p.removed_at)), false) AS holds, min(p.loaded_at) AS first
  FROM r LEFT JOIN p ON p.id = r.id GROUP BY ALL),
f AS (SELECT DISTINCT ref_table, ref_id, id AS missing_id,
    CASE WHEN known = 0 THEN 'missing' WHEN first <= t THEN 'deleted' ELSE 'late' END AS reason, strftime(t, '%Y-%m') AS ref_month
  FROM k WHERE known = 0 OR (t IS NOT NULL AND NOT holds))
"""

_DRIFT = """WITH RECURSIVE l AS (
  SELECT feed, file_name, file_date, raw_json AS raw, max((received_at, line_no)) AS at_ FROM law_files
  WHERE feed IS NOT NULL AND file_name IS NOT NULL AND file_date IS NOT NULL AND json_valid(raw_json) AND json_type(raw_json) = 'OBJECT' GROUP BY ALL),
r AS (SELECT row_number() OVER () AS i, *, CASE WHEN json_type(raw, '$.statute_id') <> 'NULL' THEN coalesce(json_extract_string(raw, '$.statute_id'), '') END AS rid FROM l),
w AS (
  SELECT i, k AS path, json_extract(raw, '$."' || k || '"') AS v FROM r, unnest(json_keys(raw)) u(k)
  UNION ALL SELECT i, path || '.' || k, json_extract(v, '$."' || k || '"') FROM w, unnest(json_keys(v)) u(k) WHERE json_type(v) = 'OBJECT'),
e AS (SELECT i, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind,
  CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(v AS DOUBLE)::VARCHAR WHEN json_type(v) <> 'NULL' THEN CAST(v AS VARCHAR) END AS val FROM w),
p AS (SELECT feed, file_name, path, arg_min(kind, (-n, kind)) FILTER (kind IS NOT NULL) AS kind FROM (SELECT feed, file_name, path, kind, count(*) AS n FROM e JOIN r USING (i) GROUP BY ALL) GROUP BY ALL),
d AS (SELECT feed, file_date, max(file_name) AS name FROM r GROUP BY ALL), b AS (SELECT feed, file_date, lag(name) OVER (PARTITION BY feed ORDER BY file_date) AS older FROM d),
f AS (SELECT DISTINCT feed, file_name, older FROM (SELECT DISTINCT feed, file_name, file_date FROM r) JOIN b USING (feed, file_date) WHERE older IS NOT NULL),
n AS (SELECT f.feed, f.file_name, path, kind, 1 AS one FROM f JOIN p ON p.feed = f.feed AND p.file_name = f.file_name), o AS (SELECT f.feed, f.file_name, path, kind, 1 AS one FROM f JOIN p ON p.feed = f.feed AND p.file_name = f.older),
c AS (SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.file_name, o.file_name) AS file_name, coalesce(n.path, o.path) AS path, CASE WHEN o.one IS NULL THEN 'added' WHEN n.one IS NULL THEN 'removed' WHEN o.kind <> n.kind THEN 'retyped' END AS change, o.kind || '>' || n.kind AS types
  FROM n FULL JOIN o ON n.feed = o.feed AND n.file_name = o.file_name AND n.path = o.path),
x AS (SELECT * FROM c WHERE change IS NOT NULL), t AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.feed = x.feed AND y.file_name = x.file_name AND starts_with(x.path, y.path || '.'))),
s AS (SELECT i, feed, file_name, rid FROM r WHERE rid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feed, file_name, rid ORDER BY at_ DESC) = 1),
g AS (SELECT f.feed, f.file_name, a.i AS ni, z.i AS oi FROM f JOIN s a ON a.feed = f.feed AND a.file_name = f.file_name JOIN s z ON z.feed = f.feed AND z.file_name = f.older AND z.rid = a.rid),
q AS (SELECT a.feed, a.file_name, a.path AS new, z.path AS old FROM t a JOIN t z ON z.feed = a.feed AND z.file_name = a.file_name WHERE a.change = 'added' AND z.change = 'removed'),
m AS (SELECT q.feed, q.file_name, q.new, q.old, count(*) FILTER (nv.val IS NOT NULL OR ov.val IS NOT NULL) AS every, count(*) FILTER (nv.val = ov.val) AS same
  FROM q JOIN g ON g.feed = q.feed AND g.file_name = q.file_name LEFT JOIN e nv ON nv.i = g.ni AND nv.path = q.new LEFT JOIN e ov ON ov.i = g.oi AND ov.path = q.old GROUP BY ALL),
k AS (SELECT * FROM m WHERE every >= 3 AND same * 10 >= every * 9)
SELECT feed, file_name, path AS field_path, change AS change_kind, CASE WHEN change = 'retyped' THEN types ELSE '' END AS detail FROM t
  WHERE NOT (change = 'added' AND EXISTS (SELECT 1 FROM k WHERE k.feed = t.feed AND k.file_name = t.file_name AND k.new = t.path)) AND NOT (change = 'removed' AND EXISTS (SELECT 1 FROM k WHERE k.feed = t.feed AND k.file_name = t.file_name AND k.old = t.path))
UNION ALL SELECT feed, file_name, new, 'renamed', old FROM k"""

QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_report, p4_found, p4_unified)}
SQL = {
    "p1_found": _LATEST + "SELECT * FROM c WHERE change_kind IS NOT NULL",
    "p1_counts": _LATEST + "SELECT snapshot_no, change_kind, count(*) AS n_records FROM c WHERE change_kind IS NOT NULL GROUP BY ALL",
    "p3_found": _ORPHANS + "SELECT * FROM f",
    "p4_found": _DRIFT,
    "p3_report": _ORPHANS + "SELECT ref_table, ref_month, reason, count(*) AS n_references, count(DISTINCT missing_id) AS n_ids FROM f GROUP BY ALL",
}
