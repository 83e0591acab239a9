"""Queries of the training-data problems about text and vectors, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import mixture, mojibake, neardup, neighbours, personal, tokenize
from docketlake.plans.session import cut, table


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text segments that carry personal information, in rows (src, row_id, seg, text)."""
    facts = table(spark, sf_dir, "precedents").select(F.lit("precedents").alias("src"), F.col("row_no").alias("row_id"), F.posexplode("facts_texts").alias("seg", "text"))
    said = table(spark, sf_dir, "statutory_analysis").select(F.lit("statutory_analysis").alias("src"), F.col("analysis_id").alias("row_id"), F.lit(0).alias("seg"), F.col("interpretation").alias("text"))
    return facts.unionByName(said)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    return personal.find(segments, personal.fitted(segments), ["src", "row_id", "seg"]).select("src", "row_id", "seg", "kind", "pii_text").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment that has any, with typed placeholders in place of personal information."""
    segments = _segments(spark, sf_dir)
    return personal.redact(segments, personal.fitted(segments), ["src", "row_id", "seg"]).filter("n_found > 0").distinct()


VECTORS = (("lessons", "lesson_no"), ("vectors", "vec_id"))


def _close(spark: SparkSession, sf_dir: str, name: str, id: str) -> DataFrame:
    return neighbours.most_similar(table(spark, sf_dir, name), id, "vec", least=0.9, ef=16, gap=0.14)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.90 or more that are among the ten most similar of either row; every row is a query."""
    parts = []
    for name, id in VECTORS:
        near = _close(spark, sf_dir, name, id)
        parts.append(near.select(F.lit(name).alias("src"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct())
    return parts[0].unionByName(parts[1])


def _searched(spark: SparkSession, sf_dir: str, name: str, id: str) -> DataFrame:
    return neighbours.most_similar(table(spark, sf_dir, name), id, "vec", asks=F.col(id) % 20 == 0)


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of all rows, for every row whose id is divisible by 20."""
    parts = [_searched(spark, sf_dir, name, id).select(F.lit(name).alias("src"), "id_a", "id_b", "similarity") for name, id in VECTORS]
    return parts[0].unionByName(parts[1])


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against brute force, per table: of p5_nearest, and of p5_found, whose rows are those of similarity 0.90 or more."""
    out = None
    for name, id in VECTORS:
        rows = table(spark, sf_dir, name)
        for search, found, least in (("p5_nearest", _searched(spark, sf_dir, name, id), -2.0), ("p5_found", _close(spark, sf_dir, name, id), 0.9)):
            one = neighbours.recall(cut(found), rows, id, "vec", least=least, asks=F.col("id") % 20 == 0).select(F.lit(search).alias("search"), F.lit(name).alias("src"), "n_queries", "recall")
            out = one if out is None else out.unionByName(one)
    return out


def _precedent_sets(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    text = F.concat_ws(" ", "facts_texts", "ratio_text")  # null elements and null parts add nothing
    return neardup.documents(table(spark, sf_dir, "precedents"), "row_no", text, words)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of similar rows, copies among them; a text that stands in n rows makes n (n - 1) / 2 pairs."""
    pairs = neardup.Similar(_precedent_sets(spark, sf_dir, 3), 0.6).pairs()
    return pairs.select(F.col("a").alias("row_no_a"), F.col("b").alias("row_no_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every precedent row with its group and number of links, by five words and a similarity of 0.8."""
    return neardup.Similar(_precedent_sets(spark, sf_dir, 5), 0.8).groups().withColumnRenamed("id", "row_no")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf_dir, "documents"), ["doc_id"])


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and texts per source and language; null and empty texts count as texts without tokens."""
    counted = tokenize.token_counts(table(spark, sf_dir, "documents"), ["source", "lang"])
    return counted.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("act_prefix", "topic")
    return tokenize.token_counts(docs, ["doc_id", "source", "lang", "topic"])


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = cut(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets")
    return mixture.report(cut(mixture.mix(docs, targets)), docs, targets)


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repaired(spark, sf_dir).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p5_found, p5_nearest, p5_recall, p6_found, p6_groups, p7_ids, p7_totals, p8_mixture, p8_report, p9_found, p9_repaired)}

_NEAR = """WITH v AS (SELECT {id} AS id, any_value(vec)::DOUBLE[] AS vec FROM {name} WHERE vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 AND {id} IS NOT NULL GROUP BY 1),
    p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vec, b.vec) AS s FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p WHERE s >= 0.9)
    SELECT DISTINCT '{name}' AS src, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 10"""

#: Brute force, which small tables allow.
SQL: dict[str, str] = {
    "p5_found": " UNION ALL ".join(f"SELECT * FROM ({_NEAR.format(name=name, id=id)})" for name, id in VECTORS),
    "p6_found": """WITH t AS (SELECT row_no, regexp_extract_all(lower(concat_ws(' ', array_to_string(list_filter(any_value(facts_texts), lambda x: x IS NOT NULL), ' '), any_value(ratio_text))), '[\\p{L}\\p{N}]+') AS w FROM precedents GROUP BY row_no),
    s AS (SELECT row_no, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 3), e AS (SELECT row_no, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.row_no AS row_no_a, b.row_no AS row_no_b, a.n + b.n AS n, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.row_no < b.row_no GROUP BY ALL) SELECT row_no_a, row_no_b FROM p WHERE c >= 0.6 * (n - c) - 1e-9""",
}
