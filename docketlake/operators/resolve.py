"""Citations to statute ids: a cascade of equi-joins, the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rewrite_alias(citations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `aliased`: the citation with its longest aliased prefix replaced; null where none fits.

    citations: citation; aliases: cited_prefix (unique), law_db_prefix. Each citation's prefixes at token ends are
    exploded, so the join is on equality.
    """
    prefixes = F.expr("transform(sequence(1, size(split(citation, '_'))), i -> array_join(slice(split(citation, '_'), 1, i), '_'))")
    hits = citations.select("citation").distinct().withColumn("cited_prefix", F.explode(prefixes)).join(aliases, "cited_prefix")
    best = hits.groupBy("citation").agg(F.max(F.struct(F.length("cited_prefix").alias("l"), "law_db_prefix")).alias("b"))
    rewritten = F.concat("b.law_db_prefix", F.expr("substring(citation, b.l + 1)"))
    return citations.join(best.select("citation", rewritten.alias("aliased")), "citation", "left")


def resolve(citations: DataFrame, known: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(citation, statute_id, rule) of each distinct citation.

    Rules in order: exact; bracket (A_5(2) as A_5_2); stripped (brackets dropped); prefix (longest known id that is a
    prefix of two tokens or more); spelling (the one known id with the same last token whose tokens hold all of the
    citation's); then the first three on the upper-cased, blank-free spelling; then on the alias. Nothing fits: null.
    """
    ids = known.select(F.col("statute_id").alias("id")).distinct()
    c = citations.select("citation").filter("citation is not null").distinct()
    normal = F.regexp_replace(F.upper(F.trim("citation")), r"[\s.-]+", "_")
    forms = c.withColumn("normal", normal)
    if aliases is not None:
        forms = forms.join(rewrite_alias(c, aliases).select("citation", "aliased").distinct(), "citation", "left")
    else:
        forms = forms.withColumn("aliased", F.lit(None).cast("string"))

    def tries(column: str, rank: int, tag: str) -> list:
        x = F.col(column)
        return [
            F.struct(F.lit(rank).alias("rank"), F.lit(f"{tag}exact").alias("rule"), x.alias("id")),
            F.struct(F.lit(rank + 1).alias("rank"), F.lit(f"{tag}bracket").alias("rule"), F.regexp_replace(F.regexp_replace(x, r"\)\(|\(", "_"), r"\)", "").alias("id")),
            F.struct(F.lit(rank + 2).alias("rank"), F.lit(f"{tag}stripped").alias("rule"), F.regexp_replace(x, r"\([^)]*\)", "").alias("id")),
        ]

    direct = forms.select("citation", F.explode(F.array(*tries("citation", 0, ""), *tries("normal", 20, "normal_"), *tries("aliased", 30, "alias_"))).alias("t")).select("citation", "t.*").filter("id is not null")
    hit = direct.join(ids, "id").select("citation", "rank", "rule", "id")
    prefixes = F.expr("transform(filter(sequence(2, greatest(size(split(citation, '_')), 2)), i -> i <= size(split(citation, '_'))), i -> array_join(slice(split(citation, '_'), 1, i), '_'))")
    longest = c.select("citation", F.explode(prefixes).alias("id")).join(ids, "id").groupBy("citation").agg(F.max(F.struct(F.length("id").alias("l"), "id"))["id"].alias("id"))
    hit = hit.unionByName(longest.select("citation", F.lit(10).alias("rank"), F.lit("prefix").alias("rule"), "id"))
    tokens = lambda x: F.split(x, "_")
    # Both share the last token and every other token of the citation: they meet on the last and the longest of these.
    key = lambda c, t: F.concat_ws(" ", F.element_at(tokens(F.col(c)), -1), t)
    longest = F.array_max(F.transform(tokens(F.col("citation")), lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))["t"]
    spelled = (
        c.withColumn("last", key("citation", longest)).join(ids.withColumn("t", F.explode(F.array_distinct(tokens(F.col("id"))))).withColumn("last", key("id", F.col("t"))).drop("t"), "last")
        .filter((F.col("id") != F.col("citation")) & (F.size(F.array_except(tokens(F.col("citation")), tokens(F.col("id")))) == 0) & (F.size(tokens(F.col("citation"))) > 1))
        .groupBy("citation").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    )
    hit = hit.unionByName(spelled.select("citation", F.lit(11).alias("rank"), F.lit("spelling").alias("rule"), "id"))
    best = hit.groupBy("citation").agg(F.min(F.struct("rank", "rule", "id")).alias("b"))
    return c.join(best, "citation", "left").select("citation", F.col("b.id").alias("statute_id"), F.col("b.rule").alias("rule"))


def contained(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, a, b): statutes of two sets per key that are equal, or one the other with more after an underscore.

    left: key, a; right: key, b. Prefixes are exploded on both sides; no theta join.
    """

    def ups(c: str):
        return F.expr(f"transform(sequence(1, size(split({c}, '_'))), i -> array_join(slice(split({c}, '_'), 1, i), '_'))")

    down = left.withColumn("p", F.explode(ups("a"))).join(right.withColumn("p", F.col("b")), [key, "p"])
    up = right.withColumn("p", F.explode(ups("b"))).join(left.withColumn("p", F.col("a")), [key, "p"])
    return down.select(key, "a", "b").unionByName(up.select(key, "a", "b")).distinct()


def unmatched_targets(aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Aliases whose target is a prefix of no known id."""
    tops = known.select(F.explode(F.expr("transform(sequence(1, size(split(statute_id, '_'))), i -> array_join(slice(split(statute_id, '_'), 1, i), '_'))")).alias("law_db_prefix")).distinct()
    return aliases.join(tops, "law_db_prefix", "left_anti")


def related(law: DataFrame) -> DataFrame:
    """(rec_no, related): the references of a record that exist, each once, in the record's order."""
    refs = law.select("rec_no", F.posexplode("intersecting_statute_ids").alias("pos", "id")).filter("id is not null")
    there = refs.join(law.select(F.col("statute_id").alias("id")).distinct(), "id", "left_semi")
    first = there.groupBy("rec_no", "id").agg(F.min("pos").alias("pos"))
    return first.groupBy("rec_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("related"))


def rewrite_references(law: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(rec_no, references): dangling references with exactly one suggestion rewritten, then each once in order.

    suggestions: missing_id, suggestion.
    """
    one = suggestions.groupBy("missing_id").agg(F.count_distinct("suggestion").alias("n"), F.min("suggestion").alias("new")).filter("n = 1").select(F.col("missing_id").alias("id"), "new")
    refs = law.select("rec_no", F.posexplode("intersecting_statute_ids").alias("pos", "id")).filter("id is not null").join(one, "id", "left")
    return refs.groupBy("rec_no").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "id").alias("id")))), lambda s: s["id"])).alias("references"))
