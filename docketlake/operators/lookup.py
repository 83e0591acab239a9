"""Lookups by id, fetches for citations, budgets, renderings, redaction and moves of raw lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_types(law: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(statute_id): statutes of one of these kinds."""
    return law.filter(F.col("jurisdiction_type").isin(*kinds)).select("statute_id").distinct()


def checklist_items(asked: DataFrame, law: DataFrame, lists: Sequence[str], scalars: dict[str, Column]) -> DataFrame:
    """(asked columns, item, problem): the item of a checklist that (field, item_index) names.

    A list field needs an index within the list (NO_INDEX, NO_ITEM), a scalar one refuses an index (INDEX_REFUSED); other
    fields are UNKNOWN_FIELD. asked: rec_no, field, item_index; law: rec_no and the list columns; scalars: field to value.
    """
    j = asked.join(law, "rec_no")
    at = lambda f: F.when((F.col("field") == f) & (F.col("item_index") >= 0), F.try_element_at(F.col(f), (F.col("item_index") + 1).cast("int")))
    size = F.coalesce(*[F.when(F.col("field") == f, F.greatest(F.size(F.col(f)), F.lit(0))) for f in lists])
    is_list, is_scalar, i = F.col("field").isin(*lists), F.col("field").isin(*scalars), F.col("item_index")
    problem = (
        F.when(is_list & i.isNull(), "NO_INDEX").when(is_list & ((i < 0) | (i >= size)), "NO_ITEM").when(is_scalar & i.isNotNull(), "INDEX_REFUSED").when(~is_list & ~is_scalar, "UNKNOWN_FIELD")
    )
    item = F.coalesce(*[at(f) for f in lists], *[F.when(F.col("field") == f, v.cast("string")) for f, v in scalars.items()])
    return j.select(*asked.columns, F.when(problem.isNull(), item).alias("item"), problem.alias("problem"))


def short_id(*columns: Column) -> Column:
    """First ten digits of the sha256 of the values as a JSON array of strings; null is null."""
    return F.substring(F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256), 1, 10)


def case_facts(items: DataFrame) -> DataFrame:
    """(case_id, amounts, dates): a case's amounts by id and dates by label, as maps; of a repeated key the least counts.

    items: case_id, kind (AMOUNT or DATE), key, value. A case's items are few.
    """
    one = items.groupBy("case_id", "kind", "key").agg(F.min("value").alias("value"))
    of = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("key", "value")))))
    return one.groupBy("case_id").agg(of("AMOUNT").alias("amounts"), of("DATE").alias("dates"))


def fetched(cited: DataFrame, stored: DataFrame) -> DataFrame:
    """(session_id, uid, ord, found): each cited uid once, in order of its first citation, with whether it is stored.

    cited: session_id, at (order), uid.
    """
    first = cited.groupBy("session_id", "uid").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "uid"))
    there = stored.select("uid").distinct().withColumn("found", F.lit(True))
    return first.withColumn("ord", n).join(there, "uid", "left").select("session_id", "uid", "ord", F.coalesce("found", F.lit(False)).alias("found"))


def bench_statutes(lists: DataFrame, columns: Sequence[str], resolved: DataFrame) -> DataFrame:
    """(case_id, statutes): the union of several lists of a case, each id once in order, of those with a resolved view.

    resolved: case_id, statute_id.
    """
    empty = F.array().cast("array<string>")
    every = lists.select("case_id", F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in columns])).alias("a"))
    ok = resolved.groupBy("case_id").agg(F.collect_set("statute_id").alias("ok"))
    return every.join(ok, "case_id", "left").select("case_id", F.filter(F.array_compact("a"), lambda s: F.coalesce(F.array_contains("ok", s), F.lit(False))).alias("statutes"))


def run_order(plan: DataFrame) -> DataFrame:
    """(split, seq, case_id): cases in the order of their decision, ties by id, numbered within a split; undated ones last."""
    w = Window.partitionBy("split").orderBy(F.col("decided").asc_nulls_last(), "case_id")
    return plan.select("split", F.row_number().over(w).alias("seq"), "case_id")


def lookup_budget(answers: DataFrame, most: int, budget: int, mark: str = "…") -> DataFrame:
    """(query_id, ord, text): the first `most` answers of a query in order, while their signs last; the one that passes the
    budget is cut and marked, those behind it are left out. answers: query_id, ord, text."""
    w = Window.partitionBy("query_id").orderBy("ord")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = answers.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).withColumn("left", F.lit(budget) - before).filter("left > 0")
    text = F.when(F.length("text") > F.col("left"), F.concat(F.substring(F.col("text"), F.lit(1), F.col("left").cast("int")), F.lit(mark))).otherwise(F.col("text"))
    return t.select("query_id", "ord", text.alias("text"))


def capped(candidates: DataFrame, by: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` candidates of each group in order: a limit that is the feature."""
    w = Window.partitionBy(by).orderBy(*order)
    return candidates.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def record_items(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, item_id, kind, claim): items of a case's lists (see records.flatten_items) by id; unknown ids give null."""
    return asked.select("case_id", "item_id").distinct().join(items.select("case_id", "item_id", "kind", "claim"), ["case_id", "item_id"], "left")


def rendered(lines: DataFrame, key: str, order: Sequence[str], head: Column, line: Column) -> DataFrame:
    """(key, text): a record as text: its head, then a line for each of its rows in order. A record's rows are few."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__l")))), lambda r: r["__l"]), "\n")
    return lines.groupBy(key).agg(F.concat_ws("\n", F.max(head), body).alias("text"))


def redacted(views: DataFrame, replacements: DataFrame, allowed: Sequence[str], json_column: str) -> tuple[DataFrame, DataFrame]:
    """(views with replaced strings, refused replacements): (view_id, old, new, by) in every nested string of a JSON column.

    A replacement is refused if its old text stands nowhere in the view (ABSENT) or `by` is not allowed (NOT_ALLOWED).
    Longer texts are replaced first. Both texts are written as JSON strings, so that quotes inside stay valid.
    """
    inner = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c))), r'^\["|"\]$', "")
    r = replacements.select("view_id", "old", "new", "by", inner("old").alias("o"), inner("new").alias("n")).join(views.select("view_id", F.col(json_column).alias("j")), "view_id")
    reason = F.when(~F.col("by").isin(*allowed), "NOT_ALLOWED").when(~F.contains("j", F.col("o")) | (F.col("old") == ""), "ABSENT")
    r = r.withColumn("reason", reason)
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("o")).alias("l"), "o", "n")))
    use = r.filter("reason is null").groupBy("view_id").agg(ordered.alias("__r"))
    empty = F.array().cast("array<struct<l:int,o:string,n:string>>")
    text = F.aggregate(F.coalesce("__r", empty), F.col(json_column), lambda s, x: F.replace(s, x["o"], x["n"]))
    out = views.join(use, "view_id", "left").withColumn(json_column, text).drop("__r")
    return out, r.filter("reason is not null").select("view_id", "old", "reason")


def moved_lines(lines: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines that stay, lines that go): raw lines (file, line_no, value, key) whose key is wanted go, value untouched, with
    where they came from."""
    keys = wanted.select("key").distinct()
    return lines.join(keys, "key", "left_anti"), lines.join(keys, "key", "left_semi")


def laid_out(df: DataFrame, path: str, date: str, tokens_of: str, key: str) -> None:
    """Writes a table partitioned by year, which date filters prune, and beside it an inverted table of words (word, key)
    sorted by word, so that a word filter skips row groups: what an index is to a store, a layout is to files."""
    from docketlake.functions.text import words

    df.withColumn("year", F.year(date)).repartition("year").write.mode("errorifexists").partitionBy("year").parquet(f"{path}/rows")
    inverted = df.select(F.explode(F.array_distinct(words(F.col(tokens_of)))).alias("word"), key)
    inverted.repartitionByRange("word").sortWithinPartitions("word").write.mode("errorifexists").parquet(f"{path}/words")
