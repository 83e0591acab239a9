"""References to records that do not exist, by runs of integer parent keys and an as-of match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.plans.session import cut

#: Integers of one run partition; runs are cut at its multiples, which bounds what one window group can hold.
BUCKET = 1 << 16
#: References to one id that meet its validity in one task; the validity of an id with more is copied once for so many.
HOT = 100_000


def normal_id(c: Column) -> Column:
    return F.upper(F.trim(c))


def _parts(c: Column) -> list[Column]:
    """An id as (stem, number); the two put together give the id again. Ids without a number have number -1."""
    number = F.regexp_extract(c, "(0|[1-9][0-9]{0,15})$", 1)
    has = number != ""
    stem = F.when(has, F.expr("substring(id, 1, length(id) - length(regexp_extract(id, '(0|[1-9][0-9]{0,15})$', 1)))")).otherwise(c)
    n = F.when(has, number.try_cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return [stem.alias("stem"), n.alias("n")]


def key_runs(ids: DataFrame) -> DataFrame:
    """Runs (stem, bucket, first, last) of contiguous numbers of the distinct ids in column id."""
    keys = ids.select("id").distinct().select(*_parts(F.col("id"))).withColumn("bucket", F.floor(F.col("n") / BUCKET))
    w = Window.partitionBy("stem", "bucket").orderBy("n")
    return (
        keys.withColumn("island", F.col("n") - F.row_number().over(w))
        .groupBy("stem", "bucket", "island")
        .agg(F.min("n").alias("first"), F.max("n").alias("last"))
        .drop("island")
    )


def known_ids(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, known) for each distinct wanted id: an as-of match to the last run that starts at or before its number."""
    asked = (
        wanted.select("id").distinct().select("id", *_parts(F.col("id")))
        .withColumn("bucket", F.floor(F.col("n") / BUCKET))
        .select("id", "stem", "bucket", "n", F.lit(None).cast("bigint").alias("last"), F.lit(1).alias("side"))
    )
    starts = runs.select(
        F.lit(None).cast("string").alias("id"), "stem", "bucket", F.col("first").alias("n"), "last", F.lit(0).alias("side")
    )
    w = Window.partitionBy("stem", "bucket").orderBy("n", "side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        starts.unionByName(asked)
        .withColumn("run_end", F.last("last", ignorenulls=True).over(w))
        .filter("side = 1")
        .select("id", F.coalesce(F.col("n") <= F.col("run_end"), F.lit(False)).alias("known"))
    )


def validity(parents: DataFrame) -> DataFrame:
    """(id, first_loaded, spans) from rows (id, start, end): spans are the merged, ordered times at which the id holds.

    A null end still holds; a null start never began. Spans that touch or overlap become one.
    """
    spans = parents.filter("start is not null and (end is null or end > start)").select("id", "start", "end").distinct()
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    spans = spans.withColumn("end", F.coalesce(F.col("end").cast("timestamp_ntz"), far)).withColumn("start", F.col("start").cast("timestamp_ntz"))
    w = Window.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        spans.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "island").agg(F.struct(F.min("start").alias("s"), F.max("end").alias("e")).alias("span"))
        .groupBy("id").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    )
    first = parents.groupBy("id").agg(F.min(F.col("start").cast("timestamp_ntz")).alias("first_loaded"))
    return first.join(merged, "id", "left")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose id holds in no parent record at the time they are made.

    refs: ref_table, ref_id, id, t (the time). parents: id, start, end. Ids must be normalised by the caller.
    Returns the distinct rows (ref_table, ref_id, missing_id, reason, ref_month): `missing` if no parent ever has the
    id, `deleted` if one was loaded by then, `late` if all were loaded later. Null and blank ids are no references.
    A reference without a time can only be `missing` (month null). No refs: no rows; no parents: all are missing.

    Plan: parent ids become runs per stem; the distinct referenced ids (not the references) are matched to them;
    references then meet one row an id; the row of an id with more than HOT references is copied, and they are salted.
    """
    refs = refs.filter("id is not null and id <> ''").select("ref_table", "ref_id", "id", F.col("t").cast("timestamp_ntz").alias("t")).distinct()
    parents = parents.filter("id is not null and id <> ''")
    asked = cut(refs.groupBy("id").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")))
    info = known_ids(asked, key_runs(parents)).join(validity(parents), "id", "left")
    hot = cut(asked.filter("salts > 1"))
    on = ["id"]
    if not hot.isEmpty():
        every, own = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)), F.pmod(F.xxhash64("ref_id", "t"), F.coalesce("salts", F.lit(1)))
        info = info.join(hot, "id", "left").withColumn("salt", every).drop("salts")
        refs = refs.join(hot, "id", "left").withColumn("salt", own.cast("int")).drop("salts")
        on = ["id", "salt"]
    holds = F.exists("spans", lambda s: (s["s"] <= F.col("t")) & (F.col("t") < s["e"]))
    reason = (
        F.when(~F.col("known"), "missing")
        .when(F.col("t").isNull() | F.coalesce(holds, F.lit(False)), None)
        .when(F.col("first_loaded") <= F.col("t"), "deleted")
        .otherwise("late")
    )
    return (
        refs.join(info, on)
        .select("ref_table", "ref_id", F.col("id").alias("missing_id"), reason.alias("reason"), F.date_format("t", "yyyy-MM").alias("ref_month"))
        .filter("reason is not null")
        .distinct()
    )
