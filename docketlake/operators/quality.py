"""Data-quality rules: one row per problem (table, key, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, table: str, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each rule (name: condition of the problem, detail) that a row breaks. A null condition is no problem."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (bad, detail) in rules.items()]))
    return rows.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.inline(found))


def law_hygiene(law: DataFrame) -> DataFrame:
    """No codes, codes that aren't upper case, repeated codes, self-reference, repeated references, of each record."""
    codes = F.filter(F.coalesce("audit_error_codes", F.array().cast("array<string>")), lambda c: c.isNotNull())
    refs = F.filter(F.coalesce("intersecting_statute_ids", F.array().cast("array<string>")), lambda c: c.isNotNull())
    odd = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c != F.upper(c))))
    return problems(
        law, "law", "rec_no",
        {
            "NO_CODES": (F.size(codes) == 0, F.lit("")),
            "CODE_NOT_UPPER": (F.size(odd) > 0, F.array_join(odd, ",")),
            "REPEATED_CODE": (F.size(F.array_distinct(codes)) < F.size(codes), F.size(codes) - F.size(F.array_distinct(codes))),
            "SELF_REFERENCE": (F.array_contains(refs, F.col("statute_id")), F.col("statute_id")),
            "REPEATED_REFERENCE": (F.size(F.array_distinct(refs)) < F.size(refs), F.size(refs) - F.size(F.array_distinct(refs))),
        },
    )


def exactly_one(labels: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, problem): expected keys without a label (MISSING), with several (REPEATED), and labels of no key (UNKNOWN)."""
    n = labels.groupBy(key).agg(F.count("*").alias("n"))
    e = expected.select(key).distinct().withColumn("wanted", F.lit(True))
    p = F.when(F.col("wanted").isNull(), "UNKNOWN").when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "REPEATED")
    return n.join(e, key, "full").select(key, p.alias("problem")).filter("problem is not null")


def unlike(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, values): groups with more than one distinct value, sorted; nulls are none."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("values")).filter("size(values) > 1")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def dangling_by(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, by: str) -> DataFrame:
    """(missing_id, referenced_by, n_rows): as dangling, one row for each missing key and each `by` that refers to it; a
    row each, not a list, so that a key with many referrers stays many rows."""
    n = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("missing_id"), F.col(by).alias("referenced_by")).agg(F.count("*").alias("n_rows"))
    return n.join(parent.select(F.col(parent_key).alias("missing_id")).distinct(), "missing_id", "left_anti")


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(missing_id, n_rows): keys of child rows that no parent row has. Counted before the join, so a hot key is one row."""
    n = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("missing_id")).agg(F.count("*").alias("n_rows"))
    return n.join(parent.select(F.col(parent_key).alias("missing_id")).distinct(), "missing_id", "left_anti")


def agreement(primary: DataFrame, secondary: DataFrame, slot: str, key: str) -> DataFrame:
    """(slot, key, state): AGREED, PRIMARY_ONLY, SECONDARY_ONLY as multisets; DISAGREED where a slot has unlike keys."""
    from pyspark.sql import Window

    w = Window.partitionBy(slot, key).orderBy(F.lit(0))
    p = primary.select(slot, key).withColumn("n", F.row_number().over(w)).withColumn("p", F.lit(True))
    s = secondary.select(slot, key).withColumn("n", F.row_number().over(w)).withColumn("s", F.lit(True))
    j = p.join(s, [slot, key, "n"], "full").withColumn("state", F.when(F.col("p") & F.col("s"), "AGREED").when(F.col("p"), "PRIMARY_ONLY").otherwise("SECONDARY_ONLY"))
    sides = j.filter("state <> 'AGREED'").groupBy(slot).agg((F.count_distinct("state") == 2).alias("clash"))
    return j.join(sides, slot, "left").select(slot, key, F.when((F.col("state") != "AGREED") & F.col("clash"), "DISAGREED").otherwise(F.col("state")).alias("state"))
