"""Lessons: which may be used, how they rank, and a greedy pick within a budget."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_lessons(
    lessons: DataFrame, status: str, statutes: list[str], versions: dict[str, str] | None = None, families: dict[str, str] | None = None, unkeyed: list[str] | None = None
) -> DataFrame:
    """ACTIVE lessons of the status, or of another of its family, whose keys are empty or among the statutes.

    Null keys count as none, and so do those in `unkeyed`. families: status to family. With versions, a lesson whose map
    `law_versions` names another version of a shared statute is left out.
    """
    keys = F.filter(F.coalesce("statute_ids", F.array().cast("array<string>")), lambda k: k.isNotNull())
    if unkeyed:
        keys = F.array_except(keys, F.array(*map(F.lit, unkeyed)))
    wanted = F.array(*map(F.lit, statutes)).cast("array<string>")
    family = (families or {}).get(status)
    sides = {status, *(s for s, f in (families or {}).items() if family is not None and f == family)}
    out = lessons.filter((F.col("status") == "ACTIVE") & F.col("party_status").isin(*sorted(sides)) & ((F.size(keys) == 0) | F.arrays_overlap(keys, wanted)))
    if versions:
        now = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
        out = out.filter(F.forall(F.map_entries("law_versions"), lambda e: F.coalesce(F.try_element_at(now, e["key"]) == e["value"], F.lit(True))))
    return out


def ranked(lessons: DataFrame, by: list[str], score: Column, id: str, k: int) -> DataFrame:
    """Adds `rank`, from 1: the k lessons of the highest score in each group, ties by id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id)
    return lessons.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def budget_pick(ranked: DataFrame, by: list[str], order: list[Column], id: str, tokens: str, budget: int, k: int) -> DataFrame:
    """(by, picked): ids taken in rank order while they fit: one too big is skipped and the walk goes on, until k are taken.

    A fold over each group's ordered candidates; a plain running sum would stop at the first that is too big. A group of
    any size stays small: of candidates of equal cost only the first k in rank order can be taken, so the fold sees at
    most k rows for each cost up to the budget.
    """
    groups = ranked.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
    cheap = Window.partitionBy(*by, tokens).orderBy(*order)
    ranked = ranked.filter(F.col(tokens) <= budget).withColumn("__c", F.row_number().over(cheap)).filter(F.col("__c") <= k).drop("__c")
    w = Window.partitionBy(*by).orderBy(*order)
    items = ranked.withColumn("__r", F.row_number().over(w)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__r", F.col(id).alias("i"), F.col(tokens).cast("bigint").alias("t")))).alias("c"))
    kind = dict(ranked.dtypes)[id]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("p"), F.lit(0).cast("bigint").alias("u"))

    def step(s: Column, x: Column) -> Column:
        fits = (F.size(s["p"]) < k) & (s["u"] + x["t"] <= budget)
        return F.struct(F.when(fits, F.concat(s["p"], F.array(x["i"]))).otherwise(s["p"]).alias("p"), F.when(fits, s["u"] + x["t"]).otherwise(s["u"]).alias("u"))

    groups = groups.join(items, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by], "left").select(*[F.col(f"__{c}").alias(c) for c in by], "c")
    return groups.select(*by, F.aggregate(F.coalesce("c", F.array().cast(items.schema["c"].dataType)), start, step)["p"].alias("picked"))


def exploration(rest: DataFrame, by: list[str], id: str, n: int, seed: str) -> DataFrame:
    """(by, drawn): a seeded sample of each group's ids, the same draw as Python's Random of that seed on the sorted ids.

    The draw depends on a group's size alone, so only sizes go to Python; the places drawn are then looked up by their
    rank, which Spark's sort gives for a group of any size.
    """

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        key = ":".join(str(pdf[c].iloc[0]) for c in by)
        size = int(pdf["__n"].iloc[0])
        at = random.Random(f"{seed}:{key}").sample(range(size), min(n, size))
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | {"__r": i + 1} for i in at])

    kinds = dict(rest.dtypes)
    sizes = rest.groupBy(*by).agg(F.count("*").alias("__n"))
    drawn = sizes.groupBy(*by).applyInPandas(places, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "__r int"]))
    ranked = rest.select(*by, id).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(id)))
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by]
    places_of = drawn.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__r").alias("__at"))
    met = ranked.join(places_of, [*same, F.col("__r") == F.col("__at")])
    return met.groupBy(*by).agg(F.array_sort(F.collect_list(id)).alias("drawn"))
