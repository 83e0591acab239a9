"""Call logs, quotas, ledgers and event traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spend(calls: DataFrame, prices: DataFrame, on: list[str]) -> DataFrame:
    """(on, calls, units, cost, priced): cost of calls by price; rows without a price are kept, with null cost.

    Units are rounded to four places, which is what is billed."""
    used = calls.groupBy(*on).agg(F.count("*").alias("calls"), F.round(F.sum("units"), 4).alias("units"))
    return used.join(prices, on, "left").select(*on, "calls", "units", (F.col("units") * F.col("price")).alias("cost"), F.col("price").isNotNull().alias("priced"))


def trailing_usage(calls: DataFrame, by: list[str], since: Column) -> DataFrame:
    """(by, requests, units) of calls at or after `since`."""
    return calls.filter(F.col("ts") >= since).groupBy(*by).agg(F.count("*").alias("requests"), F.sum("units").alias("units"))


def quota_shortfall(usage: DataFrame, quotas: DataFrame, on: list[str], need: Column) -> DataFrame:
    """Quotas that what is used already and what is needed would pass: (on, left, short)."""
    left = F.col("quota") - F.coalesce("requests", F.lit(0))
    return quotas.join(usage, on, "left").select(*on, left.alias("left"), (need - left).alias("short")).filter("short > 0")


def trace_summary(events: DataFrame, session: str, order: list[str], kind: str) -> DataFrame:
    """(session, n_events, first_kind, last_kind, kinds): the last write wins; kinds by name with their counts."""
    at = F.struct(*order)
    per = events.groupBy(session, kind).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return per.groupBy(session).agg(
        F.sum("n").alias("n_events"), F.min_by(kind, "first").alias("first_kind"), F.max_by(kind, "last").alias("last_kind"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"),
    )


def stage_matrix(jobs: DataFrame) -> DataFrame:
    """(stage, status, n) over jobs (job_id, stages array<struct<stage, status>>)."""
    return jobs.select(F.inline("stages")).groupBy("stage", "status").agg(F.count("*").alias("n"))


def bad_transitions(states: DataFrame, allowed: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Steps of a key's states that no allowed transition (old, new) covers: (key, old, new, n). A repeat is no step."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = states.select(key, F.lag(state).over(w).alias("old"), F.col(state).alias("new")).filter("old is not null and old <> new")
    return steps.join(allowed, ["old", "new"], "left_anti").groupBy(key, "old", "new").agg(F.count("*").alias("n"))


def number_events(events: DataFrame, session: str, order: list[str], after: DataFrame | None = None) -> DataFrame:
    """Adds seq per session; with `after` (session, last_seq) the numbers continue where the stored trace ended."""
    w = Window.partitionBy(session).orderBy(*order)
    out = events.withColumn("seq", F.row_number().over(w).cast("long"))
    if after is None:
        return out
    return out.join(after, session, "left").withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def islands(rows: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """Adds `island`: a running number that goes up where `opens` holds (or at the key's first row)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(w))


def turn_schedule(sessions: DataFrame) -> DataFrame:
    """(session_id, turn, side, kind) of rows (session_id, turns): sides alternate, two openings first, two closings last."""
    n = F.greatest("turns", F.lit(0)) + 2
    out = sessions.select("session_id", "turns", F.explode(F.sequence(F.lit(1), n)).alias("turn"))
    kind = F.when(F.col("turn") > F.col("turns"), "CLOSING").when(F.col("turn") <= 2, "OPENING").otherwise("ARGUMENT")
    return out.select("session_id", "turn", F.when(F.col("turn") % 2 == 1, "A").otherwise("B").alias("side"), kind.alias("kind"))
