"""Mixing sources to target weights, by iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.plans.session import cut

#: Cells of (source, language, topic) that the driver rakes at most; with more of them, coarser topics must be given.
CELLS = 200_000
#: Stands for a null language or topic.
NONE = "(none)"
#: Documents of a source that one task orders for the systematic draw.
DRAW_GROUP = 50_000


def _fill(weight: np.ndarray, tokens: np.ndarray, most: np.ndarray, group: np.ndarray, want: np.ndarray) -> np.ndarray:
    """weight times one factor a group for which the group's tokens, with no weight above its most, sum to want (or to all
    that is possible)."""
    n = len(want)
    total = lambda factor: np.bincount(group, np.minimum(weight * factor[group], most) * tokens, n)
    low, high = np.zeros(n), np.ones(n)
    while ((short := total(high) < want) & (high < 1e12)).any():
        high = np.where(short & (high < 1e12), 2 * high, high)
    for _ in range(60):
        mid = (low + high) / 2
        short = total(mid) < want
        low, high = np.where(short, mid, low), np.where(short, high, mid)
    full = want >= np.bincount(group, most * tokens, n)
    return np.where(full[group], most, np.minimum(weight * high[group], most))


def rake(cells: pd.DataFrame, shares: dict[str, float], total: float, rounds: int = 50) -> np.ndarray:
    """Times that each cell (source, lang, topic, tokens, cap) is used: iterative proportional fitting.

    Sources are fitted to share * total, as far as their caps reach; languages and topics to the shares they have in
    the cells' tokens. The source margin comes last, so it holds exactly wherever the caps allow it.
    """
    tokens, most = cells["tokens"].to_numpy(float), cells["cap"].to_numpy(float)
    weight = np.minimum(1.0, most)
    margins = {c: pd.factorize(cells[c], sort=True, use_na_sentinel=False) for c in ("topic", "lang", "source")}
    of, names = margins["source"]
    reach = np.minimum([shares.get(s, 0.0) * total for s in names], np.bincount(of, most * tokens))
    wants = {c: reach if c == "source" else reach.sum() * np.bincount(g, tokens) / tokens.sum() for c, (g, _) in margins.items()}
    for _ in range(rounds):
        before = weight.copy()
        for c, (g, _) in margins.items():
            weight = _fill(np.maximum(weight, 1e-9), tokens, most, g, wants[c])
        if np.abs(weight - before).max() < 1e-6:
            break
    return weight


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents used, each `repeats` times and never above its source's cap.

    docs: doc_id, source, lang, topic, n_tokens. targets: source, target_share, max_repeats. Documents without source,
    or of a source without target, take no part; null languages and topics are a class of their own. total_tokens
    defaults to the tokens of all documents that take part. A source that can't reach its share is used up to its cap
    and falls short; the others keep share * total. No documents or no targets give no rows.

    Every language and topic is a margin of its own. Plan: tokens are summed per (source, language, topic) cell; the
    weights of the cells, at most CELLS (more raise an error), are raked on the driver; documents get the cell's weight, whole repeats first and the rest by a systematic draw
    over the source's documents, ordered by language, topic and a hash, in groups of bounded size.
    """
    goals = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").alias("cap"))
    # Counting tokens is the costly part: it is done once, and what follows reads the counts.
    slim = cut(docs.filter("source is not null and n_tokens > 0").select("doc_id", "source", "lang", "topic", "n_tokens").join(goals.select("source", "cap"), "source"))
    slim = slim.withColumn("lang", F.coalesce("lang", F.lit(NONE))).withColumn("topic", F.coalesce("topic", F.lit(NONE)))
    cells = slim.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.max("cap").alias("cap"), F.count("*").alias("n")).limit(CELLS + 1).toPandas()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} cells of source, language and topic: give coarser topics")
    shares = {r["source"]: r["target_share"] for r in goals.collect()}
    cells = cells.sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    cells["weight"] = rake(cells, shares, float(total_tokens or cells["tokens"].sum())) if len(cells) else []
    cells["groups"] = (cells.groupby("source")["n"].transform("sum") // DRAW_GROUP + 1) if len(cells) else []
    weights = docs.sparkSession.createDataFrame(cells[["source", "lang", "topic", "weight", "groups"]], "source string, lang string, topic string, weight double, `groups` long")
    h = F.xxhash64(F.lit(seed), "doc_id")
    drawn = (
        slim.join(F.broadcast(weights), ["source", "lang", "topic"])  # at most CELLS rows
        .withColumn("group", F.pmod(h, F.col("groups")))
        .withColumn("part", F.col("weight") - F.floor("weight"))
        .withColumn("h", F.xxhash64(F.lit(seed + 1), "doc_id"))
    )
    w = Window.partitionBy("source", "group").orderBy("lang", "topic", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.pmod(F.xxhash64(F.lit(seed), "source", "group"), F.lit(1 << 30)) / float(1 << 30)
    until = F.sum("part").over(w) + offset
    extra = F.floor(until) - F.floor(until - F.col("part"))
    return (
        drawn.withColumn("repeats", F.least(F.floor("weight") + F.least(F.greatest(extra, F.lit(0)), F.lit(1)), F.col("cap")).cast("int"))
        .filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    )


def report(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: tokens there are, tokens used, target and reached share, and the most repeats of a document."""
    there = docs.filter("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens_there"))
    used = mixed.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    all_used = mixed.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("all_used"))
    rows = targets.join(there, "source", "left").join(used, "source", "left").fillna(0, ["n_docs", "tokens_there", "docs_used", "tokens_used", "most_repeats"])
    return rows.join(F.broadcast(all_used)).select(  # all_used is one row
        "source", "target_share", F.coalesce(F.try_divide("tokens_used", "all_used"), F.lit(0.0)).alias("reached_share"), "max_repeats", "most_repeats", "n_docs", "docs_used", "tokens_there", "tokens_used",
    )
