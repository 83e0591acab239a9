"""Exact vector search and similarity: scoped top-k, MaxSim, rerank, repetition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to the rows at once in top_k.
ROUND = 16_384
#: Query vectors that meet a block of rows in one task.
QUERY_BLOCK = 2048
#: Query vectors of one product of max_sim, unless one query has more.
QUERY_PART = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where either is all zero, null where either is null or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def usable(vec: Column, size: int) -> Column:
    return F.coalesce((F.size(vec) == size) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)) & F.exists(vec, lambda x: x != 0), F.lit(False))


def scoped(precedents: DataFrame, cutoff: Column, excluded: DataFrame | None = None, statutes: list[str] | None = None) -> DataFrame:
    """The rows a search may see: decided strictly before the cutoff, not excluded, and with any of the statutes.

    A null date is never before the cutoff. Excluding hides every row of an excluded precedent_id. An empty list of
    statutes sees nothing (the statutes given could not be resolved); None sets no such condition.
    """
    out = precedents.filter(F.col("decided") < cutoff)
    if excluded is not None:
        out = out.join(excluded.select("precedent_id").distinct(), "precedent_id", "left_anti")
    if statutes is not None:
        out = out.filter(F.arrays_overlap("statutes", F.array(*map(F.lit, statutes)).cast("array<string>")))
    return out


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_list()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _starts(*sorted_columns: pd.Series) -> np.ndarray:
    """Where each run of equal values of sorted columns begins."""
    codes = np.stack([pd.factorize(c, use_na_sentinel=False)[0] for c in sorted_columns])
    return np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])


def top_k(rows: DataFrame, queries: DataFrame, k: int, before: bool = False) -> DataFrame:
    """(query_id, uid, score, rank): the k rows most similar to each query, exactly; equal scores by uid.

    rows: uid, vec and, if `before`, decided; queries: query_id, vec and decided. With `before` a query sees only rows
    decided strictly before its own date. Vectors must be usable.

    Rows stay where they are: they are never shuffled. Queries go to them in rounds of at most ROUND, which bounds what
    the driver and a task hold; a task keeps the k best rows of each query over all its batches, and only these are
    shuffled and merged.
    """
    day = F.coalesce(F.datediff("decided", F.lit("1970-01-01").cast("date")), F.lit(None).cast("int")).cast("double") if before else F.lit(0.0)
    rounds = max(1, -(-queries.count() // ROUND))
    asked = queries.select("query_id", "vec", day.alias("day"), F.pmod(F.xxhash64("query_id"), F.lit(rounds)).alias("round"))
    kinds = dict(rows.dtypes) | dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, uid {kinds['uid']}, score double"
    found = None
    for i in range(rounds):
        some = asked.filter(F.col("round") == i).toPandas()
        one = rows.select("uid", "vec", day.alias("day")).mapInPandas(_best(some["query_id"].to_numpy(), some["vec"], some["day"].to_numpy(float), k, before), schema)
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(ids: np.ndarray, vecs: pd.Series, days: np.ndarray, k: int, before: bool):
    q = _unit(vecs) if len(vecs) else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uids, scores = None, np.full((len(q), k), -np.inf)
        for pdf in batches:
            if not len(pdf) or not len(q):
                continue
            own, x, day = pdf["uid"].to_numpy(), _unit(pdf["vec"]).T, pdf["day"].to_numpy(float)
            if uids is None:
                uids = np.full((len(q), k), own[0], dtype=object)
            m = min(k, len(own))
            for at in range(0, len(q), QUERY_PART):
                part = slice(at, at + QUERY_PART)
                s = np.round(q[part] @ x, 9)
                if before:
                    s[~(day[None, :] < days[part, None])] = -np.inf
                # By score, then by uid: what ties with the k-th counts too until the uids decide.
                least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                r, c = np.nonzero((s >= np.maximum(least, scores[part, -1])[:, None]) & (s > -np.inf))
                for i in np.unique(r):
                    mine = c[r == i]
                    both_s, both_u = np.concatenate([scores[at + i], s[i, mine]]), np.concatenate([uids[at + i], own[mine]])
                    order = sorted(range(len(both_s)), key=lambda j: (-both_s[j], both_u[j]))[:k]
                    scores[at + i], uids[at + i] = both_s[order], both_u[order]
        if uids is not None:
            i, j = np.nonzero(scores > -np.inf)
            yield pd.DataFrame({"query_id": ids[i], "uid": uids[i, j], "score": scores[i, j]})

    return run


def max_sim(sections: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, uid, score, rank): documents of many vectors by the sum, over a query's vectors, of the best section.

    sections: uid, vec; queries: query_id, part, vec. Vectors must be usable. Queries are cut into blocks, and sections
    into slices, by document, so that each pair of block and slice has whole documents on both sides; it multiplies
    whole queries at a time, about QUERY_PART vectors, and keeps k documents a query.
    """
    spark = sections.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    r = sections.select("uid", "vec").withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.select("query_id", "part", F.col("vec").alias("q_vec")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": right["query_id"].iloc[:0], "uid": left["uid"].iloc[:0], "score": pd.Series(dtype=float)})
        if not len(left) or not len(right):
            return empty
        left, right = left.sort_values("uid", na_position="first"), right.sort_values(["query_id", "part"])
        docs, asks = _starts(left["uid"]), _starts(right["query_id"], right["part"])
        whole = _starts(right["query_id"].iloc[asks])  # a query's parts, among asks
        uids, ids = left["uid"].to_numpy()[docs], right["query_id"].to_numpy()[asks[whole]]
        vectors, q_vectors = _unit(left["vec"]), _unit(right["q_vec"])
        m, out, at = min(k, len(docs)), [], 0
        while at < len(whole):
            end = at + 1
            while end < len(whole) and (asks[whole[end + 1]] if end + 1 < len(whole) else len(right)) - asks[whole[at]] <= QUERY_PART:
                end += 1
            lo, hi = whole[at], whole[end] if end < len(whole) else len(asks)
            rows = slice(asks[lo], asks[hi] if hi < len(asks) else len(right))
            best = np.maximum.reduceat(np.maximum.reduceat(q_vectors[rows] @ vectors.T, docs, axis=1), asks[lo:hi] - asks[lo], axis=0)
            s = np.round(np.add.reduceat(best, whole[at:end] - lo, axis=0), 9)
            top = np.argsort(-s, axis=1, kind="stable")[:, :m]
            out.append(pd.DataFrame({"query_id": np.repeat(ids[at:end], m), "uid": uids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()}))
            at = end
        return pd.concat(out)

    kinds = dict(sections.dtypes) | dict(queries.dtypes)
    found = r.groupBy("block", "slice").cogroup(q.groupBy("block", "slice")).applyInPandas(score, f"query_id {kinds['query_id']}, uid {kinds['uid']}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(candidates: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, uid, score, rank) by their best passage score, then vector score, then vector order.

    passages: query_id, uid, position, passage_score. A candidate without a passage comes last with a null score.
    """
    best = passages.groupBy("query_id", "uid").agg(
        F.max("passage_score").alias("rerank_score"), F.max_by("position", F.struct("passage_score", -F.col("position"))).alias("best_position")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.desc("score"), "rank")
    return candidates.join(best, ["query_id", "uid"], "left").withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


def repetition(turns: DataFrame, limit: float, keep: Sequence[str] = ()) -> DataFrame:
    """(session_id, side, turn, keep, best, copied): for each turn after a side's first, the greatest cosine to any earlier turn.

    turns: session_id, side, turn, vec. `copied` tells best >= limit. A session's turns are few, so the self-join is
    bounded by the square of a session's length.
    """
    a, b = turns.alias("a"), turns.select("session_id", "side", F.col("turn").alias("earlier"), F.col("vec").alias("vec_b")).alias("b")
    pairs = a.join(b, ["session_id", "side"]).filter("earlier < turn")
    return pairs.groupBy("session_id", "side", "turn", *keep).agg(F.max(cosine(F.col("vec"), F.col("vec_b"))).alias("best")).withColumn("copied", F.col("best") >= limit)


def placement(new: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """Where each new lesson goes: (lesson_id, action, match_id, similarity).

    A stored lesson of the same key that is most similar, by at least `least`, is merged with (action merge: frequency
    up by one, greater severity); otherwise the lesson is inserted. Both: lesson_id, key, vec. Ties by lesson_id.
    """
    s = stored.select(F.col("lesson_id").alias("match_id"), "key", F.col("vec").alias("s_vec"))
    pairs = new.join(s, "key").filter("match_id <> lesson_id").withColumn("similarity", F.round(cosine(F.col("vec"), F.col("s_vec")), 9))
    best = pairs.filter(F.col("similarity") >= least).groupBy("lesson_id").agg(F.max_by(F.struct("match_id", "similarity"), F.struct("similarity", -F.col("match_id"))).alias("b"))
    return new.join(best, "lesson_id", "left").select("lesson_id", F.when(F.col("b").isNull(), "insert").otherwise("merge").alias("action"), F.col("b.match_id").alias("match_id"), F.col("b.similarity").alias("similarity"))
