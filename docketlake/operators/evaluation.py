"""Evaluation statistics: accuracy, F1, exact McNemar, bootstrap, expanding baselines, alignment."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, predicted, coverage, accuracy) of rows (truth, predicted label). A null prediction lowers coverage only."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("prediction").alias("predicted"), F.try_divide(F.count("prediction"), F.count("*")).alias("coverage"),
        F.avg(F.when(F.col("prediction").isNotNull(), (F.col("prediction") == F.col("truth")).cast("int"))).alias("accuracy"),
    )


def balanced_accuracy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur in the truth; a null prediction is a miss."""
    per = rows.groupBy(*by, "truth").agg(F.avg(F.coalesce((F.col("prediction") == F.col("truth")).cast("int"), F.lit(0))).alias("recall"))
    return per.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def macro_f1(rows: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the given labels; a label without a true positive counts 0."""
    t = rows.groupBy(*by, F.col("truth").alias("label")).agg(F.count("*").alias("n_true"), F.count_if(F.col("prediction") == F.col("truth")).alias("tp"))
    p = rows.filter("prediction is not null").groupBy(*by, F.col("prediction").alias("label")).agg(F.count("*").alias("n_pred"))
    groups = rows.select(*by).distinct().join(labels) if by else labels.filter(F.lit(True))
    j = groups.join(t, [*by, "label"], "left").join(p, [*by, "label"], "left")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.coalesce("n_true", F.lit(0)) + F.coalesce("n_pred", F.lit(0))), F.lit(0.0))
    return j.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p: min(1, 2 * sum of C(n, i) / 2^n for i up to the smaller count), 1 without any difference.

    The largest term is taken by its logarithm and the others follow from it downwards, so nothing overflows.
    """
    n, k = only_a + only_b, F.least(only_a, only_b)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    top = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i)) - n * F.log(F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
    # From C(n, k) down to C(n, 0), each as a share of the first: C(n, j - 1) = C(n, j) * j / (n - j + 1).
    share = lambda a, i: a["c"] * (k - i + 1) / (n - k + i)
    total = F.aggregate(steps, start, lambda a, i: F.struct(share(a, i).alias("c"), (a["s"] + share(a, i)).alias("s")))["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total * F.exp(top)))


def paired(rows: DataFrame) -> DataFrame:
    """(pairs, only_a, only_b, p) over rows (truth, a, b) both systems predicted."""
    both = rows.filter("a is not null and b is not null")
    right_a, right_b = F.col("a") == F.col("truth"), F.col("b") == F.col("truth")
    out = both.agg(F.count("*").alias("pairs"), F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(right_b & ~right_a).alias("only_b"))
    return out.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))


def bootstrap(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str], statistic: Callable[[list], float], samples: int = 2000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(by, estimate, low, high): percentile interval of a statistic over resamples with replacement, one group a task.

    The groups are evaluation sets, so bounded. Draws come from Python's generator on the rows in order, so they are the
    same on every run. A group without a value gives nulls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [v for v in pdf.sort_values(list(order))[value].tolist() if v is not None and v == v]
        row = {c: pdf[c].iloc[0] for c in by}
        if not values:
            return pd.DataFrame([row | {"estimate": None, "low": None, "high": None}])
        draw, n = random.Random(seed), len(values)
        stats = sorted(statistic([values[draw.randrange(n)] for _ in range(n)]) for _ in range(samples))
        alpha = (1 - level) / 2
        low, high = stats[int(alpha * samples)], stats[min(samples - 1, int((1 - alpha) * samples))]
        return pd.DataFrame([row | {"estimate": statistic(values), "low": low, "high": high}])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "estimate double, low double, high double"]))


def majority(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, majority): the most common label; null on a tie or without labels."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.max(F.struct("n", label)).alias("t"), F.collect_list("n").alias("all"))
    return top.select(*by, F.when(F.size(F.filter("all", lambda x: x == F.col("t.n"))) == 1, F.col(f"t.{label}")).alias("majority"))


def expanding_majority(rows: DataFrame, labels: Sequence[str], by: Sequence[str], order: Sequence[str], truth: str, case: Sequence[str] = ()) -> DataFrame:
    """Adds `prediction`: the majority of the truths of earlier rows of the group, null on a tie or without any.

    One running count a label; only rows strictly before count, so the first of a group has no prediction. With `case`,
    rows (issues) of one case share the value from before their case: they are counted per case first.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    hits = {f"__c{i}": F.sum((F.col(truth) == v).cast("int")) for i, v in enumerate(labels)}
    if case:
        cases = rows.groupBy(*dict.fromkeys([*by, *case, *order])).agg(*[h.alias(c) for c, h in hits.items()])
        counted = cases.select(*by, *case, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in hits])
        out = out.join(counted, [*by, *case])
    else:
        for c, h in hits.items():
            out = out.withColumn(c, F.coalesce(h.over(w), F.lit(0)))
    counts = [F.col(f"__c{i}") for i in range(len(labels))]
    best = F.greatest(*counts)
    winners = sum((c == best).cast("int") for c in counts)
    pick = F.coalesce(*[F.when(c == best, F.lit(v)) for c, v in zip(counts, labels)])
    return out.withColumn("prediction", F.when((best > 0) & (winners == 1), pick)).drop(*[f"__c{i}" for i in range(len(labels))])


def issue_alignment(framed: DataFrame, truth: DataFrame, bench: DataFrame, in_record: DataFrame | None = None) -> DataFrame:
    """(case_id, compared, aligned): framed issues (case_id, issue_id) with truth (favours, driver) and bench (favours).

    An EVIDENCE-driven issue is compared only if its evidence was in the record; without in_record never. An issue the
    bench left open is not compared. aligned is null if nothing was compared.
    """
    j = framed.join(truth.withColumnRenamed("favours", "real"), ["case_id", "issue_id"]).join(bench.withColumnRenamed("favours", "found"), ["case_id", "issue_id"], "left")
    shown = F.lit(False)
    if in_record is not None:
        j = j.join(in_record.select("case_id", "issue_id", F.lit(True).alias("shown")), ["case_id", "issue_id"], "left")
        shown = F.coalesce("shown", F.lit(False))
    counts = (F.col("driver") != "EVIDENCE") | shown
    same = F.when(counts & F.col("found").isNotNull(), (F.col("found") == F.col("real")).cast("int"))
    return j.groupBy("case_id").agg(F.count(same).alias("compared"), F.avg(same).alias("aligned"))


def set_precision_recall(found: DataFrame, real: DataFrame, key: str, item: str) -> DataFrame:
    """(key, precision, recall) of two sets of items per key; null where a set is empty."""
    f = found.select(key, item).distinct().withColumn("f", F.lit(1))
    r = real.select(key, item).distinct().withColumn("r", F.lit(1))
    both = F.count(F.when(F.col("f").isNotNull() & F.col("r").isNotNull(), 1))
    return f.join(r, [key, item], "full").groupBy(key).agg(F.try_divide(both, F.count("f")).alias("precision"), F.try_divide(both, F.count("r")).alias("recall"))


def retrieval_quality(ranks: DataFrame, k: int) -> DataFrame:
    """(recall_at_k, mrr) over rows (query_id, found_at): the rank of the known item, null or 0 if it was not found."""
    hit = F.coalesce((F.col("found_at") >= 1) & (F.col("found_at") <= k), F.lit(False))
    return ranks.agg(F.avg(hit.cast("int")).alias("recall_at_k"), F.avg(F.when(hit, 1 / F.col("found_at")).otherwise(0.0)).alias("mrr"))


def subsets(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows once for each subset they belong to (subsets may overlap), in column `subset`."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return rows.withColumn("subset", F.explode(names))
