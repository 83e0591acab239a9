"""Most similar vectors of every vector: one small-world graph per shard, shard results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.hnsw import Graph
from docketlake.plans.session import cut, hash_sample

#: Vectors of a shard. A shard that gets twice as many is split by a hash; queries then go to each of its parts.
SHARD = 16_384
#: Queries to one part of a shard that one task answers; with more of them, copies of the part share them.
QUERIES = 65_536
#: Rows the shard centres are fitted on, whatever the table's size, and centres at most: what the driver holds is bounded.
#: Shards of a table so large that it would need more centres are cut into parts (see most_similar).
SAMPLE, CENTRES = 8192, 1024


def valid(vec: Column, size: int) -> Column:
    """Vectors that take part: of the right length, without null, NaN or infinite numbers, and not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) == size) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(vecs: pd.Series) -> np.ndarray:
    x = np.stack(vecs.to_list()).astype(np.float64) if len(vecs) else np.zeros((0, 1))
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, shards: int) -> np.ndarray:
    """Directions of `shards` parts of x of equal size: halved again and again at the median of the widest direction."""
    rng = np.random.default_rng(5)
    parts = [np.arange(len(x))]
    while len(parts) < shards:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        c = x[part] - x[part].mean(0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(8):
            d = c.T @ (c @ d)
            d /= np.linalg.norm(d) + 1e-30
        order = np.argsort(c @ d, kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    means = np.stack([x[p].mean(0) for p in parts])
    return (means / (np.linalg.norm(means, axis=1, keepdims=True) + 1e-30)).astype(np.float32)


def _route(at: np.ndarray, gap: float, probes: int):
    """Gives each vector, of length one, its home shard and, if it is a query, the shards it may have neighbours in.

    gap: shards whose centre is less similar to the query than the best one by more than this are left out; of the
    others the `probes` best are asked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(pdf["vec"]).astype(np.float32)
            s = x @ at.T
            near = s >= s.max(1, keepdims=True) - gap
            if probes < s.shape[1]:
                near &= s >= np.partition(s, -probes, axis=1)[:, -probes, None]
            near &= pdf["asks"].to_numpy()[:, None]
            _, c = np.nonzero(near)
            asked = np.split(c.astype(np.int32), np.cumsum(near.sum(1))[:-1])
            yield pdf.drop(columns="vec").assign(vec=[v.tobytes() for v in x], home=s.argmax(1).astype(np.int32), near=asked)

    return run


def _answer(k: int, ef: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]  # one part of a shard: bounded
        if rows:
            yield answer(pd.concat(rows, ignore_index=True))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, asks = pdf[pdf["role"] != 1], pdf[pdf["role"] > 0]
        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        if len(nodes) < 1 or not len(asks):
            return empty
        nodes = nodes.sort_values("id", kind="stable")
        ids = nodes["id"].to_numpy()
        x = np.frombuffer(b"".join(nodes["vec"]), np.float32).reshape(len(nodes), -1)
        graph = Graph(x, ids)
        places = {v: i for i, v in zip(range(len(nodes)), nodes["vec"])}
        own = np.array([places.get(v, -1) for v in asks["vec"]])
        out = []
        for inside in (True, False):
            some = (own >= 0) == inside
            if not some.any():
                continue
            q = np.frombuffer(b"".join(asks["vec"][some]), np.float32).reshape(int(some.sum()), -1)
            q_ids = asks["id"].to_numpy()[some]
            at, sims = graph.search(q, k + 1, ef, own[some] if inside else None)
            r, c = np.nonzero((at >= 0) & (sims >= least - 1e-5))
            other = ids[at[r, c]] != q_ids[r]
            r, c = r[other], c[other]
            sim = np.einsum("id,id->i", q[r].astype(np.float64), x[at[r, c]].astype(np.float64))
            out.append(pd.DataFrame({"q": q_ids[r], "n": ids[at[r, c]], "sim": sim}))
        got = pd.concat(out) if out else empty
        return got[got["sim"] >= least]

    return run


def most_similar(
    df: DataFrame, id: str, vec: str, k: int = 10, size: int = 64, least: float = -2.0, ef: int = 160, gap: float = 2.0, probes: int = 16, asks: Column | None = None
) -> DataFrame:
    """(id_a, id_b, similarity): the k rows most similar to each query row id_a, of those with cosine `least` or more.

    asks: which rows are queries (all by default); every row is searched. Vectors that are null, of another length,
    all zero or hold null, NaN or infinite numbers belong to no pair; rows without id neither. Repeated rows count
    once. Equal similarities are ordered by id. Fewer rows than k give as many as there are; an empty table none.

    The search is approximate: ef is the width of the beam in a graph, gap and probes limit the shards asked (see _route), so
    that the work of a query does not grow with the number of shards. Its recall is measured by recall(). With `least`, the pairs found from either side are both sides' pairs.

    Plan: equal vectors are one class, however many, and only its smallest id enters a graph. Shard centres come from
    a bounded sample; each vector is sent once as a node to its shard and as a query to the shards near it; each shard
    (at most 2 * SHARD nodes, with QUERIES queries) has a partition of its own. Only the k best of each are merged.
    """
    spark = df.sparkSession
    asks = F.lit(True) if asks is None else asks
    rows = df.filter(valid(F.col(vec), size) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.withColumn("h", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit(1), "vec"))
    n = rows.count()
    shards = min(CENTRES, max(1, round(n / SHARD)))
    sample = hash_sample(rows.select("g", "vec"), F.xxhash64("g"), n, SAMPLE).dropDuplicates(["g"]).toPandas()
    at = centres(_unit(sample["vec"]), shards) if len(sample) else np.zeros((1, size), np.float32)
    reps = rows.groupBy("h", "g").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.max("asks").alias("asks"), F.count_distinct("id").alias("size"))
    reps = cut(reps.mapInPandas(_route(at, gap, probes), "h long, g long, id long, asks boolean, size long, vec binary, home int, near array<int>"))
    # Parts of a shard with too many nodes, and copies of a part with too many queries: one row a shard.
    parts = reps.groupBy(F.col("home").alias("shard")).agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("parts"))
    copies = reps.select(F.explode("near").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    plan = parts.join(copies, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    upto_here = F.sum(F.col("parts") * F.col("copies")).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    plan = cut(plan.withColumn("at", upto_here - F.col("parts") * F.col("copies")))
    n_parts = plan.agg(F.max(F.col("at") + F.col("parts") * F.col("copies"))).first()[0] or 1
    plan = F.broadcast(plan)  # a row a shard: at most CENTRES
    mix = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda part, copy: (F.col("at") + part * F.col("copies") + copy).cast("int").alias("place")
    # A node is its own query where it lives (role 2); only other shards and parts are sent the vector again (role 1).
    part, copy = mix % F.col("parts"), F.floor(mix / 64) % F.col("copies")
    nodes = reps.select("id", "vec", "asks", F.col("home").alias("shard")).join(plan, "shard").withColumn("copy", upto("copies"))
    nodes = nodes.select(place(part, F.col("copy")), F.when(F.col("asks") & (F.col("copy") == copy), 2).otherwise(0).alias("role"), "id", "vec")
    questions = reps.select("id", "vec", "home", F.explode("near").alias("shard")).join(plan, "shard").withColumn("part", upto("parts"))
    questions = questions.filter((F.col("shard") != F.col("home")) | (F.col("part") != part)).select(place(F.col("part"), copy), F.lit(1).alias("role"), "id", "vec")
    # Each part and copy is numbered, and the number is its partition: no two share a task while others wait.
    routed = nodes.unionByName(questions).repartitionById(int(n_parts), "place")
    found = routed.mapInPandas(_answer(k, ef, least), "q long, n long, sim double")
    if least > -1:
        found = cut(found)
        found = found.unionByName(found.select(F.col("n").alias("q"), F.col("q").alias("n"), "sim"))
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "n")
    found = cut(found.groupBy("q", "n").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))
    # Back from classes of equal vectors to rows: of the other side's class the k + 1 smallest ids can be among k.
    classes = rows.select("id", "h", "g", "asks").distinct().join(cut(reps.filter("size > 1").select("h", "g", F.col("id").alias("rep"))), ["h", "g"]).select("rep", "id", "asks")
    classes = cut(classes)
    first = classes.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", "id")
    q_side = found.join(classes.filter("asks").select(F.col("rep").alias("q"), F.col("id").alias("qid")), "q", "left").withColumn("one", F.col("qid").isNull()).withColumn("qid", F.coalesce("qid", "q"))
    # A class whose smallest member is no query itself must not ask under that id.
    silent = classes.groupBy("rep").agg(F.max(F.when(F.col("id") == F.col("rep"), F.col("asks"))).alias("own")).filter("not own").select(F.col("rep").alias("q"))
    q_side = q_side.filter("not one").unionByName(q_side.filter("one").join(silent, "q", "left_anti"))
    wide = q_side.join(first.select(F.col("rep").alias("n"), F.col("id").alias("nid")), "n", "left").select("qid", F.coalesce("nid", "n").alias("nid"), "sim")
    equal = classes.filter("asks").join(first.withColumnRenamed("id", "nid"), "rep").select(F.col("id").alias("qid"), "nid", F.lit(1.0).alias("sim"))
    if least > 1:
        equal = equal.limit(0)
    last = Window.partitionBy("qid").orderBy(F.desc("sim"), "nid")
    return (
        wide.unionByName(equal).filter("qid <> nid").groupBy("qid", "nid").agg(F.max("sim").alias("sim"))
        .withColumn("r", F.row_number().over(last)).filter(F.col("r") <= k)
        .select(F.col("qid").alias("id_a"), F.col("nid").alias("id_b"), F.col("sim").alias("similarity"))
    )


def recall(found: DataFrame, df: DataFrame, id: str, vec: str, k: int = 10, size: int = 64, queries: int = 200, least: float = -2.0, asks: Column | None = None) -> DataFrame:
    """(n_queries, recall): the share of the k most similar rows, of those of similarity `least` or more, that `found`
    holds, over `queries` of the rows that `asks` (of id and vec) names.

    The truth comes from brute force: the chosen queries, a bounded number, are compared with all rows in blocks.
    """
    rows = df.filter(valid(F.col(vec), size) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"))
    own = rows.filter(F.lit(True) if asks is None else asks).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(queries).toPandas()
    q, q_ids = _unit(own["vec"]), own["id"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(q_ids):
                continue
            s = q @ _unit(pdf["vec"]).T
            ids = pdf["id"].to_numpy()
            s[q_ids[:, None] == ids] = -3
            m = min(k, len(ids))
            at = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pd.DataFrame({"id_a": np.repeat(q_ids, m), "id_b": ids[at].ravel(), "sim": np.take_along_axis(s, at, 1).ravel()})

    truth = rows.mapInPandas(run, "id_a long, id_b long, sim double").filter((F.col("sim") > -2) & (F.col("sim") >= least)).groupBy("id_a", "id_b").agg(F.max("sim").alias("sim"))
    worst = truth.withColumn("r", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("sim"), "id_b"))).filter(F.col("r") <= k).groupBy("id_a").agg(F.min("sim").alias("worst"), F.count("*").alias("want"))
    # A row as similar as the last of the true ones is as good as it.
    got = found.join(worst, "id_a").groupBy("id_a").agg(F.count_if(F.col("similarity") >= F.col("worst") - 1e-5).alias("hit"), F.max("want").alias("want"))
    return worst.select("id_a", "want").join(got.select("id_a", "hit"), "id_a", "left").agg(
        F.count("*").alias("n_queries"), (F.sum(F.least(F.coalesce("hit", F.lit(0)), "want")) / F.sum("want")).alias("recall")
    )
