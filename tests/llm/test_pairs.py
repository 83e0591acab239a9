"""Nearest vectors and near duplicates against brute force, and the stated cases."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from docketlake.llm import hnsw, neardup, neighbours, queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def unit(v):
    x = np.stack(v).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_finds_near_nodes():
    x = unit(np.random.default_rng(1).standard_normal((3000, 64))).astype(np.float32)
    q = unit(np.random.default_rng(2).standard_normal((300, 64))).astype(np.float32)
    graph = hnsw.Graph(x, np.arange(len(x)))
    at, sims = graph.search(q, 10, 160)
    best = np.argsort(-(q @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(at, best)]) > 0.93
    assert (np.diff(sims, axis=1) <= 1e-6).all() and len(graph.layers) >= 2
    for n in (1, 2, 5):
        at, _ = hnsw.Graph(x[:n], np.arange(n)).search(q[:3], 10, 16)
        assert (np.sort(at, 1)[:, -n:] == np.arange(n)).all() and (np.sort(at, 1)[:, :-n] == -1).all()


@pytest.mark.parametrize("shard", [16_384, 150])
def test_close_pairs_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "QUERIES", 400)
    df = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    pdf = df.toPandas().drop_duplicates("vec_id")
    pdf = pdf[[v is not None and len(v) == 64 and not np.isnan(np.array(v, float)).any() and any(v) for v in pdf["vec"]]]
    x, ids = unit(pdf["vec"].to_list()), pdf["vec_id"].to_numpy()
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    want = {(min(a, b), max(a, b)) for a, b in zip(ids[i], ids[j])}
    got = neighbours.most_similar(df, "vec_id", "vec", least=0.9, ef=16, gap=0.14)
    found = {(min(r.id_a, r.id_b), max(r.id_a, r.id_b)) for r in got.collect()}
    assert found <= want and len(found) >= 0.97 * len(want)


def test_recall_is_measured(spark):
    got = queries.p5_recall(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 4 and all(r.recall >= 0.9 and r.n_queries >= 20 for r in got if r.search == "p5_nearest") and all(r.recall >= 0.97 for r in got if r.search == "p5_found")


def test_cases_of_vectors(spark):
    e = np.eye(64)
    rng = np.random.default_rng(4)
    data = [(i, (e[0] * (1 + i)).tolist(), "x") for i in range(3)] + [(10 + i, e[1].tolist(), "x") for i in range(30)]
    data += [(50, (e[0] + 0.1 * e[2]).tolist(), "x"), (50, (e[0] + 0.1 * e[2]).tolist(), "x"), (60, None, "x"), (61, [1.0], "x"), (62, [0.0] * 64, "x"), (63, [float("nan")] * 64, "x"), (64, [None] * 64, "x"), (None, e[3].tolist(), "x"), (65, e[5].tolist(), "x")]
    data += [(100 + i, v.tolist(), "x") for i, v in enumerate(rng.standard_normal((40, 64)))]
    df = spark.createDataFrame(data, "id long, vec array<double>, n string")
    got = neighbours.most_similar(df, "id", "vec", k=10, least=0.9)
    by = {a: set(g["id_b"]) for a, g in got.toPandas().groupby("id_a")}
    assert by[0] == {1, 2, 50} and by[50] == {0, 1, 2} and by[10] == set(range(11, 21)) and by[39] == set(range(10, 20)) and 65 not in by
    assert set(by) == {0, 1, 2, 50, *range(10, 40)}
    assert neighbours.most_similar(df.limit(0), "id", "vec").count() == 0
    one = neighbours.most_similar(df, "id", "vec", k=3, asks=df["id"] % 20 == 0).toPandas()
    assert set(one["id_a"]) == {0, 20, 100, 120} and (one.groupby("id_a").size() == 3).all()


def brute_pairs(docs, words, t):
    sets = {}
    for i, text in docs:
        w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        s = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)}
        if s:
            sets[i] = s
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12), set(sets)


@pytest.mark.parametrize("words, t, block", [(3, 0.6, 2048), (3, 0.6, 3), (5, 0.8, 2048), (2, 0.5, 4)])
def test_pairs_of_edited_texts(spark, monkeypatch, words, t, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(60)]
    docs, n = [], 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, rng.integers(4, 50)))
        for _ in range(rng.integers(1, 6)):
            d = list(base)
            for _ in range(rng.integers(0, 4)):
                p = rng.integers(0, len(d))
                d[p : p + rng.integers(0, 2)] = [rng.choice(vocabulary)] * rng.integers(0, 2)
            docs.append((n, " ".join(d)))
            n += 1
    docs += [(900, None), (901, ""), (902, "one two"), (903, "Same, text here; same"), (904, "same text HERE same"), (905, "same text here same")]
    df = spark.createDataFrame(docs, "id long, text string")
    got = neardup.Similar(neardup.documents(df, "id", F.col("text"), words), t)
    want, ids = brute_pairs(docs, words, t)
    assert rows(got.pairs()) == want
    groups = {r.id: (r.class_id, r.n_links) for r in got.groups().collect()}
    top = {i: i for i in ids}
    for _ in range(len(ids)):
        for a, b in want:
            top[a] = top[b] = min(top[a], top[b])
    assert groups == {i: (top[i], sum(i in p for p in want)) for i in ids}


def test_many_copies_are_one_class(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id"), F.lit("the same long text stands in every row of this table").alias("text"))
    s = neardup.Similar(neardup.documents(df, "id", F.col("text"), 3), 0.6)
    assert s.links.count() == 0 and s.sets.count() == 1 and s.pairs().count() == 3000 * 2999 // 2
    assert s.groups().agg(F.min("n_links"), F.max("class_id")).first() == (2999, 0)
    assert {r.step: r.n for r in s.funnel().collect()} == {"documents": 3000, "distinct": 1, "prefix_tokens": 8, "met_order_1": 0, "met_all_orders": 0, "links": 0}
    empty = neardup.Similar(neardup.documents(df.limit(0), "id", F.col("text"), 3), 0.6)
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_large_class_gives_every_pair(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = ["one text stands here", "One text, stands here", "ONE text stands HERE."]
    data = [(i, [texts[i % 3]], None) for i in range(60)] + [(60, ["quite another text altogether"], None)]
    spark.createDataFrame(data, "row_no long, facts_texts array<string>, ratio_text string").write.parquet(str(tmp_path / "precedents.parquet"))
    assert rows(queries.p6_found(spark, str(tmp_path))) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got = neardup.components(spark.range(202).select("id"), edges)
    assert {r.class_id for r in got.collect()} == {0, 201}


def test_shuffle_follows_the_texts_and_not_the_meetings(spark):
    """Every two texts share sentences, and none are similar: what leaves a task stays in proportion to the texts."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    sentences = [" ".join(f"v{w}" for w in rng.integers(0, 300, 12)) for _ in range(60)]
    docs = [(i, " ".join(sentences[j] for j in rng.choice(60, 12, replace=False))) for i in range(800)]
    docs += [(900 + i, docs[i][1] + " and more of it") for i in range(5)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(4)
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    got = rows(neardup.Similar(neardup.documents(df, "id", F.col("text"), 3), 0.6).pairs())
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)
    assert got == brute_pairs(docs, 3, 0.6)[0] and {(i, 900 + i) for i in range(5)} <= set(got)
    assert written < 4096 * len(docs), written


@pytest.mark.parametrize("hot", [2, 7])
def test_tokens_of_many_documents_meet_in_blocks(spark, monkeypatch, hot):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "HOT", hot)
    rng = np.random.default_rng(9)
    docs = []
    for g in range(12):
        base = [f"w{w}" for w in rng.integers(0, 25, 30)]
        docs += [(10 * g + k, " ".join(base[:k] + ["x"] * (k % 3) + base[k:])) for k in range(rng.integers(2, 8))]
    docs += [(500, "ünï_code Words_here and_ more"), (501, "ÜNÏ code words here; and more"), (None, "ünï code words here and more")]
    df = spark.createDataFrame(docs, "id long, text string")
    got = neardup.Similar(neardup.documents(df, "id", F.col("text"), 2), 0.6)
    assert rows(got.pairs()) == brute_pairs([(i, (t or "").replace("_", " ")) for i, t in docs if i is not None], 2, 0.6)[0]
