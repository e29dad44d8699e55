import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors as vx
from palimpsest.operators import clusters, density, evaluate, scoring


def unit_rows(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name="v"):
    return spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], f"id long, {name} array<double>").repartition(4)


@pytest.mark.parametrize("dim,way", [(5, "moments"), (5, "passes"), (80, "auto"), (64, "auto")])
def test_mean_cubed_similarity(spark, dim, way, monkeypatch):
    # small blocks, so that candidates need several passes
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 8 * dim * 10)
    corpus, candidates = unit_rows(60, dim, 1), unit_rows(35, dim, 2)
    holes = frame(spark, corpus).unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    got = {r["id"]: r["score"] for r in scoring.mean_cubed_similarity(frame(spark, candidates), holes, "id", "v", "v", way).collect()}
    expected = ((candidates @ corpus.T) ** 3).mean(axis=1)
    assert len(got) == 35 and all(abs(got[i] - e) < 1e-12 for i, e in enumerate(expected))


def test_unusable_candidate_scores_null(spark):
    moments = scoring.corpus_moments(frame(spark, unit_rows(20, 4, 1)), "v")
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, None), (3, [None] * 4)], "id long, v array<double>")
    got = {r["id"]: r["score"] for r in scoring.with_moment_score(rows, "v", moments).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None


def test_nearest_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 50)
    corpus, queries = unit_rows(70, 6, 3), unit_rows(9, 6, 4)
    corpus[10] = corpus[20]  # a tie
    found = scoring.nearest_rows(frame(spark, queries), frame(spark, corpus), "id", "id", "v", 4).collect()
    for q, row in enumerate(np.round(queries @ corpus.T, 12)):
        expected = sorted(range(70), key=lambda i: (-row[i], i))[:4]
        got = [r["neighbour"] for r in sorted((r for r in found if r["query"] == q), key=lambda r: r["rank"])]
        assert got == expected


def test_unit_of_zero_vector(spark):
    row = spark.range(1).select(vx.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vx.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u")).first()
    assert row["z"] == [None, None] and row["u"] == [0.6, 0.8]


def brute_density(x, eps, k):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= k
    label = {}
    for start in range(len(x)):
        if core[start] and start not in label:
            label[start], todo = start, [start]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if j not in label:
                        label[int(j)] = start
                        todo.append(int(j))
    out = []
    for i in range(len(x)):
        out.append(label[i] if core[i] else min((label[int(j)] for j in np.flatnonzero(near[i] & core)), default=-1))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_density_clusters_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(np.concatenate([rng.normal(c, 0.25, size=(30, 2)) for c in ((0, 0), (2, 0), (2, 1.2))] + [rng.uniform(-3, 5, size=(25, 2))]), 3)
    x[40] = x[41] = x[42]  # copies are compared once
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(a) for a in x[i]]) for i in order], "id long, v array<double>").repartition(3)
    got = {r["id"]: r["cluster"] for r in density.density_clusters(df, "id", "v", 0.35, 5).collect()}
    assert [got[i] for i in range(len(x))] == brute_density(x, 0.35, 5)


def test_chain_of_edges_is_one_component(spark):
    nodes = spark.range(40)
    edges = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in clusters.connected_labels(nodes, edges).collect()} == {0}


def test_best_direction_never_falls_and_ways_agree(spark, monkeypatch):
    x = unit_rows(80, 7, 5) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x)
    scores = [clusters.best_direction(df, "v", [1.0] + [0.0] * 6, max_iter=n).first()["score"] for n in (1, 2, 5, 60)]
    assert all(b >= a - 1e-12 for a, b in zip(scores, scores[1:]))
    moments = clusters.best_direction(df, "v", [1.0] * 7, max_iter=8).first()
    monkeypatch.setattr(clusters, "MOMENT_DIM_LIMIT", 1)
    passes = clusters.best_direction(df, "v", [1.0] * 7, max_iter=8).first()
    assert abs(moments["score"] - passes["score"]) < 1e-12
    direct = ((x @ np.array(moments["direction"])) ** 3).mean()
    assert abs(moments["score"] - direct) < 1e-12


def test_projection_and_kmeans_invariants(spark):
    x = unit_rows(60, 8, 6)
    projected = clusters.project(frame(spark, x), "v", 3)
    mean = np.mean([r["projected"] for r in projected.collect()], axis=0)
    assert np.allclose(mean, 0, atol=1e-9)
    ratios = clusters.explained_variance(frame(spark, x), "v", 3)
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) <= 1 + 1e-9
    labelled, centres = clusters.kmeans(projected, "projected", 4)
    assert labelled.count() == 60 and centres.count() == 4


def test_lowest_nll_and_ties(spark):
    logprobs = spark.createDataFrame([(1, 7, -1.0), (1, 7, -3.0), (1, 5, -2.0), (1, 9, -9.0)], "example_id long, candidate_id long, logprob double")
    nll = evaluate.mean_token_nll(logprobs)
    assert {r["candidate_id"]: r["nll"] for r in nll.collect()} == {7: 2.0, 5: 2.0, 9: 9.0}
    assert evaluate.lowest_nll(nll).first()["candidate_id"] == 5
