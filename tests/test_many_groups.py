"""Neighbours, clusters and directions at numbers of rows, centres and groups that no single task could take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import clusters, density, neighbours, scoring


def unit(rng, n, dim, spread=0.25, centres=20):
    x = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name="id", kind="long"):
    cast = str if kind == "string" else int
    return spark.createDataFrame([(cast(i), [float(a) for a in v]) for i, v in enumerate(x)], f"{name} {kind}, v array<double>").repartition(4).cache()


def test_approximate_rows_find_most_neighbours(spark):
    rng = np.random.default_rng(0)
    corpus, asked = frame(spark, unit(rng, 6000, 32, 0.6), kind="string"), frame(spark, unit(rng, 60, 32, 0.6))
    exact = scoring.nearest_rows(asked, corpus, "id", "id", "v", 5).cache()
    found = neighbours.approximate_rows(asked, corpus, "id", "id", "v", 5).cache()
    plain, audited = neighbours.recall(found, exact), neighbours.audited_rows(asked, corpus, "id", "id", "v", 5, sample=40)
    assert audited[1] >= 0.95 and neighbours.recall(audited[0], exact) >= 0.95
    assert 0.5 < plain <= 1
    known = {(r["query"], r["neighbour"]): r["similarity"] for r in exact.collect()}
    assert all(abs(known.get((r["query"], r["neighbour"]), r["similarity"]) - r["similarity"]) < 1e-12 for r in found.collect())


def test_approximate_rows_with_every_bucket_are_the_exact_ones(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 40)  # hot buckets are cut into tiles
    rng = np.random.default_rng(1)
    x = unit(rng, 300, 8)
    x[50:200] = x[49]  # many copies of one vector
    corpus, asked = frame(spark, x), frame(spark, unit(rng, 20, 8))
    exact = scoring.nearest_rows(asked, corpus, "id", "id", "v", 4).collect()
    found = neighbours.approximate_rows(asked, corpus, "id", "id", "v", 4, tables=1, bits=2, probes=4).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, exact))


def test_approximate_rows_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id long, v array<double>")
    some = frame(spark, np.eye(3))
    assert neighbours.approximate_rows(some, empty, "id", "id", "v", 2).collect() == []
    assert neighbours.approximate_rows(empty, some, "id", "id", "v", 2).collect() == []


def test_density_compares_few_pairs(spark):
    x = unit(np.random.default_rng(2), 3000, 24, 0.05, 60)
    points = frame(spark, x)
    cells = density.Cells(points, 0.2)
    assert cells.comparisons(points, points) < 3000 * 3000 / 8
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2
    got = cells.meet(points, points, lambda m, a, o, b: {"id": m.column("id").to_numpy(), "n": density.close(a, b, 0.2).sum(axis=1)}, "id long, n long")
    counted = {r["id"]: r["n"] for r in got.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert counted == dict(enumerate(near.sum(axis=1).tolist()))


def test_density_with_hot_cells_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(density, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.02, size=(200, 2)), rng.normal(3, 0.4, size=(60, 2))])
    whole = {r["id"]: r["cluster"] for r in density.density_clusters(frame(spark, x), "id", "v", 0.3, 5).collect()}
    named = {r["id"]: r["cluster"] for r in density.density_clusters(frame(spark, x, kind="string"), "id", "v", 0.3, 5).collect()}
    groups = lambda labels: {frozenset(k for k in labels if labels[k] == c) for c in set(labels.values())}
    assert groups({str(k): c for k, c in whole.items()}) == groups(named)
    assert len(set(whole.values())) > 1
    for name in set(named.values()) - {None}:
        assert named[name] == name
    assert density.density_clusters(spark.createDataFrame([], "id string, v array<double>"), "id", "v").collect() == []


def test_nearest_centre_by_blocks_is_that_of_one_block(spark):
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.normal(size=(200, 6))).unionByName(spark.createDataFrame([(900, None)], "id long, v array<double>"))
    centres = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(60, 6)))] + [(60, [0.0] * 6), (61, [0.0] * 6)], "cluster int, centre array<double>")
    key = lambda df: sorted((r["id"], r["nearest"], r["distance"] and round(r["distance"], 9)) for r in df.collect())
    one, many = (key(clusters.nearest_centre(rows, "v", centres, block_bytes=b)) for b in (None, 600))
    assert one == many and one[-1] == (900, None, None)
    assert {r["nearest"] for r in clusters.nearest_centre(rows, "v", centres.limit(0)).collect()} == {None}


@pytest.mark.parametrize("block_bytes", [None, 400])
def test_kmeans_is_lloyd_s_and_lowers_the_cost(spark, block_bytes):
    x = np.round(unit(np.random.default_rng(5), 240, 5, 0.3, 8), 6)
    labelled, centres = clusters.kmeans(frame(spark, x), "v", 12, ids=("id",), max_iter=4, block_bytes=block_bytes)
    import hashlib

    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"0#{i}".encode()).hexdigest())
    c = x[order[:12]].copy()
    start = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    for _ in range(4):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(12)])
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert {r["id"]: r["cluster"] for r in labelled.collect()} == dict(enumerate(own.tolist()))
    got = np.array([r["centre"] for r in centres.orderBy("cluster").collect()])
    assert np.allclose(got, c) and ((x - got[own]) ** 2).sum() <= start


def direct(x, e):
    return ((x @ e) ** 2)[:, None] * x


def test_a_thousand_groups_of_64_components(spark):
    rng = np.random.default_rng(6)
    x = np.abs(unit(rng, 4000, 64, 0.5, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"g{i % 1000}", [float(a) for a in v]) for i, v in enumerate(x)], "g string, v array<double>")
    found = clusters.best_direction(rows, "v", [1.0] * 64, group="g", max_iter=60, tolerance=1e-6).collect()
    assert len(found) == 1000 and all(r["score"] >= r["start_score"] for r in found) and max(r["residual"] for r in found) < 1e-4
    for r in found[:20]:
        own = x[int(r["grp"][1:]) :: 1000]
        assert abs(((own @ np.array(r["direction"])) ** 3).mean() - r["score"]) < 1e-9


@pytest.mark.parametrize("block_bytes", [None, 100])
def test_wide_vectors_of_many_groups_move_together(spark, block_bytes):
    rng = np.random.default_rng(7)
    x = np.abs(unit(rng, 400, 96, 0.5, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i % 50, [float(a) for a in v]) for i, v in enumerate(x)] + [(3, None), (None, [1.0] * 96)], "g int, v array<double>").repartition(2)
    found = clusters.best_direction(rows, "v", [1.0] * 96, group="g", max_iter=3, block_bytes=block_bytes).collect()
    assert len(found) == 50
    for r in found:
        own, e = x[r["grp"] :: 50], np.full(96, 96**-0.5)
        for _ in range(3):
            e = direct(own, e).mean(0) + 2 * e
            e /= np.linalg.norm(e)
        assert np.allclose(r["direction"], e) and abs(r["score"] - ((own @ e) ** 3).mean()) < 1e-12


def test_a_hot_group_is_added_up_in_shares(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TENSOR_ROWS", 50)
    x = unit(np.random.default_rng(8), 400, 6)
    rows = spark.createDataFrame([(0 if i % 4 else 1, [float(a) for a in v]) for i, v in enumerate(x)], "g long, v array<double>")
    found = {r["grp"]: r for r in clusters.best_direction(rows, "v", [1.0] * 6, group="g", max_iter=5).collect()}
    for g, own in ((1, x[::4]), (0, np.delete(x, slice(None, None, 4), axis=0))):
        e = np.array(found[g]["direction"])
        assert abs(((own @ e) ** 3).mean() - found[g]["score"]) < 1e-12


def test_a_shift_that_follows_the_curve_reaches_the_maximum_sooner(spark):
    x = np.random.default_rng(9).normal(size=(500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, x)
    slow = clusters.best_direction(rows, "v", [1.0] * 12, max_iter=200).first()
    quick = clusters.best_direction(rows, "v", [1.0] * 12, alpha=None, max_iter=200).first()
    assert quick["residual"] < 1e-6 and quick["score"] > quick["start_score"] and quick["residual"] < slow["residual"]


def test_moments_of_nothing(spark):
    moments = scoring.corpus_moments(spark.createDataFrame([(None,)], "v array<double>"), "v", 4)
    assert moments.count == 0 and not moments.tensor.any()
