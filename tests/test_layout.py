"""Neighbour embedding: memberships, planted clusters, small groups, landmarks, and equal results over partitionings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.operators import layout, tree


def _planted(n, seed, clusters=5, dims=24):
    """Clusters that principal axes of the whole don't separate by far: tight around centres of equal spread in all directions."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    of = np.arange(n) % clusters
    return of, centres[of] + 0.35 * r.normal(size=(n, dims))


def test_memberships():
    r = np.random.default_rng(1)
    apart = np.sort(r.random((50, 8)), axis=1)
    apart[3] = 0.2  # all alike
    w = layout.memberships(apart)
    others = np.arange(50) != 3
    assert np.allclose(w[:, 0], 1) and np.allclose(w[others].sum(1), np.log2(8), atol=1e-3) and (np.diff(w, axis=1) <= 1e-12).all()


def test_graph():
    """Weights are those of a plain fuzzy union."""
    x = layout.unit(__import__("pandas").Series(list(np.random.default_rng(2).normal(size=(40, 5)))))
    places, apart = layout.nearest(x, x, 4, own=True)
    w, dense = layout.memberships(apart), np.zeros((40, 40))
    for i in range(40):
        assert i not in places[i]
        dense[i, places[i]] = w[i]
    union = dense + dense.T - dense * dense.T
    source, target, weight = layout.graph(x, 4)
    got = np.zeros((40, 40))
    got[source, target] = weight
    assert np.allclose(got, union)


def _near_share(y, of, k=5):
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return (of[np.argsort(d, axis=1)[:, :k]] == of[:, None]).mean()


def test_planted_clusters(spark):
    of, x = _planted(300, 3)
    _, small = _planted(4, 4)
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, i, v.tolist()) for i, v in enumerate(small)] + [(3, 0, None)] + [(4, i, [1.0, 2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "grp int, id long, vector array<double>")
    got = layout.embedded(df, dims=4).collect()
    assert {r["grp"] for r in got} == {1, 4} and len(got) == 309
    y = np.array([r["coordinates"] for r in sorted((r for r in got if r["grp"] == 1), key=lambda r: r["id"])])
    assert y.shape == (300, 4) and np.isfinite(y).all() and _near_share(y, of) > 0.98
    # Clusters lie apart: a mixture over the coordinates finds them all.
    found = tree.fit(layout.embedded(df.where("grp = 1"), dims=4).withColumnRenamed("coordinates", "vector"), dims=4, most_k=10)
    assert found.first()["k"] >= 5
    again = layout.embedded(df.repartition(7), dims=4).collect()
    assert sorted(map(tuple, [(r["grp"], r["id"], *r["coordinates"]) for r in again])) == sorted(map(tuple, [(r["grp"], r["id"], *r["coordinates"]) for r in got]))


def test_landmarks(spark, monkeypatch):
    """Most rows are placed at landmarks, in several cells, and keep their clusters."""
    monkeypatch.setattr(layout, "CELL", 100)
    of, x = _planted(600, 5)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "grp string, id long, vector array<double>")
    got = layout.embedded(df, dims=4, landmarks=120).orderBy("id").select("id", F.col("coordinates").alias("y")).collect()
    assert [r["id"] for r in got] == list(range(600))
    assert _near_share(np.array([r["y"] for r in got]), of) > 0.98


def test_empty(spark):
    assert layout.embedded(spark.createDataFrame([], "grp int, id long, vector array<double>")).count() == 0
