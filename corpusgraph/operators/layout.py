"""Neighbour embedding of groups of vectors: fuzzy neighbour graphs, laid out in few dimensions by sampled gradients.

After McInnes, Healy and Melville, "UMAP: Uniform Manifold Approximation and Projection" (2018). A group's layout is fitted on at most
LANDMARKS of its rows, those of least hash, in one task; every other row is placed at its nearest landmarks, in cells of
bounded size, so that no task holds a large group.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators.tree import principal, spread
from corpusgraph.plans.scratch import Scratch

LANDMARKS, NEIGHBOURS, DIMS, CELL = 1000, 10, 10, 1 << 15
#: The curve 1 / (1 + A * d ** (2 * B)) that fits a least distance of 0.
A, B = 1.9328, 0.7904
EPOCHS, AGAINST, STEP, CLIP, WIDTH = 200, 5, 1.0, 4.0, 10.0
LEAST = 5


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(float)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size == 0, 1, size)[:, None]


def nearest(x: np.ndarray, among: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosine distances of the k rows of among nearest to each row of x; with own, x is among and a row isn't its own neighbour."""
    places, apart = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for lo in range(0, len(x), 1024):
        d = 1 - x[lo : lo + 1024] @ among.T
        if own:
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        places[lo : lo + 1024], apart[lo : lo + 1024] = at, np.maximum(np.take_along_axis(d, at, axis=1), 0)
    return places, apart


def memberships(apart: np.ndarray) -> np.ndarray:
    """How much each neighbour belongs to a row: 1 for the nearest, then falling at a pace that makes them sum to log2(k)."""
    goal, k = np.log2(apart.shape[1]), apart.shape[1]
    beyond = apart - apart[:, :1]
    low, high = np.zeros(len(apart)), np.full(len(apart), np.inf)
    pace = np.maximum(beyond.mean(1), 1e-9)
    for _ in range(64 if k > 1 else 0):
        over = np.exp(-beyond / pace[:, None]).sum(1) > goal
        high, low = np.where(over, pace, high), np.where(over, low, pace)
        pace = np.where(np.isinf(high), pace * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    return np.exp(-beyond / np.maximum(pace, 1e-12)[:, None])


def graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (from, to, weight) of the fuzzy union: that either of two rows is the other's neighbour."""
    places, apart = nearest(x, x, k, own=True)
    n = len(x)
    codes = (np.repeat(np.arange(n), k) * n + places.ravel()).astype(np.int64)
    back = codes % n * n + codes // n
    every, at = np.unique(np.r_[codes, back], return_inverse=True)
    w = memberships(apart).ravel()
    there, here = np.zeros(len(every)), np.zeros(len(every))
    there[at[: len(codes)]], here[at[len(codes) :]] = w, w
    return every // n, every % n, there + here - there * here


def lay_out(x: np.ndarray, k: int, dims: int, epochs: int = EPOCHS, seed: int = 11) -> np.ndarray:
    """Positions of the rows of x: from their principal axes on, edges draw their ends together as often as their weight says, and random rows push apart."""
    r = np.random.default_rng(seed)
    source, target, weight = graph(x, k)
    centre, axes = principal(spread(x), dims)
    y = (x - centre) @ axes
    y = np.pad(y, ((0, 0), (0, dims - y.shape[1])))
    y = WIDTH * y / max(np.abs(y).max(), 1e-12) + r.normal(0, 1e-3, (len(x), dims))
    share = weight / weight.max()
    for epoch in range(epochs):
        step = STEP * (1 - epoch / epochs)
        drawn = r.random(len(share)) < share
        a, b = source[drawn], target[drawn]
        apart = y[a] - y[b]
        d2 = (apart * apart).sum(1)
        pull = np.where(d2 > 0, -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B), 0.0) if len(d2) else d2
        move = np.zeros_like(y)
        np.add.at(move, a, np.clip(np.where(np.isfinite(pull), pull, 0)[:, None] * apart, -CLIP, CLIP))
        other = r.integers(0, len(x), (AGAINST, len(a)))
        for o in other:
            apart = y[a] - y[o]
            d2 = (apart * apart).sum(1)
            push = np.where(o == a, 0.0, 2 * B / ((1e-3 + d2) * (1 + A * d2**B)))
            np.add.at(move, a, np.clip(push[:, None] * apart, -CLIP, CLIP))
        # Moves of an epoch are made at once, so a row's are averaged over its edges.
        y = y + step * move / np.maximum(np.bincount(a, minlength=len(x)), 1)[:, None]
    return y


def neighbours_of(n: int, most: int) -> int:
    """As many neighbours as the root of the group's other rows, `most` at most."""
    return min(most, int(np.sqrt(max(n - 1, 0))))


def _fitted(dims: int, most: int, epochs: int, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", "id"], kind="stable")
    k = neighbours_of(len(rows), most)
    y = lay_out(unit(rows["vector"]), k, dims, epochs) if k >= 2 else np.empty((0, dims))
    return pd.DataFrame({"grp": rows["grp"][: len(y)], "id": rows["id"][: len(y)], "vector": rows["vector"][: len(y)], "place": pd.Series(list(y), rows.index[: len(y)], object)})


def _placed(most: int, rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """Rows at the means of their nearest landmarks, weighed by membership; landmarks where they are."""
    if not len(rows) or not len(marks):
        return pd.DataFrame({"grp": rows["grp"][:0], "id": rows["id"][:0], "coordinates": np.empty(0, object)})
    marks = marks.sort_values("id", kind="stable")
    at, y = {v: i for i, v in enumerate(marks["id"])}, np.stack(marks["place"].to_list())
    places, apart = nearest(unit(rows["vector"]), unit(marks["vector"]), max(1, neighbours_of(len(marks), most)), own=False)
    w = memberships(apart)
    out = (w[:, :, None] * y[places]).sum(1) / w.sum(1)[:, None]
    known = np.array([at.get(v, -1) for v in rows["id"]])
    out[known >= 0] = y[known[known >= 0]]
    return pd.DataFrame({"grp": rows["grp"].to_numpy(), "id": rows["id"].to_numpy(), "coordinates": list(out)})


def embedded(rows: DataFrame, dims: int = DIMS, neighbours: int = NEIGHBOURS, landmarks: int = LANDMARKS, epochs: int = EPOCHS) -> DataFrame:
    """grp, id, coordinates of rows (grp, id, vector): vectors that are near by cosine are near in dims coordinates.

    Groups of fewer than LEAST rows stop here: they have no rows in the result. Rows with a null vector take no part; ids are distinct within a group. Equal inputs give equal
    coordinates over any partitioning. What is bounded: the rows that a group's layout is fitted on (`landmarks`); all rows are placed.
    """
    scratch = Scratch(rows.sparkSession, "layout")
    kinds = dict(rows.dtypes)
    plain = rows.where("vector IS NOT NULL").select("grp", "id", F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("id").alias("draw"))
    first = F.row_number().over(W.partitionBy("grp").orderBy("draw", "id"))
    marks = plain.withColumn("nth", first).where(F.col("nth") <= landmarks).drop("nth")
    fitted = marks.groupBy("grp").applyInPandas(lambda rows: _fitted(dims, neighbours, epochs, rows), f"grp {kinds['grp']}, id {kinds['id']}, vector array<double>, place array<double>")
    fitted = scratch.save(fitted, "fitted")
    sizes = plain.groupBy("grp").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.count("*").alias("n")).where(F.col("n") >= LEAST).drop("n")
    sizes = scratch.save(sizes, "sizes")
    mine = plain.join(sizes, "grp").withColumn("part", F.pmod("draw", "parts").cast("int")).select("grp", "part", "id", "vector")
    theirs = fitted.join(sizes, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", "part", "id", "vector", "place")
    return mine.groupBy("grp", "part").cogroup(theirs.groupBy("grp", "part")).applyInPandas(partial(_placed, neighbours), f"grp {kinds['grp']}, id {kinds['id']}, coordinates array<double>")
