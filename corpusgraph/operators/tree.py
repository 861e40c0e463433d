"""Clustering trees: reduced vectors, Gaussian mixtures chosen by BIC, soft members, summary nodes, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusgraph.operators import sequences
from corpusgraph.plans.scratch import Scratch

_MODEL = "grp {kind}, k int, bic double, centre array<double>, axes array<double>, weight array<double>, mean array<double>, root array<double>"


#: Groups of up to so many rows are fitted in one task; larger ones by passes over all tasks. LARGE of those share the passes.
WHOLE, LARGE = 20_000, 64


def spread(x: np.ndarray) -> np.ndarray:
    """Number, sum and products of rows, flat: sums over parts add up to that of the whole."""
    return np.r_[len(x), x.sum(0), (x.T @ x).ravel()]


def principal(moments: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and axes (columns) of the most variance; signs are fixed by the largest entry of each axis."""
    n, width = moments[0], int(np.sqrt(len(moments) - 1))
    centre = moments[1 : width + 1] / n
    _, v = np.linalg.eigh(moments[width + 1 :].reshape(width, width) / n - np.outer(centre, centre))
    axes = v[:, ::-1][:, :dims]
    return centre, axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])


def log_density(y: np.ndarray, weight: np.ndarray, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    """log(weight * density) of each row and component; root holds inverse Cholesky factors of full covariances."""
    return expand(y) @ coefficients(weight, mean, root)


def expand(y: np.ndarray) -> np.ndarray:
    """1, the entries and their products: what weights, means and covariances are sums of."""
    i, j = np.triu_indices(y.shape[1])
    return np.c_[np.ones(len(y)), y, y[:, i] * y[:, j]]


def coefficients(weight: np.ndarray, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    """log(weight * density) of each component as a sum over expand's columns."""
    d = mean.shape[1]
    i, j = np.triu_indices(d)
    sharp = root.transpose(0, 2, 1) @ root
    to = np.einsum("kij,kj->ki", sharp, mean)
    fixed = np.log(weight) + np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1) - 0.5 * d * np.log(2 * np.pi) - 0.5 * (to * mean).sum(1)
    return np.c_[fixed, to, -np.where(i == j, 0.5, 1.0) * sharp[:, i, j]].T


def maximise(sums: np.ndarray, d: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and inverse roots from each component's sums of share * expand(y)."""
    i, j = np.triu_indices(d)
    size = sums[:, 0] + 1e-9
    mean, cov = sums[:, 1 : d + 1] / size[:, None], np.empty((len(sums), d, d))
    cov[:, i, j] = cov[:, j, i] = sums[:, d + 1 :] / size[:, None]
    cov += ridge * np.eye(d) - (2 - sums[:, 0] / size)[:, None, None] * mean[:, :, None] * mean[:, None, :]
    return size / size.sum(), mean, np.linalg.inv(np.linalg.cholesky(cov))


def expect(wide: np.ndarray, factors: np.ndarray) -> tuple[float, np.ndarray]:
    """The log likelihood of rows (expanded) and, for each component, the sums of share * row."""
    log = wide @ factors
    most = log.max(1, keepdims=True)
    share = np.exp(log - most)
    size = share.sum(1, keepdims=True)
    return float((most + np.log(size)).sum()), (share / size).T @ wide


def largest_k(n: int, most_k: int) -> int:
    return max(2, min(most_k, n // 2, n - 1))


def nearest(y: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    """For 1, 2, ... seeds, each row's nearest of them."""
    best, least = np.zeros(len(y), int), np.full(len(y), np.inf)
    for s, seed in enumerate(seeds):
        away = ((y - seed) ** 2).sum(1)
        best, least = np.where(away < least, s, best), np.minimum(away, least)
        yield best


def starts(y: np.ndarray, wide: np.ndarray, seeds: np.ndarray) -> dict[int, np.ndarray]:
    """First sums for each number of parts from 2: every row is its nearest seed's."""
    return {k: np.eye(k)[own].T @ wide for k, own in enumerate(nearest(y, seeds), 1) if k > 1}


class Search:
    """Expectation maximisation of one group for every number of parts at once; whoever holds the rows answers each round.

    asked() has the factors of the parts still to be improved; told(k, total, sums) takes the answer. As the sums
    are all that is needed of the rows, they can come from one task or be added up over many.
    """

    def __init__(self, n: int, d: int, sums: dict[int, np.ndarray], rounds: int = 200) -> None:
        self.n, self.d, self.rounds, self.sums, self.left = n, d, rounds, sums, dict.fromkeys(sums, rounds)
        self.last, self.model, self.best = dict.fromkeys(sums, -np.inf), {}, None

    def asked(self) -> dict[int, np.ndarray]:
        out = {}
        for k in list(self.left):
            try:
                self.model[k] = maximise(self.sums[k], self.d)
                out[k] = coefficients(*self.model[k])
            except np.linalg.LinAlgError:
                del self.left[k]
        return out

    def told(self, k: int, total: float, sums: np.ndarray) -> None:
        self.sums[k], self.left[k] = sums, self.left[k] - 1
        if total - self.last[k] < 1e-3 * self.n or not self.left[k]:
            del self.left[k]
            free = k - 1 + k * self.d + k * self.d * (self.d + 1) // 2
            found = (free * np.log(self.n) - 2 * total, k)
            self.best = found if self.best is None else min(self.best, found)
        self.last[k] = total

    def row(self, grp: object, centre: np.ndarray, axes: np.ndarray) -> tuple | None:
        if self.best is None:
            return None
        bic, k = self.best
        weight, mean, root = self.model[k]
        return grp, k, float(bic), *(x.ravel().tolist() for x in (centre, axes, weight, mean, root))


_COLUMNS = ["grp", "k", "bic", "centre", "axes", "weight", "mean", "root"]


def fit(rows: DataFrame, dims: int = 10, most_k: int = 50, whole: int = WHOLE) -> DataFrame:
    """One model per group of rows (grp, id, vector): the mixture of least BIC among 2 to max(2, min(most_k, n / 2, n - 1)) parts.

    Every number of parts is tried, on all rows of a group; ties of BIC go to the smaller number. A group of under
    3 rows has no model. Principal axes stand in for a neighbour embedding. Groups of up to whole rows are fitted in one
    task each. The rows of larger ones stay where they are: each round sends the models out and adds up
    log likelihoods and sums per group and number of parts, so no group, however large, fills a task.
    """
    kind = dict(rows.dtypes)["grp"]
    schema = _MODEL.format(kind=kind)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x = np.array(frame["vector"].tolist(), float)
        n, found = len(x), None
        if n >= 3:
            centre, axes = principal(spread(x), min(dims, n - 1))
            y = (x - centre) @ axes
            seeds, away = [int((y**2).sum(1).argmax())], np.full(n, np.inf)
            while len(seeds) < largest_k(n, most_k):
                away = np.minimum(away, ((y - y[seeds[-1]]) ** 2).sum(1))
                seeds.append(int(away.argmax()))
            wide = expand(y)
            search = Search(n, y.shape[1], starts(y, wide, y[seeds]))
            while asked := search.asked():
                for k, factors in asked.items():
                    search.told(k, *expect(wide, factors))
            found = search.row(frame["grp"].iloc[0], centre, axes)
        return pd.DataFrame([found] if found else [], columns=_COLUMNS)

    large = sizes.where(F.col("n") > whole).orderBy("grp").collect()
    if not large:
        return rows.groupBy("grp").applyInPandas(one, schema)
    marked = rows.sparkSession.createDataFrame([(r["grp"], i, r["n"]) for i, r in enumerate(large)], f"g {kind}, gid int, n long")
    every = rows.join(F.broadcast(marked), F.col("grp").eqNullSafe(F.col("g")), "left")
    out = every.where("gid IS NULL").select("grp", "id", "vector").groupBy("grp").applyInPandas(one, schema)
    for lo in range(0, len(large), LARGE):
        out = out.unionByName(_fit_large(every.where(F.col("gid").between(lo, lo + LARGE - 1)), {i: large[i] for i in range(lo, min(lo + LARGE, len(large)))}, dims, most_k, schema))
    return out


def _added(rows: DataFrame, answer: Callable[[int, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """answer gives (key, numbers) for the ids and vectors of a part of a group; their sums over all parts, by (group, key)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for gid, mine in batch.groupby("gid"):
                for key, numbers in answer(int(gid), mine["id"].to_numpy(), np.array(mine["vector"].tolist(), float)):
                    total[int(gid), key] = total.get((int(gid), key), 0) + numbers
        yield pd.DataFrame([(g, k, v.tobytes()) for (g, k), v in total.items()], columns=["gid", "key", "x"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in sorted(frame["x"])], axis=0)
        return pd.DataFrame([(frame["gid"].iloc[0], frame["key"].iloc[0], total.tobytes())], columns=["gid", "key", "x"])

    found = rows.select("gid", "id", "vector").mapInPandas(part, "gid int, key int, x binary").groupBy("gid", "key").applyInPandas(add, "gid int, key int, x binary")
    return {(r["gid"], r["key"]): np.frombuffer(r["x"]) for r in found.collect()}


def _farthest(rows: DataFrame, seeds: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Each group's row farthest from its seeds; of equals the one of least id."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for gid, mine in batch.groupby("gid"):
                y = np.array(mine["vector"].tolist(), float)
                away = np.min([((y - s) ** 2).sum(1) for s in seeds[int(gid)]], axis=0)
                most = mine.assign(away=away)[away == away.max()].sort_values("id").iloc[:1]
                yield most[["gid", "id", "away", "vector"]]

    far = rows.select("gid", "id", "vector").mapInPandas(part, f"gid int, id {dict(rows.dtypes)['id']}, away double, vector array<double>")
    best = far.groupBy("gid").agg(F.min_by("vector", F.struct((-F.col("away")).alias("away"), "id")).alias("vector"))
    return {r["gid"]: np.array(r["vector"]) for r in best.collect()}


def _fit_large(rows: DataFrame, groups: dict[int, Row], dims: int, most_k: int, schema: str) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "mixtures")
    raw = scratch.save(rows.select("gid", "id", F.transform("vector", lambda x: x.cast("double")).alias("vector")), "raw")
    moments = _added(raw, lambda gid, ids, x: iter([(0, spread(x))]))
    axes = {g: principal(moments[g, 0], min(dims, groups[g]["n"] - 1)) for g in groups}

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for gid, mine in batch.groupby("gid"):
                centre, to = axes[int(gid)]
                yield mine.assign(vector=list((np.array(mine["vector"].tolist(), float) - centre) @ to))[["gid", "id", "vector"]]

    y = scratch.save(raw.mapInPandas(turned, raw.schema), "turned")
    scratch.free("raw")
    seeds = {g: np.zeros((0, a[1].shape[1])) for g, a in axes.items()}
    for _ in range(max(largest_k(r["n"], most_k) for r in groups.values())):
        far = _farthest(y, {g: s if len(s) else np.zeros((1, s.shape[1])) for g, s in seeds.items()})
        seeds = {g: np.r_[s, far[g][None]] if len(s) < largest_k(groups[g]["n"], most_k) else s for g, s in seeds.items()}
    first = _added(y, lambda gid, ids, x: ((k, s.ravel()) for k, s in starts(x, expand(x), seeds[gid]).items()))
    searches = {g: Search(r["n"], seeds[g].shape[1], {k: s.reshape(k, -1) for (gid, k), s in first.items() if gid == g}) for g, r in groups.items()}
    while asked := {g: a for g, x in searches.items() if (a := x.asked())}:

        def round_of(gid: int, ids: np.ndarray, x: np.ndarray, asked: dict = asked) -> Iterator[tuple[int, np.ndarray]]:
            if gid in asked:
                wide = expand(x)
                for k, factors in asked[gid].items():
                    total, sums = expect(wide, factors)
                    yield k, np.r_[total, sums.ravel()]

        for (g, k), numbers in _added(y, round_of).items():
            searches[g].told(k, numbers[0], numbers[1:].reshape(k, -1))
    scratch.free("turned")
    return rows.sparkSession.createDataFrame([r for g, x in searches.items() if (r := x.row(groups[g]["grp"], *axes[g]))], schema)


def members(rows: DataFrame, models: DataFrame, least: float = 0.3) -> DataFrame:
    """grp, id, cluster, share, hard: every row's clusters of at least that share, and always its likeliest one.

    All rows are scored in Arrow batches against their group's model; rows of groups without a model have none.
    """
    joined = rows.select("grp", "id", "vector").join(models, "grp")
    kinds = dict(rows.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=False, dropna=False):
                m = part.iloc[0]
                x, centre = np.array(part["vector"].tolist(), float), np.asarray(m["centre"])
                k, d = int(m["k"]), len(m["axes"]) // len(centre)
                y = (x - centre) @ np.asarray(m["axes"]).reshape(len(centre), d)
                log = log_density(y, np.asarray(m["weight"]), np.asarray(m["mean"]).reshape(k, d), np.asarray(m["root"]).reshape(k, d, d))
                share = np.exp(log - log.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                hard = share.argmax(1)
                own = np.arange(k) == hard[:, None]
                who, what = np.nonzero((share >= least) | own)
                yield pd.DataFrame({"grp": grp, "id": part["id"].to_numpy()[who], "cluster": what.astype(np.int32), "share": share[who, what], "hard": own[who, what]})

    return joined.mapInPandas(score, f"grp {kinds['grp']}, id {kinds['id']}, cluster int, share double, hard boolean")


def build(leaves: DataFrame, levels: int = 4, fewest: int = 3, sample: int | None = None, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Nodes (grp, node, level, vector) and links (grp, parent, child) of one tree per group of leaves (grp, id, vector).

    A level's nodes are clustered; each cluster of two or more becomes a summary node with the mean vector of its
    members (the offline stand-in for embedding a written summary). It ends at levels, or once no group has
    fewest nodes. A node may have several parents. Levels are kept as tables; of groups larger than whole only the models
    are collected. sample has no effect any more (a level's models are fitted on all rows).
    """
    scratch = Scratch(leaves.sparkSession, "tree")
    vector = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    nodes = scratch.save(leaves.select("grp", F.concat(F.lit("leaf_"), F.col("id").cast("string")).alias("node"), F.lit(0).alias("level"), vector), "0")
    all_nodes, all_links = nodes, None
    for level in range(1, levels + 1):
        rich = nodes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= fewest).select("grp")
        rows = nodes.join(rich, "grp", "left_semi").withColumnRenamed("node", "id")
        found = scratch.save(members(rows, scratch.save(fit(rows, whole=whole), f"models{level}")), f"members{level}")
        links = found.select("grp", F.concat(F.lit(f"summary_{level}_"), F.col("cluster").cast("string")).alias("parent"), F.col("id").alias("child"))
        many = links.groupBy("grp", "parent").agg(F.count("*").alias("n")).where("n >= 2").select("grp", "parent")
        links = scratch.save(links.join(many, ["grp", "parent"], "left_semi"), f"links{level}")
        each = links.join(rows.withColumnRenamed("id", "child"), ["grp", "child"]).select("grp", "parent", F.posexplode("vector").alias("pos", "x"))
        means = each.groupBy("grp", "parent", "pos").agg(F.avg("x").alias("x")).groupBy("grp", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
        new = scratch.save(means.select("grp", F.col("parent").alias("node"), F.lit(level).alias("level"), "vector"), f"{level}")
        all_links = links if all_links is None else all_links.unionAll(links)
        if not new.take(1):
            break
        all_nodes, nodes = all_nodes.unionAll(new), new
    return all_nodes, all_links


def level_counts(nodes: DataFrame) -> DataFrame:
    """grp, level, n."""
    return nodes.groupBy("grp", "level").agg(F.count("*").alias("n"))


def of_clusters(found: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of found (share, hard) that count as members: the likeliest cluster alone, or every one of at least that share, so that a row may be in several or none."""
    return found.where("hard") if least is None else found.where(F.col("share") >= least)


def reduced(rows: DataFrame, dims: int = 10) -> DataFrame:
    """grp, id, coordinates of rows (grp, id, vector) on their group's axes of most variance, at most one less than its rows.

    Groups' moments are summed up by all tasks, and only those (one matrix a group) meet in one; rows stay where they are.
    """
    kinds = dict(rows.dtypes)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            for grp, mine in batch.groupby("grp", dropna=False):
                total[grp] = total.get(grp, 0) + spread(np.array(mine["vector"].tolist(), float))
        yield pd.DataFrame([(g, x.tobytes()) for g, x in total.items()], columns=["grp", "x"])

    def axes(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in sorted(frame["x"])], axis=0)
        centre, to = principal(total, max(1, min(dims, int(total[0]) - 1)))
        return pd.DataFrame([(frame["grp"].iloc[0], centre.tolist(), to.ravel().tolist())], columns=["grp", "centre", "axes"])

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, mine in batch.groupby("grp", dropna=False):
                centre = np.asarray(mine["centre"].iloc[0])
                y = (np.array(mine["vector"].tolist(), float) - centre) @ np.asarray(mine["axes"].iloc[0]).reshape(len(centre), -1)
                yield mine.assign(coordinates=list(y))[["grp", "id", "coordinates"]]

    models = rows.select("grp", "vector").mapInPandas(part, f"grp {kinds['grp']}, x binary").groupBy("grp").applyInPandas(axes, f"grp {kinds['grp']}, centre array<double>, axes array<double>")
    return rows.select("grp", "id", "vector").join(models, "grp").mapInPandas(turned, f"grp {kinds['grp']}, id {kinds['id']}, coordinates array<double>")


def summary_nodes(links: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """node, grp, cluster, children, vector, context, section: a summary node for each cluster of two or more of links (grp, cluster, id).

    nodes is (grp, id, vector, section). The vector is the mean of the members'; the context names up to three sections
    in order, or their number. Children are in the order of their ids.
    """
    joined = links.join(nodes, ["grp", "id"])
    base = joined.groupBy("grp", "cluster").agg(F.array_sort(F.collect_set("id")).alias("children"), F.array_sort(F.collect_set(F.when(F.col("section") != "", F.col("section")))).alias("sections"))
    each = joined.select("grp", "cluster", F.posexplode("vector").alias("pos", "x")).groupBy("grp", "cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy("grp", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("vector"))
    book = F.col("grp").cast("string")
    told = F.when(F.size("sections") <= 3, F.array_join("sections", ", ")).otherwise(F.concat(F.size("sections").cast("string"), F.lit(" sections")))
    return base.where(F.size("children") >= 2).join(mean, ["grp", "cluster"]).select(
        F.concat(book, F.lit(f"::L{level}_cluster_"), F.col("cluster").cast("string")).alias("node"), "grp", "cluster", "children", "vector",
        F.concat(book, F.lit(f" > Level {level} Summary ("), told, F.lit(")")).alias("context"), F.concat(F.lit(f"Level {level} Cluster "), F.col("cluster").cast("string"), F.lit(" Summary")).alias("section"),
    )


def summary_context(nodes: DataFrame, most: int = 8000, key: str = "cluster", order: str = "id", text: str = "text") -> DataFrame:
    """key, context: the texts of each cluster's nodes in order, as many as most tokens (4 characters each) hold, the last one cut; what a summary is written from."""
    kept = sequences.within_budget(nodes.select(key, order, F.trim(F.coalesce(text, F.lit(""))).alias("text")), "text", most, key=key, order=order)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "kept"))), lambda x: x["kept"]), "\n\n---\n\n").alias("context"))
