"""A stored vector index: inverted lists with product-quantised residuals, exact reranking, and an exact mode that visits lists by bounds.

The model (centroids of lists, codebooks of residuals) is fitted on a bounded sample; every item is coded and filed. A
list that holds many items is dealt over several parts, so that no task reads a whole list however many items it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators.inverted_index import frame
from corpusgraph.plans.scratch import Scratch

#: Rows that the model is fitted on, the most lists, words of each codebook, components of each code, items of a part, queries that meet a part at once.
SAMPLE, LISTS, CODEWORDS, WIDTH, PART_ITEMS, BLOCK_QUERIES = 1 << 15, 1024, 256, 4, 1 << 16, 4096
#: Scores are rounded to six digits; a bound that is smaller by less than this is kept.
SLACK = 2e-6
MODEL = "lists int, dims int, width int, probes int, centroids binary, words binary"
#: Rows of the sample whose neighbours within the sample tell how many lists a search must visit, neighbours of each, and the share that it must find.
TRIALS, NEIGHBOURS, GOAL = 256, 10, 0.97


def _means(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    """k means of the rows of x by Lloyd's rounds from random rows; an empty one takes the row that is farthest from its own."""
    centres = x[r.choice(len(x), k, replace=False)].copy() if k < len(x) else np.concatenate([x, np.zeros((k - len(x), x.shape[1]))])
    if k >= len(x):
        return centres
    norms = (x * x).sum(1)
    for _ in range(rounds):
        apart = norms[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
        own = apart.argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        far = np.argsort(-apart[np.arange(len(x)), own], kind="stable")[: (count == 0).sum()]
        centres[count == 0] = x[far]
    return centres


class Model:
    """Centroids of lists and, for each run of `width` components, codewords of residuals; both for vectors of length 1, padded with zeros."""

    def __init__(self, centroids: np.ndarray, words: np.ndarray, dims: int) -> None:
        self.centroids, self.words, self.dims = centroids, words, dims

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, codewords: int = CODEWORDS, width: int = WIDTH, seed: int = 7) -> Model:
        r, dims = np.random.default_rng(seed), x.shape[1]
        x = cls._unit(x, -(-dims // width) * width)
        centroids = _means(x, min(lists, max(1, len(x))), 12, r)
        rest = x - centroids[cls._nearest(x, centroids)]
        words = np.stack([_means(rest[:, at : at + width], codewords, 12, r) for at in range(0, x.shape[1], width)])
        return cls(centroids, words, dims)

    @staticmethod
    def _unit(x: np.ndarray, size: int) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))
        return np.pad(x / np.where(norm == 0, 1, norm)[:, None], ((0, 0), (0, size - x.shape[1])))

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)

    def unit(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x, self.centroids.shape[1])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and distance from the list's centroid of each row of unit(x)."""
        own = self._nearest(x, self.centroids)
        rest, width = x - self.centroids[own], self.words.shape[2]
        codes = np.stack([self._nearest(rest[:, i * width : (i + 1) * width], w) for i, w in enumerate(self.words)], 1).astype(np.uint8)
        return own, codes, np.sqrt((rest * rest).sum(1))

    def probes_for(self, x: np.ndarray) -> int:
        """The number of nearest lists that hold GOAL of the nearest neighbours of some rows of x among all of x."""
        x = self.unit(x)
        some = x[:: max(1, len(x) // TRIALS)]
        near = np.argsort(-(some @ x.T), axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        place = np.argsort(np.argsort(-(some @ self.centroids.T), axis=1, kind="stable"), axis=1)
        return 1 + int(np.quantile(np.take_along_axis(place, self._nearest(x, self.centroids)[near], axis=1), GOAL)) if near.size else 1

    def estimates(self, queries: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of unit queries and the items of one list, from their codes."""
        width = self.words.shape[2]
        out = np.repeat((queries @ self.centroids[of_list])[:, None], len(codes), 1)
        for i, w in enumerate(self.words):
            out += (queries[:, i * width : (i + 1) * width] @ w.T)[:, codes[:, i]]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _filed(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            batch = whole.slice(lo, 4096)
            own, codes, away = model.code(model.unit(_matrix(batch.column("vector"))))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("vector"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(away)], ["item_id", "vector", "list", "code", "away"])


def _probed(model: Model, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of each query's nearest centroids."""
    for batch in batches:
        if batch.num_rows:
            near = model.unit(_matrix(batch.column("query_vector"))) @ model.centroids.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(near)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("number").take(at), pa.array(best.ravel().astype(np.int32))], ["number", "list"])


def _bounded(model: Model, radius: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists that may hold an item whose score reaches a query's least: the cosine is at most q.c + |q| * radius of the list."""
    for batch in batches:
        if batch.num_rows:
            near = model.unit(_matrix(batch.column("query_vector"))) @ model.centroids.T + radius
            at, own = np.nonzero((near + SLACK >= np.asarray(batch.column("least"))[:, None]) & (radius >= 0))
            yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(at)), pa.array(own.astype(np.int32))], ["number", "list"])


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k best scores of each row; ties go to the column that comes first."""
    k = min(k, score.shape[1])
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(score)), k), order.ravel()


def _shortlisted(model: Model, most: int, items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The `most` items of a part with the best estimates, for each query of a block."""
    if not len(items) or not len(queries):
        return frame([], ("number", "item_id", "list", "score"))
    items = items.sort_values("item_id", kind="stable")
    codes = np.frombuffer(b"".join(items["code"]), np.uint8).reshape(len(items), -1)
    of_list, out = int(items["list"].iloc[0]), []
    step = max(1, (1 << 22) // len(items))
    for lo in range(0, len(queries), step):
        part = queries.iloc[lo : lo + step]
        score = model.estimates(model.unit(np.stack(part["query_vector"].to_list()).astype(float)), of_list, codes)
        row, column = _best(score, most)
        out.append((part["number"].to_numpy()[row], items["item_id"].to_numpy()[column], np.full(len(row), of_list), score[row, column]))
    return frame(out, ("number", "item_id", "list", "score"))


def _exact(k: int, items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The k best items of a part by cosine (six digits, then smaller item) for each query of a block."""
    if not len(items) or not len(queries):
        return frame([], ("number", "item_id", "score"))
    items, out = items.sort_values("item_id", kind="stable"), []
    x = np.stack(items["vector"].to_list()).astype(float)
    size = np.sqrt((x * x).sum(1))
    step = max(1, (1 << 22) // len(items))
    for lo in range(0, len(queries), step):
        part = queries.iloc[lo : lo + step]
        q = np.stack(part["query_vector"].to_list()).astype(float)
        scale = np.sqrt((q * q).sum(1))[:, None] * size
        score = np.round((q @ x.T) / np.where(scale == 0, 1, scale), 6)
        row, column = _best(score, k)
        out.append((part["number"].to_numpy()[row], items["item_id"].to_numpy()[column], score[row, column]))
    return frame(out, ("number", "item_id", "score"))


class VectorIndex:
    """Tables under a path: model (one row), lists (list, n, parts, radius) and items (item_id, vector, list, part, code), a folder for each list.

    Vectors have one length and no nulls within; rows with a null vector are not indexed. A vector of zeros scores 0 with all.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        row = spark.read.parquet(f"{path}/model").first()
        centroids = np.frombuffer(row["centroids"]).reshape(row["lists"], -1)
        self.model = Model(centroids, np.frombuffer(row["words"]).reshape(centroids.shape[1] // row["width"], -1, row["width"]), row["dims"])
        self.probes = row["probes"]
        self.lists, self.items = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/items")

    @classmethod
    def build(cls, items: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index of items (item_id, vector). lists: by default the root of the number of items, LISTS at most. The model is fitted on the `sample` rows
        of least hash, which the driver holds; all else grows with the items on the cluster only."""
        spark = items.sparkSession
        rows = items.where("vector IS NOT NULL").select("item_id", F.col("vector").cast("array<float>").alias("vector"))
        count = rows.count()
        first = rows.orderBy(F.xxhash64("item_id"), "item_id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
        lists = lists or min(LISTS, max(1, round(math.sqrt(count))))
        known = _matrix(first) if count else np.zeros((1, WIDTH))
        model = Model.fit(known, lists)
        row = (len(model.centroids), model.dims, model.words.shape[2], model.probes_for(known), bytearray(np.ascontiguousarray(model.centroids).tobytes()), bytearray(np.ascontiguousarray(model.words).tobytes()))
        spark.createDataFrame([row], MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        kind = dict(rows.dtypes)["item_id"]
        filed = Scratch(spark, "filed").save(rows.mapInArrow(partial(_filed, model), f"item_id {kind}, vector array<float>, list int, code binary, away double"), "items")
        sizes = filed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART_ITEMS).cast("int"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        # One row a list, LISTS at most.
        dealt = filed.drop("away").join(F.broadcast(spark.read.parquet(f"{path}/lists").select("list", "parts")), "list")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("item_id"), "parts").cast("int")).drop("parts").repartition("list", "part")
        dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/items")
        return cls(spark, path) if count else cls._empty(spark, path, dealt)

    @classmethod
    def _empty(cls, spark: SparkSession, path: str, dealt: DataFrame) -> VectorIndex:
        index = cls.__new__(cls)
        index.probes, index.spark, index.model, index.lists, index.items = 1, spark, Model(np.zeros((1, WIDTH)), np.zeros((1, 1, WIDTH)), WIDTH), spark.createDataFrame([], "list int, n long, radius double, parts int"), dealt
        return index

    def _cells(self, pairs: DataFrame, numbered: DataFrame, column: str, make, schema: str) -> DataFrame:  # noqa: ANN001
        """make(items, queries) for each part of the lists in pairs (number, list) and each block of queries."""
        blocks = max(1, -(-numbered.count() // BLOCK_QUERIES))
        asked = pairs.join(self.lists.select("list", "parts"), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(numbered.select("number", "query_vector"), "number")
        asked = asked.select("number", "query_vector", "list", "part", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block"))
        read = self.items.join(pairs.select("list").distinct(), "list", "left_semi").select("item_id", "list", "part", column, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        on = ["list", "part", "block"]
        return read.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(make, schema)

    def _numbered(self, queries: DataFrame, scratch: Scratch) -> DataFrame:
        rows = queries.where("query_vector IS NOT NULL").select("query_id", F.col("query_vector").cast("array<float>").alias("query_vector"))
        return scratch.save(rows.withColumn("number", F.monotonically_increasing_id()), "queries")

    def _told(self, hits: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "item_id"))
        best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(numbered.select("query_id", "number"), "number").select("query_id", "item_id", "score", "rank")

    def _candidates(self, numbered: DataFrame, scratch: Scratch, shortlist: int, probes: int) -> DataFrame:
        """number, item_id, score of the shortlist of each query, scored exactly."""
        kind = dict(self.items.dtypes)["item_id"]
        pairs = scratch.save(numbered.select("number", "query_vector").mapInArrow(partial(_probed, self.model, probes), "number long, list int"), "probed")
        found = self._cells(pairs, numbered, "code", partial(_shortlisted, self.model, shortlist), f"number long, item_id {kind}, list int, score double")
        place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "item_id"))
        short = scratch.save(found.withColumn("place", place).where(F.col("place") <= shortlist).select("number", "item_id", "list"), "short")
        pairs = short.join(self.items.select("item_id", "list", "vector"), ["list", "item_id"]).join(numbered.select("number", "query_vector"), "number")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        scale = F.sqrt(dot("vector", "vector")) * F.sqrt(dot("query_vector", "query_vector"))
        return pairs.select("number", "item_id", F.round(dot("vector", "query_vector") / F.when(scale == 0, 1.0).otherwise(scale), 6).alias("score"))

    def search(self, queries: DataFrame, k: int, shortlist: int | None = None, probes: int | None = None) -> DataFrame:
        """query_id, item_id, score, rank: the k best of each query's shortlist (20 * k by default) from its `probes` nearest lists.

        By default as many lists as held GOAL of the neighbours in the sample. Scores are exact; items outside the shortlist are missed. Use exact() where none may be.
        """
        scratch = Scratch(self.spark, "vectors")
        numbered = self._numbered(queries, scratch)
        return self._told(self._candidates(numbered, scratch, shortlist or 20 * k, probes or self.probes), numbered, k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, item_id, score, rank: the k best items, as a scan of all would find them.

        A first search gives each query a score that k items reach; then every list is visited whose centroid and radius leave room for a better one.
        """
        scratch = Scratch(self.spark, "vectors")
        numbered = self._numbered(queries, scratch)
        first = self._candidates(numbered, scratch, 4 * k, max(2, len(self.model.centroids) // 16))
        place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score")))
        least = first.withColumn("place", place).where(F.col("place") == k).select("number", F.col("score").alias("least"))
        asked = numbered.join(least, "number", "left").select("number", "query_vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        radius = np.full(len(self.model.centroids), -1.0)
        for r in self.lists.collect():  # one row a list, LISTS at most
            radius[r["list"]] = r["radius"]
        pairs = scratch.save(asked.mapInArrow(partial(_bounded, self.model, radius), "number long, list int"), "bounded")
        hits = self._cells(pairs, numbered, "vector", partial(_exact, k), f"number long, item_id {dict(self.items.dtypes)['item_id']}, score double")
        return self._told(hits, numbered, k)
