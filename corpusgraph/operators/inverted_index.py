"""A stored inverted index for BM25: postings by shard and term with block maxima, and searches that skip shards by upper bounds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.plans.scratch import Scratch

#: A shard holds at most so many texts, and is closed once it has so many words.
SHARD_TEXTS, SHARD_WORDS = 4096, 1 << 22
#: Texts whose words are handed to Python at once.
BATCH_TEXTS = 512
#: Queries that a task scores at once.
BLOCK_QUERIES = 8192
#: Up to so many terms of queries are sent to the tasks, for an index of these alone or to pick their postings.
SENT_TERMS = 1 << 17
#: Scores are rounded to six digits, so bounds that are smaller by less than this are kept.
SLACK = 1e-5


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, tasks hand BATCH_TEXTS rows at once to Python, so that a worker doesn't hold the words of ten thousand texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Shards:
    """Gathers texts of one part and gives shards: a row for each term, sorted, and one without a term that tells texts and words. With terms, sorted, other words only count for lengths."""

    def __init__(self, names: list[str], most: int, terms: pa.Array | None) -> None:
        from pyspark import TaskContext

        self.names, self.most, self.terms, self.next, self.held = names, most, terms, TaskContext.get().partitionId() << 33, {}

    def add(self, part: object, ids: pa.Array, words: pa.ListArray) -> Iterator[pa.RecordBatch]:
        mine = self.held.setdefault(part, [[], [], [], [], 0])
        size = np.diff(np.asarray(words.offsets))
        flat, row = words.flatten(), np.repeat(np.arange(len(size), dtype=np.int32), size)
        if self.terms is not None:
            flat = pc.index_in(flat, self.terms)
            known = np.asarray(flat.is_valid())
            flat, row = flat.drop_null(), row[known]
        row += np.int32(sum(map(len, mine[0])))
        for have, new in zip(mine, (ids, flat, size, row), strict=False):
            have.append(new)
        mine[4] += int(size.sum())
        if sum(map(len, mine[0])) >= self.most or mine[4] >= SHARD_WORDS:
            yield self.flush(part)

    def flush(self, part: object) -> pa.RecordBatch:
        ids, flat, sizes, row, total = self.held.pop(part)
        ids, length, flat, row = pa.concat_arrays(ids), np.concatenate(sizes), pa.concat_arrays(flat), np.concatenate(row)
        if self.terms is None:
            coded = flat.dictionary_encode()
            order = np.asarray(pc.sort_indices(coded.dictionary))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            place, sorted_terms = place[np.asarray(coded.indices)], coded.dictionary.take(pa.array(order))
        else:
            place, sorted_terms = np.asarray(flat).astype(np.int64), self.terms
        pairs, tf = np.unique(place * len(length) + row, return_counts=True)
        term, row = pairs // max(1, len(length)), pairs % max(1, len(length))
        found, begin = np.unique(term, return_index=True)
        begin = np.r_[begin, len(term)]
        dl = length[row]
        most, least = (f.reduceat(x, begin[:-1]) if len(found) else np.empty(0, int) for f, x in ((np.maximum, tf), (np.minimum, dl)))
        ends = pa.array(np.r_[begin, begin[-1]], pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(ends, x)
        none = lambda x, kind, last: pa.array([*x.tolist(), last], kind)
        self.next += 1
        n = len(found) + 1
        return pa.RecordBatch.from_arrays([
            pa.array([part] * n) if part is not None else pa.nulls(n, pa.string()), pa.array([self.next] * n, pa.int64()), pa.concat_arrays([sorted_terms.take(pa.array(found)), pa.nulls(1, sorted_terms.type)]),
            none(np.diff(begin), pa.int32(), len(length)), none(most, pa.int32(), None), none(least, pa.int32(), None), pa.array([None] * (n - 1) + [total], pa.int64()),
            lists(ids.take(pa.array(row))), lists(pa.array(tf, pa.int32())), lists(pa.array(dl, pa.int32())),
        ], self.names)


def _build(names: list[str], most: int, terms: list[str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards = None
    for whole in batches:
        if shards is None:
            kind = whole.schema.field("words").type.value_type
            shards = _Shards(names, most, None if terms is None else pa.array(terms, kind))
        for lo in range(0, whole.num_rows, min(BATCH_TEXTS, most)):
            every = whole.slice(lo, min(BATCH_TEXTS, most))
            for part in every.column("part").unique().to_pylist():
                batch = every.filter(pc.equal(every.column("part"), part) if part is not None else pc.is_null(every.column("part")))
                yield from shards.add(part, batch.column("item_id"), batch.column("words"))
    for part in list(shards.held) if shards else []:
        yield shards.flush(part)


def frame(blocks: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pd.DataFrame:
    """Blocks of columns as one table; without blocks an empty one whose columns go for any type."""
    return pd.DataFrame({n: np.concatenate([b[i] for b in blocks]) if blocks else np.empty(0, object) for i, n in enumerate(names)})


def _scored(k: int, k1: float, b: float, postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The k best items of one shard for each query of a block; ties go to the smaller item."""
    if not len(postings) or not len(asked):
        return frame([], ("number", "part", "item_id", "score"))
    items = np.concatenate(postings["items"].tolist())
    names, codes = np.unique(items, return_inverse=True)
    tf, dl = (np.concatenate(postings[c].tolist()).astype(float) for c in ("tf", "dl"))
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / asked["avgdl"].iloc[0]))
    ends = np.r_[0, np.cumsum(postings["n"])]
    places = {t: (ends[i], ends[i + 1]) for i, t in enumerate(postings["term"])}
    out = []
    for number, mine in asked.groupby("number"):
        spans = [(*places[t], idf) for t, idf in sorted(zip(mine["term"], mine["idf"], strict=True))]
        at = np.concatenate([codes[lo:hi] for lo, hi, _ in spans])
        score = np.bincount(at, np.concatenate([idf * weight[lo:hi] for lo, hi, idf in spans]), len(names))
        found = np.unique(at)
        score = np.floor(score[found] * 1e6 + 0.5) / 1e6
        best = np.lexsort((found, -score))[:k]
        out.append((np.full(len(best), number), np.full(len(best), mine["part"].iloc[0], object), names[found[best]], score[best]))
    return frame(out, ("number", "part", "item_id", "score"))


class InvertedIndex:
    """Postings under a path: part, shard, term, n (texts), most (greatest count), least (shortest length), items, tf, dl; terms sorted within a shard.

    A shard holds up to SHARD_TEXTS texts of one task and one part, so that building shuffles nothing, no list
    grows beyond a shard however common its term, and shards are searched independently. A row without a term tells
    a shard's number of texts and words.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.table = spark.read.parquet(path)

    @classmethod
    def build(cls, items: DataFrame, path: str, part: str | None = None, shard_texts: int = SHARD_TEXTS, terms: list[str] | None = None) -> InvertedIndex:
        """Index of items (item_id, text); with part, a column of items, each part is a corpus by itself. Null texts have no words. Words are cut in the JVM, counted in Arrow batches.

        With terms, only their postings are kept, for queries that hold no others; lengths and numbers of texts are those of all words.
        """
        rows = items.select("item_id", (F.col(part) if part else F.lit("")).cast("string").alias("part"), tokens(F.col("text")).alias("words"))
        kind = dict(rows.dtypes)["item_id"]
        schema = f"part string, shard long, term string, n int, most int, least int, words long, items array<{kind}>, tf array<int>, dl array<int>"
        names = [x.split()[0] for x in schema.split(", ")]
        built = rows.mapInArrow(partial(_build, names, shard_texts, None if terms is None else sorted(set(terms))), schema)
        with _small_batches(items.sparkSession):
            built.write.mode("overwrite").parquet(path)
        index = cls.__new__(cls)
        index.spark, index.path, index.table = items.sparkSession, path, items.sparkSession.read.schema(schema).parquet(path)
        return index

    def _asked(self, queries: DataFrame, scratch: Scratch, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
        """Numbered queries, and for each query, shard and term there: idf, the parts' mean length, and an upper bound of the term's weight."""
        numbered = scratch.save(queries.select("query_id", "query").withColumn("number", F.monotonically_increasing_id()), "queries")
        terms = numbered.select("number", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        totals = self.table.where("term IS NULL").groupBy("part").agg(F.sum("n").alias("texts"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        lists = self.table.where("term IS NOT NULL").select("part", "shard", "term", "n", "most", "least").join(terms.select("term").distinct(), "term", "left_semi")
        df = lists.groupBy("part", "term").agg(F.sum("n").alias("df"))
        idf = F.ln(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = df.join(totals, "part").select("part", "term", idf.alias("idf"), "avgdl")
        bound = F.col("idf") * F.col("most") * (k1 + 1) / (F.col("most") + k1 * (1 - b + b * F.col("least") / F.col("avgdl")))
        met = lists.join(known, ["part", "term"]).select("part", "shard", "term", "idf", "avgdl", bound.alias("bound"))
        return numbered, scratch.save(terms.join(met, "term"), "asked")

    def _hits(self, asked: DataFrame, numbered: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        blocks = max(1, -(-numbered.count() // BLOCK_QUERIES))
        block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
        # Shards are few and go to the tasks; so do terms, if not too many, so that other postings aren't shuffled.
        terms = asked.select("term").distinct()
        terms = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
        lists = self.table.where("term IS NOT NULL").join(F.broadcast(asked.select("shard").distinct()), "shard", "left_semi").join(terms, "term", "left_semi").select("shard", "term", "n", "items", "tf", "dl", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        kind = dict(lists.dtypes)["items"][len("array<") : -1]
        cells = lists.groupBy("shard", "block").cogroup(asked.select("number", "part", "shard", "term", "idf", "avgdl", block.alias("block")).groupBy("shard", "block"))
        return cells.applyInPandas(partial(_scored, k, k1, b), f"number long, part string, item_id {kind}, score double")

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, skipped: bool = False) -> DataFrame:
        """query_id, part, item_id, score, rank: the k best items of each part for queries (query_id, query), by score, then item.

        First each query looks at the shard of its greatest bound (the sum of its terms' bounds there); then at all others
        whose bound reaches the k-th score of that one. No other shard can hold any of the k best. Queries without a word, or whose words no text
        holds, have no hits. With skipped, the result is (query_id, part, shard, visited) instead.
        """
        scratch = Scratch(self.spark, "search")
        numbered, asked = self._asked(queries, scratch, k1, b)
        sums = asked.groupBy("number", "part", "shard").agg(F.sum("bound").alias("upper"))
        place = F.row_number().over(W.partitionBy("number", "part").orderBy(F.desc("upper"), "shard"))
        sums = sums.withColumn("place", place)
        on = ["number", "part", "shard"]
        first = scratch.save(self._hits(asked.join(sums.where("place = 1").select(*on), on, "left_semi"), numbered, k, k1, b), "first")
        least = first.groupBy("number", "part").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least"))
        rest = sums.where("place > 1").join(least, ["number", "part"], "left").withColumn("reached", F.col("upper") + SLACK >= F.coalesce("least", F.lit(0.0)))
        if skipped:
            told = rest.select(*on, F.col("reached").alias("visited")).unionAll(sums.where("place = 1").select(*on, F.lit(True)))
            return numbered.select("query_id", "number").join(told, "number").drop("number")
        more = self._hits(asked.join(rest.where("reached").select(*on), on, "left_semi"), numbered, k, k1, b)
        rank = F.row_number().over(W.partitionBy("number", "part").orderBy(F.desc("score"), "item_id"))
        best = first.unionAll(more).withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(numbered.select("query_id", "number"), "number").select("query_id", "part", "item_id", "score", "rank")
