"""Exact vector search, BM25, fusion and reranking over many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators.chunking import cosine
from corpusgraph.operators.inverted_index import SENT_TERMS, InvertedIndex, tokens
from corpusgraph.plans.scratch import Scratch


def top_k(hits: DataFrame, k: int, query: str | Sequence[str] = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """hits with rank up to k; ties go to the smaller item. Spark limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*([query] if isinstance(query, str) else query)).orderBy(F.desc(score), F.col(item)))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


#: Bytes of query vectors that are sent to the tasks at once; more go in several passes over the items.
SENT_BYTES = 64 << 20
#: Scores that a task holds at once, and best scores that it keeps of a part.
HELD_SCORES = 1 << 22


def _blocks(rows: DataFrame, per_block: int) -> Iterator[list[Row]]:
    """rows in lists of at most per_block, so that the driver never holds more."""
    block: list[Row] = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == per_block:
            yield block
            block = []
    if block:
        yield block


def vector_search(queries: DataFrame, items: DataFrame, k: int, part: str | None = None) -> DataFrame:
    """query_id, item_id, score, rank: exact cosine neighbours of (query_id, query_vector) among (item_id, vector).

    With part, a string column of items, each part is searched by itself, and it is a column of the hits. Queries are sent to the items in blocks of SENT_BYTES. A batch of items meets a block in one matrix product and
    hands on only what reaches the k best that the task has seen for a query (or ties with them), so pairs don't cross the network. Rows
    with a null vector take no part; a vector of zeros has score 0 with all.
    """
    queries = queries.where("query_vector IS NOT NULL")
    first = queries.select(F.size("query_vector").alias("n")).first()
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "item_id": dict(items.dtypes)["item_id"]}
    schema = f"at int, part string, item_id {kinds['item_id']}, score double"
    spark, found, more = queries.sparkSession, None, [part] if part else []
    if first is None:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, {f'{part} string, ' if part else ''}item_id {kinds['item_id']}, score double, rank int")

    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.sqrt((x * x).sum(1))
        return x, size

    # Null vectors are left out by the tasks: a filter here would have a vector that is computed computed twice.
    plain = items.select("item_id", (F.col(part) if part else F.lit("")).alias("part"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    for block in _blocks(queries.select("query_id", "query_vector"), max(1, SENT_BYTES // (8 * max(1, first["n"])))):
        wanted, norm = unit(np.array([r["query_vector"] for r in block], float))

        def nearest(batches: Iterator[pa.RecordBatch], wanted: np.ndarray = wanted, norm: np.ndarray = norm) -> Iterator[pa.RecordBatch]:
            step, best = max(1, min(2048, HELD_SCORES // len(wanted))), {}
            for whole in batches:
                whole = whole.filter(pc.is_valid(whole.column("vector")))
                for lo in range(0, whole.num_rows, step):
                    every = whole.slice(lo, step)
                    for name in every.column("part").unique():
                        batch = every.filter(pc.equal(every.column("part"), name))
                        rows, size = unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                        scale = norm[:, None] * size[None, :]
                        score = (wanted @ rows.T) / np.where(scale == 0, 1.0, scale)
                        top = best.get(name.as_py(), np.empty((len(score), 0)))
                        both = np.concatenate([top, score], axis=1)
                        both = np.partition(both, -k, axis=1)[:, -k:] if k < both.shape[1] else both
                        if len(wanted) * k <= HELD_SCORES:
                            best[name.as_py()] = both
                        least = both.min(axis=1) if both.shape[1] == k else np.full(len(score), -np.inf)
                        at, item = np.nonzero(score >= least[:, None] - 2e-6)
                        columns = [pa.array(at, pa.int32()), batch.column("part").take(pa.array(item)), batch.column("item_id").take(pa.array(item)), pa.array(score[at, item])]
                        yield pa.RecordBatch.from_arrays(columns, ["at", "part", "item_id", "score"])

        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], f"at int, query_id {kinds['query_id']}")
        one = plain.mapInArrow(nearest, schema).join(F.broadcast(names), "at").select("query_id", *[F.col("part").alias(c) for c in more], "item_id", F.round("score", 6).alias("score"))
        found = one if found is None else found.unionAll(one)
    return top_k(found, k, [*more, "query_id"])


def containing(passages: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, item_id: the items (item_id, text) whose text holds a passage (query_id, passage).

    Passages go to the items in blocks as one automaton, which reads each text once, however many passages
    there are. Null and empty passages are in no text.
    """
    some = passages.where("passage <> ''")
    kinds = {"q": dict(passages.dtypes)["query_id"], "i": dict(items.dtypes)["item_id"]}
    spark, found = passages.sparkSession, None
    longest = some.agg(F.max(F.octet_length("passage")).alias("n")).first()["n"]
    if longest is None:
        return spark.createDataFrame([], f"query_id {kinds['q']}, item_id {kinds['i']}")
    for block in _blocks(some.select("query_id", "passage"), max(1, SENT_BYTES // (64 * longest))):
        texts = sorted({r["passage"] for r in block})

        def hold(batches: Iterator[pa.RecordBatch], texts: list[str] = texts) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, t in enumerate(texts):
                automaton.add_word(t, i)
            automaton.make_automaton()
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    batch = whole.slice(lo, 512)
                    pairs = [(i, p) for i, t in enumerate(batch.column("text").to_pylist()) if t for p in sorted({p for _, p in automaton.iter(t)})]
                    yield pa.RecordBatch.from_arrays([pa.array([p for _, p in pairs], pa.int32()), batch.column("item_id").take(pa.array([i for i, _ in pairs], pa.int64()))], ["at", "item_id"])

        place = {t: i for i, t in enumerate(texts)}
        names = spark.createDataFrame([(place[r["passage"]], r["query_id"]) for r in block], f"at int, query_id {kinds['q']}")
        one = items.select("item_id", "text").mapInArrow(hold, f"at int, item_id {kinds['i']}").join(F.broadcast(names), "at").select("query_id", "item_id")
        found = one if found is None else found.unionAll(one)
    return found


def index_for(queries: DataFrame, items: DataFrame, part: str | None = None) -> InvertedIndex:
    """An index of items for these queries: of their terms alone unless these are very many."""
    terms = [r["term"] for r in queries.select(F.explode(tokens(F.col("query"))).alias("term")).distinct().limit(SENT_TERMS + 1).collect()]
    return InvertedIndex.build(items, Scratch(queries.sparkSession, "bm25").path("index"), part, terms=terms if len(terms) <= SENT_TERMS else None)


def bm25(queries: DataFrame, items: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, part: str | None = None) -> DataFrame:
    """query_id, item_id, score, rank for (query_id, query) among (item_id, text).

    With part, a string column of items, each part is a corpus by itself, and it is a column of the hits. Items are indexed for
    this one search, by the queries' terms alone unless these are very many; whoever searches them again keeps an InvertedIndex.
    """
    hits = index_for(queries, items, part).search(queries, k, k1, b)
    return hits.select(*([F.col("part").alias(part)] if part else []), "query_id", "item_id", "score", "rank")


def relative_fusion(dense: DataFrame, keyword: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * dense + (1 - alpha) * keyword, each scaled to 0..1 within its query (a constant list is 1); what a list lacks is 0."""

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return hits.select("query_id", "item_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(keyword, "w"), ["query_id", "item_id"], "full")
    score = F.round(F.lit(alpha) * F.coalesce("d", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("w", F.lit(0.0)), 6)
    return top_k(both.select("query_id", "item_id", score.alias("score")), k)


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """query_id, item_id, score, rank from rows (query_id, list, item_id, rank); contributions names the lists."""
    fused = lists.groupBy("query_id", "item_id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("contributions")
    )
    return top_k(fused, top)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds; the offline stand-in for a cross-encoder."""
    mine = F.array_distinct(tokens(query))
    return F.round(F.size(F.array_intersect(mine, tokens(text))) / F.greatest(F.size(mine), F.lit(1)), 6)


def parsed_hits(raw: DataFrame) -> DataFrame:
    """raw with score from its distance (1 - distance) where there is one, else its score, else 0, and defaults for what is missing."""
    score = F.coalesce(1 - F.col("distance"), "score", F.lit(0.0))
    given = set(raw.columns)
    filled = {"section": F.coalesce("section", F.lit("")) if "section" in given else F.lit("")}
    for name, default in (("tree_level", F.lit(0)), ("is_summary", F.lit(False))):
        filled[name] = F.coalesce(name, default) if name in given else default
    return raw.withColumns({"score": score} | filled).drop("distance")
