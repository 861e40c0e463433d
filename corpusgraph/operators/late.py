"""Late interaction: each query word is matched with the most similar word of a text, and the matches count by how rare the words are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators import search
from corpusgraph.operators.inverted_index import InvertedIndex
from corpusgraph.plans.scratch import Scratch

#: Words of a text that are matched at once.
BLOCK = 4096


def trigrams(word: str) -> set[str]:
    """The distinct runs of three signs of a word between '^' and '$'."""
    framed = f"^{word}$"
    return {framed[i : i + 3] for i in range(max(1, len(framed) - 2))}


def best_matches(query: list[str], text: list[str]) -> np.ndarray:
    """For each query word the greatest cosine of its trigrams with those of a word of the text, by products of presence matrices over the query's trigrams."""
    if not query or not text:
        return np.zeros(len(query))
    sets = [trigrams(w) for w in query]
    place = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    mine = np.zeros((len(query), len(place)))
    for i, s in enumerate(sets):
        mine[i, [place[t] for t in s]] = 1 / np.sqrt(len(s))
    best = np.zeros(len(query))
    for lo in range(0, len(text), BLOCK):
        rows = [trigrams(w) for w in text[lo : lo + BLOCK]]
        theirs = np.zeros((len(rows), len(place)))
        for i, s in enumerate(rows):
            theirs[i, [place[t] for t in s if t in place]] = 1 / np.sqrt(len(s))
        best = np.maximum(best, (mine @ theirs.T).max(1))
    return best


def rarity(queries: DataFrame, items: DataFrame, index: InvertedIndex | None = None) -> DataFrame:
    """query_id, words, idf: the distinct words of each query in order, and ln(1 + (items - df + 0.5) / (df + 0.5)) of each over all items.

    An index of the items, in one part and with the queries' terms, tells counts without the items being read.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("query")))).alias("word"))
    if index:
        df = index.table.where("term IS NOT NULL").groupBy(F.col("term").alias("word")).agg(F.sum("n").alias("df"))
        total = index.table.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    else:
        held = items.select(F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
        df = held.groupBy("word").agg(F.count("*").alias("df"))
        total = items.agg(F.count("*").alias("items"))
    n = F.coalesce("df", F.lit(0))
    known = words.join(df, "word", "left").join(total).select("query_id", "word", F.ln(1 + (F.col("items") - n + 0.5) / (n + 0.5)).alias("idf"))  # one row
    told = F.array_sort(F.collect_list(F.struct("word", "idf")))
    return known.groupBy("query_id").agg(told.alias("told")).select("query_id", F.transform("told", lambda x: x["word"]).alias("words"), F.transform("told", lambda x: x["idf"]).alias("idf"))


def scores(hits: DataFrame, queries: DataFrame, items: DataFrame, index: InvertedIndex | None = None) -> DataFrame:
    """query_id, item_id, score of hits (query_id, item_id): the words' best matches in the text, weighed by idf, from 0 to 1. Queries without a word have no scores."""
    kinds = {c: dict(hits.dtypes)[c] for c in ("query_id", "item_id")}
    # Only texts of hits are cut into words; other ones go before.
    met = items.select("item_id", "text").join(hits.select("item_id").distinct(), "item_id", "left_semi")
    pairs = hits.select("query_id", "item_id").join(rarity(queries, items, index), "query_id").join(met.select("item_id", F.array_distinct(search.tokens(F.col("text"))).alias("held")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for words, idf, held in zip(*(part.column(c).to_pylist() for c in ("words", "idf", "held")), strict=True):
                    out.append(float(best_matches(words, held) @ np.array(idf) / sum(idf)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("item_id"), pa.array(out, pa.float64())], ["query_id", "item_id", "score"])

    found = pairs.select("query_id", "item_id", "words", "idf", "held").mapInArrow(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"))


def reranked(hits: DataFrame, queries: DataFrame, items: DataFrame, k: int, index: InvertedIndex | None = None) -> DataFrame:
    """query_id, item_id, score, rank: the k best of hits (query_id, item_id, score, rank) by late interaction; a query that has no more than k keeps them as they are."""
    # Hits are read several times; what finds them runs once.
    hits = Scratch(queries.sparkSession, "late").save(hits.select("query_id", "item_id", "score", "rank"), "hits")
    sized = hits.select("query_id", "item_id", "score", "rank", F.count("*").over(W.partitionBy("query_id")).alias("size"))
    best = search.top_k(scores(sized.where(F.col("size") > k), queries, items, index), k)
    return sized.where(F.col("size") <= k).drop("size").unionByName(best)
