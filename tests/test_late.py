"""Late interaction against a plain version, with short lists, unknown words and long texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from corpusgraph.operators import inverted_index, late, search


def _plain(query, text, texts):
    words, held = list(dict.fromkeys(query.lower().split())), set((text or "").lower().split())
    score = total = 0.0
    for w in words:
        df = sum(w in (t or "").lower().split() for t in texts)
        idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        total += idf
        score += idf * max((len(late.trigrams(w) & late.trigrams(v)) / math.sqrt(len(late.trigrams(w)) * len(late.trigrams(v))) for v in held), default=0.0)
    return round(score / total, 6)


def test_scores(spark):
    texts = ["red foxes run", "the fox is red", "blue hens", None, "", "a an x", "éclair éclairs " + " ".join(f"word{i}" for i in range(6000))]
    asked = {1: "Red fox", 2: "éclairs word5999 fox", 3: "zzz x", 4: ""}
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    hits = queries.select("query_id").join(items.select("item_id"))
    got = {(r["query_id"], r["item_id"]): r["score"] for r in late.scores(hits, queries, items).collect()}
    want = {(q, i): _plain(text, t, texts) for q, text in asked.items() if text for i, t in enumerate(texts)}
    assert set(got) == set(want) and all(math.isclose(got[x], want[x], abs_tol=2e-6) for x in want)
    assert got[1, 1] == 1.0 and 0.3 < got[1, 0] < 1.0 and got[1, 4] == 0.0


def test_short_lists_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "hen")], "item_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "hen")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 3, 0.9, 1), (1, 2, 0.5, 2), (1, 1, 0.4, 3), (2, 1, 0.9, 1)], "query_id long, item_id long, score double, rank int")
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in late.reranked(hits, queries, items, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    assert late.reranked(hits.limit(0), queries, items, 2).count() == 0
    whole = late.best_matches(["abc", "xyz"], [f"ab{i}" for i in range(50)])
    monkeypatch.setattr(late, "BLOCK", 7)
    assert np.array_equal(whole, late.best_matches(["abc", "xyz"], [f"ab{i}" for i in range(50)]))


def test_counts_from_an_index(spark):
    """The words' counts come from the index of the search, as from the texts; what isn't a hit isn't read again."""
    texts = ["red foxes run", "the fox is red", "blue hens", None, "", "a red hen"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    queries = spark.createDataFrame([(1, "Red fox"), (2, "hens zzz"), (3, "")], "query_id long, query string")
    hits = queries.select("query_id").join(items.select("item_id"))
    index = search.index_for(queries, items)
    told = lambda found: sorted(map(tuple, found.collect()))
    assert told(late.rarity(queries, items, index)) == told(late.rarity(queries, items))
    assert told(late.scores(hits, queries, items.where("item_id < 4"), index)) == [x for x in told(late.scores(hits, queries, items)) if x[1] < 4]


def test_small_batches(spark):
    """Python gets few texts at once while an index is built; the session's setting is as before then, after a failure too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most = spark.conf.get(name), inverted_index.BATCH_TEXTS
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches)
    with pytest.raises(RuntimeError), inverted_index._small_batches(spark):
        seen = {r["n"] for r in spark.range(3 * most, numPartitions=1).mapInArrow(sizes, "n long").collect()}
        raise RuntimeError
    assert seen == {most} and spark.conf.get(name) == before
    items = spark.range(5000).selectExpr("id AS item_id", "concat('red fox', id) AS text").coalesce(1)
    found = search.bm25(spark.createDataFrame([(1, "fox77 red")], "query_id long, query string"), items, 2).collect()
    assert [(r["item_id"], r["rank"]) for r in found] == [(77, 1), (0, 2)] and spark.conf.get(name) == before
