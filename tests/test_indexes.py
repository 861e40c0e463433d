"""Stored indexes: searches against brute force, skipped shards and lists, parts, ties and empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import inverted_index, vector_index
from corpusgraph.operators.inverted_index import InvertedIndex
from corpusgraph.operators.vector_index import VectorIndex
from corpusgraph.plans.session import table
from tests.conftest import DATA


def _bm25(queries, items, k):
    words = {i: [w for w in (t or "").lower().split() if w] for i, t in items}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    out = []
    for q, text in queries:
        scores = {}
        for i, x in words.items():
            tf = Counter(x)
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in set((text or "").lower().split()) if tf[w])
            if any(tf[w] for w in set((text or "").lower().split())):
                scores[i] = round(s, 6)
        best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        out += [(q, i, scores[i], n + 1) for n, i in enumerate(best)]
    return sorted(out)


def _texts():
    r = random.Random(1)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(300)]
    items += [(300 + i, "Rare words stand here") for i in range(7)] + [(400, None), (401, "")]
    queries = [(i, " ".join(r.choice(words) for _ in range(4))) for i in range(30)] + [(50, "rare w1"), (51, ""), (52, None), (53, "nowhere found"), (54, "w1 W1 w1")]
    return items, queries


@pytest.mark.parametrize(("shard", "block"), [(4096, 8192), (8, 4)])
def test_inverted_index(spark, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(inverted_index, "BLOCK_QUERIES", block)
    items, queries = _texts()
    at = str(tmp_path / "texts")
    spark.createDataFrame(items, "item_id long, text string").repartition(3).write.parquet(at)
    index = InvertedIndex.build(spark.read.parquet(at), str(tmp_path / "index"), shard_texts=shard)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got = index.search(asked, 5)
    assert sorted((x["query_id"], x["item_id"], x["score"], x["rank"]) for x in got.collect()) == _bm25(queries, items, 5)
    # A second search, from the stored table alone, with the texts gone.
    (tmp_path / "texts").rename(tmp_path / "gone")
    again = InvertedIndex(spark, str(tmp_path / "index")).search(asked, 3)
    assert sorted((x["query_id"], x["item_id"], x["score"], x["rank"]) for x in again.collect()) == _bm25(queries, items, 3)
    if shard == 8:
        seen = Counter(x["visited"] for x in index.search(asked, 1, skipped=True).collect())
        assert seen[False] > seen[True]


def test_inverted_index_parts(spark, tmp_path):
    items, queries = _texts()
    parts = [(i, t, "ab"[i % 2] if i % 5 else None) for i, t in items]
    index = InvertedIndex.build(spark.createDataFrame(parts, "item_id long, text string, kind string"), str(tmp_path / "i"), "kind", shard_texts=16)
    got = index.search(spark.createDataFrame(queries, "query_id long, query string"), 4).collect()
    for kind in ("a", "b"):
        mine = [(i, t) for i, t, p in parts if p == kind]
        assert sorted((x["query_id"], x["item_id"], x["score"], x["rank"]) for x in got if x["part"] == kind) == _bm25(queries, mine, 4)


def test_inverted_index_empty(spark, tmp_path):
    none = spark.createDataFrame([], "item_id string, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert InvertedIndex.build(none, str(tmp_path / "i")).search(asked, 3).count() == 0
    some = spark.createDataFrame([("x", "a b"), ("é", "a")], "item_id string, text string")
    assert [x["item_id"] for x in InvertedIndex.build(some, str(tmp_path / "j")).search(asked, 3).orderBy("rank").collect()] == ["é", "x"]
    assert InvertedIndex.build(some, str(tmp_path / "k")).search(asked.limit(0), 3).count() == 0


def _nearest(queries, items, k):
    out = []
    for q, v in queries:
        s = []
        for i, x in items:
            scale = math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(a * a for a in x))
            s.append((-round(float(np.dot(np.float32(v).astype(float), np.float32(x).astype(float))) / scale if scale else 0.0, 6) + 0.0, i))
        out += [(q, i, -n + 0.0, r + 1) for r, (n, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


def _told(rows):
    return sorted((x["query_id"], x["item_id"], x["score"] + 0.0, x["rank"]) for x in rows.collect())


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ITEMS", 16)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 8)
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 10))
    # One cluster holds a third, and some vectors are the same, all zeros, or null.
    rows = [(i, (centres[0 if i % 3 == 0 else i % 12] + 0.3 * r.normal(size=10)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, [1.0] * 10) for i in range(40)] + [(700, [0.0] * 10)]
    items = spark.createDataFrame([*rows, (701, None)], "item_id long, vector array<float>")
    queries = [(i, v) for i, v in rows if i % 50 == 0] + [(900, [0.0] * 10), (901, [-1.0] * 10)]
    asked = spark.createDataFrame([*queries, (902, None)], "query_id long, query_vector array<float>")
    index = VectorIndex.build(items, str(tmp_path / "v"))
    assert index.lists.agg(F.sum("n")).first()[0] == index.items.count() == len(rows)
    assert index.lists.agg(F.max("parts")).first()[0] > 1
    want = _nearest(queries, rows, 5)
    assert _told(index.exact(asked, 5)) == want
    again = VectorIndex(spark, str(tmp_path / "v"))
    assert _told(again.exact(asked, 5)) == want
    assert _told(again.search(asked, 5, shortlist=10_000, probes=10_000)) == want
    got = {x[:3] for x in _told(again.search(asked, 5))}
    scores = {(q, round(s, 6)) for q, _, s, _ in want}
    assert sum((q, round(s, 6)) in scores for q, _, s in got) >= 0.9 * len(want)
    assert len(again.exact(asked, 10_000).collect()) == len(queries) * len(rows)


def test_vector_index_recall(spark, tmp_path):
    """At least nine in ten of the exact neighbours of the whole query set, on vectors without clusters."""
    e = table(spark, DATA, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.build(items, str(tmp_path / "v"))
    exact = {x[:2] for x in _told(index.exact(asked, 10))}
    found = {x[:2] for x in _told(index.search(asked, 10))}
    assert len(found & exact) >= 0.9 * len(exact)
    assert index.probes < len(index.model.centroids)


def test_vector_index_empty(spark, tmp_path):
    none = spark.createDataFrame([], "item_id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vector array<float>")
    assert VectorIndex.build(none, str(tmp_path / "v")).exact(asked, 3).count() == 0
    one = VectorIndex.build(spark.createDataFrame([(5, [2.0, 4.0])], "item_id long, vector array<float>"), str(tmp_path / "w"))
    assert _told(one.search(asked, 3)) == [(1, 5, 1.0, 1)]
    assert one.exact(asked.limit(0), 3).count() == 0
