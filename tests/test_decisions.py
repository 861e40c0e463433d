"""Names, merges, reranking, pooling and ranks by deltas against plain versions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import evaluation, graph, models, strategies


def test_names_in_compatible_forms(spark):
    names = ["The Ｄｏｐａｍｉｎｅ", "ﬁne ﬂow", "Ⅳ of the Ⅻ", "café of", "①②", "  An  Ａ ", "½ a", None, "", "plain Name!", "ͅx", "ℌilbert space"]

    def plain(name):
        words = unicodedata.normalize("NFKC", (name or "").strip()).lower().split()
        while words and words[0] in graph.EDGE_WORDS:
            words.pop(0)
        while words and words[-1] in graph.EDGE_WORDS:
            words.pop()
        return " ".join("".join(c for c in " ".join(words) if re.match(r"[\w\s]", c)).split())

    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["n"] for r in rows.select(graph.normalised_name(F.col("name")).alias("n")).collect()]
    assert got[:3] == ["dopamine", "fine flow", "iv of the xii"] and got == [plain(n) for n in names]


def test_merging_again_changes_nothing(spark):
    schema = "normalized_name string, entity_type string, name string, chunk_ids array<long>, seq long"
    new = spark.createDataFrame([("a", "t", "A", [1, 2], 1), ("a", "t", "a", [2, 3], 2), ("b", "t", "B", [1], 3)], schema)
    once = graph.merge_nodes(new.limit(0), new)
    twice = graph.merge_nodes(once.withColumn("seq", F.lit(0).cast("long")), new)
    want = {("a", "t", "A", (1, 2, 3)), ("b", "t", "B", (1,))}
    for rows in (once, twice):
        assert {(r["normalized_name"], r["entity_type"], r["name"], tuple(r["chunk_ids"])) for r in rows.collect()} == want


def test_short_lists_stay(spark):
    items = spark.createDataFrame([(1, "red"), (2, "red fox"), (3, "hen")], "item_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "red fox")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 3, 0.9, 1), (1, 1, 0.8, 2), (1, 2, 0.7, 3), (2, 3, 0.9, 1), (2, 2, 0.1, 2)], "query_id long, item_id long, score double, rank int")
    told = lambda **how: sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in strategies.reranked(hits, queries, items, 2, **how).collect())
    assert told() == [(1, 1, 2, 1.0), (1, 2, 1, 0.5), (2, 1, 3, 0.9), (2, 2, 2, 0.1)]
    assert told(skip_if_small=False) == [(1, 1, 2, 1.0), (1, 2, 1, 0.5), (2, 1, 2, 1.0), (2, 2, 3, 0.0)]


def test_pool_of_sub_queries(spark):
    texts = [(1, "Is it red and round? Or is it not; maybe"), (2, "nothing to split"), (3, None), (4, " AND and "), (5, "sand and land")]
    rows = spark.createDataFrame(texts, "i long, q string").select("i", strategies.sub_queries(F.col("q")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in rows} == {1: ["Is it red", "round", "is it not", "maybe"], 2: ["nothing to split"], 3: [None], 4: [" AND and "], 5: ["sand", "land"]}
    hits = spark.createDataFrame([(1, 0, 7, 0.1, 2), (1, 0, 8, 0.9, 1), (1, 1, 7, 5.0, 1), (1, 1, 9, 4.0, 2), (2, 3, 7, 1.0, 1)], "query_id long, part int, item_id long, score double, rank int")
    got = sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in strategies.pooled(hits, "query_id").collect())
    assert got == [(1, 1, 8, 0.9), (1, 2, 7, 0.1), (1, 3, 9, 4.0), (2, 1, 7, 1.0)]


def test_search_types(spark):
    items = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "blue", [0.0, 1.0])], "item_id long, text string, vector array<double>")
    queries = spark.createDataFrame([(1, "blue", [1.0, 0.1])], "query_id long, query string, query_vector array<double>")
    first = lambda kind: strategies.execute_search(queries, items, 1, kind).first()["item_id"]
    assert (first("keyword"), first("vector")) == (2, 1)
    with pytest.raises(ValueError, match="unknown search type"):
        first("other")


class _Counting(models.HashedEmbedder):
    """Adds up the texts that it is given."""

    def __init__(self, total) -> None:
        super().__init__()
        self.total = total

    def embed(self, texts):
        self.total.add(len(texts))
        return super().embed(texts)


@pytest.mark.parametrize("name", ["none", "hyde"])
def test_vectors_are_computed_once(spark, name):
    total = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, f"red fox {i}") for i in range(60)], "item_id long, text string")
    chunks = models.embed(docs, _Counting(total)).select(F.col("item_id").alias("chunk_id"), F.lit("b").alias("book_id"), F.lit("s").alias("section"), "text", F.when(F.col("item_id") != 7, F.col("vector")).alias("vector"))
    found = strategies.search_chunks(spark.createDataFrame([(1, "red fox 9")], "query_id long, query string"), chunks, 3, rerank=True, name=name)
    assert found.count() == 3 and total.value == 60


def test_difficulty(spark):
    rows = spark.createDataFrame([("a", "1", 0.5), ("a", "nan", 1.0), ("a", "x", None), (None, None, 1 / 3), ("b", None, float("nan"))], "d string, m string, n double")
    got = evaluation.difficulty(rows.drop("n"), "d", ["m"]).collect()
    assert {r["difficulty"]: (r["m"], r["n"]) for r in got} == {"a": (1.0, 3), "unknown": (0.0, 1), "b": (0.0, 1)}


@pytest.mark.parametrize("tolerance", [1e-5, 1e-3])
def test_ranks_by_deltas(spark, tolerance):
    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 60, (120, 2))] + [(0, i) for i in range(60, 90)] + [(i, i + 1) for i in range(90, 130)] + [(5, 5)]
    vertices, edges = spark.range(135).withColumnRenamed("id", "id"), spark.createDataFrame(pairs, "src long, dst long")
    ranks, sent = graph.pagerank_by_deltas(vertices, edges, tolerance=tolerance, most=200)
    got = {x["id"]: x["pagerank"] for x in ranks.collect()}
    w = np.zeros((135, 135))
    for a in graph.both_ways(edges).collect():
        w[a["dst"], a["src"]] += 1
    w /= np.maximum(w.sum(0), 1)
    dense = np.linalg.solve(np.eye(135) - 0.85 * w, np.full(135, 0.15))
    assert set(got) == set(range(135))
    # What is held back could add at most tolerance / (1 - d) a vertex, counted over all vertices.
    assert sum(abs(got[i] - dense[i]) for i in got) <= 135 * tolerance / 0.15 * 0.85 + 1e-9
    assert sent[0] == 135 and sent[-1] < 135 and len(sent) < 200


def test_ranks_by_deltas_in_few_rounds(spark):
    """Two sides, doubled vertices, and ends that are no vertices: exact to six digits in at most 25 rounds, and no table is left in the catalogue."""
    r = np.random.default_rng(5)
    pairs = [(int(a), 100 + int(b)) for a, b in zip(r.integers(0, 100, 900), r.integers(0, 20, 900), strict=True)] + [(3, 500), (600, 4)]
    vertices = spark.createDataFrame([(i,) for i in [*range(122), 7, 7]], "id long")
    ranks, sent = graph.pagerank_by_deltas(vertices, spark.createDataFrame(pairs, "src long, dst long"), tolerance=1e-9)
    w = np.zeros((601, 601))
    for a, b in pairs:
        w[a, b] += 1
        w[b, a] += 1
    w = (w / np.maximum(w.sum(0), 1))[:122, :122]
    dense = np.linalg.solve(np.eye(122) - 0.85 * w, np.full(122, 0.15))
    got = [(x["id"], round(x["pagerank"] - dense[x["id"]], 6)) for x in ranks.collect()]
    assert sorted(got) == [(i, 0.0) for i in range(122)]
    assert len(sent) <= 25 and not [t for t in spark.catalog.listTables() if t.name.startswith("arcs_")]


def test_judges(spark):
    questions = spark.createDataFrame([(1, "what is red", "the fox is red"), (2, "who runs", "hens run"), (3, "nothing", "none")], "query_id long, query string, reference string")
    answers = spark.createDataFrame([(1, "The fox is red [1]. Pigs can fly [2]."), (2, "Hens run [1].")], "query_id long, answer string")
    items = spark.createDataFrame([(1, "A fox. The fox is red!"), (2, "Snow falls."), (3, "Here hens run.")], "item_id long, text string")
    hits = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (2, 3, 1), (2, 2, 2)], "query_id long, item_id long, rank int")
    got = {r["query_id"]: r for r in evaluation.judged(questions, answers, hits, items).collect()}
    assert [got[q]["faithfulness"] for q in (1, 2, 3)] == [0.5, 1.0, 0.0]
    assert [got[q]["context_precision"] for q in (1, 2, 3)] == [0.5, 1.0, 0.0]
    assert 0.8 < got[2]["correctness"] < 1.0 and got[3]["correctness"] == 0.0 and 0 < got[1]["relevancy"] < 1
    some = questions.withColumn("reference", F.when(F.col("query_id") > 1, F.col("reference")))
    assert evaluation.judged(some, answers, hits, items).columns == ["query_id", "faithfulness", "relevancy"]
    with pytest.raises(ValueError, match="unknown metric"):
        evaluation.judged(questions, answers, hits, items, ["other"])
