"""What large inputs showed: waits, tables and shuffles that grew faster than the work."""

from __future__ import annotations

import time

import regex
from pyspark.sql import functions as F

from corpusgraph.operators import boundaries, chunking, graph, grid, models, phrases, search
from corpusgraph.operators.inverted_index import InvertedIndex
from corpusgraph.plans import scratch
from corpusgraph.sources import files


class _Limited:
    """Refuses each prompt once in a way that passes, and 'never' always."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def complete(self, prompts: list[str]) -> list[str]:
        if "never" in prompts:
            raise models.ModelError("refused")
        if not self.seen.issuperset(prompts):
            self.seen |= set(prompts)
            raise models.ModelError("429: rate limit")
        return [p.upper() for p in prompts]


def test_one_wait_for_all_failed_calls():
    waits: list[float] = []
    got = models._completed(_Limited(), ["a", "never", "b", "c"], 1, 3, 0.5, waits.append)
    assert waits == [0.5]
    assert [(x["text"], x["tries"], x["error"]) for x in got] == [("A", 2, None), (None, None, "refused"), ("B", 2, None), ("C", 2, None)]
    waits.clear()
    lasting = models._completed(_Limited(), ["a"], 1, 1, 0.5, waits.append)
    assert not waits and lasting == [{"text": None, "tries": None, "error": "429: rate limit"}]


def test_keyword_search_keeps_postings_of_asked_terms_alone(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"Common word{i % 7} rare{i}, {'common ' * (i % 3)}") for i in range(60)] + [(60, None), (61, "")], "item_id long, text string")
    asked = spark.createDataFrame([(1, "common word3"), (2, "RARE5 nowhere"), (3, "")], "query_id long, query string")
    kept = []
    build = InvertedIndex.build.__func__
    monkeypatch.setattr(InvertedIndex, "build", classmethod(lambda cls, *a, **b: kept.append(build(cls, *a, **b)) or kept[-1]))
    got = {tuple(r) for r in search.bm25(asked, items, 5).select("query_id", "item_id", "score", "rank").collect()}
    assert {r["term"] for r in kept[0].table.where("term IS NOT NULL").collect()} == {"common", "word3", "rare5"}
    whole = build(InvertedIndex, items, scratch.Scratch(spark, "whole").path("index"))
    assert len(got) == 6 and got == {tuple(r) for r in whole.search(asked, 5).select("query_id", "item_id", "score", "rank").collect()}


def test_only_runs_that_may_be_known_leave_the_texts(spark):
    known = spark.createDataFrame([("new york",), ("york city hall",)], "phrase string")
    bits = phrases.known_filter(known)
    rows = spark.createDataFrame([(1, 0, "the new york city hall new".split()), (2, 0, ["york"]), (2, 1, []), (3, 0, ["new"]), (3, 1, ["york", "city"])], "key long, pos int, words array<string>")
    got = phrases.runs(rows.coalesce(1), (2, 3), lambda h, n: phrases._passes(bits, phrases._joined(h, n))).collect()
    assert sorted((r["key"], r["pos"], r["at"], r["n"], r["phrase"]) for r in got) == [(1, 0, 1, 2, "new york"), (1, 0, 2, 3, "york city hall")]


def test_a_leiden_turn_shuffles_links_once(spark):
    pairs = [(a, b) for a in range(12) for b in range(a) if (a * 7 + b * 3) % 4 == 0] + [(20, 20)]
    arcs = graph.both_ways(spark.createDataFrame(pairs, "src long, dst long")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    labels = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree")).withColumn("community", F.col("id") % 5)
    total = arcs.agg(F.sum("w")).first()[0]
    new = graph._moved(arcs, labels, total, 1.0, 3)
    home = {r["id"]: r for r in labels.collect()}
    links = {(r["src"], r["dst"]): r["w"] for r in arcs.collect()}
    turns = {r["id"] for r in labels.where("pmod(xxhash64(id, 1), 2) = 1").collect()}
    for row in new.collect():
        i, was = row["id"], home[row["id"]]["community"]
        gains = {}
        for c in {was} | {home[b]["community"] for (a, b) in links if a == i and b != i}:
            k = sum(w for (a, b), w in links.items() if a == i and b != i and home[b]["community"] == c)
            others = sum(r["degree"] for r in home.values() if r["community"] == c) - (home[i]["degree"] if c == was else 0)
            gains[c] = (round(k - home[i]["degree"] * others / total, 9), c == was, -c)
        want = max(gains, key=gains.get) if i in turns else was
        assert (row["community"], row["moved"]) == (want, want != was)
    # Two rows cross for an arc at most: to its end's label, and on to its beginning; nothing is dealt anew for sums, gains and choices.
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_merged_edges_fan_out_without_an_aggregate(spark):
    edges = spark.createDataFrame([("a", "b", "T", 2.0, 5), ("a", "b", "T", 1.0, 3), ("c", "b", "T", 9.0, 1), ("a", "x", "T", 1.0, 1), ("b", "b", None, None, 2)], "src_name string, dst_name string, type string, weight double, seq long")
    nodes = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b"), (4, None), (5, "a"), (5, "c"), (None, "b")], "id long, normalized_name string")
    got = sorted((tuple(r) for r in graph.merge_edges(edges, nodes).collect()), key=repr)
    ends = [2, 3, None]
    want = [(1, "T", b, 1.0) for b in ends] + [(5, "T", b, 9.0) for b in ends] + [(a, None, b, None) for a in ends for b in ends]
    assert got == sorted(want, key=repr)
    one_name = nodes.where("id < 4").distinct()
    plain = graph.merge_edges(edges, one_name)._jdf.queryExecution().optimizedPlan().toString()
    # Pairs of ends that have one name each are final: they come out of the last join as they are.
    assert plain.splitlines()[0].startswith("Project") and plain.splitlines()[1].strip().startswith("+- Join")
    assert len(graph.merge_edges(edges, one_name).collect()) == 6


def test_words_are_told_once_each(spark):
    docs = spark.createDataFrame([(1, 'Dr. A (saw) "Dr." saw. Saw'), (2, None), (3, " A saw!) Dr. ")], "doc_id long, text string")
    counts = boundaries.type_counts(boundaries.explode_words(docs, "doc_id", "text"))
    got = {r["type"]: (r["n"], r["dotted"], r["small"], r["inside"]) for r in counts.collect()}
    assert got == {"dr": (3, 3, 0, 1), "a": (2, 0, 0, 0), "saw": (4, 1, 3, 0)}
    lone = boundaries.type_counts(boundaries.lone_words(docs, "text"))
    assert {r["type"]: (r["n"], r["dotted"], r["small"]) for r in lone.collect()} == {k: v[:3] for k, v in got.items()}
    # Types are made after words have been counted: the aggregate by word is below the expressions.
    plan = lone._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_sentences_are_packed_and_split_slice_by_slice(spark, monkeypatch):
    seen = []
    docs = [["a b. " * 3, "c d."] * 2] * (2 * chunking.SLICE + 1)
    sizes = chunking.subwords.Words()
    monkeypatch.setattr(sizes, "sizes", lambda texts: seen.append(len(texts)) or [len(t.split()) for t in texts], raising=False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], ["key", "s"])
    out = list(chunking.packed(iter([batch]), sizes, 8, 1))
    assert [b.num_rows for b in out] == [n * out[-1].num_rows for n in (chunking.SLICE, chunking.SLICE, 1)]
    assert len(seen) == len(docs)


def test_parsed_files_are_handed_on_slice_by_slice():
    import pyarrow as pa

    content = [b"a", None, b"\xff", b"x" * files.SLICE_CHARS, *[b"b"] * files.SLICE, b"c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(content))), pa.array(content)], ["key", "content"])
    out = list(files.parsed_batches(iter([batch]), bytes.decode))
    assert [b.num_rows for b in out] == [4, files.SLICE, 1]
    got = [r for b in out for r in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True)]
    assert got == [(i, None if c is None or c == b"\xff" else c.decode()) for i, c in enumerate(content)]


def test_ranks_are_hashed_not_sorted(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "src long, dst long")
    ranks = graph.pagerank(spark.range(1, 5), edges, rounds=3)
    assert {r["id"]: round(r["pagerank"], 6) for r in ranks.collect()}[4] == 0.15
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("strategy=shuffle_hash") == 3


def test_long_texts_are_cut_to_chunks_in_one_pass(spark):
    texts = ["\n".join(f"line {i} of {i % 7}" for i in range(30_001)), "", "a", "a\n", "\n\nb\n\n\n", None]
    docs = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    began = time.time()
    got = {(r["collection"], r["item_id"]): r["text"] for r in grid.chunked(docs).collect()}
    assert time.time() - began < 30  # splitting the first text for each of its chunks takes minutes
    want = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for name, n in grid.LINES.items():
            whole = f"[s{i}] {t or ''}" if name == "contextual" else t or ""
            want |= {(name, i * grid.ROOM + at): x for at, x in enumerate(["\n".join(lines[j : j + n]) for j in range(0, len(lines), n)] if n else [whole])}
    assert got == want


def test_words_of_texts_by_blanking_other_signs():
    for text in ["", "plain words, 2 of them", "naïve Ärzte½ x y z\x1cw", "日本語、テスト", "".join(map(chr, range(33, 0x2500)))]:
        assert models.words(text) == regex.findall(r"[\p{L}\p{N}]+", text)
