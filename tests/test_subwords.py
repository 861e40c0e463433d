"""Subword counts against a plain merge loop and against the public library's own."""

from __future__ import annotations

import random

import pytest
import regex

from corpusgraph.operators import chunking, sequences, subwords
from corpusgraph.plans.session import table
from tests.conftest import DATA


@pytest.fixture(scope="module")
def pairs(spark):
    return subwords.BytePairs.read(spark)


def _plain(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_merges(pairs):
    r = random.Random(3)
    words = ["".join(r.choice("aabcdeéß日 \n0'") for _ in range(r.randrange(1, 40))).encode() for _ in range(400)] + [b"a" * 300, b"ab" * 150, "the".encode(), b"\xff\x00"]
    for w in words:
        assert subwords.merged(w, pairs.ranks) == _plain(w, pairs.ranks)
    toy = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"bab": 4}
    assert subwords.merged(b"ababab", toy) == _plain(b"ababab", toy)


def test_long_word(pairs):
    """Half a megabyte without a blank, in a bounded time."""
    import time

    began = time.monotonic()
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(500_000))
    assert 0 < pairs.sizes([text])[0] < len(text) and time.monotonic() - began < 30


def test_counts(spark, pairs):
    texts = ["", None, "it's  a test,\n\n really!", "日本語 text…", "x" * 5000, " \t ", "don't WE'LL 3.14"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in subwords.count_tokens(docs, pairs).collect()}
    want = {i: sum(len(_plain(w.encode(), pairs.ranks)) for w in regex.findall(subwords.PATTERN, t or "")) for i, t in enumerate(texts)}
    assert got == want
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=subwords.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rows = subwords.count_tokens(table(spark, DATA, "documents"), pairs).select("text", "tokens").collect()
    assert all(len(own.encode_ordinary(r["text"] or "")) == r["tokens"] for r in rows)


def test_sections_and_budgets(spark, pairs):
    docs = table(spark, DATA, "documents")
    found = chunking.pack_sentences(docs, most=300, overlap=0, counter=pairs).collect()
    from corpusgraph.operators import cleaning

    sentences = {r["doc_id"]: r["s"] for r in docs.select("doc_id", cleaning.sentences(docs["text"]).alias("s")).collect()}
    for r in found:
        sizes = pairs.sizes(sentences[r["doc_id"]][r["first"] : r["last"] + 1])
        assert r["tokens"] == sum(sizes) and (r["tokens"] <= 300 or len(sizes) == 1)
        rest = sentences[r["doc_id"]][r["last"] + 1 :]
        assert not rest or r["tokens"] + pairs.sizes(rest[:1])[0] > 300
    talk = table(spark, DATA, "conversations").collect()
    kept = {(r["conv_id"], r["turn"]): r["kept"] for r in sequences.within_budget(table(spark, DATA, "conversations"), "text", 40, least=5, counter=pairs).collect()}
    want, used = {}, {}
    for r in sorted(talk, key=lambda x: (x["conv_id"], x["turn"])):
        size, left = pairs.sizes([r["text"]])[0], 40 - used.get(r["conv_id"], 0)
        used[r["conv_id"]] = used.get(r["conv_id"], 0) + size
        if left >= size or left > 5:
            want[r["conv_id"], r["turn"]] = r["text"] if size <= left else r["text"][: left * 4] + "..."
    assert kept == want


def test_words_merged_together(pairs):
    """New words of a block are merged at once, as each would be by itself; long ones aren't remembered."""
    r = random.Random(8)
    words = ["".join(r.choice("aabcdeéß日 \n0'xyz") for _ in range(r.randrange(1, 22))).encode() for _ in range(3000)] + [b"a" * 64, b"ab" * 32, b"aaa", b"\xff\x00"]
    for ranks in (pairs.ranks, {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"bab": 4}):
        assert subwords._Merges(ranks).counts(words).tolist() == [len(subwords.merged(w, ranks)) for w in words]
    texts = ["".join(r.choice("abc日 ") for _ in range(300)) for _ in range(50)] + ["q" * 500]
    fresh = subwords.BytePairs(pairs.ranks)
    assert fresh.sizes(texts) == [sum(len(subwords.merged(w.encode(), pairs.ranks)) for w in regex.findall(subwords.PATTERN, t)) for t in texts]
    assert "q" * 500 not in fresh._memo and fresh._merges is not None


def test_packing_asks_once_a_slice():
    import pyarrow as pa

    class Counting(subwords.Words):
        calls = 0

        def sizes(self, texts):
            Counting.calls += 1
            return super().sizes(texts)

    rows = [["a b c", "d"] if i % 3 else [] for i in range(2 * chunking.SLICE)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(rows))), "s": pa.array(rows, pa.list_(pa.string()))})
    found = pa.Table.from_batches(chunking.packed(iter([batch]), Counting(), 3, 0)).to_pylist()
    assert Counting.calls == 2
    assert [(x["key"], x["text"]) for x in found] == [(i, t) for i, s in enumerate(rows) for t in s]
