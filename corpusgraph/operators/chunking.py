"""Chunking: greedy packing by tokens, similarity breaks, contextual prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators import cleaning, subwords


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def pack(sizes: list[int], most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First and last place of each chunk: greedy, and starting anew with the last overlap places if they leave room."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield begin, i - 1
            back = max(begin, i - overlap)
            again = sum(sizes[back:i])
            begin, held = (i, 0) if again + size > most else (back, again)
        held += size
    if sizes:
        yield begin, len(sizes) - 1


def pack_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 800, overlap: int = 2, counter: subwords.TokenCounter | None = None) -> DataFrame:
    """key, chunk, first, last, tokens, text: sentences packed greedily up to most tokens, which counter counts (words between blanks by default).

    A sentence that doesn't fit ends the chunk; the next starts with the last overlap sentences, or without
    them if they leave no room. A sentence of over most tokens makes a chunk of its own. The fold is
    sequential within a document, so it runs over Arrow batches; nothing is shuffled.
    """
    kind = dict(docs.dtypes)[key]
    sent = docs.sparkSession.sparkContext.broadcast(counter or subwords.Words())
    d = docs.select(F.col(key).alias("key"), cleaning.sentences(F.col(text)).alias("s"))
    return d.mapInArrow(lambda batches: packed(batches, sent.value, most, overlap), f"key {kind}, chunk int, first int, last int, tokens int, text string").withColumnRenamed("key", key)


#: Documents whose sentences a worker holds as Python strings at once, however many a batch has.
SLICE = 64


def packed(batches: Iterator[pa.RecordBatch], counter: subwords.TokenCounter, most: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of batches (key, s), slice by slice."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            source, rows = [], []
            held = batch.column("s").to_pylist()
            # One call for all, so that the counter meets their new words together.
            every = iter(counter.sizes([x for s in held for x in s]))
            for i, s in enumerate(held):
                sizes = [next(every) for _ in s]
                for n, (lo, hi) in enumerate(pack(sizes, most, overlap)):
                    source.append(i)
                    rows.append((n, lo, hi, sum(sizes[lo : hi + 1]), " ".join(s[lo : hi + 1])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(source, pa.int64())), *arrays], ["key", "chunk", "first", "last", "tokens", "text"])


def similarity_breaks(rows: DataFrame, group: str, order: str, vector: str, k: float) -> DataFrame:
    """rows with similarity to the row before and breaks: true where it is under mean - k * population deviation of the group, and at its first row."""
    at = W.partitionBy(group).orderBy(order)
    rows = rows.withColumn("similarity", cosine(F.col(vector), F.lag(vector).over(at)))
    every = W.partitionBy(group)
    cut = F.avg("similarity").over(every) - F.lit(k) * F.stddev_pop("similarity").over(every)
    return rows.withColumn("breaks", F.col("similarity").isNull() | (F.col("similarity") < cut))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda p, q: p + q)


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(dot(v, v))
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size == 0, 1.0).otherwise(size)


def contextual(snippet: Column, text: Column) -> Column:
    """[snippet] text; the text alone where there is no snippet."""
    return F.when(F.coalesce(snippet, F.lit("")) == "", text).otherwise(F.concat(F.lit("["), snippet, F.lit("] "), text))


#: What an oversized sentence is split at, in order of preference.
SEPARATORS = ("; ", ": ", ", ")


def split_oversized(sentence: str, most: int) -> list[str]:
    """Parts of a sentence of over most words: at the first separator that gives more than one part, else by words. A longer word stays whole."""
    if len(sentence.split()) <= most:
        return [sentence]
    for separator in SEPARATORS:
        pieces = sentence.split(separator)
        pieces = [p + separator.rstrip() for p in pieces[:-1]] + pieces[-1:]
        parts = [" ".join(pieces[a : b + 1]) for a, b in pack([len(p.split()) for p in pieces], most, 0)]
        if len(parts) > 1:
            return [part for p in parts for part in ([p] if len(p.split()) <= most else _by_words(p, most))]
    return _by_words(sentence, most)


def _by_words(text: str, most: int) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]


def split_sentences(rows: DataFrame, most: int, key: str = "doc_id", sentences: str = "sentences") -> DataFrame:
    """key, parts: the sentences with oversized ones split, in order. Whole texts, in Arrow batches, without a shuffle."""

    @F.arrow_udf("array<string>")
    def parts(column: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.string()))]
        for at in range(0, len(column), SLICE):
            out.append(pa.array([None if x is None else [p for s in x for p in split_oversized(s, most)] for x in column.slice(at, SLICE).to_pylist()], pa.list_(pa.string())))
        return pa.concat_arrays(out)

    return rows.select(key, parts(F.col(sentences)).alias("parts"))


def batches(rows: DataFrame, most: int, key: str = "doc_id", sizes: str = "sizes") -> DataFrame:
    """key, batch, first, last, tokens: texts of the given sizes (array<int>) in greedy batches of at most most tokens; a larger text is a batch of its own."""
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            source, found = [], []
            for i, s in enumerate(part.column("sizes").to_pylist()):
                for n, (a, b) in enumerate(pack(s or [], most, 0)):
                    source.append(i)
                    found.append((n, a, b, sum(s[a : b + 1])))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(source, pa.int64())), *[pa.array(list(c), pa.int32()) for c in columns]], ["key", "batch", "first", "last", "tokens"])

    return rows.select(F.col(key).alias("key"), F.col(sizes).alias("sizes")).mapInArrow(run, f"key {kind}, batch int, first int, last int, tokens int").withColumnRenamed("key", key)


def semantic_segments(rows: DataFrame, group: str, order: str, vector: str, k: float, overlap: int = 2) -> DataFrame:
    """group, segment (from 0), members, carried: rows in order, a new segment at each similarity break; carried are the last overlap members of the segment before."""
    at = W.partitionBy(group).orderBy(order)
    numbered = similarity_breaks(rows, group, order, vector, k).withColumn("segment", F.sum(F.col("breaks").cast("long")).over(at) - 1)
    found = numbered.groupBy(group, "segment").agg(F.array_sort(F.collect_list(order)).alias("members"))
    before = F.lag("members").over(W.partitionBy(group).orderBy("segment"))
    tail = F.slice(before, F.greatest(F.size(before) - overlap + 1, F.lit(1)), overlap)
    return found.withColumn("carried", F.coalesce(tail, F.array().cast(dict(found.dtypes)["members"])))


def _by_lines(docs: DataFrame, most: int) -> DataFrame:
    return docs.select("doc_id", F.posexplode(cleaning.lines(F.col("text"))).alias("chunk", "text"))


CHUNKERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"section": lambda docs, most: pack_sentences(docs, most=most), "lines": _by_lines}


def run(docs: DataFrame, book: str, strategies: Sequence[str], most: int = 800) -> DataFrame:
    """book, strategy, chunks: the number of chunks that each strategy makes of each book; unknown strategies raise."""
    out = None
    for name in strategies:
        if name not in CHUNKERS:
            raise ValueError(f"unknown chunking strategy {name}; known are {', '.join(sorted(CHUNKERS))}")
        # Chunkers keep documents apart, so a book's chunks are counted by document first and no text is shuffled.
        counts = CHUNKERS[name](docs, most).groupBy("doc_id").agg(F.count("*").alias("n"))
        one = docs.select("doc_id", F.col(book).alias("book")).join(counts, "doc_id").groupBy("book").agg(F.sum("n").alias("chunks")).select("book", F.lit(name).alias("strategy"), "chunks")
        out = one if out is None else out.unionAll(one)
    return out
