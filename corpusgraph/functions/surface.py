"""Helpers and chunkers by name in SQL: temporary functions, and a table function over partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.chunking import pack

_SQUEEZED = r"regexp_replace(regexp_replace(%s, ' +', ' '), r'^\s+|\s+$', '')"
#: SQL functions of one expression, which Catalyst inlines. A function can't take the variable of a lambda, so what is used in one is written out.
SCALARS = {
    "text_squeeze": ("text STRING", "STRING", _SQUEEZED % "text"),
    "text_tokens": ("text STRING", "INT", r"size(filter(split(coalesce(text, ''), r'\s+'), x -> x <> ''))"),
    "text_unfenced": ("text STRING", "STRING", r"regexp_replace(regexp_replace(text, r'^\s*```(json)?\s*', ''), r'\s*```\s*$', '')"),
    "text_sentences": ("text STRING", "ARRAY<STRING>", r"filter(transform(split(regexp_replace(coalesce(text, ''), r'([.!?])\s+', concat('$1', char(1))), char(1)), s -> " + _SQUEEZED % "s" + "), s -> s <> '')"),
}


class SectionChunks:
    """Rows (key, sentence) of one partition, in its order, packed into chunks of at most `most` words; a chunk starts with the last `overlap` sentences of the one before, if they leave room."""

    def __init__(self) -> None:
        self.key, self.sentences, self.limits = None, [], (800, 2)

    def eval(self, row: Row, most: int, overlap: int) -> None:
        self.key, self.limits = row[0], (most, overlap)
        self.sentences.append(row[-1])

    def terminate(self) -> Iterator[tuple]:
        sizes = [len(s.split()) for s in self.sentences]
        for n, (lo, hi) in enumerate(pack(sizes, *self.limits)):
            yield self.key, n, lo, hi, sum(sizes[lo : hi + 1]), " ".join(self.sentences[lo : hi + 1])


def register(spark: SparkSession) -> list[str]:
    """The names that are registered in the session: SCALARS and section_chunks(TABLE(key, ..., sentence) PARTITION BY key ORDER BY (...), most, overlap)."""
    for name, (takes, gives, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    chunks = F.udtf(SectionChunks, returnType="key bigint, chunk int, first int, last int, tokens int, text string")
    spark.udtf.register("section_chunks", chunks)
    return [*SCALARS, "section_chunks"]
