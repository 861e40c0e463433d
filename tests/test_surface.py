"""Helpers by name in SQL, and streams that are stopped and taken up again."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from corpusgraph.functions import surface
from corpusgraph.operators import chunking, cleaning
from corpusgraph.sources.collections import Collection
from corpusgraph.streaming import ingest

TEXTS = [(1, "One two.  Three four! Five six seven."), (2, None), (3, ""), (4, "a " * 30 + "end. " + "b " * 10 + "end."), (5, "Übung  macht. Ok?"), (None, "no id here.")]


def test_functions_by_name(spark):
    assert surface.register(spark) == [*surface.SCALARS, "section_chunks"]
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = spark.sql("SELECT doc_id, text_squeeze(text) AS a, text_tokens(text) AS b, text_sentences(text) AS c, text_unfenced('```json\n{{}}\n```') AS d FROM {docs}", docs=docs).collect()
    want = docs.select("doc_id", cleaning.squeeze(F.col("text")).alias("a"), chunking.token_count(F.col("text")).alias("b"), cleaning.sentences(F.col("text")).alias("c"), F.lit("{}").alias("d")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_table_function(spark):
    surface.register(spark)
    docs = spark.createDataFrame([t for t in TEXTS if t[0]], "doc_id long, text string")
    got = spark.sql("SELECT * FROM section_chunks(TABLE(SELECT doc_id, pos, s FROM (SELECT doc_id, text_sentences(text) AS every FROM {docs}) LATERAL VIEW posexplode(every) AS pos, s) PARTITION BY doc_id ORDER BY (pos), 12, 1)", docs=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.pack_sentences(docs, most=12, overlap=1).collect()))


def test_ingest_restarts(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, t, at + datetime.timedelta(minutes=n)) for n, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, ts timestamp"
    stored = Collection(spark, str(tmp_path), "chunks", ingest.FIELDS)
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[:3] + rows[:2], schema).write.parquet(str(tmp_path / "in"))
    ingest.ingest(read(), stored, str(tmp_path / "state"), most=12)
    first = {r["doc_id"] for r in stored.rows().collect()}
    # The rest comes, and some of the first documents again; then nothing new.
    spark.createDataFrame(rows[3:] + rows[:1], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(read(), stored, str(tmp_path / "state"), most=12)
        got = sorted(map(tuple, stored.rows().collect()))
        whole = ingest.chunks(spark.createDataFrame([r for r in rows if r[0]], schema), most=12)
        assert got == sorted(map(tuple, whole.collect())) and len({g[0] for g in got}) == len(got)
    assert first == {1}
