"""Queries of sources, chunkers, configuration tables and retrieval strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import chunking, cleaning, evaluation, strategies
from corpusgraph.plans.registry import query
from corpusgraph.plans.scratch import Scratch
from corpusgraph.plans.search_queries import _BM25, _OVER
from corpusgraph.plans.session import table
from corpusgraph.plans.text_queries import _COS, _SENTENCES
from corpusgraph.sources import files


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(regexp_replace(url, '^https?://', '/out/'), '\.[^./]*$', '') || '.md' END AS path FROM pages")
def src_mirror(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "/in/")
    return table(spark, d, "pages").select("page_id", files.mirrored(path, "/in", "/out", ".md").alias("path"))


@query("SELECT doc_id, lang AS strategy, source AS book, text FROM documents")
def snk_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by strategy and book, and read again; a second write is skipped."""
    at = Scratch(spark, "chunks").path("table")
    chunks = table(spark, d, "documents").select("doc_id", F.col("lang").alias("strategy"), F.col("source").alias("book"), "text")
    files.write_chunks(chunks, at)
    files.write_chunks(chunks.limit(0), at, "skip")
    return spark.read.schema(chunks.schema).parquet(at).select(*chunks.columns)


@query(f"""WITH l AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT vec_id, label, CASE WHEN b IS NOT NULL THEN {_COS} END AS similarity FROM l),
c AS (SELECT *, avg(similarity) OVER w - 1.5 * stddev_pop(similarity) OVER w AS cut FROM s WINDOW w AS (PARTITION BY label)),
n AS (SELECT vec_id, label, (sum((similarity IS NULL OR similarity < cut)::INT) OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS segment FROM c),
g AS (SELECT label, segment, list(vec_id ORDER BY vec_id) AS m FROM n GROUP BY ALL)
SELECT label, segment, array_to_string(m, ',') AS members, coalesce(array_to_string(lag(list_slice(m, greatest(len(m) - 1, 1), len(m))) OVER (PARTITION BY label ORDER BY segment), ','), '') AS carried FROM g""")
def chk_semantic(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.semantic_segments(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 1.5)
    return found.select("label", "segment", F.array_join("members", ",").alias("members"), F.array_join("carried", ",").alias("carried"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", cleaning.sentences(F.col("text")).alias("sentences"))


@query()
def chk_oversize(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_sentences(_sentences(spark, d), 12).select("doc_id", F.posexplode("parts").alias("pos", "part"))


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, list_transform({_SENTENCES}, lambda x: len(string_split(x, ' '))) AS z FROM documents),
f AS (SELECT doc_id, z, 1 AS i, 0 AS batch, z[1]::INT AS held FROM s WHERE len(z) > 0 UNION ALL
SELECT doc_id, z, i + 1, CASE WHEN held + z[i + 1] > 60 THEN batch + 1 ELSE batch END, CASE WHEN held + z[i + 1] > 60 THEN z[i + 1]::INT ELSE held + z[i + 1]::INT END FROM f WHERE i < len(z))
SELECT doc_id, batch, min(i - 1)::INT AS first, max(i - 1)::INT AS last, max(held)::INT AS tokens FROM f GROUP BY doc_id, batch""")
def chk_batch(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.transform("sentences", lambda s: F.size(F.split(s, " ")))
    return chunking.batches(_sentences(spark, d).select("doc_id", sizes.alias("sizes")), 60)


@query("SELECT * FROM (VALUES ('none', '0.0,0.5,1.0', 0.5::DOUBLE), ('hyde', '1.0', 1.0), ('decomposition', '1.0', 1.0), ('graph', '1.0', 1.0)) t(strategy, allowed, preferred)")
def cfg_alpha(spark: SparkSession, d: str) -> DataFrame:
    valid = evaluation.grid(spark).where("fault = ''").groupBy("strategy").agg(F.array_sort(F.collect_set("alpha")).alias("a"))
    preferred = F.when(F.array_contains("a", 0.5), 0.5).otherwise(F.get("a", 0))
    return valid.select("strategy", F.array_join("a", ",").alias("allowed"), preferred.alias("preferred"))


@query("SELECT * FROM (VALUES ('none', 'optional'), ('hyde', 'optional'), ('decomposition', 'required'), ('graph', 'forbidden')) t(strategy, rule)")
def cfg_rerank(spark: SparkSession, d: str) -> DataFrame:
    ok = evaluation.grid(spark).where("fault = ''").groupBy("strategy").agg(F.bool_or("reranking").alias("on"), F.bool_or(~F.col("reranking")).alias("off"))
    return ok.select("strategy", F.when(F.col("on") & F.col("off"), "optional").when(F.col("on"), "required").otherwise("forbidden").alias("rule"))


@query("SELECT s.strategy, c.collection FROM (VALUES ('none'), ('hyde'), ('decomposition')) s(strategy), (VALUES ('section'), ('semantic_std2'), ('semantic_std3'), ('contextual'), ('raptor')) c(collection) UNION ALL SELECT 'graph', 'graph_chunks'")
def cfg_coll(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.grid(spark).where("fault = ''").select("strategy", "collection").distinct()


@query("SELECT collection, string_agg(strategy, ',' ORDER BY strategy) AS strategies FROM (SELECT s.strategy, c.collection FROM (VALUES ('none'), ('hyde'), ('decomposition')) s(strategy), (VALUES ('section'), ('semantic_std2'), ('semantic_std3'), ('contextual'), ('raptor')) c(collection) UNION ALL SELECT 'graph', 'graph_chunks') GROUP BY collection")
def cfg_compat(spark: SparkSession, d: str) -> DataFrame:
    pairs = cfg_coll(spark, d)
    return pairs.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")


@query(_BM25 + "SELECT query_id, item_id, score, rank FROM h")
def st_none(spark: SparkSession, d: str) -> DataFrame:
    return strategies.get("none")(*_asked(spark, d), 10)


_PARTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '(?i)\s+(?:and|or|but)\s+|[?;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
#: Sub-queries: item_id * 1000 + part.
_SUB = f"SELECT item_id * 1000 + part AS item_id, text FROM (SELECT item_id, unnest(p) AS text, unnest(range(0, len(p))) AS part FROM (SELECT item_id, CASE WHEN len({_PARTS}) > 1 THEN {_PARTS} ELSE [text] END AS p FROM benchmark))"


def pooled_sql(hits: str, by: str = "query_id") -> str:
    """Hits of sub-queries (query_id * 1000 + part) as one list a query: items where they first occur, in the order of parts and ranks."""
    own = by.replace("query_id", "query_id // 1000")
    named = by.replace("query_id", "query_id // 1000 AS query_id")
    first = f"SELECT {named}, query_id % 1000 AS part, item_id, score, rank AS place FROM {hits} QUALIFY row_number() OVER (PARTITION BY {own}, item_id ORDER BY query_id % 1000, rank) = 1"
    return f"SELECT {by}, item_id, score, row_number() OVER (PARTITION BY {by} ORDER BY part, place)::INT AS rank, count(*) OVER (PARTITION BY {by}) AS size FROM ({first})"


#: After the hits of all sub-queries (h, 50 each): pl, the pool, and de, the 10 best of it by shared words.
_DECOMPOSED = f"""pl AS MATERIALIZED ({pooled_sql('h')}), {_OVER.replace("o AS (", "ol AS (").replace("FROM h JOIN", "FROM pl h JOIN").replace("h.item_id, round", "h.item_id, size, round")},
de AS (SELECT query_id, item_id, score, rank FROM pl WHERE size <= 10 UNION ALL SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM ol WHERE size > 10 QUALIFY rank <= 10)"""


@query(_BM25.replace("FROM benchmark", f"FROM ({_SUB})").replace("QUALIFY rank <= 10", "QUALIFY rank <= 50") + f", {_DECOMPOSED} SELECT query_id, item_id, score, rank FROM de")
def st_decomp(spark: SparkSession, d: str) -> DataFrame:
    return strategies.get("decomposition")(*_asked(spark, d), 10)


@query("""WITH e AS (SELECT n_nationkey::BIGINT AS src, -n_regionkey::BIGINT - 1 AS dst FROM nation), a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), g AS (SELECT src AS id, count(*) AS degree FROM a GROUP BY src),
p AS (SELECT DISTINCT src AS start, src AS id FROM e UNION SELECT e.src, dst FROM e UNION SELECT e.src, b.src FROM e JOIN e b ON b.dst = e.dst),
h AS (SELECT start AS query_id, s_suppkey AS item_id, max(x.degree + y.degree)::BIGINT AS score FROM p JOIN g x ON x.id = p.start JOIN g y ON y.id = p.id JOIN supplier ON s_nationkey = p.id GROUP BY ALL)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM h QUALIFY rank <= 10""")
def st_graph(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (-F.col("n_regionkey").cast("long") - 1).alias("dst"))
    named = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("item_id"))
    return strategies.get("graph")(e.select(F.col("src").alias("query_id"), F.col("src").alias("id")), e, named, 10)


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(themes|overall|summarize|compare|across|main|overview)\b') THEN 'global' ELSE 'local' END AS scope FROM conversations WHERE role = 'user'")
def g_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", strategies.scope(F.col("text")).alias("scope"))
