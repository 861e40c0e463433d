"""Queries of the search, fusion, index and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.functions import keys, structured
from corpusgraph.operators import evaluation, search
from corpusgraph.operators.vector_index import VectorIndex
from corpusgraph.plans.registry import query
from corpusgraph.plans.scratch import Scratch
from corpusgraph.plans.session import table

_DOT = "list_sum(list_transform(list_zip(%s, %s), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"round({_DOT % ('q.embedding', 'e.embedding')} / (sqrt({_DOT % ('q.embedding', 'q.embedding')}) * sqrt({_DOT % ('e.embedding', 'e.embedding')})), 6)"
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(%s, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM25 = rf"""WITH w AS (SELECT doc_id AS item_id, {_TOKENS % 'text'} AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS % 'text'})) AS term FROM benchmark),
p AS (SELECT item_id, dl, term, count(*) AS tf FROM (SELECT item_id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s QUALIFY rank <= 10)
"""
_VECTOR = f"""SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(queries, table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), 10)


def _vector(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.vector_search(queries, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), k)


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passage and document that holds it."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return search.containing(bench, docs)


@query(_BM25 + "SELECT query_id, item_id, score, rank FROM h")
def kw_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


_MEANS = "SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label"


@query(f"SELECT vec_id, label, round({_DOT % ('embedding', 'v')} / (sqrt({_DOT % ('embedding', 'embedding')}) * sqrt({_DOT % ('v', 'v')})), 6) AS score FROM embeddings JOIN ({_MEANS}) USING (label)")
def vec_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector and the mean of its label's vectors."""
    e = table(spark, d, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v"))
    return e.join(means, "label").select("vec_id", "label", F.round(search.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


@query(f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM ({_VECTOR}) QUALIFY rank <= 10")
def vec_search(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d)


def _index(spark: SparkSession, d: str) -> tuple[VectorIndex, DataFrame]:
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return VectorIndex.build(items, Scratch(spark, "index").path("vectors")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM ({_VECTOR}) QUALIFY rank <= 10")
def vec_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The exact mode of the stored index: lists are visited by bounds."""
    index, queries = _index(spark, d)
    return index.exact(queries, 10)


@query()
def vec_index(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the stored index; which items are found depends on the fitted model, so tests measure recall."""
    index, queries = _index(spark, d)
    return index.search(queries, 10)


@query(f"WITH h AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM ({_VECTOR}) QUALIFY rank <= 10) SELECT * FROM h WHERE score >= 0.3")
def vec_entities(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d).where("score >= 0.3")


_OVER = rf"""o AS (SELECT b.item_id AS query_id, h.item_id, round(len(list_intersect(list_distinct({_TOKENS % 'b.text'}), {_TOKENS % 'd.text'}))::DOUBLE / greatest(len(list_distinct({_TOKENS % 'b.text'})), 1), 6) AS score
  FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.item_id)"""


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d).select("query_id", "item_id")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return docs.join(hits, "item_id").join(bench, "query_id").select("query_id", "item_id", search.overlap_score(F.col("query"), F.col("text")).alias("score"))


@query(_BM25 + f", {_OVER} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM o QUALIFY rank <= 5")
def rr_cross(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(_overlap(spark, d), 5)


@query(_BM25 + f""", {_OVER}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS after_rank FROM o)
SELECT query_id, item_id, h.rank AS before_rank, a.after_rank, h.score AS before_score, a.score AS after_score FROM h JOIN a USING (query_id, item_id)""")
def jn_rerank(spark: SparkSession, d: str) -> DataFrame:
    before = _bm25(spark, d).select("query_id", "item_id", F.col("rank").alias("before_rank"), F.col("score").alias("before_score"))
    after = search.top_k(_overlap(spark, d), 10).select("query_id", "item_id", F.col("rank").alias("after_rank"), F.col("score").alias("after_score"))
    return before.join(after, ["query_id", "item_id"])


_NORM = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END"


@query(_BM25 + f""", {_OVER}, x AS (SELECT query_id, item_id, {_NORM} AS d FROM o WINDOW w AS (PARTITION BY query_id)), y AS (SELECT query_id, item_id, {_NORM} AS k FROM h WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, item_id, round(0.5::DOUBLE * coalesce(d, 0) + 0.5::DOUBLE * coalesce(k, 0), 6) AS score FROM x FULL JOIN y USING (query_id, item_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM m QUALIFY rank <= 5""")
def hyb_search(spark: SparkSession, d: str) -> DataFrame:
    return search.relative_fusion(_overlap(spark, d), _bm25(spark, d), 0.5, 5)


@query(_BM25 + f""", {_OVER}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, 'overlap' AS list FROM o UNION ALL SELECT query_id, item_id, rank, 'bm25' FROM h),
m AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(DISTINCT list, ',' ORDER BY list) AS contributions FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM m QUALIFY rank <= 10""")
def fus_rrf(spark: SparkSession, d: str) -> DataFrame:
    a = search.top_k(_overlap(spark, d), 10).select("query_id", "item_id", "rank", F.lit("overlap").alias("list"))
    b = _bm25(spark, d).select("query_id", "item_id", "rank", F.lit("bm25").alias("list"))
    return search.reciprocal_rank_fusion(a.unionAll(b))


_REL = "rel AS (SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(_BM25 + f""", {_REL}, m AS (SELECT query_id, count(*) AS n, count(rank) AS got, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM rel LEFT JOIN h USING (query_id, item_id) GROUP BY query_id)
SELECT query_id, (got > 0)::INT AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
round(got / 10.0::DOUBLE, 6) AS precision, round(got::DOUBLE / n, 6) AS recall FROM m""")
def ev_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_metrics(_bm25(spark, d), _relevant(spark, d), 10)


@query(f"WITH {_REL} SELECT query_id, item_id FROM rel")
def ev_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _relevant(spark, d)


@query("SELECT doc_id, u[1:8] || '-' || u[9:12] || '-5' || u[14:16] || '-' || translate(u[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || u[18:20] || '-' || u[21:32] AS uuid FROM (SELECT doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '::chunk_' || doc_id)) AS u FROM documents)")
def idx_uuid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.uuid5(F.concat("source", F.lit("::chunk_"), "doc_id")).alias("uuid"))


@query("SELECT count(*) AS n FROM documents")
def idx_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source AS book_id FROM documents")
def idx_books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("book_id")).distinct()


@query(r"""WITH c AS (SELECT s, 'RAG_' || replace(s, '.', '_') || '_embed3large_v1' AS name FROM (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'semantic_std' || (doc_id % 7) WHEN 2 THEN 'semantic_0.' || (doc_id % 9) ELSE lang END AS s FROM documents))
SELECT s AS strategy, name, CASE WHEN regexp_matches(name, '^RAG_semantic_std\d+_') THEN regexp_extract(name, '^RAG_(semantic_std\d+)_', 1) WHEN regexp_matches(name, '^RAG_semantic_\d+_\d+_') THEN 'semantic_' || replace(regexp_extract(name, '^RAG_semantic_(\d+_\d+)_', 1), '_', '.') ELSE string_split(name[5:], '_')[1] END AS parsed FROM c""")
def idx_list(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = F.when(i % 4 == 0, F.col("source")).when(i % 4 == 1, F.concat(F.lit("semantic_std"), (i % 7))).when(i % 4 == 2, F.concat(F.lit("semantic_0."), (i % 9))).otherwise(F.col("lang"))
    names = table(spark, d, "documents").select(s.alias("strategy")).distinct().withColumn("name", keys.collection_name(F.col("strategy")))
    return names.withColumn("parsed", keys.strategy_of(F.col("name")))


@query("""SELECT * FROM (SELECT s.strategy, c.collection, a.alpha, r.reranking, CASE WHEN (s.strategy = 'graph') <> (c.collection = 'graph_chunks') THEN 'collection' WHEN s.strategy <> 'none' AND a.alpha <> 1 THEN 'alpha'
WHEN s.strategy = 'decomposition' AND NOT r.reranking OR s.strategy = 'graph' AND r.reranking THEN 'reranking' ELSE '' END AS fault
FROM (VALUES ('none'), ('hyde'), ('decomposition'), ('graph')) s(strategy), (VALUES ('section'), ('semantic_std2'), ('semantic_std3'), ('contextual'), ('raptor'), ('graph_chunks')) c(collection), (VALUES (0.0::DOUBLE), (0.5), (1.0)) a(alpha), (VALUES (true), (false)) r(reranking))""")
def cfg_validate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.grid(spark)


@query("SELECT * FROM (VALUES ('none', 30), ('hyde', 10), ('decomposition', 5), ('graph', 1)) t(strategy, combinations)")
def jn_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.grid(spark).where("fault = ''").groupBy("strategy").agg(F.count("*").cast("int").alias("combinations"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


_FACTORS = "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS factor, coalesce(lang, source) AS level, round(avg(quality), 6) AS mean, round(coalesce(stddev_samp(quality), 0), 6) AS deviation, min(quality) AS low, max(quality) AS high, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))"


@query(_FACTORS)
def agg_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.factor_stats(_scored(spark, d), ["lang", "source"], "quality")


@query("""WITH b AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)), v AS (SELECT var_samp(quality) AS a FROM b)
SELECT 'lang' AS factor, round(CASE WHEN a > 0 THEN coalesce((SELECT var_samp(m) FROM (SELECT avg(quality) AS m FROM b GROUP BY lang)) / a, 0) ELSE 0 END, 6) AS effect FROM v
UNION ALL SELECT 'source', round(CASE WHEN a > 0 THEN coalesce((SELECT var_samp(m) FROM (SELECT avg(quality) AS m FROM b GROUP BY source)) / a, 0) ELSE 0 END, 6) FROM v""")
def agg_eta(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    return evaluation.effect_size(rows, "lang", "quality").unionAll(evaluation.effect_size(rows, "source", "quality"))


@query("SELECT source, round(avg(quality) FILTER (lang = 'en'), 6) AS en, round(avg(quality) FILTER (lang = 'fr'), 6) AS fr, round(avg(quality) FILTER (lang = 'de'), 6) AS de, round(avg(quality) FILTER (lang = 'es'), 6) AS es FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg_interact(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.round(F.avg("quality"), 6))


@query("""WITH r AS (SELECT (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0) AS a, (rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0) AS b FROM documents JOIN labels USING (doc_id))
SELECT round(corr(a, b), 6) AS rho FROM r""")
def agg_spearman(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spearman(_scored(spark, d), "n_chars", "quality")


@query("SELECT source, round(avg(quality), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY score DESC, source LIMIT 3")
def agg_best(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("source").agg(F.round(F.avg("quality"), 6).alias("score")).orderBy(F.desc("score"), "source").limit(3)


_VALID = "CASE WHEN try_cast(%s AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(%s AS DOUBLE)) THEN try_cast(%s AS DOUBLE) END"
_SCORE = "CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'NaN' WHEN lang = 'es' THEN NULL ELSE quality::VARCHAR END"


@query(f"""SELECT coalesce(lang, 'unknown') AS difficulty, coalesce(round(avg({_VALID.replace('%s', 's')}), 4), 0) AS quality, coalesce(round(avg(toxic), 4), 0) AS toxic, count(*) AS n
FROM (SELECT lang, toxic, {_SCORE} AS s FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def agg_difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Means by language; some scores are no numbers, and one language has none."""
    i = F.col("doc_id")
    score = F.when(i % 5 == 0, "none").when(i % 7 == 0, "NaN").when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("quality").cast("string"))
    return evaluation.difficulty(_scored(spark, d).withColumn("quality", score), "lang", ["quality", "toxic"])


@query("WITH m AS (SELECT lang, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY lang), b AS (SELECT q AS base FROM m WHERE lang = 'en') SELECT lang, round(CASE WHEN base > 0 THEN (q - base) / base * 100 ELSE 0 END, 6) AS percent FROM m, b")
def agg_improve(spark: SparkSession, d: str) -> DataFrame:
    m = _scored(spark, d).groupBy("lang").agg(F.avg("quality").alias("q"))
    base = m.where("lang = 'en'").select(F.col("q").alias("base"))
    return m.join(base).select("lang", F.round(F.when(F.col("base") > 0, (F.col("q") - F.col("base")) / F.col("base") * 100).otherwise(0.0), 6).alias("percent"))


@query("SELECT d.doc_id, lang FROM documents d ANTI JOIN labels USING (doc_id)")
def jn_resume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, n_chars FROM documents SEMI JOIN labels USING (doc_id)")
def jn_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src5') ")
def flt_books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("source").isin("src1", "src5")).select("doc_id", "source", "n_chars")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 3")
def flt_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 3")


@query("SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(table(spark, d, "documents").select("doc_id", "source", "n_chars"), 3, "source", "doc_id", "n_chars")


@query("SELECT vec_id, label, fold FROM (SELECT vec_id, label, (floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / greatest(1, floor(count(*) OVER (PARTITION BY label) / 4))))::BIGINT AS fold FROM embeddings)")
def win_fold(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("label")
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 4))
    return table(spark, d, "embeddings").select("vec_id", "label", F.floor((F.row_number().over(w.orderBy("vec_id")) - 1) / size).cast("long").alias("fold"))


_CITE = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND 9)))"


@query(f"SELECT conv_id, turn, array_to_string({_CITE}, ',') AS cited FROM (SELECT conv_id, turn, text || ' [' || (turn % 12) || '] [' || (conv_id % 9) || '] [2]' AS text FROM conversations)")
def llm_cite(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" ["), F.col("turn") % 12, F.lit("] ["), F.col("conv_id") % 9, F.lit("] [2]"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(keys.citations(text, F.lit(9)), ",").alias("cited"))


@query(r"SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || role || ':' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def llm_context(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("["), F.col("turn") + 1, F.lit("] "), "role", F.lit(":\n"), "text")
    parts = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n---\n").alias("context"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k FROM events")
def api_struct(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.from_json(keys.strip_fences(fenced), "k int").getField("k").alias("k"))


_K = "(json_extract_string(props, '$.k'))::BIGINT"


@query(f"""SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2, 3, 7) THEN {_K} END AS k,
CASE event_id % 8 WHEN 4 THEN '$.k: integer expected, not string' WHEN 5 THEN '$.k: missing' WHEN 6 THEN 'not an object' ELSE '' END AS fault FROM events""")
def api_repair(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are fenced, cut, with a comma too much, of a wrong type, without a key, missing, or amid prose: repaired or told what is wrong."""
    i, k = F.col("event_id") % 8, F.get_json_object("props", "$.k")
    text = (
        F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 1, F.concat(F.lit('{"k": '), k, F.lit(', "why": "it was cut he')))
        .when(i == 2, F.concat(F.lit('{"list": [1, 2,], "k": '), k, F.lit(",}"))).when(i == 3, F.concat(F.lit('Sure! Here: {"a": {"b": [{"c": "x, ]"}]}, "k": '), k, F.lit("} Hope it helps.")))
        .when(i == 4, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(i == 5, F.lit('{"other": 1}')).when(i == 6, F.lit("I can't say.")).otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "more')))
    )
    rows = table(spark, d, "events").select("event_id", structured.checked(text, {"k": "integer"}).alias("x"))
    return rows.select("event_id", F.try_variant_get("x.value", "$.k", "bigint").alias("k"), "x.fault")


@query("SELECT event_type, count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS valid, round(avg(value) FILTER (NOT isnan(value)), 6) AS mean FROM events GROUP BY event_type")
def flt_valid(spark: SparkSession, d: str) -> DataFrame:
    ok = keys.valid_score(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(ok).alias("valid"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean"))
