"""Queries of model plug-ins, prompts, answers and the search service, with vectors of texts from the hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import late, models, search, strategies
from corpusgraph.plans.registry import query
from corpusgraph.plans.scratch import Scratch
from corpusgraph.plans.search_queries import _BM25, _DOT, _OVER, _TOKENS, _bm25
from corpusgraph.plans.session import table
from corpusgraph.plans.strategy_queries import _SUB, _asked
from corpusgraph.plans.text_queries import _SENTENCES

_LIT = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def vector_sql(text: str) -> str:
    """The hashing embedder's vector of an SQL text."""
    return rf"list_transform(range(0, {models.DIMS}), lambda i: len(list_filter(list_transform({_TOKENS % text}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {models.DIMS}), lambda b: b = i))::DOUBLE)"


def dense_sql(queries: str, items: str, k: int, by: str = "query_id") -> str:
    """Vector hits (query_id, item_id, score, rank) of queries (query_id, v) among items (item_id, v)."""
    cos = f"round({_DOT % ('q.v', 'e.v')} / CASE WHEN sqrt({_DOT % ('q.v', 'q.v')}) * sqrt({_DOT % ('e.v', 'e.v')}) = 0 THEN 1 ELSE sqrt({_DOT % ('q.v', 'q.v')}) * sqrt({_DOT % ('e.v', 'e.v')}) END, 6)"
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT q.* EXCLUDE (v), e.* EXCLUDE (v), {cos} AS score FROM {queries} q, {items} e) QUALIFY rank <= {k}"


_Q = f"SELECT item_id AS query_id, {vector_sql('text')} AS v FROM benchmark"
_E = f"SELECT doc_id AS item_id, {vector_sql('text')} AS v FROM documents"
_V = f"ev AS MATERIALIZED ({_E}), qv AS MATERIALIZED ({_Q})"
_NORM = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END"


def fused_sql(dense: str, keyword: str, alpha: float, k: int, by: str = "query_id") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT {by}, item_id, round({alpha}::DOUBLE * coalesce(d, 0) + {1 - alpha}::DOUBLE * coalesce(k, 0), 6) AS score
FROM (SELECT {by}, item_id, {_NORM} AS d FROM {dense} WINDOW w AS (PARTITION BY {by})) FULL JOIN (SELECT {by}, item_id, {_NORM} AS k FROM {keyword} WINDOW w AS (PARTITION BY {by})) USING ({by}, item_id)) QUALIFY rank <= {k}"""


def _hits(n: int) -> str:
    return _BM25.replace("QUALIFY rank <= 10", f"QUALIFY rank <= {n}")


def overlap_sql(hits: str) -> str:
    return _OVER.replace("FROM h JOIN", f"FROM {hits} h JOIN").removeprefix("o AS (").removesuffix(")")


def small_kept_sql(hits: str, scored: str, k: int) -> str:
    """The k best by new scores; the hits as they are of queries that have no more than k."""
    many = f"query_id IN (SELECT query_id FROM {hits} GROUP BY query_id HAVING count(*) > {k})"
    return f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM {scored} WHERE {many} QUALIFY rank <= {k} UNION ALL SELECT query_id, item_id, score, rank FROM {hits} WHERE NOT {many}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Passages (query_id, query, query_vector) and documents (item_id, text, vector)."""
    queries, items = _asked(spark, d)
    return models.embed(queries, text="query", into="query_vector"), models.embed(items)


def _told(vector: str | Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",")


@query(f"SELECT doc_id, array_to_string(list_transform({vector_sql('text')}, lambda x: x::INT), ',') AS vector FROM documents")
def api_embed(spark: SparkSession, d: str) -> DataFrame:
    return models.embed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", _told("vector").alias("vector"))


@query(f"SELECT doc_id, lang, n_chars, array_to_string(list_transform({vector_sql('text')}, lambda x: x::INT), ',') AS vector, 'hashed16' AS embedding_model, 16 AS embedding_dim FROM documents")
def snk_embed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with all their fields, their vectors, the embedder's name and its dimension, written and read again."""
    at = Scratch(spark, "embedded").path("table")
    made = models.embed(table(spark, d, "documents").drop("source"), models.HashedEmbedder(), into="embedding")
    made.withColumns({"embedding_model": F.lit("hashed16"), "embedding_dim": F.size("embedding")}).write.parquet(at)
    return spark.read.parquet(at).select("doc_id", "lang", "n_chars", _told("embedding").alias("vector"), "embedding_model", "embedding_dim")


@query("SELECT * FROM (VALUES ('empty', false, 'missing'), ('mock', false, 'placeholder'), ('session', true, NULL), ('set', true, NULL)) t(service, alive, fault)")
def api_conn(spark: SparkSession, d: str) -> DataFrame:
    return models.connections(spark, {"empty": " ", "mock": "your-key-here", "set": "k-123"})


@query("SELECT conv_id, turn, CASE WHEN conv_id % 5 = 3 THEN NULL ELSE string_split(text, chr(10))[1] END AS answer, CASE WHEN conv_id % 5 <> 3 THEN 1 + (conv_id % 5 = 2)::INT END AS tries, CASE WHEN conv_id % 5 = 3 THEN 'refused' END AS error FROM conversations")
def api_chat(spark: SparkSession, d: str) -> DataFrame:
    """A chat plug-in that gives the first line of a prompt, fails once in a way that passes on some prompts, and refuses others."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("\u0001", F.col("conv_id") % 5, F.monotonically_increasing_id(), "text").alias("prompt"))
    done = models.complete(c, _Moody(), batch=1, factor=0.1)
    return done.select("conv_id", "turn", "answer.text", "answer.tries", "answer.error").withColumnRenamed("text", "answer")


class _Moody:
    def __init__(self) -> None:
        self.failed: set[str] = set()

    def complete(self, prompts: list[str]) -> list[str | None]:
        mood, call, *text = prompts[0].split("\u0001", 2)
        if mood == "3":
            raise models.ModelError("refused")
        if mood == "2" and call not in self.failed:
            self.failed.add(call)
            raise models.ModelError("429: rate limit")
        self.failed.discard(call)
        return models.FirstLine().complete(text) if text else [None]


def _prompt_sql(name: str, **values: str) -> str:
    out = _LIT(models.PROMPTS[name])
    for mark, sql in values.items():
        out = out.replace("{" + mark + "}", f"' || {sql} || '")
    return out


@query(f"SELECT item_id, 'answer' AS name, {_prompt_sql('answer', query='text', context=chr(39) + '[1] {query}' + chr(39))} AS prompt FROM benchmark UNION ALL SELECT item_id, 'hyde', {_prompt_sql('hyde', domain=chr(39) + 'x' + chr(39), query='text')} FROM benchmark")
def llm_prompts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("t"))
    a = b.select("item_id", F.lit("answer").alias("name"), models.render("answer", query=F.col("t"), context=F.lit("[1] {query}")).alias("prompt"))
    return a.unionAll(b.select("item_id", F.lit("hyde"), models.render("hyde", query=F.col("t"), domain=F.lit("x"))))


_DOMAIN = f"CASE WHEN nth < 2 THEN {_LIT(models.DOMAINS[0])} ELSE {_LIT(models.DOMAINS[1])} END"
_HYPO = f"SELECT item_id AS query_id, nth, {_DOMAIN} AS domain, 'On ' || {_DOMAIN} || ': ' || text AS passage FROM (SELECT item_id, text, unnest([0, 1, 2, 3]) AS nth FROM benchmark)"


@query(_HYPO)
def llm_hyde(spark: SparkSession, d: str) -> DataFrame:
    return models.hypothetical(_asked(spark, d)[0])


@query(f"SELECT item_id // 1000 AS query_id, (item_id % 1000)::INT AS part, text AS query FROM ({_SUB})")
def llm_decompose(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d)[0].select("query_id", F.posexplode(strategies.sub_queries(F.col("query"))).alias("part", "query"))


@query(_hits(3) + rf""", c AS (SELECT query_id, rank, list_distinct({_TOKENS % 'b.text'}) AS w, {_SENTENCES.replace("coalesce(text", "coalesce(d.text")} AS s FROM h JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = h.item_id WHERE query_id % 3 <> 0),
x AS (SELECT query_id, rank, w, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM c),
y AS (SELECT *, len(list_intersect(w, {_TOKENS % 'sentence'})) AS shared FROM x), z AS (SELECT query_id, rank, arg_max(sentence, (shared, -pos)) AS sentence FROM y WHERE shared > 0 GROUP BY ALL),
t AS (SELECT query_id, string_agg(sentence || ' [' || rank || ']', ' ' ORDER BY rank) AS answer, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS sources FROM z GROUP BY query_id)
SELECT b.item_id AS query_id, coalesce(answer, {_LIT(models.NO_CONTEXT)}) AS answer, coalesce(sources, '') AS sources FROM benchmark b LEFT JOIN t ON t.query_id = b.item_id""")
def llm_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers to all passages as questions; every third has no hits."""
    queries, items = _asked(spark, d)
    return models.answer(queries, search.bm25(queries, items, 3).where("query_id % 3 <> 0"), items)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(1 - value / 1000, 6) WHEN event_id % 3 = 1 THEN round(value, 6) ELSE 0 END AS score, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS section, 0 AS tree_level, false AS is_summary FROM events")
def hit_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    raw = table(spark, d, "events").select("event_id", F.when(i % 3 == 0, F.col("value") / 1000).alias("distance"), F.when(i % 3 != 2, F.col("value")).alias("score"), F.when(i % 2 == 0, F.col("event_type")).alias("section"))
    return search.parsed_hits(raw).select("event_id", F.round("score", 6).alias("score"), "section", "tree_level", "is_summary")


@query(f"WITH {_V} SELECT query_id, item_id, score, rank FROM ({dense_sql('qv', 'ev', 5)})")
def jn_vector(spark: SparkSession, d: str) -> DataFrame:
    """Every passage's nearest documents by vectors of their texts."""
    return search.vector_search(*_vectors(spark, d), 5)


def _dense(k: int) -> str:
    return dense_sql("qv", "ev", k)


@query(_hits(10) + f""", {_V}, x AS ({_dense(10)}), fu AS ({fused_sql('x', 'h', 0.25, 10)})
SELECT 'hybrid' AS kind, query_id, item_id, score, rank FROM fu UNION ALL SELECT 'vector', query_id, item_id, score, rank FROM x UNION ALL SELECT 'keyword', query_id, item_id, score, rank FROM h""")
def hyb_dispatch(spark: SparkSession, d: str) -> DataFrame:
    queries, items = _vectors(spark, d)
    out = [strategies.execute_search(queries, items, 10, kind, 0.25).select(F.lit(kind).alias("kind"), "query_id", "item_id", "score", "rank") for kind in ("hybrid", "vector", "keyword")]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(_hits(10) + f""", o AS ({overlap_sql('h')}), r AS ({small_kept_sql('h', 'o', 4)})
SELECT true AS enabled, query_id, item_id, score, rank FROM r UNION ALL SELECT false, query_id, item_id, score, rank FROM h""")
def rr_apply(spark: SparkSession, d: str) -> DataFrame:
    queries, items = _asked(spark, d)
    hits = _bm25(spark, d)
    out = [strategies.reranked(hits, queries, items, 4, on).select(F.lit(on).alias("enabled"), "query_id", "item_id", "score", "rank") for on in (True, False)]
    return out[0].unionAll(out[1])


@query(_hits(10) + f", o AS ({overlap_sql('h')}) {small_kept_sql('h', 'o', 3)}")
def top_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The three best of each query's hits by a new score; ties go to the smaller id."""
    queries, items = _asked(spark, d)
    return strategies.reranked(_bm25(spark, d), queries, items, 3)


_GRAMS = "list_distinct(list_transform(range(1, greatest(1, length(%s)) + 1), lambda i: substr('^' || %s || '$', i, 3)))"


@query(_hits(10) + f""", qw AS MATERIALIZED (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS % 'text'})) AS u FROM benchmark),
dw AS MATERIALIZED (SELECT item_id, unnest(list_distinct({_TOKENS % 'text'})) AS v FROM (SELECT doc_id AS item_id, text FROM documents WHERE doc_id IN (SELECT item_id FROM h))),
dc AS (SELECT v AS u, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS % 'text'})) AS v FROM documents) WHERE v IN (SELECT u FROM qw) GROUP BY v),
qi AS MATERIALIZED (SELECT query_id, u, ln(1 + ((SELECT count(*) FROM documents) - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM qw LEFT JOIN dc USING (u)),
gu AS (SELECT u, g, unnest(g) AS t FROM (SELECT DISTINCT u, {_GRAMS % ('u', 'u')} AS g FROM qw)), gv AS (SELECT v, g, unnest(g) AS t FROM (SELECT DISTINCT v, {_GRAMS % ('v', 'v')} AS g FROM dw)),
si AS MATERIALIZED (SELECT u, v, count(*) / sqrt(any_value(len(gu.g)) * any_value(len(gv.g))::DOUBLE) AS sim FROM gu JOIN gv USING (t) GROUP BY u, v),
be AS (SELECT query_id, item_id, u, max(sim) AS best FROM h JOIN qw USING (query_id) JOIN si USING (u) JOIN dw ON dw.item_id = h.item_id AND dw.v = si.v GROUP BY ALL),
o AS (SELECT h.query_id, h.item_id, round(sum(idf * coalesce(best, 0)) / sum(idf), 6) AS score FROM h JOIN qi USING (query_id) LEFT JOIN be ON be.query_id = h.query_id AND be.item_id = h.item_id AND be.u = qi.u GROUP BY ALL) {small_kept_sql('h', 'o', 5)}""".replace("be AS (SELECT query_id, item_id, u, max(sim)", "be AS (SELECT h.query_id, h.item_id, u, max(sim)"))
def rr_late(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each query's hits by late interaction."""
    queries, items = _asked(spark, d)
    index = search.index_for(queries, items)
    return late.reranked(index.search(queries, 10), queries, items, 5, index)


_EV = "ev AS MATERIALIZED (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings), qe AS MATERIALIZED (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"""WITH {_EV}, x AS ({dense_sql('qe', 'ev', 4)}),
m AS MATERIALIZED (SELECT query_id, list(m ORDER BY i) AS v FROM (SELECT query_id, i, avg(x) AS m FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT query_id, v FROM qe UNION ALL SELECT query_id, ev.v FROM x JOIN ev USING (item_id))) GROUP BY ALL) GROUP BY query_id)
SELECT query_id, item_id, score, rank FROM ({dense_sql('m', 'ev', 10)})""")
def st_hyde(spark: SparkSession, d: str) -> DataFrame:
    """The query's vector averaged with those of its best hits, which stand for written passages."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return strategies.get("hyde")(queries, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 10)


_MEAN = f"""SELECT query_id, list(m ORDER BY i) AS v FROM (SELECT query_id, i, avg(x) AS m FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT query_id, v FROM qv UNION ALL SELECT query_id, {vector_sql('passage')} FROM ({_HYPO}))) GROUP BY ALL) GROUP BY query_id"""
_HYDE = f"m AS MATERIALIZED ({_MEAN}), x AS ({dense_sql('m', 'ev', 50)})"


@query(f"WITH {_V}, {_HYDE}, o AS ({overlap_sql('x')}) {small_kept_sql('x', 'o', 10)}")
def hyde_search(spark: SparkSession, d: str) -> DataFrame:
    """Hypothetical passages' vectors averaged with the query's, the first hits reranked."""
    queries, items = _asked(spark, d)
    chunks = _chunk_rows(items)
    found = strategies.search_chunks(queries, chunks, 10, rerank=True, name="hyde")
    return found.select("query_id", F.col("chunk_id").alias("item_id"), F.col("similarity").alias("score"), "rank")


def _chunk_rows(items: DataFrame) -> DataFrame:
    return models.embed(items).select(F.col("item_id").alias("chunk_id"), F.lit("b").alias("book_id"), F.lit("s").alias("section"), "text", "vector")


@query(_hits(50) + f""", {_V}, x AS ({_dense(50)}), fu AS ({fused_sql('x', 'h', 0.5, 50)}), o AS ({overlap_sql('fu')}),
r AS ({small_kept_sql('fu', 'o', 10)})
SELECT query_id, rank, item_id AS chunk_id, source AS book_id, lang AS section, md5(coalesce(text, '')) AS text, score AS similarity FROM r JOIN documents ON doc_id = item_id""")
def svc_search(spark: SparkSession, d: str) -> DataFrame:
    """The search service: hybrid, 50 hits first, reranked to 10."""
    docs = table(spark, d, "documents")
    chunks = models.embed(docs).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book_id"), F.col("lang").alias("section"), "text", "vector")
    found = strategies.search_chunks(_asked(spark, d)[0], chunks, 10, "hybrid", 0.5, rerank=True)
    return found.withColumn("text", F.md5(F.coalesce("text", F.lit(""))))


@query(f"""WITH m AS (SELECT source, list(DISTINCT lang ORDER BY lang) AS t, list(struct_pack(i := doc_id, name := 'd' || doc_id, description := CASE WHEN doc_id % 2 = 0 THEN left(text, 40) END) ORDER BY doc_id) AS e FROM documents GROUP BY source),
x AS (SELECT source, '## Relevant Themes (from document corpus)' || chr(10) || array_to_string(list_transform(t[1:2], lambda x: chr(10) || x), chr(10)) || chr(10) || chr(10) || '## Related Concepts (from knowledge graph)' || chr(10) ||
array_to_string(list_transform(e[1:10], lambda x: '- ' || x.name || CASE WHEN coalesce(x.description, '') = '' THEN ' (concept)' ELSE ': ' || x.description END), chr(10)) AS w FROM m)
SELECT source, CASE WHEN length(w) > 300 THEN left(w, 300) || {_LIT(models.CUT)} ELSE w END AS background FROM x""")
def g_format(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    entity = F.struct(i.alias("i"), F.concat(F.lit("d"), i).alias("name"), F.lit(None).cast("string").alias("entity_type"), F.when(i % 2 == 0, F.left("text", F.lit(40))).alias("description"))
    rows = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("t"), F.array_sort(F.collect_list(entity)).alias("e"))
    return rows.select("source", models.graph_background(F.col("t"), F.col("e"), 300).alias("background"))


@query("SELECT * FROM (VALUES ('decomposition'), ('graph'), ('hyde'), ('none')) t(strategy)")
def st_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(strategies.REGISTRY) if strategies.get(n)], "strategy string")
