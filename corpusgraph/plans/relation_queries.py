"""Queries of joins, merges and aggregates over the property graph, and of the evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import evaluation, graph, search, sequences
from corpusgraph.plans.graph_queries import _DEGREE, _MENTIONS, _NORM, edges, mentions, vertices
from corpusgraph.plans.registry import query
from corpusgraph.plans.session import table

_TYPE = "'T' || (length(name) % 9)"
_NODES = "SELECT s_suppkey AS id, s_nationkey::BIGINT AS community, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS pagerank, s_name AS name FROM supplier"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    rows = mentions(spark, d).withColumn("entity_type", F.concat(F.lit("T"), F.length("name") % 9))
    return rows.withColumn("normalized_name", graph.normalised_name(F.col("name")))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("pagerank")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("community"), rank, F.col("s_name").alias("name"))


#: Suppliers that deliver one after the other in an order.
_LINKS = """SELECT a.l_suppkey AS src, b.l_suppkey AS dst, CASE WHEN a.l_linenumber % 2 = 0 THEN a.l_returnflag END AS type, CASE WHEN a.l_discount > 0.02 THEN a.l_discount END AS weight
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("src"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("type"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("weight"))
    return a.join(li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dst")), ["l_orderkey", "l_linenumber"]).select("src", "dst", "type", "weight")


@query(f"SELECT source_id, min(seq) AS seq, normalized_name, entity_type FROM (SELECT *, {_NORM} AS normalized_name, {_TYPE} AS entity_type FROM ({_MENTIONS})) GROUP BY source_id, normalized_name, entity_type")
def agg_dedup_ent(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences.keep_first(_typed(spark, d), [F.col("source_id"), F.col("normalized_name"), F.lower("entity_type")], "seq")
    return rows.select("source_id", "seq", "normalized_name", "entity_type")


@query("SELECT l_orderkey, l_partkey, l_suppkey, lower(l_returnflag) AS type, min(l_linenumber) AS line FROM lineitem GROUP BY ALL")
def agg_dedup_rel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.lower("l_returnflag").alias("type"), F.col("l_linenumber").alias("line"))
    return sequences.keep_first(rows, [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "type")], "line")


@query("SELECT source, string_agg('- ' || lang, chr(10) ORDER BY lang) AS description FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def agg_desc(spark: SparkSession, d: str) -> DataFrame:
    bullets = F.transform(F.array_sort(F.collect_set("lang")), lambda x: F.concat(F.lit("- "), x))
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(bullets, "\n").alias("description"))


@query(f"WITH {_DEGREE} SELECT l_orderkey AS chunk, max(x.degree + y.degree)::BIGINT AS degree FROM lineitem JOIN g x ON x.id = l_partkey JOIN g y ON y.id = -l_suppkey - 1 GROUP BY 1")
def agg_chunkdeg(spark: SparkSession, d: str) -> DataFrame:
    degree = graph.degrees(vertices(spark, d), edges(spark, d))
    li = table(spark, d, "lineitem").select(F.array("l_orderkey").alias("chunks"), F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))
    return graph.chunk_degrees(li.join(degree.toDF("src", "start_degree"), "src").join(degree.toDF("dst", "degree"), "dst"))


@query(f"SELECT DISTINCT source_id FROM ({_MENTIONS}) WHERE {_NORM} <> ''")
def agg_chunkids(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("normalized_name <> ''").select("source_id").distinct()


@query("SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def agg_hydeavg(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT label, string_agg(vec_id, ',' ORDER BY vec_id) AS sources FROM embeddings GROUP BY label")
def agg_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("vec_id")), ",").alias("sources"))


@query("SELECT event_type, round(avg(CASE WHEN NOT isnan(value) THEN value END), 6) AS score FROM events GROUP BY event_type")
def agg_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.nanvl("value", F.lit(None).cast("double"))), 6).alias("score"))


@query("SELECT source, round(avg(coalesce(quality, 0)), 6) AS score, count(*) FILTER (coalesce(quality, 0) = 0) AS failures FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_category(spark: SparkSession, d: str) -> DataFrame:
    value = F.coalesce("quality", F.lit(0))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg(value), 6).alias("score"), F.count_if(value == 0).alias("failures"))


@query("SELECT source, round(avg(quality), 6) AS overall, round(avg(quality) FILTER (n_chars < 600), 6) AS single, round(avg(quality) FILTER (n_chars >= 600), 6) AS crossing, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def agg_corrected(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.corrected(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "source", "quality", F.col("n_chars") < 600)


@query("""SELECT source, gap, round(CASE WHEN single > 0 THEN gap / single * 100 ELSE 0 END, 6) AS percent FROM (SELECT source, single, round(single - crossing, 6) AS gap FROM
(SELECT source, round(avg(quality) FILTER (n_chars < 600), 6) AS single, round(avg(quality) FILTER (n_chars >= 600), 6) AS crossing FROM documents JOIN labels USING (doc_id) GROUP BY source)) WHERE gap IS NOT NULL ORDER BY abs(gap), source LIMIT 10""")
def agg_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return evaluation.gaps(evaluation.corrected(rows, "source", "quality", F.col("n_chars") < 600), "source", 10)


@query("SELECT 'lang' AS factor, lang AS level, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS deviation, min(n_chars) AS low, max(n_chars) AS high, count(*) AS n FROM documents GROUP BY lang")
def agg_factor(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.factor_stats(table(spark, d, "documents"), ["lang"], "n_chars")


@query("SELECT DISTINCT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 45)")
def jn_names(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), graph.normalised_name(F.col("s_name")).alias("normalized_name"))
    asked = table(spark, d, "lineitem").where("l_quantity >= 45").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.find_by_names(asked.select(F.concat(F.lit("The "), "s_name").alias("name")), known).select("id", "name")


@query("SELECT DISTINCT p_brand, s_nationkey AS community FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IS NOT NULL")
def jn_entcomm(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return li.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).where("s_nationkey IS NOT NULL").select("p_brand", F.col("s_nationkey").alias("community")).distinct()


@query("SELECT DISTINCT s_nationkey::BIGINT AS community FROM supplier WHERE s_nationkey IS NOT NULL")
def jn_commids(spark: SparkSession, d: str) -> DataFrame:
    return _suppliers(spark, d).where("community IS NOT NULL").select("community").distinct()


@query(f"WITH l AS ({_LINKS}), b AS (SELECT src AS id FROM l UNION ALL SELECT dst FROM l) SELECT n.id, community, coalesce(pagerank, 0) AS pagerank, (SELECT count(*) FROM b WHERE b.id = n.id)::BIGINT AS degree FROM ({_NODES}) n")
def jn_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.members_with_degree(_suppliers(spark, d), _links(spark, d)).select("id", "community", "pagerank", "degree")


@query(f"SELECT a.community, src, dst, coalesce(type, 'RELATED_TO') AS type, coalesce(weight, 1.0) AS weight FROM ({_LINKS}) JOIN ({_NODES}) a ON a.id = src JOIN ({_NODES}) b ON b.id = dst WHERE a.community = b.community")
def jn_intra(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_edges(_links(spark, d), _suppliers(spark, d))


@query(f"WITH t AS (SELECT id FROM ({_NODES}) ORDER BY coalesce(pagerank, 0) DESC, id LIMIT 20) SELECT src, dst FROM ({_LINKS}) WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)")
def jn_induced(spark: SparkSession, d: str) -> DataFrame:
    top = _suppliers(spark, d).orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), "id").limit(20)
    return graph.induced(_links(spark, d), top).select("src", "dst")


@query(f"WITH l AS ({_LINKS}), b AS (SELECT src AS id FROM l UNION ALL SELECT dst FROM l), n AS (SELECT n.*, (SELECT count(*) FROM b WHERE b.id = n.id) AS degree FROM ({_NODES}) n) SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY coalesce(pagerank, 0) DESC, degree DESC, id)::INT AS place FROM n QUALIFY place <= 2")
def sort_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_members(graph.members_with_degree(_suppliers(spark, d), _links(spark, d)), 2).select("community", "id", "place")


@query(f"WITH {_DEGREE}, c AS (SELECT l_orderkey AS item_id, max(x.degree + y.degree)::BIGINT AS score FROM lineitem JOIN g x ON x.id = l_partkey JOIN g y ON y.id = -l_suppkey - 1 GROUP BY 1) SELECT item_id, score, o_custkey FROM c JOIN orders ON o_orderkey = item_id ORDER BY score DESC, item_id LIMIT 50")
def jn_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = agg_chunkdeg(spark, d).toDF("item_id", "score").join(table(spark, d, "orders"), F.col("item_id") == F.col("o_orderkey"))
    return rows.select("item_id", "score", "o_custkey").orderBy(F.desc("score"), "item_id").limit(50)


@query("SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations QUALIFY next_role IS NOT NULL")
def jn_adjacent(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return rows.where("next_role IS NOT NULL").select("conv_id", "turn", "next_role")


@query("SELECT q.conv_id, q.turn, length(q.text) AS asked, length(a.text) AS answered FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def jn_zip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.char_length("text").alias("asked"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.char_length("text").alias("answered"))
    return q.join(a, ["conv_id", "turn"])


@query("SELECT source, round(b.m - a.m, 6) AS change FROM (SELECT source, avg(n_chars) AS m FROM documents WHERE doc_id // 32 % 2 = 0 GROUP BY source) a JOIN (SELECT source, avg(n_chars) AS m FROM documents WHERE doc_id // 32 % 2 = 1 GROUP BY source) b USING (source)")
def jn_crossrun(spark: SparkSession, d: str) -> DataFrame:
    """Two runs compared by configuration: blocks of 32 ids go to the runs in turn, so that sources occur in both; all rows take part."""
    mean = lambda run: F.avg(F.when(F.floor(F.col("doc_id") / 32) % 2 == run, F.col("n_chars")))
    rows = table(spark, d, "documents").groupBy("source").agg(mean(0).alias("a"), mean(1).alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL").select("source", F.round(F.col("b") - F.col("a"), 6).alias("change"))


_SEQ = f"SELECT *, {_NORM} AS normalized_name, {_TYPE} AS entity_type FROM ({_MENTIONS})"


@query(f"""SELECT normalized_name, entity_type, arg_min(name, (source_id % 3 <> 0, seq)) AS name, string_agg(source_id, ',' ORDER BY source_id % 3 <> 0, seq) AS chunk_ids FROM (SELECT * FROM ({_SEQ}) WHERE normalized_name <> '' QUALIFY row_number() OVER (PARTITION BY normalized_name, entity_type, source_id ORDER BY seq) = 1) GROUP BY ALL""")
def grf_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = _typed(spark, d).where("normalized_name <> ''").withColumn("chunk_ids", F.array("source_id"))
    rows = rows.select("normalized_name", "entity_type", "name", "chunk_ids", "seq", "source_id")
    stored, new = rows.where("source_id % 3 = 0").drop("source_id"), rows.where("source_id % 3 <> 0").drop("source_id")
    return graph.merge_nodes(stored, new).select("normalized_name", "entity_type", "name", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("""WITH n AS (SELECT s_suppkey AS id, 'nation' || s_nationkey AS normalized_name FROM supplier), e AS (SELECT 'nation' || n_nationkey AS src_name, 'nation' || ((n_nationkey + n_regionkey) % 25) AS dst_name, n_regionkey % 2 AS type, n_nationkey / 2.0 AS weight, n_nationkey AS seq FROM nation)
SELECT a.id AS src_id, type, b.id AS dst_id, arg_min(weight, seq)::DOUBLE AS weight FROM e JOIN n a ON a.normalized_name = src_name JOIN n b ON b.normalized_name = dst_name GROUP BY ALL""")
def grf_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation"), "s_nationkey").alias("normalized_name"))
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    e = table(spark, d, "nation").select(F.concat(F.lit("nation"), k).alias("src_name"), F.concat(F.lit("nation"), (k + r) % 25).alias("dst_name"), (r % 2).alias("type"), (k / 2).alias("weight"), k.alias("seq"))
    return graph.merge_edges(e, nodes)


_LEVELS = "SELECT vec_id AS id, [vec_id % 40, vec_id % 40 % 10, vec_id % 2] AS c FROM embeddings"


@query(f"""WITH h AS ({_LEVELS}) SELECT level, community, min(parent) AS parent, count(*) AS members FROM (SELECT 0 AS level, c[1] AS community, c[2] AS parent FROM h UNION ALL SELECT 1, c[2], c[3] FROM h UNION ALL SELECT 2, c[3], NULL FROM h) GROUP BY level, community""")
def g_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return graph.hierarchy(table(spark, d, "embeddings").select(v.alias("id"), F.array(v % 40, v % 40 % 10, v % 2).alias("communities")))


@query(f"""WITH l AS ({_LINKS}), b AS (SELECT src AS id FROM l UNION ALL SELECT dst FROM l), n AS (SELECT id, community, name, coalesce(pagerank, 0) AS p, (SELECT count(*) FROM b WHERE b.id = n.id) AS degree FROM ({_NODES}) n),
m AS (SELECT community, string_agg('- ' || name || CASE WHEN p > 0 THEN printf(' (PR %.3f)', p) ELSE '' END, chr(10) ORDER BY p DESC, degree DESC, id) AS m FROM n GROUP BY community),
r AS (SELECT a.community, string_agg('- ' || src || ' ' || coalesce(type, 'RELATED_TO') || ' ' || dst, chr(10) ORDER BY src, dst, coalesce(type, 'RELATED_TO')) AS r FROM l JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.community = b.community GROUP BY 1)
SELECT community, left(concat_ws(chr(10), 'Entities:', m, 'Relationships:', r), 32000) AS context FROM m LEFT JOIN r USING (community)""")
def g_context(spark: SparkSession, d: str) -> DataFrame:
    members = graph.members_with_degree(_suppliers(spark, d), _links(spark, d))
    return graph.community_text(members, graph.community_edges(_links(spark, d), _suppliers(spark, d)))


@query()
def g_leiden(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the part-supplier graph as a whole."""
    found = graph.leiden(edges(spark, d))
    return found.select("id", F.get("communities", 0).alias("finest"), F.element_at("communities", -1).alias("coarsest"))


@query("""WITH c AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label),
s AS (SELECT q.vec_id AS query_id, label::BIGINT AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v), 6) AS score FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q, c)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s QUALIFY rank <= 3""")
def vec_communities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = each.groupBy(F.col("label").cast("long").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vector"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.vector_search(queries, centres, 3)
