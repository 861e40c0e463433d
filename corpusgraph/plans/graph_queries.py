"""Queries of the graph operators: parts and suppliers as a bipartite graph, capitalised words as entity mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import graph
from corpusgraph.plans.registry import query
from corpusgraph.plans.session import table

_EDGES = "SELECT l_partkey AS src, -l_suppkey - 1 AS dst FROM lineitem"
_VERTICES = "SELECT p_partkey AS id FROM part UNION ALL SELECT -s_suppkey::BIGINT - 1 FROM supplier"
_BOTH = f"e AS ({_EDGES}), a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), v AS ({_VERTICES})"
_DEGREE = _BOTH + ", g AS (SELECT id, count(src)::BIGINT AS degree FROM v LEFT JOIN a ON a.src = v.id GROUP BY id)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return parts.unionAll(table(spark, d, "supplier").select((-F.col("s_suppkey").cast("long") - 1).alias("id")))


@query(f"WITH {_DEGREE} SELECT id, degree FROM g")
def agg_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(vertices(spark, d), edges(spark, d))


@query(f"WITH {_DEGREE} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, max(degree) AS most, round(avg(degree), 6) AS mean FROM g")
def agg_graphstats(spark: SparkSession, d: str) -> DataFrame:
    degree = graph.degrees(vertices(spark, d), edges(spark, d)).agg(F.count("*").alias("nodes"), F.max("degree").alias("most"), F.round(F.avg("degree"), 6).alias("mean"))
    return degree.join(edges(spark, d).agg(F.count("*").alias("edges")))


@query(f"""WITH RECURSIVE {_DEGREE}, w AS (SELECT a.src, a.dst, count(*)::DOUBLE / any_value(degree) AS w FROM a JOIN g ON g.id = a.src GROUP BY a.src, a.dst),
r AS (SELECT 0 AS i, id, 0.15::DOUBLE AS p FROM v UNION ALL
 SELECT i, id, p FROM (SELECT r0.i + 1 AS i, v.id, 0.15 + 0.85 * coalesce(s.s, 0) AS p FROM (SELECT DISTINCT i FROM r) r0 JOIN v ON true LEFT JOIN (SELECT w.dst, sum(r.p * w.w) AS s FROM r JOIN w ON w.src = r.id GROUP BY w.dst) s ON s.dst = v.id WHERE r0.i < 20))
SELECT id, round(p, 6) AS pagerank FROM r WHERE i = 20""")
def g_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(vertices(spark, d), edges(spark, d)).select("id", F.round("pagerank", 6).alias("pagerank"))


@query()
def g_pagerank_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Ranks to a tolerance, by vertices that have something to send; held against a dense computation in tests."""
    ranks, _ = graph.pagerank_by_deltas(vertices(spark, d), edges(spark, d), tolerance=1e-6)
    return ranks.select("id", F.round("pagerank", 4).alias("pagerank"))


_CUSTOMER = "e AS (SELECT o_custkey AS src, -o_orderkey - 1 AS dst FROM orders)"


@query("SELECT DISTINCT -o_orderkey - 1 AS id, min(-o_orderkey - 1) OVER (PARTITION BY o_custkey) AS component FROM orders UNION SELECT DISTINCT o_custkey, min(-o_orderkey - 1) OVER (PARTITION BY o_custkey) FROM orders")
def g_components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") - 1).alias("dst"))
    return graph.connected_components(e.select(F.explode(F.array("src", "dst")).alias("id")), e)


@query("""WITH e AS (SELECT DISTINCT n_nationkey::BIGINT AS src, -n_regionkey::BIGINT - 1 AS dst FROM nation), a AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT src AS start FROM e),
p AS (SELECT start, dst AS id, 1 AS n FROM s JOIN a ON a.src = s.start UNION SELECT start, b.dst, 2 FROM s JOIN a ON a.src = s.start JOIN a b ON b.src = a.dst WHERE b.dst <> start)
SELECT start, id, min(n) AS path_length FROM p GROUP BY ALL""")
def jn_path(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (-F.col("n_regionkey").cast("long") - 1).alias("dst"))
    return graph.neighbours(e.select(F.col("src").alias("id")).distinct(), e).where("start <> id")


_WORDS = "the|a|an|of|in|on|for|to|and"
_NORM = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(name, ''))), '^(({_WORDS})(\s+|$))+', ''), '((^|\s+)({_WORDS}))+$', ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_MENTIONS = r"SELECT doc_id AS source_id, doc_id * 100000 + generate_subscripts(m, 1) - 1 AS seq, unnest(m) AS name FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?: of [a-z]+)?') AS m FROM documents)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+(?: of [a-z]+)?)"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(found).alias("at", "name"))
    return rows.select("source_id", (F.col("source_id") * 100000 + F.col("at")).alias("seq"), "name")


@query(f"SELECT DISTINCT name, {_NORM} AS normalized_name FROM ({_MENTIONS})")
def g_norm(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("name").distinct().withColumn("normalized_name", graph.normalised_name(F.col("name")))


@query(f"""SELECT normalized_name, entity_type, arg_min(name, seq) AS name, count(*) AS mentions, count(DISTINCT source_id) AS chunks FROM
(SELECT *, {_NORM} AS normalized_name, 'T' || (length(name) % 9) AS entity_type FROM ({_MENTIONS})) WHERE normalized_name <> '' GROUP BY ALL""")
def agg_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.consolidate_entities(mentions(spark, d).withColumn("entity_type", F.concat(F.lit("T"), F.length("name") % 9)))


@query("SELECT p_brand AS src, s_nationkey AS dst, l_returnflag AS relationship, round(avg(l_discount), 6) AS weight, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def agg_rels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return li.groupBy(F.col("p_brand").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_returnflag").alias("relationship")).agg(F.round(F.avg("l_discount"), 6).alias("weight"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def jn_endpoints(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT vec_id, 'community_L' || (vec_id % 3) || '_' || label AS key, (vec_id % 3)::INT AS level, label::BIGINT AS community FROM embeddings")
def g_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("key", graph.community_key(F.col("vec_id") % 3, F.col("label")))
    return rows.select("vec_id", "key", graph.parse_community_key(F.col("key")).alias("p")).select("vec_id", "key", "p.level", "p.community")


@query("SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1")
def agg_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n"))
