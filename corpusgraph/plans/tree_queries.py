"""Queries of the clustering tree: embeddings are leaves, labels are books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import layout, tree
from corpusgraph.plans.registry import query
from corpusgraph.plans.session import table


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def tree_bic(spark: SparkSession, d: str) -> DataFrame:
    return tree.fit(_leaves(spark, d)).select("grp", "k", F.round("bic", 3).alias("bic"))


@query()
def tree_gmm(spark: SparkSession, d: str) -> DataFrame:
    rows = _leaves(spark, d)
    return tree.members(rows, tree.fit(rows)).select("grp", "id", "cluster", F.round("share", 6).alias("share"), "hard")


@query()
def tree_build(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = tree.build(_leaves(spark, d))
    return links.join(nodes.select("grp", F.col("node").alias("parent"), "level"), ["grp", "parent"]).select("grp", "parent", "child", "level")


@query()
def agg_levels(spark: SparkSession, d: str) -> DataFrame:
    return tree.level_counts(tree.build(_leaves(spark, d))[0])


@query("SELECT label AS grp, vec_id AS id, (vec_id % 5)::INT AS cluster FROM embeddings WHERE (vec_id * 7) % 10 >= 3")
def tree_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of clusters by a least share of 0.3."""
    v = F.col("vec_id")
    found = table(spark, d, "embeddings").select(F.col("label").alias("grp"), v.alias("id"), (v % 5).cast("int").alias("cluster"), ((v * 7) % 10 / 10).alias("share"), (v % 3 == 0).alias("hard"))
    return tree.of_clusters(found, 0.3).select("grp", "id", "cluster")


@query()
def tree_reduce(spark: SparkSession, d: str) -> DataFrame:
    return tree.reduced(_leaves(spark, d)).select("grp", "id", F.transform("coordinates", lambda x: F.round(x, 6)).alias("coordinates"))


@query()
def tree_layout(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates by neighbour embedding; tests hold planted clusters, neighbourhoods and equal results over partitionings."""
    return layout.embedded(_leaves(spark, d)).select("grp", "id", F.transform("coordinates", lambda x: F.round(x, 6)).alias("coordinates"))


_CLUSTERED = "SELECT label AS grp, vec_id AS id, vec_id // 3 % 20 AS cluster, embedding, CASE WHEN vec_id % 4 <> 0 THEN 's' || (vec_id % 4 + vec_id // 60 % 3) ELSE '' END AS section FROM embeddings"


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = F.col("vec_id")
    section = F.when(v % 4 != 0, F.concat(F.lit("s"), (v % 4 + F.floor(v / 60) % 3).cast("string"))).otherwise("")
    nodes = table(spark, d, "embeddings").select(F.col("label").alias("grp"), v.alias("id"), F.col("embedding").alias("vector"), section.alias("section"), (F.floor(v / 3) % 20).alias("cluster"))
    return nodes.select("grp", "cluster", "id"), nodes.drop("cluster")


@query(f"""WITH c AS ({_CLUSTERED}), n AS (SELECT grp, cluster, array_to_string(list(id ORDER BY id), ',') AS children, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT grp, cluster, array_to_string(list(round(m, 4)::DECIMAL(9, 4) ORDER BY i), ',') AS vector FROM (SELECT grp, cluster, i, avg(x::DOUBLE) AS m FROM (SELECT grp, cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM c) GROUP BY ALL) GROUP BY ALL)
SELECT grp || '::L1_cluster_' || cluster AS node, children, vector FROM n JOIN m USING (grp, cluster) WHERE n >= 2""")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = tree.summary_nodes(*_clustered(spark, d), 1)
    return found.select("node", F.array_join("children", ",").alias("children"), F.array_join(F.transform("vector", lambda x: F.round(x, 4).cast("decimal(9,4)")), ",").alias("vector"))


@query(f"""WITH n AS (SELECT grp, cluster, list(DISTINCT section ORDER BY section) FILTER (section <> '') AS s FROM ({_CLUSTERED}) GROUP BY ALL HAVING count(*) >= 2)
SELECT grp || ' > Level 1 Summary (' || CASE WHEN s IS NULL THEN '' WHEN len(s) <= 3 THEN array_to_string(s, ', ') ELSE len(s) || ' sections' END || ')' AS context, 'Level 1 Cluster ' || cluster || ' Summary' AS section FROM n""")
def tree_ctx(spark: SparkSession, d: str) -> DataFrame:
    return tree.summary_nodes(*_clustered(spark, d), 1).select("context", "section")


@query("""WITH t AS (SELECT source, doc_id, trim(coalesce(text, '')) AS text, length(trim(coalesce(text, ''))) // 4 AS tokens FROM documents),
l AS (SELECT *, 900 - (sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) - tokens) AS l FROM t)
SELECT source, string_agg(CASE WHEN tokens <= l THEN text ELSE substr(text, 1, (l * 4)::BIGINT) || '...' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS context FROM l WHERE l >= tokens OR l > 50 GROUP BY source""")
def tree_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the summary of each source's documents is written from."""
    return tree.summary_context(table(spark, d, "documents"), 900, "source", "doc_id")
