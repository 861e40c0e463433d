"""Queries of the stored graph, local search, communities, DRIFT and book-wise extraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import cleaning, communities, extraction, graph
from corpusgraph.plans.extraction_queries import _FOUND, _found
from corpusgraph.plans.graph_queries import _NORM
from corpusgraph.plans.registry import query
from corpusgraph.plans.relation_queries import _LINKS, _links
from corpusgraph.plans.scratch import Scratch
from corpusgraph.plans.session import table
from corpusgraph.sources import collections

_NODES = "name string, id long, entity_type string, description string, community long, pagerank double"


def _store(spark: SparkSession, name: str, fields: str, key: str) -> collections.Collection:
    return collections.Collection(spark, Scratch(spark, "graph").path(""), name, fields, key)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    empty = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("of "), F.col("s_nationkey").cast("string")))
    return s.select(F.lower("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("entity_type"), empty.alias("description"))


def _nodes(spark: SparkSession, d: str) -> collections.Collection:
    c = _store(spark, "nodes", _NODES, "name")
    c.create()
    c.upsert(_entities(spark, d))
    return c


@query("SELECT lower(s_name) AS name, s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0")
def grf_index(spark: SparkSession, d: str) -> DataFrame:
    """Nodes looked up by name in a table dealt by hash of the name, so that a lookup reads its names' buckets only."""
    at, buckets = Scratch(spark, "byname").path("table"), 8
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int").alias("bucket")
    _entities(spark, d).select("name", "id", bucket).write.partitionBy("bucket").parquet(at)
    asked = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.lower("s_name").alias("name")).select("name", bucket)
    return spark.read.parquet(at).join(asked, ["bucket", "name"], "left_semi").select("name", "id")


@query("SELECT count(*)::INT AS deleted, 0 AS left FROM supplier")
def grf_clear(spark: SparkSession, d: str) -> DataFrame:
    c = _nodes(spark, d)
    return spark.createDataFrame([(c.clear(), c.rows().count())], "deleted int, left int")


@query(f"""WITH l AS ({_LINKS}) SELECT (SELECT count(DISTINCT s_name) FROM supplier)::INT AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, coalesce(type, 'RELATED_TO') AS type, dst FROM l))::INT AS edges""")
def grf_upload(spark: SparkSession, d: str) -> DataFrame:
    """An extraction uploaded into the store, twice: what is there already is merged."""
    e = _entities(spark, d)
    links = _links(spark, d)
    names = e.select("id", "name")
    # Equal links are merged before their ends are named, and kept for both uploads.
    links = links.select(F.col("src").alias("src_name"), F.col("dst").alias("dst_name"), F.coalesce("type", F.lit("RELATED_TO")).alias("type"), "weight", F.xxhash64("src", "dst", "type", "weight").alias("seq"))
    links = graph.first_edges(links).withColumnsRenamed({"src_name": "src", "dst_name": "dst"})
    named = links.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst").select("src_name", "dst_name", "type", "weight", "seq")
    named = Scratch(spark, "links").save(named, "named")
    nodes = _store(spark, "nodes", _NODES, "name")
    nodes.create()
    arcs = _store(spark, "arcs", "arc string, src_id long, type string, dst_id long, weight double", "arc")
    arcs.create()
    for _ in range(2):
        nodes.upsert(e)
        merged = graph.merge_edges(named, nodes.rows().select("id", F.col("name").alias("normalized_name")))
        arcs.upsert(merged.withColumn("arc", F.concat_ws(":", "src_id", "type", "dst_id")))
    return spark.createDataFrame([(nodes.rows().count(), arcs.rows().count())], "nodes int, edges int")


@query("SELECT vec_id AS id, label::BIGINT AS community, 42 AS seed FROM embeddings")
def grf_ckpt(spark: SparkSession, d: str) -> DataFrame:
    """Assignments saved with their seed and loaded again; another seed has none."""
    at = Scratch(spark, "assigned").path("")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("community"))
    graph.save_assignments(rows, at, 42)
    if graph.load_assignments(spark, at, 7) is not None:
        raise AssertionError("assignments of another seed were loaded")
    return graph.load_assignments(spark, at, 42).withColumn("seed", F.lit(42))


@query("SELECT lower(s_name) AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END::BIGINT AS community, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal END AS pagerank FROM supplier")
def grf_writeback(spark: SparkSession, d: str) -> DataFrame:
    """Communities and ranks written onto stored nodes; nodes without one keep what they had."""
    c = _nodes(spark, d)
    s = table(spark, d, "supplier")
    for column, rows in (("community", s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("community"))), ("pagerank", s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("pagerank")))):
        c.upsert(graph.written_back(c.rows(), rows, column))
    return c.rows().select("name", "community", "pagerank")


@query("SELECT lower(s_name) AS name, 'of ' || s_nationkey AS description FROM supplier WHERE s_suppkey % 4 <> 0")
def grf_page(spark: SparkSession, d: str) -> DataFrame:
    """Stored nodes with a description: one scan, without pages."""
    return _nodes(spark, d).rows().where("coalesce(description, '') <> ''").select("name", "description")


@query(f"WITH l AS ({_LINKS}) SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l) GROUP BY ALL")
def g_project(spark: SparkSession, d: str) -> DataFrame:
    return graph.both_ways(_links(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


_REGIONAL = "e AS (SELECT n_nationkey::BIGINT AS src, -n_regionkey::BIGINT - 1 AS dst FROM nation)"
_REACHED = f"""{_REGIONAL}, a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), g AS (SELECT src AS id, count(*) AS degree FROM a GROUP BY src),
p AS (SELECT DISTINCT src AS start, src AS id FROM e UNION SELECT e.src, dst FROM e UNION SELECT e.src, b.src FROM e JOIN e b ON b.dst = e.dst),
h AS (SELECT start AS query_id, s_suppkey AS item_id, max(x.degree + y.degree)::BIGINT AS score FROM p JOIN g x ON x.id = p.start JOIN g y ON y.id = p.id JOIN supplier ON s_nationkey = p.id WHERE start % 4 = 0 GROUP BY ALL)"""


def _regional(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starting nations, edges of nations and regions, and the suppliers that nations are named in."""
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (-F.col("n_regionkey").cast("long") - 1).alias("dst"))
    named = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("item_id"))
    return e.where("src % 4 = 0").select(F.col("src").alias("query_id"), F.col("src").alias("id")), e, named


@query(f"WITH {_REACHED} SELECT query_id, item_id FROM h")
def g_chunkids(spark: SparkSession, d: str) -> DataFrame:
    return communities.chunk_ids(*_regional(spark, d)).select("query_id", "item_id")


@query(f"WITH {_REACHED} SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS place FROM h")
def sort_graph(spark: SparkSession, d: str) -> DataFrame:
    """All chunks that the graph leads to, by degree sum, then id."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return communities.chunk_ids(*_regional(spark, d)).withColumn("place", F.row_number().over(order))


_MEMBER = "SELECT DISTINCT query_id, 'community_L2_' || s_nationkey AS community_id FROM (SELECT s_suppkey % 3 AS query_id, s_nationkey FROM supplier WHERE s_suppkey % 7 = 0 AND s_nationkey IS NOT NULL)"


def _membership(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    names = s.where("s_suppkey % 7 = 0").select((F.col("s_suppkey") % 3).alias("query_id"), F.concat(F.lit("The "), F.col("s_name")).alias("name"))
    known = s.select(graph.normalised_name(F.col("s_name")).alias("normalized_name"), F.col("s_nationkey").alias("community"))
    count = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("int").alias("member_count"))
    stored = table(spark, d, "nation").where("n_nationkey % 5 <> 0").join(count, "n_nationkey").select(graph.community_key(F.lit(2), F.col("n_nationkey")).alias("community_id"), F.col("n_name").alias("summary"), "member_count")
    return communities.by_membership(names, known, stored)


_STORED = "SELECT 'community_L2_' || n_nationkey AS community_id, n_name AS summary, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::INT AS member_count FROM nation WHERE n_nationkey % 5 <> 0"


@query(f"SELECT query_id, community_id, summary, member_count, 1.0::DOUBLE AS score FROM ({_MEMBER}) JOIN ({_STORED}) USING (community_id)")
def jn_membership(spark: SparkSession, d: str) -> DataFrame:
    return _membership(spark, d)


@query(f"""WITH {_REACHED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM h WHERE item_id % 6 <> 0 QUALIFY rank <= 5)
SELECT 'chunk' AS kind, query_id, item_id::VARCHAR AS id, rank, s_name AS text FROM r JOIN supplier ON s_suppkey = item_id UNION ALL SELECT 'community', query_id, community_id, 0, summary FROM ({_MEMBER}) JOIN ({_STORED}) USING (community_id)""")
def g_local(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the graph with the communities of the entities asked for; every sixth chunk isn't stored."""
    chunks = table(spark, d, "supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("text"))
    hits = communities.local_search(*_regional(spark, d), chunks, 5)
    hits = hits.select(F.lit("chunk").alias("kind"), F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("string").alias("id"), "rank", "text")
    return hits.unionAll(_membership(spark, d).select(F.lit("community"), F.col("query_id").cast("long"), "community_id", F.lit(0), "summary"))


@query(f"""WITH l AS ({_LINKS}), n AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS name, s_suppkey % 3 AS t FROM supplier WHERE s_nationkey % 6 <> 0),
k AS (SELECT name, arg_max('T' || t, id) AS entity_type FROM n GROUP BY name),
x AS (SELECT 'n' || a.s_nationkey AS source, 'n' || b.s_nationkey AS target, coalesce(l.type, 'RELATED_TO') AS type, l.src * 1000000 + l.dst AS seq, l.type AS t0 FROM l JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst),
y AS (SELECT source, target, arg_max(type, (seq, type)) AS type FROM x GROUP BY ALL)
SELECT 'node' AS kind, name AS a, '' AS b, entity_type AS type FROM k UNION ALL SELECT 'edge', source, target, type FROM y WHERE source IN (SELECT name FROM k) AND target IN (SELECT name FROM k)""")
def g_fetch(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    known = s.where("s_nationkey % 6 <> 0").select(name("s_nationkey").alias("normalized_name"), F.concat(F.lit("T"), (F.col("s_suppkey") % 3).cast("string")).alias("entity_type"), F.col("s_suppkey").alias("seq"))
    at = s.select(F.col("s_suppkey").alias("k"), name("s_nationkey").alias("n"))
    links = _links(spark, d).join(at.toDF("src", "source"), "src").join(at.toDF("dst", "target"), "dst")
    links = links.select("source", "target", "type", F.struct((F.col("src") * 1_000_000 + F.col("dst")).alias("s"), F.coalesce("type", F.lit("RELATED_TO")).alias("t")).alias("seq"))
    nodes, arcs = communities.collapsed(known, links)
    return nodes.select(F.lit("node").alias("kind"), F.col("normalized_name").alias("a"), F.lit("").alias("b"), F.col("entity_type").alias("type")).unionAll(arcs.select(F.lit("edge"), "source", "target", "type"))


_CHILDREN = "c AS (SELECT n_regionkey AS parent, n_nationkey AS child, (SELECT string_agg('- ' || s_name, chr(10) ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS raw, CASE WHEN n_nationkey % 6 <> 0 THEN n_name END AS summary FROM nation)"


@query(f"""WITH {_CHILDREN}, b AS (SELECT *, '[Community ' || child || ']' || chr(10) || raw AS l, '[Summary of community ' || child || ']' || chr(10) || summary AS s FROM c WHERE raw IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS nth, sum(CASE WHEN s IS NULL THEN 0 ELSE length(l) - length(s) END) OVER (w ROWS UNBOUNDED PRECEDING) AS saves FROM b WINDOW w AS (PARTITION BY parent ORDER BY length(raw) DESC, child)),
x AS (SELECT n_regionkey AS parent, n_name || ' next' AS line FROM nation WHERE n_nationkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name || ' next') <= 20),
t AS (SELECT parent, chr(10) || 'Between communities:' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS tail FROM x GROUP BY parent),
z AS (SELECT parent, coalesce(any_value(tail), '') AS tail, sum(length(l)) + count(*) - 1 + length(coalesce(any_value(tail), '')) AS total, count(*) AS n FROM o LEFT JOIN t USING (parent) GROUP BY parent),
u AS (SELECT parent, tail, CASE WHEN total <= 200 THEN 0 ELSE coalesce((SELECT min(nth) FROM o WHERE o.parent = z.parent AND total - saves <= 200), n) END AS used FROM z),
p AS (SELECT parent, any_value(used) AS used, string_agg(CASE WHEN nth <= used AND s IS NOT NULL THEN s ELSE l END, chr(10) ORDER BY child) || any_value(tail) AS w FROM o JOIN u USING (parent) GROUP BY parent)
SELECT parent, CASE WHEN length(w) > 200 THEN left(w, 200) || chr(10) || '[... truncated]' ELSE w END AS context, used::INT AS substituted FROM p""")
def g_hctx(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("child"), F.struct("s_suppkey", F.concat(F.lit("- "), "s_name").alias("line")).alias("x"))
    raw = s.groupBy("child").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("raw"))
    n = table(spark, d, "nation")
    children = n.select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")).alias("summary")).join(raw, "child")
    cross = n.where("n_nationkey % 2 = 1").select(F.col("n_regionkey").alias("parent"), F.concat("n_name", F.lit(" next")).alias("line"))
    return communities.hierarchical_context(children, cross, 50)


@query("""WITH h AS (SELECT vec_id AS id, vec_id % 40 AS c0, vec_id % 40 % 10 AS c1, vec_id % 2 AS c2 FROM embeddings),
f AS (SELECT 0 AS level, c0 AS community, min(c1) AS parent, '- v' || min(id) AS summary, count(*) AS n FROM h GROUP BY c0), a AS (SELECT level, community, parent, CASE WHEN community % 5 = 0 THEN 'old ' || community ELSE summary END AS summary FROM f WHERE n >= 3 OR community % 5 = 0),
g AS (SELECT c1 AS community, min(c2) AS parent, '- v' || min(id) AS raw, count(*) AS n FROM h GROUP BY c1), b AS (SELECT 1 AS level, g.community, g.parent, coalesce(arg_min(a.summary, a.community), any_value(raw)) AS summary FROM g LEFT JOIN a ON a.parent = g.community WHERE n >= 3 GROUP BY g.community, g.parent),
i AS (SELECT c2 AS community, '- v' || min(id) AS raw, count(*) AS n FROM h GROUP BY c2), c AS (SELECT 2 AS level, i.community, coalesce(arg_min(b.summary, b.community), any_value(raw)) AS summary FROM i LEFT JOIN b ON b.parent = i.community WHERE n >= 3 GROUP BY i.community)
SELECT level, community, summary FROM a UNION ALL SELECT level, community, summary FROM b UNION ALL SELECT level, community, summary FROM c""")
def g_summ(spark: SparkSession, d: str) -> DataFrame:
    """Summaries level by level, some of the finest ones stored already; the model gives the first line of what it is shown."""
    v = F.col("vec_id")
    assigned = table(spark, d, "embeddings").select(v.alias("id"), F.array(v % 40, v % 40 % 10, v % 2).alias("communities"))
    shape = graph.hierarchy(assigned)
    lines = F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(F.lit("- v"), x.cast("string")))
    raw = assigned.select("id", F.posexplode("communities").alias("level", "community")).groupBy("level", "community").agg(F.array_join(lines, "\n").alias("raw"))
    stored = shape.where("level = 0 AND community % 5 = 0").select("level", "community", F.concat(F.lit("old "), F.col("community").cast("string")).alias("summary"))
    return communities.summarize(shape.join(raw, ["level", "community"]), stored)


class _Scoring:
    """Scores a fold by the first community it shows; answers on other prompts with their first line."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            found = re.findall(r"--- Community (\d+) ---", p)
            if not found:
                out.append(p.split("Passages:\n")[-1].split("\n", 1)[0] + " ")
            elif int(found[0]) == 3:
                out.append("This is Not relevant here")
            elif int(found[0]) == 4:
                out.append("[Answer]\nunscored " + ",".join(found))
            else:
                out.append(f"[Score: {int(found[0]) % 8}/10]\n[Answer]\nfrom {','.join(found)}\n")
        return out


@query("""WITH m AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label),
s AS (SELECT q.vec_id AS query_id, m.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v), 6) DESC, m.label) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, m QUALIFY rank <= 8),
f AS (SELECT query_id, (rank - 1) // 2 AS fold, list(label ORDER BY rank) AS ids FROM s GROUP BY ALL),
a AS (SELECT *, array_to_string(ids, ',') AS told, CASE WHEN ids[1] = 3 THEN -1 WHEN ids[1] = 4 THEN 5 ELSE ids[1] % 8 END AS score FROM f),
k AS (SELECT query_id, string_agg('[Relevance: ' || score || '/10]' || chr(10) || CASE WHEN ids[1] = 4 THEN 'unscored ' ELSE 'from ' END || told, chr(10) || chr(10) ORDER BY score DESC, fold) AS intermediate, array_to_string(list_sort(flatten(list(ids))), ',') AS used, max(score) AS best FROM a WHERE score > 0 GROUP BY query_id)
SELECT vec_id AS query_id, coalesce('[Relevance: ' || best || '/10]', 'The retrieved communities do not contain information relevant to this query.') AS answer, coalesce(intermediate, '') AS intermediate, coalesce(used, '') AS used FROM embeddings LEFT JOIN k ON k.query_id = vec_id WHERE vec_id % 100 = 0""")
def g_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = each.groupBy(F.col("label").alias("community_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vector"))
    told = centres.withColumn("summary", F.concat(F.lit("report "), F.col("community_id").cast("string")))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("what?").alias("query"), F.col("embedding").alias("query_vector"))
    return communities.drift(asked, told, _Scoring(), 8).withColumn("used", F.array_join("used", ","))


@query(f"""WITH x AS ({_FOUND}), n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT source AS book, coalesce(sum(n), 0)::BIGINT AS entities, count(*) FILTER (text IS NOT NULL) AS processed, count(*) FILTER (text IS NULL) AS failed FROM documents LEFT JOIN n USING (doc_id) GROUP BY source""")
def ext_book(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all books' chunks with their counters; chunks without text fail and are counted."""
    docs = table(spark, d, "documents")
    found = extraction.names(docs.select("doc_id", F.posexplode(cleaning.sentences(F.col("text"))).alias("pos", "sentence")))
    return extraction.by_book(docs.select("doc_id", F.col("source").alias("book"), "text"), found)


@query(f"""WITH x AS (SELECT f.*, {_NORM} AS norm, 'T' || (length(name) % 9) AS t FROM ({_FOUND}) f), r AS (SELECT src, dst, count(*) AS n FROM (SELECT src, lead(src) OVER (PARTITION BY doc_id, pos ORDER BY nth) AS dst FROM (SELECT *, norm AS src FROM x) WHERE src <> '') WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)
SELECT (SELECT count(DISTINCT source) FROM documents) AS books, (SELECT count(*) FROM x) AS raw_entities, (SELECT count(DISTINCT t) FROM x) AS entity_types, (SELECT count(*) FROM (SELECT DISTINCT norm, t FROM x WHERE norm <> '')) AS entities, (SELECT sum(n) FROM r)::BIGINT AS raw_relations, (SELECT count(*) FROM r) AS relations""")
def ext_merge(spark: SparkSession, d: str) -> DataFrame:
    """All books' extractions merged: raw and consolidated numbers."""
    found = _found(spark, d).withColumn("entity_type", F.concat(F.lit("T"), (F.length("name") % 9).cast("string")))
    return extraction.merged(table(spark, d, "documents").select("doc_id", F.col("source").alias("book")), found)

