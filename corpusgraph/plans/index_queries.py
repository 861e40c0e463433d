"""Queries of collections, sources, sinks and configuration names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import keys
from corpusgraph.operators import chunking, cleaning, graph
from corpusgraph.plans.graph_queries import _NORM
from corpusgraph.plans.registry import query
from corpusgraph.plans.scratch import Scratch
from corpusgraph.plans.session import table
from corpusgraph.plans.text_queries import _MARKDOWN, _PACK, _SPACE, _SPLIT, _chunks
from corpusgraph.sources import collections, files, logs

_VALUES = ", ".join(f"('{kind}', {at}, '{f.split()[0]}', '{f.split()[1]}')" for kind, ddl in collections.KINDS.items() for at, f in enumerate(ddl.split(", ")))


def _collection(spark: SparkSession, name: str, fields: str, key: str = "uuid") -> collections.Collection:
    return collections.Collection(spark, Scratch(spark, "collections").path(""), name, fields, key)


@query(f"SELECT * FROM (VALUES {_VALUES}) t(collection, pos, field, type)")
def idx_create(spark: SparkSession, d: str) -> DataFrame:
    """The four kinds of collections as created, read back from storage."""
    out = []
    for kind in collections.KINDS:
        c = _collection(spark, kind, kind)
        assert c.create() and not c.create()
        out += [(kind, i, f.name, f.dataType.simpleString()) for i, f in enumerate(spark.read.parquet(f"{c.path}/v0").schema)]
    return spark.createDataFrame(out, "collection string, pos int, field string, type string")


@query("SELECT * FROM (VALUES ('kept', false, true), ('dropped', true, false), ('missing', false, false)) t(name, dropped, there)")
def idx_drop(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for name, make, drop in (("kept", True, False), ("dropped", True, True), ("missing", False, True)):
        c = _collection(spark, name, "chunk")
        if make:
            c.create()
        out.append((name, c.drop() if drop else False, bool(c.versions())))
    return spark.createDataFrame(out, "name string, dropped boolean, there boolean")


@query("SELECT source || '::' || (doc_id % 50) AS uuid, arg_max(doc_id, (doc_id % 2, doc_id)) AS doc_id, arg_max(n_chars, (doc_id % 2, doc_id)) AS n_chars FROM documents GROUP BY 1")
def idx_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two writes of documents into a stored collection: rows of even ids, then of odd ones, which replace those of their key."""
    c = _collection(spark, "documents", "uuid string, doc_id long, n_chars long")
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("::"), F.col("doc_id") % 50).alias("uuid"), "doc_id", "n_chars", F.col("doc_id").alias("seq"))
    c.create()
    for rest in (0, 1):
        c.upsert(docs.where(F.col("doc_id") % 2 == rest))
    return c.rows()


def _communities(spark: SparkSession, d: str) -> collections.Collection:
    c = _collection(spark, "communities", "community")
    e = table(spark, d, "embeddings").select(F.col("label"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    key = graph.community_key(F.lit(2), F.col("label"))
    rows = e.select(keys.uuid5(key).alias("uuid"), key.alias("community_id"), F.lit(2).alias("level"), "seq", "label", "vector")
    count = rows.groupBy(F.col("uuid").alias("u")).agg(F.count("*").cast("int").alias("member_count"))
    rows = rows.join(count, F.col("uuid") == F.col("u")).withColumn("members_json", F.to_json(F.array(F.struct(F.col("label").alias("id")))))
    c.create()
    c.insert(rows.where("label < 5").withColumn("summary", F.concat(F.lit("first "), "seq")))
    again = rows.withColumn("summary", F.concat(F.lit("again "), "seq")).withColumn("vector", F.when(F.col("label") != 8, F.col("vector")))
    c.insert(again)
    return c


@query("""SELECT 'community_L2_' || label AS community_id, 2 AS level, count(*)::INT AS member_count, CASE WHEN label < 5 THEN 'first ' ELSE 'again ' END || min(vec_id) AS summary, '[{"id":' || label || '}]' AS members_json
FROM embeddings WHERE label <> 8 GROUP BY label""")
def idx_upcomm(spark: SparkSession, d: str) -> DataFrame:
    """Communities inserted twice: what is stored stays, and what has no vector is skipped."""
    return _communities(spark, d).rows().select("community_id", "level", "member_count", "summary", "members_json")


@query("SELECT DISTINCT 'community_L2_' || label AS community_id FROM embeddings WHERE label <> 8")
def idx_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the communities uploaded so far."""
    return _communities(spark, d).rows().select("community_id").distinct()


@query("SELECT 'community_L2_' || label AS community_id, count(*)::INT AS member_count FROM embeddings WHERE label IN (2, 5, 8) AND label <> 8 GROUP BY label")
def jn_communities(spark: SparkSession, d: str) -> DataFrame:
    """Stored communities by wanted ids; unknown ones give nothing."""
    wanted = table(spark, d, "embeddings").where("label IN (2, 5, 8)").select(graph.community_key(F.lit(2), F.col("label")).alias("community_id")).distinct()
    return _communities(spark, d).rows().join(wanted, "community_id", "left_semi").select("community_id", "member_count")


@query("SELECT source || '.json' AS name, count(*) AS chunks FROM documents GROUP BY source")
def src_list(spark: SparkSession, d: str) -> DataFrame:
    """Files of chunks, one for each book, listed below a folder with the rows that each holds."""
    at = _books(spark, d)
    names = files.listing(spark, at, "*.json").select(F.regexp_extract("path", r"book=([^/]+)\.json/[^/]*$", 1).alias("book")).distinct()
    found = spark.read.schema("doc_id long").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(at)
    rows = found.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"book=([^/]+)\.json/[^/]*$", 1).alias("book")).agg(F.count("*").alias("chunks"))
    return names.join(rows, "book").select(F.concat("book", F.lit(".json")).alias("name"), "chunks")


def _books(spark: SparkSession, d: str) -> str:
    at = Scratch(spark, "books").path("")
    docs = table(spark, d, "documents").select(F.concat("source", F.lit(".json")).alias("book"), "doc_id", "source", "lang", "text")
    docs.write.partitionBy("book").json(at)
    return at


@query(f"""WITH p AS (SELECT doc_id, source AS book_id, lang AS context, {_SPACE % 'text'} AS text FROM documents)
SELECT doc_id, book_id, context, text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INT AS words FROM p WHERE text IS NOT NULL""")
def src_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph files by book, read with a fixed schema."""
    rows = spark.read.schema("doc_id long, source string, lang string, text string").option("recursiveFileLookup", True).json(_books(spark, d)).where("text IS NOT NULL")
    text = cleaning.squeeze(F.col("text"))
    return rows.select("doc_id", F.col("source").alias("book_id"), F.col("lang").alias("context"), text.alias("text"), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).alias("words"))


@query("SELECT doc_id, text FROM documents")
def src_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk files of both shapes: objects with a list of chunks, and plain ones."""
    at = Scratch(spark, "chunkfiles").path("")
    docs = table(spark, d, "documents").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(7)).alias("g"))
    nested = docs.where("doc_id % 2 = 0").groupBy("g").agg(F.collect_list(F.struct("doc_id", "text")).alias("chunks")).drop("g")
    nested.write.json(f"{at}/nested")
    docs.where("doc_id % 2 = 1").drop("g").write.option("ignoreNullFields", False).json(f"{at}/flat")
    return files.read_chunks(spark, at, "doc_id long, text string", multi_line=False).select("doc_id", "text")


_PAGE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKDOWN}, '(?i)<h1\b[^>]*>', chr(10) || '# ', 'g'), '(?i)<h[2-6]\b[^>]*>', chr(10) || '## ', 'g'), '(?i)</(h[1-6]|p|div|li|ul|title|head)>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: {_SPACE % 'x'}), lambda x: x <> ''), chr(10)) AS text FROM pages")
def src_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Text of paged documents as markdown: captions, tables, headers and footers go. Pages stored as binary files go through the parser plug-in."""
    at = Scratch(spark, "pages").path("")
    pages = table(spark, d, "pages")
    pages.select("page_id", F.encode("html", "UTF-8").alias("content")).write.parquet(at)
    stored = spark.read.parquet(at)
    return files.parsed(stored.select(F.col("page_id").alias("key"), "content"), files.html_parser).select(F.col("key").alias("page_id"), "text")


@query("SELECT 'PERSON, BRAIN_STRUCTURE, BRAIN_FUNCTION, CHEMICAL, DISORDER, MENTAL_STATE, BEHAVIOR, THEORY, PRECEPT' AS types, 9 AS n")
def src_types(spark: SparkSession, d: str) -> DataFrame:
    rows = files.entity_types(spark)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]), ", ").alias("types"), F.count("*").cast("int").alias("n"))


@query("""WITH m AS (SELECT s_suppkey AS id, s_name AS name, abs(s_acctbal) / 1e9 AS price FROM supplier), p AS (SELECT n_regionkey AS category, n_nationkey * 2 AS id, n_nationkey AS pos FROM nation),
b AS (SELECT category, arg_min(m.id, pos) AS id FROM p JOIN m USING (id) GROUP BY category), c AS (SELECT DISTINCT category FROM p)
SELECT category, coalesce(id, -1) AS model, coalesce(category || ': ' || name || ' (' || CASE WHEN price = 0 THEN 'free' WHEN price * 1000000 < 0.01 THEN printf('$%.3f', price * 1000000) WHEN price * 1000000 < 1 THEN printf('$%.2f', price * 1000000) ELSE printf('$%.1f', price * 1000000) END || ')', 'fallback') AS label
FROM c LEFT JOIN b USING (category) LEFT JOIN m USING (id)""")
def src_models(spark: SparkSession, d: str) -> DataFrame:
    """For each category the first model of its priority list that the catalogue has, with a price label; else a fallback."""
    catalogue = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.abs("s_acctbal") / F.lit(1e9)).alias("price"))
    n = F.col("n_nationkey")
    wanted = table(spark, d, "nation").select(F.col("n_regionkey").alias("category"), (n * 2).alias("id"), n.alias("pos"))
    picked = files.curated(wanted, catalogue)
    label = F.concat(F.col("category").cast("string"), F.lit(": "), "name", F.lit(" ("), files.price_label(F.col("price")), F.lit(")"))
    return picked.select("category", F.coalesce("id", F.lit(-1)).alias("model"), F.coalesce(label, F.lit("fallback")).alias("label"))


@query("SELECT doc_id % 3 AS run, doc_id, CASE WHEN doc_id % 3 = 1 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT 2, doc_id, 'new' FROM documents WHERE doc_id % 3 = 2")
def snk_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Three tables that exist or not, written again: left alone (skip), replaced (all), written anew."""
    at = Scratch(spark, "overwrite").path("")
    docs = table(spark, d, "documents").select("doc_id", F.lit("s").alias("strategy"), F.lit("b").alias("book"))
    out = None
    for run, there, mode in ((0, True, "skip"), (1, True, "all"), (2, False, "skip")):
        mine = docs.where(F.col("doc_id") % 3 == run)
        if there:
            files.write_chunks(mine.withColumn("state", F.lit("old")), f"{at}/{run}")
        files.write_chunks(mine.withColumn("state", F.lit("new")), f"{at}/{run}", mode)
        one = spark.read.parquet(f"{at}/{run}").select(F.lit(run).cast("long").alias("run"), "doc_id", "state")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT conv_id AS id, turn::INT AS rank, role AS stage, text AS query, round(length(text) / 7.0::DOUBLE, 4) AS score FROM conversations")
def snk_querylog(spark: SparkSession, d: str) -> DataFrame:
    """Query logs appended in two runs as JSON lines and read again."""
    at = Scratch(spark, "querylog").path("")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("rank"), F.col("role").alias("stage"), F.col("text").alias("query"), (F.char_length("text") / F.lit(7.0)).alias("score"))
    for rest in (0, 1):
        logs.append_queries(c.where(F.col("id") % 2 == rest), at)
    return logs.read_queries(spark, at)


@query("SELECT doc_id AS question, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE lang END AS strategy, doc_id % 2 = 0 AS reranking, CASE WHEN quality IS NOT NULL THEN quality::DOUBLE END AS score, CASE WHEN quality IS NULL THEN 'no label' END AS failure FROM documents LEFT JOIN labels USING (doc_id)")
def snk_trace(spark: SparkSession, d: str) -> DataFrame:
    """Traces written as JSON and read again; those of older runs lack the field reranking, which is then false."""
    at = Scratch(spark, "traces").path("")
    i = F.col("doc_id")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(i.alias("question"), F.when(i % 3 == 0, F.lit("x")).otherwise(F.col("lang")).alias("strategy"), F.when(i % 2 == 0, F.lit(True)).alias("reranking"), F.col("quality").cast("double").alias("score"))
    logs.write_traces(rows.withColumn("failure", F.when(F.col("score").isNull(), "no label")), at)
    return logs.read_traces(spark, at)


@query("SELECT lang, source, count(*) AS n FROM documents WHERE NOT (lang = 'en' AND source < 'src3') GROUP BY ALL")
def snk_evalckpt(spark: SparkSession, d: str) -> DataFrame:
    """Combinations that a checkpoint doesn't tell as finished, with their rows."""
    at = Scratch(spark, "evalckpt").path("")
    docs = table(spark, d, "documents")
    logs.save_finished(docs.where("lang = 'en' AND source < 'src3'").select("lang", "source").distinct(), at)
    logs.save_finished(docs.where("lang = 'en' AND source < 'src2'").select("lang", "source").distinct(), at)
    return logs.unfinished(docs, spark, at, ["lang", "source"]).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT string_agg('## Run ' || (vec_id % 17) || ' (label ' || label || ')', chr(10)) AS t FROM embeddings) SELECT (SELECT max(vec_id % 17) + 1 FROM embeddings)::INT AS next_run")
def snk_history(spark: SparkSession, d: str) -> DataFrame:
    """The number of the next run from the headings of a history file to which runs are appended."""
    at = Scratch(spark, "history").path("")
    lines = table(spark, d, "embeddings").select(F.concat(F.lit("## Run "), F.col("vec_id") % 17, F.lit(" (label "), F.col("label").cast("string"), F.lit(")")).alias("value"))
    logs.append_history(lines, at)
    return logs.next_run(spark, at)


_DEGREES = "SELECT s_nationkey AS src, s_suppkey % 25 AS dst, s_acctbal / 1000 AS weight, s_name AS description FROM supplier"


@query(f"""WITH e AS ({_DEGREES}), g AS (SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM e WHERE src = n_nationkey) + (SELECT count(*) FROM e WHERE dst = n_nationkey) AS degree FROM nation),
m AS (SELECT min(degree) AS low, max(degree) AS high FROM g)
SELECT 'node' AS kind, id::BIGINT AS a, NULL::BIGINT AS b, name AS label, round(30 + 60 * (degree - low)::DOUBLE / CASE WHEN high > low THEN high - low ELSE 1 END, 6) AS size FROM g, m
UNION ALL SELECT 'edge', src, dst, CASE WHEN length(description) > 6 THEN left(description, 6) || '...' ELSE description END, round(greatest(0.5::DOUBLE, least(coalesce(weight, 1.0::DOUBLE), 5.0::DOUBLE)), 6) FROM e""")
def snk_viz(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and widths of a graph's drawing."""
    e = table(spark, d, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 25).alias("dst"), (F.col("s_acctbal") / 1000).alias("weight"), F.col("s_name").alias("description"))
    v = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    nodes, arcs = graph.drawing(v, e, 6)
    a = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("name").alias("label"), F.round("size", 6).alias("size"))
    return a.unionAll(arcs.select(F.lit("edge"), F.col("src").cast("long"), F.col("dst").cast("long"), "tooltip", F.round("width", 6)))


_COEFFICIENT = "(vec_id % 9) / 4.0::DOUBLE"


@query(rf"""SELECT DISTINCT vec_id % 9 AS i, 'semantic_std' || rtrim(rtrim(printf('%.2f', {_COEFFICIENT}), '0'), '.') AS folder, regexp_replace(regexp_replace('a/' || (vec_id % 9) || '\\..x', '[/\\]+', '_', 'g'), '\.{{2,}}', '_', 'g') AS safe,
'Community_semantic_' || (vec_id % 9) || '_5_embed3large_v1' AS community FROM embeddings""")
def cfg_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id") % 9
    rows = table(spark, d, "embeddings").select(i.alias("i")).distinct()
    i = F.col("i")
    unsafe = F.concat(F.lit("a/"), i, F.lit("\\\\..x"))
    named = keys.collection_name(F.concat(F.lit("semantic_"), i, F.lit(".5")), prefix="Community_")
    return rows.select("i", keys.semantic_folder(i / F.lit(4.0)).alias("folder"), keys.safe_name(unsafe).alias("safe"), named.alias("community"))


@query("""SELECT s AS strategy, CASE WHEN s = 'section' THEN 'Section-Based Chunking' WHEN s = 'contextual' THEN 'Contextual Chunking' WHEN s = 'raptor' THEN 'RAPTOR (Hierarchical)'
WHEN regexp_matches(s, '^semantic_std[0-9]+$') THEN 'Semantic (' || substr(s, 13) || ' std)' WHEN s LIKE 'semantic\\_%' ESCAPE '\\' THEN 'Semantic (' || substr(s, 10) || ')' ELSE 'Src' || substr(s, 4) END AS name
FROM (SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN 'section' WHEN 1 THEN 'contextual' WHEN 2 THEN 'raptor' WHEN 3 THEN 'semantic_std' || (doc_id % 4) WHEN 4 THEN 'semantic_0.' || (doc_id % 5) ELSE source END AS s FROM documents)""".replace("\\\\", "\\"))
def cfg_meta(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    cases = F.when(i % 6 == 0, "section").when(i % 6 == 1, "contextual").when(i % 6 == 2, "raptor").when(i % 6 == 3, F.concat(F.lit("semantic_std"), i % 4)).when(i % 6 == 4, F.concat(F.lit("semantic_0."), i % 5)).otherwise(F.col("source"))
    rows = table(spark, d, "documents").select(cases.alias("strategy")).distinct()
    return rows.select("strategy", keys.display_name(F.col("strategy")).alias("name"))


@query(f"""SELECT doc_id, (sum(is_header::INT) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS headers, pos, is_header FROM (SELECT doc_id, pos, regexp_matches(line, '^#+\\s+') AS is_header FROM
(SELECT page_id AS doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT page_id, string_split({_PAGE}, chr(10)) AS l FROM pages)))""".replace("\\\\", "\\"))
def cln_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header lines as delimiters: each line with the number of headers so far."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), cleaning.markdown_of_html(F.col("html")).alias("text"))
    return cleaning.split_at_headers(pages).withColumn("pos", F.col("pos").cast("long"))


@query(_PACK + "SELECT source AS book, 'section' AS strategy, count(*) AS chunks FROM x JOIN documents USING (doc_id) GROUP BY 1 UNION ALL SELECT source, 'lines', sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT FROM documents GROUP BY 1")
def chk_run(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each book by the registered chunkers, all books in one plan."""
    docs = table(spark, d, "documents")
    return chunking.run(docs, "source", ["section", "lines"], most=200)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS elapsed, date_trunc('day', ts)::DATE AS day, (extract(hour FROM ts))::INT AS hour FROM events")
def fn_time(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps of logs: written as ISO strings, read again, and told as elapsed seconds, day and hour."""
    e = table(spark, d, "events").select("event_id", keys.stamp(F.col("ts")).alias("stamp"))
    ts = keys.stamped(F.col("stamp"))
    return e.select("event_id", "stamp", keys.elapsed_seconds(F.lit("2024-01-01T00:00:00"), F.col("stamp")).alias("elapsed"), F.to_date(ts).alias("day"), F.hour(ts).alias("hour"))


@query("SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS counts, max(n) FILTER (source = 'src3') AS of_src3, count(*)::INT AS size, sum(n)::BIGINT AS total FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def fn_map(spark: SparkSession, d: str) -> DataFrame:
    """Counters as maps: built, merged over parts, looked up and listed."""
    parts = table(spark, d, "documents").groupBy("lang", (F.col("doc_id") % 3).alias("part"), "source").agg(F.count("*").alias("n"))
    maps = parts.groupBy("lang", "part").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    whole = keys.merged_counts(maps, "lang", "m")
    ordered = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return whole.select("lang", ordered.alias("counts"), F.try_element_at("m", F.lit("src3")).alias("of_src3"), F.size("m").alias("size"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
