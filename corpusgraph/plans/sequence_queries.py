"""Queries of the operators on ordered rows, of filters, slices and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators import search, sequences, subwords
from corpusgraph.plans.registry import query
from corpusgraph.plans.session import table

_LINES = "SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
_AT = "OVER (PARTITION BY doc_id ORDER BY pos)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return sequences.lines(table(spark, d, "documents"))


@query(f"SELECT doc_id, pos, coalesce(line = lag(line) {_AT}, false) AS repeats FROM ({_LINES})")
def win_prevline(spark: SparkSession, d: str) -> DataFrame:
    return sequences.repeats_previous(_lines(spark, d), "line").select("doc_id", "pos", "repeats")


@query(f"SELECT doc_id, pos, context, sum(c) {_AT}::BIGINT AS island FROM (SELECT *, CASE WHEN context <> lag(context) {_AT} THEN 1 ELSE 0 END AS c FROM (SELECT doc_id, pos, length(line) // 60 AS context FROM ({_LINES})))")
def win_island(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences.islands(_lines(spark, d), F.floor(F.char_length("line") / 60).cast("long"))
    return rows.select("doc_id", "pos", "context", "island")


@query(f"SELECT doc_id, pos, last_value(CASE WHEN length(line) BETWEEN 1 AND 40 THEN line END IGNORE NULLS) {_AT} AS header FROM ({_LINES})")
def win_headerfill(spark: SparkSession, d: str) -> DataFrame:
    short = F.when(F.char_length("line").between(1, 40), F.col("line"))
    return sequences.carried(_lines(spark, d), short).select("doc_id", "pos", "header")


@query(f"SELECT doc_id, pos, 'doc' || doc_id || '::chunk_' || (row_number() {_AT} - 1) AS chunk_id FROM ({_LINES}) WHERE line <> ''")
def win_seq(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return _lines(spark, d).where("line <> ''").select("doc_id", "pos", F.concat(F.lit("doc"), "doc_id", F.lit("::chunk_"), place).alias("chunk_id"))


@query(f"SELECT doc_id, pos, array_to_string(coalesce(lag(w) {_AT}, []), ' ') AS overlap FROM (SELECT doc_id, pos, list_slice(w, greatest(len(w) - 1, 1), len(w)) AS w FROM (SELECT doc_id, pos, string_split(line, ' ') AS w FROM ({_LINES})))")
def win_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumn("words", F.split("line", " ", -1))
    return sequences.tail_of_previous(rows, "words", 2).select("doc_id", "pos", F.array_join("overlap", " ").alias("overlap"))


@query(f"SELECT doc_id, pos, round(avg(length(line)) OVER w, 6) AS mean, round(stddev_pop(length(line)) OVER w, 6) AS deviation FROM ({_LINES}) WINDOW w AS (PARTITION BY doc_id)")
def win_stats(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("doc_id")
    return _lines(spark, d).select("doc_id", "pos", F.round(F.avg(F.char_length("line")).over(w), 6).alias("mean"), F.round(F.stddev_pop(F.char_length("line")).over(w), 6).alias("deviation"))


@query("SELECT doc_id, round(10 + CASE WHEN b > a THEN (n_chars - a) / (b - a)::DOUBLE ELSE 0 END * 40, 6) AS size FROM documents, (SELECT min(n_chars) AS a, max(n_chars) AS b FROM documents)")
def win_minmax(spark: SparkSession, d: str) -> DataFrame:
    return sequences.scaled(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 10.0, 50.0).select("doc_id", "size")


@query("SELECT source, score, row_number() OVER (ORDER BY score DESC, source)::INT AS place FROM (SELECT source, round(avg(quality), 6) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def win_leader(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("score"))
    return scores.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "source")))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def win_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return sequences.keep_first(docs, [F.col("digest")], "doc_id")


@query("SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM (SELECT source AS query_id, doc_id AS item_id, n_chars AS score FROM documents)")
def win_rank(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("n_chars").alias("score"))
    return hits.select("query_id", "item_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")).alias("rank"))


@query("""SELECT conv_id, turn, CASE WHEN tokens <= l THEN text ELSE substr(text, 1, (l * 4)::BIGINT) || '...' END AS kept FROM
(SELECT *, 150 - (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) - tokens) AS l FROM (SELECT *, length(text) // 4 AS tokens FROM conversations)) WHERE l >= tokens OR l > 50""")
def win_budget(spark: SparkSession, d: str) -> DataFrame:
    return sequences.within_budget(table(spark, d, "conversations"), "text", 150).select("conv_id", "turn", "kept")


@query()
def win_budget_subwords(spark: SparkSession, d: str) -> DataFrame:
    """win_budget by tokens of a byte-pair vocabulary; held against a plain loop in tests."""
    kept = sequences.within_budget(table(spark, d, "conversations"), "text", 150, counter=subwords.BytePairs.read(spark))
    return kept.select("conv_id", "turn", "kept")


@query("SELECT vec_id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 1000")
def flt_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label = 2").select("vec_id", "label").orderBy("vec_id").limit(1000)


@query("SELECT p_partkey, p_type, (SELECT count(*) FROM part WHERE lower(p_type) NOT IN (SELECT DISTINCT lower(p_type) FROM part WHERE p_size <= 2)) AS discarded FROM part WHERE lower(p_type) IN (SELECT DISTINCT lower(p_type) FROM part WHERE p_size <= 2)")
def flt_strict(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("type", F.lower("p_type"))
    allowed = part.where("p_size <= 2").select("type").distinct()
    gone = part.join(allowed, "type", "left_anti").agg(F.count("*").alias("discarded"))
    return part.join(allowed, "type", "left_semi").join(F.broadcast(gone)).select("p_partkey", "p_type", "discarded")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5 AND n_chars >= 800")
def flt_sim(spark: SparkSession, d: str) -> DataFrame:
    best = search.top_k(table(spark, d, "documents").select("doc_id", "source", "n_chars"), 5, "source", "doc_id", "n_chars")
    return best.where("n_chars >= 800").drop("rank")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (3, 7)")
def flt_exclude(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(~F.col("item_id").isin(3, 7)).select("item_id")


@query("SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def flt_desc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "").select("conv_id", "turn")


@query("""SELECT * FROM (SELECT 'top' AS part, source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10))
UNION ALL SELECT * FROM (SELECT 'bottom', source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n, source LIMIT 3))""")
def top_best3(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    best, worst = counts.orderBy(F.desc("n"), "source").limit(10), counts.orderBy("n", "source").limit(3)
    return best.select(F.lit("top").alias("part"), "source", "n").unionAll(worst.select(F.lit("bottom"), "source", "n"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id OFFSET 20 LIMIT 30")
def top_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").offset(20).limit(30)


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn)[1:3], ',') AS roles FROM conversations GROUP BY conv_id")
def top_cut(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.slice(turns, 1, 3), lambda x: x["role"]), ",").alias("roles"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION SELECT doc_id, lang FROM documents WHERE n_chars > 500")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("doc_id", "lang").unionAll(docs.where("n_chars > 500").select("doc_id", "lang")).distinct()


@query("SELECT DISTINCT lang, source FROM documents")
def set_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE n_chars > 300 INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars > 300").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))
