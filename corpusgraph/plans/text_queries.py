"""Queries of the cleaning, segmentation and chunking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import surface
from corpusgraph.operators import boundaries, chunking, cleaning, subwords
from corpusgraph.plans.registry import query
from corpusgraph.plans.scratch import Scratch
from corpusgraph.plans.session import table
from corpusgraph.sources.collections import Collection
from corpusgraph.streaming import ingest


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DROP = " OR ".join(f"regexp_matches(x, {_quoted(p)})" for p in cleaning.LINE_PATTERNS.values())
_SPLIT = "string_split(coalesce(text, ''), chr(10))"
_TRAIL = r"""([.!?"'])\s+\d+\s+([A-Z])"""
_INLINE = rf"regexp_replace(regexp_replace(regexp_replace(%s, {_quoted(cleaning.FIGURE_REF)}, '', 'g'), {_quoted(cleaning.FOOTNOTE)}, '', 'g'), {_quoted(_TRAIL)}, '\1 \2', 'g')"
_SUBST = "replace(replace(%s, '/u2014.d', '--'), '/u2014', '--')"
_HYPHEN = r"regexp_replace(%s, '([\p{L}\p{N}_]+)-\s+([\p{L}\p{N}_]+)', '\1-\2', 'g')"
_SPACE = r"regexp_replace(regexp_replace(%s, ' +', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: " + _SPACE % "x" + "), lambda x: x <> '')"


@query(f"SELECT doc_id, array_to_string(list_filter({_SPLIT}, lambda x: NOT ({_DROP})), chr(10)) AS text FROM documents")
def cln_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.remove_artifact_lines(F.col("text")).alias("text"))


@query(rf"""WITH l AS (SELECT doc_id, {_SPLIT} AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: NOT (regexp_matches(x, '^\s*\([a-z]\)\s+') AND i > 1 AND regexp_matches(trim(coalesce(l[i - 1], '')), '[.!?"]$'))), chr(10)) AS text FROM l""")
def cln_markers(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.remove_list_markers(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_SUBST % 'text'} AS text FROM documents")
def cln_subst(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.substitute(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_INLINE % 'text'} AS text FROM documents")
def cln_inline(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.remove_inline(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_HYPHEN % 'text'} AS text FROM documents")
def cln_hyphen(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.join_hyphens(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_SPACE % 'text'} AS text FROM documents")
def cln_space(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.squeeze(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_SPACE % (_HYPHEN % (_INLINE % (_SUBST % 'text')))} AS text FROM documents")
def cln_inline_all(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.clean_inline(F.col("text")).alias("text"))


_PARA = rf"""l AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, {_SPLIT} AS l FROM documents)),
s AS (SELECT doc_id, pos, {_SPACE % 'line'} AS line FROM l),
w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM s WHERE line <> ''),
n AS (SELECT *, CASE WHEN last IS NULL OR (regexp_matches(last, '[.!?:;"]$') AND NOT regexp_matches(line, '^\p{{Ll}}')) THEN 1 ELSE 0 END AS new FROM w),
p AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS para FROM n)"""


@query(f"WITH {_PARA} SELECT doc_id, para, string_agg(line, ' ' ORDER BY pos) AS text FROM p GROUP BY doc_id, para")
def cln_para(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.consolidate(_docs(spark, d))


@query(f"""WITH {_PARA}, g AS (SELECT doc_id, para, string_agg(line, ' ' ORDER BY pos) AS text FROM p GROUP BY doc_id, para)
SELECT doc_id, para, {_SPACE % (_HYPHEN % (_INLINE % (_SUBST % 'text')))} AS text FROM g AS g(doc_id, para, text) WHERE NOT ({_DROP.replace('(x,', '(text,')})""")
def cln_pipeline(spark: SparkSession, d: str) -> DataFrame:
    para = cleaning.consolidate(_docs(spark, d)).where(cleaning.artifact(F.col("text")).isNull())
    return para.select("doc_id", "para", cleaning.clean_inline(F.col("text")).alias("text"))


@query(f"""WITH l AS (SELECT unnest({_SPLIT}) AS x FROM documents)
SELECT CASE {' '.join(f"WHEN regexp_matches(x, {_quoted(p)}) THEN '{n}'" for n, p in cleaning.LINE_PATTERNS.items())} ELSE 'KEPT' END AS pattern, count(*) AS lines FROM l GROUP BY 1""")
def cln_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.explode(cleaning.lines(F.col("text"))).alias("x"))
    return rows.groupBy(F.coalesce(cleaning.artifact(F.col("x")), F.lit("KEPT")).alias("pattern")).agg(F.count("*").alias("lines"))


@query(f"""SELECT count(*) AS documents, sum(len(regexp_extract_all(text, {_quoted(cleaning.FIGURE_REF)})))::BIGINT AS figure_refs,
sum(len(regexp_extract_all(text, {_quoted(cleaning.FOOTNOTE)})))::BIGINT AS footnotes FROM documents""")
def agg_clean(spark: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p))).cast("long")
    return _docs(spark, d).agg(F.count("*").alias("documents"), count(cleaning.FIGURE_REF).alias("figure_refs"), count(cleaning.FOOTNOTE).alias("footnotes"))


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS at, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def seg_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(cleaning.sentences(F.col("text"))).alias("at", "sentence")).withColumn("at", F.col("at").cast("long"))


_CORE = rf"regexp_replace(regexp_replace(%s, {_quoted(boundaries.CLOSERS)}, ''), {_quoted(boundaries.QUOTES)}, '')"
_LIKE = "(%s * ln(greatest(1e-12, least(%s, 1 - 1e-12))) + (%s - %s) * ln(1 - greatest(1e-12, least(%s, 1 - 1e-12))))"


@query(rf"""WITH w AS (SELECT {_CORE % 'w'} AS c FROM (SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents)),
t AS (SELECT regexp_replace(lower(c), '[.,;:!?…]+$', '') AS type, regexp_matches(c, '\.$') AND NOT regexp_matches(c, '([!?…]|\.\.)$') AS dot FROM w),
c AS (SELECT type, count(*) AS n, count_if(dot)::BIGINT AS dotted, length(regexp_replace(type, '[^\p{{L}}]', '', 'g'))::DOUBLE AS letters, length(type) - length(replace(type, '.', '')) AS inside FROM t GROUP BY type),
p AS (SELECT sum(dotted)::DOUBLE / sum(n) AS p FROM c),
s AS (SELECT type, n, dotted, -2 * ({_LIKE % ('dotted', 'p', 'n', 'dotted', 'p')} - {_LIKE % ('dotted', '0.99::DOUBLE', 'n', 'dotted', '0.99::DOUBLE')}) * exp(-letters) * (inside + 1) * pow(letters, -(n - dotted)) AS x FROM c, p WHERE dotted > 0 AND letters > 0)
SELECT type, n, dotted, CASE WHEN x > 0 THEN round(x, 6) ELSE 0 END AS score, x >= 0.3 AS abbreviation FROM s""")
def seg_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Types that stand before a period, and which of them counts tell to be abbreviations."""
    counts = boundaries.type_counts(boundaries.lone_words(_docs(spark, d), "text"))
    return boundaries.abbreviations(Scratch(spark, "types").save(counts, "counts"))  # read twice, for totals and for scores


@query()
def seg_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by boundaries learnt from the same texts; held against texts of known boundaries in tests."""
    docs = _docs(spark, d)
    return boundaries.Boundaries.learn(docs).split(docs).select("doc_id", F.posexplode("sentences").alias("at", "sentence"))


@query(rf"""SELECT doc_id, coalesce(CASE WHEN len(regexp_split_to_array(x, '\s+')) < 2 THEN 'Too short' WHEN regexp_matches(x, '^\p{{Ll}}') THEN 'Starts lowercase'
WHEN NOT regexp_matches(x, '[.?!")\]]$') THEN 'No terminal punctuation' END, 'kept') AS reason, count(*) AS n FROM (SELECT doc_id, unnest({_SENTENCES}) AS x FROM documents) GROUP BY ALL""")
def seg_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.explode(cleaning.sentences(F.col("text"))).alias("x"))
    return rows.groupBy("doc_id", F.coalesce(cleaning.sentence_fault(F.col("x")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, concat_ws(' > ', source, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'S' || doc_id END) AS context FROM documents")
def seg_context(spark: SparkSession, d: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("S"), F.col("doc_id")))
    return _docs(spark, d).select("doc_id", cleaning.context_of(F.col("source"), F.col("lang"), section).alias("context"))


@query("SELECT doc_id, trim(string_split(source || ' > ' || lang, '>')[-1]) AS section FROM documents")
def seg_section(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", cleaning.section_of(F.concat_ws(" > ", "source", "lang")).alias("section"))


_TAGS = "script|style|nav|header|footer|table|figure"
_MARKDOWN = "html"
for _tag in _TAGS.split("|"):
    _MARKDOWN = rf"regexp_replace({_MARKDOWN}, '(?is)<{_tag}\b.*?</{_tag}>', ' ', 'g')"


@query(rf"""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKDOWN}, '(?i)<h1\b[^>]*>', chr(10) || '# ', 'g'), '(?i)<h[2-6]\b[^>]*>', chr(10) || '## ', 'g'),
  '(?i)</(h[1-6]|p|div|li|ul|title|head)>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS text FROM pages),
l AS (SELECT page_id AS book, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT page_id, {_SPLIT} AS l FROM m)),
s AS (SELECT book, pos, {_SPACE % 'line'} AS line FROM l),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^#( |$)') THEN {_SPACE % "regexp_replace(line, '^#+', '')"} END AS c, CASE WHEN regexp_matches(line, '^##') THEN {_SPACE % "regexp_replace(line, '^#+', '')"} END AS sec FROM s WHERE line <> ''),
n AS (SELECT *, count(c) OVER o AS number, coalesce(last_value(c IGNORE NULLS) OVER o, 'Unknown Chapter') AS chapter FROM h WINDOW o AS (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY book, number ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM n)
SELECT book, pos, concat_ws(' > ', book::VARCHAR, chapter, section) AS context, line AS text FROM x WHERE NOT regexp_matches(line, '^#')""")
def seg_document(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", cleaning.markdown_of_html(F.col("html")).alias("text"))
    return cleaning.segment_document(pages, "page_id", "text").withColumn("at", F.col("at").cast("long")).withColumnRenamed("at", "pos")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::INT AS tokens FROM documents")
def chk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", chunking.token_count(F.col("text")).alias("tokens"))


@query()
def chk_subwords(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a byte-pair vocabulary; held against a plain merge loop in tests."""
    return subwords.count_tokens(_docs(spark, d), subwords.BytePairs.read(spark)).select("doc_id", "tokens")


@query()
def chk_section_subwords(spark: SparkSession, d: str) -> DataFrame:
    """chk_section by tokens of a byte-pair vocabulary."""
    return chunking.pack_sentences(_docs(spark, d), most=400, counter=subwords.BytePairs.read(spark))


_PACK = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
t AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_split_to_array(x, '\s+'))) AS t FROM d WHERE len(s) > 0),
p AS (SELECT doc_id, s, list_transform(range(0, len(t) + 1), lambda i: coalesce(list_sum(t[1:i]), 0)::INT) AS p FROM t),
r AS (SELECT doc_id, 0 AS i, 0 AS b, NULL::INT AS b0 FROM p UNION ALL
  SELECT r.doc_id, r.i + 1, CASE WHEN p.p[r.i + 3] - p.p[r.b + 1] > 200 THEN CASE WHEN p.p[r.i + 3] - p.p[greatest(r.b, r.i - 1) + 1] > 200 THEN r.i + 1 ELSE greatest(r.b, r.i - 1) END ELSE r.b END,
  CASE WHEN p.p[r.i + 3] - p.p[r.b + 1] > 200 THEN r.b END FROM r JOIN p USING (doc_id) WHERE r.i + 1 < len(p.s)),
c AS (SELECT doc_id, b0 AS first, i - 1 AS last FROM r WHERE b0 IS NOT NULL UNION ALL SELECT r.doc_id, r.b, r.i FROM r JOIN p USING (doc_id) WHERE r.i = len(p.s) - 1),
k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY last) - 1)::INT AS chunk, first, last FROM c),
x AS (SELECT k.doc_id, chunk, first, last, p.p[last + 2] - p.p[first + 1] AS tokens, array_to_string(p.s[first + 1:last + 1], ' ') AS text FROM k JOIN p USING (doc_id)) """


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack_sentences(_docs(spark, d), most=200)


@query(_PACK + "SELECT doc_id, chunk, first, last, tokens, text FROM x")
def chk_section(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d)


@query(_PACK + "SELECT doc_id, chunk, first, last, tokens, text FROM x")
def udtf_section(spark: SparkSession, d: str) -> DataFrame:
    """chk_section from SQL text: a table function over the sentences of each document, with helpers by name."""
    surface.register(spark)
    return spark.sql(
        "SELECT key AS doc_id, chunk, first, last, tokens, text FROM section_chunks(TABLE(SELECT doc_id, pos, sentence FROM (SELECT doc_id, text_sentences(text) AS every FROM {docs}) LATERAL VIEW posexplode(every) AS pos, sentence) PARTITION BY doc_id ORDER BY (pos), 200, 2)",
        docs=_docs(spark, d),
    )


_INGESTED = rf"(SELECT doc_id, {_SPACE % (_HYPHEN % (_INLINE % "coalesce(text, '')"))} AS text FROM documents)"


@query(_PACK.replace("FROM documents)", f"FROM {_INGESTED})", 1) + "SELECT doc_id, chunk, tokens, md5(text) AS text FROM x")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream, each twice, cleaned and chunked into a stored collection."""
    scratch = Scratch(spark, "ingest")
    docs = _docs(spark, d).select("doc_id", "text", F.timestamp_seconds(F.lit(1_000_000)).alias("ts"))
    docs.unionAll(docs).write.parquet(scratch.path("docs"))
    stored = Collection(spark, scratch.path("stored"), "chunks", ingest.FIELDS)
    ingest.ingest(spark.readStream.schema(docs.schema).parquet(scratch.path("docs")), stored, scratch.path("state"), most=200)
    return stored.rows().select("doc_id", "chunk", "tokens", F.md5("text").alias("text"))


@query(_PACK + "SELECT count(*) AS chunks, round(avg(tokens), 6) AS mean_tokens, median(tokens)::DOUBLE AS median_tokens, count(*) FILTER (chunk = 0) AS documents FROM x")
def chk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return c.agg(F.count("*").alias("chunks"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.percentile("tokens", F.lit(0.5)).alias("median_tokens"), F.count_if(F.col("chunk") == 0).alias("documents"))


_DOT = "list_sum(list_transform(list_zip(%s, %s), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"{_DOT % ('a', 'b')} / (sqrt({_DOT % ('a', 'a')}) * sqrt({_DOT % ('b', 'b')}))"


@query(f"""WITH l AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT vec_id, label, CASE WHEN b IS NOT NULL THEN {_COS} END AS similarity FROM l),
c AS (SELECT *, avg(similarity) OVER (PARTITION BY label) - 1.5 * stddev_pop(similarity) OVER (PARTITION BY label) AS cut FROM s)
SELECT vec_id, label, round(similarity, 6) AS similarity, similarity IS NULL OR similarity < cut AS breaks FROM c""")
def chk_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.similarity_breaks(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 1.5)
    return rows.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "breaks")


@query(r"SELECT doc_id, CASE WHEN s = '' THEN text ELSE '[' || s || '] ' || text END AS text FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^[^\n.!?]*', 0) AS s FROM documents)")
def chk_contextual(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", chunking.contextual(F.regexp_extract(text, r"^[^\n.!?]*", 0), text).alias("text"))
