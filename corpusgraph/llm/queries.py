"""The registered queries of this subpackage: thin uses of its operators on whole tables, and SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import language_id, pieces, quality, secrets, warc
from corpusgraph.llm.exact_dedup import exact_dedup
from corpusgraph.llm.filter_audit import audit
from corpusgraph.llm.hard_negatives import mine
from corpusgraph.llm.jaccard_join import near_classes
from corpusgraph.llm.line_dedup import line_dedup
from corpusgraph.llm.mixing import mix_sources
from corpusgraph.llm.sharding import assign_shards
from corpusgraph.llm.substring_dedup import substring_digests
from corpusgraph.plans.session import table

SHARDS, SOURCE_WEIGHTS = 24, (5, 2, 1)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, length(body) AS n_chars,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256, n_chars::BIGINT AS n_chars FROM w
"""


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    place = F.array(*[F.lit(k) for k in secrets.KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    ordered = F.array_sort(F.transform(F.concat("base_spans", "linked_spans"), lambda x: F.struct(x["start"], F.array_position(place, x["kind"]).alias("place"), x["end"], x["kind"])))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(F.col("base_spans")), 256).alias("base_sha256"), told(ordered).alias("spans"),
        F.size("linked_spans").cast("long").alias("n_linked"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS random FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT]::HUGEINT AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight FROM w
        WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * rest_weight <= weight * (budget - used) AS capped FROM o),
f AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        (weight * (budget - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
e AS (SELECT *, floor(target)::BIGINT AS whole, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM f),
p AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, e.whole - e.epochs * e.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.random, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
        FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM p
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM (SELECT v.doc_id, v.i FROM v JOIN f USING (h) WHERE v.doc_id > f.least)),
g AS (SELECT doc_id, list(i) AS cut FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM g)),
x AS (SELECT doc_id, count(*) AS kept, string_agg(w[i], ' ' ORDER BY i) AS t FROM k ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, CASE WHEN g.doc_id IS NULL THEN 0 ELSE len(g.cut) END::BIGINT AS n_removed,
  sha256(CASE WHEN g.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(x.t, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), count_links=False).select("doc_id", "n_shingles", "component_id")


OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT u AS node, v AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(seen) FROM r WHERE r.node = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op8() -> str:
    tests = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {c}::DOUBLE AS cutoff" for r in quality.RULES for c in r.cutoffs)
    feature = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.feature}" for r in quality.RULES) + " END"
    number, p = sum(len(r.cutoffs) for r in quality.RULES), 0.05 / len(quality.RULES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM v) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM a, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
g AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
c AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (({feature}) > cutoff) AS k FROM b JOIN g USING (doc_id), ({tests}) WHERE NOT base_failed GROUP BY ALL),
q AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range(0, k + 1) AS t(i)) AS chance FROM c WHERE k < n * {p}),
s AS (SELECT lang, rule, min(cutoff) AS cutoff FROM q WHERE chance <= 0.05 / {number} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM b)) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM s WHERE s.lang IS NOT DISTINCT FROM b.lang AND ({feature}) > s.cutoff) AS kept FROM b
"""


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM q
"""


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's labels change where vec_id is divisible by 7, and its components are scaled to whole numbers, before mining."""
    items = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(items.withColumn("label", label), anchors=F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=5, percent=80)


OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12 = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, coalesce(doc_id < last, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails,
      doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS it, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) AS r(step)),
e AS (SELECT part, filter_order, step, it, n, good, toxic, fails, contains(fails, it) AS failing, translate(fails, before, '') <> fails AS early FROM c, s),
r AS (SELECT part, filter_order, step, it, sum(n) FILTER (NOT failing AND NOT early) AS kept, sum(n) FILTER (failing AND NOT early) AS removed, sum(n) FILTER (failing AND early) AS redundant,
      sum(n) FILTER (fails = it) AS unique_fails, sum(good) FILTER (failing AND NOT early) AS good_lost, sum(toxic) FILTER (failing AND NOT early) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, it), 0)::BIGINT AS shapley FROM r
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_rendezvous_sharding,
        op3_substring_dedup,
        op4_secret_scan,
        op5_source_mixing,
        op6_jaccard_join,
        op7_language_id,
        op8_quality_rules,
        op9_warc_round_trip,
        op10_piece_sampling,
        op11_hard_negatives,
        op12_line_dedup,
        op13_filter_audit,
    )
}
ORACLES = {"op1_exact_dedup": OP1, "op3_substring_dedup": OP3, "op5_source_mixing": OP5, "op6_jaccard_join": OP6, "op8_quality_rules": _op8(), "op9_warc_round_trip": OP9, "op11_hard_negatives": OP11, "op12_line_dedup": OP12, "op13_filter_audit": OP13}
