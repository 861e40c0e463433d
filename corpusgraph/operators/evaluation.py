"""Configuration grids, retrieval metrics and factor statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.functions import keys
from corpusgraph.operators import chunking, cleaning, models, search
from corpusgraph.plans.scratch import Scratch

#: Collections, the alpha grid, and what each strategy allows (alphas, reranking, collections).
COLLECTIONS = ("section", "semantic_std2", "semantic_std3", "contextual", "raptor")
DEDICATED = "graph_chunks"
ALPHAS = (0.0, 0.5, 1.0)
STRATEGIES = {"none": (None, "optional", None), "hyde": (1.0, "optional", None), "decomposition": (1.0, "required", None), "graph": (1.0, "forbidden", DEDICATED)}


def grid(spark: SparkSession) -> DataFrame:
    """strategy, collection, alpha, reranking and the first failing check of every combination; '' if valid. The grid is a fixed, small table."""
    every = spark.range(1, numPartitions=1)
    rules = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(a).cast("double").alias("fixed_alpha"), F.lit(r).alias("rerank_rule"), F.lit(o).cast("string").alias("only")) for s, (a, r, o) in STRATEGIES.items()])
    choices = {"rule": rules, "collection": F.array(*map(F.lit, (*COLLECTIONS, DEDICATED))), "alpha": F.array(*map(F.lit, ALPHAS)), "reranking": F.array(F.lit(True), F.lit(False))}
    for name, values in choices.items():
        every = every.withColumn(name, F.explode(values))
    every = every.select("rule.*", "collection", "alpha", "reranking")
    return every.select("strategy", "collection", "alpha", "reranking", fault(F.col("collection"), F.col("alpha"), F.col("reranking")).alias("fault"))


def fault(collection: Column, alpha: Column, reranking: Column) -> Column:
    wrong = F.when(F.col("only").isNull(), collection == DEDICATED).otherwise(collection != F.col("only"))
    return (
        F.when(wrong, "collection")
        .when(F.col("fixed_alpha").isNotNull() & (F.abs(alpha - F.col("fixed_alpha")) > 0.001), "alpha")
        .when((F.col("rerank_rule") == "required") & ~reranking | (F.col("rerank_rule") == "forbidden") & reranking, "reranking")
        .otherwise("")
    )


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, hit, mrr, ndcg, precision, recall at k, for each query of relevant (query_id, item_id); hits has query_id, item_id, rank."""
    found = relevant.join(hits.where(F.col("rank") <= k), ["query_id", "item_id"], "left")
    gain = 1 / F.log2(F.col("rank") + 1)
    out = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("got"), F.min("rank").alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return out.select(
        "query_id", (F.col("got") > 0).cast("int").alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.col("got") / k, 6).alias("precision"), F.round(F.col("got") / F.col("n"), 6).alias("recall"),
    )


def factor_stats(rows: DataFrame, factors: Sequence[str], score: str) -> DataFrame:
    """factor, level, mean, deviation (sample; 0 for one row), low, high, n: all factors in one pass by grouping sets."""
    sets = ", ".join(f"({f})" for f in factors)
    name = f"CASE {' '.join(f'WHEN grouping({f}) = 0 THEN {chr(39)}{f}{chr(39)}' for f in factors)} END"
    level = f"coalesce({', '.join(f'CAST({f} AS STRING)' for f in factors)})"
    return rows.sparkSession.sql(
        f"SELECT {name} AS factor, {level} AS level, round(avg({score}), 6) AS mean, round(coalesce(stddev_samp({score}), 0), 6) AS deviation, "
        f"min({score}) AS low, max({score}) AS high, count(*) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})",
        rows=rows,
    )


def difficulty(rows: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """difficulty ('unknown' for null), the means of the metrics' valid scores (numbers) to four digits, 0 where a group has none, and n."""
    means = []
    for m in metrics:
        number = F.col(m).cast("string").try_cast("double")
        means.append(F.coalesce(F.round(F.avg(F.when(keys.valid_score(F.col(m).cast("string")), number)), 4), F.lit(0.0)).alias(m))
    return rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias("difficulty")).agg(*means, F.count("*").alias("n"))


def effect_size(rows: DataFrame, factor: str, score: str) -> DataFrame:
    """effect: sample variance of the levels' means over that of all scores; 0 where either is missing or 0."""
    means = rows.groupBy(factor).agg(F.avg(score).alias("m")).agg(F.var_samp("m").alias("between"))
    whole = rows.agg(F.var_samp(score).alias("all"))
    return means.join(whole).select(F.lit(factor).alias("factor"), F.round(F.when(F.col("all") > 0, F.coalesce(F.col("between") / F.col("all"), F.lit(0.0))).otherwise(0.0), 6).alias("effect"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rho: correlation of average ranks, from counts by value, so equal values share a rank.

    Values are sorted in ranges, and a running sum over the ranges' totals gives each its offset, so no task sorts all values.
    """
    scratch = Scratch(rows.sparkSession, "spearman")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranked(of: str, name: str) -> DataFrame:
        counts = rows.groupBy(F.col(of).alias(f"v_{name}")).agg(F.count("*").alias("c"))
        # A table, so that ranges of values are the same wherever they are read.
        counts = scratch.save(counts.repartitionByRange(parts, f"v_{name}").withColumn("range", F.spark_partition_id()), name)
        before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
        offsets = counts.groupBy("range").agg(F.sum("c").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("offset"))
        upto = F.col("offset") + F.sum("c").over(W.partitionBy("range").orderBy(f"v_{name}"))
        return counts.join(F.broadcast(offsets), "range").select(f"v_{name}", (upto - (F.col("c") - 1) / 2).alias(name))

    both = rows.join(ranked(a, "ra"), F.col(a) == F.col("v_ra")).join(ranked(b, "rb"), F.col(b) == F.col("v_rb"))
    return both.agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def failure_stage(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(F.contains(low, F.lit("preprocessing")), "preprocessing")
        .when(F.contains(low, F.lit("retrieval")) | F.contains(low, F.lit("vector store")), "retrieval")
        .when(F.contains(low, F.lit("generation")), "generation")
        .otherwise("evaluation")
    )


def corrected(rows: DataFrame, config: str, score: str, single: Column) -> DataFrame:
    """config, overall, single, crossing, n: means of a score over all questions, single-topic ones and the others."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy(config).agg(
        mean(F.col(score)).alias("overall"), mean(F.when(single, F.col(score))).alias("single"), mean(F.when(~single, F.col(score))).alias("crossing"), F.count("*").alias("n")
    )


def gaps(means: DataFrame, config: str, most: int) -> DataFrame:
    """config, gap, percent of the most configurations with the smallest gap between single and crossing means."""
    rows = means.withColumn("gap", F.round(F.col("single") - F.col("crossing"), 6)).where("gap IS NOT NULL")
    percent = F.round(F.when(F.col("single") > 0, F.col("gap") / F.col("single") * 100).otherwise(0.0), 6)
    return rows.orderBy(F.abs("gap"), config).limit(most).select(config, "gap", percent.alias("percent"))


def served(hits: DataFrame, ks: Sequence[int], folder: str) -> DataFrame:
    """k, query_id, item_id, rank: hits kept once as a table in folder, and cut at each of ks from there, so that nothing is searched twice."""
    hits.write.mode("overwrite").parquet(folder)
    kept = hits.sparkSession.read.schema(hits.schema).parquet(folder)
    each = kept.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return each.where("rank <= k").select("k", "query_id", "item_id", "rank")


def correctness(answer: Column, reference: Column, a: Column, b: Column) -> Column:
    """0.75 of the F1 of distinct words of answer and reference, 0.25 of the cosine of their vectors a and b."""
    mine, wanted = F.array_distinct(search.tokens(answer)), F.array_distinct(search.tokens(reference))
    both = F.size(F.array_intersect(mine, wanted))
    f1 = F.when(both > 0, 2 * both / (F.size(mine) + F.size(wanted))).otherwise(0.0)
    return F.round(F.lit(0.75) * f1 + F.lit(0.25) * chunking.cosine(a, b), 6)


#: The share of a claim's words that one sentence of a context must hold, and of a reference's words that a context must hold to be of use.
SUPPORTED, USEFUL = 0.8, 0.5
#: Metrics that need a reference answer.
REFERENCED = ("context_precision", "correctness")


def faithfulness(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, claims, faithfulness of answers (query_id, answer) by contexts (query_id, text): the share of an answer's sentences that a sentence of its contexts supports.

    Citations don't count as words. Answers without a sentence of words have no row; a query without contexts has 0.
    """
    bare = F.regexp_replace("answer", r"\s*\[\d+\]", "")
    claims = answers.select("query_id", F.posexplode(cleaning.sentences(bare)).alias("nth", "claim")).select("query_id", "nth", F.array_distinct(search.tokens(F.col("claim"))).alias("words")).where(F.size("words") > 0)
    said = contexts.select("query_id", F.explode(cleaning.sentences(F.col("text"))).alias("sentence")).select("query_id", search.tokens(F.col("sentence")).alias("held"))
    share = F.size(F.array_intersect("words", "held")) / F.size("words")
    best = claims.join(said, "query_id", "left").groupBy("query_id", "nth").agg(F.max(share).alias("best"))
    supported = F.when(F.coalesce("best", F.lit(0.0)) >= SUPPORTED, 1.0).otherwise(0.0)
    return best.groupBy("query_id").agg(F.count("*").alias("claims"), F.round(F.avg(supported), 6).alias("faithfulness"))


def context_precision(hits: DataFrame, references: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, context_precision of hits (query_id, item_id, rank): the mean precision at the ranks of contexts that are of use for the reference (query_id, reference); 0 where none is."""
    pairs = hits.select("query_id", "item_id", "rank").join(references.where("reference IS NOT NULL"), "query_id").join(items.select("item_id", "text"), "item_id")
    useful = pairs.select("query_id", "rank", (search.overlap_score(F.col("reference"), F.col("text")) >= USEFUL).cast("int").alias("v"))
    upto = F.sum("v").over(W.partitionBy("query_id").orderBy("rank")) / F.count("*").over(W.partitionBy("query_id").orderBy("rank"))
    each = useful.withColumn("p", upto * F.col("v"))
    return each.groupBy("query_id").agg(F.round(F.when(F.sum("v") > 0, F.sum("p") / F.sum("v")).otherwise(0.0), 6).alias("context_precision"))


def judged(questions: DataFrame, answers: DataFrame, hits: DataFrame, items: DataFrame, metrics: Sequence[str] = ("faithfulness", "relevancy", *REFERENCED)) -> DataFrame:
    """query_id and the metrics of questions (query_id, query, reference): answers (query_id, answer) by hits (query_id, item_id, rank) among items.

    Metrics that need a reference are left out unless every question has one. relevancy is the cosine of the answer's and the question's vectors.
    """
    if questions.where("reference IS NULL").take(1):
        metrics = [m for m in metrics if m not in REFERENCED]
    out = questions.select("query_id")
    contexts = hits.join(items.select("item_id", "text"), "item_id").select("query_id", "text")
    for name in metrics:
        if name == "faithfulness":
            one = faithfulness(answers, contexts).drop("claims")
        elif name == "context_precision":
            one = context_precision(hits, questions.select("query_id", "reference"), items)
        elif name in ("relevancy", "correctness"):
            other = "query" if name == "relevancy" else "reference"
            rows = models.embed(models.embed(answers.join(questions, "query_id"), text="answer", into="a"), text=other, into="b")
            score = F.round(chunking.cosine(F.col("a"), F.col("b")), 6) if name == "relevancy" else correctness(F.col("answer"), F.col("reference"), F.col("a"), F.col("b"))
            one = rows.select("query_id", score.alias(name))
        else:
            raise ValueError(f"unknown metric {name}")
        out = out.join(one, "query_id", "left")
    return out.na.fill(0.0, list(metrics))


def run(results: DataFrame, relevant: DataFrame, k: int, configs: DataFrame | None = None) -> DataFrame:
    """config, the means of all retrieval metrics, n: results is (config, query_id, item_id, rank); queries without a relevant item aren't scored.

    configs (config) are scored even if they have no results; without it, those that results hold.
    """
    configs = results.select("config").distinct() if configs is None else configs
    named = relevant.join(F.broadcast(configs)).select(F.struct("config", "query_id").alias("query_id"), "item_id")
    scores = retrieval_metrics(results.select(F.struct("config", "query_id").alias("query_id"), "item_id", "rank"), named, k)
    mean = [F.round(F.avg(c), 6).alias(c) for c in ("hit", "mrr", "ndcg", "precision", "recall")]
    return scores.groupBy(F.col("query_id.config").alias("config")).agg(*mean, F.count("*").alias("n"))


def retried(first: DataFrame, again: DataFrame) -> DataFrame:
    """id, tries, stage, answer: what a second run (id, text) made of the failures of the first (id, text, error); stage tells where the first failed."""
    both = first.join(again.select("id", F.col("text").alias("second")), "id", "left")
    failed = F.col("error").isNotNull()
    return both.select("id", F.when(failed, 2).otherwise(1).alias("tries"), F.when(failed, failure_stage(F.col("error"))).alias("stage"), F.coalesce("text", "second").alias("answer"))


def report(means: DataFrame, title: str) -> DataFrame:
    """pos, line: a report in markdown of means (config, score, n): a table of all configurations, best first. One row per configuration is all that is ordered."""
    order = W.orderBy(F.desc("score"), "config")
    row = F.format_string("| %d | %s | %.4f | %d |", F.row_number().over(order), "config", "score", "n")
    body = means.select((F.row_number().over(order) + 3).alias("pos"), row.alias("line"))
    spark = means.sparkSession
    head = spark.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| Place | Configuration | Score | Questions |"), (3, "|---|---|---|---|")], "pos int, line string")
    return head.unionAll(body)


def analyzed(rows: DataFrame, factors: Sequence[str], score: str, single: Column) -> DataFrame:
    """type, factor, level, mean, deviation, n, effect for all questions, single-topic ones and the others; effect is the factor's, as in effect_size()."""
    out = None
    for name, mine in (("overall", rows), ("single", rows.where(single)), ("cross", rows.where(~single))):
        effects = None
        for f in factors:
            one = effect_size(mine, f, score)
            effects = one if effects is None else effects.unionAll(one)
        stats = factor_stats(mine, factors, score).select("factor", "level", "mean", "deviation", "n").join(F.broadcast(effects), "factor")
        stats = stats.select(F.lit(name).alias("type"), "factor", "level", "mean", "deviation", "n", "effect")
        out = stats if out is None else out.unionAll(stats)
    return out
