"""Query logs, traces, finished combinations and run histories as append-only files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERY = "id long, rank int, stage string, query string, score double"
_TRACE = "question long, strategy string, reranking boolean, scores map<string, double>, failed map<string, string>"


def append_queries(rows: DataFrame, folder: str) -> None:
    """Appends rows (id, rank, stage, query, score) as JSON lines; scores have four decimals. Runs only add files, so nothing is read again."""
    rows.select("id", "rank", "stage", "query", F.round("score", 4).alias("score")).write.mode("append").json(folder)


def read_queries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_QUERY).json(folder)


def write_traces(rows: DataFrame, folder: str) -> None:
    """Writes rows (question, strategy, reranking, score, failure) as JSON traces; fields that are null are left out."""
    scores = F.when(F.col("score").isNotNull(), F.create_map(F.lit("score"), "score"))
    failed = F.when(F.col("failure").isNotNull(), F.create_map(F.lit("score"), "failure"))
    rows.select("question", "strategy", "reranking", scores.alias("scores"), failed.alias("failed")).write.mode("overwrite").json(folder)


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """question, strategy, reranking (false where a trace lacks it), score, failure."""
    rows = spark.read.schema(_TRACE).json(folder)
    return rows.select("question", "strategy", F.coalesce("reranking", F.lit(False)).alias("reranking"), F.col("scores")["score"].alias("score"), F.col("failed")["score"].alias("failure"))


def save_finished(combinations: DataFrame, folder: str) -> None:
    combinations.write.mode("append").parquet(folder)


def unfinished(rows: DataFrame, spark: SparkSession, folder: str, key: list[str]) -> DataFrame:
    """Rows whose combination no checkpoint in folder tells as finished; combinations saved twice count once."""
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*key).dtypes)
    return rows.join(spark.read.schema(kinds).parquet(folder), key, "left_anti")


def append_history(lines: DataFrame, folder: str) -> None:
    lines.select("value").write.mode("append").text(folder)


def next_run(spark: SparkSession, folder: str) -> DataFrame:
    """next_run: one more than the largest number in a heading '## Run N'; 1 for an empty history."""
    number = F.regexp_extract("value", r"^## Run (\d+)", 1).try_cast("int")
    return spark.read.text(folder).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_run"))
