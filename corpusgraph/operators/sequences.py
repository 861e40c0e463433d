"""Operators on ordered rows: predecessors, islands, carried values, budgets, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.operators import subwords

def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), line: the lines of each text; null text is one empty line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))


def repeats_previous(rows: DataFrame, value: str, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """rows with repeats: whether the value equals that of the row before."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("repeats", F.coalesce(F.col(value) == before, F.lit(False)))


def islands(rows: DataFrame, context: Column, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """rows with island (from 0): it grows wherever the context changes; null is a context."""
    at = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("context", context)
    rows = rows.withColumn("changes", (~F.col("context").eqNullSafe(F.lag("context").over(at)) & (F.row_number().over(at) > 1)).cast("long"))
    return rows.withColumn("island", F.sum("changes").over(at)).drop("changes")


def carried(rows: DataFrame, header: Column, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """rows with header: the last non-null header at or before the row."""
    return rows.withColumn("header", F.last(header, ignorenulls=True).over(W.partitionBy(key).orderBy(order)))


def tail_of_previous(rows: DataFrame, items: str, n: int, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """rows with overlap: the last n items of the row before, empty for the first."""
    before = F.lag(items).over(W.partitionBy(key).orderBy(order))
    tail = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n)
    return rows.withColumn("overlap", F.coalesce(tail, F.array().cast("array<string>")))


def within_budget(rows: DataFrame, text: str, budget: int, least: int = 50, key: str = "conv_id", order: str = "turn", counter: subwords.TokenCounter | None = None) -> DataFrame:
    """rows that fit in a budget of tokens, with kept. Tokens are counted by counter; by default, and where a text is cut, one is 4 code points.

    The row that crosses the budget is cut to what is left and marked by '...', if over least tokens are left;
    later rows go.
    """
    rows = subwords.count_tokens(rows, counter, text) if counter else rows.withColumn("tokens", F.floor(F.char_length(text) / 4).cast("long"))
    run = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    left = F.lit(budget) - (F.sum("tokens").over(run) - F.col("tokens"))
    rows = rows.withColumn("left", left).where((F.col("left") >= F.col("tokens")) | (F.col("left") > least))
    cut = F.concat(F.substring(text, F.lit(1), (F.col("left") * 4).cast("int")), F.lit("..."))
    return rows.withColumn("kept", F.when(F.col("tokens") <= F.col("left"), F.col(text)).otherwise(cut)).drop("left", "tokens")


def scaled(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """rows with size: the value scaled to low..high over all rows; low where all are equal. One pass for the ends, which are one row."""
    ends = rows.agg(F.min(value).alias("least"), F.max(value).alias("most"))
    share = F.when(F.col("most") > F.col("least"), (F.col(value) - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(0.0)
    return rows.join(F.broadcast(ends)).withColumn("size", F.round(F.lit(low) + share * (high - low), 6)).drop("least", "most")


def keep_first(rows: DataFrame, by: list[Column], order: str) -> DataFrame:
    """The first row (by order) of each group: an aggregate, combined before the shuffle, so a hot group costs no sort."""
    names = [f"_by{i}" for i in range(len(by))]
    keyed = rows.select(*[c.alias(n) for c, n in zip(by, names, strict=True)], F.struct(*rows.columns).alias("row"))
    return keyed.groupBy(*names).agg(F.min_by("row", F.col("row")[order]).alias("row")).select("row.*")
