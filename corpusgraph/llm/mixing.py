"""Mixing sources to target weights: hash-random order, distributed prefix sums and an exact cut in each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.llm.sharding import bucket_rows
from corpusgraph.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: Column, text: Column, seed: int) -> Column:
    """60 bits of MD5 over the seed and the key, or where the key is null the text; the same on every run."""
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], share: float = 1.0, most: int = 3) -> DataFrame:
    """sources (source, source_size) with target: share of all sizes split by weight, most times a source's size at most.

    Weights repeat over the sources in code point order, null last. What a capped source can't take goes to the
    others by weight until none is above its cap: in the order of cap / weight, the capped sources are a prefix.
    One row per source is all that is ordered here.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    exact = "decimal(38,0)"
    s = sources.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), rank % len(weights)).cast(exact))
    s = s.withColumn("cap", (F.col("source_size") * most).cast(exact))
    everything = W.partitionBy()
    s = s.withColumn("budget", F.floor(F.sum("source_size").over(everything) * F.lit(share)).cast(exact))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(exact)
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("capped", F.col("cap") * left.cast(exact) <= F.col("weight") * (F.col("budget") - used))
    full = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    even = (F.col("weight") * (F.col("budget") - full)).cast("double") / open_weight.cast("double")
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(even)).drop("cap", "budget", "capped")


def mix_sources(docs: DataFrame, weights: Sequence[int], share: float = 1.0, most: int = 3, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    size is the number of words (null text: 0). Each source is read in hash-random order, whole epochs first,
    then up to the exact word at which its budget (the target, rounded down) ends: the sum of taken over a
    source is its budget, and only one document of a source is cut. Null source is a source of its own. Rows
    of one key are ordered by size; rows that are the same in both are interchangeable. A source without words
    has target 0. Other columns are ignored; an empty table gives no rows.

    The random keys are uniform, so equal ranges of them are equal shares of a source: a source is sorted in
    as many ranges as its rows need, and a running sum over the ranges' totals gives each its offset.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(_sized(docs, seed, key, text, source), "sized")
    rows = _placed(sized, sized, scratch, weights, share, most)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).cast("long").alias("taken"))


def _sized(docs: DataFrame, seed: int, key: str, text: str, source: str) -> DataFrame:
    return docs.select(*_columns(docs, seed, key, text, source))


def _placed(rows: DataFrame, sized: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """rows (which have sized's columns, and may have more) with source_size, target, epochs, and cut: the words taken after whole epochs."""
    n = sized.count()
    held = bucket_rows(n, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sources, weights, share, most)
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select(
        F.col("source").alias("name"), "source_size", "target", epochs.alias("epochs"), (whole - epochs * F.col("source_size")).alias("rest"), F.ceil(F.col("n") / held).cast("long").alias("ranges")
    )
    sources = scratch.save(sources, "sources")
    group = {"g": F.coalesce("source", F.lit("")), "g0": F.col("source").isNull(), "range": F.shiftright(F.shiftright("random", 28) * F.col("ranges"), 32)}

    def ranged(df: DataFrame) -> DataFrame:
        return df.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumns(group)

    sums = ranged(sized).groupBy(*group).agg(F.sum("size").alias("held"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("held").over(W.partitionBy("g", "g0").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("held")
    inner = W.partitionBy("g", "g0", "range").orderBy("random", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged(rows).withColumn("upto", F.sum("size").over(inner)).join(offsets, ["g", "g0", "range"])
    start = F.col("offset") + F.col("upto") - F.col("size")
    return placed.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start)))


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (n + 1).cast("int"))
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed_rows(docs: DataFrame, weights: Sequence[int], share: float = 1.0, most: int = 3, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns, whatever their names.

    A row comes once for each whole epoch of its source. In the last epoch each source is cut at its exact budget:
    the one document in which that ends comes with its text up to that word, so the words of a source's rows
    are its budget, rounded down. Its other columns are those of the whole document. Rows without words are taken by no
    mix and go. Nulls and repeated rows are as in mix_sources(); an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    sized = scratch.save(_sized(docs, seed, key, text, source), "sized")
    rows = docs.select(F.struct("*").alias("row"), *_columns(docs, seed, key, text, source))
    placed = _placed(rows, sized, scratch, weights, share, most).where("size > 0")
    size, cut, whole = F.col("size"), F.col("cut"), F.col(f"row.{text}")
    takes = F.concat(F.when(F.col("epochs") > 0, F.array_repeat(size, F.col("epochs").cast("int"))).otherwise(F.array().cast("array<bigint>")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    each = placed.select("row", "size", F.explode(takes).alias("take"))
    return each.select(*[F.when(F.col("take") < size, first_words(whole, F.col("take"))).otherwise(whole).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def _columns(docs: DataFrame, seed: int, key: str, text: str, source: str) -> list[Column]:
    doc, body = F.col(key).cast("long"), F.col(text)
    return [doc.alias("doc_id"), F.col(source).alias("source"), words(body).alias("size"), random_key(doc, body, seed).alias("random")]
