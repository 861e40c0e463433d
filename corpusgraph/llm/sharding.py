"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.plans.scratch import Scratch

_UNIT = 2.0**-53


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Exponential race: each shard draws -ln(u) / weight for a key; the smallest wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard.cast("long")), 11).cast("double") + F.lit(0.5)) * F.lit(_UNIT)
    return -F.ln(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the winning shard. A shard more, or one less, moves only rows into or out of itself."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shares = F.array(*[F.lit(float(w)) for w in weights])
    draws = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(_score(key, s, F.get(shares, s)).alias("score"), s.alias("shard")))
    return F.array_min(draws)


def bucket_rows(rows: int, partitions: int, most: int = 1 << 16) -> int:
    """Rows of a bucket that one task sorts: few enough to spread over all partitions, most at most."""
    return max(64, min(most, rows // (8 * partitions)))


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law 'key', shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; null text has no bytes, and CRC-32 0. A null key is a key like any
    other. Rows of one key share a shard. slot numbers the rows of a shard from 0 without gaps, by hash bucket,
    then key, size and checksum. grown_shard is the shard after one of grown_weight was added. Other columns
    are ignored; an empty table gives no rows.

    Slots come from counts by bucket and a running sum over those counts, so no task sees a whole shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    n, doc = len(weights), F.col("doc_id")
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = plain.select("doc_id", (F.octet_length("text") + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), rendezvous(doc, weights).alias("best"))
    late = _score(doc, F.lit(n), F.lit(float(grown_weight)))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), F.when(late < F.col("best.score"), F.lit(n)).otherwise(F.col("best.shard")).alias("grown_shard"))
    rows = scratch.save(rows, "rows")
    buckets = max(1, rows.count() // (n * bucket_rows(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """Writes docs as Parquet under path/shard=N; each shard is dealt over files_per_shard files by hash of the key."""
    sharded = docs.withColumn("shard", rendezvous(F.col(key).cast("long"), weights)["shard"])
    part = F.pmod(F.xxhash64(F.lit("file"), F.col(key)), F.lit(files_per_shard))
    sharded.repartition(len(weights) * files_per_shard, "shard", part).write.partitionBy("shard").mode("overwrite").parquet(path)
