"""Deterministic keys, names and parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """UUID version 5 of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def collection_name(strategy: Column, model: str = "embed3large", version: str = "v1", prefix: str = "RAG_") -> Column:
    return F.concat(F.lit(prefix), F.replace(strategy, F.lit("."), F.lit("_")), F.lit(f"_{model}_{version}"))


def strategy_of(collection: Column) -> Column:
    """The strategy that a collection name was made from; 'unknown' for other names."""
    rest = F.split(F.substring(collection, 5, 1 << 20), "_")
    std = F.regexp_extract(collection, r"^RAG_(semantic_std\d+)_", 1)
    number = F.regexp_extract(collection, r"^RAG_semantic_(\d+_\d+)_", 1)
    return (
        F.when(~F.startswith(collection, F.lit("RAG_")) | (F.size(rest) < 3), "unknown")
        .when(std != "", std)
        .when(number != "", F.concat(F.lit("semantic_"), F.replace(number, F.lit("_"), F.lit("."))))
        .otherwise(F.get(rest, 0))
    )


def citations(answer: Column, most: Column) -> Column:
    """Sorted distinct [n] marks from 1 to most."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,9})\]")), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most))))


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```(json)?\s*", ""), r"\s*```\s*$", "")


def valid_score(score: Column) -> Column:
    number = score.try_cast("double")
    return number.isNotNull() & ~F.isnan(number)


def semantic_folder(coefficient: Column) -> Column:
    """semantic_std and the coefficient with at most two decimals, without trailing zeros."""
    return F.concat(F.lit("semantic_std"), F.regexp_replace(F.format_string("%.2f", coefficient.cast("double")), r"\.?0+$", ""))


def safe_name(name: Column) -> Column:
    """name without what could leave a folder: separators and runs of dots become underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\]+", "_"), r"\.{2,}", "_")


#: Names of the chunking strategies.
DISPLAY_NAMES = {"section": "Section-Based Chunking", "contextual": "Contextual Chunking", "raptor": "RAPTOR (Hierarchical)"}


def display_name(strategy: Column) -> Column:
    out = F.when(F.lit(False), "")
    for key, name in DISPLAY_NAMES.items():
        out = out.when(strategy == key, name)
    std = F.regexp_extract(strategy, r"^semantic_std([0-9]+)$", 1)
    other = F.regexp_extract(strategy, r"^semantic_(.*)$", 1)
    told = lambda x, unit: F.concat(F.lit("Semantic ("), x, F.lit(f"{unit})"))
    return out.when(std != "", told(std, " std")).when(F.startswith(strategy, F.lit("semantic_")), told(other, "")).otherwise(F.initcap(F.replace(strategy, F.lit("_"), F.lit(" "))))


def stamp(time: Column) -> Column:
    """ISO string of a time, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def stamped(text: Column) -> Column:
    """The time of an ISO string; null for other strings."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def elapsed_seconds(begin: Column, end: Column) -> Column:
    """Seconds between two ISO strings."""
    return F.unix_timestamp(stamped(end)) - F.unix_timestamp(stamped(begin))


def merged_counts(rows: DataFrame, key: str, counts: str) -> DataFrame:
    """key and a map with the sums of all its maps' values, which are added before the shuffle."""
    each = rows.select(key, F.explode(counts).alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias(counts))
