"""Audit of filters that are applied in some order: what each removes first, in vain, alone, and at which cost in labelled documents.

Each document has a mask of the filters that it fails. For a part and label, 2**n signed parity sums (one for each
set of filters: documents that fail an even number of its filters minus those that fail an odd number) hold the same
as the counts of all masks; the inverse Walsh-Hadamard transform gives those counts exactly. Every order of the
filters is then evaluated on the counts, so that documents are read once, whatever the number of orders.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
FILTERS = "ABCDE"
LABELS = ("all", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions on which a text fails A to D; text without nulls."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, part, mask (bit i: fails FILTERS[i]), good, toxic.

    Null text is empty, null part the empty string. E fails if the whole text equals that of a smaller key anywhere
    in the table; a null key is neither smaller nor larger than another, and rows of one key don't fail for each
    other. A key with several labels is good (toxic) if one of them says so; a null key has none. Texts meet by their
    SHA-256; the copies of a text are counted within each task first, and the join that tells them their least key
    reads two plain tables, so that a text which many rows share can be split over tasks.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    fails = text_failures(F.col("body"))
    mask = sum((F.when(fails[x], 1 << i).otherwise(0) for i, x in enumerate(FILTERS[:-1])), F.lit(0))
    slim = scratch.save(plain.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest")), "slim")
    first = scratch.save(slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"), "first")
    marks = labels.select(F.col("doc_id").cast("long").alias("labelled"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = scratch.save(marks.where("labelled IS NOT NULL").groupBy("labelled").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "marks")
    copies = slim.join(first, "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("least") < F.col("doc_id"), 1 << len(FILTERS) - 1).otherwise(0))
    joined = copies.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    return joined.select("doc_id", "part", "mask", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])


def parity_sums(masks: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part, and for each label an array of the 2**n signed parity sums of its documents."""

    def sums(label: str) -> Column:
        sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
        of = (lambda x: x) if label == "all" else (lambda x: F.when(F.col(label), x).otherwise(0))
        return F.array(*[F.sum(of(sign(s)).cast("long")) for s in range(1 << n)]).alias(label)

    return masks.groupBy("part").agg(*[sums(x) for x in LABELS])


def mask_cells(sums: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part, mask, and the number of documents of each label with just that mask; one row for every mask."""
    terms = sums.select("part", F.posexplode(F.arrays_zip(*LABELS)).alias("s", "w")).select("part", "s", "w.*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("mask"))
    sign = 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.col("s"))) % 2)
    # The sums of 2**n terms are multiples of 2**n; shifting keeps them whole numbers.
    return terms.groupBy("part", "mask").agg(*[F.shiftright(F.sum(sign * F.col(x)), n).alias(x) for x in LABELS])


def order_steps(names: str = FILTERS) -> list[dict]:
    """Every order of the filters and step: the bit of its filter, and those of the filters before."""
    bit = {x: 1 << i for i, x in enumerate(names)}
    return [{"filter_order": "".join(o), "step": k + 1, "bit": bit[x], "before": sum(bit[y] for y in o[:k])} for o in itertools.permutations(names) for k, x in enumerate(o)]


def evaluate_orders(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document that fails f filters is removed by each of them in n! / f of the orders, which gives shapley without
    a sum over orders.
    """
    steps = F.from_json(F.lit(json.dumps(order_steps(names))), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = cells.select("part", "mask", *LABELS, F.explode(steps).alias("at")).select("part", "mask", *LABELS, "at.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, early = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    count = lambda when, label="all": F.sum(F.when(when, F.col(label)).otherwise(0)).cast("long")
    share = F.lit(math.factorial(len(names))) / F.greatest(F.bit_count(mask), F.lit(1))  # a whole number: the count is at most n
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~early).alias("kept"), count(fails & ~early).alias("removed"), count(fails & early).alias("redundant"),
        count(mask == bit).alias("unique_fails"), count(fails & ~early, "good").alias("good_lost"), count(fails & ~early, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("all") * share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of evaluate_orders(), zeros included: 600 rows for each part of docs.

    Nulls, copies and repeated keys as in failure_masks(); other columns are ignored, whatever their names; an empty
    table gives no rows. All that grows with the corpus is read once; a part sends 96 sums from each task.
    """
    return evaluate_orders(mask_cells(parity_sums(failure_masks(docs, labels, key, text, part))))
