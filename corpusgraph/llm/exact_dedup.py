"""Exact dedup over a Golomb-coded fingerprint exchange.

Senders give owners the sorted, compressed fingerprints of their texts and get duplicate bitmaps back; only
texts whose bit is set (suspects) are read again and compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import exchange
from corpusgraph.plans.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
_KINDS = [("doc_id", "<i8"), ("there", "u1"), ("n_chars", "<i8"), ("sha", "V32"), ("row", "<i8")]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without ASCII blanks), n_chars.

    Texts are equal when they are the same without the characters space, tab, LF, VT, FF, CR; null counts as
    empty, so null, empty and blank texts form one group. Of equal texts the one of most code points stays,
    then the smallest key (null last), then one of the rows that are the same in both, so exactly one row of a group is kept.
    Other columns are ignored, whatever their names. An empty table gives no rows. Whole texts are compared.

    The fingerprint is a prefix of SHA-256. Suspects' texts meet by their whole SHA-256, after each task has
    merged its own equal texts, so a text that a third of all rows share arrives once per task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    owners = exchange.owners_for(docs.count(), exchange.partitions_of(docs))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, seen = exchange.Sender(owners, _KINDS), TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            doc, there = exchange.ids(batch.column("doc_id"))
            sha = np.frombuffer(b"".join(batch.column("sha").to_pylist()), "V32")
            mark = sha.view(np.uint8).reshape(n, 32)[:, :8].copy().view(">u8").ravel().astype(np.uint64)
            mark = mark >> np.uint64(64 - fingerprint_bits) << np.uint64(64 - fingerprint_bits)
            row = np.arange(seen, seen + n)
            seen += n
            for block in out.add(mark, row, doc_id=doc, there=there, n_chars=np.asarray(batch.column("n_chars")), sha=sha, row=row):
                yield exchange.batch_of(block)
        for block in out.flush():
            yield exchange.batch_of(block)

    digests = plain.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"),
    )
    blocks = scratch.save(digests.mapInArrow(send, exchange.BLOCKS), "blocks")

    def make(keys: np.ndarray, shared: np.ndarray, f: dict[str, np.ndarray]) -> pa.Table:
        sha = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(f["sha"].tobytes())])
        return pa.table({"doc_id": exchange.nullable(f["doc_id"], f["there"]), "n_chars": f["n_chars"], "sha": sha.cast(pa.binary()), "row": f["row"], "suspect": shared})

    rows = scratch.save(exchange.open_rows(blocks, _KINDS, make, "doc_id long, n_chars long, sha binary, row long, suspect boolean"), "rows")
    scratch.free("blocks")
    suspects = rows.where("suspect")
    wanted = suspects.select(F.col("doc_id").alias("wanted"))
    texts = plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select(normalised(F.col("text")).alias("body"))
    proof = texts.groupBy(F.unhex(F.sha2("body", 256)).alias("sha")).agg((F.min("body") == F.max("body")).alias("same"))
    best = suspects.groupBy("sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("rank"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best"),
    )
    checked = F.when(F.col("same"), F.col("best.row")).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("long"))
    groups = best.where("group_size > 1").join(proof, "sha").select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), checked.alias("keep_row"))
    groups = scratch.save(groups, "groups")
    alone = F.col("keep_row").isNull()
    return rows.join(groups, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns, one row for each group of equal texts.

    Of rows alike in key, text without blanks and length one stays, whichever. Columns of any names come through
    unchanged. Nulls and empty tables are as in exact_dedup(). Whole rows cross the network once, dealt by key, digest and length,
    so copies under different keys don't meet in one task.
    """
    there = [F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "sha", "chars"]
    kept = exact_dedup(docs, key, text).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"), F.col("n_chars").alias("chars"))
    body = F.col(f"row.{key}").cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col(f"row.{text}")), 256)).alias("sha"), F.char_length(F.coalesce(F.col(f"row.{text}"), F.lit(""))).cast("long").alias("chars")
    mine = docs.select(F.struct("*").alias("row")).select("row", *body).select("row", *there)
    on = ["id", "none", "sha", "chars"]
    return mine.join(kept.select(*there), on, "left_semi").dropDuplicates(on).select("row.*")
