"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of line hashes, dealt to buckets and sorted within them, with the number of documents that hold the
line and the largest of their ids. Batches come in order of falling ids. Each new batch is merge-anti-joined with what
the runs have settled (lines that enough documents hold already) and adds the rest as a run of its own on level 0. As
soon as a level has two runs, a merge join compacts them into one run of the next level. Runs share their buckets, so
that joins read them side by side without a shuffle.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def line_keys(body: Column) -> Column:
    """The lines of a text without blanks at both ends, A-Z lower-cased.

    lower() is quicker than translate(), and does the same to lines of ASCII and of signs that surely have no lower case.
    """
    other = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Z}]"
    fold = lambda x: F.when((F.octet_length(x) != F.char_length(x)) & x.rlike(other), F.translate(x, UPPER, LOWER)).otherwise(F.lower(x))
    return F.transform(F.transform(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))), fold)


def digest(text: Column) -> Column:
    """32 hexadecimal digits of SHA-256: by chance no two texts share them, and nobody can make two that do."""
    return F.left(F.sha2(text, 256), F.lit(32))


class SortedRuns:
    """Levelled runs of (key, docs, last), sorted by key in shared buckets.

    Tables lie in the scratch folder and have entries in the session's catalogue, by which Spark knows their buckets, until
    close() drops both.
    """

    def __init__(self, scratch: Scratch, buckets: int) -> None:
        self.spark: SparkSession = scratch.spark
        self.scratch, self.buckets, self.mark, self.made = scratch, buckets, uuid.uuid4().hex, 0
        self.levels: list[str | None] = []

    def store(self, df: DataFrame, name: str, *partition: str) -> DataFrame:
        """df as a table of buckets sorted by key."""
        writer = df.write.partitionBy(*partition) if partition else df.write
        writer.bucketBy(self.buckets, "key").sortBy("key").option("path", self.scratch.path(name)).format("parquet").saveAsTable(self._entry(name))
        return self.spark.table(self._entry(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self._entry(x)) for x in self.levels if x]

    def add(self, batch: DataFrame, settled: int) -> None:
        """batch: distinct keys with docs and last. Keys that one run holds in `settled` documents are left out; the rest is a new run."""
        for run in self.runs():
            batch = batch.join(run.where(F.col("docs") >= settled).select("key").hint("merge"), "key", "left_anti")
        self._keep(batch.select("key", "docs", "last"), 0)

    def compact(self) -> DataFrame:
        """All runs merged into one, smaller ones first."""
        names = [x for x in self.levels if x]
        while len(names) > 1:
            names[:2] = [self._merged(names[0], names[1], len(self.levels))]
        self.levels = [*[None] * len(self.levels), names[0]]
        return self.runs()[0]

    def _keep(self, run: DataFrame, level: int) -> None:
        name = self._stored(run, level)
        while level < len(self.levels) and self.levels[level]:
            old, self.levels[level] = self.levels[level], None
            level += 1
            name = self._merged(old, name, level)
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = name

    def _stored(self, run: DataFrame, level: int) -> str:
        self.made += 1
        self.store(run, f"run-{level}-{self.made}")
        return f"run-{level}-{self.made}"

    def _merged(self, one: str, two: str, level: int) -> str:
        a, b = (self.spark.table(self._entry(x)).alias(side) for x, side in ((one, "a"), (two, "b")))
        both = a.join(b.hint("merge"), F.col("a.key") == F.col("b.key"), "full")
        docs = F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))
        name = self._stored(both.select(F.coalesce("a.key", "b.key").alias("key"), docs.alias("docs"), F.greatest("a.last", "b.last").alias("last")), level)
        self.drop(one)
        self.drop(two)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._entry(name)}")
        self.scratch.free(name)

    def close(self) -> None:
        for x in filter(None, self.levels):
            self.drop(x)

    def _entry(self, name: str) -> str:
        return f"`lines_{self.mark}_{name.replace('-', '_')}`"


def repeated_lines(docs: DataFrame, scratch: Scratch, key: str, text: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """key (hash), last: the lines of min_chars code points or more that min_docs rows of docs hold, with the largest id of those."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # Where the batches end: quantiles of the ids, one row; equal ids are in one batch. Any ends give the same lines.
    ends = plain.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], F.lit(10_000)).alias("ends")).first()["ends"] or []
    batch = sum((F.when(F.col("doc_id") >= F.lit(x), 0).otherwise(1) for x in ends), F.lit(0))
    runs = SortedRuns(scratch, int(spark.conf.get("spark.sql.shuffle.partitions")))
    long_lines = F.filter(line_keys(F.col("body")), lambda x: F.char_length(x) >= min_chars)
    keys = plain.select("doc_id", batch.alias("batch"), F.explode(F.array_distinct(F.transform(long_lines, digest))).alias("key")).withColumn("key", F.unhex("key"))
    # The only shuffle of all lines: hashes, counted for each batch within each task first. It deals keys to the runs' buckets.
    parts = [F.struct(F.count_if(F.col("batch") == i).alias("docs"), F.max(F.when(F.col("batch") == i, F.col("doc_id"))).alias("last")) for i in range(len(ends) + 1)]
    counted = keys.groupBy("key").agg(F.array(*parts).alias("parts")).select("key", F.posexplode("parts").alias("batch", "part")).where("part.docs > 0").select("key", "batch", "part.*")
    staged = runs.store(counted, "staged", "batch")
    for i in range(len(ends) + 1):
        runs.add(staged.where(F.col("batch") == i), min_docs)
    found = runs.compact().where(F.col("docs") >= min_docs).select("key", "last")
    found = scratch.save(found, "repeated")
    runs.drop("staged")
    runs.close()
    return found


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text.

    Texts are cut at \\n; null and empty texts have one empty line. A line's key is that of line_keys(). Lines whose key has min_chars
    code points or more and occurs in min_docs rows or more go everywhere but in the rows of the largest doc_id that
    holds it; all lines of a kept key stay there, repeats too. A null doc_id is less than every other; a key that only rows without
    an id hold stays in all of them. Rows that repeat a doc_id count as documents of their own, and all of the largest doc_id keep.
    Other columns are ignored, whatever their names. An empty table gives no rows.

    batches tells how runs are built, not what is found. A hash in a third of all rows is counted within each task
    before it is sent; the join of lines with the repeated ones reads two plain tables, so that its rows can be split over tasks.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = repeated_lines(docs, scratch, key, text, min_chars, min_docs, batches)
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(digest(body)).alias("mark"), body.alias("body"))
    # Rows meet their verdicts by id and text; rows that are the same in both have the same one.
    lines = plain.select("doc_id", "mark", F.posexplode(line_keys(F.col("body"))).alias("at", "line")).where(F.char_length("line") >= min_chars)
    lines = lines.select("doc_id", "mark", "at", F.unhex(digest(F.col("line"))).alias("key"))
    out = lines.join(found, "key").where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))
    out = out.select(F.col("doc_id").alias("of"), F.col("mark").alias("text_mark"), "gone")
    # Cut before the join, as an expression within a lambda would be evaluated anew for each element.
    cut = plain.select("doc_id", "mark", F.split("body", "\n", -1).alias("lines"))
    both = cut.join(out, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("text_mark")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))
