"""Files in and out: listings, mirrored paths, chunk files of both shapes, partitioned chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of all files under folder whose name matches; contents are not read. A missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def mirrored(path: Column, root: str, out: str, suffix: str) -> Column:
    """The path under out that mirrors path under root, with another suffix; null for paths outside root."""
    base = root.rstrip("/") + "/"
    rest = F.substring(path, F.lit(len(base) + 1), F.char_length(path))
    return F.when(F.startswith(path, F.lit(base)), F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(rest, r"\.[^./]*$", ""), F.lit(suffix)))


def read_chunks(spark: SparkSession, folder: str, fields: str, multi_line: bool = True) -> DataFrame:
    """Chunks with the given fields (DDL), from JSON files that hold a list of chunks or objects with a list 'chunks'; book is the file's name.

    Files of one object a line (multi_line=False) can be split, so large ones are read by several tasks.
    """
    names = [f.name for f in spark.createDataFrame([], fields).schema]
    rows = spark.read.schema(f"{fields}, chunks array<struct<{_nested(spark, fields)}>>").option("multiLine", multi_line).option("recursiveFileLookup", True).json(folder)
    book = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    each = F.explode(F.coalesce("chunks", F.array(F.struct(*names))))
    return rows.select(book.alias("book"), each.alias("chunk")).select("book", "chunk.*")


def _nested(spark: SparkSession, fields: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in spark.createDataFrame([], fields).schema)


def write_chunks(chunks: DataFrame, folder: str, overwrite: str = "skip") -> bool:
    """Writes chunks by strategy and book. overwrite: 'all' replaces, 'skip' leaves an existing table alone, 'error' raises. Tells whether it wrote."""
    modes = {"all": "overwrite", "skip": "ignore", "error": "errorifexists"}
    jvm = chunks.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(chunks.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if there and overwrite == "skip":
        return False
    chunks.write.mode(modes[overwrite]).partitionBy("strategy", "book").parquet(folder)
    return True


#: The entity types that extraction asks for.
ENTITY_TYPES = ("PERSON", "BRAIN_STRUCTURE", "BRAIN_FUNCTION", "CHEMICAL", "DISORDER", "MENTAL_STATE", "BEHAVIOR", "THEORY", "PRECEPT")


def entity_types(spark: SparkSession) -> DataFrame:
    """pos, type."""
    return spark.range(1, numPartitions=1).select(F.posexplode(F.array(*map(F.lit, ENTITY_TYPES))).alias("pos", "type"))


def curated(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """category, id, name, price: of each category of wanted (category, id, pos) the first model that the catalogue (id, name, price) has; null if none."""
    first = wanted.join(catalogue, "id").groupBy("category").agg(F.min_by(F.struct("id", "name", "price"), "pos").alias("m")).select("category", "m.*")
    return wanted.select("category").distinct().join(first, "category", "left")


def price_label(price: Column) -> Column:
    """A price for one token, told for a million."""
    million = price * 1_000_000
    return F.when(price == 0, "free").otherwise(F.concat(F.lit("$"), F.when(million < 0.01, F.format_string("%.3f", million)).when(million < 1, F.format_string("%.2f", million)).otherwise(F.format_string("%.1f", million))))


def parsed(stored: DataFrame, parser: Callable[[bytes], str]) -> DataFrame:
    """key, text of stored (key, content): a parser plug-in applied to each file's bytes; what it can't parse is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed_batches(batches, parser)

    return stored.select("key", "content").mapInArrow(run, f"key {dict(stored.dtypes)['key']}, text string")


#: Texts of a batch that are held before they are handed on: so many files, or so many characters.
SLICE, SLICE_CHARS = 64, 1 << 22


def parsed_batches(batches: Iterator[pa.RecordBatch], parser: Callable[[bytes], str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, texts, held = 0, [], 0
        for i, content in enumerate(batch.column("content")):
            try:
                texts.append(None if content.as_py() is None else parser(content.as_py()))
            except ValueError:
                texts.append(None)
            held += len(texts[-1] or "")
            if len(texts) == SLICE or held >= SLICE_CHARS or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(begin, len(texts)), pa.array(texts, pa.string())], ["key", "text"])
                begin, texts, held = i + 1, [], 0


def html_parser(content: bytes) -> str:
    """Markdown lines of an HTML page, as cleaning.markdown_of_html() makes them, without blank ones."""
    import re

    text = re.sub(r"(?is)<(script|style|nav|header|footer|table|figure)\b.*?</\1>", " ", content.decode())
    text = re.sub(r"(?i)<h[2-6]\b[^>]*>", "\n## ", re.sub(r"(?i)<h1\b[^>]*>", "\n# ", text))
    text = re.sub(r"(?i)</(h[1-6]|p|div|li|ul|title|head)>|<br\s*/?>", "\n", text, flags=re.ASCII)
    lines = (re.sub(" +", " ", x).strip(" \t\n\x0b\x0c\r") for x in re.sub(r"<[^>]*>", " ", text).split("\n"))
    return "\n".join(x for x in lines if x)
