"""WARC archives written and read as a table of record chunks.

A payload is cut once into rows of record identifier and chunk number, each with the digest of the payload up to
its end. Each row becomes one WARC segment (those after the first are continuation records). The reader gets
segments in order and feeds one running digest, so it holds no record as a whole, and the writer none but the row it
is given. No segment contains the mark that begins a record (a payload that has it is cut inside it), so archives can be
split into records at that mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch

CHUNK, LEAST_SHARED = 16 << 10, 1000
MARK = "WARC/1.1"
VERSION = f"{MARK}\r\n"
GAP = "\r\n\r\n"
#: Bytes of chunks that a writing task hands on at once.
HELD = 4 << 20


def _uuid(name: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(name), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def revisits(pages: DataFrame, key: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload, refers_to: null, or the largest page_id of the same payload of LEAST_SHARED bytes or more.

    Payloads are compared by SHA-256. Null payload is empty, null url stays null.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body), F.lit("")).alias("html"))
    large = F.octet_length("html") >= LEAST_SHARED
    name = F.unhex(F.sha2("html", 256))
    groups = p.where(large).select("page_id", name.alias("same")).groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").drop("n")
    groups = scratch.save(groups, "groups")
    told = ["page_id", "url", F.encode("html", "UTF-8").alias("payload")]
    # Small payloads take no part in the join: as nulls they would all be one key.
    found = p.where(large).withColumn("same", name).join(groups, "same", "left").select(*told, F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))
    return found.unionAll(p.where(~large).select(*told, F.lit(None).cast("long").alias("refers_to")))


_CHUNKS = "record long, page_id long, url string, refers_to long, total long, no int, last boolean, digest string, data binary"
_SCHEMA = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("total", pa.int64()), ("no", pa.int32()), ("last", pa.bool_()), ("digest", pa.string()), ("data", pa.binary())])


def cut(payload: memoryview, chunk: int) -> Iterator[memoryview]:
    """payload in order, in views of at most chunk bytes, none of which contains MARK; one empty view of an empty payload."""
    marks = (m.start() + 1 for m in re.finditer(re.escape(MARK.encode()), payload))
    mark, at = next(marks, None), 0
    while at < len(payload) or not at:
        end = min(at + chunk, len(payload))
        while mark is not None and mark <= at:
            mark = next(marks, None)
        if mark is not None:
            end = min(end, mark)
        yield payload[at:end]
        if end == at:
            return
        at = end


def chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of records (page_id, url, payload, refers_to): a record number, the chunk's number and bytes.

    digest is the SHA-1 of the payload up to the chunk's end, so the last chunk's is the payload's; total is the
    payload's length. A revisit is one chunk without bytes. Payloads are read in place and in linear time; at most
    HELD bytes of chunks are held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        record, rows, size = TaskContext.get().partitionId() << 33, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for b in batches:
            fields = (b.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for i, (page, url, refers_to) in enumerate(zip(*fields, strict=True)):
                payload = memoryview(b.column("payload")[i].as_buffer())
                sha, seen = hashlib.sha1(), 0
                for no, part in enumerate(cut(payload, chunk)):
                    sha.update(part)
                    seen += len(part)
                    if refers_to is None:
                        rows.append((record, page, url, None, len(payload), no, seen == len(payload), sha.hexdigest(), part.tobytes()))
                        size += len(part) + 200
                if refers_to is not None:
                    rows.append((record, page, url, refers_to, len(payload), 0, True, sha.hexdigest(), b""))
                    size += 200
                record += 1
                while size > HELD:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, _CHUNKS)


def segments(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row (value) for each chunk as a WARC segment: version line, headers, blank line, block.

    Record identifiers come from the record's number in this table, so they are unique, also for repeated or null pages.
    """
    first, single = F.col("no") == 0, (F.col("no") == 0) & F.col("last")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("total"), F.lit(GAP))
    lead = F.when(first & ~again, http).otherwise(F.lit(""))
    kind = F.when(again, "revisit").when(first, "response").otherwise("continuation")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    origin = _uuid(F.concat_ws(":", F.lit("record"), F.col("record"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    part = _uuid(F.concat_ws(":", F.lit("part"), F.col("record"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("no")))
    head = F.concat(
        line("WARC-Type", kind), line("WARC-Record-ID", F.when(first, origin).otherwise(part)),
        line("WARC-Date", F.lit("2020-01-01T00:00:00Z")), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.when(F.col("last"), F.concat(F.lit("sha1:"), F.col("digest")))),
        line("WARC-Segment-Number", F.when(~single, F.col("no") + 1)), line("WARC-Segment-Origin-ID", F.when(~first, origin)),
        line("WARC-Segment-Total-Length", F.when(~single & F.col("last"), F.col("total") + F.octet_length(http))),
        line("X-Digest-So-Far", F.when(~single, F.col("digest"))), line("X-Page", F.col("page_id")),
        line("X-Payload-Length", F.when(again, F.col("total"))), line("X-Refers-To-Page", F.col("refers_to")),
        line("Content-Length", F.octet_length(lead) + F.octet_length("data")), F.lit("\r\n"), lead,
    )
    return chunks(records, chunk).select(F.concat(F.lit(VERSION).cast("binary"), head.cast("binary"), F.col("data")).cast("string").alias("value"))


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes records (page_id, url, payload, refers_to) as WARC files, gzipped, one for each task."""
    segments(records, chunk).write.option("lineSep", GAP).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of response, resource, revisit and continuation records: header fields, and block (the payload's bytes alone).

    Plain WARC 1.1 files, gzipped or not, are read too; their pages are null. A record that is shorter than its
    Content-Length (a payload of another writer that has the mark of a record) raises an error.
    """
    raw = spark.read.option("lineSep", GAP + VERSION).text(path).where(F.length("value") > 0)
    value = F.col("value")
    value = F.when(F.startswith(value, F.lit(VERSION)), F.expr(f"substring(value, {len(VERSION) + 1})")).otherwise(value)
    raw = raw.select(value.alias("v"))
    raw = raw.withColumn("head", F.substring_index("v", GAP, 1))
    get = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n")), rf"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1), F.lit(""))
    length = get("Content-Length").cast("int")
    raw = raw.withColumns({"length": length, "type": get("WARC-Type")}).where(F.col("type").isin("response", "resource", "revisit", "continuation"))
    there = F.octet_length("v") - F.octet_length("head") - 4
    block = F.substring(F.col("v").cast("binary"), F.octet_length("head") + 5, F.col("length"))
    raw = raw.withColumn("block", F.when(F.col("length") <= F.greatest(there, F.lit(0)), block).otherwise(F.raise_error(F.lit("a record is shorter than its Content-Length")).cast("binary")))
    raw = raw.select(
        "type", get("WARC-Payload-Digest").alias("told"), F.coalesce(get("WARC-Segment-Origin-ID"), get("WARC-Record-ID")).alias("origin"), get("WARC-Target-URI").alias("url"),
        get("WARC-Segment-Number").cast("int").alias("no"), get("WARC-Segment-Total-Length").isNotNull().alias("last"), get("X-Digest-So-Far").alias("so_far"),
        get("X-Page").cast("long").alias("page_id"), get("X-Payload-Length").cast("long").alias("size"), get("X-Refers-To-Page").cast("long").alias("refers_to"), "block",
    )
    text = F.col("block").cast("string")
    http = (F.col("type") == "response") & F.startswith(text, F.lit("HTTP/"))
    return raw.withColumn("block", F.when(http, F.substring("block", F.octet_length(F.substring_index(text, GAP, 1)) + 5, F.lit((1 << 31) - 1))).otherwise(F.col("block")))


_JOINED = ["page_id", "url", "type", "refers_to", "told", "size", "digest"]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments ordered by record and number: one row per record, its digest fed and compared segment by segment."""
    key, state = None, {}

    def done() -> pa.RecordBatch:
        if not state["last"]:
            raise ValueError(f"the last segment of {key} is missing")
        row = {"page_id": state["page_id"], "url": state["url"], "type": state["type"], "refers_to": None, "told": state["told"], "size": state["size"], "digest": state["sha"].hexdigest()}
        kinds = pa.schema([(c, {"page_id": pa.int64(), "refers_to": pa.int64(), "size": pa.int64()}.get(c, pa.string())) for c in _JOINED])
        return pa.RecordBatch.from_pylist([row], schema=kinds)

    for batch in batches:
        fields = (batch.column(c).to_pylist() for c in ("origin", "no", "page_id", "url", "type", "told", "so_far", "last"))
        for i, (origin, no, page, url, kind, told, so_far, last) in enumerate(zip(*fields, strict=True)):
            if origin != key:
                if key is not None:
                    yield done()
                key, state = origin, {"sha": hashlib.sha1(), "size": 0, "no": 0, "last": False, "page_id": page, "url": url, "type": kind, "told": None}
            if no != state["no"] + 1:
                raise ValueError(f"segment {state['no'] + 1} of {key} is missing or there twice")
            block = batch.column("block")[i].as_buffer()
            state["sha"].update(block)
            if so_far is not None and state["sha"].hexdigest() != so_far:
                raise ValueError(f"segment {no} of {key} differs from its recorded digest")
            state |= {"size": state["size"] + block.size, "no": no, "last": last, "told": told or state["told"]}
    if key is not None:
        yield done()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response come from the payload read; those of a revisit are the recorded ones of the
    payload it stands for. A payload whose digest isn't the recorded one raises an error; digests recorded in another form
    than hexadecimal SHA-1 aren't compared.
    """
    s = read_segments(spark, path)
    again = F.col("type") == "revisit"
    single = s.where("no IS NULL").select(
        "page_id", "url", "type", "refers_to", "told",
        F.when(again, F.col("size")).otherwise(F.octet_length("block")).alias("size"), F.when(again, F.substring("told", 6, 40)).otherwise(F.sha1("block")).alias("digest"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = s.where("no IS NOT NULL").select("origin", "no", "page_id", "url", "type", "told", "so_far", "last", "block")
    joined = several.repartition(parts, "origin").sortWithinPartitions("origin", "no").mapInArrow(_joined, "page_id long, url string, type string, refers_to long, told string, size long, digest string")
    every = single.select(_JOINED).unionAll(joined.select(_JOINED))
    wrong = F.col("told").rlike("^sha1:[0-9a-f]{40}$") & (F.concat(F.lit("sha1:"), F.col("digest")) != F.col("told"))
    right = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("payload differs from its recorded digest")).cast("string")).otherwise(F.col("digest"))
    return every.select("page_id", "url", F.col("size").cast("long").alias("payload_bytes"), right.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def archive_round_trip(pages: DataFrame, path: str | None = None, key: str = "page_id", body: str = "html", url: str = "url", chunk: int = CHUNK) -> DataFrame:
    """Writes pages as WARC under path (a folder of the shared one by default) and reads the archives back.

    One row per row of pages: read_archives() without url. Rows of equal payload of LEAST_SHARED bytes or more revisit the one of largest key;
    rows with a null key, and all rows of the largest key, are responses. Repeated rows are records of their own. Payloads of
    any length are cut into chunks. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = path or Scratch(pages.sparkSession, "warc").path("archives")
    write_archives(revisits(pages, key, body, url), path, chunk)
    return read_archives(pages.sparkSession, path).drop("url")
