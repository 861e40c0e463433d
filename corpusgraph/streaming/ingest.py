"""Streams of documents into a stored collection of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import keys
from corpusgraph.operators import chunking, cleaning
from corpusgraph.sources.collections import Collection

FIELDS = "uuid string, doc_id long, chunk int, tokens int, text string"


def chunks(docs: DataFrame, most: int = 800, overlap: int = 2) -> DataFrame:
    """FIELDS of documents (doc_id, text), cleaned and packed; the same on streams and tables."""
    clean = docs.select("doc_id", cleaning.squeeze(cleaning.join_hyphens(cleaning.remove_inline(F.coalesce("text", F.lit(""))))).alias("text"))
    packed = chunking.pack_sentences(clean, most=most, overlap=overlap)
    uuid = keys.uuid5(F.concat(F.col("doc_id").cast("string"), F.lit("::chunk_"), F.col("chunk").cast("string")))
    return packed.select(uuid.alias("uuid"), "doc_id", "chunk", "tokens", "text")


def ingest(docs: DataFrame, collection: Collection, checkpoint: str, late: str = "1 hour", most: int = 800, overlap: int = 2) -> None:
    """Runs a stream of documents (doc_id, text, ts) over all that is there now into the collection, and ends.

    A document that comes again within the watermark is dropped. Batches are upserted by the chunks' keys, so a batch that is
    repeated after a failure changes nothing; a restart from the checkpoint takes up what has come since. Rows without an id are left out,
    and so are rows whose time lies more than `late` before the latest that earlier batches have seen.
    """
    fresh = docs.where("doc_id IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id"])

    def upsert(batch: DataFrame, number: int) -> None:
        collection.upsert(batch)

    out = chunks(fresh.select("doc_id", "text"), most, overlap).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    out.trigger(availableNow=True).start().awaitTermination()
