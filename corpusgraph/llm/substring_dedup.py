"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is WINDOW consecutive words. Each window is filed under its anchor, the least hash of its ANCHOR-word
grams, so equal windows have one anchor. The windows that follow each other under one anchor make a segment.
A window outside an anchor's segments can't occur among them, so parsing against the reference block of an anchor
finds all factors of WINDOW words that parsing against every block would.

What is parsed is first narrowed, always by the same steps: segments equal in words are told by digest, each
task's copies at once; of the others, windows that no other document has (told by an exchange of window hashes) are cut
off, and the runs that are left are merged in each task by their bytes. A block thus holds passages that documents
really share, once for each task, however many documents share them and whatever stands around them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.llm import exchange
from corpusgraph.llm.arrays import Words, pieces, sliding_min
from corpusgraph.plans.scratch import Scratch

WINDOW, ANCHOR = 50, 10
#: Bytes of different runs that a task holds before it hands them on.
HELD = 64 << 20
BLANKS = r"[\x20\x09-\x0D]"
_KINDS = [("doc_id", "<i8"), ("text_hash", "<i8"), ("at", "<i4"), ("n", "<i4"), ("seg", "<u8"), ("copy", "u1")]
_PLACES = [("rid", "<i8"), ("at", "<i4")]


def _segments(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """anchor, text's row, first window (word in the text), number of windows, hash of the words; for each segment."""
    width = min(ANCHOR, window)
    grams, whole = words.grams(width)
    grams[~whole] = np.iinfo(np.uint64).max
    count = len(words.hash)
    anchor = sliding_min(grams, window - width + 1) if count else grams
    row = words.rows()
    starts = np.flatnonzero(words.first[1:][row] - np.arange(count) >= window)
    if not len(starts):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, np.empty(0, np.uint64)
    new = np.r_[True, (np.diff(starts) != 1) | (anchor[starts[1:]] != anchor[starts[:-1]])]
    lo = starts[new]
    n = np.diff(np.r_[np.flatnonzero(new), len(starts)])
    seg = words.span(words.prefix(), lo, lo + n + window - 1)
    return anchor[lo], row[lo], lo - words.first[row[lo]], n, seg


def _copies_here(key: np.ndarray, fields: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """copy: 1 where a document of smaller id has the segment among these rows, 2 where only documents of larger id have it too."""
    order = np.lexsort((fields["doc_id"], fields["seg"], key))
    k, s, d = key[order], fields["seg"][order], fields["doc_id"][order]
    new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    last = d[np.r_[begin[1:], len(d)] - 1]
    copy = np.empty(len(key), np.uint8)
    copy[order] = np.where(d > d[begin][group], 1, np.where(last > d[begin], 2, 0)[group])
    return {"copy": copy}


class Block:
    """A reference block: the passages so far, and where each of their windows first stands."""

    def __init__(self, window: int) -> None:
        self.window, self.index, self.refs = window, {}, []

    def _find(self, words: list[bytes], i: int, key: int) -> tuple[int, int | None]:
        """The slot of the window at words[i], and its place if it is known; windows of one hash are told apart by their words."""
        while (code := self.index.get(key)) is not None:
            ref, j = code >> 32, code & 0xFFFFFFFF
            if self.refs[ref][j : j + self.window] == words[i : i + self.window]:
                return key, code
            key += 1
        return key, None

    def _keys(self, body: bytes, words: list[bytes]) -> Iterator[int]:
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        for i in range(len(words) - self.window + 1):
            yield hash(body[at[i] : at[i + self.window] - 1])

    def factors(self, body: bytes) -> list[tuple[int, int]]:
        """Greedy parse: each factor of window words or more, as words lo:hi of body.

        After a factor, the windows that cross its end are looked up one by one: one of them may start
        another factor, from elsewhere in the block. A window that isn't in the index gives a literal word.
        """
        words, size, out = body.split(b" "), self.window, []
        keys, i = list(self._keys(body, words)), 0
        while i < len(keys):
            _, code = self._find(words, i, keys[i])
            if code is None:
                i += 1
                continue
            j, n, source = code & 0xFFFFFFFF, size, self.refs[code >> 32]
            while i + n < len(words) and j + n < len(source) and words[i + n] == source[j + n]:
                n += 1
            out.append((i, i + n))
            i += n - size + 1
        return out

    def add(self, body: bytes) -> None:
        words = body.split(b" ")
        self.refs.append(words)
        for i, key in enumerate(self._keys(body, words)):
            slot, code = self._find(words, i, key)
            if code is None:
                self.index[slot] = len(self.refs) - 1 << 32 | i


def parse_block(rows: Iterator[tuple[int, int, bytes]], window: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(bid, owner, factors) for passages (least document, bid, body) of one anchor, ordered by document.

    owner is the least document of all that have the passage; in it only the factors repeat earlier documents,
    in all others the whole passage does.
    """
    block, known, mine, last = Block(window), {}, [], None
    for doc, bid, body in rows:
        if doc != last:
            for x in mine:
                block.add(x)
            mine, last = [], doc
        if body not in known:
            known[body] = (doc, block.factors(body))
            mine.append(body)
        yield bid, *known[body]


def _parsed(window: int):  # noqa: ANN202
    schema = pa.schema([("bid", pa.int64()), ("owner", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])

    def batch(found: list) -> pa.RecordBatch:
        columns = [[f[0] for f in found], [f[1] for f in found], [[x for x, _ in f[2]] for f in found], [[x for _, x in f[2]] for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in zip(*(b.column(c).slice(at, 256).to_pylist() for c in ("anchor", "doc_id", "bid", "body")), strict=True))
        out = []
        for _, block in groupby(rows, lambda r: r[0]):
            for found in parse_block((r[1:] for r in block), window):
                out.append(found)
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
        yield batch(out)

    return run


class Groups:
    """Numbers what is equal within a task; a group's least document is known, and the group handed on, at flush()."""

    def __init__(self) -> None:
        from pyspark import TaskContext

        self.next, self.held, self.size = TaskContext.get().partitionId() << 33, {}, 0

    def number(self, key: tuple, doc: int, size: int) -> int:
        found = self.held.get(key)
        if found is None:
            self.held[key] = found = [self.next, doc]
            self.next, self.size = self.next + 1, self.size + size
        found[1] = min(found[1], doc)
        return found[0]

    def flush(self) -> dict:
        held, self.held, self.size = self.held, {}, 0
        return held


_PICKED = "kind int, id long, anchor long, body binary, doc_id long, text_hash long, at int, n int"
_FIELDS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("anchor", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
#: Kinds of rows: a group (its least document, its digest or passage), a member of a group, a segment to be narrowed.
GROUP, MEMBER, SEGMENT = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _FIELDS, strict=True)], schema=_FIELDS)


def _groups(groups: Groups) -> list[tuple]:
    return [(GROUP, number, key[0], key[1], doc, None, None, None) for key, (number, doc) in groups.flush().items()]


def _picker(window: int):  # noqa: ANN202
    """Members and groups of segments that have copies (by digest of their words); the words of segments to be narrowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, rid = Groups(), None
        rid = groups.next
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out: list[tuple] = []
                for doc, text_hash, text, picks in zip(*(whole.column(c).slice(at, 64).to_pylist() for c in ("doc_id", "text_hash", "text", "picks")), strict=True):
                    words = (text or "").encode().split()
                    for p in picks:
                        body = b" ".join(words[p["at"] : p["at"] + p["n"] + window - 1])
                        if p["copies"]:
                            number = groups.number((0, hashlib.blake2b(body, digest_size=32).digest()), doc, 200)
                            out.append((MEMBER, number, None, None, doc, text_hash, p["at"], p["n"] + window - 1))
                        if p["narrow"]:
                            out.append((SEGMENT, rid, p["anchor"], body, doc, text_hash, p["at"], p["n"]))
                            rid += 1
                yield _rows(out)
                if groups.size > HELD:
                    yield _rows(_groups(groups))
        yield _rows(_groups(groups))

    return run


def _narrowed(window: int):  # noqa: ANN202
    """Runs of the segments' shared windows, merged by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                out: list[tuple] = []
                columns = (whole.column(c).slice(lo, 256).to_pylist() for c in ("anchor", "body", "doc_id", "text_hash", "at", "places"))
                for anchor, body, doc, text_hash, at, places in zip(*columns, strict=True):
                    words, p = body.split(b" "), np.unique(np.asarray(places))
                    cuts = np.flatnonzero(np.diff(p) != 1) + 1
                    for a, b in zip(p[np.r_[0, cuts]].tolist(), p[np.r_[cuts, len(p)] - 1].tolist(), strict=True):
                        part = words[a : b + window]
                        passage = body if len(part) == len(words) else b" ".join(part)
                        out.append((MEMBER, groups.number((anchor, passage), doc, len(passage) + 200), None, None, doc, text_hash, at + a, len(part)))
                yield _rows(out)
                if groups.size > HELD:
                    yield _rows(_groups(groups))
        yield _rows(_groups(groups))

    return run


def _windows(window: int, owners: int, key: int):  # noqa: ANN202
    """Blocks of the hashes of all windows of segments, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = exchange.Sender(owners, _PLACES)
        for batch in batches:
            rid, doc = np.asarray(batch.column("id")), np.asarray(batch.column("doc_id"))
            for lo, _, data, offsets in pieces(batch.column("body")):
                words = Words(data, offsets, key)
                h, whole = words.grams(window)
                on = np.flatnonzero(whole)
                row = words.rows()[on]
                for block in out.add(h[on], doc[lo + row], rid=rid[lo + row], at=on - words.first[row]):
                    yield exchange.batch_of(block)
        for block in out.flush():
            yield exchange.batch_of(block)

    return run


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _shared_segments(plain: DataFrame, scratch: Scratch, window: int, partitions: int, key: int) -> DataFrame:
    """Segments under anchors of several documents: which have copies, and which are to be narrowed (each once, if its anchor has another)."""
    owners = exchange.owners_for(plain.count() * 32, partitions)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = exchange.Sender(owners, _KINDS, _copies_here)
        for batch in batches:
            doc, text_hash = np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_hash"))
            for lo, hi, data, offsets in pieces(batch.column("text")):
                anchor, row, at, n, seg = _segments(Words(data, offsets, key), window)
                mine = doc[lo:hi][row]
                for block in out.add(anchor, mine, doc_id=mine, text_hash=text_hash[lo:hi][row], at=at, n=n, seg=seg):
                    yield exchange.batch_of(block)
        for block in out.flush():
            yield exchange.batch_of(block)

    blocks = scratch.save(plain.mapInArrow(send, exchange.BLOCKS), "blocks")

    def make(keys: np.ndarray, on: np.ndarray, f: dict[str, np.ndarray]) -> pa.Table:
        mine = {name: f[name][on] for name, _ in _KINDS}
        return pa.table({"anchor": keys[on].view(np.int64)} | mine | {"seg": mine["seg"].view(np.int64), "copy": mine["copy"].astype(np.int32)})

    rows = scratch.save(exchange.open_rows(blocks, _KINDS, make, "anchor long, doc_id long, text_hash long, at int, n int, seg long, copy int"), "shared")
    scratch.free("blocks")
    same = W.partitionBy("anchor", "seg")
    ranked = rows.where("copy <> 1").withColumns({"first": F.min("doc_id").over(same), "last": F.max("doc_id").over(same), "most": F.max("copy").over(same)})
    ranked = scratch.save(ranked, "ranked")
    several = ranked.where("doc_id = first").groupBy("anchor").agg((F.min("seg") != F.max("seg")).alias("several")).where("several")
    pick = [F.col(c) for c in ("doc_id", "text_hash", "at", "n", "anchor")]
    told = ranked.join(several, "anchor", "left").select(
        *pick, ((F.col("last") > F.col("first")) | (F.col("most") == 2)).alias("copies"), ((F.col("doc_id") == F.col("first")) & F.col("several").isNotNull()).alias("narrow")
    )
    return told.where("copies OR narrow").unionAll(rows.where("copy = 1").select(*pick, F.lit(True), F.lit(False)))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, spans: array of struct(lo, hi), words lo:hi; only rows that have any.

    The spans cover a word if and only if a window of it occurs in a row of smaller id. Words are runs of
    anything but space, tab, LF, VT, FF, CR, compared as they are. Null text has no words; rows without a key
    neither lose words nor make others lose them. Rows of one key don't make each other lose words, whether their
    texts are alike or not; each is judged by its own text, told from others of the key by text_hash (XXH64).
    Texts shorter than a window give nothing. Other columns are ignored. All rows take part, whatever a block's size.

    Only anchors cross the network for all documents (Golomb-coded). Texts do so once, to meet the list of their
    segments whose anchors several documents have; see the module's docstring for the steps from there.
    """
    return _spans(docs, window, key, text)[0]


def _spans(docs: DataFrame, window: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """duplicate_spans(), and the rows (doc_id, text_hash, text) that may have any."""
    spark = docs.sparkSession
    scratch, salt = Scratch(spark, "substring"), secrets.randbits(64)
    plain = _plain(docs, key, text).where("doc_id IS NOT NULL")
    partitions = exchange.partitions_of(docs)
    told = _shared_segments(plain, scratch, window, partitions, salt)
    lists = told.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "n", "anchor", "copies", "narrow")).alias("picks"))
    texts = scratch.save(plain.join(lists, ["doc_id", "text_hash"]), "texts")
    scratch.free("shared", "ranked")
    picked = scratch.save(texts.mapInArrow(_picker(window), _PICKED), "picked")
    texts = texts.drop("picks")

    least = picked.where(f"kind = {GROUP}").select("id", F.col("doc_id").alias("least"), "body")
    owner = least.groupBy("body").agg(F.min("least").alias("owner"))
    owner = least.join(owner, "body").select("id", "owner")
    copies = picked.where(f"kind = {MEMBER}").join(owner, "id").where("doc_id > owner")
    copies = copies.select("doc_id", "text_hash", F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi")).alias("span"))

    segments = picked.where(f"kind = {SEGMENT}")
    owners = exchange.owners_for(segments.agg(F.sum("n")).first()[0] or 0, partitions)
    blocks = scratch.save(segments.select("id", "doc_id", "body").mapInArrow(_windows(window, owners, salt), exchange.BLOCKS), "windows")

    def make(keys: np.ndarray, on: np.ndarray, f: dict[str, np.ndarray]) -> pa.Table:
        return pa.table({"id": f["rid"][on], "at": f["at"][on]})

    places = exchange.open_rows(blocks, _PLACES, make, "id long, at int").groupBy("id").agg(F.collect_list("at").alias("places"))
    runs = segments.select("id", "anchor", "body", "doc_id", "text_hash", "at").join(places, "id")
    runs = scratch.save(runs.mapInArrow(_narrowed(window), _PICKED), "runs")
    scratch.free("windows")
    dealt = runs.where(f"kind = {GROUP}").select("anchor", "doc_id", F.col("id").alias("bid"), "body")
    dealt = dealt.repartition(4 * partitions, "anchor").sortWithinPartitions("anchor", "doc_id", "bid")
    found = dealt.mapInArrow(_parsed(window), "bid long, owner long, lo array<int>, hi array<int>")
    members = runs.where(f"kind = {MEMBER}").join(found, F.col("id") == F.col("bid"))
    whole = F.array(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi")))
    parts = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((F.col("at") + x["lo"]).alias("lo"), (F.col("at") + x["hi"]).alias("hi")))
    parsed = members.select("doc_id", "text_hash", F.explode(F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(parts)).alias("span"))
    spans = scratch.save(copies.unionAll(parsed).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")), "spans")
    scratch.free("picked", "runs")
    return spans, texts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            size, gone, kept = [], [], []
            for body, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (body or "").encode().split()
                size.append(len(words))
                out = bytearray(len(words))
                for c in cuts or ():
                    lo, hi = c["lo"], min(c["hi"], len(words))
                    out[lo:hi] = b"\1" * (hi - lo)
                gone.append(out.count(1))
                kept.append(b" ".join([w for w, x in zip(words, out, strict=True) if not x] if cuts else words))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "n_removed", "kept_text"])


_CUT = "doc_id long, text_hash long, n_words long, n_removed long, kept_text string"


def substring_dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the words outside all spans, joined by one space).

    See duplicate_spans() for what goes. An empty table gives no rows.
    """
    spans, _ = _spans(docs, window, key, text)
    return _plain(docs, key, text).join(spans, ["doc_id", "text_hash"], "left").mapInArrow(_cut, _CUT).drop("text_hash")


def _joined_words(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}+|{BLANKS}+$", ""), f"{BLANKS}+", " ")


def substring_digests(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """substring_dedup() with kept_sha256 in place of kept_text: only texts that lose words are read again."""
    spans, texts = _spans(docs, window, key, text)
    sha = lambda c: F.unhex(F.sha2(c, 256))
    cut = texts.join(spans, ["doc_id", "text_hash"]).mapInArrow(_cut, _CUT)
    cut = cut.groupBy("doc_id", "text_hash").agg(F.max("n_removed").alias("gone"), F.max(sha(F.col("kept_text"))).alias("rest"))
    body, n = F.col("body"), F.col("n_words")
    every = _plain(docs, key, text).select("doc_id", "text_hash", _joined_words(F.col("text")).alias("body"))
    size = F.when(body == "", 0).otherwise(F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit(""))) + 1)
    every = every.select("doc_id", "text_hash", size.cast("long").alias("n_words"), sha(body).alias("sha"))
    out = every.join(cut, ["doc_id", "text_hash"], "left")
    return out.select("doc_id", n, F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("rest", "sha"))).alias("kept_sha256"))
