"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

Shingle sets are grouped in bands by size. For a band, at most H shingles differ between two similar sets, so
when the universe of shingles is hashed into more than H segments, two similar sets agree on a whole segment, or
differ there by one shingle where a segment is given two shares. Shares are given by cost, which a segment's content
decides, so that both sides of a pair decide alike:

- An empty segment would meet every set that is empty there. It gets no share; there are spare segments for that.
- Any other segment gets one share: its subset is indexed.
- A set with more empty segments than spare ones may agree with a similar set on empty segments only. Then each
  other segment differs, and unless they are few, one of them differs by one shingle: these sets' segments get
  two shares, their subsets and one-deletion neighbourhoods are indexed.
- Where so few segments are left that even this proves nothing (tiny sets), single shingles are indexed.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import exchange
from corpusgraph.llm.arrays import Words, mix, pieces
from corpusgraph.llm.components import components
from corpusgraph.plans.scratch import Scratch

GRAM, NUM, DEN = 5, 80, 100
SMALL_GROUP, TILE, SKETCH_BITS = 8, 1024, 1024
_G = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(4096)
def band_of(n: int, num: int, den: int) -> tuple[int, int, int]:
    """number, least and largest size of the band of sets of n shingles; similar sets are in one or in neighbouring bands."""
    lo, k = 1, 0
    while True:
        below = lo - 1
        top = max(lo, (below * den) // num)
        if n <= top:
            return k, lo, top
        lo, k = top + 1, k + 1


def differences(top: int, num: int, den: int) -> int:
    """The most shingles that differ between a set of at most top and a similar set that is no smaller."""
    return (top + top * den // num) * (den - num) // (den + num)


def spare_segments(most: int) -> int:
    return 1 + most // 16


def shingle_sets(words: Words, gram: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one where there are fewer than gram."""
    grams, whole = words.grams(gram)
    prefix = words.prefix() if len(words.hash) else None
    first = words.first.tolist()
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= gram:
            yield np.unique(grams[lo : hi - gram + 1])
        elif hi > lo:
            yield words.span(prefix, np.array([lo]), np.array([hi]))
        else:
            yield np.empty(0, np.uint64)


def segment_keys(s: np.ndarray, k: int, top: int, num: int, den: int) -> np.ndarray:
    """The keys under which the set s meets the sets of band k (of at most top shingles)."""
    most = differences(top, num, den)
    spare = spare_segments(most)
    m = most + 1 + spare
    h = mix(s + np.uint64((k + 1) * int(_G) & (1 << 64) - 1))
    segment = (h % np.uint64(m)).astype(np.int64)
    code = mix(h ^ _G)
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, code)
    size = np.bincount(segment, minlength=m)
    tags = mix(np.arange(m, dtype=np.uint64) * _G + np.uint64(k + 1))
    keys = [mix(total ^ tags)[size > 0]]
    empty = m - len(keys[0])
    if empty > spare:
        wide = mix(tags + _G)
        keys += [mix(total ^ wide), mix((total[segment] - code) ^ wide[segment])]
        if 2 * (m - empty) <= most:
            keys.append(mix(code + np.uint64(k + 1)))
    return np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0]


def words_digest(body: bytes) -> bytes:
    """16 bytes that texts share if their lowered words are the same."""
    return hashlib.blake2b(b" ".join(body.translate(_ASCII_LOWER).split()), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    """The number that stands for all texts of the same words while candidates are searched; should two kinds share it, both are tried."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _described(batch: pa.RecordBatch, gram: int, key: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row, set and digest of the words of each text."""
    for lo, _, data, offsets in pieces(batch.column("text")):
        for i, s in enumerate(shingle_sets(Words(data, offsets, key, lower=True), gram)):
            yield lo + i, s, words_digest(data[offsets[i] : offsets[i + 1]].tobytes())


def _describe(gram: int, key: int):  # noqa: ANN202
    """doc_id, text_hash, size of the set, digest of the words, its node and the set's parity sketch of SKETCH_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch = [], [], []
            for _, s, d in _described(batch, gram, key):
                n.append(len(s))
                digest.append(d)
                sketch.append(np.packbits((np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes())
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array([node_of(d) for d in digest], pa.int64()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "node", "sketch"])

    return run


_KINDS = [("node", "<i8"), ("own", "u1")]


def _index(gram: int, num: int, den: int, owners: int, key: int):  # noqa: ANN202
    """Blocks of (key, node): each set under its own band's keys, and under those of the band below, where it only seeks.

    A task files texts of the same words once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = exchange.Sender(owners, _KINDS), set()
        for batch in batches:
            for _, s, d in _described(batch, gram, key):
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                k, lo, top = band_of(len(s), num, den)
                for band, most in ((k, top), (k - 1, lo - 1)):
                    if most < 1:
                        continue
                    keys = segment_keys(s, band, most, num, den)
                    who = np.full(len(keys), node_of(d))
                    for block in out.add(keys, who, node=who, own=np.full(len(keys), band == k, np.uint8)):
                        yield exchange.batch_of(block)
            if len(seen) > 1 << 20:
                seen.clear()
        for block in out.flush():
            yield exchange.batch_of(block)

    return run


_FOUND = "kind int, x long, y long, own boolean"


def _gather(blocks: pa.Table) -> pa.Table:
    """At an owner: pairs (kind 0) of nodes of small groups and of each large group's least node with the others; members (kind 1) of large groups."""
    keys, docs, own = [], [], []
    for b in blocks.to_pylist():
        place = np.cumsum(np.unpackbits(np.frombuffer(b["place"], np.uint8))[: b["rows"]]) - 1
        keys.append(exchange.unrice(b["n"], b["k"], b["code"])[place])
        docs.append(np.frombuffer(b["payload"], "<i8", b["rows"]))
        own.append(np.frombuffer(b["payload"], "u1", b["rows"], 8 * b["rows"]))
    key, doc, own = np.concatenate(keys), np.concatenate(docs), np.concatenate(own)
    order = np.argsort(key, kind="stable")
    key, doc, own = key[order], doc[order], own[order]
    twin = np.r_[False, key[1:] == key[:-1]]
    some = twin | np.r_[twin[1:], False]
    key, doc, own = key[some], doc[some], own[some]
    order = np.lexsort((1 - own, doc, key))
    key, doc, own = key[order], doc[order], own[order]
    if len(key):
        fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        key, doc, own = key[fresh], doc[fresh], own[fresh]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[begin, len(key)])
    keep = (size > 1) & (np.add.reduceat(own, begin, dtype=np.int64) > 0) if len(begin) else np.empty(0, bool)
    begin, size = begin[keep], size[keep]
    pairs, members, known = [np.empty((0, 2), np.int64)], [], set()
    for g in range(2, SMALL_GROUP + 1):
        at = begin[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                mine = (own[at + i] | own[at + j]) > 0
                pairs.append(np.stack([doc[at + i], doc[at + j]], 1)[mine])
    for lo, g in zip(begin[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        mine, held = doc[lo : lo + g], own[lo : lo + g]
        name = hashlib.blake2b(mine.tobytes() + held.tobytes(), digest_size=8).digest()
        if name not in known:
            known.add(name)
            hub = mine[int(np.argmax(held))]
            rest = mine[mine != hub]
            pairs.append(np.stack([np.minimum(rest, hub), np.maximum(rest, hub)], 1))
            members.append((int.from_bytes(name, "big", signed=True), mine, held))
    pair = np.concatenate(pairs)
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    if len(pair):
        pair = pair[np.r_[True, (pair[1:] != pair[:-1]).any(1)]]
    n = sum(len(x[1]) for x in members)
    return pa.table(
        {
            "kind": np.repeat(np.array([0, 1], np.int32), [len(pair), n]),
            "x": np.concatenate([pair[:, 0], *[np.full(len(x[1]), x[0]) for x in members]]),
            "y": np.concatenate([pair[:, 1], *[x[1] for x in members]]),
            "own": np.concatenate([np.ones(len(pair), bool), *[x[2] > 0 for x in members]]),
        }
    )


_PAIR = "a struct<doc_id: long, text_hash: long>, b struct<doc_id: long, text_hash: long>"


def _tile(num: int, den: int):  # noqa: ANN202
    """Pairs of a tile that may be similar by size and sketch and aren't linked yet: differing sketch bits never exceed differing shingles."""

    def run(rows: pa.Table) -> pa.Table:
        n, own, tile = (np.asarray(rows[c].combine_chunks()) for c in ("n_shingles", "held", "tile"))
        root = np.stack([np.asarray(rows["root"].combine_chunks().field(c)) for c in ("doc_id", "text_hash")], 1)
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(n), -1)
        left, right = rows["left"][0].as_py(), rows["right"][0].as_py()
        x, y = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
        out = [np.empty((0, 2), np.int64)]
        for i in x:
            js = y[y > i] if left == right else y
            fits = (root[js] != root[i]).any(1) & ((own[js] > 0) | (own[i] > 0)) & (np.minimum(n[js], n[i]) * den >= np.maximum(n[js], n[i]) * num)
            js = js[fits]
            apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(1, dtype=np.int64)
            js = js[apart * (den + num) <= (n[js] + n[i]) * (den - num)]
            out.append(np.stack([np.full(len(js), i), js], 1))
        pair = np.concatenate(out)
        rep = rows["rep"].combine_chunks()
        return pa.table({"a": rep.take(pa.array(pair[:, 0])), "b": rep.take(pa.array(pair[:, 1]))})

    return run


def _by_sketch(num: int, den: int):  # noqa: ANN202
    """Pairs that sizes and sketches don't prove dissimilar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n_a), -1) for c in ("sketch_a", "sketch_b"))
                apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
                fits = (apart * (den + num) <= (n_a + n_b) * (den - num)) & (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits))

    return run


def exact_set(text: str | None, gram: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().translate(_ASCII_LOWER).split()
    if len(words) < gram:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(gram)), strict=False))


_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _verify(gram: int, num: int, den: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                good = []
                for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                    if a != last:
                        last, mine = a, exact_set(ta, gram)
                    other = exact_set(tb, gram)
                    both = len(mine & other)
                    good.append(den * both >= num * (len(mine) + len(other) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_classes(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN, key: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and, if count_links, n_links.

    A document's set holds its distinct gram-word shingles (A-Z lowered; words are runs of anything but space,
    tab, LF, VT, FF, CR), or all its words as one if there are fewer. Null texts and texts without words have
    empty sets and link with nothing. Two documents link when den * |intersection| >= num * |union|.
    component_id is the smallest doc_id that links lead to; texts of the same words form one class, whose least row
    stands for it in all further steps, so copies aren't expanded into pairs. n_links is the number of other rows
    that a row links with, those of its own class included; all pairs of a key's group are then compared, and
    the links between different classes are verified one by one, however many there are. Without it, only links that
    prove components are looked for, which is far less work in large groups.
    Rows without a key take no part and have no component. Rows of one key with unlike texts are judged each by its
    own text, and so may have unlike components. Other columns are ignored; an empty table gives no rows.

    Candidates and n_shingles go by 64-bit hashes of shingles under a key drawn for each run (two of a text's n shingles share one
    with a chance of about n * n / 2**65, and nobody can choose texts that do so more often); classes go by a digest of the words, and every link is verified on the words themselves.

    Groups under one key give pairs only up to SMALL_GROUP members. Larger ones give each member's pair with the
    least member first; groups that this leaves in several components (all, if links are counted) are compared in tiles by sketch, which
    proves most pairs dissimilar, and what is left is verified. So no link is lost, whatever a group's size.
    """
    rows = _near(docs, gram, num, den, key, text, count_links)
    there = F.col("doc_id").isNotNull()
    component = F.when(there, F.coalesce("root.doc_id", "doc_id")).alias("component_id")
    told = [F.when(there, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")] if count_links else []
    return rows.select("doc_id", "n_shingles", component, *told)


def _near(docs: DataFrame, gram: int, num: int, den: int, key: str, text: str, count_links: bool) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, root, n_links): root is the least (doc_id, text_hash) of the component; null without words or key."""
    spark = docs.sparkSession
    scratch, salt = Scratch(spark, "jaccard"), secrets.randbits(64)
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    plain = every.where("doc_id IS NOT NULL")
    rows = scratch.save(every.mapInArrow(_describe(gram, salt), "doc_id long, text_hash long, n_shingles long, digest binary, node long, sketch binary"), "rows")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.first("node").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = scratch.save(classes, "classes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    owners = exchange.owners_for(total * 6 // 10, exchange.partitions_of(docs))
    blocks = plain.select("text").mapInArrow(_index(gram, num, den, owners, salt), exchange.BLOCKS).drop("sender", "many")
    found = scratch.save(blocks.groupBy("owner").applyInArrow(_gather, _FOUND), "found")

    def ordered(pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)

    def of_classes(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of class representatives that may be similar."""
        sides = [classes.select(F.col("node").alias(at), F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")) for at, side in (("x", "a"), ("y", "b"))]
        mapped = ordered(pairs.distinct().join(sides[0], "x").join(sides[1], "y").where("a != b"), "n_a", "n_b", "sketch_a", "sketch_b")
        return mapped.mapInArrow(_by_sketch(num, den), _PAIR).distinct()

    def linked(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        wide = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch.save(wide.mapInArrow(_verify(gram, num, den), _PAIR), f"links{name}")

    pairs = scratch.save(of_classes(found.where("kind = 0").select("x", "y")), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    crowd = found.where("kind = 1").select(F.col("x").alias("gid"), F.col("y").alias("node"), "own").distinct().join(classes, "node")
    if large := bool(found.where("kind = 1").take(1)):
        needed = needed.unionAll(crowd.select("rep"))
    needed = needed.distinct().select("rep", "rep.doc_id", "rep.text_hash")
    texts = scratch.save(plain.join(needed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("rep", "text"), "texts")
    links = linked(pairs, texts, "1")
    roots = components(links)
    if large:
        members = crowd.groupBy("gid", "rep").agg(F.max(F.col("own").cast("int")).alias("held"), F.first("n").alias("n_shingles"), F.first("sketch").alias("sketch"))
        if count_links:
            members = members.withColumn("root", F.col("rep"))
        else:
            members = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        members = scratch.save(members, "members")
        apart = members.groupBy("gid").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("g")).where("one != other")
        tiles = F.ceil(F.col("g") / TILE).cast("int")
        tiled = members.join(apart.select("gid", "g"), "gid").withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        tiled = tiled.withColumns({"left": F.least("tile", "with"), "right": F.greatest("tile", "with")}).drop("with", "g")
        more = ordered(tiled.groupBy("gid", "left", "right").applyInArrow(_tile(num, den), _PAIR)).distinct()
        more = linked(more.join(pairs, ["a", "b"], "left_anti"), texts, "2")
        if more.take(1):
            links = scratch.save(links.unionAll(more), "links")
            roots = components(links)
    scratch.free("texts")
    known = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    if count_links:
        both = links.select("a", "b").unionAll(links.select("b", "a")).toDF("rep", "other")
        counts = both.join(classes.select(F.col("rep").alias("other"), F.col("copies").alias("more")), "other").groupBy("rep").agg(F.sum("more").alias("others"))
        known = known.join(counts, "rep", "left")
    n_links = [(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")] if count_links else []
    known = scratch.save(known.select("digest", F.coalesce("root", "rep").alias("root"), *n_links), "known")
    mine = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "digest").join(known, "digest").drop("digest")
    none = {"root": F.lit(None).cast("struct<doc_id: long, text_hash: long>")} | ({"n_links": F.lit(0).cast("long")} if count_links else {})
    return mine.unionByName(rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n_shingles").withColumns(none))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """One row of each component, the one of smallest key, with all its columns, whatever their names.

    Rows without a key and rows without words link with nothing and all stay. Rows of one key are judged each by its own
    text; of rows that agree in key and text one stays, and of unlike texts of that key in one component one,
    whichever. An empty table gives no rows. Whole rows cross the network once.
    """
    how = {"gram": GRAM, "num": NUM, "den": DEN} | how
    found = _near(docs, key=key, text=text, count_links=False, **how)
    stay = found.where(F.col("root") == F.struct("doc_id", "text_hash")).select("doc_id", "text_hash").distinct()
    mine = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    on = ["doc_id", "text_hash"]
    kept = mine.where(~alone).drop("text").join(stay, on, "left_semi").dropDuplicates(on)
    return kept.select("row.*").unionAll(mine.where(alone).select("row.*"))
