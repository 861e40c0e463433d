"""SentencePiece encoding and decoding with sampled segmentations.

Forward filtering: over the lattice of all ways to write a stretch of text in pieces, each byte position gets the
total weight of the ways to reach it. Backward sampling: from the end, the last piece is drawn in proportion
to the weight through it, and so on. Draws are hashes of the row key and the place, so runs agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import exchange
from corpusgraph.llm.arrays import mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_G, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Stretches of more bytes are walked one by one; shorter ones side by side. Edges that a walk takes up at once.
LONG, EDGES = 1024, 1 << 15


class Vocabulary:
    """Pieces as bytes, a space standing for the word mark; byte pieces write what no other piece can.

    The mark character itself in a text is written in byte pieces, so decoding is lossless. A model of merges
    has ranks, not probabilities: a piece of rank r weighs (r + 2) ** -sharpness, a byte piece as the last rank.
    """

    def __init__(self, model: bytes, sharpness: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text: list[bytes] = [b""] * len(sp)
        self.byte = np.full(256, -1, np.int32)
        self.weight = -sharpness * np.log(np.arange(len(sp)) + 2.0)
        pieces = {}
        for i in range(len(sp)):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.text[i], self.byte[value], self.weight[i] = bytes([value]), i, -sharpness * math.log(len(sp) + 2)
            else:
                self.text[i] = sp.id_to_piece(i).replace("\u2581", " ").encode()
                pieces[self.text[i]] = i
        if self.byte.min() < 0:
            raise ValueError("the model has no byte pieces; it can't write every text")
        self.by_line = not any(b"\n" in p for p in pieces)
        self.by_space = not any(b" " in p.lstrip(b" ") for p in pieces)
        self._plant(pieces)

    def _plant(self, pieces: dict[bytes, int]) -> None:
        """A trie as an open-addressed table of (node, byte) -> node."""
        nodes: dict[bytes, int] = {b"": 0}
        moves: list[tuple[int, int]] = []
        leaf = [-1]
        for p in sorted(pieces):
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(leaf)
                    moves.append((nodes[p[: n - 1]] << 8 | p[n - 1], len(leaf)))
                    leaf.append(-1)
            leaf[nodes[p]] = pieces[p]
        self.leaf = np.array(leaf, np.int32)
        self.mask = (1 << (len(moves) * 4).bit_length()) - 1
        self.slot, self.next = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        keys, nexts = np.array([m[0] for m in moves]), np.array([m[1] for m in moves], np.int32)
        at = self._hash(keys)
        while len(keys):
            free = np.flatnonzero(self.slot[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slot[at[put]], self.next[at[put]] = keys[put], nexts[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, nexts, at = keys[rest], nexts[rest], (at[rest] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 7) & self.mask

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node of each, -1 where there is none."""
        keys = node.astype(np.int64) << 8 | byte
        at = self._hash(keys)
        out = np.where(self.slot[at] == keys, self.next[at], -1)
        todo = np.flatnonzero((self.slot[at] != keys) & (self.slot[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.slot[at[todo]]
            out[todo[found == keys[todo]]] = self.next[at[todo[found == keys[todo]]]]
            todo = todo[(found != keys[todo]) & (found >= 0)]
        return out

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the stretches begin: no piece crosses these places."""
        new = np.zeros(len(data), bool)
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.by_space:
            new[1:] |= (data[1:] == 32) & (data[:-1] != 32)
            if self.by_line:
                new[1:] |= (data[1:] == 10) | (data[:-1] == 10)
        return np.flatnonzero(new)


class Lattice:
    """Forward-filtered lattices of stretches that stand one after the other in data."""

    def __init__(self, v: Vocabulary, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.begin, self.end = begin, end
        home = np.repeat(begin, end - begin)
        room = np.repeat(end, end - begin) - np.arange(len(data))
        head = np.flatnonzero(data & 0xC0 != 0x80)
        size = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        at, node, n = head, np.zeros(len(head), np.int32), 0
        source, target, piece = [], [], []
        single = np.zeros(len(data), bool)
        while len(at):
            node = v.step(node, data[at + n])
            n += 1
            on = node >= 0
            at, node = at[on], node[on]
            done = v.leaf[node] >= 0
            source.append(at[done])
            target.append(at[done] + n)
            piece.append(v.leaf[node[done]])
            single[at[done][size[at[done]] == n]] = True
            go = room[at] > n
            at, node = at[go], node[go]
        lone = head[~single[head]]
        raw = np.repeat(lone, size[lone]) + np.concatenate([np.arange(k) for k in size[lone]] or [np.empty(0, np.int64)])
        source.append(raw)
        target.append(raw + 1)
        piece.append(v.byte[data[raw]])
        source, target, piece = np.concatenate(source), np.concatenate(target), np.concatenate(piece)
        order = np.argsort(target, kind="stable")
        self.source, target, self.piece = source[order], target[order], piece[order]
        self.total = self._filter(target, home, v.weight[self.piece])

    def _filter(self, target: np.ndarray, home: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each edge, its end plus the running share of the ways into that end that it and those before it carry."""
        far = target - home[target - 1]
        long = (self.end - self.begin) > LONG
        side = np.flatnonzero(~np.repeat(long, self.end - self.begin)[target - 1]) if long.any() else slice(None)
        order = np.argsort(far[side], kind="stable") if isinstance(side, slice) else side[np.argsort(far[side], kind="stable")]
        cuts = np.r_[0, np.flatnonzero(np.diff(far[order])) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
        forward = np.zeros(len(home) + 1)
        inner = self.source != home[self.source]
        total = np.empty(len(target))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = order[lo:hi]
            ends = target[e]
            first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(e)]))
            log = weight[e] + np.where(inner[e], forward[self.source[e]], 0.0)
            most = np.maximum.reduceat(log, first)
            share = np.exp(log - most[group])
            whole = np.add.reduceat(share, first)
            forward[ends[first]] = most + np.log(whole)
            run = np.cumsum(share)
            run = (run - (run[first] - share[first])[group]) / whole[group]
            run[np.r_[first[1:], len(e)] - 1] = 1.0
            total[e] = ends + np.minimum(run, 1.0)
        for begin, end in zip(self.begin[long].tolist(), self.end[long].tolist(), strict=True):
            self._walk(begin, end, target, weight, total)
        return total

    def _walk(self, begin: int, end: int, target: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """_filter() for one stretch, end by end; a step of arrays for each of its bytes would take far longer."""
        forward = [0.0] * (end - begin + 1)
        lo, last = np.searchsorted(target, [begin + 1, end + 1]).tolist()
        while lo < last:
            hi = min(lo + EDGES, last)
            if hi < last:
                hi = int(np.searchsorted(target, target[hi]))  # edges into one end stay together; there are fewer than EDGES
            into, back, by = target[lo:hi].tolist(), (self.source[lo:hi] - begin).tolist(), weight[lo:hi].tolist()
            out, i = [], 0
            while i < len(into):
                at, j = into[i], i + 1
                while j < len(into) and into[j] == at:
                    j += 1
                logs = [by[x] + forward[back[x]] for x in range(i, j)]
                most = max(logs)
                shares = [math.exp(x - most) for x in logs]
                whole, run = sum(shares), 0.0
                forward[at - begin] = most + math.log(whole)
                for share in shares:
                    run += share
                    out.append(at + min(run / whole, 1.0))
                out[-1] = at + 1.0
                i = j
            total[lo:hi] = out
            lo = hi

    def sample(self, kinds: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all stretches (kinds, each with a seed) one after the other, and the number of ids of each."""
        order = np.argsort(kinds, kind="stable")
        kinds, seeds = kinds[order], seeds[order]
        begin, state = self.begin[kinds], self.end[kinds].copy()
        drawn, count = [], np.zeros(len(kinds), np.int64)
        walked = {i: self._drawn(int(begin[i]), int(state[i]), int(seeds[i])) for i in np.flatnonzero(state - begin > LONG).tolist()}
        live = np.flatnonzero(state - begin <= LONG)
        while len(live):
            u = (mix(seeds[live] + count[live].astype(np.uint64) * _K) >> np.uint64(40)).astype(float) * 2.0**-24 + 2.0**-25
            edge = np.searchsorted(self.total, state[live] + u, "right")
            drawn.append((live, self.piece[edge]))
            state[live] = self.source[edge]
            count[live] += 1
            live = live[state[live] > begin[live]]
        for i, ids in walked.items():
            count[i] = len(ids)
        sizes = np.empty(len(count), np.int64)
        sizes[order] = count
        last = np.cumsum(sizes)[order]
        out = np.empty(int(sizes.sum()), np.int32)
        for step, (who, ids) in enumerate(drawn):
            out[last[who] - 1 - step] = ids
        for i, ids in walked.items():
            out[last[i] - len(ids) : last[i]] = ids[::-1]
        return out, sizes

    def _drawn(self, begin: int, end: int, seed: int) -> np.ndarray:
        """The ids of one long stretch from its end on; draws as in sample(), all made before the walk."""
        u = (mix(np.uint64(seed) + np.arange(end - begin, dtype=np.uint64) * _K) >> np.uint64(40)).astype(float) * 2.0**-24 + 2.0**-25
        ids, total, source = [], self.total, self.source
        for draw in u.tolist():
            edge = int(total.searchsorted(end + draw, "right"))
            ids.append(edge)
            end = int(source[edge])
            if end <= begin:
                break
        return self.piece[np.array(ids)]


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches to keep, one of each content, and for each stretch the place of its like among them."""
    up, down = powers(_G, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    name = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _K)
    _, keep, place = np.unique(name, return_index=True, return_inverse=True)
    like = keep[place]
    shift = np.repeat(begin[like] - begin, end - begin) + np.arange(len(data))
    if ((end - begin) != (end - begin)[like]).any() or (data[np.minimum(shift, len(data) - 1)] != data).any():
        return np.arange(len(begin)), np.arange(len(begin))
    return keep, place


def encode_batch(v: Vocabulary, keys: np.ndarray, texts: list[str | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled ids of all texts one after the other and where each text's begin and end; null has none."""
    bodies = [b"" if t is None else b" " + t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(b) for b in bodies])]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    if not len(data):
        return np.empty(0, np.int32), offsets
    begin = v.starts(data, offsets)
    end = np.r_[begin[1:], len(data)]
    keep, kinds = _distinct(data, begin, end)
    sizes = (end - begin)[keep]
    stop = np.cumsum(sizes)
    own = data[np.repeat(begin[keep] - (stop - sizes), sizes) + np.arange(stop[-1])]
    lattice = Lattice(v, own, stop - sizes, stop)
    first = np.searchsorted(begin, offsets)
    row = np.repeat(mix(keys.astype(np.uint64) + np.uint64(seed) * _K), np.diff(first))
    place = np.arange(len(begin)) - np.repeat(first[:-1], np.diff(first))
    ids, counts = lattice.sample(kinds, row + place.astype(np.uint64) * _G)
    return ids, np.r_[0, np.cumsum(counts)][first]


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text that was encoded: the pieces' bytes without the space put before the text."""
    return b"".join([vocabulary.text[i] for i in ids])[1:].decode()


_held: dict[tuple, Vocabulary] = {}


def _vocabulary(model: bytes, name: tuple) -> Vocabulary:
    """One per worker."""
    if name not in _held:
        _held[name] = Vocabulary(model, name[1])
    return _held[name]


def encode(docs: DataFrame, model: str = MODEL, sharpness: float = 1.0, seed: int = 1, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int, null for null text), n_ids (null text: 0), lossless.

    Segmentations are sampled; the key, the seed and a place in the text fix the draw, so equal rows agree on
    every run and over any partitioning. A null key counts as 0. Empty text gives the piece of the leading
    space. lossless tells that decoding the ids gave the text back (true for null text; null where check is
    off). Whole texts are encoded, about 512 KB of them at a time. No piece crosses the borders of a stretch (a
    word with the spaces before it), so stretches of one content share one lattice; only draws are made anew.
    Other columns are ignored; an empty table gives no rows.
    """
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    name = (model, sharpness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent.value, name)
        for whole in batches:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(whole.column("text")), 0)).astype(np.int64)
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), 1 << 19, "right")) + lo)
                batch, lo = whole.slice(lo, hi - lo), hi
                keys, _ = exchange.ids(batch.column("doc_id"))
                texts = batch.column("text").to_pylist()
                flat, ends = encode_batch(v, keys, texts, seed)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts], pa.bool_()))
                good = [None if not check else t is None or decode_ids(v, flat[a:b].tolist()) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.diff(ends), pa.int64()), pa.array(good, pa.bool_())], ["doc_id", "ids", "n_ids", "lossless"])

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with the column into: the text of their ids; null ids give null."""
    with open(model, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())
    name = (model, 1.0)

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        v = _vocabulary(sent.value, name)
        return pa.array([None if x is None else decode_ids(v, x) for x in column.to_pylist()], pa.string())

    return rows.withColumn(into, text_of(F.col(ids)))
