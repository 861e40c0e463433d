"""Golomb-coded exchange of keys: which keys occur in more than one row of the whole table?

Senders cut their rows into blocks by owner (the key's high bits), each with its distinct keys sorted and
Golomb-Rice coded. Owners decode the blocks, and send back one bit per key: does it occur elsewhere too?
Only keys cross the network on the way there and bits on the way back; a key that a sender holds a million
times is sent once, so that no key is hot. Owners hold about OWNER_KEYS keys each, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "sender string, owner int, n int, k int, code binary, many binary, place binary, payload binary, rows int"
OWNER_KEYS = 1 << 21
FLUSH_ROWS = 1 << 20


def owners_for(keys: int, partitions: int) -> int:
    """A power of two: enough owners for OWNER_KEYS keys each and for all partitions."""
    return 1 << max(0, math.ceil(math.log2(max(1, keys / OWNER_KEYS, 2 * partitions))))


def rice(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct uint64: unary quotients of the gaps, then remainders of k bits."""
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[0] = 0
    n = len(values)
    k = max(0, int(float(values[-1] - values[0]) / n).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), bool)
    unary[ends - 1] = True
    bits = np.unpackbits((gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8)).reshape(n, 64)[:, 64 - k :]
    return k, int(values[0]).to_bytes(8, "big") + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def unrice(n: int, k: int, code: bytes) -> np.ndarray:
    tail = (n * k + 7) // 8
    body = np.frombuffer(code, np.uint8)
    unary = np.unpackbits(body[8 : len(body) - tail])
    quotient = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    bits = np.zeros((n, 64), np.uint8)
    if k:
        bits[:, 64 - k :] = np.unpackbits(body[len(body) - tail :])[: n * k].reshape(n, k)
    rest = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(k)) | rest
    gaps[0] = int.from_bytes(code[:8], "big")
    return np.cumsum(gaps)


class Sender:
    """Gathers rows of one task (key, document, payload fields) and yields blocks; at most FLUSH_ROWS rows are held."""

    def __init__(self, owners: int, kinds: list[tuple[str, str]], settle: Callable[[np.ndarray, dict], dict] | None = None) -> None:
        """settle(keys, fields) gives further fields from all rows of a flush."""
        from pyspark import TaskContext

        context = TaskContext.get()
        self.name, self.flushes = f"{context.partitionId() if context else 0}", 0
        self.shift, self.kinds, self.held, self.rows, self.settle = 64 - (owners.bit_length() - 1), kinds, [], 0, settle

    def add(self, key: np.ndarray, who: np.ndarray, **fields: np.ndarray) -> Iterator[dict]:
        """who: equal numbers for rows of one document, whose keys don't count as shared among themselves."""
        self.held.append((key, who, fields))
        self.rows += len(key)
        if self.rows >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        held, self.held, self.rows = self.held, [], 0
        if not sum(len(x[0]) for x in held):
            return
        key, who = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        fields = {name: np.concatenate([x[2][name] for x in held]) for name in held[0][2]}
        if self.settle:
            fields |= self.settle(key, fields)
        order = np.argsort(key, kind="stable")
        key, who, fields = key[order], who[order], {name: x[order] for name, x in fields.items()}
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        many = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
        owner = (key >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(key), np.int64)
        cuts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(key)]
        self.flushes += 1
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = slice(place[lo], place[hi - 1] + 1)
            distinct = key[begin[at]]
            k, code = rice(distinct)
            yield {
                "sender": f"{self.name}-{self.flushes}", "owner": int(owner[lo]), "n": len(distinct), "k": k, "code": code,
                "many": np.packbits(many[at]).tobytes(), "place": np.packbits(new[lo:hi]).tobytes(),
                "payload": b"".join(np.ascontiguousarray(fields[name][lo:hi], kind).tobytes() for name, kind in self.kinds), "rows": hi - lo,
            }


_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in BLOCKS.split(", ")])


def batch_of(block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([block], schema=_ARROW)


def _shared(blocks: pa.Table) -> pa.Table:
    """At an owner: a bit for each key of each block, set if the key occurs in another block or in several documents of its own."""
    n, k = blocks["n"].to_pylist(), blocks["k"].to_pylist()
    keys = [unrice(*x) for x in zip(n, k, blocks["code"].to_pylist(), strict=True)]
    many = [np.unpackbits(np.frombuffer(b, np.uint8))[:m].astype(bool) for m, b in zip(n, blocks["many"].to_pylist(), strict=True)]
    _, where, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    local = np.zeros(len(count), bool)
    local[where[np.concatenate(many)]] = True
    bits = ((count > 1) | local)[where]
    ends = np.cumsum([0, *n])
    packed = [np.packbits(bits[lo:hi]).tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"sender": blocks["sender"], "owner": blocks["owner"], "bits": pa.array(packed, pa.binary())})


def with_bits(blocks: DataFrame) -> DataFrame:
    """blocks, each with the owner's bits for its keys."""
    sent = blocks.select("sender", "owner", "n", "k", "code", "many")
    bits = sent.groupBy("owner").applyInArrow(_shared, "sender string, owner int, bits binary")
    return blocks.select("sender", "owner", "n", "k", "code", "place", "payload", "rows").join(bits, ["sender", "owner"])


def opened(block: dict, kinds: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The rows of a block from with_bits(): keys, whether each is shared, payload fields."""
    rows, keys = block["rows"], unrice(block["n"], block["k"], block["code"])
    place = np.cumsum(np.unpackbits(np.frombuffer(block["place"], np.uint8))[:rows]) - 1
    shared = np.unpackbits(np.frombuffer(block["bits"], np.uint8))[: block["n"]].astype(bool)
    fields, at = {}, 0
    for name, kind in kinds:
        fields[name] = np.frombuffer(block["payload"], kind, rows, at)
        at += fields[name].nbytes
    return keys[place], shared[place], fields


def open_rows(blocks: DataFrame, kinds: list[tuple[str, str]], make: Callable[[np.ndarray, np.ndarray, dict], pa.Table], schema: str) -> DataFrame:
    """make(keys, shared, fields) for each block, as one DataFrame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from make(*opened(batch.slice(i, 1).to_pylist()[0], kinds)).to_batches()

    return with_bits(blocks).mapInArrow(run, schema)


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_id as int64 and whether it is there."""
    return np.asarray(column.cast(pa.int64()).fill_null(0)), np.asarray(column.is_valid())


def nullable(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=there == 0)
