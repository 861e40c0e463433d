"""Token counts of subword vocabularies: byte-pair merging in Arrow batches, with a memo of words in each worker."""

from __future__ import annotations

import base64
import heapq
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how texts are cut into words before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: So many words (and those of one block more) a worker remembers, and the longest that it does.
MEMO, MEMO_BYTES = 1 << 18, 64
#: Characters of texts whose words are looked up together, words that are merged at once, and how many are worth it.
BLOCK, AT_ONCE, FEW = 1 << 20, 1 << 14, 32


class TokenCounter(Protocol):
    """A plug-in: anything that can be sent to the workers and counts the tokens of texts."""

    def sizes(self, texts: list[str]) -> list[int]: ...


class Words:
    """Counts words between blanks."""

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a word: while two neighbours make a token, the pair of least rank that comes first is merged.

    Neighbours are linked, and pairs wait in a heap, so that a word of n bytes takes n * log(n) steps, however long it is.
    """
    parts = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    gone = bytearray(len(parts))
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        parts[i] += parts[j]
        gone[j] = 1
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p, x in zip(parts, gone, strict=True) if not x]


class _Merges:
    """All pairs of tokens that make a token, as sorted keys, for merging many words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        names = [*ranks, *(x for x in (bytes([i]) for i in range(256)) if x not in ranks)]
        place = {t: i for i, t in enumerate(names)}
        self.rank = np.array([*ranks.values(), *[0] * (len(names) - len(ranks))], np.int64)
        self.tokens = len(names)
        found = [(place[a] * len(names) + place[b], i) for i, t in enumerate(ranks) for n in range(1, len(t)) if (a := t[:n]) in place and (b := t[n:]) in place]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.made = np.r_[pairs[:, 0], np.iinfo(np.int64).max], np.r_[pairs[:, 1], -1]
        self.bytes = np.array([place[bytes([i])] for i in range(256)], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each two tokens make, or -1."""
        wanted = left * self.tokens + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.made[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (none of them empty), as merged() makes them: in each round every word merges its pair of least rank that comes first."""
        out = np.zeros(len(words), np.int64)
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), [len(w) for w in words])
        made = np.r_[np.where(own[1:] == own[:-1], self.pair(ids[:-1], ids[1:]), -1), -1]
        never = np.iinfo(np.int64).max
        while len(ids):
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            cost = np.where(made >= 0, self.rank[made] * len(ids) + np.arange(len(ids)), never)
            best = np.minimum.reduceat(cost, begin)
            size, done = np.diff(np.r_[begin, len(ids)]), best == never
            out[own[begin[done]]] = size[done]
            at = best[~done] % len(ids)
            ids[at] = made[at]
            keep = np.repeat(~done, size)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, own, made = ids[keep], own[keep], made[keep]
            for i in (at, at[at > 0] - 1):
                after = np.minimum(i + 1, len(ids) - 1)
                made[i] = np.where((own[after] == own[i]) & (after > i), self.pair(ids[i], ids[after]), -1)
        return out


class BytePairs:
    """Counts tokens of a byte-level vocabulary (tokens with their ranks). The memo stays in the worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.pattern = ranks, pattern
        self._cut, self._merges, self._memo = None, None, {}

    @classmethod
    def read(cls, spark: SparkSession, path: str = VOCABULARY, pattern: str = PATTERN) -> BytePairs:
        """From a file of lines 'token in Base64, blank, rank'; the vocabulary, not a corpus, passes the driver."""
        lines = spark.read.text(path if "://" in path else f"file://{path}").where("value <> ''").toArrow()["value"].to_pylist()
        return cls({base64.b64decode(a): int(b) for a, b in map(str.split, lines)}, pattern)

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "_cut": None, "_merges": None, "_memo": {}}

    def _learn(self, words: set[str]) -> list[str]:
        """Puts the words' counts into the memo; gives those that are too long to stay there."""
        if len(self._memo) > MEMO:
            self._memo.clear()
        new, long = [], []
        for word in words.difference(self._memo):
            body = word.encode()
            if len(body) > MEMO_BYTES:
                long.append(word)
            if body in self.ranks:
                self._memo[word] = 1
            elif len(body) > MEMO_BYTES:
                self._memo[word] = len(merged(body, self.ranks))
            else:
                new.append((word, body))
        if len(new) < FEW:
            self._memo.update((w, len(merged(x, self.ranks))) for w, x in new)
        else:
            self._merges = self._merges or _Merges(self.ranks)
            for lo in range(0, len(new), AT_ONCE):
                some = new[lo : lo + AT_ONCE]
                self._memo.update(zip((w for w, _ in some), self._merges.counts([x for _, x in some]).tolist(), strict=True))
        return long

    def sizes(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Words that are new in some texts (about BLOCK characters) are merged together."""
        if self._cut is None:
            self._cut = regex.compile(self.pattern)
        out, lo = [], 0
        while lo < len(texts):
            held, cut = 0, []
            while lo < len(texts) and held < BLOCK:
                held += len(texts[lo])
                cut.append(self._cut.findall(texts[lo]))
                lo += 1
            long = self._learn(set().union(*cut))
            out += [sum(map(self._memo.__getitem__, words)) for words in cut]
            for word in long:
                del self._memo[word]
        return out


def count_tokens(rows: DataFrame, counter: TokenCounter, text: str = "text", into: str = "tokens") -> DataFrame:
    """rows with the number of tokens of a text column (null: 0). Whole texts are counted in Arrow batches; nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(counter)

    @F.arrow_udf("int")
    def sizes(column: pa.Array) -> pa.Array:
        out: list[int] = []
        for lo in range(0, len(column), 256):
            out += sent.value.sizes([t or "" for t in column.slice(lo, 256).to_pylist()])
        return pa.array(out, pa.int32())

    return rows.withColumn(into, sizes(F.col(text)))
