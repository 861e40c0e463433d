"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgraph.llm.arrays import _LOWER, pieces
from corpusgraph.plans.scratch import Scratch

#: Lengths of the n-grams (of UTF-8 bytes, A-Z lowered), the number of hashed n-grams and the bytes hashed at once.
SPECTRUM, SLOTS, CUT = (1, 2, 3, 4), 1 << 22, 1 << 20
#: The most weights (n-grams times classes) that are kept multiplied out, the steps of a feature, so that sums are exact, and the digits of a decision value.
DIRECT, STEPS, DIGITS = 1 << 24, 1 << 16, 9
#: A product of matrices is made once so many weights take part.
PRODUCT = 1 << 21
UNKNOWN = "und"
_last = np.zeros(SLOTS, np.int32)


def grams(data: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of one text, as slots; a long text is hashed in cuts that overlap by an n-gram."""
    if len(data) > CUT:
        return np.unique(np.concatenate([grams(data[lo : min(lo + CUT, len(data))]) for lo in range(0, len(data), CUT - max(SPECTRUM) + 1)]))
    data = _LOWER[data].astype(np.uint32)
    h, every = np.zeros(len(data), np.uint32), []
    for n in range(1, min(max(SPECTRUM), len(data)) + 1):
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        if n in SPECTRUM:
            every.append(((h * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 22))
    if not every:
        return np.empty(0, np.uint32)
    slot, place = np.concatenate(every), np.arange(sum(map(len, every)), dtype=np.int32)
    _last[slot] = place
    return slot[_last[slot] == place]


class Landmarks:
    """The n-grams of the landmark texts, each with the landmarks that have it."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        every = np.concatenate([*texts, np.empty(0, np.uint32)])
        mark = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
        order = np.argsort(every, kind="stable")
        self.slots, first = np.unique(every[order], return_index=True)
        self.mark, self.start = mark[order], np.r_[first, len(every)].astype(np.int64)
        self.scale = 1 / np.sqrt(np.maximum([len(x) for x in texts], 1))
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def hits(self, slots: np.ndarray) -> np.ndarray:
        """The places in self.slots of those of a text's n-grams that a landmark has."""
        if self._place is None:
            self._place = np.full(SLOTS, -1, np.int32)
            self._place[self.slots] = np.arange(len(self.slots), dtype=np.int32)
        found = self._place[slots]
        return found[found >= 0]

    def kernel(self, slots: np.ndarray) -> np.ndarray:
        """The kernel values of a text with all landmarks: shared n-grams over the root of both numbers of n-grams."""
        at = self.hits(slots)
        size = self.start[at + 1] - self.start[at]
        each = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.mark[each], minlength=len(self.scale)) * self.scale / np.sqrt(max(len(slots), 1))


class LanguageModel:
    """classes and, for each landmark and class, its weight in the class's decision value.

    Texts are scored in batches by a product of matrices. Kernel values and weights are both linear in a text's n-grams, so up to
    DIRECT numbers the weights are kept multiplied out (a row of the classes' weights for each n-gram), and a batch's sparse
    matrix of n-grams is multiplied with them; above, its matrix of kernel values with the weights. Both are sums of the same
    products in double precision; values are rounded to DIGITS digits, far above what their order can change.
    """

    def __init__(self, classes: list[str], marks: Landmarks, weights: np.ndarray, offset: np.ndarray) -> None:
        self.classes, self.marks, self.weights, self.offset = classes, marks, weights, offset
        self.direct = None
        if len(marks.slots) * len(classes) <= DIRECT:
            each = np.repeat(np.arange(len(marks.slots)), np.diff(marks.start))
            scaled = marks.scale[:, None] * weights
            self.direct = np.stack([np.bincount(each, scaled[marks.mark, c], len(marks.slots)) for c in range(len(classes))], 1) if len(classes) else None

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        """Decision values, a row for each text (its n-grams' slots) and a column for each class."""
        if self.direct is None:
            raw = np.stack([self.marks.kernel(x) for x in texts]) @ self.weights
        else:
            raw, lo = np.zeros((len(texts), len(self.classes))), 0
            while lo < len(texts):
                hits, size = [], 0
                while lo + len(hits) < len(texts) and size * len(self.classes) <= PRODUCT:
                    hits.append(self.marks.hits(texts[lo + len(hits)]))
                    size += len(hits[-1])
                sizes = np.array([len(x) for x in hits])
                some = np.flatnonzero(sizes)
                if len(some):
                    raw[lo + some] = np.add.reduceat(self.direct[np.concatenate(hits)], np.r_[0, np.cumsum(sizes[some])[:-1]], axis=0)
                lo += len(hits)
            raw /= np.sqrt(np.maximum([len(x) for x in texts], 1))[:, None]
        return np.round(raw + self.offset, DIGITS)

    def decide(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The class of the greatest value and the score of each text."""
        value = self.values(texts)
        best = value.argmax(1)
        return best, np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1)


def whitening(marks: Landmarks, texts: list[np.ndarray]) -> np.ndarray:
    value, vector = np.linalg.eigh(np.stack([marks.kernel(x) for x in texts]))
    good = value > value[-1] * 1e-6
    return vector[:, good] / np.sqrt(value[good])


def features(marks: Landmarks, whiten: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Nystroem features of texts in whole STEPS, and a constant."""
    return np.c_[np.rint(np.stack([marks.kernel(x) for x in texts]) @ whiten * STEPS), np.full(len(texts), STEPS)]


def fold(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 3


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: int = 1, per_class: int = 600, landmarks: int = 320, least_landmarks: int = 8, ridge: float = 0.1) -> LanguageModel:
    """Learns from rows with a label whose fold isn't held_out.

    Every label is learnt. The sample is bounded: about per_class texts of each label, chosen by hash of the key (of
    the text where it is null), and landmarks landmark texts, least_landmarks of each label at least. The n-grams of the landmark texts reach the driver; sums over the
    texts' features are formed by executors, exactly, so that their order doesn't matter.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("c")).where(F.col("c").isNotNull() & (fold(F.col("k")) != held_out) & F.col("t").isNotNull())
    counts = rows.groupBy("c").count().collect()
    classes = sorted(r["c"] for r in counts)
    if len(classes) < 2:
        return LanguageModel(classes, Landmarks([]), np.zeros((0, len(classes))), np.ones(len(classes)))
    draw = F.crc32(F.encode(F.concat(F.lit("sample:"), F.coalesce(F.col("k").cast("string"), F.col("t"))), "UTF-8"))
    share = docs.sparkSession.createDataFrame([(r["c"], int(min(1.0, per_class / r["count"]) * 2**32)) for r in counts], "c string, most long")

    def vectors(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("t"), 1 << 20):
                found = [grams(data[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(lo, hi - lo), batch.column("c").slice(lo, hi - lo), pa.array(found, pa.large_binary()).cast(pa.binary())], ["d", "c", "x"])

    scratch = Scratch(docs.sparkSession, "language")
    picked = rows.withColumn("d", draw).join(F.broadcast(share), "c").where(F.col("d") < F.col("most")).select("d", "c", "t")
    picked = scratch.save(picked.mapInArrow(vectors, "d long, c string, x binary"), "sample")
    first = F.row_number().over(W.partitionBy("c").orderBy("d", "x"))
    chosen = sorted((r["c"], r["d"], r["x"]) for r in picked.withColumn("nth", first).where(F.col("nth") <= max(least_landmarks, landmarks // len(classes))).select("c", "d", "x").collect())
    texts = [np.frombuffer(x, np.uint32) for _, _, x in chosen]
    marks = Landmarks(texts)
    whiten = whitening(marks, texts)
    sent = docs.sparkSession.sparkContext.broadcast((marks, whiten, classes))

    def sums(batches):  # noqa: ANN001, ANN202
        marks, whiten, classes = sent.value
        place, wide = {c: i for i, c in enumerate(classes)}, whiten.shape[1] + 1
        total = np.zeros((wide, wide + len(classes)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                x = features(marks, whiten, [np.frombuffer(t, np.uint32) for t in batch.column("x").slice(lo, 256).to_pylist()])
                y = np.full((len(x), len(classes)), -1.0)
                y[range(len(x)), [place[c] for c in batch.column("c").slice(lo, 256).to_pylist()]] = 1
                total += x.T @ np.c_[x, y]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    total = sum(np.frombuffer(r["x"]) for r in picked.repartition(8, "d").mapInArrow(sums, "x binary").toLocalIterator()).reshape(whiten.shape[1] + 1, -1)
    gram, moment = total[:, : len(total)] / STEPS**2, total[:, len(total) :] / STEPS
    beta = np.linalg.solve(gram + ridge * np.diag([1.0] * (len(gram) - 1) + [1e-6]), moment)
    scratch.free("sample")
    return LanguageModel(classes, marks, whiten @ beta[:-1], beta[-1])


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a column struct(lang, score): the predicted class and its score from 0 to 1.

    Null texts and texts without a letter are 'und' with score 0, and so are all texts if nothing was learnt.
    The whole text counts; nothing but the text does.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        m = sent.value
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for lo, hi, data, offsets in pieces(texts, 1 << 20):
            best[lo:hi], score[lo:hi] = m.decide([grams(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return pa.StructArray.from_arrays([pa.array(m.classes, pa.string()).take(pa.array(best)), pa.array(score)], ["lang", "score"])

    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not model.classes:
        return docs.withColumn(into, none)
    return docs.withColumn(into, F.when(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), predict(F.col(text))).otherwise(none))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **how: float) -> DataFrame:
    """One row per row of docs: doc_id, held_out (fold 1 of crc32(key) mod 3, never learnt from), lang_pred, score.

    A null key is in fold 0. Other columns are ignored; an empty table gives no rows. Repeated rows are predicted one by
    one, and alike texts alike. Texts of any length count whole. The kernel's n-grams are hashed to SLOTS numbers, so
    two n-grams may count as one; a text's distinct n-grams are far fewer than the slots.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = with_language(plain.drop("lang"), train(plain, "doc_id", "text", "lang", **how))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def drop_unknown(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **how: float) -> DataFrame:
    """The rows of docs whose text has a language, with all their columns, whatever their names; texts without a letter and nulls go.

    If no label could be learnt, texts with a letter stay all the same. Repeated rows are judged one by one; an empty table gives no rows.
    """
    model = train(docs, key, text, lang, **how)
    if not model.classes:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return with_language(rows, model, "text", "language").where(F.col("language.lang") != UNKNOWN).select("row.*")
