"""Hard negatives by distributed radix selection over integer scores.

Items and windows (ranges of scores, one for each anchor or anchor and positive) are dealt to cells of a grid, so that
each item meets each anchor in one cell and no side is broadcast. In a pass every cell counts, for each window, its
items by the next digit of the score, from the top; the sums over cells tell the bucket of the k-th score, and the next
pass looks at that bucket only. When all digits are known, items above the k-th score and the least ids among its ties
are gathered. A cell sends counts of at most k buckets and at most k items a window: a lower bucket than that of its
own k-th item can't hold the k-th of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch

DIGIT = 9
CELL_ITEMS, CELL_ANCHORS = 1 << 16, 1 << 13
BLOCK = 1 << 21
ITEM = "vec_id long, label int, vector binary"


def _quantised(scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        ends = np.asarray(vectors.offsets)
        flat = np.asarray(vectors.values.cast(pa.float64()).fill_null(np.nan))[ends[0] : ends[-1]]
        ends = ends - ends[0]
        bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
        take = np.asarray(batch.column("label").is_valid()) & np.asarray(batch.column("vec_id").is_valid()) & np.asarray(vectors.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]])
        flat = np.floor(scale * np.where(np.repeat(take, np.diff(ends)), flat, 0))
        norms = np.r_[0, np.cumsum(flat * flat)]
        norms = norms[ends[1:]] - norms[ends[:-1]]
        if norms.max(initial=0) >= 2**52:
            raise ValueError("scores of 2**52 or more can't be told exactly; take a smaller scale")
        raw = flat.astype("<i4").tobytes()
        rows = np.flatnonzero(take)
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id").take(pa.array(rows)), "label": batch.column("label").take(pa.array(rows)),
            "vector": pa.array([raw[4 * ends[i] : 4 * ends[i + 1]] for i in rows], pa.binary()), "norm": norms[rows].astype(np.int64),
        })


def quantised(items: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, vector (floor(scale * x) as 32-bit integers), norm (the vector's score with itself) of the rows that take part."""
    plain = items.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return plain.mapInArrow(partial(_quantised, scale), ITEM + ", norm long")


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, x in enumerate(vectors):
        row = np.frombuffer(x, "<i4")
        out[i, : len(row)] = row
    return out


def _blocks(items: pd.DataFrame, windows: pd.DataFrame, same: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Blocks of a cell: windows, vec_ids in order, and for each window how far each item's score lies below its high end; -1 where the item isn't in the window."""
    if not len(items) or not len(windows):
        return
    items, windows = items.sort_values("vec_id", kind="stable"), windows.sort_values("window", kind="stable")
    size = max(len(x) for v in (items["vector"], windows["vector"]) for x in v) // 4
    x, step = _matrix(items["vector"], size).T, max(1, BLOCK // len(items))
    ids, labels = items["vec_id"].to_numpy(), items["label"].to_numpy()
    for at in range(0, len(windows), step):
        part = windows.iloc[at : at + step]
        of = lambda name: part[name].to_numpy()[:, None]  # noqa: B023, E731
        scores = (_matrix(part["vector"], size) @ x).astype(np.int64)
        fits = ((labels == of("label")) == same) & (ids != of("vec_id")) & (scores >= of("low")) & (scores <= of("high"))
        yield part, ids, np.where(fits, of("high") - scores, -1)


def _counted(same: bool, shift: int, items: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
    """Counts by window and digit, from the top bucket down to that of the cell's own k-th item."""
    out = []
    for part, _, below in _blocks(items, windows, same):
        digit = np.where(below < 0, np.int64(1) << 62, below >> shift)
        k = np.minimum(part["need"].to_numpy(), digit.shape[1])
        top = np.sort(np.partition(digit, k.max() - 1, axis=1)[:, : k.max()], axis=1)
        row, column = np.nonzero((digit <= np.take_along_axis(top, k[:, None] - 1, axis=1)) & (below >= 0))
        codes, counts = np.unique(np.stack([row, digit[row, column]]), axis=1, return_counts=True)
        out.append(pd.DataFrame({"window": part["window"].to_numpy()[codes[0]], "digit": codes[1], "n": counts}))
    return pd.concat(out) if out else pd.DataFrame({"window": [], "digit": [], "n": []}, dtype="int64")


def _gathered(same: bool, items: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
    """The items in each window above its low end, and of those at the low end the first `need` by vec_id."""
    out = []
    for part, ids, below in _blocks(items, windows, same):
        ties = below == (part["high"] - part["low"]).to_numpy()[:, None]
        row, column = np.nonzero((below >= 0) & (~ties | (np.cumsum(ties, axis=1) <= part["need"].to_numpy()[:, None])))
        out.append(pd.DataFrame({"window": part["window"].to_numpy()[row], "vec_id": ids[column], "score": part["high"].to_numpy()[row] - below[row, column]}))
    return pd.concat(out) if out else pd.DataFrame({"window": [], "vec_id": [], "score": []}, dtype="int64")


class Grid:
    """Items, numbered so that they can be dealt, and the cells in which they meet windows."""

    def __init__(self, items: DataFrame, n_items: int, n_anchors: int) -> None:
        self.items = items
        partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.across = max(1, math.ceil(n_anchors / CELL_ANCHORS))
        self.down = max(1, math.ceil(n_items / CELL_ITEMS), math.ceil(partitions / self.across))

    def cells(self, windows: DataFrame, make, schema: str) -> DataFrame:  # noqa: ANN001
        mine = self.items.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(self.across - 1)))).withColumn("j", F.pmod("number", F.lit(self.down)).cast("int"))
        theirs = windows.withColumn("i", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(self.across)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(self.down - 1))))
        return mine.groupBy("i", "j").cogroup(theirs.groupBy("i", "j")).applyInPandas(make, schema)


def radix_select(scratch: Scratch, grid: Grid, windows: DataFrame, k: int, same: bool, span: int, name: str) -> DataFrame:
    """window, vec_id, score, rank: of the items with the anchor's label (same) or another whose score lies in the window, the first k by score, then vec_id.

    windows: window, vec_id, label and vector of the anchor, low and high end; one row a window, none wider than span scores.
    """
    goal = windows.withColumn("need", F.lit(k).cast("long"))
    state, digits = goal, max(1, math.ceil((span - 1).bit_length() / DIGIT))
    for d in range(digits):
        shift = DIGIT * (digits - 1 - d)
        counts = grid.cells(state, partial(_counted, same, shift), "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
        # At most 2**DIGIT rows a window, and no more than the cells have sent.
        upto = counts.select("window", "digit", "n", F.expr("sum(n) OVER (PARTITION BY window ORDER BY digit)").alias("upto")).join(state.select("window", "need"), "window")
        found = upto.where("upto >= need").groupBy("window").agg(F.min(F.struct("digit", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))).alias("at"))
        # The bucket of the k-th score is the next window. Windows that have fewer than k items end here.
        high = F.col("high") - F.expr(f"shiftleft(at.digit, {shift})")
        low = F.greatest("low", high - (1 << shift) + 1)
        state = scratch.save(state.join(found, "window").select("window", "vec_id", "label", "vector", low.alias("low"), high.alias("high"), F.col("at.left").alias("need")), f"{name}-{d}")
    kth = state.select("window", F.col("high").alias("kth"), F.col("need").alias("ties"))
    ready = goal.join(kth, "window", "left").withColumns({"low": F.coalesce("kth", "low"), "need": F.coalesce("ties", "need")}).drop("kth", "ties")
    rows = grid.cells(scratch.save(ready, f"{name}-ready"), partial(_gathered, same), "window long, vec_id long, score long")
    out = scratch.save(rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY window ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k), name)
    scratch.free(*[f"{name}-{d}" for d in range(digits)], f"{name}-ready")
    return out


def mine(items: DataFrame, anchors: Column, scale: float = 256, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of items (vec_id, label, embedding).

    Scores are inner products of the components' floor(scale * x). An anchor's positives are the first rows of its label by
    score, then smaller vec_id; a positive's negatives are the first rows of other labels with a score of percent to 100
    per cent of the positive's, so that a negative score of a positive leaves none. Rows with a null vec_id, label, vector or component,
    or a component that isn't finite, take no part. A vector that is shorter than another counts as padded with zeros;
    empty ones score 0. Rows with the anchor's vec_id are neither its positives nor its negatives. Other repeated rows each count: as
    positives they give rows of their own, and they take several ranks. Anchors that repeat a vec_id each give
    rows; those alike in label and vector are searched for once. Other columns are ignored, whatever their names; an empty table gives no rows.
    Where sums could reach 2**52, an error is raised.
    """
    scratch = Scratch(items.sparkSession, "negatives")
    rows = scratch.save(quantised(items, scale).withColumn("number", F.monotonically_increasing_id()), "items")
    of = rows.where(anchors).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("times"))
    starts = scratch.save(of.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_items, bound = rows.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0))).first()
    grid = Grid(rows.drop("norm"), n_items, starts.count())
    anchor = ("vec_id", "label", "vector")
    whole = starts.select(F.col("anchor").alias("window"), *anchor, F.lit(-bound).cast("long").alias("low"), F.lit(bound).cast("long").alias("high"))  # no score exceeds the largest norm
    near = radix_select(scratch, grid, whole, positives, True, 2 * bound + 1, "positives")
    near = near.select(F.col("window").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Positives of one score have one window.
    ranges = starts.join(near.where("positive_score >= 0").select("anchor", "positive_score").distinct(), "anchor")
    ranges = scratch.save(ranges.withColumn("window", F.monotonically_increasing_id()), "ranges")
    least = F.expr(f"({percent} * positive_score + 99) DIV 100")
    widest = ranges.agg(F.coalesce(F.max(F.col("positive_score") - least), F.lit(0))).first()[0]
    far = radix_select(scratch, grid, ranges.select("window", *anchor, least.alias("low"), F.col("positive_score").alias("high")), negatives, False, widest + 1, "far")
    far = far.select("window", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = far.join(ranges.select("window", "anchor", "positive_score", "times", F.col("vec_id").alias("anchor_id")), "window").join(near, ["anchor", "positive_score"])
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
