"""Hard negatives, line dedup and the filter audit against brute force, with nulls, repeats, ties, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import filter_audit, hard_negatives, line_dedup
from corpusgraph.plans.scratch import Scratch

ITEMS = "vec_id long, label int, embedding array<float>, window string, anchor int, score double, number long"
DOCS = "doc_id long, text string, lang string, key string, line int, lines string, gone int, mask int, good string, digest string, part string"


def _items():
    r = random.Random(5)
    rows = [(i, r.randrange(3), [r.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, i % 2, [0.5] * 6) for i in range(40)]  # one vector, many ties
    rows += [(10, 1, rows[10][2]), (10, 1, rows[10][2]), (300, 1, rows[10][2]), (7, 2, [0.1] * 6), (7, 2, [0.1] * 6)]  # repeated ids, anchors and items
    rows += [(None, 1, [1.0] * 6), (400, None, [1.0] * 6), (410, 1, None), (420, 1, [1.0, None]), (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6)]
    rows += [(450, 1, []), (460, 2, [1.0, -2.0]), (470, 9, [0.3] * 6), (480, 0, [-1.0] * 6)]
    return rows


def _mined(rows, k=3):
    v = [(i, label, [math.floor(16 * float(x)) for x in e]) for i, label, e in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for a, label, q in v:
        if a % 10:
            continue
        order = sorted(((-dot(q, p), i, other == label) for i, other, p in v if i != a))
        for s, i, _ in [x for x in order if x[2]][:k]:
            fits = [x for x in order if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out.update((a, i, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits))
    return out


@pytest.mark.parametrize(("digit", "cell"), [(9, 1 << 16), (2, 16)])
def test_hard_negatives(spark, monkeypatch, digit, cell):
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    monkeypatch.setattr(hard_negatives, "CELL_ITEMS", cell)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cell)
    monkeypatch.setattr(hard_negatives, "BLOCK", 1 << 10)
    import numpy as np

    rows = [(i, label, e and [None if x is None else float(np.float32(x)) for x in e]) for i, label, e in _items()]
    df = spark.createDataFrame([(*r, "w", 1, 0.5, 3) for r in rows], ITEMS)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, scale=16, positives=3, negatives=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == _mined(rows)


def test_hard_negatives_edges(spark):
    empty = spark.createDataFrame([], ITEMS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, 1, [1.0], "", 0, 0.0, 0)], ITEMS)
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0
    large = spark.createDataFrame([(10, 1, [1e9], "", 0, 0.0, 0)], ITEMS)
    with pytest.raises(Exception, match="smaller scale"):
        hard_negatives.mine(large, F.col("vec_id") % 10 == 0).count()


def _docs():
    r = random.Random(3)
    hot = "  The quick brown fox jumps over the lazy dog, AGAIN and again.\t"
    lines = [hot, "Ünïcode line Straße İstanbul ΣΣ that is long enough to count", "x" * 39, "x" * 40, "", "   ", *(f"A line of its own, number {i}, long enough to be a key" for i in range(30))]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    texts += [None, "", "\n", hot, hot.upper(), hot, "\n".join([hot] * 3 + ["short"]), "\n".join(f"row {i} of a very long text, " + "y" * 20 for i in range(5000)) + "\n" + hot]
    rows = list(enumerate(texts))
    return [*rows, (None, hot + "\nshort"), (None, hot + "\nshort"), (None, "only rows without an id hold this line, really"), rows[5], (67, hot), (67, "other\n" + hot)]


def _strip(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})


def _kept(rows, least=40, many=5):
    held = defaultdict(list)
    for doc, text in rows:
        for k in {_strip(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append(-1 if doc is None else doc)
    gone = {k: max(v) for k, v in held.items() if len(v) >= many}
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if gone.get(_strip(x), doc if doc is not None else -1) == (-1 if doc is None else doc)]
        out[doc, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("batches", [1, 6])
def test_lines(spark, batches):
    rows = _docs()
    df = spark.createDataFrame([(d, t, "en", "k", 1, "l", 0, 1, "g", "d", "p") for d, t in rows], DOCS)
    got = line_dedup.line_dedup(df, batches=batches)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert Counter(map(tuple, got.collect())) == _kept(rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    nulls = [(None, "a line that only rows without an id have in common")] * 6
    kept = line_dedup.line_dedup(spark.createDataFrame([(d, t, "", "", 0, "", 0, 0, "", "", "") for d, t in nulls], DOCS)).collect()
    assert len(kept) == 6 and not any(x["n_dropped"] for x in kept)


def test_line_keys(spark):
    """Only A-Z are lower-cased, whatever else is a capital."""
    signs = [chr(i) for i in range(1, 0x2FFFF) if not 0xD800 <= i < 0xE000 and chr(i) != "\n"]
    texts = [("Q" + "".join(signs[i : i + 50]) + "é",) for i in range(0, len(signs), 50)]
    got = spark.createDataFrame(texts, "text string").select("text", line_dedup.line_keys(F.col("text"))[0].alias("key")).collect()
    assert all(r["key"] == _strip(r["text"]) for r in got)
    assert len(got) == len(texts)


def test_sorted_runs(spark):
    """Counts and largest ids survive any number of batches; settled keys aren't added again."""
    runs = line_dedup.SortedRuns(Scratch(spark, "runs"), 4)
    rows = [(bytes([i % 7]), 1 + i % 3, i) for i in range(70)]
    for at in range(5):
        mine = {}
        for k, n, x in rows[at::5]:
            old = mine.get(k, (0, -1))
            mine[k] = (old[0] + n, max(old[1], x))
        runs.add(spark.createDataFrame([(bytearray(k), n, x) for k, (n, x) in mine.items()], "key binary, docs long, last long"), settled=10**6)
    want = {i: (sum(1 + j % 3 for j in range(i, 70, 7)), 63 + i) for i in range(7)}
    whole = runs.compact()
    assert {r["key"][0]: (r["docs"], r["last"]) for r in whole.collect()} == want
    runs.add(spark.createDataFrame([(bytearray([0]), 1, 1), (bytearray([9]), 1, 1)], "key binary, docs long, last long"), settled=5)
    assert [r["key"][0] for r in runs.runs()[0].collect()] == [9]
    entries = len(spark.catalog.listTables())
    runs.close()
    assert len(spark.catalog.listTables()) == entries - 2


def _audited(rows, labels):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    docs = []
    for doc, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(x for x, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(set("#$%&*|") & set(t)),
            doc is not None and least[t] < doc,
        ), strict=True) if bad)
        docs.append((lang or "", fails, any(d == doc and d is not None and q == 1 for d, q, _ in labels), any(d == doc and d is not None and x == 1 for d, _, x in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        removed_by = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for k, x in enumerate(order):
                removed = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                every = [d for d in docs if d[0] == part and x in d[1]]
                removed_by[x] += len(removed)
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(every) - len(removed), sum(d[1] == x for d in every), sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_audit(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(n)}" for _ in range(m)) + end for n in (5, 900) for m in (10, 199, 200, 400) for end in ("", " 5 %", "\tA", " UPPER" * 40, "")]
    texts += [None, "", " \n\t", "é" * 50 + "ABC", " ".join(str(i) for i in range(60_000)), "a b"]
    rows = [(i, t, ("en", "fr", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(i + 500, t, "en") for i, t in enumerate(texts[::3])] + [(None, "a b", "en"), (None, "a b", None), rows[7], rows[7], (3, "another text under one id", "de")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 520, 3)] + [(6, 1, 0), (6, None, 1), (None, 1, 1), (9, None, None)]
    df = spark.createDataFrame([(d, t, lang, "k", 1, "l", 0, 31, "g", "d", "p") for d, t, lang in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x")).withColumn("part", F.lit(1))
    got = filter_audit.audit(df, marks)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(x["part"], x["filter_order"], x["step"]): [x[n] for n in names] for x in got.collect()} == _audited(rows, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert filter_audit.audit(df, marks.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_transform_is_exact(spark):
    """Any counts of masks come back from their parity sums."""
    r = random.Random(8)
    masks = [("p", r.randrange(32), r.random() < 0.5, r.random() < 0.1) for _ in range(500)]
    df = spark.createDataFrame(masks, "part string, mask int, good boolean, toxic boolean")
    cells = {x["mask"]: (x["all"], x["good"], x["toxic"]) for x in filter_audit.mask_cells(filter_audit.parity_sums(df)).collect()}
    assert cells == {m: (sum(x[1] == m for x in masks), sum(x[1] == m and x[2] for x in masks), sum(x[1] == m and x[3] for x in masks)) for m in range(32)}
    assert hashlib.sha256(b"").hexdigest()
