"""Sentence boundaries on texts whose boundaries are known by construction."""

from __future__ import annotations

import random

import pytest

from corpusgraph.operators import boundaries
from corpusgraph.operators.boundaries import Boundaries

SHORT = ("dr", "e.g", "approx", "fig", "p", "vol", "st")


def _made(n, seed):
    """Texts as lists of sentences: abbreviations, initials, decimals and numbered references within sentences."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfglmnrst") for _ in range(r.randrange(2, 5)))
    vocabulary = [word() for _ in range(150)]
    names = [word().capitalize() + "x" for _ in range(40)]
    special = [lambda: f"Dr. {r.choice(names)}", lambda: f"e.g. {r.choice(vocabulary)}", lambda: f"approx. {r.randrange(99)}.{r.randrange(9)} {r.choice(vocabulary)}", lambda: f"fig. {r.randrange(30)}",
               lambda: f"p. {r.randrange(300)}", lambda: f"vol. {r.randrange(9)}", lambda: f"{r.choice('ABCDEFGH')}. {r.choice('JKLMN')}. {r.choice(names)}", lambda: f"St. {r.choice(names)}", lambda: f"3.{r.randrange(10)}"]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(r.randrange(1, 12)):
            parts = [r.choice(vocabulary) for _ in range(r.randrange(3, 12))]
            parts[0] = parts[0].capitalize()
            for _ in range(r.randrange(0, 3)):
                parts.insert(r.randrange(1, len(parts)), r.choice(special)())
            text.append(" ".join(parts) + r.choice([".", ".", ".", ".", "!", "?", '."']))
        texts.append(text)
    return texts


@pytest.fixture(scope="module")
def texts():
    return _made(400, 1)


def test_known_boundaries(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = boundaries.type_counts(boundaries.explode_words(docs, "doc_id", "text"))
    found = {r["type"] for r in boundaries.abbreviations(counts).where("abbreviation").collect()}
    assert set(SHORT) <= found and all(len(x) == 1 for x in found - set(SHORT))  # initials are abbreviations too
    learnt = Boundaries.learn(docs)
    got = {r["doc_id"]: r["sentences"] for r in learnt.split(docs).collect()}
    right = sum(len(set(_cuts(got[i])) & set(_cuts(t))) for i, t in enumerate(texts))
    made, wanted = sum(len(_cuts(x)) for x in got.values()), sum(len(_cuts(t)) for t in texts)
    assert right >= 0.99 * wanted and right >= 0.99 * made
    # A split after every period that white space follows is far from that.
    plain = sum(t.count(". ") + t.count('." ') for t in map(" ".join, texts))
    assert plain > 1.3 * wanted
    again = {r["doc_id"]: r["sentences"] for r in Boundaries.learn(docs.repartition(5)).split(docs.repartition(3)).collect()}
    assert again == got


def _cuts(sentences):
    out, n = [], 0
    for s in sentences[:-1]:
        n += len(s.split())
        out.append(n)
    return out


def test_unseen_text(spark, texts):
    learnt = Boundaries.learn(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = [
        (1, "See e.g. fig. 4 for it. This was new!  We left at 3.5 and J. S. Bachx came."), (2, None), (3, " \n"), (4, "one word"), (5, 'He said "stop." Then 4 came. 5 left... and so on'),
        (5, 'He said "stop." Then 4 came. 5 left... and so on'), (5, "another text. Of the same id."), (None, "No id. Still cut."),
    ]
    got = sorted(((r["doc_id"] or 0, r["sentences"]) for r in learnt.split(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [
        (0, ["No id.", "Still cut."]), (1, ["See e.g. fig. 4 for it.", "This was new!", "We left at 3.5 and J. S. Bachx came."]), (2, []), (3, []), (4, ["one word"]),
        (5, ['He said "stop."', "Then 4 came.", "5 left... and so on"]), (5, ['He said "stop."', "Then 4 came.", "5 left... and so on"]), (5, ["another text.", "Of the same id."]),
    ]
    assert got == sorted(want, key=repr)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    learnt = Boundaries.learn(none)
    assert learnt.types.count() == 0 and learnt.split(none).count() == 0
