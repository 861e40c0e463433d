"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose feature exceeds a cutoff; the candidates are fixed before any label is seen."""

    name: str
    feature: str
    cutoffs: Sequence[float]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.6, 0.8)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.45)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (7.0, 8.0, 10.0, 12.0, 16.0, 24.0)),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def _covered(places: Column) -> Column:
    """Words that windows of three at the given places cover; places are in order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))
    step = lambda acc, p: F.struct((acc["n"] + F.lit(3) - F.greatest(F.lit(0), acc["upto"] - p + 1)).cast("long").alias("n"), (p + 2).cast("int").alias("upto"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    body = F.col("body")
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    d = d.withColumns({"words": _words(body), "lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("words")
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("windows", F.when(n >= 3, F.slice(windows, F.lit(1), n - 2)))
    unique = F.coalesce(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(True))
    # Hashes tell that no window repeats; where some do, windows are compared by their words (which hold no blanks).
    # A column of its own for each step: inside a lambda, an expression would be evaluated anew for each element.
    told = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    d = d.withColumn("ordered", F.when(~unique, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), told(i).alias("w"), i.alias("i"))))))
    like = lambda x, i: F.coalesce((x["h"] == F.get("ordered", i)["h"]) & (x["w"] == F.get("ordered", i)["w"]), F.lit(False))
    d = d.withColumn("again", F.filter("ordered", lambda x, i: like(x, i - 1) | like(x, i + 1)))
    d = d.withColumn("places", F.sort_array(F.transform("again", lambda x: x["i"])))
    return d.select(
        "doc_id", "stratum", n.cast("long").alias("n_words"),
        F.char_length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; relative error under 1e-12 for x >= 1."""
    y = x + F.lit(8.0)
    shift = F.ln(x)
    for i in range(1, 8):
        shift = shift + F.ln(x + F.lit(float(i)))
    series = F.lit(1 / 12) / y - F.lit(1 / 360) / F.pow(y, F.lit(3)) + F.lit(1 / 1260) / F.pow(y, F.lit(5))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Probability of k or fewer in n draws of probability p, exact to double precision for every k; 1 where k isn't below n * p.

    Summed from k downwards. The i-th term before is at most exp(-(i - 1) ** 2 / 2 / k) of the first, so 12 * sqrt(k) + 64
    terms leave under 1e-30 of it; that rest is added as a geometric series, which is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    log = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    odds = (1 - p) / p
    last = F.least(k, F.floor(12 * F.sqrt(k) + 64).cast("double"))
    ratio = lambda i: (k - i + 1) / (n - k + i) * F.lit(odds)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * ratio(i.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    sums = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>")), start, step)
    further = F.when(k > last, sums["t"] * ratio(last + 1) / (1 - ratio(last + 1))).otherwise(0.0)
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(log + F.ln(sums["s"] + further)))).otherwise(1.0)


def certify(found: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, risk: float = 0.05, error: float = 0.05, key: str = "doc_id", good: str = "quality") -> DataFrame:
    """stratum, rule, cutoff: for each stratum and rule the least cutoff that is safe there.

    Good documents (label 1) that pass the base rules are the holdout. With k of n of them above a cutoff, the
    cutoff is safe if k or fewer would have probability at most error / (all tests) at a false rejection rate of
    risk / rules: the exact binomial bound, with Bonferroni's correction over strata, rules and cutoffs. So with
    probability 1 - error no stratum loses more than risk of its good documents to all rules together. Strata
    with too few labels get no cutoff. A key labelled twice is good if all its labels are.
    """
    one = labels.groupBy(F.col(key).cast("long").alias("labelled")).agg(F.min(good).alias("good")).where("good = 1")
    held = found.where("NOT base_failed").join(one, F.col("doc_id") == F.col("labelled"))
    counts = [F.count_if(F.expr(r.feature) > F.lit(c)).alias(f"k_{i}_{j}") for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs)]
    by_stratum = held.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    tests = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k_{i}_{j}").alias("k")) for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs)])
    number = found.select("stratum").distinct().agg(F.count("*").alias("strata"))
    tried = by_stratum.withColumn("test", F.explode(tests)).join(F.broadcast(number)).select("stratum", "n", "strata", "test.*")
    chance = binomial_tail(F.col("k"), F.col("n"), risk / len(rules))
    safe = tried.where(chance <= F.lit(error / sum(len(r.cutoffs) for r in rules)) / F.greatest("strata", F.lit(1)))
    return safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, risk: float = 0.05, error: float = 0.05, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """features() with kept: false if base_failed, or if a rule's feature exceeds its certified cutoff in the stratum.

    Null text has no words and fails the base rules. Null stratum is a stratum. Other columns are ignored; an
    empty table gives no rows; without labels only the base rules reject. Features of all documents are kept as
    a table (a few numbers each); cutoffs are one row per stratum.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.save(features(docs, key, text, stratum), "features")
    cutoffs = certify(found, labels, rules, risk, error)
    wide = cutoffs.groupBy(F.col("stratum").alias("of")).agg(*[F.min(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules])
    wide = scratch.save(wide, "cutoffs")
    over = F.lit(False)
    for r in rules:
        over = over | F.coalesce(F.expr(r.feature) > F.col(f"cut_{r.name}"), F.lit(False))
    return found.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("kept", ~F.col("base_failed") & ~over)
