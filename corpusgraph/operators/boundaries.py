"""Sentence boundaries without a trained model: abbreviations, collocations and openers are told by counts over all texts, then each period is judged.

The statistics are those of Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): likelihood
ratios of a word and its period, of two words around a period, and of a word and the place after a boundary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import Scratch

#: The thresholds of abbreviations, collocations and openers, and the chance of a period after an abbreviation.
ABBREVIATION, COLLOCATION, OPENER, DOTTED = 0.3, 7.88, 30.0, 0.99
#: What words are judged by is told once for each different word, or pair of words; only MARKED is asked of every word.
MARKED = r"""[.!?…]["'”’»)\]]*$"""
#: Texts that are cut at once.
SLICE = 256
CLOSERS, QUOTES = r"""["'”’»)\]]+$""", r"""^["'“‘«(\[]+"""


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def core(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, CLOSERS, ""), QUOTES, "")


def word_type(word: Column) -> Column:
    """What a word is counted as: lower case, without quotes and brackets around it, the final period and other final marks."""
    return _type(core(word))


def mark(word: Column) -> Column:
    """'.' for a word that ends in one period, '!' for one that ends in ! ? … or several periods, else ''."""
    return _mark(core(word))


def _type(bare: Column) -> Column:
    return F.regexp_replace(F.lower(bare), r"[.,;:!?…]+$", "")


def _mark(bare: Column) -> Column:
    return F.when(bare.rlike(r"([!?…]|\.\.)$"), "!").when(bare.rlike(r"\.$"), ".").otherwise("")


def _kind(bare: Column) -> Column:
    """'u' for a word that begins with a capital, 'l' with a small letter, 'n' with a number, '' else."""
    return F.when(bare.rlike(r"^\p{Lu}"), "u").when(bare.rlike(r"^\p{Ll}"), "l").when(bare.rlike(r"^\d"), "n").otherwise("")


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of k in n, without what doesn't depend on p; p is kept away from 0 and 1."""
    q = F.greatest(F.lit(1e-12), F.least(p, F.lit(1 - 1e-12)))
    return k * F.ln(q) + (n - k) * F.ln(1 - q)


def pair_ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio for b standing after a: counts of a, of b, of both, and of all words; 0 where b isn't more frequent there."""
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1))
    ratio = -2 * (likelihood(ab, a, p) + likelihood(b - ab, n - a, p) - likelihood(ab, a, p1) - likelihood(b - ab, n - a, p2))
    return F.when(p1 > p, ratio).otherwise(0.0)


def marked(word: Column) -> Column:
    """Whether mark() isn't empty."""
    return word.rlike(MARKED)


def explode_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of the text, at, word, and the words before and after."""
    w, none = F.col("w"), F.array(F.lit(None).cast("string"))
    n = F.size(w)
    some = docs.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    zipped = F.arrays_zip(w.alias("word"), F.concat(none, F.slice(w, F.lit(1), n - 1)).alias("before"), F.concat(F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), none).alias("after"))
    return some.select("key", "digest", F.posexplode(zipped).alias("at", "x")).select("key", "digest", "at", "x.*")


def lone_words(docs: DataFrame, text: str) -> DataFrame:
    """word, before (null) of each word: what abbreviations need of it."""
    return docs.select(F.explode(F.split(F.col(text), r"\s+")).alias("word")).where("word <> ''").withColumn("before", F.lit(None).cast("string"))


def type_counts(rows: DataFrame) -> DataFrame:
    """type, n, dotted, small (in small letters), inside (capitalised after a word without a mark), for each type of word of rows (word, before).

    Words are counted as they are written first, so that types, marks and kinds are found once for each different word.
    """
    each = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("before").isNotNull() & ~marked(F.col("before"))).alias("within"))
    each = each.withColumn("bare", core(F.col("word")))  # cut once, and used three times
    each = each.select(_type(F.col("bare")).alias("type"), _mark(F.col("bare")).alias("mark"), _kind(F.col("bare")).alias("kind"), "n", "within")
    of = lambda test, n: F.sum(F.when(test, F.col(n)).otherwise(0))
    return each.groupBy("type").agg(
        F.sum("n").alias("n"), of(F.col("mark") == ".", "n").alias("dotted"), of(F.col("kind") == "l", "n").alias("small"), of(F.col("kind") == "u", "within").alias("inside")
    )


def abbreviations(counts: DataFrame) -> DataFrame:
    """type, n, dotted, score, abbreviation for types with letters that end in a period somewhere. Short words with inner periods, seldom without a final one, score high."""
    totals = counts.agg(F.sum("n").alias("words"), F.sum("dotted").alias("periods"))
    letters = F.char_length(F.regexp_replace("type", r"[^\p{L}]+", "")).cast("double")
    inner = F.char_length("type") - F.char_length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    n, dotted = F.col("n"), F.col("dotted")
    gain = -2 * (likelihood(dotted, n, F.col("periods") / F.col("words")) - likelihood(dotted, n, F.lit(DOTTED)))
    score = gain * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - dotted).cast("double"))
    rows = counts.where((dotted > 0) & (letters > 0)).join(totals)  # one row
    return rows.select("type", "n", "dotted", F.when(score > 0, F.round(score, 6)).otherwise(0.0).alias("score")).withColumn("abbreviation", F.col("score") >= ABBREVIATION)


def told(pairs: DataFrame) -> DataFrame:
    """pairs (word, after) with type and mark of the word, type_after and kind_after."""
    word, after = F.col("_word"), F.col("_after")
    bare = pairs.withColumns({"_word": core(F.col("word")), "_after": core(F.col("after"))})
    return bare.withColumns({"type": _type(word), "mark": _mark(word), "type_after": _type(after), "kind_after": _kind(after)}).drop("_word", "_after")


@dataclass
class Boundaries:
    """Tables that texts are cut by: types (type, short, opens, starter) and pairs (type, type_after) that belong together."""

    types: DataFrame
    pairs: DataFrame

    @classmethod
    def learn(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Boundaries:
        """From all texts. Counts are aggregates by type or pair of types, combined before the shuffle, so that common words aren't hot."""
        scratch = Scratch(docs.sparkSession, "boundaries")
        rows = explode_words(docs, key, text)
        counts = scratch.save(type_counts(rows), "counts")
        short = abbreviations(counts).where("abbreviation").select("type", F.lit(True).alias("short"))
        around = told(rows.where(marked(F.col("word")) & F.col("after").isNotNull()).groupBy("word", "after").agg(F.count("*").alias("n"))).where("kind_after <> ''")
        around = around.groupBy("type", "mark", "type_after").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("kind_after") == "u", F.col("n")).otherwise(0)).alias("capital"))
        around = scratch.save(around.join(short, "type", "left").withColumn("short", F.coalesce("short", F.lit(False))), "around")
        total = counts.agg(F.sum("n").alias("words"))
        of = counts.select("type", F.col("dotted").alias("a"))
        after = counts.select(F.col("type").alias("type_after"), F.col("n").alias("b"))
        met = around.where("mark = '.' AND both > 1").join(of, "type").join(after, "type_after").join(total)
        pairs = met.where(pair_ratio(F.col("a"), F.col("b"), F.col("both"), F.col("words")) > COLLOCATION).select("type", "type_after")
        ends = around.where("NOT short OR mark = '!'")
        breaks = ends.agg(F.sum("both").alias("a"))
        begins = ends.groupBy("type_after").agg(F.sum("capital").alias("both")).where("both > 1").join(after, "type_after").join(total).join(breaks)
        starter = begins.where(pair_ratio(F.col("a"), F.greatest("b", "both"), F.col("both"), F.col("words")) > OPENER).select(F.col("type_after").alias("type"), F.lit(True).alias("starter"))
        opens = ((F.col("small") > 0) & (F.col("inside") == 0)).alias("opens")
        types = counts.select("type", opens).join(short, "type", "left").join(starter, "type", "left")
        types = types.select("type", "opens", F.coalesce("short", F.lit(False)).alias("short"), F.coalesce("starter", F.lit(False)).alias("starter"))
        return cls(scratch.save(types.where("opens OR short OR starter"), "types"), scratch.save(pairs, "pairs"))

    def ends(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, digest, ends: for each text the places of the words that end sentences, but for the last word.

        A word with ! ? … or several periods ends one unless a small letter follows. A period does, unless
        - the word is an abbreviation, and what follows isn't a capitalised word that opens sentences (one that is otherwise written small,
          never capitalised within sentences, or stands after boundaries far more often than elsewhere),
        - it is a number or a single letter, and a number, a small letter, or (after a letter) a name follows,
        - it and what follows are a pair that belongs together, and no opener follows.
        """
        scratch = Scratch(docs.sparkSession, "marks")
        marks = explode_words(docs, key, text).where(marked(F.col("word")) & F.col("after").isNotNull()).select("key", "digest", "at", "word", "after")
        marks = scratch.save(marks, "marks")
        # Each different pair of words is judged once.
        rows = told(marks.select("word", "after").distinct())
        first = self.types.select("type", F.col("short"))
        after = self.types.select(F.col("type").alias("type_after"), "opens", "starter")
        rows = rows.join(first, "type", "left").join(after, "type_after", "left").join(self.pairs.withColumn("pair", F.lit(True)), ["type", "type_after"], "left")
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        capital, small = F.col("kind_after") == "u", F.col("kind_after") == "l"
        opener = capital & (flag("opens") | flag("starter"))
        single = F.col("type").rlike(r"^\p{L}$")
        number = F.col("type").rlike(r"^[\d.,]+$")
        # A single letter before a name is an initial, whatever the name; before an opener it may end a sentence.
        period = (
            F.when(flag("short") | single, opener)
            .when(number, ~small & (F.col("kind_after") != "n") & ~(flag("pair") & ~opener))
            .when(flag("pair"), opener)
            .otherwise(True)
        )
        ends = F.when(F.col("mark") == "!", ~small).otherwise(period)
        found = marks.join(rows.where(ends).select("word", "after"), ["word", "after"], "left_semi")
        return found.groupBy("key", "digest").agg(F.array_sort(F.collect_set("at")).alias("ends"))

    def split(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, sentences: the words of each sentence joined by one space; null and blank texts have none."""

        @F.arrow_udf("array<string>")
        def cut(of: pa.Array, ends: pa.Array) -> pa.Array:
            parts = [pa.array([], pa.list_(pa.string()))]
            for lo in range(0, len(of), SLICE):
                out = []
                for t, e in zip(of.slice(lo, SLICE).to_pylist(), ends.slice(lo, SLICE).to_pylist(), strict=True):
                    w = re.findall(r"[^ \t\n\x0b\f\r]+", t or "")
                    stops = [-1, *(e or []), len(w) - 1]
                    out.append([" ".join(w[a + 1 : b + 1]) for a, b in zip(stops, stops[1:], strict=False) if b > a])
                parts.append(pa.array(out, pa.list_(pa.string())))
            return pa.concat_arrays(parts)

        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("whole"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
        found = self.ends(docs, key, text).select(F.col("key").alias("of"), F.col("digest").alias("text_digest"), "ends")
        both = rows.join(found, F.col("key").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_digest")), "left")
        return both.select(F.col("key").alias(key), cut("whole", "ends").alias("sentences"))
