"""Text cleaning and segmentation as column expressions and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What is removed from extracted books, and how sentences end.
LINE_PATTERNS = {
    "FIGURE_TABLE_CAPTION": r"^\s*(#+\s*)?([Ff][Ii][Gg]([Uu][Rr][Ee])?|[Tt][Aa][Bb]([Ll][Ee])?)\.?\s+[\w\.\-]+\s+[A-Z]",
    "LEARNING_OBJECTIVE": r"^\s*(##\s*)?LO\s+\d",
    "SINGLE_CHAR": r"^\s*[a-zA-Z0-9\.\|\-]\s*$",
    "HEADING_SINGLE_NUMBER": r"^\s*##\s+\d+\s*$",
}
FIGURE_REF = r"\(\s*([Ff][Ii][Gg]([Uu][Rr][Ee])?|[Tt][Aa][Bb]([Ll][Ee])?)\.?\s*[\d\.\-]+[a-zA-Z]?\s*\)"
FOOTNOTE = r"\bfn\d+\b\s*"
TRAILING_NUMBER = r"""(?<=[.!?"'])\s+\d+\s+(?=[A-Z])"""
SUBSTITUTIONS = (("/u2014.d", "--"), ("/u2014", "--"))
LIST_MARKER = r"^\s*\([a-z]\)\s+"
TERMINAL = r"""[.!?:;"]$"""
SENTENCE_END = r"""[.!?"]$"""
VALID_ENDING = r"""[.?!")\]]$"""
WORD = r"[\p{L}\p{N}_]+"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def artifact(line: Column) -> Column:
    """Name of the first pattern a line matches; null for none."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in LINE_PATTERNS.items():
        out = out.when(line.rlike(pattern), name)
    return out


def remove_artifact_lines(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: artifact(x).isNull()), "\n")


def remove_list_markers(text: Column) -> Column:
    """Drops lines that begin with a list marker where the line before, as it stood, ends a sentence."""
    every = lines(text)
    before = lambda i: F.coalesce(F.trim(F.get(every, i - 1)), F.lit(""))
    return F.array_join(F.filter(every, lambda x, i: ~(x.rlike(LIST_MARKER) & before(i).rlike(SENTENCE_END))), "\n")


def substitute(text: Column) -> Column:
    for old, new in SUBSTITUTIONS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def remove_inline(text: Column, legacy: bool = False) -> Column:
    """References, footnote marks and stray numbers; a number goes with its blanks for one space (for nothing if legacy)."""
    text = F.regexp_replace(F.regexp_replace(text, FIGURE_REF, ""), FOOTNOTE, "")
    return F.regexp_replace(text, TRAILING_NUMBER, "" if legacy else " ")


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, rf"({WORD})-\s+({WORD})", "$1-$2")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"^\s+|\s+$", "")


def clean_inline(text: Column) -> Column:
    return squeeze(join_hyphens(remove_inline(substitute(text))))


def consolidate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, para, text: lines joined to paragraphs.

    A line goes on its predecessor's paragraph if that lacks terminal punctuation or ends in a comma or hyphen,
    or if the line begins in lower case; blank lines are skipped. Both tests look at neighbours only, so
    paragraphs are runs found by a window.
    """
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("at", "line")).withColumn("line", squeeze(F.col("line"))).where("line <> ''")
    order = W.partitionBy(key).orderBy("at")
    last = F.lag("line").over(order)
    new = last.isNull() | (last.rlike(TERMINAL) & ~F.col("line").rlike(r"^\p{Ll}"))
    rows = rows.withColumn("new", new.cast("int"))
    rows = rows.withColumn("para", (F.sum("new").over(order) - 1).cast("long"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "para").agg(F.array_join(parts, " ").alias("text"))


def sentences(text: Column) -> Column:
    """Non-empty sentences: cut after . ! or ? before white space."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), squeeze), lambda x: x != "")


def sentence_fault(sentence: Column) -> Column:
    """Why a sentence is dropped, or null."""
    short = F.size(F.split(squeeze(sentence), r"\s+")) < 2
    return F.when(short, "Too short").when(sentence.rlike(r"^\p{Ll}"), "Starts lowercase").when(~sentence.rlike(VALID_ENDING), "No terminal punctuation")


def context_of(book: Column, chapter: Column, section: Column) -> Column:
    return F.concat_ws(" > ", book, chapter, section)


def section_of(context: Column) -> Column:
    return F.trim(F.element_at(F.split(context, ">"), -1))


def markdown_of_html(html: Column) -> Column:
    """Text of a page: script, style, navigation and tables go; h1 and h2 to h6 become # and ## lines; blocks end lines."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|table|figure)\b.*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<h1\b[^>]*>", "\n# "), r"(?i)<h[2-6]\b[^>]*>", "\n## ")
    text = F.regexp_replace(text, r"(?i)</(h[1-6]|p|div|li|ul|title|head)>|<br\s*/?>", "\n")
    return F.regexp_replace(text, r"(?s)<[^>]*>", " ")


def segment_document(docs: DataFrame, book: str, text: str) -> DataFrame:
    """book, at, context, sentence lines of markdown: each text line with the chapter and section that hold there.

    '# ' sets the chapter and clears the section, '##' sets the section; before any chapter it is 'Unknown Chapter'.
    """
    rows = docs.select(F.col(book).alias("book"), F.posexplode(lines(F.col(text))).alias("at", "line")).withColumn("line", squeeze(F.col("line"))).where("line <> ''")
    title = squeeze(F.regexp_replace("line", "^#+", ""))
    rows = rows.withColumns({"chapter": F.when(F.col("line").rlike("^#( |$)"), title), "section": F.when(F.col("line").rlike("^##"), title)})
    order = W.partitionBy("book").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"number": F.count("chapter").over(order), "chapter": F.coalesce(F.last("chapter", True).over(order), F.lit("Unknown Chapter"))})
    inner = W.partitionBy("book", "number").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("section", F.last("section", True).over(inner)).where(~F.col("line").rlike("^#"))
    return rows.select("book", "at", context_of(F.col("book").cast("string"), F.col("chapter"), F.col("section")).alias("context"), F.col("line").alias("text"))


def split_at_headers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, is_header, headers: each line, whether it is a header ('#' and more, then white space), and the headers up to it."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("is_header", F.col("line").rlike(r"^#+\s+"))
    return rows.select(key, "pos", "is_header", F.sum(F.col("is_header").cast("long")).over(W.partitionBy(key).orderBy("pos")).alias("headers"))
