"""Model plug-ins, retries, prompts and answers. The defaults are deterministic and need no model or network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import keys
from corpusgraph.operators import cleaning, search

DIMS = 16
#: The answer without context, the sign that ends a cut text, and the words that tell a passing failure.
NO_CONTEXT = "No relevant context was found to answer this question."
CUT = "\n[... truncated]"
PASSING = ("rate", "limit", "429", "500", "502", "503", "timeout")

PROMPTS = {
    "answer": "Passages:\n{context}\n\nQuestion: {query}\n\nAnswer from the passages alone and cite them as [1], [2] and so on.",
    "background": "Themes of the corpus:\n{background}\n\nPassages:\n{context}\n\nQuestion: {query}\n\nAnswer from the passages, cite them as [1], [2] and so on, and use the themes for the wider view.",
    "decompose": "Split this question into simpler ones, one a line:\n{query}",
    "hyde": "Write a short passage on {domain} that answers this question:\n{query}",
    "summary": "Sum these passages up in one paragraph.\n\nPassages:\n{context}",
    "fold": "Question: {query}\n\nReports:\n{context}\n\nBegin with [Score: N/10], then answer.",
}
#: The two domains that hypothetical passages are written for.
DOMAINS = ("the brain and behaviour", "the good life")


class ModelError(Exception):
    """A call that failed; passing tells whether another try may help."""

    def __init__(self, message: str, passing: bool | None = None) -> None:
        super().__init__(message)
        self.passing = any(w in message.lower() for w in PASSING) if passing is None else passing


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def with_retries(call: Callable[[], object], attempts: int = 3, factor: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """What call returns and the number of tries. After a passing failure it waits factor ** tries seconds; others, and the last, are raised."""
    for tried in range(1, attempts + 1):
        try:
            return call(), tried
        except ModelError as e:
            if not e.passing or tried == attempts:
                raise
            sleep(factor**tried)
    raise ValueError("attempts must be positive")


class FirstLine:
    """A text model that gives back the first line after the last 'Passages:' or 'Reports:' line of a prompt, or of the prompt itself."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [regex.split(r"(?:^|\n)(?:Passages|Reports):\n", p)[-1].split("\n", 1)[0] for p in prompts]


#: Signs of a text that aren't in words, up to which they are blanked one by one.
BLANKED = 64


class _Signs(dict):
    """Whether a sign is a letter or a digit, as the pattern of words has it."""

    def __missing__(self, sign: str) -> bool:
        found = self[sign] = regex.match(r"[\p{L}\p{N}]", sign) is not None
        return found


_SIGNS = _Signs()


def words(text: str) -> list[str]:
    """The runs of letters and digits of a text."""
    others = [c for c in set(text) if not _SIGNS[c]]
    if len(others) > BLANKED:
        return regex.findall(r"[\p{L}\p{N}]+", text)
    for c in others:
        text = text.replace(c, " ")
    return text.split()


class HashedEmbedder:
    """Counts of lower-cased words (runs of letters and digits) by the first 32 bits of their MD5 modulo dims."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims, self.name, self._slots = dims, f"hashed{dims}", {}

    def _slot(self, word: str) -> int:
        if len(self._slots) > 1 << 18:
            self._slots.clear()
        found = self._slots.get(word)
        if found is None:
            found = self._slots[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % self.dims
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            slots = [self._slot(w) for w in words(t)]
            out[i] = np.bincount(slots, minlength=self.dims) if slots else 0
        return out


def embed(rows: DataFrame, embedder: Embedder | None = None, text: str = "text", into: str = "vector", batch: int = 256) -> DataFrame:
    """rows with the vector of a text column in lower case (null: as empty). Texts go to the embedder in batches, in order, with retries; nothing is shuffled."""
    embedder = embedder or HashedEmbedder()

    @F.arrow_udf("array<double>")
    def vectors(column: pa.Array) -> pa.Array:
        parts = [np.zeros((0, embedder.dims))]
        for lo in range(0, len(column), batch):
            texts = [t or "" for t in column.slice(lo, batch).to_pylist()]
            parts.append(np.asarray(with_retries(lambda texts=texts: embedder.embed(texts))[0], float))
        whole = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * embedder.dims, pa.int32()), pa.array(whole.ravel()))

    return rows.withColumn(into, vectors(F.lower(F.coalesce(F.col(text), F.lit("")))))


def _completed(model: TextModel, prompts: list[str], batch: int, attempts: int, factor: float, sleep: Callable[[float], None]) -> list[dict]:
    """{text, tries, error} of each prompt. Calls that fail in a passing way are tried again together, after one wait for all of them, so that waits don't add up over calls."""
    out: list[dict] = [{}] * len(prompts)
    left = [range(lo, min(lo + batch, len(prompts))) for lo in range(0, len(prompts), batch)]
    for tried in range(1, attempts + 1):
        again = []
        for span in left:
            try:
                for i, text in zip(span, model.complete([prompts[i] for i in span]), strict=True):
                    out[i] = {"text": text, "tries": tried, "error": None}
            except ModelError as e:
                if e.passing and tried < attempts:
                    again.append(span)
                    continue
                for i in span:
                    out[i] = {"text": None, "tries": None, "error": str(e)}
        if not (left := again):
            break
        sleep(factor**tried)
    return out


def complete(rows: DataFrame, model: TextModel | None = None, prompt: str = "prompt", into: str = "answer", batch: int = 64, factor: float = 1.5, attempts: int = 3) -> DataFrame:
    """rows with struct(text, tries, error): the model's answer to a prompt column; a failure that lasts gives its message as error, and no text.

    Between two tries of a call others are made, so a model mustn't tell a second try by its following the first.
    """
    model = model or FirstLine()

    @F.arrow_udf("struct<text: string, tries: int, error: string>")
    def answers(column: pa.Array) -> pa.Array:
        out = _completed(model, [p or "" for p in column.to_pylist()], batch, attempts, factor, time.sleep)
        return pa.array(out, pa.struct([("text", pa.string()), ("tries", pa.int32()), ("error", pa.string())]))

    return rows.withColumn(into, answers(F.col(prompt)))


def render(name: str, **values: Column) -> Column:
    """A prompt with its marks replaced, each once and in order, so that values that hold marks stay as they are."""
    parts = regex.split(r"\{(\w+)\}", PROMPTS[name])
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise ValueError(f"prompt {name} needs {', '.join(sorted(missing))}")
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def hypothetical(queries: DataFrame, k: int = 4) -> DataFrame:
    """query_id, nth, domain, passage: k passages for each query, the first half (rounded down) on the first domain. Stand-in for a writing model: a template."""
    domain = F.when(F.col("nth") < k // 2, DOMAINS[0]).otherwise(DOMAINS[1])
    each = queries.select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("nth")).withColumn("domain", domain)
    return each.select("query_id", "nth", "domain", F.concat(F.lit("On "), "domain", F.lit(": "), F.coalesce("query", F.lit(""))).alias("passage"))


def numbered(hits: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """query_id, rank, text of the first most hits."""
    return hits.where(F.col("rank") <= most).select("query_id", "item_id", "rank").join(items.select("item_id", "text"), "item_id").select("query_id", "rank", "text")


def answer(queries: DataFrame, hits: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """query_id, answer, sources: for each of the first most hits its sentence that shares the most words with the query, marked [rank].

    Stand-in for an answering model. Of equal sentences the first is taken; hits without a shared word aren't cited.
    A query without such a hit has the fixed answer and no sources.
    """
    rows = numbered(hits, items, most).join(queries.select("query_id", "query"), "query_id")
    each = rows.select("query_id", "rank", F.array_distinct(search.tokens(F.col("query"))).alias("words"), F.posexplode(cleaning.sentences(F.col("text"))).alias("pos", "sentence"))
    each = each.withColumn("shared", F.size(F.array_intersect("words", search.tokens(F.col("sentence"))))).where("shared > 0")
    best = each.groupBy("query_id", "rank").agg(F.max_by("sentence", F.struct("shared", -F.col("pos"))).alias("sentence"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: F.concat(x["sentence"], F.lit(" ["), x["rank"].cast("string"), F.lit("]")))
    told = best.groupBy("query_id").agg(F.array_join(parts, " ").alias("answer"))
    out = queries.select("query_id").join(told, "query_id", "left")
    cited = F.when(F.col("answer").isNotNull(), keys.citations(F.regexp_replace("answer", r"\[(\d+)\](?! |$)", ""), F.lit(most)))
    return out.select("query_id", F.coalesce("answer", F.lit(NO_CONTEXT)).alias("answer"), F.coalesce(F.array_join(cited, ","), F.lit("")).alias("sources"))


#: The headings of the background text, and how many themes, entities and characters it holds.
THEMES_HEAD, ENTITIES_HEAD = "## Relevant Themes (from document corpus)", "## Related Concepts (from knowledge graph)"
THEMES, ENTITIES, BACKGROUND = 2, 10, 2000


def graph_background(themes: Column, entities: Column, longest: int = BACKGROUND) -> Column:
    """The background text of the first THEMES themes (array<string>) and ENTITIES entities (array<struct<name, entity_type, description>>), cut at longest characters."""
    told = F.transform(
        F.slice(entities, 1, ENTITIES),
        lambda e: F.when(F.coalesce(e["description"], F.lit("")) != "", F.concat(F.lit("- "), e["name"], F.lit(": "), e["description"]))
        .otherwise(F.concat(F.lit("- "), e["name"], F.lit(" ("), F.coalesce(e["entity_type"], F.lit("concept")), F.lit(")"))),
    )
    part = lambda head, lines, some: F.when(F.size(some) > 0, F.concat(F.array(F.lit(head)), lines)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        part(THEMES_HEAD, F.transform(F.slice(themes, 1, THEMES), lambda t: F.concat(F.lit("\n"), t)), themes),
        part("\n" + ENTITIES_HEAD, told, entities),
    )
    whole = F.array_join(lines, "\n")
    return F.when(F.char_length(whole) > longest, F.concat(F.left(whole, F.lit(longest)), F.lit(CUT))).otherwise(whole)


def connections(spark: SparkSession, service_keys: dict[str, str | None]) -> DataFrame:
    """service, alive, fault: the session answers a query; a service's key is there and isn't a placeholder."""
    alive = spark.range(1, numPartitions=1).count() == 1
    rows = [("session", alive, None if alive else "no answer")]
    for name, key in sorted(service_keys.items()):
        fault = "missing" if not (key or "").strip() else "placeholder" if regex.match(r"(?i)^(your|change|xxx|<)", key.strip()) else None
        rows.append((name, fault is None, fault))
    return spark.createDataFrame(rows, "service string, alive boolean, fault string")
