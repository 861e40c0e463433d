"""Secret scans with multipart credential linking."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _either(words: str) -> str:
    """Letters in either case, ASCII only."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: The base patterns and their least lengths.
ASSIGN = re.compile(_either(r"(?:password|passwd|secret|token|api_?key)") + _VALUE + r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

_IDENTIFIER = re.compile(_either(r"(?:access_?key_?id|client_?id|account|user_?name|user|login)") + _VALUE + r"([A-Za-z0-9_.@+-]{4,})")
_WEAK_SECRET = re.compile(_either(r"(?:password|passwd|pwd|passphrase|secret|token|api_?key|auth)") + _VALUE + r"([A-Za-z0-9+/_.=!@$%^&*-]{6,})")
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,64}")
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{4,}|""" + _either(r"(?:host|endpoint|server|database_?url)") + _VALUE + r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_PLACE_WORDS = ("://", "host", "endpoint", "server", "database", "key", "client", "account", "user", "login")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str, low: str) -> list[Span]:
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    return sorted(out)


def _random_looking(s: str) -> bool:
    return any(c.isdigit() for c in s) and any("A" <= c <= "Z" for c in s) and any("a" <= c <= "z" for c in s)


def _outside(found: list[Span], taken: list[Span]) -> list[Span]:
    """found without what overlaps taken (sorted by start)."""
    merged: list[list[int]] = []
    for s, _, e in taken:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]

    def free(x: Span) -> bool:
        at = bisect_left(starts, x[2])
        return not at or merged[at - 1][1] <= x[0]

    return [x for x in found if free(x)]


def linked_spans(text: str, low: str, base: list[Span], reach: int) -> list[Span]:
    """Weak identifiers, secrets and endpoints that have their complement within reach code points of them.

    An interval join by sorted ends: a secret (weak, or a base assign or hex) joins an identifier or endpoint
    (weak, or a base access) if the gap between them is at most reach. Weak parts without a partner are left out.
    """
    strong_places = [x for x in base if x[1] == 1]
    if not strong_places and not any(w in low for w in _PLACE_WORDS):
        return []
    places = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)] + [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    places = sorted(_outside(places, base))
    anchors = sorted(places + strong_places)
    if not anchors:
        return []
    secrets = [(m.start(), 4, m.end()) for m in _WEAK_SECRET.finditer(text)]
    for lo, hi in _around(anchors, reach, len(text)):
        secrets += [(m.start() + lo, 4, m.end() + lo) for m in _RANDOM.finditer(text[lo:hi]) if _random_looking(m[0])]
    taken = sorted(base + places)
    weak: list[Span] = []
    for x in sorted(set(_outside(secrets, taken)), key=lambda x: (x[0], -x[2])):
        if not weak or x[0] >= weak[-1][2]:
            weak.append(x)
    keys = sorted(weak + [x for x in base if x[1] != 1])
    return sorted(_meeting(places, keys, reach) + _meeting(weak, anchors, reach))


def _around(spans: list[Span], reach: int, end: int) -> list[tuple[int, int]]:
    """The scopes about spans, merged where they overlap."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        lo, hi = max(0, s - reach - 64), min(end, e + reach + 64)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _meeting(found: list[Span], others: list[Span], reach: int) -> list[Span]:
    """Those of found with one of others (sorted by start) at most reach away: of all that start in time, the one that ends last decides."""
    starts, last = [s for s, _, _ in others], list(accumulate((e for _, _, e in others), max))

    def near(x: Span) -> bool:
        at = bisect_right(starts, x[2] + reach)
        return at > 0 and last[at - 1] >= x[0] - reach

    return [x for x in found if near(x)]


def scan(text: str | None, reach: int) -> tuple[list[Span], list[Span]]:
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    return base, linked_spans(text, low, base, reach)


def secret_spans(docs: DataFrame, reach: int = 160, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base_spans and linked_spans, arrays of struct(kind, start, end) in code points.

    base_spans holds what the three base patterns find; linked_spans adds weak identifiers, secrets and endpoints,
    only where a secret and an identifier or endpoint stand within reach code points of each other. Spans are
    ordered by start, then kind as in KINDS. Null text is empty and has no spans; null keys and repeated rows are scanned
    like others. Whole texts are read, in time about linear in their length; a document is scanned alone, so nothing is
    shuffled. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [scan(t, reach) for t in batch.column("text").to_pylist()]
                columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x[i]] for x in found], pa.list_(span)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base_spans", "linked_spans"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id long, base_spans {spans}, linked_spans {spans}")
