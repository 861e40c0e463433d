"""Structured answers: objects cut out of a model's text, repaired where that is possible, and checked against a schema, in column expressions over VARIANT."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of brackets that a cut object may be left open in.
DEPTH = 12
_STRING = r'"(?:[^"\\]|\\.)*"'
#: Names of types, and what Spark calls the types of values that are taken for them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def candidate(text: Column) -> Column:
    """What stands from the first brace to the last, or to the end if the last one is missing; without code fences around it. Null without a brace."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?```(?:json|JSON)?\s*(?=\{)", ""), r"(?s)```.*$", "")

    def cut(bare: Column) -> Column:
        whole, opened = F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.regexp_extract(bare, r"(?s)(\{.*)$", 1)
        return F.when(F.try_parse_json(whole).isNotNull(), whole).when(opened != "", opened)

    return let(bare, cut)


def closed(text: Column) -> Column:
    """The text with an open string and open brackets closed, and without commas before a closing bracket or the end."""

    def brackets(text: Column) -> Column:
        open_ = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]+", "")
        for _ in range(DEPTH):
            open_ = F.regexp_replace(open_, r"\{\}|\[\]", "")
        return F.concat(text, F.reverse(F.translate(open_, "{[", "}]")))

    text = let(text, lambda t: F.when(F.contains(F.regexp_replace(t, _STRING, ""), F.lit('"')), F.concat(t, F.lit('"'))).otherwise(t))
    text = F.regexp_replace(F.regexp_replace(text, r"[,\s]+$", ""), r":$", ": null")
    # Commas before brackets go outside strings only: a string is matched first, and put back.
    return F.regexp_replace(let(text, brackets), rf"({_STRING})|,\s*(?=[\]}}])", "$1")


def parsed(text: Column) -> Column:
    """VARIANT of the object in a text: as it is, closed, or closed without the last member that was cut; null if none of these is JSON, or it isn't an object."""
    # A key that the end has cut off, or one without a value.
    member = r'(?s)(?:,|(?<=\{))\s*"(?:[^"\\]|\\.)*"?\s*:?\s*[A-Za-z0-9+\-.]*\s*$'
    value = let(candidate(text), lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(closed(t)), F.try_parse_json(closed(F.regexp_replace(t, member, "")))))
    return let(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def fault(value: Column, schema: Mapping[str, str]) -> Column:
    """The first path of schema (path below the object, such as 'a' or 'a.b' -> type, with '?' at its end where it may be missing) that the object breaks, with how; '' if none does, 'not an object' for null."""
    out = F.when(value.isNull(), "not an object")
    for path, kind in schema.items():
        part = F.try_variant_get(value, f"$.{path}", "variant")
        missing = part.isNull() | F.is_variant_null(part)
        if not kind.endswith("?"):
            out = out.when(missing, f"$.{path}: missing")
        out = out.when(~missing & ~F.schema_of_variant(part).rlike(f"^(?:{TYPES[kind.rstrip('?')]})$"), F.concat(F.lit(f"$.{path}: {kind.rstrip('?')} expected, not "), F.lower(F.regexp_extract(F.schema_of_variant(part), r"^(\w+)", 1))))
    return out.otherwise("")


def checked(text: Column, schema: Mapping[str, str]) -> Column:
    """struct(value VARIANT, fault): the object in a text, null where it breaks the schema, and where and how it does."""

    def judged(value: Column) -> Column:
        return let(fault(value, schema), lambda wrong: F.struct(F.when(wrong == "", value).alias("value"), wrong.alias("fault")))

    return let(parsed(text), judged)
