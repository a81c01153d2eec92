"""Reading what a model wrote: JSON in prose or fences, drafts and verdicts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import js_trim, sentences

# Reasons of verdicts that give none.
STATED, NOT_STATED, UNREADABLE = "passage states it", "not stated in passage", "unreadable verdict"

_FENCE = re.compile(r"\A\s*```(?:json)?|```\s*\Z", re.IGNORECASE)
_STRUCTURE = re.compile(r'["\\{}]')


def first_object(raw: str | None) -> str | None:
    """Text of the first balanced object, if it is JSON; braces within strings don't count."""
    text = _FENCE.sub("", raw or "")
    start = text.find("{")
    depth, quoted, skip = 0, False, -1
    for match in _STRUCTURE.finditer(text, start) if start >= 0 else ():
        at, char = match.start(), match[0]
        if at == skip:
            continue
        if char == "\\":
            skip = at + 1 if quoted else skip
        elif char == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if char == "{" else -1
            if depth == 0:
                found = text[start : at + 1]
                try:
                    json.loads(found, parse_constant=_no_constant)
                except ValueError:
                    return None
                return found
    return None


def _no_constant(name: str) -> None:
    raise ValueError(name)


@F.pandas_udf(T.StringType())
def json_object(raws: pd.Series) -> pd.Series:
    return raws.map(first_object)


def as_string(value: Column, path: str) -> Column:
    """A field of a variant that is a string and not blank, trimmed; else null."""
    found = F.try_variant_get(value, path, "variant")
    text = js_trim(F.try_variant_get(value, path, "string"))
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(text, F.lit("")))


def _first(value: Column, *names: str) -> Column:
    return F.coalesce(*[as_string(value, f"$.{n}") for n in names])


def _is(value: Column, path: str, wanted: bool) -> Column:
    found = F.try_variant_get(value, path, "variant")
    same = (F.schema_of_variant(found) == "BOOLEAN") & (F.try_variant_get(value, path, "boolean") == F.lit(wanted))
    return F.coalesce(same, F.lit(False))


def draft(found: Column) -> Column:
    """struct<sufficient, claims array<struct<text, chunk_id, quote>>> of an object's text from :func:`json_object`.

    Rows without text are skipped; a row of several sentences becomes as many
    claims that share its citation.  No object: insufficient, without claims.
    """
    value = F.try_parse_json(found)
    rows = F.try_variant_get(value, "$.sentences", "array<variant>")

    def claims(row: Column) -> Column:
        text = _first(row, "text", "sentence", "claim")
        chunk = _first(row, "passage", "chunk_id", "chunkId", "id")
        quote = _first(row, "quote", "evidence", "support")

        def claim(t: Column) -> Column:
            return F.struct(t.alias("text"), chunk.alias("chunk_id"), quote.alias("quote"))

        parts = sentences(text)
        one = F.array(claim(text))
        many = F.transform(parts, lambda s: claim(s["text"]))
        kind = "array<struct<text:string,chunk_id:string,quote:string>>"
        return F.when(text.isNull(), F.array().cast(kind)).when(F.size(parts) > 1, many).otherwise(one)

    kind = "array<struct<text:string,chunk_id:string,quote:string>>"
    listed = F.coalesce(F.flatten(F.transform(rows, claims)), F.array().cast(kind))
    return F.struct(
        (value.isNotNull() & ~_is(value, "$.sufficient", False)).alias("sufficient"),
        F.when(value.isNotNull(), listed).otherwise(F.array().cast(kind)).alias("claims"),
    )


def verdict(found: Column, reason_chars: int = 120) -> Column:
    """struct<supported, reason> of an object's text: supported only if it says exactly true."""
    value = F.try_parse_json(found)
    supported = _is(value, "$.supported", True)
    stated = F.when(supported, STATED).otherwise(NOT_STATED)
    reason = F.when(value.isNull(), UNREADABLE).otherwise(F.substring(F.coalesce(as_string(value, "$.reason"), stated), 1, reason_chars))
    return F.struct(supported.alias("supported"), reason.alias("reason"))
