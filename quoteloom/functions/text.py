"""Folding, trimming, tokenising and sentence splitting, as column expressions.

Offsets are in code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ABBREVIATIONS, CHARS_PER_TOKEN, SPACE, STOPWORDS

#: The characters of ``SPACE``, one by one.
_SPACES = "".join(char for char in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", char))


def js_trim(text: Column) -> Column:
    """Without white space, in the ECMAScript sense, at either end."""
    return F.btrim(text, F.lit(_SPACES))


def is_blank(text: str) -> bool:
    return not text.strip(_SPACES)


def fold_char(char: str) -> str:
    """What one character folds to: letters and digits a-z0-9, blanks for separators, nothing for a mark.

    Characters beyond the basic plane are separators, as half a surrogate pair
    has no decomposition.
    """
    if ord(char) > 0xFFFF or 0xD800 <= ord(char) <= 0xDFFF:
        return " "
    out = ""
    for c in unicodedata.normalize("NFKD", char).lower():
        if unicodedata.category(c)[0] != "M":
            out += c if c.isascii() and c.isalnum() else " "
    return out


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one character or to nothing, as arguments of translate; and those that fold to several."""
    single, to, gone, many = [], [], [], {}
    for code in range(1, 0x10000):
        char = chr(code)
        out = fold_char(char)
        if out == char or not out.strip() and out:
            continue  # kept as it is, or a separator anyway
        if not out:
            gone.append(char)
        elif len(out) == 1:
            single.append(char)
            to.append(out)
        else:
            many[char] = out
    return "".join(single + gone), "".join(to), many


def _class(chars) -> str:
    """A character class of these characters, as ranges: a long list of single ones is slow to test."""
    codes = sorted(map(ord, chars))
    edges = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1), len(codes)]
    return "[" + "".join(f"{chr(codes[a])}-{chr(codes[z - 1])}" for a, z in zip(edges, edges[1:])) + "]"


def fold(text: Column) -> Column:
    """Lower case a-z0-9 words with single blanks between: case, accents, punctuation and spacing make no difference.

    All of it runs in the JVM: texts of ASCII are lower-cased; in others, one
    translation for characters that become one character or none, and those that
    become several (ligatures, fractions) spelled out where a text has any.
    """
    # a lambda names the text, which may be costly to work out, once
    return F.transform(F.array(text), _fold)[0]


def _fold(text: Column) -> Column:
    source, target, many = _fold_tables()
    listed = "\u0002".join(f"{char}\u0003{out}" for char, out in many.items())
    spelled = F.str_to_map(F.lit(listed), F.lit("\u0002"), F.lit("\u0003"))
    parts = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(spelled, c), c))
    any_of = text.rlike(rf"(?=[{min(many)}-\uffff]){_class(many)}")  # most places fail at the look-ahead, which is one range
    lowered = F.translate(F.when(any_of, F.array_join(parts, "")).otherwise(text), source, target)
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lowered)
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


@lru_cache(maxsize=1)
def _code_tables() -> tuple[bytes, np.ndarray, re.Pattern, dict[str, str]]:
    """What each ASCII character folds to; each code point, 0 for nothing, the last for all beyond the basic plane; and the characters that fold to several."""
    gone_last, to, many = _fold_tables()
    table = np.full(0x10001, 32, np.uint8)
    for code in range(128):
        table[code] = ord(fold_char(chr(code)))
    codes = np.array([ord(c) for c in gone_last])
    table[codes] = 0
    table[codes[: len(to)]] = np.frombuffer(to.encode(), np.uint8)
    return table[:256].tobytes(), table, re.compile(_class(many)), many


def fold_words(text: str) -> list[bytes]:
    """The words of a text as :func:`fold` folds it, within tasks."""
    ascii_, table, several, many = _code_tables()
    if text.isascii():
        return text.encode().translate(ascii_).split()
    text = several.sub(lambda found: many[found[0]], text)
    out = table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)]
    return out[out != 0].tobytes().split()


def folded_words(folded: Column) -> Column:
    """Number of words of a folded text."""
    return F.when(folded == "", 0).otherwise(F.size(F.split(folded, " ")))


def fold_map(text: str) -> tuple[str, list[int]]:
    """A text folded, and for each folded character the place it came from."""
    out: list[str] = []
    places: list[int] = []
    gap = -1
    for place, char in enumerate(text):
        for c in fold_char(char):
            if c == " ":
                gap = place if gap < 0 else gap
                continue
            if gap >= 0 and out:
                out.append(" ")
                places.append(gap)
            gap = -1
            out.append(c)
            places.append(place)
    return "".join(out), places


def project(places: list[int], start: int, end: int) -> tuple[int, int] | None:
    """The original span of a folded one; None where that is empty or out of bounds."""
    if start < 0 or end > len(places) or start >= end:
        return None
    return places[start], places[end - 1] + 1


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.IntegerType()))]))
def fold_with_map(texts: pd.Series) -> pd.DataFrame:
    """Folded text with the place of each folded character; for the few rows that need every place."""
    return pd.DataFrame([fold_map(t or "") for t in texts], columns=["text", "map"])


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def project_span(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    """Original span of ``length`` folded characters from ``start`` of a text's folded form."""
    spans = []
    for text, start, length in zip(texts, starts, lengths):
        span = None if text is None or pd.isna(start) else project(fold_map(text)[1], int(start), int(start) + int(length))
        spans.append(span or (None, None))
    return pd.DataFrame(spans, columns=["start", "end"]).astype({"start": "Int32", "end": "Int32"})


def tokens(folded: Column) -> Column:
    """Words of a folded text of more than one character that carry weight, repeats included."""
    return F.filter(F.split(folded, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


_WEIGHTLESS = frozenset(w.encode() for w in STOPWORDS)


#: Words that are no tokens: those, and all of one character.
_LIGHT = _WEIGHTLESS | {char.encode() for char in "abcdefghijklmnopqrstuvwxyz0123456789"}


@F.arrow_udf(T.ArrayType(T.StringType()))
def _terms(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else [w for w in fold_words(t) if w not in _LIGHT] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.string()))


class AskedTerms:
    """Terms that are asked for, to be counted in many texts at once; within tasks."""

    def __init__(self, terms: Iterable[str]):
        self.terms = pa.array(sorted(set(terms)), pa.string())
        light = sorted(_LIGHT)
        self.light = len(light)
        self.known = pa.array([w + b" " for w in [*light, *(t.encode() for t in self.terms.to_pylist())]], pa.binary())

    def counted(self, texts: list[str | None], together: int = 512) -> tuple[pa.Array, pa.Array]:
        """Those of each text's :func:`tokens` that are asked for, and how many tokens it has in all; null for a null text."""
        # so many at a time that what is worked on stays near the processor
        lists, lengths = zip(*(self._counted(texts[i : i + together]) for i in range(0, len(texts) or 1, together)))
        return pa.concat_arrays(lists), pa.concat_arrays(lengths)

    def _counted(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        _, table, several, many = _code_tables()
        null = np.array([t is None for t in texts], bool)
        given = [several.sub(lambda found: many[found[0]], t) if t and not t.isascii() else t or "" for t in texts]
        codes = np.frombuffer(" ".join([*given, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = table[np.minimum(codes, 0x10000)]
        folded[np.cumsum([len(t) + 1 for t in given], dtype=np.int64) - 1] = 10  # what stands after a text
        folded = folded[folded != 0]
        within = folded > 32
        after = np.concatenate([[False], within[:-1]])[: len(within)] & ~within  # the place after a word
        upto = np.cumsum(after, dtype=np.int32)[folded == 10]  # words up to the end of each text
        raw = folded[within | after]
        raw[raw == 10] = 32
        offsets = np.concatenate([[0], np.flatnonzero(raw == 32) + 1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        code = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy()
        found = np.flatnonzero(code >= self.light)
        ends = np.concatenate([[0], np.searchsorted(found, upto)])
        terms = self.terms.take(pa.array(code[found] - self.light))
        light = np.cumsum((code >= 0) & (code < self.light), dtype=np.int32)
        light = np.concatenate([[0], light])[upto]
        length = np.diff(upto - light, prepend=0)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms, mask=pa.array(null) if null.any() else None)
        return lists, pa.array(length, pa.int32(), mask=null)


def terms_of(text: Column) -> Column:
    """:func:`tokens` of a table's texts, folded, worked out in Python; it can't stand within a lambda."""
    return _terms(F.make_valid_utf8(text))


def estimate_tokens(text: Column) -> Column:
    """Model tokens of a text, estimated from its length."""
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)))


# Characters that a terminator takes with it, and those of them that aren't terminators.
_RUN = r"[.!?\"'’”)\]]"
_CLOSE = r"[\"'’”)\]]"
MARK = "\u0001"
#: A run that ends a sentence: it holds ! or ? or a full stop that is neither an initial's nor an abbreviation's.
_FALSE = rf"(?<=(?<![A-Za-z])(?i:[a-z]|{'|'.join(ABBREVIATIONS)}))\.{_CLOSE}*+(?!{_RUN})"
#: The first look-ahead fails at once at most places, before anything costly is tried.
_END = rf"(?={_CLOSE}*+[.!?])(?<!{_RUN})(?!{_FALSE})({_CLOSE}*+[.!?]{_RUN}*+)(?=[{SPACE}]|\z)"

SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def sentences(text: Column) -> Column:
    """Sentences with their offsets, array<struct<text,start,end>>: no piece is lost, blank ones are dropped.

    A mark goes after each run that ends a sentence and before each blank line;
    pieces between marks are trimmed and their places counted along.
    """
    safe = F.translate(text, MARK, " ")
    marked = F.regexp_replace(safe, _END, f"$1{MARK}")
    marked = F.regexp_replace(marked, r"\n(?=[ \t]*\r?\n)", f"{MARK}\n")

    def measured(piece: Column) -> Column:
        size, left = F.length(piece), F.length(F.ltrim(piece, F.lit(_SPACES)))
        return F.struct(js_trim(piece).alias("text"), size.alias("size"), (size - left).alias("lead"))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["lead"]
        one = F.struct(piece["text"].alias("text"), start.alias("start"), (start + F.length(piece["text"])).alias("end"))
        found = F.when(piece["text"] == "", state["found"]).otherwise(F.concat(state["found"], F.array(one)))
        return F.struct((state["at"] + piece["size"]).alias("at"), found.alias("found"))

    # pieces are trimmed and measured once each, before they are placed
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
    return F.aggregate(F.transform(F.split(marked, MARK), measured), zero, add, lambda s: s["found"])


# The same ends for texts within tasks: a mark of a run or a line before a blank one, and what a full stop that ends nothing stands after.
_STOP = re.compile(rf"[.!?\n](?:(?<!\n){_RUN}*+|(?<=\n)(?=[ \t]*\r?\n))")
_SHORT = re.compile(rf"(?<![A-Za-z])(?:[A-Za-z]|(?i:{'|'.join(ABBREVIATIONS)}))\Z", re.ASCII)
_LONGEST = max(map(len, ABBREVIATIONS))
#: What an abbreviation's last two letters are: after any other two letters a full stop needs no further look.
_LAST_TWO = frozenset(a[-2:] for a in ABBREVIATIONS)
_MARKS, _RUNS = re.compile("[.!?]"), frozenset(char for char in map(chr, range(0x10000)) if re.match(_RUN, char))


def _is_short(text: str, stop: int) -> bool:
    """Whether an initial or an abbreviation ends at a full stop."""
    two = text[max(0, stop - 2) : stop]
    if len(two) == 2 and two.isascii() and two.isalpha() and two.lower() not in _LAST_TWO:
        return False
    return _SHORT.search(text, max(0, stop - _LONGEST), stop) is not None


def sentence_ends(text: str, start: int = 0) -> Iterator[int]:
    """Where a text is cut into sentences, its end at last; from ``start``, which no run of terminators goes across."""
    for found in _STOP.finditer(text, start):
        first, end = found.span()
        mark = text[first]
        if mark == "\n":
            yield first
        elif end == len(text) or text[end] in _SPACES:
            if mark != "." or end > first + 1 and _MARKS.search(text, first + 1, end) or not _is_short(text, first):
                yield end
    yield len(text)


def ends_around(text: str, at: int, goal: int) -> tuple[int, int]:
    """Of the places where a text is cut, ``at`` among them, the last up to ``goal`` and the first after it; only what is near is looked at."""
    goal, width = max(at, goal), 256
    while True:
        low, last = max(at, goal - width), at
        while low > at and text[low - 1] in _RUNS:
            low -= 1
        for end in sentence_ends(text, low):
            if end > goal:
                break
            last = end
        if last > at or low == at:
            return last, end
        width *= 4


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where a text's sentences lie, as :func:`sentences` finds them; each character is looked at a fixed number of times."""
    text = text.replace(MARK, " ")
    spans, at = [], 0
    for end in sentence_ends(text):
        low, high = stripped(text, at, end)
        if low < high:
            spans.append((low, high))
        at = end
    return spans


def stripped(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the blanks at either end; empty if there is nothing else."""
    rest = text[start:end].lstrip(_SPACES)
    return end - len(rest), end - len(rest) + len(rest.rstrip(_SPACES))


def listed(rows: Iterable[list[tuple] | None], **kinds: pa.DataType) -> pa.Array:
    """Lists of tuples as an array of lists of structs; None as null."""
    rows = list(rows)
    ends = np.cumsum([0, *(len(r or ()) for r in rows)])
    columns = list(zip(*(one for r in rows for one in r or ()))) or [()] * len(kinds)
    values = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in rows), False]))
    return pa.ListArray.from_arrays(offsets, values)


def by_text(f: Callable[[str], list[tuple]], **kinds: pa.DataType) -> Callable[[Column], Column]:
    """A function of one text, None for a null one, as a column of array<struct>."""
    fields = ",".join(f"{name}:{'string' if pa.types.is_string(kind) else 'int'}" for name, kind in kinds.items())

    @F.arrow_udf(f"array<struct<{fields}>>")
    def column(texts: pa.Array) -> pa.Array:
        return listed((None if t is None else f(t) for t in texts.to_pylist()), **kinds)

    return lambda text: column(F.make_valid_utf8(text))


def sentences_of(text: Column) -> Column:
    """:func:`sentences` of a table's texts: worked out in Python, many times faster on long texts.

    It can't stand within a lambda of a column expression.
    """

    def told(t: str) -> list[tuple]:
        shown = t.replace(MARK, " ")
        return [(shown[start:end], start, end) for start, end in sentence_spans(t)]

    return by_text(told, text=pa.string(), start=pa.int32(), end=pa.int32())(text)
