"""Overlapping passages of documents, exact to the character."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_TARGET
from ..functions.text import MARK, by_text, ends_around, is_blank, sentence_ends, stripped
from ..sources.tables import arrow_batches
from .numbering import as_ranges, numbered
from .scoring import held_terms

_GAP = re.compile(r"\n[ \t]*\r?\n")


def spans_of(text: str, target: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Spans of a text's passages, see :func:`chunk_spans`.

    Segments are paragraphs, or the sentences of a long one, or slices of one
    that has none.  Of a long paragraph's sentences only those are told apart that
    lie where a passage ends.
    """
    text = text.replace(MARK, " ")
    done: list[tuple[int, int]] = []
    start, end = 0, -1

    def add(low: int, high: int) -> None:
        """The next segment."""
        nonlocal start, end
        if end == -1:
            start = low
        elif high - start > target:
            done.append((start, end))
            start = min(max(start, end - overlap), low)
        end = high

    gaps = [found.span() for found in _GAP.finditer(text)]
    for first, last in zip([0, *(z for _, z in gaps)], [*(a for a, _ in gaps), len(text)]):
        piece = text[first:last]
        low, high = stripped(piece, 0, len(piece))
        if low == high:
            continue
        if len(piece) <= target:
            add(first, last)
            continue
        at = next(e for e in sentence_ends(piece) if e > low)  # the end of the first sentence
        if at >= high:
            for a in range(0, len(piece), target):
                if not is_blank(piece[a : a + target]):
                    add(first + a, min(first + a + target, last))
            continue
        add(first + low, first + stripped(piece, low, at)[1])
        while at < high:
            room = start + target - first
            if high <= room:
                add(first + high, first + high)  # all that is left
                break
            before, after = ends_around(piece, at, room)
            for a, z in ((at, before), (before, after)):
                a, z = stripped(piece, a, z)
                if a < z:
                    add(first + a, first + z)
            at = after
    if end == -1:
        return done
    if done and end - start < least:
        start = done.pop()[0]
    return [*done, (start, end)]


def chunk_spans(text: Column, target: int = CHUNK_TARGET, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_MIN) -> Column:
    """Spans of a text's passages: as many segments as fit, each passage beginning in the end of the one before.

    A last passage that is too short joins the one before it.  A text is gone
    through once, however many passages it has.
    """
    return by_text(lambda t: spans_of(t, target, overlap, least), start=pa.int32(), end=pa.int32())(text)


def running_sum(rows: DataFrame, order: str, value: str, into: str, stride: int = 65_536) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before in ``order``, a unique whole number.

    Ranges of ``stride`` numbers are summed first; where numbers are far apart,
    there are many ranges, which are summed by ranges of ranges, and so on.  No
    task sees more than ``stride`` numbers of any level, however they are spread.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return _summed_before(rows, order, value, into, stride, (high or 0) - (low or 0), 0)


def _summed_before(rows: DataFrame, order: str, value: str, into: str, stride: int, spread: int, level: int) -> DataFrame:
    part, base, within = (f"_{name}{level}" for name in ("range", "base", "within"))
    ranged = rows.withColumn(part, F.expr(f"(`{order}` - pmod(`{order}`, {stride}L)) div {stride}L"))
    totals = ranged.groupBy(part).agg(F.sum(value).alias("_sum"))
    if spread // stride >= stride:
        bases = _summed_before(totals, part, "_sum", base, stride, spread // stride, level + 1).select(part, base)
    else:
        before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(base))
    own = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(within, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return summed.join(bases, part).withColumn(into, F.col(base) + F.col(within)).drop(part, base, within)


def chunk_documents(docs: DataFrame, target: int = CHUNK_TARGET, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_MIN, asked: list[str] | None = None) -> DataFrame:
    """Passages of docs (doc_id, doc_order, title, text): chunk_id, doc_id, doc_order, doc_title, index, start, end, text.

    Ids are ``<doc_id>#<index>``; :func:`number_chunks` numbers a whole corpus.
    A document's passages are made where it lies; only documents out of order are
    dealt by ranges of it first.  With ``asked`` (``retrieval.asked_files``) they
    have the columns terms and length of ``retrieval.indexed`` besides, counted
    in the same pass.
    """
    arrow_batches(docs.sparkSession)
    docs = as_ranges(docs, "doc_order")
    rows = docs.select("doc_id", "doc_order", F.col("title").alias("doc_title"), F.make_valid_utf8("text").alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns[:3]} | {"index": "int", "start": "int", "end": "int", "text": "string"}
    paths = None if asked is None else tuple(asked)
    if paths is not None:
        kinds |= {"terms": "array<string>", "length": "int"}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            spans = [spans_of(t, target, overlap, least) if t else [] for t in texts]
            cut = [t[a:z] for t, own in zip(texts, spans) for a, z in own]
            row = pa.array([i for i, own in enumerate(spans) for _ in own], pa.int64())
            numbers = [[i for own in spans for i in range(len(own))], [a for own in spans for a, _ in own], [z for own in spans for _, z in own]]
            columns = [*(batch.column(i).take(row) for i in range(3)), *(pa.array(n, pa.int32()) for n in numbers), pa.array(cut, pa.string())]
            if paths is not None:
                columns += held_terms(paths).counted(cut)
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    found = rows.mapInArrow(scan, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))
    return found.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("index").cast("string")).alias("chunk_id"), *found.columns)


def number_chunks(chunks: DataFrame, first: int = 0) -> DataFrame:
    """Chunks, written once, with ids c0, c1, ... (or from ``first``) in document order, and that number as chunk_order.

    No passage moves if documents lie in order (:mod:`quoteloom.operators.numbering`).
    """
    found = numbered(chunks, ("doc_order", "index"), "chunk_order", "chunks").withColumn("chunk_order", F.col("chunk_order") + first)
    return found.withColumn("chunk_id", F.concat(F.lit("c"), F.col("chunk_order").cast("string")))
