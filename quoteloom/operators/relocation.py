"""Where quotes lie in a corpus: all of them are looked for at once, in one pass in which no text moves.

A match of a folded quote begins and ends within words at most, so its inner
words are whole words, in a row, of every document that holds it.  A run of
words has a hash that is put together from sums over all words before, so the
hash of any run of a document is two look-ups.  Of each quote the inner run of
up to three words that fewest quotes share is its *anchor*.  A task passes the
anchors' hashes through a filter of bits, looks up what is left, and compares
the hash of all inner words; only then it leaves the scan, with the words that
stand there, which are compared with the quote itself.

Quotes are written once, in blocks of bounded size, to the shared folder; a task
holds one block at a time and takes a group of documents through each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_map, fold_words, project
from ..sources.tables import arrow_batches, open_input, saved

#: Inner words of an anchor, at most.
ANCHOR_WORDS = 3
#: Characters of quotes in a block; folded text that goes through the blocks together; pairs compared at a time.
BLOCK_CHARS, GROUP_BYTES, PAIRS = 16_000_000, 32_000_000, 1_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: All bits of a number's first so many bytes.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word ``raw[start:end]``, of all words at once, eight bytes after eight."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place
    size = end - start
    with np.errstate(over="ignore"):
        found = (eight[start] & _BYTES[np.minimum(size, 8)]) * _FACTOR
        rest, at = np.flatnonzero(size > 8), 8
        while len(rest):
            more = eight[start[rest] + at] & _BYTES[np.minimum(size[rest] - at, 8)]
            found[rest] = (found[rest] ^ (found[rest] >> np.uint64(29)) ^ more) * _FACTOR
            at += 8
            rest = rest[size[rest] > at]
        found = (found ^ (found >> np.uint64(32))) * _FACTOR
    return found ^ (found >> np.uint64(29))


class Words:
    """The words of folded texts, end to end, and the hashes of their runs."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
        last = np.flatnonzero(raw == 10)
        raw[last] = 32
        self.end = np.flatnonzero(raw == 32)  # of each word, in the joined text
        offsets = np.concatenate([[0], self.end + 1]).astype(np.int32)
        self.start = offsets[:-1].astype(np.int64)
        hashes = word_hashes(raw, self.start, self.end)
        self.upto = np.searchsorted(self.end, last) + 1  # words up to the end of each text
        self.text_start = np.concatenate([[0], last[:-1] + 1])
        n = len(self.end)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _FACTOR)]))
            self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:-1], dtype=np.uint64)])

    def runs(self, first: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        """Hash of so many words from each ``first``."""
        return (self.sums[first + words] - self.sums[first]) * self.back[first]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Sought:
    """A block of quotes, by anchor."""

    def __init__(self, numbers: np.ndarray, quotes: list[str], cited: list[list[int]]):
        self.numbers, self.quotes = numbers, quotes
        self.cited = {(i, h) for i, own in enumerate(cited) for h in own or ()}
        words = Words([q.encode() for q in quotes])
        count = np.diff(words.upto, prepend=0)
        self.first_chars = words.end[words.upto - count] - words.text_start if len(quotes) else np.zeros(0, np.int64)
        inner, begin = count - 2, words.upto - count + 1
        self.inner = inner
        self.whole = np.zeros(len(quotes), np.uint64)
        fit = np.flatnonzero(inner > 0)
        self.whole[fit] = words.runs(begin[fit], inner[fit])
        self.by_size = {}
        for size in range(1, ANCHOR_WORDS + 1):
            own = fit[np.minimum(inner[fit], ANCHOR_WORDS) == size]
            if not len(own):
                continue
            many = inner[own] - size + 1
            offset = _ragged(np.zeros(len(own), np.int64), many)
            run = words.runs(np.repeat(begin[own], many) + offset, size)
            distinct, which, shared = np.unique(run, return_inverse=True, return_counts=True)
            of = np.repeat(own, many)
            order = np.lexsort((offset, shared[which], of))
            pick = order[np.searchsorted(of[order], own)]
            pick = pick[np.argsort(run[pick], kind="stable")]
            bits = max(10, int(len(pick) * 16 - 1).bit_length())
            hit = np.zeros(1 << bits, bool)
            hit[run[pick] >> np.uint64(64 - bits)] = True
            self.by_size[size] = (run[pick], of[pick], offset[pick], hit, np.uint64(64 - bits))

    def found(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Quote and first inner word of each match of the inner words."""
        n = len(words.end)
        low = np.repeat(np.concatenate([[0], words.upto[:-1]]), np.diff(words.upto, prepend=0))
        high = np.repeat(words.upto, np.diff(words.upto, prepend=0))
        for size, (anchors, quote, offset, hit, shift) in self.by_size.items():
            if n < size:
                continue
            run = words.runs(np.arange(n - size + 1), size)
            at = np.flatnonzero(hit[run >> shift])
            left, right = np.searchsorted(anchors, run[at], "left"), np.searchsorted(anchors, run[at], "right")
            at, left, many = at[right > left], left[right > left], (right - left)[right > left]
            parts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), PAIRS), "right")
            for a, z in zip(parts, [*parts[1:], len(at)]):  # a place meets the quotes that share its anchor
                row = _ragged(left[a:z], many[a:z])
                place = np.repeat(at[a:z], many[a:z])
                q = quote[row]
                begin = place - offset[row]
                ok = (begin > low[place]) & (begin + self.inner[q] < high[place])
                q, begin = q[ok], begin[ok]
                same = words.runs(begin, self.inner[q]) == self.whole[q]
                yield q[same], begin[same]


_loaded: dict[str, Sought] = {}


def _block(path: str) -> Sought:
    """A block of quotes; a worker keeps one."""
    if path not in _loaded:
        with open_input(path) as source:
            table = pq.ParquetFile(source).read()
        _loaded.clear()
        _loaded[path] = Sought(table["number"].to_numpy(), table["folded"].to_pylist(), table["cited"].to_pylist())
    return _loaded[path]


_FOUND = "number long, doc_id {}, hash long, doc_order long, hit int, span_start int, span_end int, source_text string"


def _scan(batches: Iterator[pa.RecordBatch], blocks: list[str]) -> Iterator[pa.RecordBatch]:
    least: dict[str, np.ndarray] = {}  # order of the first document told of, by quote

    def told(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([b.column(i) for b in group]) for i in range(4)]
        ids, order, hashes, texts = columns[0], columns[1].to_numpy(), columns[2].to_numpy(), columns[3]
        folded = [b" ".join(fold_words(t or "")) for t in texts.to_pylist()]
        words = Words(folded)
        rows: list[tuple] = []
        docs: list[int] = []
        maps: dict[int, tuple[str, list[int]]] = {}
        for path in blocks:
            sought = _block(path)
            first = least.setdefault(path, np.full(len(sought.numbers), np.iinfo(np.int64).max))
            for quotes, begins in sought.found(words):
                for q, d, begin in zip(quotes.tolist(), np.searchsorted(words.upto, begins, "right").tolist(), begins.tolist()):
                    if order[d] >= first[q] and (q, int(hashes[d])) not in sought.cited:
                        continue
                    quote = sought.quotes[q].encode()
                    hit = int(words.start[begin] - words.text_start[d]) - 1 - int(sought.first_chars[q])
                    if hit < 0 or not folded[d].startswith(quote, hit):
                        continue  # its first or last word is no part of the words there
                    hit = folded[d].index(quote)  # the first place of all
                    if d not in maps:
                        text = texts[d].as_py()
                        maps[d] = text, fold_map(text)[1]
                    text, places = maps[d]
                    start, end = project(places, hit, hit + len(quote))
                    rows.append((int(sought.numbers[q]), int(hashes[d]), int(order[d]), hit + 1, start, end, text[start:end]))
                    docs.append(d)
                    first[q] = min(first[q], order[d])
        names = [x.split()[0] for x in _FOUND.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        rest = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([rest[0], ids.take(pa.array(docs, pa.int64())), *rest[1:]], names)

    group, size = [], 0
    for batch in batches:
        if batch.num_rows:
            group.append(batch)
            size += batch.nbytes
        if group and (len(blocks) == 1 or size > GROUP_BYTES):
            yield told(group)
            group, size = [], 0
    if group:
        yield told(group)


def relocate(lost: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, doc_id, hit, span_start, span_end, source_text): the first document that holds each lost quote, the cited one before others.

    ``lost`` has claim_id, folded and cited_doc; ``docs`` has doc_id, doc_order,
    a whole number, and text.  ``hit`` is where the quote folds to, counted from
    one, and the span is of the document's own characters.  Quotes of fewer than
    three words have no inner word and are not found.  Quotes that many claims
    share are looked for once.  A task tells of a quote only in a document that
    a claim cites for it, or that comes before all it told of.
    """
    spark = lost.sparkSession
    quotes = saved(lost.groupBy("folded").agg(F.collect_set(F.xxhash64("cited_doc")).alias("cited"), F.count("*").alias("claims")), "quotes")
    chars = quotes.agg(F.sum(F.length("folded"))).first()[0] or 0
    blocks = saved(quotes.withColumn("number", F.monotonically_increasing_id()).repartition(-(-chars // BLOCK_CHARS) or 1), "quote-blocks")
    paths = sorted(blocks.inputFiles()) if chars else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_batches(spark)
    rows = docs.select("doc_id", F.col("doc_order").cast("long").alias("doc_order"), F.xxhash64("doc_id").alias("hash"), F.make_valid_utf8("text").alias("text"))
    rows = rows if paths else rows.limit(0)
    found = saved(rows.mapInArrow(lambda batches: _scan(batches, paths), _FOUND.format(kind)), "found")
    place = F.struct("doc_order", "doc_id", "hit", "span_start", "span_end", "source_text")
    first = found.groupBy("number").agg(F.min_by(place, "doc_order").alias("first"))
    first = blocks.select("number", "folded").join(first, "number").drop("number")
    named = found.join(blocks.select("number", "folded"), "number")
    cited = named.groupBy("folded", F.col("doc_id").alias("cited_doc")).agg(F.min_by(place, "doc_order").alias("cited"))
    asked = lost.select("claim_id", "folded", "cited_doc").join(first, "folded").join(cited, ["folded", "cited_doc"], "left")
    best = F.coalesce("cited", "first")
    return asked.select("claim_id", *[best[c].alias(c) for c in ("doc_id", "hit", "span_start", "span_end", "source_text")])
