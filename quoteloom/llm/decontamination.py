"""Benchmark decontamination: FM-index searches of test phrases in shards of the corpus.

Each task gathers documents into shards of bounded size, indexes each shard and
searches all windows of the benchmark in it at once; occurrences are located
and merged into removal spans of words.  Only runs of consecutive words that the
benchmark uses, at least as long as its shortest window, can hold an occurrence,
so only these are indexed.  The benchmark is written once, in blocks of bounded
size, to the shared folder.  A task holds one block at a time, whatever the
benchmark's size, and takes a group of shards through each, so that a block is
read once for a group.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import fresh, open_input, pick, small_batches
from .tokens import give_back_memory, kept, ragged

WINDOW_WORDS = 10
#: Text of a block of the benchmark, and of a shard of the corpus.
BLOCK_BYTES, SHARD_BYTES = 8_000_000, 8_000_000
#: Shards that go through the blocks of a benchmark together, where it has several.
SHARDS_AT_ONCE = 8


def _word_bytes() -> bytes:
    """Upper-case letters to lower case, and what is in no word to a blank."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


_TABLE = _word_bytes()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


@dataclass
class Phrases:
    """The distinct windows of some items, as word numbers, right-aligned."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    item_start: np.ndarray  # of each window's items, in items
    items: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], window_words: int) -> "Phrases":
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for item, text in enumerate(texts):
            numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            size = min(window_words, len(numbers))
            for window in {tuple(numbers[i : i + size]) for i in range(len(numbers) - size + 1)} if numbers else ():
                owners.setdefault(window, []).append(item)
        windows = np.zeros((len(owners), window_words), np.int64)
        lengths = np.fromiter(map(len, owners), np.int64, len(owners))
        for row, window in enumerate(owners):
            windows[row, window_words - len(window) :] = window
        counts = np.fromiter(map(len, owners.values()), np.int64, len(owners))
        items = np.array([i for own in owners.values() for i in own], np.int64)
        return cls(vocabulary, windows, lengths, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), items)


@dataclass
class Shard:
    """Documents held until there are enough to index."""

    batches: list[pa.RecordBatch] = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    size: int = 0

    def matches(self, phrases: Phrases, covered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) pairs; marks in ``covered`` the words of each document that are hit."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(phrases.windows):
            return none
        least, get = int(phrases.lengths.min()), phrases.vocabulary.get
        numbers, docs, places, run_lengths = [], [], [], []
        for doc, text in enumerate(self.texts):
            words = text.split()
            found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            known = np.zeros(len(words) + 2, np.int8)
            known[1:-1] = found >= 0
            edge = np.diff(known)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long_enough = end - start >= least
            start, size = start[long_enough], (end - start)[long_enough]
            if len(start):
                place = ragged(start, size)
                numbers.append(found[place])
                places.append(place)
                docs.append(np.full(len(place), doc))
                run_lengths.append(size)
        if not numbers:
            return none
        number, doc, place, runs = (np.concatenate(x) for x in (numbers, docs, places, run_lengths))
        index = FMIndex(number, runs, len(phrases.vocabulary))
        low, high = index.search(phrases.windows, phrases.lengths)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        at = index.locate(ragged(low, count))
        text_doc = np.full(index.size, -1)
        text_place = np.zeros(index.size, np.int64)
        is_word = np.ones(index.size, bool)
        is_word[np.cumsum(runs + 1) - 1] = False
        text_doc[is_word], text_place[is_word] = doc, place
        depth = np.zeros(index.size + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + phrases.lengths[window], -1)
        hit = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
        by_doc = text_doc[hit]  # ascending, as documents lie in order
        edges = np.flatnonzero(np.diff(by_doc, prepend=-1, append=-2))
        for a, z in zip(edges, edges[1:]):
            covered[by_doc[a]][text_place[hit[a:z]]] = True
        pair = np.unique(text_doc[at] * len(phrases.windows) + window)
        own, row = pair // len(phrases.windows), pair % len(phrases.windows)
        many = phrases.item_start[row + 1] - phrases.item_start[row]
        items = phrases.items[ragged(phrases.item_start[row], many)]
        n_items = int(phrases.items.max()) + 1
        pair = np.unique(np.repeat(own, many) * n_items + items)
        return pair // n_items, pair % n_items


def searched(shards: Iterator[Shard], blocks: list[str], window_words: int) -> Iterator[tuple[Shard, list[np.ndarray], list[set[str]]]]:
    """Each shard with, for its documents, which words are hit, and ids of the items that occur."""
    while group := list(islice(shards, SHARDS_AT_ONCE if len(blocks) > 1 else 1)):
        covered = [[np.zeros(len(t.split()), bool) for t in shard.texts] for shard in group]
        items: list[list[set[str]]] = [[set() for _ in shard.texts] for shard in group]
        for path in blocks:
            names, phrases = read_block(path, window_words)
            for shard, hit, found in zip(group, covered, items):
                for doc, item in zip(*(x.tolist() for x in shard.matches(phrases, hit))):
                    found[doc].add(names[item])
        yield from zip(group, covered, items)


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of runs of hit words, in order."""
    if not hit.any():
        return []
    return [tuple(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2).tolist()]


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of some spans, and what stands between them."""
    if not spans:
        return text
    words = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_TABLE))]
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join(parts) + text[at:]


def write_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[str]:
    """The benchmark as files of at most about BLOCK_BYTES of text; their paths."""
    spark = benchmark.sparkSession
    items = pick(benchmark, id_col, text_col).toDF("item_id", "text").select(F.col("item_id").cast("string"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = fresh(spark, "benchmark")
    items.repartition(-(-total // BLOCK_BYTES) or 1).write.parquet(folder)
    return sorted(spark.read.schema(items.schema).parquet(folder).inputFiles())


def read_block(path: str, window_words: int) -> tuple[list[str], Phrases]:
    """Item ids and windows of a block; the last block read is kept."""
    read, key = kept("benchmark"), (path, window_words)
    if key not in read:
        read.clear()
        with open_input(path) as source:
            block = pq.read_table(source)
        texts = block["text"].cast(pa.binary()).to_pylist()
        read[key] = ([i or "" for i in block["item_id"].to_pylist()], Phrases.of(texts, window_words))
    return read[key]


def _shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[Shard]:
    """Documents in shards of about SHARD_BYTES."""
    shard = Shard()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = [t.translate(_TABLE) if t else b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
        shard.batches.append(batch)
        shard.texts += texts
        shard.size += sum(map(len, texts))
        if shard.size >= SHARD_BYTES:
            yield shard
            shard = Shard()
    if shard.texts:
        yield shard


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window_words: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (ordered as strings), spans of hit words.

    Null text has no words.  An item without words has no window; a null item id
    is the empty string.  Repeated rows have a row each, repeated items count once
    by id.  Empty tables give no row, or rows without hits.  Spans are [start, end) in words, merged and in order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = write_blocks(benchmark, item_col, item_text_col)

    def results(found: tuple[Shard, list[np.ndarray], list[set[str]]]) -> pa.RecordBatch:
        shard, covered, items = found
        spans = [[{"start": a, "end": z} for a, z in spans_of(mask)] for mask in covered]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [
            pa.concat_arrays([b.column(0) for b in shard.batches]),
            pa.array([len(m) for m in covered], pa.int64()),
            pa.array([int(m.sum()) for m in covered], pa.int64()),
            pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            pa.array(spans, kind),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])

    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.withColumn("doc_id", plain.doc_id.cast("long"))
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    return plain.mapInArrow(lambda batches: map(results, searched(_shards(batches, 1), blocks, window_words)), schema)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents in which no window occurs, all columns as they are."""
    small_batches(docs.sparkSession)
    blocks = write_blocks(benchmark, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, covered, _ in searched(_shards(batches, at), blocks, window_words):
            clean = np.array([not m.any() for m in covered], bool)
            first = 0
            for batch in shard.batches:
                yield batch.filter(pa.array(clean[first : first + batch.num_rows]))
                first += batch.num_rows
            give_back_memory()

    return docs.mapInArrow(run, docs.schema)


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """All documents, all columns as they are but for the text, which loses the merged spans of words that any window hits.

    What stands between the words of a span goes with them; null text stays null.
    """
    small_batches(docs.sparkSession)
    blocks = write_blocks(benchmark, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, covered, _ in searched(_shards(batches, at), blocks, window_words):
            first = 0
            for batch in shard.batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                masks = covered[first : first + batch.num_rows]
                left = [None if t is None else without_spans(t, spans_of(m)).decode() for t, m in zip(texts, masks)]
                yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
                first += batch.num_rows
            give_back_memory()

    return docs.mapInArrow(run, docs.schema)


def with_digest(found: DataFrame) -> DataFrame:
    """Results with items as their number and a SHA-256 of their ids, comma-joined."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
