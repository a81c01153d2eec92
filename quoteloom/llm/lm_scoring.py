"""Language-model scoring of whole texts: a smoothed unigram base, and causal self-attention.

One pass cuts the corpus into blocks.  A block's file holds its texts as numbers
of the block's own words, and each of those words' subword ids; its words go
into a table with their training counts, packed by bucket of their hash.  That
table is dealt by bucket, summed there, and goes back to the blocks as numbers
alone: each block gets the corpus-wide counts of just the words it holds, and
neither a vocabulary nor (document, word) pairs are ever moved whole.

The attention model learns from all training documents: subword counts and
neighbours give token classes, and every window of every training document is
trained on, in the round of training that its hash says.  Windows of a round
are dealt by hash into groups of about GROUP, each of which is trained on in
order from the parameters of the round before; parameters are averaged in order
of groups.  Neither choice nor order depends on how rows were dealt, so a text's
score doesn't either, but for the rounding of sums.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import WINDOW, Attention, Classes, log_probabilities, make_classes, sums_of, windows
from .simple8b import decode, encode
from .store import drop, fresh, open_input, open_output, partitions, pick, small_batches, written
from .tokens import WORD_BPE, encoder, give_back_memory, keep_memory, kept, ragged
from .word_bpe import word_encoder

BLOCK_BYTES = 16_000_000
#: Bound of the memo beside a block in memory.
MEMO_UNITS = 600_000
FOLD, HELD_OUT = 7, 2
#: Hashed neighbours on each side, for classes.
BUCKETS = 8
#: Rounds of training, the share of all windows that each uses (one in so many: together they use all), and windows of a group.
ROUNDS, GROUP = 3, 8192
TRAIN_SHARE = ROUNDS
#: Buckets of words by hash, buckets of a round's groups at most, and slices of a table of counts: what is one row each.
WORD_BUCKETS, GROUP_BUCKETS, SLICES = 2048, 4096, 16
_END_WORD = b" "  # no word is empty; the words of the table keep the blank after them
#: Bytes of a packed window: hash, place where scoring starts, size, class before, classes.
PACKED = 4 + 3 + WINDOW


def _crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with the blank after each, most frequent first, the words of all texts as their numbers, and each text's number of words."""
    lines = [b" ".join(t.lower().split()) for t in texts]
    joined = b" ".join(x for x in lines if x) + b" "
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    if not counts.sum():
        return pa.array([], pa.binary()), np.zeros(0, np.int64), counts
    column = _split(np.frombuffer(joined, np.uint8)).dictionary_encode()
    codes = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    often = np.bincount(codes)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return column.dictionary.take(pa.array(order)), rank[codes], counts


def _split(raw: np.ndarray) -> pa.Array:
    """Words with the blank after each, of a buffer of such."""
    offsets = np.concatenate([[0], np.flatnonzero(raw == 32) + 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each word, of so many, by a hash of its bytes."""
    if not len(words):
        return np.zeros(0, np.uint16)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
    size = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
    mixed = np.add.reduceat((raw + np.uint64(1)) * _PLACES[place % len(_PLACES)], offsets[:-1])  # no word is empty
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[0]
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16)


def _rows_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of runs of values, up to each end."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, end to end."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _sizes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a binary column."""
    return np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64)


def _path(folder: str, number: int) -> str:
    return f"{folder}/{number:016d}.block"


class Block:
    """Some documents, read from their file."""

    def __init__(self, folder: str, number: int):
        with open_input(_path(folder, number)) as source:
            held = np.load(io.BytesIO(source.read()))
        self.doc_ids, self.known, self.crc, self.counts = (held[k] for k in ("doc_ids", "known", "crc", "counts"))
        self.bucket = held["bucket"]
        self.words = decode(held["coded"], held["offsets"], held["escaped"], int(self.counts.sum())).astype(np.int64)
        self.sub_counts, self.sub_ids = held["sub_counts"].astype(np.int64), held["sub_ids"].astype(np.int64)
        self.held_out = self.crc % FOLD == HELD_OUT

    def parts(self, chosen: np.ndarray, words: int = 400_000) -> list[np.ndarray]:
        """Chosen documents in parts of about so many words, to bound what is held at once."""
        if not len(chosen):
            return []
        part = (np.cumsum(self.counts[chosen]) - self.counts[chosen]) // words
        return np.split(chosen, np.flatnonzero(np.diff(part)) + 1)

    def tokens(self, chosen: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of chosen documents, each with the end after it, and their counts."""
        first = np.cumsum(self.counts) - self.counts
        words = self.words[ragged(first[chosen], self.counts[chosen])]
        size = self.sub_counts[words]
        starts = np.cumsum(self.sub_counts) - self.sub_counts
        ids = self.sub_ids[ragged(starts[words], size)]
        run = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(self.counts[chosen])
        counts = run[ends] - run[ends - self.counts[chosen]]
        return np.insert(ids, np.cumsum(counts), end), counts + 1


def write_blocks(docs: DataFrame, folder: str, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Write the blocks; the table (block, bucket, words, trained) of their words with counts, bucket -1 being the end of a text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = serial = 0

        def block() -> pa.RecordBatch:
            nonlocal serial, size
            number = (task.taskAttemptId() << 20) + serial  # a repeated attempt writes files of its own
            words, numbers, counts = _words(texts)
            sub_ids, sub_counts = word_encoder(vocabulary, MEMO_UNITS).encode(words, tail=1)
            coded, offsets, escaped = encode(numbers.astype(np.uint64))
            crc = np.array([_crc(i) for i in ids], np.int64)
            bucket = _buckets(words, WORD_BUCKETS)
            order = np.argsort(bucket, kind="stable")
            out = io.BytesIO()
            known = np.array([i is not None for i in ids])
            np.savez(out, bucket=bucket, doc_ids=np.array([i or 0 for i in ids], np.int64), known=known, crc=crc, counts=counts, coded=coded, offsets=offsets, escaped=escaped, sub_counts=sub_counts.astype(np.int32 if len(sub_counts) and sub_counts.max() > 255 else np.uint8), sub_ids=sub_ids.astype(np.uint16 if encoder(vocabulary, MEMO_UNITS).vocab_size < 65_000 else np.uint32))
            with open_output(_path(folder, number)) as file:
                file.write(out.getvalue())
            learnt = np.repeat(crc % FOLD != HELD_OUT, counts)
            trained = np.bincount(numbers[learnt], minlength=len(words))
            serial += 1
            last = np.flatnonzero(np.diff(bucket[order], append=WORD_BUCKETS)) + 1  # one past each bucket's last word
            dealt = words.take(pa.array(order))
            ends = np.frombuffer(dealt.buffers()[1], np.int32)[last] if len(words) else last
            packed = pa.concat_arrays([pa.array([_END_WORD], pa.binary()), _rows_of(_bytes_of(dealt), ends)])
            own = np.append(int((crc % FOLD != HELD_OUT).sum()), trained[order]).astype(np.int32)
            rows = [pa.array(np.full(len(packed), number)), pa.array(np.append(-1, bucket[order][last - 1].astype(np.int32)).astype(np.int32)), packed, _rows_of(own, np.append(1, last + 1))]
            ids.clear()
            texts.clear()
            size = 0
            return pa.RecordBatch.from_arrays(rows, ["block", "bucket", "words", "trained"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    give_back_memory()
        if ids:
            yield block()

    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.withColumn("doc_id", plain.doc_id.cast("long"))
    return written(plain.mapInArrow(run, "block long, bucket int, words binary, trained binary"), "words")


def written_classes(classes: Classes, path: str) -> str:
    """Classes with their table of shares as a file, for tasks to read: its size is that of vocabulary and classes."""
    out = io.BytesIO()
    np.savez_compressed(out, of=classes.of, log_share=classes.log_share, count=classes.count, log_prior=classes.log_prior, log_after=classes.log_after)
    with open_output(path) as file:
        file.write(out.getvalue())
    return path


def read_classes(path: str) -> Classes:
    """What :func:`written_classes` wrote; the last one read is kept."""
    classes = kept("classes")
    if path not in classes:
        with open_input(path) as source:
            held = np.load(io.BytesIO(source.read()))
        classes.clear()
        classes[path] = Classes(held["of"], held["log_share"], int(held["count"]), held["log_prior"], held["log_after"])
    return classes[path]


def corpus_counts(words: DataFrame) -> DataFrame:
    """(block, bucket, c, n, v): c are the training counts in all blocks of the words of each row, in order.

    n sums to the training tokens of all blocks, v to the distinct ones.
    """
    names = ["block", "bucket", "words", "trained"]

    def counted(rows: pa.RecordBatch) -> pa.RecordBatch:
        codes = _split(_bytes_of(rows["words"])).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        trained = _bytes_of(rows["trained"]).view(np.int32)
        total = np.bincount(codes, trained).astype(np.int64)
        ends = np.cumsum(_sizes_of(rows["trained"]) // 4)
        n = np.diff(np.concatenate([[0], np.cumsum(trained, dtype=np.int64)])[ends], prepend=0)
        v = np.zeros(len(ends), np.int64)
        v[0] = (total > 0).sum()
        return pa.RecordBatch.from_arrays([rows["block"], rows["bucket"], _rows_of(total[codes], ends), pa.array(n), pa.array(v)], ["block", "bucket", "c", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last bucket, which may go on, and what came with its beginning

        def joined() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(4)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column(1)[-1] == held[0].column(1)[0]:
                continue
            rows = joined()
            bucket = rows["bucket"].to_numpy()
            edge = int(np.searchsorted(bucket, bucket[-1]))
            yield counted(rows.slice(0, edge))
            held = [rows.slice(edge)]
        if held:
            yield counted(joined())

    dealt = words.repartition(partitions(words.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, c binary, n long, v long")


def _sliced(total: np.ndarray) -> list[pa.Array]:
    """Counts of a table that aren't zero, as columns (slice, cells, n) of few rows."""
    cell = np.flatnonzero(total)
    ends = np.searchsorted(cell, -(-len(total) // SLICES) * np.arange(1, SLICES + 1))
    return [pa.array(np.arange(SLICES, dtype=np.int32)), _rows_of(cell.astype(np.int32), ends), _rows_of(total[cell].astype(np.int64), ends)]


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The table of ``size`` counts that columns (slice, cells, n) add up to."""
    width = -(-size // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, cells, n in zip(*(c.to_pylist() for c in batch.columns)):
                totals.setdefault(number, np.zeros(width, np.int64))[np.frombuffer(cells, np.int32) - number * width] += np.frombuffer(n, np.int64)
        for number, total in totals.items():
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([(cell + number * width).astype(np.int32).tobytes()]), pa.array([total[cell].tobytes()])], ["slice", "cells", "n"])

    spark = parts.sparkSession
    found = parts.repartition(min(SLICES, partitions(spark)), "slice").mapInArrow(run, "slice int, cells binary, n binary").toArrow()
    total = np.zeros(size, np.int64)
    for cells, n in zip(found["cells"].to_pylist(), found["n"].to_pylist()):
        total[np.frombuffer(cells, np.int32)] = np.frombuffer(n, np.int64)
    return total


def neighbour_counts(blocks: DataFrame, folder: str, vocab_size: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of each token of training documents (the last is the end), of its hashed neighbours, and of windows by turn."""
    width = 2 * BUCKETS + 1
    size = (vocab_size + 1) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size + share, np.int64), False
        for batch in batches:
            for number in batch.column(0).to_pylist():
                block, seen = Block(folder, number), True
                for part in block.parts(np.flatnonzero(~block.held_out)):
                    ids, counts = block.tokens(part, vocab_size)
                    bucket = ids * 40_503 % 65_537 % BUCKETS
                    for cell in (ids * width, ids[1:] * width + 1 + bucket[:-1], ids[:-1] * width + 1 + BUCKETS + bucket[1:]):
                        total[:size] += np.bincount(cell, minlength=size)
                    total[size:] += np.bincount(_hashed_windows(block, part, ids, counts)[-1] % share, minlength=share)
        if seen:
            yield pa.RecordBatch.from_arrays(_sliced(total), ["slice", "cells", "n"])

    total = _summed(blocks.mapInArrow(run, "slice int, cells binary, n binary"), size + share)  # the size of the vocabulary file
    table = total[:size].reshape(-1, width)
    return table[:, 0], table[:, 1:], total[size:]


_MIX = tuple(np.random.default_rng(11).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1))
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _window_hash(crc: np.ndarray, which: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """31 bits that name a window by its document's id, its place there, and its first and last token."""
    parts = (x.astype(np.uint64) * m for x, m in zip((crc, which, first, last), _MIX))
    mixed = sum(parts, np.zeros(len(crc), np.uint64))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[4]
    return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(33)


def _hashed_windows(block: Block, part: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, size, scored from, hash) of the windows of some documents."""
    start, text, scored = windows(counts)
    first = (np.cumsum(counts) - counts)[text] + start
    size = np.minimum(counts[text] - start, WINDOW)
    return first, size, scored, _window_hash(block.crc[part][text], start, ids[first], ids[first + size - 1]).astype(np.int64)


def _groups(h: np.ndarray, groups: int) -> np.ndarray:
    """The group of each window of a round, by its hash."""
    mixed = h.astype(np.uint64) * _MIX[1]
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX[2] >> np.uint64(33)).astype(np.int64) % max(1, groups)


def training_data(blocks: DataFrame, folder: str, classes: Classes, rounds: int, share: int, many: np.ndarray) -> DataFrame:
    """One pass over training documents, as a written table of two kinds of rows.

    (slice, cells, n) are partial counts by (class before, token); (turn,
    groups, bucket, window) are the windows of each round, those of a bucket of
    its groups packed end to end: hash, where scoring starts, size, the class
    before, and the classes themselves.  ``many`` are the windows of each turn.
    """
    width = len(classes.of)
    names = ["slice", "cells", "n", "turn", "groups", "bucket", "window"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    groups = [-(-int(x) // GROUP) for x in many]

    def some(*given: pa.Array, at: int) -> pa.RecordBatch:
        columns = [given[i - at] if 0 <= i - at < len(given) else pa.nulls(len(given[0]), k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((classes.count + 1) * width, np.int64), False
        for batch in batches:
            for number in batch.column(0).to_pylist():
                block, seen = Block(folder, number), True
                packed, dealt = [], []
                for part in block.parts(np.flatnonzero(~block.held_out)):
                    ids, counts = block.tokens(part, width - 1)
                    before = classes.before(ids, counts)
                    total += np.bincount(before * width + ids, minlength=len(total))
                    first, size, scored, h = _hashed_windows(block, part, ids, counts)
                    turn = h % share
                    for now in range(rounds):
                        own = np.flatnonzero(turn == now)
                        rows = np.empty((len(own), PACKED), np.uint8)
                        rows[:, :4] = h[own].astype("<u4").view(np.uint8).reshape(-1, 4)
                        rows[:, 4], rows[:, 5], rows[:, 6] = scored[own], size[own], before[first[own]]
                        rows[:, 7:] = np.lib.stride_tricks.sliding_window_view(np.pad(classes.of[ids], (0, WINDOW)), WINDOW)[first[own]]
                        rows[:, 7:] *= np.arange(WINDOW) < size[own][:, None]
                        packed.append(rows)
                        dealt.append(now * GROUP_BUCKETS + _groups(h[own], groups[now]) % GROUP_BUCKETS)
                if not packed or not sum(map(len, packed)):
                    continue
                rows, key = np.concatenate(packed), np.concatenate(dealt)
                order = np.argsort(key, kind="stable")
                key = key[order]
                ends = np.flatnonzero(np.diff(key, append=-1)) + 1
                turn, bucket = np.divmod(key[ends - 1], GROUP_BUCKETS)
                window = _rows_of(rows[order].reshape(-1), ends * PACKED)
                yield some(pa.array(turn, pa.int32()), pa.array(np.array(groups)[turn], pa.int32()), pa.array(bucket, pa.int32()), window, at=3)
        if seen:
            yield some(*_sliced(total), at=0)

    schema = "slice int, cells binary, n binary, turn int, groups int, bucket int, window binary"
    return written(blocks.mapInArrow(run, schema), "training-data")


def pair_counts(data: DataFrame, classes: Classes) -> np.ndarray:
    """Corpus counts by (class before, token) of training documents."""
    found = _summed(data.where("slice is not null").select("slice", "cells", "n"), (classes.count + 1) * len(classes.of))  # a number for each class and token
    return found.astype(float).reshape(-1, len(classes.of))


def in_order(packed: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows in order of their group, hash and classes, and the group of each."""
    packed = packed.reshape(-1, PACKED)
    h = np.ascontiguousarray(packed[:, :4]).view("<u4").reshape(-1).astype(np.int64)
    key = _groups(h, groups) << 32 | h
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    tied = np.flatnonzero(same | np.append(same[1:], False))
    if len(tied):  # windows of one hash are ordered by all of their bytes
        rows = packed[order[tied]]
        order[tied] = order[tied][np.lexsort([*rows.T[::-1], key[tied]])]
    return packed[order], key >> 32


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which of them are scored, of windows as :func:`training_data` writes them."""
    grid = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PACKED)[:, 4:].astype(np.int64)
    place = np.arange(WINDOW)
    grid = grid[np.argsort(grid[:, 0], kind="stable")]  # windows that begin a text first: of the others, the first places are not asked for
    live = (place < grid[:, 1:2]) & (place >= grid[:, :1])
    return grid[:, 2:-1], grid[:, 3:], live


def train(data: DataFrame, classes: Classes, rounds: int, sums: int = 32) -> np.ndarray:
    """Parameters after some rounds, each over its own windows of all training documents."""
    weights = Attention(classes.count, classes.log_prior).flat()
    chosen = data.where("window is not null").select("turn", "groups", "bucket", "window")
    groups = {r.turn: r.n for r in chosen.groupBy("turn").agg(F.max("groups").alias("n")).collect()}  # a row for each round
    n = partitions(data.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, tuple[int, np.ndarray]] = {}  # in order of groups within each
        for batch in batches:
            for slot, seen, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                part, (had, total) = np.frombuffer(raw, np.float64) * seen, slots.get(slot, (0, 0.0))
                slots[slot] = had + seen, total + part
        for slot, (seen, total) in slots.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((slot, pa.int64()), (0, pa.int64()), (seen, pa.int64()), (total.tobytes(), pa.binary()))], ["slot", "group", "seen", "weights"])

    for turn in range(rounds):
        if turn not in groups:
            continue

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            keep_memory()
            now, held = None, []

            def learnt() -> Iterator[pa.RecordBatch]:
                rows, group = in_order(np.concatenate(held), groups[turn])
                held.clear()
                for a, z in zip(edges := np.flatnonzero(np.diff(group, prepend=-1, append=-1)), edges[1:]):
                    model = Attention(classes.count, classes.log_prior).load(weights)
                    for at in range(a, z, 2 * GROUP):
                        model.train(*unpacked([rows[at : min(z, at + 2 * GROUP)].tobytes()]), rate=0.02 / (turn + 1))
                    name = int(group[a])
                    row = ((name % sums, pa.int64()), (name, pa.int64()), (int(z - a), pa.int64()), (model.flat().astype(np.float64).tobytes(), pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in row], ["slot", "group", "seen", "weights"])

            for batch in batches:
                bucket = batch.column(0).to_numpy()
                sizes = np.cumsum(_sizes_of(batch.column(1)))
                raw = _bytes_of(batch.column(1))
                ends = np.flatnonzero(np.diff(bucket, append=-1))
                for number, part in zip(bucket[ends].tolist(), np.split(raw, sizes[ends])):
                    if held and number != now:
                        yield from learnt()
                    now = number
                    held.append(part)
            if held:
                yield from learnt()

        dealt = chosen.where(F.col("turn") == turn).select("bucket", "window")
        dealt = dealt.repartition(min(n, groups[turn]), "bucket").sortWithinPartitions("bucket")
        schema = "slot long, group long, seen long, weights binary"
        summed = dealt.mapInArrow(run, schema).repartition(min(n, sums), "slot").sortWithinPartitions("slot", "group").mapInArrow(partial, schema)
        rows = sorted(summed.collect(), key=lambda r: r.slot)  # at most ``sums`` rows
        weights = sum(np.frombuffer(r.weights, np.float64) for r in rows) / sum(r.seen for r in rows)
    return weights.astype(np.float32)


def score(
    docs: DataFrame, vocabulary: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, share: int = TRAIN_SHARE
) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is the empty text, which has the end token alone.  Documents whose
    id's CRC-32 leaves the remainder HELD_OUT teach nothing; a null id counts as
    the empty text there.  With no training documents all counts are zero.  Rows
    repeated are each scored and each learnt from.  An empty table has no row.
    """
    spark = docs.sparkSession
    folder, n = fresh(spark, "blocks"), partitions(spark)
    words = write_blocks(docs, folder, vocabulary, id_col, text_col)
    blocks = written(words.where("bucket = -1").select("block"), "block-list").repartition(n, "block")
    counted = written(corpus_counts(words), "word-counts")
    drop(words, spark)
    row = counted.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, distinct = row.n or 0, row.v
    vocab_size = encoder(vocabulary, MEMO_UNITS).vocab_size
    counts, context, many = neighbour_counts(blocks, folder, vocab_size, share)
    classes = make_classes(counts, context)
    data = training_data(blocks, folder, classes, rounds, share, many)
    weights = train(data, classes, rounds)
    shared = written_classes(classes.with_pairs(pair_counts(data, classes)), f"{folder}/classes")
    drop(data, spark)

    del classes

    def scored(number: int, by_bucket: np.ndarray) -> pa.RecordBatch:
        block, end_count = Block(folder, number), by_bucket[0]  # the end of a text comes first
        counts = np.empty(len(block.bucket), np.int64)
        counts[np.argsort(block.bucket, kind="stable")] = by_bucket[1:]
        log = np.log10((counts + 1) / (tokens + distinct + 1))

        def summed(values: np.ndarray) -> np.ndarray:
            return sums_of(values[block.words], block.counts)

        base = summed(log) + np.log10((end_count + 1) / (tokens + distinct + 1))
        known = summed((counts > 0).astype(np.int64)) + (end_count > 0)
        classes = read_classes(shared)
        model = Attention(classes.count, classes.log_prior).load(weights)
        parts = block.parts(np.arange(len(block.counts)))
        probability = np.concatenate([log_probabilities(model, classes, *block.tokens(part, vocab_size)) for part in parts])
        columns = [
            pa.array(block.doc_ids, mask=~block.known),
            pa.array(block.held_out),
            pa.array(block.counts + 1),
            pa.array(known),
            pa.array(np.full(len(known), tokens)),
            pa.array(base),
            pa.array(probability),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        now, held = None, []
        for batch in batches:
            number = batch.column(0).to_numpy()
            sizes = np.cumsum(_sizes_of(batch.column(1)))
            ends = np.flatnonzero(np.diff(number, append=-1))
            for own, part in zip(number[ends].tolist(), np.split(_bytes_of(batch.column(1)), sizes[ends])):
                if held and own != now:
                    yield scored(now, np.concatenate(held).view(np.int64))
                    give_back_memory()
                    held.clear()
                now = own
                held.append(part)
        if held:
            yield scored(now, np.concatenate(held).view(np.int64))
            give_back_memory()

    dealt = counted.repartition(n, "block").sortWithinPartitions("block", "bucket").select("block", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.mapInArrow(run, schema)
