"""Packing of whole documents into as few sequences as can be: dominance reduction, then best fit.

A sequence's content is a multiset of lengths, and there are no more lengths
than tokens in a sequence, so the whole corpus is packed from its histogram of
lengths.  *Reduction* goes through the lengths from the longest: where one set
of companions dominates every other way to fill the rest of its sequence, by
the criteria of Martello and Toth for sets of up to two companions, that set is
fixed, as many times as its lengths allow; some best packing holds them all.
What no criterion settles is packed by best fit, longest first.  Either step
moves all sequences of a kind at once, so that work and plan depend on the
number of lengths and not on that of documents: at most two new kinds of
sequence for each length, of at most 63 different lengths each.

Documents are encoded once and cut into pieces in place.  A piece's rank among
all pieces of its length is its place in its task plus the counts of the tasks
before; the plan, which every task gets, says which sequence and offset a rank
of a length has.  No text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import PART_BYTES
from .store import pick, small_batches, written
from .tokens import BYTE_BPE, crc_of_ids, encoder, give_back_memory

TOKENS = 2048

#: Lengths of a sequence and how many there are of each, and how many such sequences.
Kind = tuple[Counter, int]


def _least(counts: np.ndarray, many: int) -> list[int]:
    """The ``many`` smallest lengths, repeats included, or all there are."""
    out: list[int] = []
    for size in np.flatnonzero(counts)[:many].tolist():
        out += [size] * min(many - len(out), int(counts[size]))
    return out


def dominating(counts: np.ndarray, length: int, room: int) -> list[int] | None:
    """Companions that dominate all others for a sequence with ``length`` and ``room`` left, None where none is known to.

    ``counts`` is of the lengths left besides this one.  A set dominates another
    if the other's members can be dealt to its own so that each takes up no more
    than the member's place: exchanging them needs no further sequence.
    """
    least = _least(counts, 3)
    if not least or least[0] > room:
        return []
    one = int(np.flatnonzero(counts[: room + 1])[-1])
    if one == room or len(least) < 2 or least[0] + least[1] > room:
        return [one]
    if len(least) > 2 and sum(least) <= room:
        return None
    # at most two companions: the fullest pair, the larger member first
    sizes = np.flatnonzero(counts[: room + 1])
    upto = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), -1))
    second = upto[np.minimum(room - sizes, np.where(counts[sizes] > 1, sizes, sizes - 1))]
    pairs = np.where(second > 0, sizes + second, -1)
    best = int(pairs.max())
    if one >= best:
        return [one]
    large, small = one, int(second[-1])
    if small <= 0 or large + small < best:
        return None
    between = counts.copy()
    between[: small + 1] = 0
    between[large] -= 1
    two = _least(between, 2)
    return [large, small] if len(two) < 2 or sum(two) > room else None


def reduce(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Fix dominating sets, as long as there are any, and take their lengths out of ``counts``."""
    fixed: list[Kind] = []
    again = True
    while again:
        again = False
        for length in np.flatnonzero(counts)[::-1].tolist():
            while counts[length]:
                counts[length] -= 1
                companions = dominating(counts, length, capacity - length)
                counts[length] += 1
                if companions is None:
                    break
                kind = Counter([length, *companions])
                # fewer of these lengths leave fewer other ways, so the set dominates as often as it can be had
                times = min(int(counts[size]) // need for size, need in kind.items())
                for size, need in kind.items():
                    counts[size] -= need * times
                fixed.append((kind, times))
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Longest first, each into the fullest sequence that has room; all sequences alike are filled together."""
    by_room: list[list[Kind]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)

    def put(kind: Counter, times: int, room: int) -> None:
        if times:
            by_room[room].append((kind, times))
            open_rooms[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(open_rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                kind, times = by_room[room].pop()
                open_rooms[room] = bool(by_room[room])
            else:
                room, kind, times = capacity, Counter(), left
            each = room // length
            full = min(times, left // each)
            put(kind + Counter({length: each}), full, room - each * length)
            left -= full * each
            if full < times and left:  # fewer than one more would take
                put(kind + Counter({length: left}), 1, room - left * length)
                full, left = full + 1, 0
            if kind:
                put(kind, times - full, room)
    return [kind for kinds in by_room for kind in kinds]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: all tokens, or long lengths alone with what can't lie beside them."""
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    many, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    for k in range(capacity // 2 + 1):
        alone = many[capacity + 1] - many[capacity - k + 1]
        half = many[capacity - k + 1] - many[capacity // 2 + 1]
        free = half * capacity - (tokens[capacity - k + 1] - tokens[capacity // 2 + 1])
        rest = tokens[capacity // 2 + 1] - tokens[k]
        best = max(best, int(alone + half + max(0, -(-int(rest - free) // capacity))))
    return best


@dataclass
class Plan:
    """Where the pieces of each length go, by rank: rows ordered by length and first rank."""

    key: np.ndarray  # length << 44 | first rank
    times: np.ndarray  # sequences of the kind
    sequence: np.ndarray  # the first of them
    offset: np.ndarray  # of the length's first piece in each

    @classmethod
    def of(cls, counts: np.ndarray, capacity: int) -> "Plan":
        left = counts.copy()
        kinds = reduce(left, capacity)
        kinds += best_fit(left, capacity)
        ranks, sequence, rows = Counter(), 0, []
        for kind, times in kinds:
            offset = 0
            for length, each in sorted(kind.items(), reverse=True):
                rows.append((length << 44 | ranks[length], times, sequence, offset))
                ranks[length] += each * times
                offset += each * length
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*np.ascontiguousarray(table.T))

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece of each rank among those of its length."""
        key = length << 44 | rank
        row = np.searchsorted(self.key, key, "right") - 1
        nth, which = np.divmod(key - self.key[row], self.times[row])
        return self.sequence[row] + which, self.offset[row] + nth * length


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, slot long"


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents, with the task that made them and their place among its pieces of the length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, np.int64)
        codec = encoder(vocabulary, batch_bytes=PART_BYTES)
        for batch in batches:
            flat, counts = codec.encode_array(batch.column(1))
            flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            first = np.cumsum(counts) - counts
            pieces = -(-counts // tokens)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = (counts - (pieces - 1) * tokens)[doc]  # of the first piece
            start = np.where(piece, short + (piece - 1) * tokens, 0)
            length = np.where(piece, tokens, short)
            begin = first[doc] + start
            crcs = [crc_of_ids(flat[a : a + n]) for a, n in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            among = np.bincount(length, minlength=tokens + 1)
            slot = np.empty(len(length), np.int64)
            slot[order] = np.arange(len(length)) - np.repeat(np.cumsum(among) - among, among)
            slot += seen[length]
            seen += among
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(doc), part)), pa.array(slot)], [x.split()[0] for x in _PIECES.split(", ")])
            give_back_memory()

    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return plain.withColumn("doc_id", plain.doc_id.cast("long")).mapInArrow(run, _PIECES)


def best_fit_pack(
    docs: DataFrame,
    vocabulary: str = BYTE_BPE,
    end_id: int = 0,
    tokens: int = TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document.

    A document of more than ``tokens`` ids, the end id included, is cut into
    pieces of so many, the first of which may be shorter; others stay whole.
    Null text is the empty text and has the end id alone.  Rows repeated are
    packed each for itself; a null doc_id is kept.  A very long text is encoded
    as a whole, by one task.  An empty table has no piece.
    """
    if tokens < 1:
        raise ValueError("a sequence needs room: tokens must be 1 or more")
    pieces = written(cut_documents(docs, vocabulary, end_id, tokens, id_col, text_col), "pieces")
    histogram = np.zeros(tokens + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row for each length, ``tokens`` at most
        histogram[row.length] = row.n
    plan = Plan.of(histogram, tokens)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = plan.places(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
