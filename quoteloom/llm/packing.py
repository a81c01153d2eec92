"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A task packs its own documents, a pool of bounded size at a time, so nothing is
shuffled.  What a document has beyond whole sequences is an item with a demand
in each limit; a sequence is filled by the dot-product heuristic (of the items
that still fit, take the one whose demand, weighted by how scarce each limit is,
has the greatest dot product with the room left).  Emptier sequences are then
dissolved and their pieces cut to close the gaps in the others.  What is left of
the pool waits for the next one; at the end of a task the last tokens go into
sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .preferences import render
from .store import pick, small_batches
from .tokens import WORD_BPE, encoder, give_back_memory

POOL_TOKENS = 2_000_000
#: Text encoded at a time, which takes many times its size beside it.
PART_BYTES = 2_000_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most; each limit is 1 or more, or nothing could ever be placed."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self) -> None:
        for name in ("tokens", "segments", "loss"):
            if getattr(self, name) < 1:
                raise ValueError(f"a sequence needs room: {name} must be 1 or more")


Piece = tuple[int, int, int]  # document, first token, tokens


class Packer:
    """Packs pieces of documents; ``loss_before`` has each document's running count of loss-bearing tokens, None where all bear loss."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.loss_before: dict[int, np.ndarray | None] = {}

    def loss(self, piece: Piece) -> int:
        doc, start, length = piece
        run = self.loss_before.get(doc)
        return length if run is None else int(run[start + length] - run[start])

    def most(self, piece: Piece, tokens: int, loss: int) -> int:
        """Tokens at the piece's start that fit in so much room."""
        doc, start, length = piece
        n = min(length, tokens)
        run = self.loss_before.get(doc)
        if run is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(run[start : start + n + 1], run[start] + loss, "right")) - 1)

    def whole(self, piece: Piece) -> tuple[list[list[Piece]], Piece | None]:
        """Sequences that a long piece fills alone, and its remainder."""
        done, (doc, start, length) = [], piece
        while length > self.limits.tokens or self.loss((doc, start, length)) > self.limits.loss:
            n = self.most((doc, start, length), self.limits.tokens, self.limits.loss)
            done.append([(doc, start, n)])
            start, length = start + n, length - n
        if length == self.limits.tokens:
            return [*done, [(doc, start, length)]], None
        return done, (doc, start, length) if length else None

    def heuristic(self, items: list[Piece]) -> list[list[Piece]]:
        """Sequences of uncut items."""
        classes: dict[tuple[int, int], list[Piece]] = defaultdict(list)
        for item in items:
            classes[(item[2], self.loss(item))].append(item)
        shapes = np.array(list(classes), np.int64).reshape(-1, 2)
        stacks = list(classes.values())
        demand = np.stack([shapes[:, 0], np.ones(len(shapes), np.int64), shapes[:, 1]], 1)
        room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)
        many = np.array([len(s) for s in stacks])
        scarce = (demand * many[:, None]).sum(0) / (room * max(1, many.sum()))
        weighted = demand / room * scarce
        out = []
        left = len(items)
        while left:
            free, bin_ = room.copy(), []
            while left:
                fits = (demand <= free).all(1) & (many > 0)
                if not fits.any():
                    break
                best = int(np.argmax(np.where(fits, weighted @ (free / room), -1.0)))
                bin_.append(stacks[best].pop())
                many[best] -= 1
                free -= demand[best]
                left -= 1
            out.append(bin_)
        return out

    def room(self, bin_: list[Piece]) -> tuple[int, int, int]:
        return (
            self.limits.tokens - sum(p[2] for p in bin_),
            self.limits.segments - len(bin_),
            self.limits.loss - sum(map(self.loss, bin_)),
        )

    def close_gaps(self, bins: list[list[Piece]]) -> tuple[list[list[Piece]], list[Piece]]:
        """Full sequences, and pieces left over: the emptiest sequences are cut up to fill the others."""
        gaps = [(self.room(b), b) for b in bins]
        gaps.sort(key=lambda x: x[0][0])
        full, left = [], []
        first, last = 0, len(gaps) - 1
        while first <= last:
            (tokens, segments, loss), bin_ = gaps[first]
            while tokens and segments and loss:
                if not left:
                    if last == first:
                        break
                    left = gaps[last][1]
                    last -= 1
                doc, start, length = piece = left.pop()
                n = self.most(piece, tokens, loss)
                if n:
                    bin_.append((doc, start, n))
                    tokens, segments, loss = tokens - n, segments - 1, loss - self.loss((doc, start, n))
                if n < length:
                    left.append((doc, start + n, length - n))
                if not n:
                    break
            if tokens and segments and loss and first == last:
                left += bin_
            else:
                full.append(bin_)
            first += 1
        return full, left

    def tail(self, pieces: list[Piece]) -> list[list[Piece]]:
        """The last pieces, in sequences of powers of two while the other limits allow."""
        out: list[list[Piece]] = []
        pieces = pieces[::-1]
        while pieces:
            total = sum(p[2] for p in pieces)
            tokens = min(self.limits.tokens, 1 << (total.bit_length() - 1))
            segments, loss, bin_ = self.limits.segments, self.limits.loss, []
            while pieces and tokens and segments:
                doc, start, length = piece = pieces[-1]
                n = self.most(piece, tokens, loss)
                if not n:
                    break
                pieces.pop()
                bin_.append((doc, start, n))
                tokens, segments, loss = tokens - n, segments - 1, loss - self.loss((doc, start, n))
                if n < length:
                    pieces.append((doc, start + n, length - n))
            out.append(bin_)
        return out

    def pool(self, pieces: list[Piece]) -> tuple[list[list[Piece]], list[Piece]]:
        done, items = [], []
        for piece in pieces:
            full, rest = self.whole(piece)
            done += full
            if rest:
                items.append(rest)
        full, left = self.close_gaps(self.heuristic(items))
        return done + full, left


def _pack_task(batches: Iterator[pa.RecordBatch], ids_of, limits: Limits, pool_tokens: int) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 40
    packer = Packer(limits)
    docs: dict[int, tuple[int | None, np.ndarray]] = {}
    pieces: list[Piece] = []
    held, serial = 0, 0

    def emit(sequences: list[list[Piece]]) -> pa.RecordBatch:
        nonlocal sequence
        rows = []
        for bin_ in sequences:
            offset = 0
            for doc, start, length in bin_:
                doc_id, ids = docs[doc]
                crc = zlib.crc32(ids[start : start + length].data)
                rows.append((doc_id, start, length, crc, len(ids), sequence, offset, packer.loss((doc, start, length))))
                offset += length
            sequence += 1
        names = [x.split()[0] for x in _PIECES.split(", ")]
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        for doc_id, ids, loss in ids_of(batch):
            if not len(ids):
                continue
            docs[serial] = (doc_id, ids)
            packer.loss_before[serial] = loss
            pieces.append((serial, 0, len(ids)))
            serial += 1
            held += len(ids)
        if held >= pool_tokens:
            done, pieces = packer.pool(pieces)
            yield emit(done)
            wanted = {p[0] for p in pieces}
            docs = {k: v for k, v in docs.items() if k in wanted}
            packer.loss_before = {k: packer.loss_before[k] for k in wanted}
            held = sum(p[2] for p in pieces)
            give_back_memory()
    done, pieces = packer.pool(pieces)
    yield emit(done + packer.tail(pieces))


def pack_documents(
    docs: DataFrame,
    vocabulary: str = WORD_BPE,
    end_id: int = 1,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """A row for each piece of each document's ids: all of them bear loss.

    Null text is the empty text and has the end id alone.  Rows repeated are
    packed each for itself; a null doc_id is kept.  An empty table has no piece.
    """
    small_batches(docs.sparkSession)

    def ids_of(batch: pa.RecordBatch):
        flat, counts = encoder(vocabulary, batch_bytes=PART_BYTES).encode_array(batch.column(1))
        ends = np.cumsum(counts)
        flat = np.insert(flat, ends, end_id).astype("<u4")
        ends += np.arange(1, len(ends) + 1)
        for doc_id, end, n in zip(batch.column(0).to_pylist(), ends.tolist(), (counts + 1).tolist()):
            yield doc_id, flat[end - n : end], None

    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.withColumn("doc_id", plain.doc_id.cast("long"))
    return plain.mapInArrow(lambda b: _pack_task(b, ids_of, limits, pool_tokens), _PIECES)


def pack_examples(
    examples: DataFrame,
    limits: Limits,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    loss_col: str = "loss",
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """As :func:`pack_documents`, of instruction examples: arrays of ids and, as long, of whether each bears loss.

    A null or empty array of ids gives no piece; null loss flags count as bearing none.
    Another number of flags than ids is an error.
    """
    small_batches(examples.sparkSession)

    def ids_of(batch: pa.RecordBatch):
        for doc_id, ids, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
            flags = np.array([bool(x) for x in loss or [False] * len(ids or [])], np.int64)
            if len(flags) != len(ids or []):
                raise ValueError("an example needs a loss flag for each id")
            yield doc_id, np.array(ids or [], "<u4"), np.concatenate([[0], np.cumsum(flags)])

    plain = pick(examples, id_col, ids_col, loss_col).toDF("doc_id", "ids", "loss")
    plain = plain.withColumn("doc_id", plain.doc_id.cast("long"))
    return plain.mapInArrow(lambda b: _pack_task(b, ids_of, limits, pool_tokens), _PIECES)


def chat_examples(whole: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 1) -> DataFrame:
    """(doc_id, ids, loss) of conversations as :func:`quoteloom.llm.preferences.conversations` returns them.

    Turns are rendered and encoded one after the other; ids of assistants' turns
    bear loss, and so does the end id after an assistant's last turn.
    """
    small_batches(whole.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            talks = [[(t["role"], t["text"]) for t in turns] for turns in batch.column(1).to_pylist()]
            encoded = iter(encoder(vocabulary).encode([render(turn) for talk in talks for turn in talk]))
            ids, loss = [], []
            for talk in talks:
                parts, flags = [], []
                for role, _ in talk:
                    part = next(encoded)
                    parts.append(part)
                    flags.append(np.full(len(part), role == "assistant"))
                parts.append(np.array([end_id]))
                flags.append(np.array([bool(talk) and talk[-1][0] == "assistant"]))
                ids.append(np.concatenate(parts).astype(np.int64))
                loss.append(np.concatenate(flags))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(loss, pa.list_(pa.bool_()))], ["doc_id", "ids", "loss"])
            give_back_memory()

    return whole.select("conv_id", "turns").mapInArrow(run, "doc_id long, ids array<long>, loss array<boolean>")
