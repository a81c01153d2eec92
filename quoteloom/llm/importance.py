"""Resampling towards a target by importance: hashed n-grams, noisy weights, and an exact draw.

Runs of one to three words are hashed into buckets; the share of each bucket in
the target and in the corpus gives the bucket's *gain*, and a document's weight
is the sum over its features.  With Gumbel noise from its id, the highest
scores are a sample without replacement in proportion to the weights.

Counting and scoring go over columns: words are cut with numpy and told apart by
an Arrow dictionary, only distinct words are hashed, and the checksum of a run
of words is put together from those of its words, as CRC-32 is linear.

The draw sends no document and no full sort.  The least score that can be drawn
is found from counts of at most 4,096 ranges of scores, read again for the range
that holds it.  What reaches it is sorted within each partition, a *run*, and
dealt by ranges of (score, id) to slices, which are written run after run.  The
sizes of the slices tell how many each has to give; a tournament tree merges a
slice's runs, a block of each in memory, stops when that many are drawn, and
numbers them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import _TABLE
from .store import fresh, open_input, open_output, partitions, pick, small_batches, written
from .tokens import give_back_memory

BUCKETS, LONGEST, LEAST_WORDS, SEED = 10_000, 3, 20, 42
#: Text cut into words at a time; a longer text is taken in pieces.
PART_BYTES = 2_000_000
#: Ranges of scores counted at a time, and records of a slice in memory while it is merged.
RANGES, HELD = 4096, 1_000_000
_LAST = np.iinfo(np.int64).max


class Shifts:
    """Moves a CRC-32 past any number of bytes: by tables up to 64, and by powers of two of 64 beyond."""

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, byte >> 1 ^ np.uint32(0xEDB88320), byte >> 1)
        now = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
        tables = [now]
        for _ in range(64):
            now = byte[now & 255] ^ now >> 8
            tables.append(now)
        self.short = np.ascontiguousarray(np.stack(tables)).reshape(-1)
        self.powers = [np.ascontiguousarray(tables[64])]

    @staticmethod
    def _apply(table: np.ndarray, base: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
        out = table.take(base + (crc & 255))
        for k in (1, 2, 3):
            out ^= table.take(base + ((crc >> np.uint32(8 * k) & 255) + 256 * k))
        return out

    def __call__(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``crc`` (unsigned 32-bit) of texts, past ``size`` zero bytes each."""
        out = self._apply(self.short, (size % 64) << 10, crc)
        if len(size) and size.max() >= 64:
            times, power = size // 64, 0
            while times.max() >> power:
                if power == len(self.powers):
                    last = self.powers[-1]
                    self.powers.append(self._apply(last.reshape(-1), 0, last.reshape(-1)).reshape(4, 256))
                far = np.flatnonzero(times >> power & 1)
                out[far] = self._apply(self.powers[power].reshape(-1), 0, out[far])
                power += 1
        return out


_shifts: list[Shifts] = []


def segments(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Parts of bounded size: (place of the text, words between blanks, how many leading words belong to the segment before)."""
    part, size = [], 0
    for place, text in enumerate(texts):
        text, context, before = (text or b"").translate(_TABLE), 0, 0
        while True:
            if size and size + len(text) > PART_BYTES:
                yield part
                part, size = [], 0
            cut = text.find(b" ", before + PART_BYTES)
            if cut < 0 or not text[cut:].strip():
                break
            yield [(place, text[:cut], context)]
            again = text[:cut].split()[1 - LONGEST :]
            context, before = len(again), sum(map(len, again)) + len(again)
            text = b" ".join([*again, text[cut:]])
        part.append((place, text, context))
        size += len(text) + 1
    if part:
        yield part


def features(part: list[tuple[int, bytes, int]], buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words by segment, each word's segment, and for each length of run the places of its last words and its buckets.

    Words that belong to the segment before count in neither.
    """
    if not _shifts:
        _shifts.append(Shifts())
    raw = np.frombuffer(b" ".join([p[1] for p in part]) + b" ", np.uint8)
    word = raw != 32
    end = np.zeros(len(raw), bool)
    end[1:] = word[:-1] & ~word[1:]
    kept = raw[word | end]
    ends = np.flatnonzero(kept == 32) + 1
    bounds = np.cumsum([len(p[1]) + 1 for p in part])
    upto = np.searchsorted(np.flatnonzero(end), bounds)
    count = np.diff(upto, prepend=0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    distinct = coded.dictionary.to_pylist()  # each with the blank after it
    which = coded.indices.to_numpy()
    alone = np.fromiter((zlib.crc32(w[:-1]) for w in distinct), np.uint32, len(distinct))[which]
    joined = np.fromiter((zlib.crc32(w[:-1], zlib.crc32(b" ")) for w in distinct), np.uint32, len(distinct))[which]
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))[which]
    owner = np.repeat(np.arange(len(part)), count)
    nth = np.arange(len(owner)) - np.repeat(upto - count, count)
    context = np.array([p[2] for p in part])
    own = nth >= context[owner]
    runs, crc = [], alone
    for length in range(1, LONGEST + 1):
        if length > 1:
            crc = _shifts[0](np.concatenate([crc[:1], crc[:-1]]), size) ^ joined
        last = np.flatnonzero(own & (nth >= length - 1))
        runs.append((last, (crc[last] % np.uint32(buckets)).astype(np.int64)))
    return count - context, owner, runs


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in segments(batch.column(0).cast(pa.binary()).to_pylist()):
                for _, bucket in features(part, buckets)[2]:
                    total += np.bincount(bucket, minlength=buckets)
            give_back_memory()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return pick(docs, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket, a thousand times the logarithm of the target's share over the corpus's, each smoothed by one a bucket, rounded down."""
    sides = []
    for side in (target, corpus):
        counts = np.zeros(buckets, np.int64)
        for row in side.collect():  # a row a bucket
            counts[row.bucket] = row.n
        sides.append(counts)
    t, s = sides
    whole = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * whole[0] / ((float(b) + 1) * whole[1]))) for a, b in zip(t.tolist(), s.tolist())], np.int64)


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's words, features, weight and score."""
    small_batches(docs.sparkSession)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, many, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for part in segments(batch.column(1).cast(pa.binary()).to_pylist()):
                count, owner, runs = features(part, buckets)
                place = np.array([p[0] for p in part])
                np.add.at(words, place, count)
                for last, bucket in runs:
                    ends = np.searchsorted(last, np.searchsorted(owner, np.arange(len(part) + 1)))
                    running = np.concatenate([[0], np.cumsum(gain[bucket])])
                    np.add.at(weight, place, np.diff(running[ends]))
                    np.add.at(many, place, np.diff(ends))
            told = [f"{seed}:{'' if i is None else i}".encode() for i in batch.column(0).to_pylist()]
            h = np.array([int(sha256(x).hexdigest()[:8], 16) for x in told], np.float64)
            score = weight + np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, many, weight, score))], [x.split()[0] for x in _SCORED.split(", ")])
            give_back_memory()

    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return plain.withColumn("doc_id", plain.doc_id.cast("long")).mapInArrow(run, _SCORED)


def least_drawn(scores: DataFrame, draws: int) -> int:
    """The greatest score that at least ``draws`` rows reach."""
    low, high, above = *scores.agg(F.min("score"), F.max("score")).first(), 0
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        held = scores.where(F.col("score").between(low, high)).groupBy(F.expr(f"(score - {low}L) div {width}L").alias("range")).count()
        for row in sorted(held.collect(), reverse=True):  # 4,096 rows at most
            if above + row["count"] >= draws:
                low, high = low + row.range * width, min(high, low + (row.range + 1) * width - 1)
                break
            above += row["count"]
    return low


Record = tuple[int, int, int]  # less the score, id, row


class Run:
    """A sorted run of records on file, a block of them in memory."""

    def __init__(self, source, first: int, end: int, block: int):
        self.source, self.at, self.end, self.size = source, first, end, block
        self._load()

    def _load(self) -> None:
        many = min(self.size, self.end - self.at)
        self.block = np.frombuffer(self.source.read_at(24 * many, 24 * self.at), np.int64).reshape(-1, 3) if many else np.zeros((0, 3), np.int64)
        self.at += many
        self.next = 0
        self.head: Record | None = tuple(self.block[0].tolist()) if many else None

    def take(self, limit: Record | None, most: int) -> np.ndarray:
        """Records of the block from the head on that come before ``limit``, at most so many."""
        low, high = self.next, len(self.block)
        if limit is not None:
            for k in range(3):
                column = self.block[low:high, k]
                left, right = np.searchsorted(column, limit[k], "left"), np.searchsorted(column, limit[k], "right")
                low, high = low + int(left), low + int(right)
            high = low
        found = self.block[self.next : min(high, self.next + most)]
        self.next += len(found)
        if self.next == len(self.block):
            self._load()
        else:
            self.head = tuple(self.block[self.next].tolist())
        return found


class Tournament:
    """A tree of losers over runs: the winner has the least head, and each inner node the run that lost there."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        k = len(runs)
        self.losers = [0] * k
        won = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (b, a) if self._before(b, a) else (a, b)
        self.winner = won[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head, self.runs[b].head
        return x is not None and (y is None or x < y)

    def merged(self, draws: int) -> Iterator[np.ndarray]:
        """The least ``draws`` records, in order; what comes after is not read."""
        while draws:
            path, node = [], (len(self.runs) + self.winner) // 2
            while node:
                path.append(node)
                node //= 2
            heads = [h for h in (self.runs[self.losers[n]].head for n in path) if h is not None]
            found = self.runs[self.winner].take(min(heads) if heads else None, draws)
            yield found
            draws -= len(found)
            for node in path:
                if self._before(self.losers[node], self.winner):
                    self.losers[node], self.winner = self.winner, self.losers[node]


_SLICES = "slice long, path string, many long, starts array<long>"


def sliced(runs: DataFrame, folder: str) -> DataFrame:
    """Write (score, doc_id, row) by slices of the order, run after run; a row for each slice that has any."""
    spark = runs.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            many = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(many, run)), pa.array(np.arange(at, at + many))], ["score", "doc_id", "row", "run", "at"])
            at += many

    def spooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, path, out, many, last, starts = task.partitionId(), "", None, 0, -1, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{folder}/slice-{part:06d}-{task.taskAttemptId()}.runs"
                out = open_output(path)
            score, doc_id, row, run, _ = batch.columns
            records = np.stack([-score.to_numpy(), doc_id.fill_null(_LAST).to_numpy(), row.to_numpy()], 1)
            out.write(np.ascontiguousarray(records))
            of = run.to_numpy()
            starts += (many + np.flatnonzero(np.diff(of, prepend=last))).tolist()
            many, last = many + len(of), int(of[-1])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"slice": pa.array([part], pa.int64()), "path": [path], "many": pa.array([many], pa.int64()), "starts": pa.array([starts], pa.list_(pa.int64()))})

    small_batches(spark, rows=65_536)
    ordered = runs.select("score", "doc_id", "row").sortWithinPartitions(*order)
    dealt = ordered.mapInArrow(numbered, "score long, doc_id long, row long, run long, at long").repartitionByRange(partitions(spark), *order)
    return written(dealt.sortWithinPartitions("run", "at").mapInArrow(spooled, _SLICES), "slices")


def ranked(spark: SparkSession, slices: DataFrame, draws: int, held: int = HELD) -> DataFrame:
    """(row, rank) of the ``draws`` first records of all slices."""
    before, plan = 0, []
    for part, many in sorted((r.slice, r.many) for r in slices.select("slice", "many").collect()):  # a row for each slice
        if before < draws:
            plan.append((part, before, min(many, draws - before)))
        before += many
    plan = spark.createDataFrame(plan, "slice long, base long, wanted long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                ends = [*job["starts"][1:], job["many"]]
                with open_input(job["path"]) as source:
                    block = max(1, held // len(ends))
                    rank = job["base"] + 1
                    for found in Tournament([Run(source, a, z, block) for a, z in zip(job["starts"], ends)]).merged(job["wanted"]):
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 2]), pa.array(np.arange(rank, rank + len(found)))], ["row", "rank"])
                        rank += len(found)

    return slices.join(F.broadcast(plan), "slice").repartition(partitions(spark), "slice").mapInArrow(run, "row long, rank long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``rank`` is null where it isn't drawn.

    ``percent`` of the documents with ``least_words`` words or more are drawn,
    rounded down: the highest scores, ties to the smaller id.  A null text has no
    words, no feature and weight 0; a null id is the last of a tie, and its
    noise is that of the empty id.  Rows that share id and score are drawn in
    order of their place in the table, each for itself.  An empty target only
    smooths; an empty table gives no row.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent is from 0 to 100")
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets), buckets)
    rows = written(scored(docs, gain, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "scored")
    plain = ["doc_id", "n_features", "weight", "score"]
    fit = F.col("n_words") >= least_words
    draws = rows.where(fit).count() * percent // 100
    if not draws:
        return rows.select(*plain, F.lit(None).cast("long").alias("rank"))
    reach = fit & (F.col("score") >= least_drawn(rows.where(fit), draws))
    drawn = written(ranked(spark, sliced(rows.where(reach), fresh(spark, "runs")), draws), "ranks")
    found = rows.where(reach).join(drawn, "row", "left").select(*plain, "rank")
    return found.unionByName(rows.where(~reach).select(*plain, F.lit(None).cast("long").alias("rank")))
