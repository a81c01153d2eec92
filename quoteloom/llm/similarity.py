"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least some bound.

Candidates are told in two ways.  Texts whose SimHash fingerprints are linked, by
the trees of ``near_dedup``, are a bucket.  Edits that leave four fifths of the
shingles flip up to 13 of 64 bits and more, and at that radius shards by agreeing
bit blocks hold much of the corpus; so texts that agree on the ``ROWS`` least hashes
of one of ``BANDS`` bands are buckets too, and a pair at similarity 0.8 has no such
band with a chance of 5e-8.  Every candidate is confirmed on its whole set.  Within a
bucket a text, once reached, is compared with those not reached yet and leaves, so
that a cluster is gone after a few comparisons and pairs are never listed; a bucket
of the same members as another is looked at once.  Buckets that share members go to
one task together, so that a text's shingles are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import stars
from .simhash import SEED, majority, shingle_hashes
from .store import drop, join_one, partitions, small_batches, written
from .tokens import kept, ragged

BANDS, ROWS = 32, 4
#: Of a filter by hash that keeps most texts that have no candidate out of the exchange; it lets others pass, never the reverse.
SLOTS = 1 << 23
#: Shingles of one bucket in one task, twice over where a larger bucket is cut into pieces.
HOLD_BYTES = 64_000_000
#: Shingles of buckets that share members, in one task together; each bucket of more goes for itself.
GROUP_BYTES = 16_000_000
#: Members of buckets in one task while buckets with the same members are looked for; and what stands for the size of one that has more.
HOLD_MEMBERS, CROWD = 2_000_000, 1 << 60
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64)
_FLIP, _TIMES, _ROW_TIMES = _MIX[0], _MIX[1] | np.uint64(1), _MIX[2] | np.uint64(1)


def shingle_set(text: bytes | None, shingle_words: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of a text's word shingles; a shorter text is one shingle, a wordless one has none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle_words)]))


def band_keys(shingles: np.ndarray, step: int = 1024) -> np.ndarray:
    """A key for each band, of the least hashes of its rows."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), step):
        np.minimum(least, ((shingles[at : at + step, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * _ROW_TIMES
    keys = (mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64)


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(member, least member of its component) for whatever is connected by pairs of at least ``similarity``."""
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    found, left = [], np.arange(len(sets))
    while len(left):
        start, left = int(left[0]), left[1:]
        front = [start]
        while front and len(left):
            one = front.pop()
            alike = left[np.minimum(size[left], size[one]) + 1e-9 >= similarity * np.maximum(size[left], size[one])]
            own = code[first[one] : first[one] + size[one]]
            mark[own] = True
            run = np.concatenate([[0], np.cumsum(mark[code[ragged(first[alike], size[alike])]])])
            mark[own] = False
            ends = np.cumsum(size[alike])
            shared = run[ends] - run[ends - size[alike]]
            reached = alike[shared + 1e-9 >= similarity * (size[alike] + size[one] - shared)]
            if len(reached):
                found += [(int(r), start) for r in reached]
                front.extend(reached.tolist())
                left = np.setdiff1d(left, reached, assume_unique=True)
    return found


def _like_first(sets: list[np.ndarray], similarity: float) -> list[int]:
    """Which sets are similar to the first."""
    first, found = sets[0], []
    for i, other in enumerate(sets[1:], 1):
        if min(len(first), len(other)) + 1e-9 >= similarity * max(len(first), len(other)):
            shared = len(np.intersect1d(first, other, assume_unique=True))
            if shared + 1e-9 >= similarity * (len(first) + len(other) - shared):
                found.append(i)
    return found


def text_key(text: Column) -> Column:
    """What names a text; null is the empty text."""
    return F.md5(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, name, keys, fp) of every row of doc_id, text; fp is the SimHash fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("similarity")
        for batch in batches:
            keys, prints = [np.zeros(0, np.int64)], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = list(shingle_hashes(text, shingle_words))
                keys.append(band_keys(np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))))
                prints.append(majority(hashes))
            offsets = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * BANDS)
            columns = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "name", "keys", "fp"])

    named = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("name"), "text")
    return named.mapInArrow(run, "doc_id long, name string, keys array<long>, fp long")


def similar_texts(
    docs: DataFrame,
    nodes: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    hold_bytes: int = HOLD_BYTES,
    hold_members: int = HOLD_MEMBERS,
    group_bytes: int = GROUP_BYTES,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """(u, v), u > v: links between ``nodes`` (node, name, keys) that connect all texts of at least ``similarity``.

    ``clusters`` (cluster, node), if given, are candidates too, as buckets of their own.
    Buckets that share members, directly or by others, are a group; groups whose sets
    take up to ``group_bytes`` are looked at by one task each.  Beyond that a bucket whose sets take more than ``hold_bytes`` is cut into pieces of about
    that size: each meets the bucket's least node, and then the members that it
    does not reach.  No task holds more than two pieces, and no pair is lost.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)

    def told(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Members of whole buckets of two or more, with their bucket's size and two hashes of who is in it."""
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edges, len(key)))
        mixed = (node.view(np.uint64) + np.uint64(1)) * _TIMES[0]
        mixed = ((mixed ^ (mixed >> np.uint64(31)))[:, None] * _TIMES[1:3]) ^ _FLIP[1:3]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _TIMES[3:5]
        digest = np.add.reduceat(mixed, edges).view(np.int64)
        bucket = np.repeat(np.arange(len(edges)), size)
        rows = np.flatnonzero(size[bucket] > 1)
        at = bucket[rows]
        yield from marked(key[rows], node[rows], size[at], digest[at, 0], digest[at, 1])

    def marked(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], ["key", "node", "n", "s", "x"])

    def crowd_of(key: int, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.full(len(node), key)
        yield from marked(same, node, np.full(len(node), CROWD), same, same)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, node, crowded = none, none, None
        for batch in batches:  # sorted by key
            keys, nodes_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if crowded is not None:
                end = int(np.searchsorted(keys, crowded, "right"))
                yield from crowd_of(crowded, nodes_[:end])
                if end == len(keys):
                    continue
                keys, nodes_, crowded = keys[end:], nodes_[end:], None
            key, node = np.concatenate([key, keys]), np.concatenate([node, nodes_])
            if len(key) >= hold_members:
                end = int(np.searchsorted(key, key[-1], "left"))
                if end:
                    yield from told(key[:end], node[:end])
                    key, node = key[end:], node[end:]
                else:  # too large to hold, so not compared with others as a whole
                    crowded = int(key[0])
                    yield from crowd_of(crowded, node)
                    key, node = none, none
        if len(key):
            yield from told(key, node)

    dealt = nodes.select(F.explode("keys").alias("key"), "node")
    if clusters is not None:
        dealt = dealt.union(clusters.select(F.xxhash64("cluster"), "node"))
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key")
    several = written(dealt.mapInArrow(shared, "key long, node long, n long, s long, x long"), "shared-keys")
    buckets = several.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")
    members = written(join_one(several.select("key", "node"), buckets, "key", "n", several.count()), "buckets")
    drop(several, spark)
    least = members.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n"))
    label = stars(join_one(members, least, "key", "n", members.count()).select(F.col("node").alias("u"), "v").where("u > v"))
    held = members.groupBy("node").agg(F.collect_list("key").alias("own"))  # a key for each band at most, and that of a cluster
    held = held.join(label, held.node == label.u, "left").select("node", "own", F.coalesce("v", "node").alias("group"))
    names = written(nodes.select("node", "name").join(held, "node"), "candidates")
    slot = F.pmod(F.xxhash64("name"), F.lit(SLOTS))
    some = np.zeros(SLOTS, bool)
    some[names.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True  # at most SLOTS rows
    some = spark.sparkContext.broadcast(np.packbits(some))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("similarity")
        wanted = np.unpackbits(some.value).astype(bool)
        for batch in batches:
            own = batch.filter(pa.array(wanted[batch.column(2).to_numpy()]))
            sets = [shingle_set(t, shingle_words).tobytes() for t in own.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.binary())], ["name", "shingles"])

    texts = docs.select(text_key(F.col("text")).alias("name"), "text").withColumn("slot", slot)
    found = texts.mapInArrow(shingled, "name string, shingles binary").groupBy("name").agg(F.first("shingles").alias("shingles"))  # copies are one
    sets = written(found.join(names, "name").select("node", "own", "group", "shingles"), "shingles")

    sizes = sets.select("node", "group", (F.octet_length("shingles") + 64).alias("bytes"))
    crowded = sizes.groupBy("group").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > min(group_bytes, hold_bytes)).select("group")
    crowded = written(crowded, "large-groups")
    few = F.broadcast(crowded)  # at most one for each ``group_bytes`` of candidates' shingles
    grouped = _grouped(sets.join(few, "group", "left_anti"), n, similarity)
    if crowded.isEmpty():
        return grouped
    sets = written(sets.join(few, "group", "left_semi").select("node", "shingles"), "large-group-shingles")
    sizes = sets.select("node", (F.octet_length("shingles") + 64).alias("bytes"))
    members = written(members.join(sizes.select("node"), "node").select("key", "node"), "large-group-members")
    many = members.join(sizes, "node").groupBy("key").agg(F.sum("bytes").alias("bytes"), F.min("node").alias("pivot"))
    many = written(many.where(F.col("bytes") > hold_bytes).withColumn("pieces", F.ceil(F.col("bytes") / hold_bytes)), "large-buckets")
    large = F.broadcast(many.drop("bytes"))  # at most one for each ``hold_bytes`` of candidates' shingles
    small = members.join(F.broadcast(many.select("key")), "key", "left_anti")
    together = small.join(sets, "node").select("key", F.lit(0).cast("long").alias("pair"), "node", "shingles")
    found = grouped.union(_linked(together, n, similarity))
    if many.isEmpty():
        return found
    piece = F.pmod(F.xxhash64("node"), F.col("pieces"))
    crowd = written(members.join(large, "key").withColumn("piece", piece), "crowds")
    # every member meets the pivot of its bucket; most of a group of near copies ends there
    whole = crowd.join(sets, "node").select("key", "piece", "pieces", "pivot", "node", "shingles")
    pivots = whole.where("node = pivot").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("pair"), "node", "shingles")
    met = whole.where("node <> pivot").select("key", F.col("piece").alias("pair"), "node", "shingles")
    near = written(_linked(met.unionByName(pivots), n, similarity, pivot=True), "pivot-links")
    # what the pivot does not reach meets every member, piece by piece
    reached = near.select("key", F.col("u").alias("node"))
    rest = written(crowd.where("node <> pivot").join(reached, ["key", "node"], "left_anti").join(sizes, "node"), "unreached")
    parts = written(rest.groupBy("key").agg(F.ceil(F.sum("bytes") / hold_bytes).alias("parts")), "unreached-parts")
    parts = F.broadcast(parts)  # no more rows than large buckets
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    everyone = crowd.join(parts, "key").select("key", "node", "piece", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asked = rest.join(parts, "key").select("key", "node", part.alias("part"), "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    dealt = everyone.select("key", (F.col("piece") * F.col("parts") + F.col("part")).alias("pair"), "node")
    dealt = dealt.union(asked.select("key", (F.col("piece") * F.col("parts") + F.col("part")).alias("pair"), "node")).distinct()
    cross = _linked(dealt.join(sets, "node").select("key", "pair", "node", "shingles"), n, similarity)
    return found.union(near.select("u", "v")).union(cross)


def _grouped(sets: DataFrame, n: int, similarity: float) -> DataFrame:
    """(u, v) that connect what is similar within a bucket, of rows (group, node, own buckets, shingles), group by group."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            buckets: dict[int, list[int]] = {}
            for i, (_, own, _) in enumerate(held):
                for key in own:
                    buckets.setdefault(key, []).append(i)
            label, pairs = np.arange(len(held)), []
            for _, at in sorted(buckets.items()):
                if len(at) > 1 and len(set(label[at].tolist())) > 1:  # or else they are connected already
                    for a, b in similar_links([held[i][2] for i in at], similarity):
                        a, b = at[a], at[b]
                        pairs.append((held[a][0], held[b][0]))
                        if label[a] != label[b]:
                            label[label == label[a]] = label[b]
            return pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.int64()) for f in (max, min)], ["u", "v"])

        for batch in batches:
            for group, node, own, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now:
                    if len(held) > 1:
                        yield links()
                    now, held = group, []
                held.append((node, own, np.frombuffer(raw, np.uint64)))
        if len(held) > 1:
            yield links()

    dealt = sets.select("group", "node", "own", "shingles").repartition(n, "group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(confirm, "u long, v long")


def _linked(together: DataFrame, n: int, similarity: float, pivot: bool = False) -> DataFrame:
    """(u, v) that connect what is similar among the rows (node, shingles) of each key and pair.

    With ``pivot`` only (key, u, v) with the least node of each, which is in all
    of a key's pairs.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sets = None, [], []

        def links() -> pa.RecordBatch:
            pairs = [(0, i) for i in _like_first(sets, similarity)] if pivot else similar_links(sets, similarity) if len(held) > 1 else []
            pairs = [(held[a], held[b]) for a, b in pairs]
            u, v = (pa.array([f(p) for p in pairs], pa.int64()) for f in (max, min))
            if pivot:
                return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(pairs), pa.int64()), u, v], ["key", "u", "v"])
            return pa.RecordBatch.from_arrays([u, v], ["u", "v"])

        for batch in batches:
            for key, pair, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, pair) != now:
                    if held:
                        yield links()
                    now, held, sets = (key, pair), [], []
                held.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
        if held:
            yield links()

    dealt = together.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "node")
    return dealt.mapInArrow(confirm, "key long, u long, v long" if pivot else "u long, v long")
