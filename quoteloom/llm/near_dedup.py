"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Equal fingerprints are one node.  Two fingerprints that differ in at most r bits
agree on at least b - r of b bit blocks, so nodes are dealt into shards by every
choice of b - r blocks: every link lies inside some shard, and no shard holds
more than a sliver of the corpus.  Each task builds the BK-trees of its shards
and searches them; a shard hands on one link for each member, to the smallest
member of its component there, never all pairs.  Links become components by star
contraction.  A tree of the whole corpus could not be broadcast and would visit
most of its nodes for each query, as distances of unrelated fingerprints crowd
around 32.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bk_tree import Forest, dense, settle
from .components import stars
from .similarity import signatures, similar_texts, text_key
from .simhash import fingerprints
from .store import free_name, join_one, partitions, pick, small_batches, suspected, written

#: Shards above this many members are cut by further blocks, then searched by elimination.
TREE_MEMBERS = 256
#: Members of one shard in one task, twice over where a larger shard is cut into pieces.
HOLD = 400_000


def blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n even slices of the given bit positions."""
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:])]


def masks_for(nodes: int, radius: int) -> list[int]:
    """Masks of block choices, with enough bits that shards of unrelated fingerprints stay small."""
    keep = 1
    while keep < 4 and nodes / 2 ** (64 * keep / (radius + keep)) > 8:
        keep += 1
    parts = blocks(list(range(64)), radius + keep)
    return [sum(c) for c in combinations(parts, keep)]


def shard_links(shard: np.ndarray, values: np.ndarray, radius: int, fixed: np.ndarray, depth: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect what is connected within each shard.

    ``fixed`` has, by item, the bits on which its shard agrees.
    """
    order = np.argsort(shard, kind="stable")
    shard, values, fixed = shard[order], values[order], fixed[order]
    new = np.ones(len(shard), bool)
    new[1:] = shard[1:] != shard[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(shard)))[np.cumsum(new) - 1]
    found = []
    small = np.flatnonzero((size > 1) & (size <= TREE_MEMBERS))
    if len(small):
        label = settle(len(small), Forest(shard[small], values[small]).links(radius))
        moved = np.flatnonzero(label != np.arange(len(small)))
        found.append((small[moved], small[label[moved]]))
    large = np.flatnonzero(size > TREE_MEMBERS)
    if len(large) and depth < 2:
        subs, member, sub_fixed = [], [], []
        for mask in np.unique(fixed[large]):
            own = large[fixed[large] == mask]
            free = [b for b in range(64) if not int(mask) >> b & 1]
            for i, m in enumerate(blocks(free, radius + 1)):
                part = (values[own] & np.uint64(m)).astype(np.uint64)
                key = np.unique(np.stack([shard[own].astype(np.uint64), part], 1), axis=0, return_inverse=True)[1].reshape(-1)
                subs.append(key + (len(subs) << 40))
                member.append(own)
                sub_fixed.append(np.full(len(own), mask | np.uint64(m)))
        member = np.concatenate(member)
        deeper = shard_links(np.concatenate(subs), values[member], radius, np.concatenate(sub_fixed), depth + 1)
        found += [(member[a], member[b]) for a, b in deeper]
    elif len(large):
        for s in np.unique(shard[large]):
            own = large[shard[large] == s]
            label = dense(values[own], radius)
            moved = np.flatnonzero(label != np.arange(len(own)))
            found.append((own[moved], own[label[moved]]))
    return [(order[a], order[b]) for a, b in found]


def near_links(nodes: DataFrame, count: int, radius: int = 4, hold: int = HOLD) -> DataFrame:
    """(u, v), u > v: links that connect every pair of distinct fingerprints at most ``radius`` apart.

    A shard of more than ``hold`` members is cut into pieces of about that many
    by hash, and every two pieces meet in a task of their own, so that no task
    holds more than two.  Pairs of pieces grow with the square of such a shard
    (a group of 5 million distinct near copies is 10 pieces and 55 tasks).
    """
    masks = masks_for(count, radius)
    signed = np.array(masks, np.uint64).view(np.int64).tolist()

    def search(keys: np.ndarray, which: np.ndarray, pair: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        _, shard = np.unique(np.stack([which.astype(np.uint64), keys, pair.astype(np.uint64)], 1), axis=0, return_inverse=True)
        pairs = shard_links(shard.reshape(-1), values, radius, np.array(masks, np.uint64)[which])
        a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        a, b = values[a].view(np.int64), values[b].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(4)]))
            rows += batch.num_rows
            if rows >= hold:
                whole = np.concatenate(held, 1)
                last = (whole[:3] == whole[:3, -1:]).all(axis=0)
                if not last.all():
                    yield search(whole[1, ~last], whole[0, ~last].astype(np.int64), whole[2, ~last], whole[3, ~last])
                    whole = whole[:, last]
                held, rows = [whole], (whole.shape[1] if whole.shape[1] < hold else 0)
        if held and (whole := np.concatenate(held, 1)).size:
            yield search(whole[1], whole[0].astype(np.int64), whole[2], whole[3])

    dealt = nodes.select(F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("which", "mask"), "fp").select(
        F.col("which").cast("long"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    if count <= hold:  # no shard can be larger
        dealt = dealt.select("which", "key", F.lit(0).cast("long").alias("pair"), "fp")
    else:
        large = dealt.groupBy("which", "key").agg(F.count("*").alias("n")).where(F.col("n") > hold)
        large = large.select("which", "key", F.ceil(F.col("n") / hold).alias("pieces"))
        # at most one in ``hold`` of the rows dealt
        dealt = dealt.join(F.broadcast(written(large, "large-shards")), ["which", "key"], "left")
        pieces = F.coalesce("pieces", F.lit(1).cast("long"))
        own = F.pmod(F.xxhash64("fp"), pieces)
        pair = F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda other: F.least(own, other) * pieces + F.greatest(own, other))
        dealt = dealt.select("which", "key", F.explode(pair).alias("pair"), "fp")
    n = partitions(nodes.sparkSession)
    return dealt.repartition(n, "which", "key", "pair").sortWithinPartitions("which", "key", "pair").mapInArrow(run, "u long, v long").where("u > v")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that links reach.

    Null or wordless texts have fingerprint 0 and link like any other.  A null
    doc_id never is a component's id unless all its members' are null.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    star = stars(near_links(nodes, count, radius))
    named = components_of(nodes.withColumnRenamed("fp", "node"), star, count).withColumnRenamed("node", "fp")
    return join_one(rows, written(named, "named"), "fp", "n", total).select("doc_id", "fp", "component_id")


def components_of(nodes: DataFrame, star: DataFrame, count: int) -> DataFrame:
    """``nodes`` (node, least, n and more) with component_id, the smallest ``least`` of those that ``star`` joins."""
    labelled = nodes.join(star, nodes.node == star.u, "left").drop("u").withColumn("label", F.coalesce("v", "node")).drop("v")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return join_one(labelled, least, "label", "members", count).drop("label", "least")


def fingerprint_clusters(nodes: DataFrame, radius: int) -> DataFrame:
    """(cluster, node) of those ``nodes`` (node, fp) whose fingerprint is within ``radius`` of another's, or the same."""
    prints = written(nodes.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    star = stars(near_links(prints, prints.count(), radius))
    linked = star.select("u", "v").union(star.select("v", "v").distinct())
    cluster = prints.join(linked, prints.fp == linked.u, "left").where("u is not null or n > 1").select("fp", F.coalesce("v", "fp").alias("cluster"), "n")
    return join_one(nodes.select("node", "fp"), cluster, "fp", "n", nodes.count()).select("cluster", "node")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Of each component of similar texts the document of the smallest id, all columns as they are; rows without id stay.

    Texts whose fingerprints the trees link within ``radius`` are candidates, and
    so are those that share a band of least hashes, as edits that leave this much
    flip more bits than trees can search.  Candidates are linked where their sets
    of word shingles have at least this Jaccard similarity.  Rows go by id and
    text: where an id occurs with several texts, each is judged by its own.
    """
    small_batches(docs.sparkSession)
    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    distinct = signatures(plain, shingle_words).groupBy("name").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.count("*").alias("n"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    clusters = written(fingerprint_clusters(nodes, radius), "clusters")
    star = stars(similar_texts(plain, nodes, shingle_words, similarity, clusters=clusters))
    named = written(components_of(nodes.drop("keys", "fp"), star, count).drop("node"), "named")
    rows = plain.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("name"))
    found = join_one(rows, named, "name", "n", total)
    gone_id, gone_text = free_name(docs, "gone_id"), free_name(docs, "gone_text")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id), F.col("name").alias(gone_text)).distinct()
    gone = written(gone, "near-copies")
    own_id = F.col(f"`{id_col}`").cast("long")
    clear, others = suspected(docs, own_id, gone.select(gone_id))
    same = (own_id == F.col(gone_id)) & (text_key(F.col(f"`{text_col}`")) == F.col(gone_text))
    return clear.union(others.join(gone, same, "left_anti"))
