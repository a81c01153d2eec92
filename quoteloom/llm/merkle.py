"""Merkle manifest of a dataset: a proof for every row, folded again from what a copy holds.

A row's leaf is a digest of its columns; the leaves of a group, in order of id,
are folded ``fanout`` at a time into the group's root, and the groups' roots,
in order of the groups, into the root of all.  Leaves are made in the JVM; only
digests travel.  They are put in order by ranges, numbered by the sums of
ranges, and gathered in *blocks*: aligned runs of ``fanout ** height`` nodes,
each the leaves of one node that many levels up.  A block is a contiguous
matrix of hexadecimal digests; its levels are hashed by reshaping rows, and the
siblings of all its leaves are found by index arithmetic.  The tops of blocks
are the nodes of the next blocks, so a group of any size is spread over tasks
and no task holds more than one block.

Edge cases: a null value has a digest of its own, unlike that of any text.
Null groups come first and form a group; null ids come first in their group.
Rows that are equal in all columns have a place, and a proof, each.  An empty
table has no root and no row.  Ids must be whole numbers, or casting stops.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions, small_batches, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes folded into one, and levels of a block: 2,187 leaves, some 300 kB with what goes with them.
FANOUT, HEIGHT = 3, 7
HEX = 64


def leaf_of(values: list[Column]) -> Column:
    """Digest of values, each with its length in bytes before it; ``-`` where it is null."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, the place in the order of its ``tree``, and ``n``, the tree's rows.

    Rows are sorted by ranges of (tree, order); a row for each tree of each range
    carries how many rows stand before.
    """
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    ordered = written(ordered.withColumn("row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("row", 33)
    runs = ordered.groupBy(part.alias("part"), F.col(tree).alias("of")).agg(F.min("row").alias("first"), F.count("*").alias("many"))
    own = Window.partitionBy("of")
    before = F.sum("many").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "of", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("many").over(own).alias("n"))
    runs = written(runs, "places")
    found = ordered.join(runs, (part == runs.part) & ordered[tree].eqNullSafe(runs.of))
    return found.select(*rows.columns, (F.col("row") + F.col("shift")).alias("at"), "n")


def matrix(digests: pa.Array) -> np.ndarray:
    """A column of hexadecimal digests as rows of bytes, without copying."""
    digests = digests.cast(pa.string())
    first = np.frombuffer(digests.buffers()[1], np.int32)[digests.offset] if len(digests) else 0
    return np.frombuffer(digests.buffers()[2], np.uint8, HEX * len(digests), int(first)).reshape(-1, HEX) if len(digests) else np.zeros((0, HEX), np.uint8)


def strings(rows: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(rows).view(f"S{HEX}").ravel().astype(str), pa.string())


def hashed(runs: list) -> np.ndarray:
    return np.frombuffer("".join([sha256(r).hexdigest() for r in runs]).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, fanout: int, height: int, alone: bool) -> list[np.ndarray]:
    """Matrices from the leaves up: to the one top of ``height`` levels, or, ``alone``, until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= height:
        now = out[-1]
        whole = len(now) // fanout * fanout
        runs = list(now[:whole].reshape(-1, fanout * HEX))
        if whole < len(now):
            runs.append(now[whole:].reshape(-1))
        out.append(hashed(runs))
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its siblings, level by level and left to right, and which of them there are."""
    n, steps = len(tree[0]), len(tree) - 1
    found = np.zeros((n, steps * (fanout - 1), HEX), np.uint8)
    there = np.zeros((n, steps * (fanout - 1)), bool)
    node = np.arange(n)
    for step, now in enumerate(tree[:-1]):
        others = (node // fanout * fanout)[:, None] + np.arange(fanout - 1)
        others += others >= node[:, None]
        own = slice(step * (fanout - 1), (step + 1) * (fanout - 1))
        there[:, own] = others < len(now)
        found[:, own] = now[np.minimum(others, len(now) - 1)]
        node = node // fanout
    return found, there


def folded(tree: list[np.ndarray], leaves: np.ndarray, fanout: int) -> np.ndarray:
    """What each of ``leaves``, in the place of the tree's own, makes of the top."""
    now, node, rows = leaves, np.arange(len(leaves)), np.arange(len(leaves))
    for level in tree[:-1]:
        first = node // fanout * fanout
        runs = level[np.minimum(first[:, None] + np.arange(fanout), len(level) - 1)]
        runs[rows, node - first] = now
        size = HEX * np.minimum(fanout, len(level) - first)
        now = hashed([run[:k] for run, k in zip(runs.reshape(len(rows), -1), size.tolist())])
        node = node // fanout
    return now


def paths(tree: list[np.ndarray], fanout: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each leaf and level, what stands left and right of its node, as text."""
    left: list[list[str]] = [[] for _ in tree[0]]
    right: list[list[str]] = [[] for _ in tree[0]]
    for step, now in enumerate(tree[:-1]):
        told = [bytes(row).decode() for row in now]
        for leaf in range(len(tree[0])):
            node = leaf // fanout**step
            first = node // fanout * fanout
            left[leaf].append("".join(told[first:node]))
            right[leaf].append("".join(told[node + 1 : first + fanout]))
    return left, right


@dataclass(frozen=True)
class Shape:
    """Nodes folded into one, and levels of a block."""

    fanout: int = FANOUT
    height: int = HEIGHT

    def __post_init__(self) -> None:
        if self.fanout < 2 or self.height < 1:
            raise ValueError("nodes are folded two at a time at least, and a block has a level")

    @property
    def size(self) -> int:
        return self.fanout**self.height

    def tree_of(self, members: pa.Array, n: int) -> list[np.ndarray]:
        """Levels of a block of a tree of ``n`` nodes."""
        return levels(matrix(members.field("digest")), self.fanout, self.height, n <= self.size)


class Forest:
    """Trees over nodes (tree, at, n, digest, and other columns), in blocks, one table of blocks for each height."""

    def __init__(self, nodes: DataFrame, shape: Shape, kept: tuple[str, ...] = ()):
        self.shape = shape
        self.blocks: list[DataFrame] = []
        roots = []
        while True:
            self.blocks.append(written(self._grouped(nodes, kept), "blocks"))
            tops = written(self._tops(self.blocks[-1]), "tops")
            roots.append(tops.where("n = 1").select("tree", "digest"))
            nodes, kept = tops.where("n > 1"), ()
            if nodes.isEmpty():
                break
        self.roots = roots[0]
        for more in roots[1:]:
            self.roots = self.roots.unionByName(more)

    def _grouped(self, nodes: DataFrame, kept: tuple[str, ...]) -> DataFrame:
        block = F.expr(f"at div {self.shape.size}").alias("block")
        member = F.struct("at", "digest", *kept)
        return nodes.groupBy("tree", block, "n").agg(F.sort_array(F.collect_list(member)).alias("members"))

    def _tops(self, blocks: DataFrame) -> DataFrame:
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                many = zip(batch.column(3), batch.column(2).to_pylist())
                tops = [shape.tree_of(members.values, n)[-1] for members, n in many]
                n = pa.array([-(-x // shape.size) for x in batch.column(2).to_pylist()], pa.int64())
                digest = strings(np.concatenate(tops)) if tops else pa.array([], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, digest], ["tree", "at", "n", "digest"])

        small_batches(blocks.sparkSession)
        return blocks.select("tree", "block", "n", "members").mapInArrow(run, "tree string, at long, n long, digest string")

    def below(self, above: DataFrame) -> DataFrame:
        """The lowest blocks with ``left`` and ``right`` of their tops' ways up, and ``above``'s other columns, by tree.

        ``above`` has (tree, left, right, ...): the ways up from the trees' own roots.
        """
        carried = [c for c in above.columns if c not in ("tree", "left", "right")]
        parents: DataFrame | None = None
        for height in range(len(self.blocks) - 1, -1, -1):
            blocks = self.blocks[height]
            roots = above.withColumnRenamed("tree", "of")
            found = blocks.where(f"n <= {self.shape.size}").join(roots, blocks.tree.eqNullSafe(F.col("of"))).drop("of")
            if parents is not None:
                more = blocks.where(f"n > {self.shape.size}").join(parents, blocks.tree.eqNullSafe(F.col("of")) & (blocks.block == F.col("place")))
                found = found.unionByName(more.drop("of", "place"))
            if height:
                parents = written(self.ways(found, carried, {}), "ways").withColumnsRenamed({"tree": "of", "at": "place"})
        return found

    def ways(self, blocks: DataFrame, carried: list[str], fields: dict[str, str]) -> DataFrame:
        """The ways up from each member of ``blocks``: tree, at, left, right, the members' ``fields`` and what is ``carried``."""
        shape, kinds = self.shape, dict(blocks.dtypes)
        names = ["tree", "at", "left", "right", *fields, *carried]
        types = ["string", "long", "array<string>", "array<string>", *fields.values(), *[kinds[c] for c in carried]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    tree, n, members, left, right, *rest = (column[row] for column in batch.columns)
                    own = paths(shape.tree_of(members.values, n.as_py()), shape.fanout)
                    ways = [pa.array([x + side.as_py() for x in one], pa.list_(pa.string())) for one, side in zip(own, (left, right))]
                    many = len(members.values)
                    columns = [pa.array([tree.as_py()] * many, pa.string()), members.values.field("at"), *ways, *map(members.values.field, fields)]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x.as_py()] * many, x.type) for x in rest]], names)

        small_batches(blocks.sparkSession)
        schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
        return blocks.select("tree", "n", "members", "left", "right", *carried).mapInArrow(run, schema)

    def proofs(self, blocks: DataFrame, root: str) -> DataFrame:
        """The manifest's rows, from blocks of leaves with the ways up from their tops."""
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    n, members, left, right, subroot = (column[row].as_py() if i != 1 else column[row].values for i, column in enumerate(batch.columns))
                    tree = shape.tree_of(members, n)
                    found, there = siblings(tree, shape.fanout)
                    above = "".join(x + y for x, y in zip(left, right)).encode()
                    proofs = [sha256((own if ok.all() else own[ok]).tobytes() + above).hexdigest() for own, ok in zip(found, there)]
                    other, leaf = members.field("other"), members.field("digest")
                    now = folded(tree, matrix(pc.coalesce(other, leaf)), shape.fanout)
                    tops = [bytes(x).decode() for x in now]
                    for x, y in zip(left, right):
                        tops = [sha256(f"{x}{top}{y}".encode()).hexdigest() for top in tops]
                    same = [top == root for top in tops]
                    rest = [pa.array([x] * len(leaf)) for x in (subroot, root)]
                    yield pa.RecordBatch.from_arrays([members.field("doc_id"), leaf, *rest, pa.array(proofs), pa.array(tops), pa.array(same)], [x.split()[0] for x in _MANIFEST.split(", ")])

        small_batches(blocks.sparkSession)
        return blocks.select("n", "members", "left", "right", "subroot").mapInArrow(run, _MANIFEST)


_MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def merkle_manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "source",
    changed: tuple[Column, dict[str, Column]] | None = None,
    shape: Shape = Shape(),
) -> DataFrame:
    """A row for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` tells of the copy that is verified: where its condition holds, the
    given columns have the given values there.  ``folded_root`` is recomputed from
    the copy's leaf and the siblings of the manifest; ``verified`` says whether that
    is the root.
    """
    spark = docs.sparkSession
    own = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_of(list(own.values()))
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed[0], leaf_of([changed[1].get(c, own[c]) for c in columns]))
    leaves = docs.select(
        F.col(f"`{group_col}`").cast("string").alias("tree"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        leaf.alias("digest"),
        other.alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed = numbered(written(leaves, "leaves"), "tree", "doc_id", "digest", "tie").drop("tie")
    groups = Forest(placed, shape, ("doc_id", "other"))

    subroots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = Forest(numbered(subroots, "tree", "name"), shape, ("name",))
    root = sources.roots.select("digest").collect()
    if not root:
        return spark.createDataFrame([], _MANIFEST)
    none = F.array().cast("array<string>")
    top = spark.createDataFrame([("",)], "tree string").select("tree", none.alias("left"), none.alias("right"))
    above = sources.ways(sources.below(top), [], {"name": "string", "digest": "string"})
    above = written(above.select(F.col("name").alias("tree"), "left", "right", F.col("digest").alias("subroot")), "subroots")
    return groups.proofs(groups.below(above), root[0].digest)
