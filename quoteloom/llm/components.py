"""Connected components of links between longs: star contraction, until what is left fits one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bk_tree import settle
from .store import drop, join_one, written

#: Links that one task settles at once, in some 50 MB; rounds of exchanges over so few cost many times more.
ONE_TASK = 500_000


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    found = join_one(both, least, "u", "n", 2 * many)
    return found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_one(edges, least, "u", "n", many).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([b.column(i).to_numpy() for i in range(2)]) for b in batches if b.num_rows]
    if not ends:
        return
    name, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
    at = at.reshape(2, -1)
    label = settle(len(name), [(at[0], at[1])])
    moved = np.flatnonzero(label != np.arange(len(name)))
    for a in range(0, len(moved), 100_000):
        some = moved[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(name[label[some]])], ["u", "v"])


def stars(edges: DataFrame, max_rounds: int = 100, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v): the smallest member v of u's component, for every u but the smallest itself.

    ``edges`` has columns u > v.  Both halves of a round are written to the shared
    folder, so lineage stays short and a lost executor costs half a round.  What
    has very many neighbours is met by broadcast, a thousand such at most, so
    that no task holds all links of a hub.  Up to ``one_task`` links, all there are
    or all that rounds leave, are settled by one task.
    """
    now = written(edges.select("u", "v").distinct(), "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            return now
        if state[0] <= one_task:
            return written(now.coalesce(1).mapInArrow(_settled, "u long, v long"), "links")
        large = written(_large_star(now, state[0]), "large-star")
        after = written(_small_star(large, state[0]), "links")
        new = _state(after)
        drop(now, now.sparkSession)
        drop(large, now.sparkSession)
        now = after
        if new == state:
            return now
        state = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
