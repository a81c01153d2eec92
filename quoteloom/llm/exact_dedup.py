"""Exact deduplication by a tree-merge of sorted digest runs.

Each partition turns its documents into a *run*: one record for each digest of
normalised text, ordered by digest, holding the best document so far (most code
points, then smallest id), how many rows share the digest, and a second hash of
the same text.  Runs meet in rounds: ``fan_in`` neighbouring runs are dealt, by
slice of the digest space, to one task, which streams over them in digest order
and keeps one record for each digest.  A group of copies of any size is thus one
record for each run from the first round on; the last round leaves one record
for each digest, spread over the slices.  At every level the second hash is
compared, so a digest collision stops the job instead of losing a document.

Edge cases: null text counts as empty; a null id sorts after every other;
rows repeated with id and text are all reported with the same ``keep_id``, and
``best_rows`` says how many rows tie for the place that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, join_one, partitions, pick, suspected, written
from .tokens import kept

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SLICE_DIGITS = 3
_RUN = "run long, slice string, digest string, less long, best_id long, rows long, best_rows long, check long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, points, digest, check) of every row: SHA-256 and a second hash of the normalised text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        pick(docs, id_col, text_col)
        .toDF("doc_id", "text")
        .select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("points"), F.translate(text, BLANKS, "").alias("bare"))
        .select("doc_id", "points", F.sha2("bare", 256).alias("digest"), F.xxhash64("bare").alias("check"))
    )


def _reduced(table: pa.Table) -> pa.Table:
    """One record for each digest of a table ordered by digest, less, best_id."""
    digest = table["digest"].combine_chunks()
    new = np.ones(len(digest), bool)
    new[1:] = pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    col = {c: table[c].to_numpy() for c in ("less", "rows", "best_rows", "check")}
    ids = table["best_id"].combine_chunks()
    known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    head = first[group]
    if (col["check"] != col["check"][head]).any():
        raise ValueError("two different texts share a digest")
    ties = (col["less"] == col["less"][head]) & (value == value[head]) & (known == known[head])
    out = table.take(pa.array(first))
    for name, values in (("rows", col["rows"]), ("best_rows", np.where(ties, col["best_rows"], 0))):
        out = out.set_column(out.column_names.index(name), name, pa.array(np.add.reduceat(values, first), pa.int64()))
    return out


def _streamed(batches: Iterator[pa.RecordBatch], run_of) -> Iterator[pa.RecordBatch]:
    """Merge records that arrive in order; the last digest of a batch waits for the next batch."""
    kept("merge")
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)  # without Spark's nullability
        merged = _reduced(pa.concat_tables([held, table]) if held is not None else table)
        held = merged.slice(merged.num_rows - 1)
        yield from run_of(merged.slice(0, merged.num_rows - 1)).to_batches()
    if held is not None:
        yield from run_of(held).to_batches()


def _first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId()

    def numbered(table: pa.Table) -> pa.Table:
        return table.set_column(0, "run", pa.array(np.full(table.num_rows, run), pa.int64()))

    return _streamed(batches, numbered)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _streamed(batches, lambda table: table)


def tree_merge(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """(digest, keep_id, group_size, best_rows), from the rows of :func:`digests`."""
    n = partitions(rows.sparkSession)
    order = ["slice", "digest", "less", F.col("best_id").asc_nulls_last()]
    runs = rows.select(
        F.lit(0).cast("long").alias("run"),
        F.substring("digest", 1, SLICE_DIGITS).alias("slice"),
        "digest",
        (-F.col("points")).alias("less"),
        F.col("doc_id").alias("best_id"),
        F.lit(1).cast("long").alias("rows"),
        F.lit(1).cast("long").alias("best_rows"),
        "check",
    )
    left = max(1, runs.rdd.getNumPartitions())
    runs = runs.sortWithinPartitions(*order).mapInArrow(_first_run, _RUN)
    while True:
        left = -(-left // fan_in)
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))
        runs = runs.repartition(n, "slice", "run").sortWithinPartitions("run", *order).mapInArrow(_merge, _RUN)
        if left == 1:
            break
    return runs.select("digest", F.col("best_id").alias("keep_id"), F.col("rows").alias("group_size"), "best_rows")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, points, best_rows.

    The digests are written once to the shared folder, as they are read both for
    the runs and to carry the result back to each document.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    winners = written(tree_merge(rows, fan_in), "winners").withColumn("n", F.col("group_size"))
    found = join_one(rows, winners, "digest", "n", rows.count())
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "points",
        "best_rows",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """The documents that stay, all columns as they are; of rows repeated with id and text, one.

    Texts stay where they are but for rows whose id is, or by its hash may be,
    that of a copy: only these are hashed again and matched by id and text.
    """
    found = exact_dedup(docs, id_col, text_col, fan_in)
    gone_id, gone_text, flat = (free_name(docs, n) for n in ("gone_id", "gone_text", "bare_text"))
    gone = found.where("not kept or best_rows > 1").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_text), "kept").distinct()
    gone = written(gone, "copies")
    own_id = F.col(f"`{id_col}`").cast("long")
    clear, others = suspected(docs, own_id, gone.select(gone_id))
    bare = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), BLANKS, "")
    same = own_id.eqNullSafe(F.col(gone_id)) & (F.sha2(bare, 256) == F.col(gone_text))
    left = others.join(gone.where("not kept").drop("kept"), same, "left_anti")
    repeated = gone.where("kept").drop("kept")
    if repeated.isEmpty():
        return clear.union(left)
    left = written(left, "suspected")
    once = left.join(repeated, same, "left_semi").withColumn(flat, bare).dropDuplicates([id_col, flat]).drop(flat)
    return clear.union(left.join(repeated, same, "left_anti")).union(once)
