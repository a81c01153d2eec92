"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are counted by encoded length.  For a context limit L, documents
longer than L and their tokens are suffix sums of that histogram, from which
follow the tokens that truncation to L keeps and drops, and the rank of L among
lengths.  The histogram has a row for each length that occurs; it is summed in
two steps, by ranges of 1,024 lengths and within each, so that no task holds it
all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import pick, small_batches, written
from .tokens import BYTE_BPE, encoder

RANGE = 1024


def lengths(docs: DataFrame, vocabulary: str = BYTE_BPE, text_col: str = "text") -> DataFrame:
    """(length, documents): the histogram of whole texts' token counts; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = encoder(vocabulary).encode_array(batch.column(0))
            length, many = np.unique(counts, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(many, pa.int64())], ["length", "n"])

    small_batches(docs.sparkSession)
    partial = pick(docs, text_col).toDF("text").mapInArrow(run, "length long, n long")
    return partial.groupBy("length").agg(F.sum("n").alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit, of the histogram's columns length and documents:

    documents_longer, tokens_longer, total documents and tokens, documents up to
    the limit (its rank, for quantiles), and the tokens that truncation to it
    keeps and drops.
    """
    counted = written(histogram.withColumn("tokens", F.col("length") * F.col("documents")), "lengths")
    ranged = counted.withColumn("range", F.floor(F.col("length") / RANGE).cast("long"))
    by_range = ranged.groupBy("range").agg(F.sum("documents").alias("range_documents"), F.sum("tokens").alias("range_tokens"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    above = by_range.select(
        "range",
        F.coalesce(F.sum("range_documents").over(after), F.lit(0)).alias("documents_above"),
        F.coalesce(F.sum("range_tokens").over(after), F.lit(0)).alias("tokens_above"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    total = counted.agg(F.sum("documents").alias("total_documents"), F.sum("tokens").alias("total_tokens"))
    longer = (
        ranged.join(above, "range")
        .withColumn("documents_longer", F.col("documents_above") + F.coalesce(F.sum("documents").over(within), F.lit(0)))
        .withColumn("tokens_longer", F.col("tokens_above") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .crossJoin(F.broadcast(total))  # one row
    )
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("documents_longer")
    return longer.select(
        F.col("length").alias("context_limit"),
        "documents",
        "documents_longer",
        (F.col("total_documents") - F.col("documents_longer")).alias("documents_within"),
        "tokens_longer",
        kept.alias("tokens_kept"),
        (F.col("total_tokens") - kept).alias("tokens_dropped"),
        "total_documents",
        "total_tokens",
    )


def kept_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, documents_longer, tokens_kept) at any limits, also between lengths that occur.

    Between two lengths nothing is added to the histogram, so the row of the
    greatest length within the limit, or else the totals, answers.
    """
    asked = sorted(set(limits))
    row = F.struct("documents_longer", "tokens_longer")
    best = [F.max_by(row, F.when(F.col("context_limit") <= x, F.col("context_limit"))).alias(f"_{i}") for i, x in enumerate(asked)]
    found = sums.agg(F.coalesce(F.max("total_documents"), F.lit(0)).alias("n"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("t"), *best)

    def answer(limit: int, at: str):
        longer = F.coalesce(F.col(f"{at}.documents_longer"), "n")
        kept = F.col("t") - F.coalesce(F.col(f"{at}.tokens_longer"), "t") + limit * longer
        return F.struct(F.lit(limit).cast("long").alias("context_limit"), longer.alias("documents_longer"), kept.alias("tokens_kept"))

    return found.select(F.inline(F.array(*[answer(x, f"_{i}") for i, x in enumerate(asked)])))


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """(quantile, length): the least length with at least that share of documents within it."""
    need = [F.greatest(F.ceil(F.lit(float(q)) * F.col("total_documents")), F.lit(1)) for q in at]
    least = [F.min(F.when(F.col("documents_within") >= n, F.col("context_limit"))).alias(f"_{i}") for i, n in enumerate(need)]
    answers = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"_{i}").alias("length")) for i, q in enumerate(at)])
    return sums.agg(*least).select(F.inline(answers))
