"""Numbering rows of a whole corpus where they lie.

Rows whose partitions are ranges of an order need no exchange to be numbered:
each knows its place in its own partition, and one row a partition, summed up in
order and broadcast, says how many stand before it.  Corpora mostly lie in their
order; one that doesn't is dealt by ranges once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def _overlap(parts: DataFrame) -> bool:
    """Whether a part (low, high) begins before one with a lower beginning has ended."""
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    return not parts.select("low", F.max("high").over(before).alias("ended")).where("ended >= low").isEmpty()


def as_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in partitions that are ranges of ``order``: as they are if they are that already, else dealt anew.

    Only the columns of the order are read to find out.
    """
    place = F.struct(*order)
    parts = rows.select(place.alias("place"), F.spark_partition_id().alias("part")).groupBy("part").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return rows.repartitionByRange(*order) if _overlap(parts) else rows


def numbered(rows: DataFrame, order: tuple[str, ...], into: str, name: str) -> DataFrame:
    """``rows``, written once, with the number of rows before each in ``order`` as ``into``.

    Rows should come from :func:`as_ranges`; if they don't, they are dealt by ranges here.
    """
    place, part = F.struct(*order), F.shiftright("_row", 33)

    def put(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        table = saved(df.sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), name)
        return table, saved(table.groupBy(part.alias("part")).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")), "parts")

    table, parts = put(rows)
    if _overlap(parts):
        table, parts = put(table.drop("_row").repartitionByRange(*order))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return table.join(F.broadcast(bases), part == F.col("part")).withColumn(into, F.col("base") + own).drop("_row", "part", "base")
