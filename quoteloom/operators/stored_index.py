"""An inverted index that outlives a call: postings kept by term, added to by new passages, read by the terms asked for.

Passages are dealt by *block*, a bounded range of places, and turned to postings
there.  Postings lie in files by *segment*, the passages added at a time, and
*bucket*, a hash of the term; a row is a block of one term's postings, by place
in the block, and rows are sorted by term.  Terms that very many passages hold are
thus many rows, in several files.  A search reads the buckets of its terms and,
of these, the row groups that can hold them; blocks are scored apart, and the
ids of the best passages alone are looked up.  Passages of a term are counted
over all segments, so scores are those of an index built at once.

A segment is readable once a *generation*, the list of all segments with their
counts, names it; generations are written whole, under the next number, and a
number is taken once.  What a failed attempt wrote is in no generation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TOP_K
from ..sources.tables import arrow_batches, saved
from .retrieval import asked_terms, weighted
from .scoring import asked_blocks, best_postings, in_runs, ranks

#: Buckets of terms, and places in a block of postings.
BUCKETS, BLOCK = 64, 16_384
#: Terms of a batch that are told to the files' readers one by one; with more, buckets alone are.
TERMS_TOLD = 5_000
#: Bytes of passages that are turned to postings at a time, at most; a block of more gives several rows a term.
TURNED = 64_000_000

_POSTINGS = "term string, block long, postings array<struct<at:int,length:int,f:int>>"
_SEGMENTS = "segment string, n long, words long"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of passages (block, at, length, terms) that lie together by block."""
    for group in in_runs(batches, ("block",), TURNED):
        at, lists = group["at"].to_numpy(), group["terms"].combine_chunks()
        if len(np.unique(at)) < len(at):
            raise ValueError("passages of an index need places of their own")
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(at)), pc.list_value_length(lists).to_numpy())
        key, f = np.unique(words.indices.to_numpy().astype(np.int64) * len(at) + np.argsort(np.argsort(at))[row], return_counts=True)
        term, own = key // len(at), np.argsort(at)[key % len(at)]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        posted = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (at[own], group["length"].to_numpy()[own], f)], ["at", "length", "f"])
        postings = pa.ListArray.from_arrays(pa.array([*starts, len(term)], pa.int32()), posted)
        block = pa.array(np.full(len(starts), group["block"][0].as_py()), pa.int64())
        rows = pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[starts])), block, postings], ["term", "block", "postings"])
        for first in range(0, len(rows), 4_096):
            yield rows.slice(first, 4_096)


class StoredIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _generation(self) -> int:
        """The last one written whole; 0 before any."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generations")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(root) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(map(int, names), default=0)

    def segments(self) -> DataFrame:
        """(segment, n, words): passages and their words, of each time that some were added."""
        now = self._generation()
        if not now:
            return self.spark.createDataFrame([], _SEGMENTS)
        return self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/generations/{now}")

    def _publish(self, segments: DataFrame, after: int) -> None:
        segments.coalesce(1).write.mode("error").parquet(f"{self.path}/generations/{after + 1}")

    def stats(self) -> DataFrame:
        """One row: passages n and their average length."""
        total = self.segments().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("words").alias("words"))
        return total.select("n", F.coalesce(F.col("words") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("avg_length"))

    def _write(self, blocks: DataFrame, segment: str) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = blocks.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).repartition(parts, "bucket", F.col("block") % max(1, parts // self.buckets))
        dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    def append(self, index: DataFrame) -> str:
        """Add passages that are not in it yet, as ``indexed`` gives them with one whole number, of each its own, as their place; the segment's name.

        Passages without a term count, though no posting names them.
        """
        before, segment = self._generation(), uuid.uuid4().hex
        number = index.schema["place"].dataType.names[0]
        rows = saved(index.select("chunk_id", F.col("place")[number].cast("long").alias("place"), "length", "terms"), "index")
        block = F.floor(F.col("place") / BLOCK)
        dealt = rows.where("length > 0").select(block.alias("block"), (F.col("place") - block * BLOCK).cast("int").alias("at"), "length", "terms")
        arrow_batches(self.spark)
        self._write(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_turned, _POSTINGS), segment)
        rows.select("place", "chunk_id").write.parquet(f"{self.path}/passages/segment={segment}")
        own = rows.agg(F.lit(segment).alias("segment"), F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("words"))
        self._publish(self.segments().unionByName(own), before)
        return segment

    def compact(self) -> None:
        """Make one segment of all: fewer files to open after many small additions.  Readers of the former ones can go on."""
        before, segment = self._generation(), uuid.uuid4().hex
        if not before:
            return
        held = self._blocks().groupBy("term", "block").agg(F.sort_array(F.flatten(F.collect_list("postings"))).alias("postings"))
        self._write(held, segment)
        self._passages().select("place", "chunk_id").write.parquet(f"{self.path}/passages/segment={segment}")
        total = self.segments().agg(F.lit(segment).alias("segment"), F.sum("n").alias("n"), F.sum("words").alias("words"))
        self._publish(total, before)

    def _read(self, kind: str) -> DataFrame:
        """A table of all segments; those without a term have no postings."""
        names = [r.segment for r in self.segments().where("words > 0").select("segment").collect()]  # a row for each addition
        if not names:
            raise LookupError("the index is empty")
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/segment={n}" for n in names])

    def _blocks(self) -> DataFrame:
        """(term, block, postings, segment, bucket)."""
        return self._read("postings")

    def _passages(self) -> DataFrame:
        """(place, chunk_id, segment)."""
        return self._read("passages")

    def _held(self, asked: DataFrame) -> DataFrame:
        """Blocks of the terms of ``asked``: only their buckets are read."""
        terms = saved(asked.select("term").distinct().withColumn("bucket", bucket_of(F.col("term"), self.buckets)), "terms")
        buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # as many as the index has at most
        found = self._blocks().where(F.col("bucket").isin(buckets))
        told = [r.term for r in terms.select("term").limit(TERMS_TOLD + 1).collect()]
        if len(told) <= TERMS_TOLD:
            found = found.where(F.col("term").isin(told))
        return found.join(terms.select("term"), "term", "left_semi")

    def postings(self, asked: DataFrame) -> DataFrame:
        """(term, place, length, f) of the terms of ``asked``."""
        found = self._held(asked).select("term", "block", F.inline("postings"))
        return found.select("term", (F.col("block") * BLOCK + F.col("at")).alias("place"), "length", "f")

    def search(self, questions: DataFrame, top_k: int = TOP_K) -> DataFrame:
        """(question_id, rank, chunk_id, score, coverage), as :func:`quoteloom.operators.retrieval.search` over all passages added."""
        asked = saved(asked_terms(questions), "asked")
        kind = asked.schema["question_id"].dataType.simpleString()
        try:
            held, passages = self._held(asked), self._passages()
        except LookupError:
            return self.spark.createDataFrame([], f"question_id {kind}, rank int, chunk_id string, score double, coverage double")
        df = held.groupBy("term").agg(F.sum(F.size("postings")).alias("df"))
        paths = asked_blocks(weighted(asked, df, self.stats()))
        best = saved(ranks(best_postings(held, paths, kind, top_k, BLOCK), top_k), "best")  # a few rows a question
        return passages.join(F.broadcast(best), "place").select("question_id", "rank", "chunk_id", "score", "coverage")
