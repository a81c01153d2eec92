"""Token-id files: whole texts encoded, written in ascending id order, and read back.

Documents are range-partitioned by id; each task encodes its range and writes
one file of Simple-8b segments.  A manifest row for each segment names file,
place and counts; a document's start is the ids of earlier files (one sum for
each file), of earlier segments of its file, and of earlier documents of its
segment.  Files of lost or repeated attempts are named by attempt and are never
in the manifest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .simple8b import pack_segment, unpack_segment
from .store import fresh, open_input, open_output, partitions, pick, small_batches, written
from .tokens import BYTE_BPE, crc_of_ids, encoder

#: Larger than elsewhere, as a task holds little else: fewer look-ups a unit.
MEMO_UNITS, BATCH_BYTES = 1_000_000, 8_000_000

_MANIFEST = "part long, segment long, path string, at long, size long, documents long, ids long"


def encode_documents(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str, text_col: str, segment_ids: int) -> DataFrame:
    """Write the files; the manifest, as a written table."""
    spark = docs.sparkSession
    small_batches(spark, size=BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/part-{part:06d}-{task.taskAttemptId()}.s8b"
        codec = encoder(vocabulary, MEMO_UNITS, BATCH_BYTES)
        rows, out, at = [], None, 0
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def flush() -> None:
            nonlocal out, at, n_held
            if not held:
                return
            out = out or open_output(path)
            doc_ids, known, counts, ids = (np.concatenate(x) for x in zip(*held))
            raw = pack_segment(doc_ids, known, counts, ids)
            out.write(raw)
            rows.append((part, len(rows), path, at, len(raw), len(doc_ids), len(ids)))
            at += len(raw)
            held.clear()
            n_held = 0

        for batch in batches:
            flat, counts = codec.encode_array(batch.column(1))
            ends = np.cumsum(counts)
            ids = np.insert(flat, ends, end_id)
            doc_ids = batch.column(0)
            held.append((doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), counts + 1, ids))
            n_held += len(ids)
            if n_held >= segment_ids:
                flush()
        flush()
        if out:
            out.close()
        names = [x.split()[0] for x in _MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string() if n == "path" else pa.int64()) for i, n in enumerate(names)})

    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.withColumn("doc_id", plain.doc_id.cast("long"))
    ordered = plain.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, _MANIFEST), "manifest")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    totals = sorted((r.part, r.ids) for r in manifest.groupBy("part").agg(F.sum("ids").alias("ids")).collect())  # a row for each file
    before, starts = 0, []
    for part, ids in totals:
        starts.append((part, before))
        before += ids
    bases = F.broadcast(spark.createDataFrame(starts, "part long, base long"))
    earlier = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("earlier", earlier).join(bases, "part").select("path", "at", "size", (F.col("base") + F.col("earlier")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as source:
                    raw = source.read_at(row["size"], row["at"])
                doc_ids, known, counts, ids = unpack_segment(raw)
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                crcs = [crc_of_ids(ids[a:z]) for a, z in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=~known), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = partitions(spark)
    return placed.repartition(n, "path", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(
    docs: DataFrame,
    vocabulary: str = BYTE_BPE,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = 1_000_000,
    folder: str | None = None,
) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start, n_tokens, ids_crc32.

    Null text is the empty text and has the end id alone.  A null doc_id sorts
    first; rows with one id follow each other, ordered by their text's hash.
    An empty table writes no file and returns no row.
    """
    spark = docs.sparkSession
    manifest = encode_documents(docs, folder or fresh(spark, "token-files"), vocabulary, end_id, id_col, text_col, segment_ids)
    return read_documents(spark, manifest)
