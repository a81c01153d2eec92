"""64-bit SimHash fingerprints of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .store import pick, small_batches

SEED = 42


def shingle_hashes(text: bytes | None, shingle_words: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in blocks; a shorter text is one shingle, a wordless one has none."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle_words, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    ends = ends[size - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, len(starts), block):
        spans = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist())
        yield np.array([digest(joined[a:z], seed) for a, z in spans], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes: the bits that over half of them have; of none, 0."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprint(text: bytes | None, shingle_words: int = 4, block: int = 1 << 16) -> int:
    """SimHash of a text's word shingles, repeats included; 0 where there is no word."""
    return majority(shingle_hashes(text, shingle_words, block))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return plain.withColumn("doc_id", plain.doc_id.cast("long")).mapInArrow(run, "doc_id long, fp long")
