"""Scores of passages where their terms lie: no row for a question and a passage that share a term ever leaves a task, only the best of each question.

Questions are written once, in blocks of bounded size, to the shared folder.  A
task takes passages a slice at a time: the share of each term in each passage is
a matrix of terms by passages, and a question's scores are the sum of its terms'
rows, in the order of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1
from ..functions.text import AskedTerms
from ..sources.tables import arrow_batches, open_input, saved

#: Terms of questions in a block, passages in a slice, and bytes of passages that go through the blocks together where there are several.
BLOCK_TERMS, SLICE, GROUP_BYTES = 4_096, 512, 32_000_000
#: Terms asked for that a task holds, at most; where there are more, an index has all terms.
HELD_TERMS = 500_000
#: Scores that are equal to so many places are ties, which keep document order.
TIE_PLACES = 1e9


def asked_blocks(weighted: DataFrame) -> list[str]:
    """Files of questions (question_id, n_terms, pos, term, idf, average); one question's terms lie in one."""
    weighted = saved(weighted, "weighted")
    blocks = saved(weighted.repartition(-(-weighted.count() // BLOCK_TERMS) or 1, "question_id"), "asked-blocks")
    return sorted(blocks.inputFiles())


def term_files(terms: DataFrame) -> list[str] | None:
    """Files of the different terms (term) that are asked for; None where they are too many for a task to hold."""
    held = saved(terms.select("term").distinct(), "asked-terms")
    return sorted(held.inputFiles()) if held.count() <= HELD_TERMS else None


@lru_cache(maxsize=1)
def held_terms(paths: tuple[str, ...]) -> AskedTerms:
    """The terms of :func:`term_files`, within tasks; a worker keeps those of one batch of questions."""
    found: list[str] = []
    for path in paths:
        with open_input(path) as source:
            found += pq.ParquetFile(source).read()["term"].to_pylist()
    return AskedTerms(found)


class Asked:
    """A block of questions: the places of each one's terms in the matrix of terms."""

    def __init__(self, path: str):
        with open_input(path) as source:
            rows = pq.ParquetFile(source).read().sort_by([("question_id", "ascending"), ("pos", "ascending")])
        ids, terms = (rows[c].combine_chunks().dictionary_encode() for c in ("question_id", "term"))
        self.ids, self.terms = ids.dictionary, terms.dictionary
        question, term = ids.indices.to_numpy(), terms.indices.to_numpy()
        first = np.searchsorted(question, np.arange(len(self.ids)))
        nth = np.arange(len(question)) - first[question]
        self.at = np.full((int(nth.max(initial=-1)) + 1, len(self.ids)), len(self.terms))  # the last row of the matrix is zero
        self.at[nth, question] = term
        self.n_terms = rows["n_terms"].to_numpy()[first] if len(first) else np.zeros(0)
        self.idf = np.zeros(len(self.terms))
        self.idf[term] = rows["idf"].to_numpy()
        self.average = rows["average"][0].as_py() if len(question) else 1.0


class Best:
    """The best passages of a block's questions, of all that a task has seen."""

    def __init__(self, questions: int, top_k: int):
        self.top_k, self.kept = top_k, None
        self.cut = np.zeros(questions)  # what a passage must score to be among the best

    def add(self, asked: Asked, term: np.ndarray, passage: np.ndarray, f: np.ndarray, length: np.ndarray, passages: pa.Table) -> None:
        """Passages of a slice, by occurrences ``f`` of a term in a passage (a place in ``passages``) of a length."""
        part = np.zeros((len(asked.terms) + 1, len(passages)))
        norm = f + BM25_K1 * (1 - BM25_B + BM25_B * length / asked.average)
        part[term, passage] = asked.idf[term] * (f * (BM25_K1 + 1)) / norm
        score = np.zeros((len(asked.ids), len(passages)))
        for row in asked.at:
            score += part[row]
        key = np.floor(score * TIE_PLACES + 0.5) / TIE_PLACES
        question, own = np.nonzero((score > 0) & (key >= self.cut[:, None]))
        if not len(question):
            return
        found = passages.take(pa.array(own))
        covered = (part[asked.at[:, question], own] > 0).sum(axis=0) / asked.n_terms[question]
        for name, values in (("coverage", covered), ("score", score[question, own]), ("key", key[question, own]), ("_question", question)):
            found = found.append_column(name, pa.array(values))
        rows = found if self.kept is None else pa.concat_tables([self.kept, found])
        order = [("_question", "ascending"), ("key", "descending"), *[(c, "ascending") for c in passages.column_names if c.startswith("place_")]]
        rows = rows.sort_by(order)
        own = rows["_question"].to_numpy()
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        self.kept = rows.filter(pa.array(nth < self.top_k)).combine_chunks()
        last = np.flatnonzero(nth == self.top_k - 1)
        self.cut[own[last]] = rows["key"].to_numpy()[last]


class Blocks:
    """Blocks of questions with their best passages; one block is held at a time."""

    def __init__(self, paths: list[str], top_k: int):
        self.paths, self.top_k = paths, top_k
        self.best: dict[str, Best] = {}
        self.now: tuple[str, Asked] | None = None

    def each(self) -> Iterator[tuple[Asked, Best]]:
        for path in self.paths:
            if self.now is None or self.now[0] != path:
                self.now = path, Asked(path)
            asked = self.now[1]
            yield asked, self.best.setdefault(path, Best(len(asked.ids), self.top_k))

    def told(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        for asked, best in self.each():
            if best.kept is not None:
                rows = best.kept.append_column("question_id", asked.ids.take(best.kept["_question"].combine_chunks()))
                yield from rows.select(names).to_batches()


def _sliced(group: list[pa.RecordBatch], blocks: Blocks) -> None:
    """Passages (chunk_id, place_..., length, terms) through all blocks."""
    passages = pa.Table.from_batches(group)
    names = [c for c in passages.column_names if c not in ("length", "terms")]
    for asked, best in blocks.each():
        for at in range(0, len(passages), SLICE):
            part = passages.slice(at, SLICE).combine_chunks()
            n, lists = len(part), part["terms"].combine_chunks()
            term = pc.fill_null(pc.index_in(lists.flatten(), asked.terms), -1).to_numpy()
            passage = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            f = np.bincount((term * n + passage)[term >= 0], minlength=1)
            held = np.flatnonzero(f)
            if len(held):
                own = held % n
                best.add(asked, held // n, own, f[held], part["length"].to_numpy()[own], part.select(names))


def best_passages(index: DataFrame, paths: list[str], question_kind: str, top_k: int) -> DataFrame:
    """(question_id, chunk_id, place, score, coverage, key) of the best passages of each task, of an index and the files of :func:`asked_blocks`."""
    place = index.schema["place"].dataType
    rows = index.select("chunk_id", *[F.col("place")[c].alias(f"place_{c}") for c in place.names], "length", "terms")
    kinds = {"question_id": question_kind} | {c: rows.schema[c].dataType.simpleString() for c in rows.columns[:-2]} | dict.fromkeys(("score", "coverage", "key"), "double")
    arrow_batches(index.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, group, size = Blocks(paths, top_k), [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if len(paths) == 1 or size > GROUP_BYTES:
                _sliced(group, blocks)
                group, size = [], 0
        if group:
            _sliced(group, blocks)
        yield from blocks.told(list(kinds))

    found = rows.mapInArrow(scan, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))
    return found.withColumn("place", F.struct(*[F.col(f"place_{c}").alias(c) for c in place.names]))


def best_postings(blocks_: DataFrame, paths: list[str], question_kind: str, top_k: int, size: int) -> DataFrame:
    """(question_id, place, score, coverage, key), the same of blocks (term, segment, block, postings) of ``size`` places, dealt by block."""
    kinds = {"question_id": question_kind, "place_": "long"} | dict.fromkeys(("score", "coverage", "key"), "double")
    rows = blocks_.select("segment", "block", "term", "postings").repartition("segment", "block").sortWithinPartitions("segment", "block")
    arrow_batches(blocks_.sparkSession)

    def score(group: pa.Table, blocks: Blocks) -> None:
        lists = group["postings"].combine_chunks()
        posted = lists.flatten()
        at, length, f = (posted.field(c).to_numpy() for c in ("at", "length", "f"))
        number = np.repeat(np.arange(len(group)), pc.list_value_length(lists).to_numpy())
        order = np.argsort(at, kind="stable")
        start = group["block"][0].as_py() * size
        for asked, best in blocks.each():
            terms = pc.fill_null(pc.index_in(group["term"].combine_chunks(), asked.terms), -1).to_numpy()
            own = order[terms[number[order]] >= 0]
            for low in range(0, size, SLICE):
                a, z = np.searchsorted(at[own], (low, low + SLICE))
                if a == z:
                    continue
                part = own[a:z]
                places, passage = np.unique(at[part], return_inverse=True)
                best.add(asked, terms[number[part]], passage, f[part], length[part], pa.table({"place_": pa.array(start + places, pa.int64())}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(paths, top_k)
        for group in in_runs(batches, ("segment", "block")):
            score(group, blocks)
        yield from blocks.told(list(kinds))

    return rows.mapInArrow(scan, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())).withColumnRenamed("place_", "place")


def in_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int | None = None) -> Iterator[pa.Table]:
    """Rows that lie together by ``keys``, each run of equal ones as a table; of runs of more than ``most`` bytes, several."""
    held, held_key, size = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(batch.schema.get_field_index(k)).dictionary_encode() for k in keys]
        numbers = np.stack([c.indices.to_numpy() for c in codes])
        edges = [0, *(np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            part = batch.slice(a, z - a)
            key = tuple(c.dictionary[int(n)].as_py() for c, n in zip(codes, numbers[:, a]))
            if held and (key != held_key or most is not None and size > most):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            held_key, size = key, size + part.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranks(found: DataFrame, top_k: int) -> DataFrame:
    """``found`` with the rank of the best of each question, from the best of each task."""
    best = Window.partitionBy("question_id").orderBy(F.desc("key"), "place")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
