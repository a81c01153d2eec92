"""Language ID by cross-parsing entropy.

A language is known by a bounded sample of its labelled text, held as a suffix
automaton.  A text is parsed against each language into the longest phrases that
occur in that sample; phrases weighed by the bits that name a place in the
sample, over the text's length, estimate the cross entropy, and the language
with the least wins.

An automaton becomes one table of transitions; where a phrase can't go on, the
entry restarts at the root; whatever begins a phrase carries a flag, so that
parsing is one table look-up a byte.  Texts are cut into slices of ``SLICE`` bytes that are parsed side by
side; a phrase never crosses a slice, for all languages alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import pick, small_batches
from .tokens import give_back_memory, kept

#: Bounds of the sample: excerpts of each language, characters of each, and characters in all: with many languages
#: excerpts are shorter, so that the tables of a worker stay within some hundred MB.
SAMPLE_TEXTS, SAMPLE_CHARS, ALL_CHARS = 96, 512, 8 * 96 * 512
#: Languages that are learnt: of more labels, those that most documents have.
MAX_LANGUAGES = 256
SLICE = 256
UNKNOWN = "und"

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def bare(text: str | None) -> bytes:
    """Lower-case letters in UTF-8; whatever stands between words is one blank."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) if text else b""


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in text:
        now = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at != -1 and byte not in step[at]:
            step[at][byte] = now
            at = link[at]
        if at != -1:
            to = step[at][byte]
            if longest[at] + 1 == longest[to]:
                link[now] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at != -1 and step[at].get(byte) == to:
                    step[at][byte] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    return step


class Parser:
    """Phrase counts of texts against the samples of several languages."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = sorted(set(b"".join(samples.values()) + b" "))
        self.symbol = np.full(256, len(used), np.uint8)  # a byte of no sample
        self.symbol[used] = np.arange(len(used))
        self.width = width = len(used) + 2  # and, last, the end of a slice
        self.tables = []
        for name in self.languages:
            steps = suffix_automaton(samples[name])
            table = np.zeros((len(steps), width), np.int32)
            root = np.zeros(width, np.int32)
            for byte, to in steps[0].items():
                root[self.symbol[byte]] = to * width << 1
            table[:] = root | 1
            table[:, -1] = 0
            for state, step in enumerate(steps):
                if step:
                    table[state, self.symbol[list(step)]] = np.fromiter(step.values(), np.int32, len(step)) * width << 1
            table[0, :-1] |= 1  # what leaves the root begins a phrase
            self.tables.append(table.reshape(-1))
        self.bits = np.array([np.log2(max(2, len(samples[name]))) for name in self.languages])

    def phrases(self, texts: list[bytes], slices_at_once: int = 16_384) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        slices = -(-size // SLICE)
        total = int(slices.sum())
        grid = np.full(total * SLICE, self.width - 1, np.uint8)
        first = np.cumsum(slices) - slices
        for text, at in zip(texts, (first * SLICE).tolist()):
            grid[at : at + len(text)] = self.symbol[np.frombuffer(text, np.uint8)]
        grid = grid.reshape(total, SLICE)
        found = np.zeros((total, len(self.languages)), np.int64)
        for a in range(0, total, slices_at_once):
            columns = np.ascontiguousarray(grid[a : a + slices_at_once].T)
            for which, table in enumerate(self.tables):
                state = np.zeros(columns.shape[1], np.int32)
                count = np.zeros(columns.shape[1], np.int32)
                for symbols in columns:
                    state += symbols
                    state = table.take(state)
                    count += state & 1
                    state >>= 1
                found[a : a + slices_at_once, which] += count
        owner = np.repeat(np.arange(len(texts)), slices)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(out, owner, found)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        cost = self.phrases([bare(texts[i]) for i in rows]) * self.bits
        for i, c in zip(rows, cost):
            best = int(np.argmin(c))
            rest = np.delete(c, best)
            names[i] = self.languages[best]
            scores[i] = float(1 - c[best] / rest.min()) if len(rest) else 1.0
        return names, scores


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, most: int = MAX_LANGUAGES, all_chars: int = ALL_CHARS) -> dict[str, bytes]:
    """Excerpts by language, of columns text and lang: at most ``texts`` distinct texts of ``chars`` characters each.

    Texts are chosen by their hash, so that copies count once and the choice
    doesn't depend on how rows are dealt.  All languages together have at most
    ``all_chars`` characters, by shorter excerpts of each.  Of more than ``most``
    labels, those that most documents have are learnt, ties going to the first
    in order; the others are never predicted.
    """
    known = labelled.where("text is not null and lang is not null")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    langs = [r.lang for r in counted.collect()]  # ``most`` at most
    if not langs:
        return {}
    chars = max(1, min(chars, all_chars // (texts * len(langs))))
    spark = labelled.sparkSession
    hashed = known.join(F.broadcast(spark.createDataFrame([(x,) for x in langs], "lang string")), "lang", "left_semi").withColumn("h", F.xxhash64("text"))
    rows = hashed.groupBy("lang", F.pmod("h", F.lit(texts)).alias("b")).agg(F.min("h").alias("h")).collect()  # texts * most at most
    keys = F.broadcast(spark.createDataFrame([(r.lang, r.h) for r in rows], "lang string, h long"))
    excerpts = hashed.join(keys, ["lang", "h"], "left_semi").select("lang", "h", F.substring("text", 1, chars).alias("text"))
    found: dict[str, list[bytes]] = {}
    for row in excerpts.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():  # at most as many as keys
        found.setdefault(row.lang, []).append(bare(row.text))
    return {lang: b" ".join(parts) for lang, parts in found.items() if any(parts)}


def _parser(samples: dict[str, bytes]) -> Parser:
    parsers, key = kept("parser"), hash(tuple(sorted(samples.items())))
    if key not in parsers:
        parsers.clear()
        parsers[key] = Parser(samples)
    return parsers[key]


def predictions(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row and whole text; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            names, scores = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    plain = pick(docs, id_col, text_col).toDF("doc_id", "text")
    plain = plain.withColumn("doc_id", plain.doc_id.cast("long"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text has a language: others are ``und``.

    Where nothing was labelled, texts with a letter stay.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept = [n != UNKNOWN for n in parser.predict(texts)[0]] if parser.languages else list(map(has_letter, texts))
            yield batch.filter(pa.array(kept, pa.bool_()))
            give_back_memory()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def remainder(id_column: Column, fold: int) -> Column:
    """crc32 of an id as text, modulo ``fold``; of a null id, of the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(fold))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score.

    Learns from rows with a label whose id's CRC-32 leaves a remainder.  Null and
    letterless texts are ``und`` with score 0, as is everything where nothing was
    labelled; ties go to the language first in order.  The score is one less the
    ratio of the least to the second least cost.
    """
    plain = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    samples = sample(plain.where(remainder(F.col("doc_id"), fold) != 0).select("text", "lang"))
    found = predictions(docs, samples, id_col, text_col)
    return found.select("doc_id", (remainder(F.col("doc_id"), fold) == 0).alias("held_out"), "lang_pred", "score")
