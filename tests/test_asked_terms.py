"""Terms that questions ask for, counted while passages are cut; and passages cut by the sentences near their ends."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteloom.constants import STOPWORDS
from quoteloom.functions import text
from quoteloom.operators import relocation, scoring
from quoteloom.operators.chunks import chunk_documents, number_chunks, spans_of
from quoteloom.operators.retrieval import asked_files, indexed, search
from quoteloom.plans import ask, progress
from quoteloom.sources.tables import saved

ODD = [*"aB .!?\"')]\n\r\t \x00\x01", "Mr", "é", "ﬁ", "½", "\U0001F600", "dept", "Sept.", "I.", "́", "e.g", "No", "éa", "the ", "water "]


def odd_texts(n, longest, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(longest))) for _ in range(n)]


def documents(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["moon", "river", "water", "the", "salt", "cave", "x", "Sea.", "Ice!"]) for _ in range(rng.randrange(900))) for _ in range(12)]
    rows = [(f"d{i}", i, "t", t) for i, t in enumerate([*texts, *odd_texts(20, 3000), None, ""])]
    return spark.createDataFrame(rows, "doc_id string, doc_order long, title string, text string")


def questions(spark):
    return spark.createDataFrame([(1, "Where is the moon's water?"), (2, "salt, ice and nowhere"), (3, "the")], "question_id long, question string")


def test_terms_are_counted_as_word_by_word():
    known = text.AskedTerms(["water", "ab", "bab"])
    texts = [*odd_texts(700, 60), None, "", "the", "water", None]
    lists, lengths = known.counted(texts, together=100)
    words = [None if t is None else [w.decode() for w in text.fold_words(t)] for t in texts]
    assert lists.to_pylist() == [None if w is None else [x for x in w if x in ("water", "ab", "bab")] for w in words]
    assert lengths.to_pylist() == [None if w is None else sum(len(x) > 1 and x not in STOPWORDS for x in w) for w in words]
    assert [len(x) for x in known.counted([])] == [0, 0]


@pytest.mark.parametrize("most", [scoring.HELD_TERMS, 1])
def test_an_index_of_asked_terms_finds_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(scoring, "HELD_TERMS", most)
    docs, asked = documents(spark), questions(spark)
    files = asked_files(asked)
    assert (files is None) == (most == 1)
    whole = indexed(number_chunks(chunk_documents(docs)))
    cut = chunk_documents(docs, asked=files)
    for index in (indexed(number_chunks(cut if files is None else cut.drop("text"))), indexed(number_chunks(chunk_documents(docs)), asked=files)):
        assert sorted(search(index, asked).collect()) == sorted(search(whole, asked).collect())
        assert sorted(index.select("chunk_id", "length").collect()) == sorted(whole.select("chunk_id", "length").collect())
    nulls = indexed(docs, "doc_id", ("doc_order",), files).where("chunk_id = 'd32'").first()
    assert nulls.terms is None and nulls["length"] is None


def test_a_run_writes_no_terms_that_nobody_asked_for(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(progress, "saved", lambda df, name: written.setdefault(name, saved(df, name)))
    ready = ask.prepare(documents(spark), questions(spark))
    held = {r.t for r in written["index"].select(F.explode("terms").alias("t")).collect()}
    assert held == {"moon", "water", "salt", "ice"}
    assert "text" in ready.chunks.columns and "terms" not in ready.chunks.columns


def cut_by_all_sentences(t, target, overlap, least):
    """What :func:`spans_of` has to give, from every segment."""
    t, done, start, end = t.replace("\x01", " "), [], 0, -1
    parts, at = [], 0
    for found in text.re.finditer(r"\n[ \t]*\r?\n", t):
        parts.append((at, found.start()))
        at = found.end()
    for low, high in [*parts, (at, len(t))]:
        piece = t[low:high]
        own = [(0, len(piece))] if len(piece) <= target else text.sentence_spans(piece)
        if len(piece) > target and len(own) <= 1:
            own = [(a, min(a + target, len(piece))) for a in range(0, len(piece), target)]
        for a, z in ((low + a, low + z) for a, z in own if not text.is_blank(piece[a:z])):
            if end == -1:
                start = a
            elif z - start > target:
                done.append((start, end))
                start = min(max(start, end - overlap), a)
            end = z
    if end == -1:
        return done
    if done and end - start < least:
        start = done.pop()[0]
    return [*done, (start, end)]


@pytest.mark.parametrize("limits", [(20, 6, 3), (45, 40, 30), (300, 50, 40)])
def test_passages_are_those_of_all_sentences(limits):
    for t in odd_texts(1500, 200, seed=limits[0]) + ["Aa. " * 600, ".?!" * 400, "a" * 900, "Mr. " * 300 + "End. So."]:
        assert spans_of(t, *limits) == cut_by_all_sentences(t, *limits), t


def test_sentences_amid_a_passage_are_not_looked_at(monkeypatch):
    seen, short = [], text._is_short
    monkeypatch.setattr(text, "_is_short", lambda t, stop: seen.append(stop) or short(t, stop))
    assert len(spans_of("It was so. " * 2000, 1100, 200, 120)) > 20 and len(seen) < 1100


def test_hashes_of_words_of_any_length():
    words = ["", "a", "b", "ab", "aaaaaaaa", "aaaaaaab", "aaaaaaaaa", "a" * 16, "a" * 17, "a" * 16 + "b", "b" + "a" * 16, "a" * 300]
    raw = np.frombuffer(" ".join([*words, *reversed(words), ""]).encode(), np.uint8)
    end = np.flatnonzero(raw == 32)
    told = relocation.word_hashes(raw, np.concatenate([[0], end[:-1] + 1]), end).tolist()
    assert told == told[::-1] and len(set(told)) == len(words)
