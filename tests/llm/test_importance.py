import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm import importance
from quoteloom.llm.importance import Run, Shifts, Tournament, features, least_drawn, ranked, resample, segments, sliced

from .helpers import AWKWARD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def brute(docs, target, percent=5, least=20):
    """Rows of (doc_id, n_features, weight, score, rank)."""
    s, t = (Counter(bucket(g) for _, text in side for g in grams(text)[1]) for side in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, all_ = grams(text)
        weight = sum(gain[bucket(g)] for g in all_)
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(all_), weight, score, None, len(words)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted([tuple(r[:5]) for r in rows], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=300)), min_size=1, max_size=20))
def test_checksums_are_joined(pairs):
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    size = np.array([len(b) for _, b in pairs], np.int64)
    second = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    assert (Shifts()(first, size) ^ second).tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("part", [1, 7, 60, 2_000_000])
def test_features_of_texts_in_pieces(monkeypatch, part):
    monkeypatch.setattr(importance, "PART_BYTES", part)
    texts = [None, "", "One two, THREE\x00four", "a" * 500 + " b " + "c" * 9000 + " d e", " , ", "ünï çé 中文 x " * 30, "tail", "b  c " * 40 + "  "]
    counts, words = {}, Counter()
    for some in segments([t.encode() if t is not None else None for t in texts]):
        count, owner, runs = features(some, 10000)
        for place, n in zip((p[0] for p in some), count.tolist()):
            words[place] += n
        for last, found in runs:
            for segment, b in zip(owner[last].tolist(), found.tolist()):
                counts.setdefault(some[segment][0], Counter())[b] += 1
    for i, text in enumerate(texts):
        plain, all_ = grams(text)
        assert words[i] == len(plain) and counts.get(i, Counter()) == Counter(map(bucket, all_))


class Memory:
    def __init__(self, records):
        self.raw, self.read = np.array(records, np.int64).reshape(-1, 3).tobytes(), 0

    def read_at(self, size, at):
        self.read += size
        return self.raw[at : at + size]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 3)), max_size=12), min_size=1, max_size=9), st.integers(1, 5), st.integers(0, 100))
def test_a_tournament_merges_runs_and_stops(runs, block, draws):
    serial = iter(range(1000))
    runs = [sorted((a, b, next(serial)) for a, b in run) for run in runs]
    flat = [r for run in runs for r in run]
    source, at, opened = Memory(flat), 0, []
    for run in runs:
        opened.append(Run(source, at, at + len(run), block))
        at += len(run)
    draws = min(draws, len(flat))
    found = [tuple(r) for part in Tournament(opened).merged(draws) for r in part.tolist()]
    assert found == sorted(flat)[:draws]
    assert source.read <= 24 * (draws + 2 * block * len(runs))  # each run's blocks up to where it stopped


def test_ties_nulls_and_slices(spark):
    rows = [(i % 5, None if i % 17 == 0 else i // 2, i) for i in range(400)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(7)
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for draws in (1, 79, 80, 81, 400):
        least = least_drawn(df, draws)
        assert sum(r[0] >= least for r in rows) >= draws > sum(r[0] > least for r in rows)
        slices = sliced(df.where(df.score >= least), importance.fresh(spark, "runs"))
        found = {r.row: r["rank"] for r in ranked(spark, slices, draws, held=8).collect()}
        assert found == {row: i for i, (_, _, row) in enumerate(want[:draws], 1)}


def test_least_drawn_of_wide_scores(spark):
    scores = sorted((pow(7, i, 1_000_003) * 1000 - 400_000_000 for i in range(3000)), reverse=True)
    df = spark.createDataFrame([(s,) for s in scores], "score long")
    assert [least_drawn(df, n) for n in (1, 150, 3000)] == [scores[n - 1] for n in (1, 150, 3000)]


def test_documents_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = resample(documents(spark, docs).repartition(5), documents(spark, target), percent=40)
    assert rows_of(found) == brute(docs, target, 40)


def test_awkward_rows(spark):
    target = [(1, "alpha beta gamma"), (2, None), (3, "")]
    found = resample(documents(spark, AWKWARD).repartition(3), documents(spark, target), percent=50, least_words=2)
    assert rows_of(found) == brute(AWKWARD, target, 50, 2)


def test_no_draw_and_whole_draw(spark):
    few = [(i, "word " * (i + 18)) for i in range(6)]
    assert rows_of(resample(documents(spark, few), documents(spark, []))) == brute(few, [])  # 5 % of 4 is none
    assert rows_of(resample(documents(spark, few), documents(spark, []), percent=100)) == brute(few, [], 100)
    with pytest.raises(ValueError, match="percent"):
        resample(documents(spark, few), documents(spark, few), percent=101)


def test_empty_table(spark):
    assert resample(documents(spark, []), documents(spark, [(1, "a b")])).collect() == []


def test_equals_its_sql(spark, sf_dir, duck):
    from quoteloom.llm.queries import ORACLES, QUERIES

    found = QUERIES["op12_importance"](spark, sf_dir)
    want = duck.execute(ORACLES["op12_importance"])
    assert [d[0] for d in want.description] == found.columns
    assert rows_of(found) == sorted(want.fetchall(), key=str)
