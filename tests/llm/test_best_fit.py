import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm.best_fit import Plan, best_fit, best_fit_pack, lower_bound, reduce
from quoteloom.llm.tokens import BYTE_BPE, vocabulary_path

from .helpers import AWKWARD, documents
from .test_token_files import with_added


def histogram(sizes, capacity):
    return np.bincount(np.array(sizes, np.int64), minlength=capacity + 1).astype(np.int64)


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, (*rest, room - sizes[i]))
        place(i + 1, (*rooms, capacity - sizes[i]))

    place(0, ())
    return best


def checked(kinds, counts, capacity):
    used = Counter()
    for kind, times in kinds:
        assert times > 0 and sum(k * n for k, n in kind.items()) <= capacity
        for k, n in kind.items():
            used[k] += n * times
    assert used == Counter({i: n for i, n in enumerate(counts.tolist()) if n})
    return sum(times for _, times in kinds)


@settings(max_examples=400, deadline=None)
@given(st.integers(5, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_a_best_packing(case):
    capacity, sizes = case
    counts = histogram(sizes, capacity)
    left = counts.copy()
    fixed = reduce(left, capacity)
    checked(fixed, counts - left, capacity)
    rest = [i for i, n in enumerate(left.tolist()) for _ in range(n)]
    best = fewest(sizes, capacity)
    assert sum(times for _, times in fixed) + fewest(rest, capacity) == best
    kinds = fixed + best_fit(left, capacity)
    assert best <= checked(kinds, counts, capacity)
    assert lower_bound(counts, capacity) <= best


@settings(max_examples=150, deadline=None)
@given(st.integers(8, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.tuples(st.integers(1, c), st.integers(1, 10_000)), max_size=12))))
def test_all_pieces_have_a_place_of_their_own(case):
    capacity, sizes = case
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in sizes:
        counts[size] = n % 60 + 1
    plan = Plan.of(counts, capacity)
    length = np.repeat(np.arange(capacity + 1), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = plan.places(length, rank)
    by = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(by) == list(range(len(by))) and len(by) >= lower_bound(counts, capacity)


def test_best_fit_of_many_alike_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        capacity = int(rng.integers(5, 60))
        sizes = sorted(rng.integers(1, capacity + 1, 40).tolist(), reverse=True)
        rooms = []
        for size in sizes:
            fit = [r for r in rooms if r >= size]
            rooms.remove(min(fit)) if fit else None
            rooms.append((min(fit) if fit else capacity) - size)
        assert sum(t for _, t in best_fit(histogram(sizes, capacity), capacity)) == len(rooms)


def test_work_does_not_grow_with_the_number_of_documents():
    counts = np.random.default_rng(0).integers(0, 1000, 2049)
    counts[0] = 0
    small, large = Plan.of(counts, 2048), Plan.of(counts * 1_000_000, 2048)
    assert len(large.key) < 2 * len(small.key) + 100 < 3 * 2048 * 63


@pytest.mark.parametrize("tokens", [7, 2048])
def test_documents_round_trip(spark, sf_dir, tokens):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    texts = AWKWARD + [(1000 + i, t) for i, t in enumerate(with_added(BYTE_BPE))]
    if tokens > 7:
        texts += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = best_fit_pack(documents(spark, texts).repartition(3), tokens=tokens).collect()
    ids = {d: np.array(codec.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in texts}
    many = Counter(d for d, _ in texts)
    for doc_id, own in ids.items():
        found = Counter((r.piece, r.start, r.length) for r in rows if r.doc_id == doc_id)
        pieces = -(-len(own) // tokens)
        first = len(own) - (pieces - 1) * tokens
        want = [(0, 0, first)] + [(i, first + (i - 1) * tokens, tokens) for i in range(1, pieces)]
        assert found == Counter({w: many[doc_id] for w in want})
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    counts = histogram([r.length for r in rows], tokens)
    left = counts.copy()
    kinds = reduce(left, tokens) + best_fit(left, tokens)
    assert len(sequences) == sum(n for _, n in kinds)
    if tokens > 7:
        assert len(sequences) == lower_bound(counts, tokens)


def test_empty_table_and_no_room(spark):
    assert best_fit_pack(documents(spark, [])).collect() == []
    with pytest.raises(ValueError, match="room"):
        best_fit_pack(documents(spark, []), tokens=0)
