import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm.packing import Limits, Packer, chat_examples, pack_documents, pack_examples
from quoteloom.llm.preferences import conversations, render
from quoteloom.llm.tokens import WORD_BPE, vocabulary_path

from .helpers import AWKWARD, documents
from .test_token_files import with_added


def check(pieces, sizes, limits):
    """Each token in one piece; limits kept; offsets gapless."""
    for doc, n in sizes.items():
        at = 0
        for start, length in sorted((s, n) for d, s, n in pieces if d == doc):
            assert start == at and length > 0
            at += length
        assert at == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.integers(1, 6), st.integers(10, 64), st.randoms())
def test_limits_hold_and_nothing_is_lost(sizes, segments, loss, rnd):
    limits = Limits(tokens=64, segments=segments, loss=loss)
    packer = Packer(limits)
    for i, n in enumerate(sizes):
        flags = np.array([rnd.random() < 0.6 for _ in range(n)], np.int64)
        packer.loss_before[i] = np.concatenate([[0], np.cumsum(flags)]) if i % 3 else None
    done, left = packer.pool([(i, 0, n) for i, n in enumerate(sizes)])
    bins = done + packer.tail(left)
    check([p for b in bins for p in b], dict(enumerate(sizes)), limits)
    for b in bins:
        assert sum(p[2] for p in b) <= 64 and len(b) <= segments and sum(map(packer.loss, b)) <= loss


def test_no_padding_where_only_tokens_bind():
    rng = np.random.default_rng(0)
    packer = Packer(Limits(64, 64, 64))
    sizes = rng.integers(1, 200, 300).tolist()
    done, left = packer.pool([(i, 0, int(n)) for i, n in enumerate(sizes)])
    assert all(sum(p[2] for p in b) == 64 for b in done)
    assert all(sum(p[2] for p in b).bit_count() == 1 for b in packer.tail(left))


@pytest.mark.parametrize("bad", [(0, 4, 4), (64, 0, 64), (64, 4, 0), (64, -1, 64)])
def test_limits_without_room_are_refused(bad):
    with pytest.raises(ValueError, match="1 or more"):
        Limits(*bad)


def test_each_limit_binds():
    """Short examples fill the segments, talkative ones the loss: both well before the tokens."""
    packer = Packer(Limits(64, 4, 16))
    sizes = [6] * 40 + [30] * 40
    for i, n in enumerate(sizes):
        packer.loss_before[i] = np.arange(n + 1) if n == 30 else np.zeros(n + 1, np.int64)
    done, left = packer.pool([(i, 0, n) for i, n in enumerate(sizes)])
    bins = done + packer.tail(left)
    assert all(len(b) <= 4 and sum(map(packer.loss, b)) <= 16 and sum(p[2] for p in b) <= 64 for b in bins)
    assert any(len(b) == 4 for b in bins) and any(sum(map(packer.loss, b)) == 16 for b in bins)


@pytest.mark.parametrize("pool", [50, 2_000_000])
def test_documents_round_trip(spark, sf_dir, pool):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(vocabulary_path(WORD_BPE))
    texts = AWKWARD + [(1000 + i, t) for i, t in enumerate(with_added(WORD_BPE))]
    if pool > 50:
        texts += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = pack_documents(documents(spark, texts).repartition(3), pool_tokens=pool).collect()
    ids = {}
    for doc_id, text in texts:
        ids[doc_id] = np.array(codec.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(ids[d]) for d, _ in texts)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at.bit_count() == 1


def test_examples_with_loss_flags(spark):
    rows = [(1, [5] * 30, [True] * 10 + [False] * 20), (2, [6] * 5, None), (3, None, None), (4, [], []), (None, [7], [True])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>, loss array<boolean>")
    found = pack_examples(df, Limits(16, 4, 8)).collect()
    assert sum(r.length for r in found) == 36 and sum(r.loss for r in found) == 11
    assert all(r.loss <= 8 for r in found)


def test_chats_under_three_limits(spark, sf_dir):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(vocabulary_path(WORD_BPE))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want, flags = {}, {}
    for r in turns.orderBy("conv_id", "turn").collect():
        ids = codec.encode(render((r.role, r.text)), add_special_tokens=False).ids
        want.setdefault(r.conv_id, []).extend(ids)
        flags.setdefault(r.conv_id, []).extend([r.role == "assistant"] * len(ids))
    for c in want:
        want[c].append(1)
        flags[c].append(flags[c][-1])
    limits = Limits(512, 3, 200)
    rows = pack_examples(chat_examples(conversations(turns)), limits).collect()
    bins = {}
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and sum(flags[r.doc_id][r.start : r.start + r.length]) == r.loss
        bins.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    assert all(sum(r.length for r in b) <= 512 and len(b) <= 3 and sum(r.loss for r in b) <= 200 for b in bins.values())
    assert any(len(b) == 3 for b in bins.values()) or any(sum(r.loss for r in b) == 200 for b in bins.values())


def test_empty_table(spark):
    assert pack_documents(documents(spark, [])).count() == 0
