import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm.simple8b import BLOCK, decode, encode, pack_segment, unpack_segment
from quoteloom.llm.token_files import token_files
from quoteloom.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, vocabulary_path

from .helpers import AWKWARD, documents


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def with_added(name):
    """Texts that hold the strings of added tokens: alone, doubled, within words, in upper case, cut short."""
    texts = []
    for token in library(name).get_added_tokens_decoder().values():
        t = token.content
        texts += [t, t + t, f"hello {t} world", f"ab{t}cd", f"a {t}\n{t.upper()} b", t.upper(), t[:-1], f"{t}'s. {t}, x", f"  {t}  ", f"é{t}é"]
    return texts


@pytest.mark.parametrize(
    "values",
    [[], [0], [1 << 63, 5, (1 << 60) - 1, 1 << 60, (1 << 64) - 1], [0] * 5000, list(range(3 * BLOCK + 1)), [7] + [0] * 700 + [1 << 62] + [0] * 700],
)
def test_coding_round_trip(values):
    values = np.array(values, np.uint64)
    words, blocks, escaped = encode(values)
    assert (decode(words, blocks, escaped, len(values)) == values).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 300), max_size=1500))
def test_coding_round_trip_of_any_values(values):
    values = np.array(values, np.uint64)
    assert (decode(*encode(values), len(values)) == values).all()


def test_blocks_decode_alone():
    values = np.arange(4 * BLOCK, dtype=np.uint64) % np.uint64(900)
    words, blocks, escaped = encode(values)
    part = words[blocks[2] : blocks[3]]
    assert (decode(part, np.array([0, len(part)]), escaped, BLOCK) == values[2 * BLOCK : 3 * BLOCK]).all()


def test_segment_round_trip():
    ids = np.array([5, 5, 49_000, 3, 3, 3, 0], np.uint64)
    back = unpack_segment(pack_segment(np.array([-4, 9]), np.array([True, False]), np.array([3, 4]), ids))
    assert back[0].tolist() == [-4, 9] and back[1].tolist() == [True, False] and back[2].tolist() == [3, 4]
    assert (back[3] == ids).all()


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_memoised_ids_equal_the_librarys(name):
    texts = [t for _, t in AWKWARD] + ["\n\n a  b\n", "a.b, c,, d. e? f’. é. «x». x».\ny", "ﬁ x y", "\tq  w", "a\x01b \x02", " .", ". ,", "a .", "<|endoftext|> ok", "ΑΣ. Σ, İ.", "\n\n", "'s a", "x\n's b", "y 'll\n'll", "'", "a\n\n", "a  ", " \n", "it's. don't, I'll.\nWe've", *with_added(name)]
    want = [e.ids for e in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    codec = Encoder(name, memo_units=8, batch_bytes=64)
    assert [x.tolist() for x in codec.encode(texts)] == want
    assert [x.tolist() for x in codec.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aéß .,\n!?'sT0- »", max_size=60))
def test_memoised_ids_equal_the_librarys_for_any_text(text):
    for name in (BYTE_BPE, WORD_BPE):
        codec = _shared.setdefault(name, Encoder(name))
        assert codec.encode([text])[0].tolist() == codec._library([text])[0]


_shared: dict = {}


def test_units_equal_the_librarys():
    for name in (BYTE_BPE, WORD_BPE):
        codec = Encoder(name)
        units = ["word", "word.", "Word,", "wörd.", ".", ",", "a.b,", "x..", "3.", "it's.", "×.", "中.", *[t for t in with_added(name) if not set(t) & set(" \n")]]
        ids, counts = codec.encode_units([u.encode() for u in units])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [codec._library([u])[0] for u in units]


def test_files_round_trip(spark):
    rows = [r for r in AWKWARD]
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files(documents(spark, rows).repartition(5), segment_ids=50).collect()}
    codec = library(BYTE_BPE)
    start, want = 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(codec.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[(doc_id, start)] = (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_whole_table_equals_the_library(spark, sf_dir):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows += [(10_000 + i, t) for i, t in enumerate(with_added(BYTE_BPE))]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files(documents(spark, rows)).collect()}
    codec, start, want = library(BYTE_BPE), 0, {}
    for doc_id, text in rows:
        ids = np.array(codec.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_empty_table(spark):
    assert token_files(documents(spark, [])).count() == 0
