import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from quoteloom.llm import attention, lm_scoring
from quoteloom.llm.attention import STRIDE, WINDOW, Attention, Classes, gathered, log_probabilities, make_classes, windows
from quoteloom.llm.lm_scoring import unpacked
from quoteloom.llm.tokens import WORD_BPE, Encoder
from quoteloom.llm.word_bpe import WordEncoder

from .helpers import AWKWARD, documents


def brute_base(rows):
    counts = Counter()
    bags = []
    for doc_id, text in rows:
        key = "" if doc_id is None else str(doc_id)
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        held_out = zlib.crc32(key.encode()) % 7 == 2
        bags.append((doc_id, words, held_out))
        if not held_out:
            counts.update(words)
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    return [(d, h, len(w) + 1, sum(counts[t] > 0 for t in [*w, None]), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in [*w, None])) for d, w, h in bags]


@pytest.mark.parametrize("block_bytes", [40, 16_000_000])
def test_base_scores_match_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
    rows = AWKWARD + [(i, f"word{i % 3} the of") for i in range(20, 40)]
    found = sorted(lm_scoring.score(documents(spark, rows).repartition(3)).collect(), key=str)
    want = sorted(brute_base(rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = []
    for deal, block_bytes in ((docs, 16_000_000), (docs.repartition(7, "text"), 16_000_000), (docs.orderBy(F.desc("doc_id")), 60_000)):
        monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(lm_scoring, "GROUP", 32)
        found.append({r.doc_id: (r.score, r.base_score) for r in lm_scoring.score(deal, share=4).collect()})
    for other in found[1:]:
        for doc_id, (score, base) in found[0].items():
            assert other[doc_id] == pytest.approx((score, base), rel=1e-4)


def test_score_beats_a_normalised_unigram_on_held_out_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    codec = Encoder(WORD_BPE)
    end, held, counts = codec.vocab_size, {}, Counter()
    words = list({w for _, text in rows for w in text.lower().split()})
    ids_of = dict(zip(words, (x.tolist() for x in codec.encode(words))))
    for doc_id, text in rows:
        ids = [i for w in text.lower().split() for i in ids_of[w]] + [end]
        if zlib.crc32(str(doc_id).encode()) % 7 == 2:
            held[doc_id] = ids
        else:
            counts.update(ids)
    total = sum(counts.values()) + end + 1
    unigram = sum(math.log10((counts[i] + 1) / total) for ids in held.values() for i in ids)
    found = {r.doc_id: r.score for r in lm_scoring.score(documents(spark, rows), share=4).collect() if r.held_out}
    assert set(found) == set(held) and sum(found.values()) > unigram


def test_every_training_document_can_teach(spark, monkeypatch):
    """With a share of one every window is trained on, once, in the first round."""
    monkeypatch.setattr(lm_scoring, "GROUP", 16)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(3 + i % 90))) for i in range(200)] + [(None, "a b c")]
    seen = []
    monkeypatch.setattr(lm_scoring, "train", lambda data, classes, rounds: seen.append((data.where("window is not null").collect(), classes)) or Attention(classes.count, classes.log_prior).flat())
    lm_scoring.score(documents(spark, rows), rounds=1, share=1).count()
    inputs, targets, live = unpacked([bytes(r.window) for r in seen[0][0]])
    teach = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    codec = Encoder(WORD_BPE)
    assert live.sum() == sum(1 + sum(len(codec.encode([w])[0]) for w in t.split()) for t in teach)
    assert (targets[live] == 0).sum() == len(teach)


def test_rounds_as_given_train_on_every_window(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(3 + i % 190))) for i in range(300)]
    seen = []
    monkeypatch.setattr(lm_scoring, "train", lambda data, classes, rounds: seen.append((data.where("window is not null").collect(), rounds)) or Attention(classes.count, classes.log_prior).flat())
    lm_scoring.score(documents(spark, rows)).count()
    (found, rounds), codec = seen[0], Encoder(WORD_BPE)
    _, _, live = unpacked([bytes(r.window) for r in found])
    teach = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert live.sum() == sum(1 + sum(len(codec.encode([w])[0]) for w in t.split()) for t in teach)
    assert {r.turn for r in found} == set(range(rounds))


def test_shifted_and_plain_exponentials_agree(monkeypatch):
    rng = np.random.default_rng(6)
    model = tiny(rng)
    inputs, targets = rng.integers(0, 8, (5, WINDOW)), rng.integers(0, 7, (5, WINDOW))
    live = rng.random((5, WINDOW)) < 0.8
    found = []
    for small in (True, False):
        monkeypatch.setattr(attention, "_small", lambda x, small=small: small)
        found.append([model.hidden(inputs), model.log_classes(inputs, targets, live), *model.step(inputs, targets, live)])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(*found))


def brute_log10(model, classes, ids):
    """log10 probability of one text by loops over windows, places and earlier places."""
    embed, place, wq, wk, wv, wo, u, b = (p.astype(np.float64) for p in model.params)
    kinds, total, at, start = [int(classes.of[i]) for i in ids], 0.0, 0, 0
    while at < len(ids):
        inputs = [classes.count if start == 0 else kinds[start - 1]] + kinds[start : start + WINDOW - 1]
        x = [embed[c] + place[j] for j, c in enumerate(inputs)]
        while at < min(len(ids), start + WINDOW):
            j = at - start
            q = x[j] @ wq
            weight = np.array([math.exp(q @ (x[i] @ wk) / math.sqrt(len(q))) for i in range(j + 1)])
            o = sum(w * (x[i] @ wv) for i, w in enumerate(weight)) / weight.sum()
            z = (x[j] + o @ wo) @ u + b
            before = classes.count if at == 0 else kinds[at - 1]
            total += z[kinds[at]] - math.log(np.exp(z).sum()) + classes.log_after[before, ids[at]]
            at += 1
        start += STRIDE
    return total / math.log(10)


def test_probabilities_match_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 9, (8, 40)).astype(float)
    classes = Classes(np.append(rng.integers(1, 7, 39), 0).astype(np.uint8), np.log(np.full(40, 0.1)).astype(np.float32), 7, np.log(np.full(7, 1 / 7))).with_pairs(pairs)
    model = tiny(rng)
    model.load(model.flat() + rng.standard_normal(model.flat().size).astype(np.float32) * 0.5)
    counts = np.array([1, 5, WINDOW, WINDOW + 1, 3 * WINDOW, 90])
    ids = rng.integers(0, 40, counts.sum())
    got = log_probabilities(model, classes, ids, counts, at_once=3)
    want = [brute_log10(model, classes, part) for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_extreme_logits_stay_finite():
    model = tiny(np.random.default_rng(5))
    model.params[-1] = np.full(7, -500, np.float32)
    model.params[2] *= 1000
    inputs, live = np.zeros((1, WINDOW), int), np.ones((1, WINDOW), bool)
    assert np.isfinite(model.log_classes(inputs, inputs, live)).all()


def test_empty_table(spark):
    assert lm_scoring.score(documents(spark, [])).count() == 0


def test_windows_score_each_token_once():
    for n in [*range(1, 120), 1000]:
        counts = np.array([n, 3, n])
        _, _, live, at = gathered(np.zeros(2 * n + 3, np.uint8), counts, 9)
        assert (np.bincount(at[live], minlength=2 * n + 3) == 1).all()
        assert len(windows(counts)[0]) == live.shape[0]


def tiny(rng, classes=7):
    prior = np.log(np.full(classes, 1 / classes))
    return Attention(classes, prior)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = tiny(rng)
    inputs, targets = rng.integers(0, 8, (2, WINDOW)), rng.integers(0, 7, (2, WINDOW))
    live = rng.random((2, WINDOW)) < 0.8
    model.params = [p.astype(np.float64) for p in model.params]
    grads = model.step(inputs, targets, live)
    loss = lambda: -model.log_classes(inputs, targets, live).mean()
    for p, g in zip(model.params, grads):
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(1)
    model = tiny(rng)
    inputs = rng.integers(0, 8, (1, WINDOW))
    changed = inputs.copy()
    changed[0, 20:] = 0
    assert np.allclose(model.hidden(inputs)[0, :20], model.hidden(changed)[0, :20])
    live = np.ones((1, WINDOW), bool)
    total = sum(np.exp(model.log_classes(inputs, np.full((1, WINDOW), c), live)) for c in range(7))
    assert np.allclose(total, 1, atol=1e-5)


def test_classes_share_out_all_probability():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 500, 3000)
    classes = make_classes(counts, rng.integers(0, 30, (3000, 16)))
    total = np.bincount(classes.of, np.exp(classes.log_share.astype(float)), minlength=classes.count)
    assert np.allclose(total[total > 0], 1, atol=1e-3) and classes.of[-1] == 0 and (classes.of[:-1] > 0).all()


def test_training_beats_the_untrained_model():
    tokens = np.tile([1, 2, 3, 4, 5], 2000)
    classes = Classes(np.arange(6, dtype=np.uint8), np.zeros(6, np.float32), 6, np.log(np.full(6, 1 / 6)))
    counts = np.full(20, 500)
    model = Attention(6, classes.log_prior)
    before = log_probabilities(model, classes, tokens, counts).sum()
    inputs, targets, live, _ = gathered(classes.of[tokens], counts, 6)
    for _ in range(10):
        model.train(inputs, targets, live)
    assert log_probabilities(model, classes, tokens, counts).sum() > before / 4


def test_words_and_windows_are_packed(spark, tmp_path, monkeypatch):
    """A block's words are a row a bucket, and windows a row a bucket of groups, not a row each."""
    monkeypatch.setattr(lm_scoring, "WORD_BUCKETS", 16)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(100)]
    words = lm_scoring.write_blocks(documents(spark, rows).coalesce(1), f"file://{tmp_path}/blocks", WORD_BPE, "doc_id", "text").collect()
    assert sorted(r.bucket for r in words) == list(range(-1, 16))
    assert sorted(w for r in words for w in bytes(r.words).split()) == sorted(w.encode() for _, t in rows for w in t.split())
    seen = []
    monkeypatch.setattr(lm_scoring, "train", lambda data, classes, rounds: seen.extend(data.where("window is not null").collect()) or Attention(classes.count, classes.log_prior).flat())
    lm_scoring.score(documents(spark, rows).coalesce(1)).count()
    assert len(seen) == lm_scoring.ROUNDS and len(unpacked([bytes(r.window) for r in seen])[0]) > 100


def test_buckets_that_are_cut_into_batches(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(30))) for i in range(60)]
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 90)
    want = sorted(brute_base(rows))
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(small)
    spark.conf.set(small, "2")
    try:
        for buckets in (1, 3):
            monkeypatch.setattr(lm_scoring, "WORD_BUCKETS", buckets)
            monkeypatch.setattr(lm_scoring, "GROUP_BUCKETS", buckets)
            monkeypatch.setattr(lm_scoring, "GROUP", 8)
            found = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_scoring.score(documents(spark, rows).repartition(4)).collect())
            for a, b in zip(found, want, strict=True):
                assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    finally:
        spark.conf.set(small, before)


def test_order_of_windows_depends_on_their_bytes_alone():
    rng = np.random.default_rng(8)
    packed = rng.integers(0, 3, (500, lm_scoring.PACKED)).astype(np.uint8)
    packed[:, 1:4] = 0  # three hashes
    found = [lm_scoring.in_order(packed[rng.permutation(500)].reshape(-1), 2) for _ in range(3)]
    assert all((rows == found[0][0]).all() and (group == found[0][1]).all() for rows, group in found)
    assert sorted(map(bytes, found[0][0])) == sorted(map(bytes, packed)) and (np.diff(found[0][1]) >= 0).all()


def test_words_encoded_at_once_equal_the_librarys(sf_dir):
    codec = Encoder(WORD_BPE)
    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    words = {w for t in texts for w in (t or "").lower().split()}
    words |= {"a", "z.", "é", "ÀÉÞ", "ß,", "×", "÷.", "x..", ".", ",", "it's", "3.5", "中文", "naïve.", "x" * 64, "ab" * 33, "ꟃ", "Ç", "ﬁ", "<|endoftext|>", "é"}
    column = pa.array([w.encode() + b" " for w in sorted(words)], pa.binary())
    for some in (column, column.slice(3, 50), column[:0]):
        ids, counts = WordEncoder(codec).encode(some, tail=1)
        units = [w[:-1].decode() for w in some.to_pylist()]
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])][: len(units)] == [codec._library([u])[0] for u in units]
