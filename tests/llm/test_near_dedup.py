import re

import numpy as np
import xxhash

from quoteloom.llm import components
from quoteloom.llm.bk_tree import Forest, dense, settle
from quoteloom.llm.components import stars
from quoteloom.llm.near_dedup import blocks, drop_near_copies, masks_for, near_components, near_links, shard_links
from quoteloom.llm.simhash import fingerprint

from .helpers import AWKWARD, documents


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(values, radius=4):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def clustered(rng, n):
    """Fingerprints with chains and dense clusters of near ones."""
    centres = rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)
    out = list(centres)
    while len(out) < n:
        value = int(out[rng.integers(len(out))])
        for bit in rng.integers(0, 64, rng.integers(1, 7)):
            value ^= 1 << int(bit)
        out.append(value)
    return np.unique(np.array(out, dtype=np.uint64))


def test_fingerprints_match_brute_force():
    for _, text in AWKWARD:
        assert fingerprint(text.encode() if text else None) == brute_fingerprint(text)
    assert fingerprint(b"a b c d e f g h" * 50, block=3) == fingerprint(b"a b c d e f g h" * 50)


def test_forest_finds_every_pair_in_its_shard():
    rng = np.random.default_rng(1)
    values = clustered(rng, 300)
    shard = np.sort(rng.integers(0, 3, len(values)))
    pairs = {(int(a), int(b)) for q, at in Forest(shard, values).links(4) for a, b in zip(q, at)}
    want = {
        (i, j) for i in range(len(values)) for j in range(i) if shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= 4
    }
    assert pairs == want


def test_settle_and_dense_agree_with_brute_force():
    rng = np.random.default_rng(2)
    values = clustered(rng, 400)
    pairs = Forest(np.zeros(len(values), int), values).links(4)
    want = brute_labels(values)
    assert (settle(len(values), pairs) == want).all()
    assert (dense(values, 4) == want).all()


def test_large_shards_are_cut_further_without_loss():
    rng = np.random.default_rng(3)
    values = clustered(rng, 1500)
    pairs = shard_links(np.zeros(len(values), np.int64), values, 4, np.zeros(len(values), np.uint64))
    assert (settle(len(values), [(np.maximum(a, b), np.minimum(a, b)) for a, b in pairs]) == brute_labels(values)).all()


def test_masks_cover_every_link_at_every_size():
    assert sum(blocks(list(range(64)), 5)) == (1 << 64) - 1
    rng = np.random.default_rng(4)
    for nodes in (10, 10**6, 10**9, 10**12):
        masks = masks_for(nodes, 4)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flip & m for m in masks)


def test_links_and_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    values = clustered(rng, 600)
    signed = values.view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    label = brute_labels(values)
    for hold in (400_000, 12):  # at once, and in pieces that meet two by two
        star = {r.u: r.v for r in stars(near_links(nodes, len(values), 4, hold)).collect()}
        for want in np.unique(label):
            members = signed[label == want].tolist()
            assert {star.get(m, m) for m in members} == {min(members)}


def test_hubs_and_chains_become_stars(spark):
    rng = np.random.default_rng(8)
    edges = [(i, 0) for i in range(1, 400)] + [(1000 + i, 999 + i) for i in range(1, 60)] + [(2000 + i, 100 + i) for i in range(50)]
    edges += [(5000, i) for i in range(3000, 3200)] + [(int(a), int(b)) for a, b in np.sort(rng.integers(6000, 6300, (250, 2)))[:, ::-1] if a != b]
    found = {r.u: r.v for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        before = dict(label)
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
        if before == label:
            break
    assert {x: found.get(x, x) for x in label} == label


def test_few_links_need_no_rounds(spark, monkeypatch):
    edges = [(i + 1, i) for i in range(-30, 300)] + [(1000 + i, 500) for i in range(50)] + [(5, 3), (1 << 62, -(1 << 62))]
    links = spark.createDataFrame(edges, "u long, v long")
    by_rounds = {tuple(r) for r in stars(links, one_task=0).collect()}
    partly = {tuple(r) for r in stars(links, one_task=len(edges) - 2).collect()}
    monkeypatch.setattr(components, "_large_star", None)
    assert {tuple(r) for r in stars(links).collect()} == by_rounds == partly
    assert (300, -30) in by_rounds and (1 << 62, -(1 << 62)) in by_rounds


def test_awkward_documents(spark):
    rows = {(r.doc_id, r.component_id) for r in near_components(documents(spark, AWKWARD)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (5, 5), (6, 5), (8, 8), (9, 8)} <= rows
    assert len(near_components(documents(spark, AWKWARD)).collect()) == len(AWKWARD)


def test_empty_table_and_no_links(spark):
    assert near_components(documents(spark, [])).count() == 0
    assert near_components(documents(spark, [(1, "a b c d e"), (2, "v w x y z")])).count() == 2


def test_drop_near_copies_keeps_the_smallest_id(spark):
    docs = documents(spark, [(3, "a b c d e f"), (1, "A b c d e f"), (2, "w x y z q r")])
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]
