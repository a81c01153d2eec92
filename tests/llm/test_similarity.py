import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from quoteloom.llm import near_dedup
from quoteloom.llm.near_dedup import drop_near_copies
from quoteloom.llm.similarity import shingle_set, signatures, similar_links, similar_texts
from quoteloom.llm.simhash import fingerprint
from quoteloom.llm.store import written

from .helpers import documents


def edited(words, rng, n):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"edit{rng.integers(1 << 40)}"
    return " ".join(out)


def corpus():
    """Texts with copies of 1 to 12 edited words in 200, and copies of copies."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        rows.append(" ".join(words))
        for n in (1, 4, 5, 12):
            rows.append(edited(words, rng, n))
            rows.append(edited(rows[-1].split(), rng, 4))
    return list(enumerate(rows))


def brute_kept(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both + 1e-9 >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {rows[i][0] for i in range(len(rows)) if label[i] == i}


def test_stage_drops_copies_of_similarity_four_fifths(spark, sf_dir):
    rows = corpus()
    prints = [fingerprint(t.encode()) for _, t in rows]
    assert any((prints[0] ^ p).bit_count() > 4 for p in prints[1:6])
    want = brute_kept(rows)
    assert 12 <= len(want) < len(rows) - 20
    left = corpus_pipeline.near_dedup(spark, documents(spark, rows), sf_dir)
    assert {r.doc_id for r in left.collect()} == want


def test_links_connect_what_similar_pairs_connect_and_are_few():
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(300)]
    texts = [edited(base, rng, 2) for _ in range(150)] + [edited(base, rng, 40) for _ in range(20)]
    rows = list(enumerate(texts))
    pairs = similar_links([shingle_set(t.encode()) for t in texts], 0.8)
    assert len(pairs) < len(texts)
    assert set(range(len(texts))) - {a for a, _ in pairs} == brute_kept(rows)


def linked(spark, rows, **bounds):
    """Components of similar_texts by brute-force settling of its links."""
    plain = documents(spark, rows).select("doc_id", "text")
    nodes = written(signatures(plain, 5).select(F.col("doc_id").alias("node"), "name", "keys"), "test-nodes")
    label = {i: i for i, _ in rows}
    links = [(r.u, r.v) for r in similar_texts(plain, nodes, **bounds).collect()]
    assert all(u > v for u, v in links)
    for _ in rows:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_large_buckets_in_pieces_lose_no_link(spark):
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
    rows = [" ".join(words)]
    for _ in range(60):  # chains: later ones are far from the first
        rows.append(edited(rows[rng.integers(len(rows))].split(), rng, int(rng.integers(1, 5))))
    rows = list(enumerate(dict.fromkeys(rows)))
    want = linked(spark, rows)
    assert 1 < len({x for x in want.values()}) + 1 < len(rows)
    for bounds in ({"hold_bytes": 8_000}, {"hold_bytes": 2_500, "hold_members": 3}, {"hold_members": 10}):
        assert linked(spark, rows, **bounds) == want


def test_groups_of_buckets_find_what_each_bucket_finds(spark):
    rows = corpus()
    assert linked(spark, rows) == linked(spark, rows, group_bytes=0)
    assert len(set(linked(spark, rows, group_bytes=3_000).values())) == len(brute_kept(rows))


def test_stage_searches_fingerprints_and_confirms_on_whole_sets(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    rows = [" ".join(words)] + [edited(words, rng, n) for n in (1, 1, 2, 40, 120)] + ["two words", "x y z"]
    prints = [fingerprint(t.encode(), 5) for t in rows]
    rows = list(enumerate(rows))
    found = []
    monkeypatch.setattr(near_dedup, "similar_texts", lambda plain, nodes, *a, clusters: found.append((plain, nodes, clusters)) or similar_texts(plain, nodes, *a, clusters=clusters))
    assert {r.doc_id for r in drop_near_copies(documents(spark, rows), radius=8).collect()} == brute_kept(rows)
    plain, nodes, clusters = found[0]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    own = {r.node: r.least for r in nodes.collect()}
    got = {}
    for r in clusters.collect():
        got.setdefault(r.cluster, set()).add(own[r.node])
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1) != []
    # without any band the trees' clusters are still confirmed
    apart = nodes.withColumn("keys", F.array((F.col("node") + 1) * 1000))
    links = {(own[r.u], own[r.v]) for r in similar_texts(plain, apart, clusters=clusters).collect()}
    assert links and {max(p) for p in links} <= set(range(len(rows))) - brute_kept(rows)


def test_short_wordless_and_missing_texts(spark):
    rows = [(1, None), (2, " "), (3, "one two"), (4, "ONE two"), (5, "one three"), (None, "one two"), (None, "")]
    left = drop_near_copies(documents(spark, rows))
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, 5, None, None]


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "u v w x y z"), (2, None)]
    left = drop_near_copies(documents(spark, rows))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "a b c d e f"), (2, ""), (2, "u v w x y z")]
