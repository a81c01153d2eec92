import re

import numpy as np

from quoteloom.llm import decontamination
from quoteloom.llm.decontamination import decontaminate, drop_contaminated, remove_contaminated, with_digest
from quoteloom.llm.fm_index import FMIndex, Wavelet, suffix_order

from .helpers import AWKWARD, documents


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()], key=str)


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    runs = [rng.integers(0, 5, rng.integers(1, 40)) for _ in range(60)] + [np.array([1, 2, 3, 1, 2])] * 5
    numbers, lengths = np.concatenate(runs), np.array([len(r) for r in runs])
    index = FMIndex(numbers, lengths, 5)
    phrases = rng.integers(0, 5, (200, 4))
    sizes = rng.integers(1, 5, 200)
    low, high = index.search(phrases, sizes)
    starts = np.cumsum(lengths + 1) - lengths - 1
    for p, m, a, z in zip(phrases, sizes, low, high):
        want = sorted(int(s) + i for r, s in zip(runs, starts) for i in range(len(r) - m + 1) if (r[i : i + m] == p[4 - m :]).all())
        assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_suffix_order_and_ranks():
    text = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 1, 4, 1, 0])
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    wavelet = Wavelet(text, 10)
    for symbol in range(10):
        places = np.arange(len(text) + 1)
        assert wavelet.rank(np.full(len(places), symbol), places).tolist() == [int((text[:p] == symbol).sum()) for p in places]


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (10, "ONE two, three four five six seven eight nine ten"),
    (2, "alpha beta"),
    (3, None),
    (4, " ?! "),
    (5, "one"),
    (5, "中文"),
    (None, "nbsp"),
]


def test_awkward_rows_match_brute_force(spark):
    items = [(i, t) for i, t in ITEMS if i is not None] + [("", "nbsp")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(decontaminate(documents(spark, AWKWARD), bench)) == brute(AWKWARD, items)


def test_small_blocks_and_shards_change_nothing(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS[:6], "item_id long, text string")
    want = found(decontaminate(documents(spark, AWKWARD), bench))
    blocks = decontamination.write_blocks
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 30)
    assert len(blocks(bench, "item_id", "text")) > 1
    assert found(decontaminate(documents(spark, AWKWARD), bench)) == want


def test_spans_are_merged(spark):
    docs = documents(spark, [(1, "x one two three four five six seven eight nine ten eleven y one")])
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    row = decontaminate(docs, bench).first()
    assert [(s.start, s.end) for s in row.spans] == [(1, 12)] and row.n_hit == 11


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(documents(spark, []), bench).count() == 0
    rows = with_digest(decontaminate(documents(spark, AWKWARD), bench.limit(0))).collect()
    assert len(rows) == len(AWKWARD) and not any(r.contaminated for r in rows)


def test_drop_contaminated_keeps_clean_rows_and_columns(spark):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    docs = documents(spark, AWKWARD)
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 5, 6, 7, 10, 11, None}


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before, {item.upper()}! after"), (2, f"{item} -- {item}; x"), (3, "clean text"), (4, None), (5, f"é {item.replace(' ', '  ')}é"), (6, item)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, rows)
    left = remove_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "Before, ! after", 2: "; x", 3: "clean text", 4: None, 5: f"é {item.replace(' ', '  ')}é", 6: ""}
