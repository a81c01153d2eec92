import random

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import numbering
from quoteloom.operators.chunks import chunk_documents, chunk_spans, number_chunks, running_sum
from quoteloom.sources.tables import saved

from .conftest import exchanged

SCHEMA = "doc_id string, doc_order long, title string, text string"


def chunks(spark, texts, **options):
    docs = spark.createDataFrame([(f"d{i}", i, "t", t) for i, t in enumerate(texts)], SCHEMA)
    return sorted(chunk_documents(docs, **options).collect(), key=lambda c: (c.doc_order, c["index"]))


def test_slices_advance_without_gaps(spark):
    rng = random.Random(0)
    texts = ["", "   \n ", "x", "Short text."]
    texts += ["\n\n".join(f"Paragraph {i} says {'word ' * rng.randint(1, 30)}." for i in range(40))]
    texts += [" ".join(f"Sentence {i} ends here." for i in range(200)), "a" * 5000, "é😀. " * 400]
    found = chunks(spark, texts, target=300, overlap=60, least=40)
    for i, text in enumerate(texts):
        own = [c for c in found if c.doc_order == i]
        assert bool(own) == bool(text.strip())
        for c in own:
            assert c.text == text[c.start : c.end]
        for a, b in zip(own, own[1:]):
            assert a.start < b.start <= a.end or not text[a.end : b.start].strip()
        if own:
            assert not text[: own[0].start].strip() and not text[own[-1].end :].strip()
        assert all(c.end - c.start <= 300 + 60 + 300 for c in own)
    assert [c.chunk_id for c in found if c.doc_order == 3] == ["d3#0"]


def test_long_texts_are_cut_in_one_pass(spark):
    """each sentence and each passage was put behind a copy of all before, by column expressions that were a text's main cost."""
    n = 60_000
    df = spark.createDataFrame([("One two. " * n,)], "t string").select(chunk_spans(F.col("t"), 90, 0, 0).alias("s"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    spans = df.first().s
    assert len(spans) == n // 10 and [(s.start, s.end) for s in spans[:2]] == [(0, 89), (89, 179)] and spans[-1].end == 9 * n - 1


def test_short_last_passage_joins(spark):
    text = "A" * 90 + ".\n\n" + "B" * 90 + ".\n\n" + "tail."
    found = chunks(spark, [text], target=97, overlap=0, least=50)
    assert [(c.start, c.end) for c in found] == [(0, 91), (91, len(text))]


def test_numbers_follow_documents(spark):
    docs = spark.createDataFrame([(f"d{i}", i * 70_000, "t", "One. " * (i * 60)) for i in range(1, 6)], SCHEMA)
    rows = number_chunks(chunk_documents(docs, target=100, overlap=10)).collect()
    rows.sort(key=lambda r: (r.doc_order, r["index"]))
    assert [r.chunk_id for r in rows] == [f"c{i}" for i in range(len(rows))]


@pytest.mark.parametrize("parts", [1, 3, 7])
@pytest.mark.parametrize("in_order", [True, False])
def test_numbers_of_documents_in_any_layout(spark, parts, in_order):
    docs = spark.createDataFrame([(f"d{i}", i * 11 - 50, "t", "One. Two words. " * (i % 13)) for i in range(90)], SCHEMA)
    docs = docs.repartitionByRange(parts, "doc_order") if in_order else docs.repartition(parts, "doc_id")
    chunks_ = chunk_documents(docs, target=60, overlap=10, least=5)
    rows = sorted(number_chunks(chunks_).collect(), key=lambda r: (r.doc_order, r["index"]))
    assert [r.chunk_id for r in rows] == [f"c{i}" for i in range(len(rows))] and len(rows) > 90
    assert all(r.chunk_order == i and r.text for i, r in enumerate(rows))


def test_no_text_moves_where_documents_lie_in_order(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(numbering, "saved", lambda df, name: written.append(exchanged(df)) or saved(df, name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").alias("doc_order"), F.lit("t").alias("title"), "text")
    found = number_chunks(chunk_documents(docs))
    assert len(written) == 2 and "text" not in set.union(*written) | exchanged(found)
    assert found.where("text is null").count() == 0


def test_rows_out_of_order_are_dealt_when_they_are_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 100, str(i)) for i in range(100)], "k long, v string").repartition(4)
    assert {r.k: r.n for r in numbering.numbered(rows, ("k",), "n", "rows").collect()} == {i: i for i in range(100)}
    assert numbering.numbered(rows.limit(0), ("k",), "n", "rows").collect() == []


@pytest.mark.parametrize("ids", [list(range(50)), [7**k for k in range(20)] + [-5, -(2**61), 2**62, 2**62 + 1], [], [3]])
def test_running_sums_over_sparse_numbers(spark, ids):
    rows = [(i, n * 10 + 1) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "i long, v long")
    want, total = {}, 0
    for i, v in sorted(rows):
        want[i], total = total, total + v
    assert {r.i: r.before for r in running_sum(df, "i", "v", "before", stride=4096).collect()} == want
