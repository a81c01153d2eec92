import random

import pytest
from pyspark.sql import functions as F

from quoteloom.functions.text import fold_map
from quoteloom.operators import relocation
from quoteloom.operators.chunks import chunk_documents, number_chunks
from quoteloom.operators.relocation import relocate
from quoteloom.operators.verification import verify
from quoteloom.sources.tables import saved

from .conftest import plan_of

ONE = (
    "The lighthouse was built in 1872\nby a crew of forty men. It’s twelve storeys high, and cost 3.5 million.\n\n"
    "Its lamp burned oil until 1931, when it was wired.\n\nNobody has lived there since the last keeper, Anna Ó Briain, left."
)
TWO = "A second tower stands on the northern cape. Its lamp burned gas for a while. The lighthouse was built in 1872 by a crew of forty men too."


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("a", 0, "A", ONE), ("b", 1, "B", TWO)], "doc_id string, doc_order long, title string, text string")
    return docs, number_chunks(chunk_documents(docs, target=120, overlap=30, least=20)).cache()


def check(spark, corpus, chunk_id, quote, **options):
    claims = spark.createDataFrame([(1, "Claim.", chunk_id, quote)], "claim_id long, text string, chunk_id string, quote string")
    return verify(*corpus, claims, **options).first()


@pytest.mark.parametrize(
    ("chunk", "quote", "reason"),
    [
        (None, "built in 1872 by a crew", "no_citation"), ("c0", None, "no_citation"), ("c0", "  ", "no_citation"), ("zz", "built in 1872 by a crew", "missing_source"),
        ("c0", "built in 1872", "quote_too_short"), ("c0", "a b c d e", "quote_too_short"), ("c0", "built in 1873 by a crew of forty men", "quote_not_found"),
        ("c0", "The lighthouse was built in 1872 by a crew of sixty men", "quote_not_found"),
        ("c0", "built in 1872 by a crew of forty men who sang", "quote_not_found"),
    ],
)
def test_rejections(spark, corpus, chunk, quote, reason):
    row = check(spark, corpus, chunk, quote)
    assert (row.status, row.reason, row.span_start, row.relocated) == ("unverified", reason, None, False) and row.detail


@pytest.mark.parametrize(
    "quote",
    ["built in 1872 by a crew of forty men", "BUILT IN 1872   BY A CREW OF FORTY MEN", "it's twelve storeys high, and cost 3.5", "built, in 1872; by a crew: of forty men!"],
)
def test_presentation_does_not_matter(spark, corpus, quote):
    row = check(spark, corpus, "c0", quote)
    assert row.status == "verified" and not row.relocated and row.span_doc_id == "a"
    assert fold_map(row.source_text)[0] == fold_map(quote)[0]
    assert ONE[row.span_start : row.span_end] == row.source_text


def test_words_may_be_cut_at_the_ends(spark, corpus):
    assert check(spark, corpus, "c0", "ghthouse was built in 1872 by a cr").status == "verified"


def test_relocation_prefers_the_cited_document(spark, corpus):
    chunks = {c.chunk_id: c for c in corpus[1].collect()}
    last_b = max((c for c in chunks.values() if c.doc_id == "b"), key=lambda c: c["index"])
    row = check(spark, corpus, "c0", "Its lamp burned gas for a while")
    assert row.relocated and row.span_doc_id == "b" and row.chunk_id == "c0"
    row = check(spark, corpus, last_b.chunk_id, "Anna O Briain, left")
    assert row.relocated and row.span_doc_id == "a" and row.verified_chunk_id != last_b.chunk_id
    first_b = min((c for c in chunks.values() if c.doc_id == "b"), key=lambda c: c["index"])
    assert check(spark, corpus, first_b.chunk_id, "was built in 1872 by a crew of forty men").span_doc_id == "b"
    off = check(spark, corpus, "c0", "Its lamp burned gas for a while", allow_relocation=False)
    assert off.reason == "quote_not_found"


def test_options(spark, corpus):
    assert check(spark, corpus, "c0", "built in 1872", min_quote_words=3, min_quote_chars=5).status == "verified"
    with pytest.raises(ValueError, match="three words"):
        check(spark, corpus, "c0", "built in", min_quote_words=2)


def test_empty_corpus(spark, corpus):
    docs, chunks = corpus
    assert check(spark, (docs.limit(0), chunks.limit(0)), "c0", "built in 1872 by a crew").reason == "missing_source"


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_relocation_equals_the_nested_loop(spark, monkeypatch, block):
    monkeypatch.setattr(relocation, "BLOCK_CHARS", block)
    rng = random.Random(0)
    words = ["ab", "abc", "b", "cab", "x", "yx", "zz", "Éa", "1"]
    bodies = [" ".join(rng.choice(words) + rng.choice(["", "", ",", " —"]) for _ in range(60)) for _ in range(40)] + ["", "ab", "ab b"]
    folded = [fold_map(b)[0] for b in bodies]
    docs = spark.createDataFrame([(f"d{i}", i, b) for i, b in enumerate(bodies)], "doc_id string, doc_order long, text string").repartition(5)
    quotes = []
    for i in range(150):
        body = rng.choice(folded[:40])
        a = rng.randrange(len(body) - 30)
        quote = body[a : a + rng.randint(6, 30)].strip()
        if len(quote.split()) >= 3:
            quotes += [(10 * i + k, quote, f"d{rng.randrange(43)}") for k in range(1 + i % 3)]  # some quotes are claimed again
    quotes += [(5000, "ab b x nowhere at all", "d1"), (5001, "ab b x nowhere at all", None)]
    lost = spark.createDataFrame(quotes, "claim_id long, folded string, cited_doc string").repartition(3)
    found = {r.claim_id: r for r in relocate(lost, docs).collect()}
    for i, quote, cited in quotes:
        hits = [d for d, b in enumerate(folded) if quote in b]
        if not hits:
            assert i not in found
            continue
        d = int(cited[1:]) if cited and int(cited[1:]) in hits else min(hits)
        row = found[i]
        assert (row.doc_id, row.hit) == (f"d{d}", folded[d].index(quote) + 1)
        assert row.source_text == bodies[d][row.span_start : row.span_end] and fold_map(row.source_text)[0] == quote


def test_quotes_that_share_all_their_runs(spark):
    """Every place of the text meets every quote of one word repeated; all are told apart."""
    docs = spark.createDataFrame([(i, i, "la " * n) for i, n in enumerate((3, 50, 20))], "doc_id long, doc_order long, text string")
    lost = spark.createDataFrame([(n, " ".join(["la"] * n), None) for n in range(3, 60)], "claim_id long, folded string, cited_doc long")
    found = {r.claim_id: r.doc_id for r in relocate(lost, docs).collect()}
    assert found == {n: 0 if n == 3 else 1 for n in range(3, 51)}


def test_no_text_of_documents_is_shuffled(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(relocation, "saved", lambda df, name: plans.append((name, plan_of(df))) or saved(df, name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").alias("doc_order"), "text")
    lost = spark.createDataFrame([(1, "words that nobody wrote", 3)], "claim_id long, folded string, cited_doc long")
    assert relocate(lost, docs).count() == 0
    scan = dict(plans)["found"]
    assert "MapInArrow" in scan and "Exchange" not in scan and "Generate" not in scan


def test_no_quotes(spark):
    docs = spark.createDataFrame([(1, 1, "some text of five words")], "doc_id long, doc_order long, text string")
    lost = spark.createDataFrame([], "claim_id long, folded string, cited_doc long")
    assert relocate(lost, docs).collect() == []
    assert relocate(lost.union(spark.createDataFrame([(1, "some text", None)], lost.schema)), docs).collect() == []  # no inner word
