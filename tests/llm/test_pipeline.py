import weakref

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest

from quoteloom.llm import decontamination, exact_dedup, language_id, packing, tokens
from quoteloom.llm.decontamination import decontaminate
from quoteloom.llm.queries import ORACLES, QUERIES

from .helpers import AWKWARD, documents
from .test_decontamination import brute as brute_hits
from .test_exact_dedup import bare
from .test_language_id import bare as letters
from .test_similarity import brute_kept


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if letters(r[1])]
    best = {}
    for doc_id, text in rows:
        key = bare(text)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(text), doc_id))
    keep = {v[1] for v in best.values()}
    rows = sorted(r for r in rows if r[0] in keep)
    kept = brute_kept(rows)  # the stage's rule: four fifths of five-word shingles
    rows = [r for r in rows if r[0] in kept]
    hits = brute_hits(rows, [(r.item_id, r.text) for r in bench.collect()])
    want = {h[0] for h in hits if not h[2]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_stages_take_awkward_rows(spark, sf_dir):
    docs = documents(spark, AWKWARD + [(i, f"word{i} and of the", "en") for i in range(20, 30)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_take_empty_tables(spark, sf_dir):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and decontaminate is not None


@pytest.mark.parametrize("then", ["packing", "merge", "decontamination"])
def test_a_worker_keeps_the_tables_of_one_stage(then, tmp_path):
    """Workers outlive a stage: what it left must not stay beside the tables of the next."""
    codec = weakref.ref(tokens.encoder(tokens.WORD_BPE))
    parser = weakref.ref(language_id._parser({"en": b"a word and another"}))
    assert codec() is None and parser() is not None
    assert language_id._parser({"en": b"a word and another"}) is parser()
    if then == "packing":
        tokens.encoder(tokens.WORD_BPE, batch_bytes=packing.PART_BYTES)
    elif then == "merge":
        list(exact_dedup._merge(iter([])))
    else:
        path = str(tmp_path / "block.parquet")
        pa.parquet.write_table(pa.table({"item_id": ["x"], "text": ["one two three"]}), path)
        decontamination.read_block(f"file://{path}", 10)
    assert parser() is None
