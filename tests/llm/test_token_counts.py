from quoteloom.llm.token_counts import kept_at, lengths, quantiles, suffix_sums
from quoteloom.llm.tokens import BYTE_BPE

from .helpers import AWKWARD, documents
from .test_token_files import library, with_added


def test_sums_match_brute_force(spark, sf_dir):
    texts = [t for _, t in AWKWARD] + with_added(BYTE_BPE) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sizes = sorted(len(e.ids) for e in library(BYTE_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False))
    sums = suffix_sums(lengths(documents(spark, list(enumerate(texts))))).cache()
    for r in sums.collect():
        limit = r.context_limit
        assert r.documents == sizes.count(limit)
        assert r.documents_longer == sum(s > limit for s in sizes) and r.tokens_longer == sum(s for s in sizes if s > limit)
        assert r.tokens_kept == sum(min(s, limit) for s in sizes) and r.tokens_kept + r.tokens_dropped == sum(sizes)
    asked = [-1, 0, 1, 3, 9, 10, 1000, 20_000, 10**6]
    for r in kept_at(sums, asked).collect():
        if r.context_limit >= 0:
            assert r.tokens_kept == sum(min(s, r.context_limit) for s in sizes)
    for r in quantiles(sums, [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        need = max(1, -(-int(r.quantile * len(sizes) * 1000) // 1000))
        assert r.length == sizes[need - 1]


def test_empty_table(spark):
    sums = suffix_sums(lengths(documents(spark, [])))
    assert sums.count() == 0
    assert [r.tokens_kept for r in kept_at(sums, [5]).collect()] == [0]
