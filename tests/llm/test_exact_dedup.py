import hashlib

from pyspark.sql import functions as F

from quoteloom.llm.exact_dedup import digests, drop_copies, exact_dedup, tree_merge
from quoteloom.llm.store import suspected

from .helpers import AWKWARD, DOCS, documents


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), doc_id if doc_id is not None else 1 << 63, doc_id))
    out = []
    for doc_id, text in rows:
        group = groups[bare(text)]
        keep = min(group)[2]
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(bare(text).encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_awkward_rows_match_brute_force(spark):
    assert found(exact_dedup(documents(spark, AWKWARD))) == brute(AWKWARD)


def test_many_runs_many_rounds_small_batches(spark):
    rows = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(900)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        result = exact_dedup(documents(spark, rows).repartition(20), fan_in=2)
        assert found(result) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_group_of_copies_is_one_record_for_each_run(spark):
    docs = documents(spark, [(i, "same") for i in range(500)]).repartition(8)
    merged = tree_merge(digests(docs)).collect()
    assert [(r.keep_id, r.group_size, r.best_rows) for r in merged] == [(0, 500, 1)]


def test_empty_table(spark):
    assert exact_dedup(documents(spark, []).select("doc_id", "text")).count() == 0


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, AWKWARD)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert len(kept) == len({bare(t) for _, t in AWKWARD})
    assert sorted(k[0] for k in kept if k[1] and k[1].startswith(("one two", "ONE"))) == [8, 9]
    assert DOCS.split()[0] in left.columns


def test_rows_that_surely_stay_are_told_from_others(spark):
    rows = [(i, "t") for i in range(0, 4000, 3)] + [(None, "t"), (-5, "u"), (2**62, "v")]
    docs = documents(spark, rows).withColumn("_map", F.lit(1)).withColumn("_bits", F.lit(2))
    ids = {i for i, _ in rows if i is None or i % 5 == 0}
    clear, others = suspected(docs, F.col("doc_id"), spark.createDataFrame([(i,) for i in ids], "gone long"))
    assert clear.columns == others.columns == docs.columns
    kept, moved = [r.doc_id for r in clear.collect()], [r.doc_id for r in others.collect()]
    assert sorted(kept + moved, key=str) == sorted((i for i, _ in rows), key=str)
    assert ids <= set(moved) and len(moved) < len(ids) + 5
    assert suspected(docs, F.col("doc_id"), spark.createDataFrame([], "gone long"))[0].count() == len(rows)
