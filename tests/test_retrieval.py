import math

import pytest

from quoteloom.operators import scoring, stored_index
from quoteloom.operators.retrieval import asked_terms, corpus_stats, gate, indexed, search
from quoteloom.operators.stored_index import StoredIndex

from .conftest import exchanged, plan_of

CHUNKS = [
    ("c0", 0, "The moon orbits the planet slowly."),
    ("c1", 1, "Cheese ripens in cool caves."),
    ("c2", 2, "Moon moon moon: an orbit of the moon."),
    ("c3", 3, "Rivers carry water to the sea."),
    ("c4", 4, "Sea water is salty water."),
    ("c5", 5, "Rivers carry water to the sea."),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, o, 0, t) for i, o, t in CHUNKS]
    return indexed(spark.createDataFrame(rows, "chunk_id string, doc_order long, index int, text string"))


def ask(spark, index, *texts, k=6):
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    found = search(index, questions, k)
    return found.orderBy("question_id", "rank").collect(), gate(questions, found)


def test_ranking_and_coverage(spark, index):
    rows, _ = ask(spark, index, "moon orbit", "water")
    assert [r.chunk_id for r in rows if r.question_id == 0] == ["c2", "c0"]
    assert [r.coverage for r in rows if r.question_id == 0] == [1.0, 0.5]
    assert [r.chunk_id for r in rows if r.question_id == 1] == ["c4", "c3", "c5"]


def test_score_formula(spark, index):
    rows, _ = ask(spark, index, "cheese")
    avg = corpus_stats(index).first().avg_length
    idf = math.log(1 + (6 - 1 + 0.5) / 1.5)
    assert rows[0].score == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / avg)))


def test_limits_and_empties(spark, index):
    assert len(ask(spark, index, "water sea", k=2)[0]) == 2
    assert ask(spark, index, "the of and", "", "zzz")[0] == []
    none = index.limit(0)
    assert ask(spark, none, "water")[0] == []


def test_gate(spark, index):
    _, gated = ask(spark, index, "moon orbit", "quantum chromodynamics cheese lattice", "zzz")
    assert [r.relevant for r in gated.orderBy("question_id").collect()] == [True, False, False]


def stored(spark, path, rows, **options):
    return StoredIndex(spark, f"file://{path}", **options), [indexed(spark.createDataFrame([(i, o, t) for i, o, t in part], "chunk_id string, chunk_order long, text string"), order_cols=("chunk_order",)) for part in rows]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")


def test_additions_equal_one_index(spark, tmp_path):
    """Any number of additions, and all of them made one, give what a pass over all passages gives."""
    questions = asked(spark, "moon orbit", "water", "cheese caves sea", "zzz", "")
    index, parts = stored(spark, tmp_path / "a", [CHUNKS[:3], CHUNKS[3:4], [("c9", 9, ". !")], CHUNKS[4:]], buckets=4)
    assert index.search(questions).collect() == []
    told = []
    for n, part in enumerate(parts):
        index.append(part)
        whole = parts[0]
        for more in parts[1 : n + 1]:
            whole = whole.unionByName(more)
        told.append(sorted(index.search(questions).collect()))
        assert told[-1] == sorted(search(whole, questions).collect())
    assert len(told[0]) < len(told[-1])
    index.compact()
    assert index.segments().count() == 1 and sorted(index.search(questions).collect()) == told[-1]
    assert StoredIndex(spark, index.path, buckets=4).stats().first().n == 7


def test_a_generation_is_taken_once(spark, tmp_path):
    index, (part,) = stored(spark, tmp_path / "a", [CHUNKS])
    index.append(part)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index._publish(index.segments(), 0)
    (tmp_path / "a" / "generations" / "2").mkdir()  # of an attempt that failed
    assert index.stats().first().n == 6


def rows_scanned(spark, df):
    """Rows that a plan's scan of files puts out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    df = df.select("*")  # planned anew
    try:
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        metrics = [leaves.apply(i).metrics() for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("Scan")]
        return max(m.apply("numOutputRows").value() for m in metrics)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    index, (part,) = stored(spark, tmp_path / "a", [[(f"c{i}", i, " ".join(words[i : i + 5])) for i in range(396)]], buckets=16)
    index.append(part)
    found = index.postings(asked_terms(asked(spark, "word100 word101 nowhere")))
    assert len(found.collect()) == 10
    plan = plan_of(found)
    assert "PartitionFilters" in plan and "In(term, [" in plan
    assert rows_scanned(spark, found) <= 400 * 3 / 16 * 2
    assert rows_scanned(spark, index._blocks()) == 400


def test_a_common_term_is_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "BLOCK", 10)
    index, (part,) = stored(spark, tmp_path / "a", [[(f"c{i}", i, "common") for i in range(95)]])
    index.append(part)
    assert sorted(len(r.postings) for r in index._blocks().collect()) == [5] + [10] * 9
    assert index.search(asked(spark, "common"), 3).orderBy("rank").select("chunk_id").collect() == [("c0",), ("c1",), ("c2",)]


def test_only_the_best_of_each_task_leave_it(spark):
    """400 passages that all share the question's word are 400 rows before they are ranked, unless tasks keep the best."""
    rows = [(f"c{i}", i, 0, "common " * (1 + i % 3) + f"word{i}") for i in range(400)]
    found = search(indexed(spark.createDataFrame(rows, "chunk_id string, doc_order long, index int, text string").repartition(2)), asked(spark, "common", "common word7"), 3)
    assert not {"f", "terms", "parts"} & exchanged(found)
    ranked = {(r.question_id, r.rank): r.chunk_id for r in found.collect()}
    assert [ranked[0, k] for k in (1, 2, 3)] == ["c2", "c5", "c8"] and ranked[1, 1] == "c7"


def test_blocks_of_questions_equal_one(spark, monkeypatch, index):
    texts = ["moon orbit", "water sea", "cheese caves", "rivers carry water", "zzz"]
    whole = ask(spark, index, *texts)[0]
    monkeypatch.setattr(scoring, "BLOCK_TERMS", 2)
    assert ask(spark, index, *texts)[0] == whole


def test_postings_move_by_block_without_ids(spark, tmp_path, monkeypatch):
    """what an index and its search shuffle are terms of passages once and blocks of postings, never a row for each posting."""
    carried = []
    real = stored_index.StoredIndex._write
    monkeypatch.setattr(stored_index.StoredIndex, "_write", lambda self, blocks, segment: carried.append(exchanged(blocks)) or real(self, blocks, segment))
    index, (part,) = stored(spark, tmp_path / "a", [CHUNKS])
    index.append(part)
    assert carried and not {"chunk_id", "term", "f"} & carried[0]
    assert "chunk_id" not in index._blocks().schema.simpleString()
    with pytest.raises(Exception, match="places of their own"):
        index.append(stored(spark, tmp_path / "b", [[("c0", 1, "moon"), ("c1", 1, "sea")]])[1][0].coalesce(1))
