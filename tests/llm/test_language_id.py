import numpy as np

from quoteloom.llm.language_id import SLICE, Parser, bare, identify, keep_known, sample, suffix_automaton

from .helpers import AWKWARD, documents


def brute_phrases(text, sample):
    """Greedy longest phrases within slices, by substring search."""
    total = 0
    for at in range(0, len(text), SLICE):
        piece = text[at : at + SLICE]
        i = 0
        while i < len(piece):
            n = 1
            while i + n < len(piece) and piece[i : i + n + 1] in sample:
                n += 1
            total += 1  # a byte that the sample lacks is a phrase of its own
            i += n
    return total


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcbcabbac"
    steps = suffix_automaton(text)

    def accepts(word):
        state = 0
        for byte in word:
            if byte not in steps[state]:
                return False
            state = steps[state][byte]
        return True

    words = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(accepts(w) for w in words)
    rng = np.random.default_rng(0)
    for _ in range(500):
        word = bytes(rng.choice(list(b"abcd"), rng.integers(1, 6)).tolist())
        assert accepts(word) == (word in words)


def test_phrases_match_brute_force():
    samples = {"a": b"the cat sat on the mat", "b": b"der hund und die katze"}
    parser = Parser(samples)
    texts = [b"the hund sat", b"", b"zzz the", b"katze " * 200, b"x"]
    got = parser.phrases(texts, slices_at_once=2)
    for row, text in zip(got, texts):
        for column, name in enumerate(parser.languages):
            assert row[column] == brute_phrases(text, samples[name])


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify(docs).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    rows = [(i, "one two three the of and", "en") for i in range(20, 40)] + [(i, "eins zwei drei der die und", "de") for i in range(40, 60)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(documents(spark, AWKWARD + rows)).collect()}
    assert found[1] == found[2] == found[3] == found[10] == ("und", 0.0)
    assert found[4][0] == "en"
    assert len(identify(documents(spark, AWKWARD + rows)).collect()) == len(AWKWARD) + 40


def test_nothing_labelled_and_empty_table(spark):
    assert {r.lang_pred for r in identify(documents(spark, AWKWARD)).collect()} == {"und"}
    assert identify(documents(spark, [])).count() == 0


def test_keep_known_keeps_columns(spark):
    docs = documents(spark, AWKWARD + [(50, "one two", "en")])
    left = keep_known(docs, sample(docs.select("text", "lang")))
    assert left.columns == docs.columns
    assert {1, 2, 3, 10}.isdisjoint({r.doc_id for r in left.collect()})
    assert bare("A-b  C!") == b"a b c"
    assert len(keep_known(docs, {}).collect()) == len(AWKWARD) + 1 - 4


def test_many_labels_share_the_sample(spark):
    rows = [(i, f"word{i % 300} " * 200, f"l{i % 300:03}") for i in range(600)] + [(1000 + i, f"often {i}", "l299") for i in range(3)]
    labelled = documents(spark, rows).select("text", "lang")
    found = sample(labelled, texts=4, chars=100, most=20, all_chars=4 * 20 * 30)
    assert sorted(found) == [f"l{i:03}" for i in range(19)] + ["l299"]
    assert all(len(x) <= 4 * 31 for x in found.values())
    assert len(sample(labelled, texts=4, most=1000)) == 300
