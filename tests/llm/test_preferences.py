import hashlib

from quoteloom.llm import preferences
from quoteloom.llm.preferences import common_prefix, completion, conversations, format_pairs, pairs_by_opening, pairs_by_reply, render, with_bounds

SCHEMA = "conv_id long, turn long, role string, text string"

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|end|>"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello <|end|>"), (2, 2, "user", "more"), (2, 3, "assistant", "short"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello <|end|>"), (3, 2, "user", "more"), (3, 3, "assistant", "long answer"),
    (4, 0, "system", None), (4, 1, None, "odd"),
    (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (5, 0, "user", "alone"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS turns", "2 AS opening", "3 AS weight", "'x' AS chosen")


def test_pairs_prompts_and_masks(spark):
    whole = conversations(table(spark, TURNS))
    pairs = pairs_by_opening(whole)
    assert sorted((r.chosen_id, r.rejected_id) for r in pairs.collect()) == [(1, 2), (1, 3)]
    rows = {r.rejected_id: r for r in format_pairs(whole, pairs).collect()}
    two = rows[2]
    assert two.prompt_turns == 3 and two.prompt.startswith("<|user|>\nhi<|end|>\n<|assistant|>\nhello < |end|><|end|>\n")
    assert two.chosen == "<|assistant|>\nlong answer<|end|>\n" and two.rejected == "<|assistant|>\nshort<|end|>\n"
    (span,) = two.chosen_loss
    assert two.chosen[span.start : span.end] == "long answer<|end|>\n"
    assert rows[3].chosen == rows[3].rejected == "" and not rows[3].chosen_loss


def test_given_pairs(spark):
    whole = conversations(table(spark, TURNS))
    given = spark.createDataFrame([("mine", 4, 5), ("mine", 4, 5), ("mine", 4, 99), ("mine", 5, 5)], "kind string, chosen_id long, rejected_id long")
    rows = {(r.chosen_id, r.rejected_id): r for r in with_bounds(format_pairs(whole, given)).collect()}
    assert set(rows) == {(4, 5), (5, 5)}
    r = rows[(4, 5)]
    assert r.prompt_turns == 0 and r.status == "no_prompt" and r.chosen_loss == "" and r.rejected.startswith("<|user|>\nalone")
    assert [r.rejected[int(a) : int(z)] for a, z in (x.split("-") for x in r.rejected_loss.split(","))] == ["b<|end|>\n"] * 2
    assert rows[(5, 5)].status == "no_loss" and rows[(5, 5)].prompt_turns == 3


def brute_replies(rows, bucket_size):
    """(chosen, giver of the rejected reply) by the rule, in plain Python."""
    talks = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        talks.setdefault(conv, []).append((role or "", text or ""))
    last = {c: [x for role, x in t if role == "assistant"][-1] for c, t in talks.items() if any(role == "assistant" for role, _ in t)}
    digits = 0
    while len(last) > bucket_size * 16**digits:
        digits += 1
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    found = set()
    for c, reply in last.items():
        near = [d for d in last if md5(d)[:digits] == md5(c)[:digits]]
        circle = sorted({md5(last[d]) for d in near})
        if len(circle) > 1:
            following = circle[(circle.index(md5(reply)) + 1) % len(circle)]
            found.add((c, min(d for d in near if md5(last[d]) == following)))
    return talks, last, found


def test_replies_are_exchanged(spark, monkeypatch):
    long = "word " * 100_000
    rows = TURNS + [(None, 0, "user", "lost"), (None, 1, "assistant", "nobody's"), (7, 0, "assistant", long), (8, 0, "user", long), (8, 1, "assistant", None)]
    rows += [(i, t, r, f"same {t}" if i % 3 else f"own {i} {t}") for i in range(20, 60) for t, r in enumerate(("user", "assistant", "user", "assistant", "user"))]
    for bucket, share in ((4096, 1024), (4, 2)):
        monkeypatch.setattr(preferences, "BUCKET", bucket)
        monkeypatch.setattr(preferences, "SHARE", share)
        talks, last, want = brute_replies(rows, bucket)
        whole = conversations(table(spark, rows))
        pairs = pairs_by_reply(whole)
        assert {(r.chosen_id, r.rejected_id) for r in pairs.collect()} == want and len(want) > 30
        got = format_pairs(whole, pairs).collect()
        assert len(got) == len(want)
        for r in got:
            talk = talks[r.chosen_id]
            at = max(i for i, t in enumerate(talk) if t[0] == "assistant")
            assert r.prompt_turns == at and r.prompt == "".join(map(render, talk[:at]))
            assert r.chosen == render(talk[at]) and r.rejected == render(("assistant", last[r.rejected_id])) and r.chosen != r.rejected
            assert [r.chosen[s.start : s.end] for s in r.chosen_loss] == [r.chosen.removeprefix("<|assistant|>\n")]
            assert r.status == ("ok" if at else "no_prompt")
        openings = pairs_by_opening(whole).collect()
        assert len(format_pairs(whole, pairs_by_opening(whole)).collect()) == len(openings) > 20


def test_ties_go_to_the_smallest_id(spark):
    rows = [(c, t, r, x) for c in (9, 3, 5) for t, (r, x) in enumerate((("user", "q"), ("assistant", "abc"[c % 3] * 4)))]
    assert sorted((r.chosen_id, r.rejected_id) for r in pairs_by_opening(conversations(table(spark, rows))).collect()) == [(3, 5), (3, 9)]


def test_parts():
    assert common_prefix([("a", "x")], [("a", "x"), ("b", "y")]) == 1
    assert completion([]) == ("", [])
    assert render(("user", "a<|b")) == "<|user|>\na< |b<|end|>\n"


def test_empty_table(spark):
    whole = conversations(table(spark, []))
    assert format_pairs(whole, pairs_by_opening(whole).union(pairs_by_reply(whole))).count() == 0
