import json
import random
from collections import deque

import pytest

from quoteloom.operators.scheduling import Budget
from quoteloom.streaming import stateful
from quoteloom.streaming.events import answered_to

CHUNKS = "stream string, seq long, chunk binary"
REQUESTS = "budget_key string, op string, id string, at_ms long, tokens long"


def run(spark, tmp_path, parts, schema, transform):
    """Each part arrives as a file and is read by a stream of its own that goes on from the last one's checkpoint; rows told by each."""
    told, seen = [], 0
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        answered_to(transform(stream), f"{tmp_path}/out").awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out/answers").collect()
        told.append(rows)
        assert len(rows) >= seen
        seen = len(rows)
    return told


def test_lines_cut_at_any_byte(spark, tmp_path):
    rng = random.Random(1)
    texts = {s: [json.dumps({"seq": i, "type": "scheduler", "label": "é😀—" * (i % 3)}, ensure_ascii=False) for i in range(20)] + ["", "{broken", "  "] for s in "ab"}
    chunks = []
    for s, lines in texts.items():
        raw = "\n".join(lines).encode() + b"\nunfinished"
        cuts = sorted(rng.sample(range(len(raw)), 30)) + [5, 5]
        cuts = [0, *sorted(cuts), len(raw)]
        chunks += [(s, i, bytearray(raw[a:z])) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    rng.shuffle(chunks)
    parts = [chunks[:20], chunks[20:45], chunks[45:] + chunks[:3]]  # out of order between batches, some twice
    told = run(spark, tmp_path, parts, CHUNKS, stateful.stream_lines)
    found = {(r.stream, r.line): r.text for r in told[-1]}
    assert len(found) == len(told[-1]) and found == {(s, i): x for s, lines in texts.items() for i, x in enumerate(lines)}
    assert len(told[0]) < len(told[-1])
    lines = spark.createDataFrame(told[-1])
    events = stateful.events_of(lines).collect()
    assert sorted((e.stream, e.seq, e.label) for e in events) == sorted((s, i, "é😀—" * (i % 3)) for s in "ab" for i in range(20))


def plain(requests, limit, window):
    """Answers by id, stepping through every millisecond."""
    out = {}
    for key in {r[0] for r in requests}:
        own = sorted((r for r in requests if r[0] == key), key=lambda r: (r[3], r[2], r[1]))
        held, queue = [], []
        for now in range(max(r[3] for r in own) + 1):
            ops = [r for r in own if r[3] == now]
            for op in [None, *ops]:
                if op and op[1] == "reserve" and op[4] > limit:
                    out[op[2]] = ("exceeds_ceiling", None)
                elif op and op[1] == "reserve":
                    queue.append((op[2], op[4]))
                elif op and op[1] == "release":
                    out |= {q[0]: ("released", None) for q in queue if q[0] == op[2]}
                    queue = [q for q in queue if q[0] != op[2]]
                    held = [e for e in held if e[0] != op[2]]
                elif op and op[1] == "reconcile":
                    held = [(i, at, max(n, op[4]) if i == op[2] else n) for i, at, n in held]
                while queue and sum(n for _, at, n in held if at > now - window) + queue[0][1] <= limit:
                    id_, n = queue.pop(0)
                    held.append((id_, now, n))
                    out[id_] = ("ok", now)
    return out


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(3)
    rows = []
    for key in "xyz":
        at = 1  # what is as old as the first watermark, 0, counts as late
        for i in range(40):
            at += rng.choice([0, 1, 5, 40, 2000])
            rows.append((key, "reserve", f"{key}{i:02}", at, rng.choice([1, 30, 60, 99, 101])))
            if rng.random() < 0.4:
                rows.append((key, rng.choice(["release", "reconcile"]), f"{key}{i:02}", at + rng.choice([1, 30, 500]), 80))
    return rows


def test_waiting_reservations_are_admitted_in_time(spark, tmp_path, requests):
    last = max(r[3] for r in requests)
    ticks = [(k, "tick", "", last + 10_000, 0) for k in "xyz"]
    rows = sorted(requests + ticks, key=lambda r: r[3])
    parts = [[r for r in rows if a <= r[3] < z] for a, z in ((0, last // 3), (last // 3, last // 2), (last // 2, last * 9))]
    told = run(spark, tmp_path, parts, REQUESTS, lambda s: stateful.stream_admissions(s, 100, 300))
    want = plain(rows, 100, 300)
    assert len(told[-1]) == len(want) and {r.id: (r.verdict, r.admitted_ms) for r in told[-1]} == want
    assert any(r.verdict == "ok" and r.admitted_ms > r.asked_ms for r in told[-1]) and {r.verdict for r in told[-1]} == {"ok", "exceeds_ceiling", "released"}


def test_a_timer_wakes_what_waits(spark, tmp_path):
    """No request of the budget comes any more; another budget's only moves the time on."""
    parts = [[("x", "reserve", "a", 1, 90), ("x", "reserve", "b", 10, 90), ("x", "reserve", "c", 20, 90)], [("y", "reserve", "d", 1_800, 1)], [("y", "tick", "", 90_000, 0)]]
    told = run(spark, tmp_path, parts, REQUESTS, lambda s: stateful.stream_admissions(s, 100, 500))
    assert [sorted((r.id, r.admitted_ms) for r in rows) for rows in told] == [[("a", 1)], [("a", 1), ("b", 501), ("d", 1800)], [("a", 1), ("b", 501), ("c", 1001), ("d", 1800)]]


def test_an_empty_window_equals_the_plain_budget(spark, tmp_path):
    rows = [("x", "reserve", str(i), i * 10 + 1, 10) for i in range(5)]
    told = run(spark, tmp_path, [rows], REQUESTS, lambda s: stateful.stream_admissions(s, 100, 500))
    budget = Budget(100, 500)
    assert {r.id: (r.verdict, r.admitted_ms) for r in told[-1]} == {i: (budget.reserve(i, n, at)[0], at) for _, _, i, at, n in rows}


def test_giving_up_is_no_search_of_the_line(tmp_path):
    """each release went through the whole line, so that a long one took the square of its length."""

    class Counted(str):
        compared = 0

        def __eq__(self, other):
            Counted.compared += 1
            return str.__eq__(self, other)

        def __ne__(self, other):
            Counted.compared += 1
            return str.__ne__(self, other)

        __hash__ = str.__hash__

    waiting = stateful.Waiting(10, 1000)
    waiting.held, waiting.spent, waiting.queue, waiting.waits, waiting.now, waiting.told = deque([["x", 0, 10]]), 10, deque(), {}, 0, []
    for i in range(2000):
        waiting._take("reserve", Counted(i), 1, 5)
    for i in range(0, 2000, 2):
        waiting._take("release", Counted(i), 2, 0)
    assert Counted.compared < 20_000 and len(waiting.told) == 1000
    waiting._advance(1000)
    assert waiting.told[-2:] == [("1", 1, 5, "ok", 1000), ("3", 1, 5, "ok", 1000)]


def test_an_id_that_waits_twice():
    waiting = stateful.Waiting(10, 1000)
    waiting.held, waiting.spent, waiting.queue, waiting.waits, waiting.now, waiting.told = deque(), 0, deque(), {}, 0, []
    for _ in range(3):
        waiting._take("reserve", "a", 0, 10)
    waiting._take("release", "a", 1, 0)
    assert waiting.told == [("a", 0, 10, "ok", 0), ("a", 0, 10, "released", None), ("a", 0, 10, "released", None)] and not waiting.held and waiting.spent == 0
