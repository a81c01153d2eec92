import random
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import models, scheduling
from quoteloom.operators.scheduling import Budget, Outcome, Task, simulate


def tasks(n, cost, latency=40.0, outcome=None):
    return [Task(f"t{i}", cost, outcome or (lambda a, t: Outcome("done", latency, cost))) for i in range(n)]


def test_budget_window_slides():
    budget = Budget(1000, 60_000)
    assert budget.reserve("a", 600, 0)[0] == "ok" and budget.reserve("b", 400, 10_000)[0] == "ok"
    assert budget.reserve("c", 1, 59_999) == ("window_full", 60_000)
    assert budget.reserve("c", 600, 60_001)[0] == "ok" and budget.spent(60_001) == 1000
    assert budget.reserve("d", 1001, 0) == ("exceeds_ceiling", None)


def test_budget_reconcile_only_raises_and_release_frees():
    budget = Budget(1000, 60_000)
    budget.reserve("a", 500, 0)
    budget.reconcile("a", 100)
    assert budget.spent(0) == 500
    budget.reconcile("a", 900)
    budget.reconcile("zz", 5)
    assert budget.spent(0) == 900
    budget.release("zz")
    budget.release("a")
    assert budget.spent(0) == 0


@pytest.mark.parametrize(("n", "cost", "limit"), [(100, 250, 8000), (100, 368, 8000), (60, 300, 4000), (10, 400, 1000)])
def test_bursts_have_a_closed_form(n, cost, limit):
    budget = Budget(limit, 60_000)
    ended, counters = simulate(tasks(n, cost), budget=budget)
    assert [t.started[0] for t in ended] == [60_000 * (i // (limit // cost)) for i in range(n)]
    assert counters["completed"] == n and counters["peak_concurrency"] == min(n, limit // cost)


def test_window_is_never_exceeded():
    started = []
    simulate([Task(f"t{i}", 300, lambda a, t: started.append(t) or Outcome("done", 7000, 280)) for i in range(60)], budget=Budget(4000, 60_000))
    for now in started:
        assert 300 * sum(now - 60_000 < s <= now for s in started) <= 4000


def test_impossible_task_fails_at_once():
    ended, n = simulate([Task("big", 9000, lambda a, t: Outcome()), *tasks(2, 100)])
    assert ended[0].state == "failed" and "9000" in ended[0].error and n["completed"] == 2 and n["failed"] == 1


def test_refusals_are_retried_and_released():
    seen = set()

    def refused_once(i):
        def outcome(attempt, now):
            if i < 10 and attempt <= 4:
                seen.add(i)
                return Outcome("rate_limited", 10, 0, 5000, "slow down")
            return Outcome("done", 10, 100)

        return outcome

    jitter = cycle([0.1, 0.5, 0.9, 0.3, 0.7])
    ended, n = simulate([Task(f"t{i}", 100, refused_once(i)) for i in range(20)], jitter=lambda: next(jitter))
    assert (n["dispatched"], n["retries"], n["rate_limit_hits"], n["completed"]) == (60, 40, 40, 20)
    first = ended[0].started
    assert all(b - a >= 5000 for a, b in zip(first, first[1:]))


def test_failures_end():
    ended, n = simulate(tasks(3, 10, outcome=lambda a, t: Outcome("retryable", 5, error="busy")))
    assert all(t.state == "failed" and t.attempts == 5 and "after 5 attempt(s)" in t.error for t in ended) and n["retries"] == 12
    ended, n = simulate(tasks(3, 10, outcome=lambda a, t: Outcome("final", 5, error="no")))
    assert all(t.attempts == 1 for t in ended) and n["dispatched"] == 3


def test_width_and_attempt_costs():
    assert simulate(tasks(50, 10, 100.0), concurrency=7)[1]["peak_concurrency"] == 7
    _, n = simulate([Task("t", lambda a: 100 * a, lambda a, t: Outcome("done" if a == 2 else "retryable", 1, 50))])
    assert n["tokens_estimated"] == 300 and n["tokens_actual"] == 50


def test_cancel_and_shared_budget():
    ended, n = simulate(tasks(30, 1000, 10_000.0), cancel_at=5000)
    assert n["cancelled"] == 30 and n["tasks"] == n["completed"] + n["failed"] + n["cancelled"]
    assert {t.state for t in ended} == {"cancelled"}
    budget = Budget(1000, 60_000)
    simulate(tasks(3, 300), budget=budget)
    ended, _ = simulate(tasks(2, 300), budget=budget, start_ms=100)
    assert [t.started[0] for t in ended] == [60_000, 60_000]


def test_events_end_in_final_states():
    log = []
    simulate(tasks(40, 368), on_event=lambda now, t: log.append((now, t.id, t.state)))
    assert {s for _, _, s in log} == {"running", "waiting-budget", "done"}


def test_schedule_by_key(spark):
    rows = [(k, i, f"{k}{i}", 400, 350) for k in "ab" for i in range(5)]
    df = spark.createDataFrame(rows, "budget_key string, position long, task_id string, estimate long, tokens_used long")
    found = {r.task_id: r.started_ms for r in scheduling.schedule(df, window_tokens=1000).collect()}
    assert found == {f"{k}{i}": 60_000.0 * (i // 2) for k in "ab" for i in range(5)}


def test_schedule_with_outcomes_equals_the_simulation(spark):
    rng = random.Random(3)
    kinds = ("done", "done", "rate_limited", "retryable", "final")
    rows = []
    for key in "abc":
        for i in range(30):
            script = [(rng.choice(kinds), float(rng.randrange(1, 900)), rng.randrange(500), rng.choice([None, 300.0]), "e") for _ in range(rng.randrange(1, 4))]
            rows.append((key, i % 2, i, f"{key}{i}", rng.randrange(50, 400), rng.choice([None, 350]), script))
    outcome = "array<struct<kind:string,latency_ms:double,tokens:long,retry_after_ms:double,error:string>>"
    df = spark.createDataFrame(rows, f"budget_key string, phase int, position long, task_id string, estimate long, estimate_again long, outcomes {outcome}")
    limits = {"concurrency": 5, "window_tokens": 1000, "window_ms": 2000}
    for cancel in (None, 4000.0):
        found = {r.task_id: (r.state, r.attempts, r.ended_ms, r.error, r.tokens_used) for r in scheduling.schedule(df, **limits, cancel_at_ms=cancel).collect()}
        counted = {(r.budget_key, r.phase): r.asDict() for r in scheduling.schedule(df, **limits, cancel_at_ms=cancel, counters=True).collect()}
        for key in "abc":
            budget, now = Budget(1000, 2000), 0
            for phase in (0, 1):
                given = []
                for _, _, _, name, first, again, script in (r for r in rows if r[0] == key and r[1] == phase):
                    outs = [Outcome(k, ms, t, wait, e) for k, ms, t, wait, e in script]
                    given.append(Task(name, lambda a, f=first, g=again: f if a == 1 or g is None else g, lambda a, t, o=outs: o[min(a, len(o)) - 1]))
                ended, n = simulate(given, 5, budget, start_ms=now, cancel_at=cancel)
                now += n["wall_clock_ms"]
                assert all(found[t.id] == (t.state, t.attempts, t.ended, t.error, t.tokens) for t in ended)
                assert {c: counted[key, phase][c] for c in scheduling.COUNTERS} == n
                assert n["tasks"] == n["completed"] + n["failed"] + n["cancelled"]
        assert cancel is None or "cancelled" in {x[0] for x in found.values()}


def test_window_spent_without_key_equals_brute_force(spark):
    rows = [(i, (i * 7919) % 400_000, i % 50) for i in range(500)] + [(500, 60_000, 5), (501, 120_000, 5), (502, 119_999, 5)]
    df = spark.createDataFrame(rows, "id long, at_ms long, tokens long")
    for r in scheduling.window_spent(df).collect():
        assert r.spent == sum(t for _, at, t in rows if r.at_ms - 60_000 < at <= r.at_ms)


def test_reservations_as_tables(spark):
    held = spark.createDataFrame([("a", 0, 10), ("b", 50, 20)], "id string, at_ms long, tokens long")
    actual = spark.createDataFrame([("a", 5), ("b", 25), ("z", 9)], "id string, actual long")
    assert {r.id: r.tokens for r in scheduling.reconcile(held, actual).collect()} == {"a": 10, "b": 25}
    assert [r.id for r in scheduling.release(held, actual.where("id = 'a'")).collect()] == ["b"]
    assert [r.id for r in scheduling.live(held, 60_000).collect()] == ["b"]


def test_backoff(spark):
    rows = [(1, 0.0, None, 250.0), (1, 1.0, None, 500.0), (3, 0.5, None, 1500.0), (20, 1.0, None, 30_000.0), (1, 0.5, 2000, 2250.0), (9, 0.5, 2000, 2500.0), (2, 0.0, 0, 500.0)]
    df = spark.createDataFrame(rows, "a int, j double, r long, want double")
    for r in df.withColumn("d", scheduling.backoff_ms(F.col("a"), F.col("j"), F.col("r"))).collect():
        assert r.d == pytest.approx(r.want)


def test_board_histogram_ledger(spark):
    events = spark.createDataFrame([(1, "a", "label", "queued", 0), (3, "a", None, "done", 2), (2, "a", None, "running", 1), (4, "b", None, "failed", 1)], "seq long, task_id string, label string, state string, attempts int")
    rows = {r.task_id: (r.label, r.state, r.attempts) for r in scheduling.board(events).collect()}
    assert rows == {"a": ("label", "done", 2), "b": ("b", "failed", 1)}
    assert {r.state: r.n for r in scheduling.histogram(scheduling.board(events)).collect() if r.n} == {"done": 1, "failed": 1}
    ended = spark.createDataFrame([("a", "done", 2, 50), ("b", "failed", 1, 0)], "task_id string, state string, attempts int, tokens_used int")
    sent = spark.createDataFrame([(10,), (20,), (30,)], "estimate int")
    row = scheduling.ledger(sent, ended).first()
    assert (row.tasks, row.completed, row.failed, row.dropped, row.dispatched, row.tokens_estimated) == (2, 1, 1, 0, 3, 60)
    assert scheduling.clamped(500, 10) == (200, 500)


def test_models(spark):
    raw = '{"data":[{"id":"big-chat","context_window":131072,"owned_by":"x"},{"id":"a-chat","context_window":32768},{"id":"b-chat","context_window":32768},{"id":"whisper-l","context_window":99999},{"id":"tiny","context_window":4096},{"id":7,"context_window":99999},{"id":"odd","context_window":"x"},{"id":"text-embed","context_window":9999},{"id":"safeguard","context_window":9999}]}'
    fit = models.chat_models(models.read_catalogue(spark.createDataFrame([(raw,)], "raw string")))
    assert [(r.id, r.owned_by) for r in fit.orderBy("place").collect()] == [("big-chat", "x"), ("a-chat", "unknown"), ("b-chat", "unknown")]
    assert models.pick_model(fit, ["gone", "b-chat", "a-chat"]) == "b-chat" and models.pick_model(fit, ["gone"]) == "big-chat"
    with pytest.raises(LookupError):
        models.pick_model(fit.limit(0), ["a"])
    now, loads = [0.0], []
    catalogue = models.Catalogue(lambda: loads.append(1) or models.read_catalogue(spark.createDataFrame([(raw,)], "raw string")), ["a-chat"], ["b-chat"], "gone", lambda: now[0])
    assert (catalogue.models()["draft"], catalogue.models()["verify"], len(loads)) == ("a-chat", "b-chat", 1)
    now[0] = 301
    catalogue.models()
    assert len(loads) == 2
    catalogue.override = "big-chat"
    catalogue.reset()
    assert catalogue.models()["draft"] == "big-chat"


def test_waits_and_classes(spark):
    waits = {"12": 12_000.0, "1.5s": 1500.0, " 300ms ": 300.0, "2m": 120_000.0, "soon": None, "1.2.3": None, "": None}
    df = spark.createDataFrame([(k, v) for k, v in waits.items()], "raw string, want double")
    for r in df.withColumn("ms", models.retry_after_ms(F.col("raw"), F.lit(None).cast("string"))).collect():
        assert r.ms == r.want
    kinds = [(200, "", "ok"), (400, "json_validate_failed", "retryable"), (400, "x", "final"), (429, "", "rate_limited"), (503, "", "retryable"), (408, "", "retryable"), (404, "", "final"), (None, None, "retryable")]
    df = spark.createDataFrame(kinds, "s int, b string, want string")
    assert all(r.k == r.want for r in df.withColumn("k", models.classify(F.col("s"), F.col("b"))).collect())


def test_send_drops_refused_parameters():
    calls = []

    def call(body):
        calls.append(set(body))
        if "reasoning_effort" in body:
            return 400, "unknown parameter reasoning_effort"
        if "response_format" in body:
            return 400, {"error": "response_format is not supported"}
        return 200, {"usage": {"total_tokens": 7, "prompt_tokens": "x"}}

    status, reply = models.send(call, {"model": "m"}, effort="low")
    assert status == 200 and len(calls) == 3 and models.usage(reply) == {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 7}
    assert models.send(lambda b: (400, "bad request"), {}, effort="low")[0] == 400
