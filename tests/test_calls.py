import time

import pytest
from pyspark.sql import functions as F

from quoteloom.operators.calls import Limits, ask_models

REQUESTS = "key string, messages array<struct<role:string,content:string>>"
OK = {"model": "m", "choices": [{"message": {"content": "yes"}}], "usage": {"total_tokens": 7}}


def ask(spark, call, n, limits, estimate=50, **options):
    rows = [(f"k{i}", [("user", f"question {i}")]) for i in range(n)]
    called = ask_models(spark.createDataFrame(rows, REQUESTS).repartition(3), call, lambda a: F.lit(estimate) * a, lambda a: 100 * a, limits, **options)
    return {r.key: r for r in called.replies.collect()}, called.attempts.collect()


def spent(attempts, window_ms):
    """The most tokens that any window holds."""
    return max(sum(r.estimate for r in attempts if a.at_ms - window_ms < r.at_ms <= a.at_ms and r.kind != "rate_limited") for a in attempts)


def test_leases_keep_to_the_window_and_calls_overlap(spark):
    def slow(body, attempt):
        time.sleep(0.2)
        return 200, OK, {}

    limits = Limits(window_tokens=400, window_ms=700, in_flight=8, lanes=2)
    found, attempts = ask(spark, slow, 20, limits, json_mode=False)
    assert len(found) == 20 and all((r.state, r.raw, r.attempts, r.tokens_used) == ("done", "yes", 1, 7) for r in found.values())
    assert spent(attempts, 700) <= 400
    for lane in {r.lane for r in attempts}:
        own = sorted(r.at_ms for r in attempts if r.lane == lane)
        assert any(b - a < 150 for a, b in zip(own, own[1:]))  # sent before the one before was answered


def test_rounds_share_a_window(spark):
    """What a first round reserved counts in the second: here all fail once, and a window has room for six."""

    def busy_once(body, attempt):
        return (503, "busy", {}) if attempt == 1 else (200, OK, {})

    limits = Limits(window_tokens=600, window_ms=1500, lanes=1, backoff_base_ms=1)
    found, attempts = ask(spark, busy_once, 6, limits, estimate=100)
    assert all(r.attempts == 2 for r in found.values()) and spent(attempts, 1500) <= 600


def test_replies_are_classified_and_backed_off(spark):
    def call(body, attempt):
        i = int(body["messages"][0]["content"].split()[1])
        if i == 0 and attempt < 3:
            return 429, "slow down", {"retry-after": "0.3"}
        if i == 1:
            raise OSError("no route")
        if i == 2:
            return 401, "bad key", {}
        if i == 3 and attempt == 1:
            return 400, "Failed to generate JSON", {}
        if i == 4 and ("response_format" in body or "reasoning_effort" in body):
            return 400, "json_object and reasoning are unknown", {}
        return 200, OK | {"usage": {"total_tokens": body["max_completion_tokens"]}}, {}

    found, attempts = ask(spark, call, 6, Limits(window_tokens=10_000, max_attempts=3, backoff_base_ms=1), effort="low")
    told = {k: (r.state, r.kind, r.attempts, r.tokens_used, r.error) for k, r in found.items()}
    assert told == {
        "k0": ("done", "ok", 3, 300, None),
        "k1": ("failed", "retryable", 3, 0, "no route (after 3 attempt(s))"),
        "k2": ("failed", "final", 1, 0, "bad key (after 1 attempt(s))"),
        "k3": ("done", "ok", 2, 200, None),
        "k4": ("done", "ok", 1, 100, None),
        "k5": ("done", "ok", 1, 100, None),
    }
    waits = sorted(r.at_ms for r in attempts if r.key == "k0")
    assert all(b - a >= 300 for a, b in zip(waits, waits[1:]))


def test_what_no_window_holds_is_not_asked(spark):
    found, attempts = ask(spark, lambda b, a: (200, OK, {}), 2, Limits(window_tokens=100, max_attempts=1), estimate=101)
    assert attempts == [] and {(r.state, r.kind, r.attempts) for r in found.values()} == {("failed", "too_large", 0)}
    found, attempts = ask(spark, lambda b, a: (200, OK, {}), 0, Limits())
    assert found == {} and attempts == []


def test_lanes_leave_room_for_the_largest_request():
    limits = Limits(window_tokens=8000, in_flight=100, lanes=16)
    assert [limits.dealt(n) for n in (1, 500, 2500, 8000)] == [16, 16, 3, 1]
    assert Limits(in_flight=2).dealt(1) == 2
    with pytest.raises(ValueError, match="in_flight"):
        Limits(in_flight=0)
