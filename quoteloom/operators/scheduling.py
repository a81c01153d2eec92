"""Rolling token budgets, back-off, and the simulation of a rate-limited run."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BACKOFF_BASE_MS, BACKOFF_MAX_MS, CONCURRENCY, CONCURRENCY_MOST, MAX_ATTEMPTS, RETRY_JITTER_MS, STATES, WINDOW_MS, WINDOW_TOKENS, WINDOW_TOKENS_LEAST


def clamped(concurrency: int = CONCURRENCY, window_tokens: int = WINDOW_TOKENS) -> tuple[int, int]:
    """A run's limits within what is allowed."""
    return max(1, min(CONCURRENCY_MOST, concurrency)), max(WINDOW_TOKENS_LEAST, window_tokens)


def window_spent(reservations: DataFrame, window_ms: int = WINDOW_MS, key: str | None = None) -> DataFrame:
    """Reservations (at_ms, tokens) with the tokens spent in the window that ends with each.

    A reservation exactly one window old no longer counts.  Without a ``key``
    column one budget covers all rows: time is cut into windows, as what a row
    counts lies in its own window of time or the one before, so that tasks hold
    a window's rows and not everything.
    """
    frame = (-(window_ms - 1), 0)
    if key:
        return reservations.withColumn("spent", F.sum("tokens").over(Window.partitionBy(key).orderBy("at_ms").rangeBetween(*frame)))
    cell = ((F.col("at_ms") - F.pmod(F.col("at_ms"), F.lit(window_ms))) / window_ms).cast("long")
    twice = reservations.withColumn("_cell", F.explode(F.array(cell, cell + 1))).withColumn("_own", F.col("_cell") == cell)
    summed = twice.withColumn("spent", F.sum("tokens").over(Window.partitionBy("_cell").orderBy("at_ms").rangeBetween(*frame)))
    return summed.where("_own").drop("_cell", "_own")


def backoff_ms(attempt: Column, jitter: Column, retry_after_ms: Column, base: int = BACKOFF_BASE_MS, most: int = BACKOFF_MAX_MS) -> Column:
    """Delay before another attempt: a server's own wish with a little jitter, or a doubling delay of which half is jitter."""
    doubling = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    asked = retry_after_ms + jitter * F.least(doubling, F.lit(float(RETRY_JITTER_MS)))
    return F.when(F.coalesce(retry_after_ms, F.lit(0)) > 0, asked).otherwise(doubling * (0.5 + 0.5 * jitter))


@dataclass
class Budget:
    """Tokens reserved in a sliding window of time."""

    limit: int
    window_ms: int
    entries: list[list] = field(default_factory=list)  # [id, at, tokens]

    def live(self, now: float) -> list[list]:
        self.entries = [e for e in self.entries if e[1] > now - self.window_ms]
        return self.entries

    def spent(self, now: float) -> int:
        return sum(e[2] for e in self.live(now))

    def reserve(self, key: str, tokens: int, now: float) -> tuple[str, float | None]:
        """("ok" | "exceeds_ceiling" | "window_full", when to try again)."""
        if tokens > self.limit:
            return "exceeds_ceiling", None
        if self.spent(now) + tokens > self.limit:
            return "window_full", (self.entries[0][1] if self.entries else now) + self.window_ms
        self.entries.append([key, now, tokens])
        return "ok", None

    def reconcile(self, key: str, actual: int) -> None:
        """Raise a reservation to what was used; it is never lowered, and its time stays."""
        for e in self.entries:
            if e[0] == key:
                e[2] = max(e[2], actual, 0)
                return

    def release(self, key: str) -> None:
        for i, e in enumerate(self.entries):
            if e[0] == key:
                del self.entries[i]
                return


@dataclass
class Outcome:
    """What an attempt comes to: done, rate_limited, retryable or final, after some time."""

    kind: str = "done"
    latency_ms: float = 0
    tokens: int = 0
    retry_after_ms: float | None = None
    error: str = ""


@dataclass
class Task:
    id: str
    estimate: int | Callable[[int], int]
    outcome: Callable[[int, float], Outcome]
    state: str = "queued"
    attempts: int = 0
    error: str = ""
    tokens: int = 0
    started: list[float] = field(default_factory=list)
    ended: float | None = None

    def tokens_for(self, attempt: int) -> int:
        return self.estimate(attempt) if callable(self.estimate) else self.estimate


COUNTERS = ("tasks", "dispatched", "completed", "failed", "cancelled", "retries", "rate_limit_hits", "budget_waits", "peak_concurrency", "wall_clock_ms", "tokens_estimated", "tokens_actual")


def simulate(
    tasks: Iterable[Task],
    concurrency: int = CONCURRENCY,
    budget: Budget | None = None,
    max_attempts: int = MAX_ATTEMPTS,
    base_ms: int = BACKOFF_BASE_MS,
    max_ms: int = BACKOFF_MAX_MS,
    jitter: Callable[[], float] = lambda: 0.5,
    start_ms: float = 0,
    cancel_at: float | None = None,
    on_event: Callable[[float, Task], None] | None = None,
) -> tuple[list[Task], dict[str, float]]:
    """Run tasks in virtual time under a budget; the tasks as they end, and the run's counters.

    Tasks start in order; one that does not fit its window holds back those
    behind it until the oldest reservation leaves; one that never fits fails at
    once; refused attempts are released and return to the end of the queue.
    """
    budget = budget or Budget(WINDOW_TOKENS, WINDOW_MS)
    every = list(tasks)
    queue = deque(every)
    n: Counter = Counter(tasks=len(every))
    events: list[tuple[float, int, str, Task | None, Outcome | None]] = []
    serial, now, running, wake = 0, start_ms, 0, None
    cancelling = cancel_at is not None and cancel_at <= start_ms

    def at(when: float, kind: str, task: Task | None = None, outcome: Outcome | None = None) -> None:
        nonlocal serial
        heapq.heappush(events, (when, serial, kind, task, outcome))
        serial += 1

    def enter(task: Task, state: str) -> None:
        task.state = state
        if on_event:
            on_event(now, task)

    def end(task: Task, state: str, error: str = "") -> None:
        task.error, task.ended = error or task.error, now
        n[{"done": "completed"}.get(state, state)] += 1
        enter(task, state)

    def pump() -> None:
        nonlocal running, wake
        while cancelling and queue:
            end(queue.popleft(), "cancelled")
        while running < max(1, concurrency) and queue:
            task, attempt = queue[0], queue[0].attempts + 1
            need = task.tokens_for(attempt)
            verdict, again = budget.reserve(f"{task.id}#{attempt}", need, now)
            if verdict == "ok":
                queue.popleft()
                task.attempts = attempt
                task.started.append(now)
                n["dispatched"] += 1
                n["tokens_estimated"] += need
                running += 1
                n["peak_concurrency"] = max(n["peak_concurrency"], running)
                enter(task, "running")
                outcome = task.outcome(attempt, now)
                at(now + outcome.latency_ms, "settled", task, outcome)
            elif verdict == "exceeds_ceiling":
                queue.popleft()
                task.attempts = attempt
                end(task, "failed", f"{need} tokens are more than the window of {budget.limit} ever holds")
            else:
                if task.state != "waiting-budget":
                    n["budget_waits"] += 1
                    enter(task, "waiting-budget")
                if wake is None or again < wake:
                    wake = again
                    at(again, "wake")
                return

    def settled(task: Task, outcome: Outcome) -> None:
        nonlocal running
        running -= 1
        key = f"{task.id}#{task.attempts}"
        if outcome.kind == "done":
            budget.reconcile(key, outcome.tokens)
            task.tokens = outcome.tokens
            n["tokens_actual"] += outcome.tokens
            end(task, "done")
            return
        if outcome.kind == "rate_limited":
            n["rate_limit_hits"] += 1
            budget.release(key)
        if outcome.kind == "final" or task.attempts >= max_attempts:
            end(task, "failed", f"{outcome.error} (after {task.attempts} attempt(s))")
            return
        n["retries"] += 1
        task.error = outcome.error
        enter(task, "retrying")
        doubling = min(max_ms, base_ms * 2 ** (task.attempts - 1))
        if outcome.kind == "rate_limited" and (outcome.retry_after_ms or 0) > 0:
            delay = outcome.retry_after_ms + jitter() * min(doubling, RETRY_JITTER_MS)
        else:
            delay = doubling * (0.5 + 0.5 * jitter())
        at(now + delay, "again", task)

    if cancel_at is not None:
        at(cancel_at, "cancel")
    pump()
    last = now
    while events:
        when, _, kind, task, outcome = heapq.heappop(events)
        if kind == "cancel" and not (queue or running or any(e[2] == "again" for e in events)):
            continue  # all had ended
        now = max(now, when)
        if kind == "wake":
            wake = None if wake is not None and wake <= when else wake
            if not queue:
                continue
        elif kind == "cancel":
            cancelling = True
            for e in [e for e in events if e[2] in ("settled", "again")]:
                if e[2] == "settled":
                    running -= 1
                    budget.release(f"{e[3].id}#{e[3].attempts}")
                end(e[3], "cancelled")
            events = [e for e in events if e[2] not in ("settled", "again")]
            heapq.heapify(events)
        elif kind == "settled":
            settled(task, outcome)
        elif kind == "again":
            enter(task, "queued")
            queue.append(task)
        last = now
        pump()
    n["wall_clock_ms"] = last - start_ms
    return every, {c: n[c] for c in COUNTERS}


_RUN_OUT = "budget_key string, phase long, task_id string, position long, state string, attempts long, started_ms double, ended_ms double, error string, tokens_used long"
_COUNTERS_OUT = "budget_key string, phase long, " + ", ".join(f"{c} {'double' if c == 'wall_clock_ms' else 'long'}" for c in COUNTERS)


def _scripted(row: dict, latency_ms: float) -> Task:
    """A task whose attempts end as its row says: the last outcome named stands for all later attempts."""
    script = row.get("outcomes")
    if script is None or not len(script):
        script = [{"kind": "done", "latency_ms": latency_ms, "tokens": row.get("tokens_used") or 0}]
    script = [o if isinstance(o, dict) else o.asDict() for o in script]
    outcomes = [
        Outcome(o["kind"], o.get("latency_ms") or 0, int(o.get("tokens") or 0), o.get("retry_after_ms"), o.get("error") or "") for o in script
    ]
    first, again = int(row["estimate"]), row.get("estimate_again")
    later = first if again is None or pd.isna(again) else int(again)
    return Task(row["task_id"], lambda attempt: first if attempt == 1 else later, lambda attempt, now: outcomes[min(attempt, len(outcomes)) - 1])


def _simulated(rows: pd.DataFrame, limits: dict, latency_ms: float, jitter: float, cancel_at_ms: float | None) -> Iterator[tuple[int, pd.DataFrame, list[Task], dict]]:
    """(phase, rows, tasks, counters) of one budget, a phase beginning when the one before has ended."""
    budget, now = Budget(limits["window_tokens"], limits["window_ms"]), 0
    if "phase" not in rows:
        rows = rows.assign(phase=0)
    for phase, part in rows.sort_values(["phase", "position", "task_id"]).groupby("phase"):
        given = [_scripted(r, latency_ms) for r in part.to_dict("records")]
        ended, found = simulate(given, limits["concurrency"], budget, limits["max_attempts"], jitter=lambda: jitter, start_ms=now, cancel_at=cancel_at_ms)
        yield int(phase), part, ended, found
        now += found["wall_clock_ms"]


def schedule(
    tasks: DataFrame,
    concurrency: int = CONCURRENCY,
    window_tokens: int = WINDOW_TOKENS,
    window_ms: int = WINDOW_MS,
    latency_ms: float = 0,
    max_attempts: int = MAX_ATTEMPTS,
    jitter: float = 0.5,
    cancel_at_ms: float | None = None,
    counters: bool = False,
) -> DataFrame:
    """How tasks (budget_key, position, task_id, estimate) run: state, attempts, first start, end, last error and tokens of each.

    Optional columns: ``estimate_again``, the reservation from the second attempt
    on; ``outcomes``, an array of struct<kind, latency_ms, tokens, retry_after_ms,
    error> by attempt, kind being done, rate_limited, retryable or final, the
    last one for all later attempts, without which a task is done at once with
    ``tokens_used``; and ``phase``, a number: a budget's phases share its window
    and follow each other.  At ``cancel_at_ms`` what has not ended is cancelled.  With
    ``counters`` the result is instead a row of counters for each budget and phase.

    A budget is one ordered state, so its tasks are simulated together, in memory
    in proportion to that budget's tasks; budgets are independent of each other
    and run side by side.
    """
    limits = {"concurrency": concurrency, "window_tokens": window_tokens, "window_ms": window_ms, "max_attempts": max_attempts}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([told(*found) for found in _simulated(rows, limits, latency_ms, jitter, cancel_at_ms)])

    def told(phase: int, rows: pd.DataFrame, ended: list[Task], _: dict) -> pd.DataFrame:
        return pd.DataFrame({
            "budget_key": rows["budget_key"].to_numpy(),
            "phase": phase,
            "task_id": [t.id for t in ended],
            "position": rows["position"].to_numpy(),
            "state": [t.state for t in ended],
            "attempts": [t.attempts for t in ended],
            "started_ms": [t.started[0] if t.started else None for t in ended],
            "ended_ms": [t.ended for t in ended],
            "error": [t.error for t in ended],
            "tokens_used": [t.tokens for t in ended],
        })

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["budget_key"].iloc[0]
        return pd.DataFrame([{"budget_key": key, "phase": p} | n for p, _, _, n in _simulated(rows, limits, latency_ms, jitter, cancel_at_ms)])

    groups = tasks.groupBy("budget_key")
    return groups.applyInPandas(count, _COUNTERS_OUT) if counters else groups.applyInPandas(run, _RUN_OUT)


def reconcile(reservations: DataFrame, actuals: DataFrame) -> DataFrame:
    """Reservations (id, at_ms, tokens) raised to actual use (id, actual); unknown ids are ignored."""
    joined = reservations.join(actuals, "id", "left")
    return joined.withColumn("tokens", F.greatest("tokens", F.coalesce("actual", F.lit(0)), F.lit(0))).drop("actual")


def release(reservations: DataFrame, refused: DataFrame) -> DataFrame:
    """Reservations without refused ones (id)."""
    return reservations.join(refused.select("id"), "id", "left_anti")


def live(reservations: DataFrame, now_ms: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """Reservations that still count at a time."""
    return reservations.where((F.col("at_ms") > now_ms - window_ms) & (F.col("at_ms") <= now_ms))


def ledger(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: counters of ended tasks (task_id, state, attempts, tokens_used); what is dropped must be zero."""
    done = tasks.agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("state") == "done").alias("completed"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "cancelled").alias("cancelled"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_actual"),
    ).withColumn("dropped", F.col("tasks") - F.col("completed") - F.col("failed") - F.col("cancelled"))
    sent = attempts.agg(F.count("*").alias("dispatched"), F.coalesce(F.sum("estimate"), F.lit(0)).alias("tokens_estimated"))
    return done.crossJoin(sent)  # one row each


def board(events: DataFrame) -> DataFrame:
    """(task_id, label, state, attempts) from task events (seq, task_id, label, state, attempts): the last state wins, a label stays."""
    last = F.max_by(F.struct("state", "attempts"), "seq")
    label = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("seq")))
    return events.groupBy("task_id").agg(last.alias("s"), F.coalesce(label, F.first("task_id")).alias("label")).select("task_id", "label", "s.state", "s.attempts")


def histogram(tasks: DataFrame) -> DataFrame:
    """(position, state, n): tasks by state in display order, zeros included."""
    counts = tasks.groupBy("state").agg(F.count("*").alias("n"))
    order = tasks.sparkSession.createDataFrame(list(enumerate(STATES)), "position int, state string")
    return F.broadcast(order).join(counts, "state", "left").select("position", "state", F.coalesce("n", F.lit(0)).alias("n"))


def meter_pct(in_window: Column, ceiling: Column) -> Column:
    """How full a window is, in per cent."""
    return F.when(ceiling > 0, F.least(F.lit(100.0), in_window / ceiling * 100)).otherwise(0.0)

