"""Model calls from within tasks: many in flight, under one budget of tokens, classified, backed off and asked again.

Attempts go in rounds.  A round is one Spark job over the requests still open:
requests are dealt to *lanes*, a task each, and every lane has a lease, its share
of the tokens that a window allows, so that lanes need not speak to each other
and all of them together stay within the limit.  A task keeps calls in flight up
to its share, reserves before it sends, and waits for its window or for a
request's back-off.  Replies are written once a round; what they mean, who is
asked again and when, is worked out from the table of replies.  Reservations
that still count when a round ends are carried into the next one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from queue import Empty, SimpleQueue

import pandas as pd
from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BACKOFF_BASE_MS, BACKOFF_MAX_MS, CONCURRENCY, MAX_ATTEMPTS, WINDOW_MS, WINDOW_TOKENS
from ..sources.tables import arrow_batches, saved
from .models import classify, retry_after_ms, send, usage
from .scheduling import Budget, backoff_ms

#: Tasks that call at a time, at most.
LANES = 16

#: Takes a request's body and the number of the attempt; returns status, reply and headers.  What it raises is a failure on the way.
Call = Callable[[dict, int], tuple[int, dict | str, dict[str, str]]]


@dataclass(frozen=True)
class Limits:
    """What a provider allows, and how often it is asked."""

    window_tokens: int = WINDOW_TOKENS
    window_ms: int = WINDOW_MS
    in_flight: int = CONCURRENCY
    max_attempts: int = MAX_ATTEMPTS
    backoff_base_ms: int = BACKOFF_BASE_MS
    backoff_most_ms: int = BACKOFF_MAX_MS
    lanes: int = LANES

    def __post_init__(self) -> None:
        for name in ("window_tokens", "window_ms", "in_flight", "max_attempts", "lanes"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")

    def dealt(self, largest: int) -> int:
        """Lanes such that each has a call in flight and a lease that the largest request fits."""
        return max(1, min(self.lanes, self.in_flight, self.window_tokens // max(1, largest)))


def _now() -> int:
    return time.time_ns() // 1_000_000


def _text(reply: dict | str) -> str | None:
    try:
        return str(reply["choices"][0]["message"]["content"])
    except (KeyError, IndexError, TypeError):
        return None


_REPLY = "key string, attempt int, lane int, estimate long, at_ms long, status int, reply string, text string, model string, retry_after string, reset_tokens string, tokens_used long"


def _ask(row, call: Call, at: int, json_mode: bool, effort: str | None) -> tuple:
    headers: dict[str, str] = {}

    def one(body: dict) -> tuple[int, dict | str]:
        status, reply, told = call(body, int(row.attempt))
        headers.update({k.lower(): v for k, v in told.items()})
        return status, reply

    body = {"messages": [{"role": m["role"], "content": m["content"]} for m in row.messages], "max_completion_tokens": int(row.output)}
    try:
        status, reply = send(one, body, json_mode, effort)
    except Exception as e:  # whatever a client raises never reached an answer
        status, reply = None, str(e)
    model = reply.get("model") if isinstance(reply, dict) else None
    told = json.dumps(reply) if isinstance(reply, dict) else str(reply)
    return (row.key, row.attempt, row.lane, row.estimate, at, status, told, _text(reply), model, headers.get("retry-after"), headers.get("x-ratelimit-reset-tokens"), usage(reply)["total_tokens"])


def _lane(batches: Iterator[pd.DataFrame], call: Call, lease: int, window_ms: int, in_flight: int, held: dict, json_mode: bool, effort: str | None) -> Iterator[pd.DataFrame]:
    task, budgets, ended = TaskContext.get(), {}, SimpleQueue()
    if task.attemptNumber():  # what the lost attempt reserved isn't known
        time.sleep(window_ms / 1000)

    def settle() -> None:
        while True:
            try:
                lane, key, done = ended.get_nowait()
            except Empty:
                return
            if done[5] == 429:  # refused before it cost anything
                budgets[lane].release(key)
            else:
                budgets[lane].reconcile(key, int(done[11]))

    with ThreadPoolExecutor(in_flight) as pool:
        for batch in batches:
            asked = []
            for row in batch.itertuples():
                budget = budgets.setdefault(row.lane, Budget(lease, window_ms, [list(e) for e in held.get(row.lane, ())]))
                time.sleep(max(0, row.ready_ms - _now()) / 1000)
                while True:
                    settle()
                    at = _now()
                    verdict, again = budget.reserve(row.key, int(row.estimate), at)
                    if verdict == "ok":
                        break
                    time.sleep(max(1, min(again - at, 100)) / 1000)  # a refused call may end before the window does
                future = pool.submit(_ask, row, call, at, json_mode, effort)
                future.add_done_callback(lambda f, lane=row.lane, key=row.key: ended.put((lane, key, f.result())))
                asked.append(future)
            rows = [f.result() for f in asked]
            columns = {c.split()[0]: list(v) for c, v in zip(_REPLY.split(", "), zip(*rows))} if rows else {}
            kinds = {"int": "Int32", "long": "Int64", "string": object}
            yield pd.DataFrame({n: pd.Series(columns.get(n, []), dtype=kinds[k]) for n, k in (c.split() for c in _REPLY.split(", "))})


@dataclass
class Called:
    """``replies``: a row a request: key, state (done, failed or cancelled), raw, error, model, attempts, tokens_used, kind.  ``attempts``: every reply as it came."""

    replies: DataFrame
    attempts: DataFrame


def ask_models(
    requests: DataFrame,
    call: Call,
    estimate: Callable[[Column], Column],
    output: Callable[[Column], Column],
    limits: Limits = Limits(),
    json_mode: bool = True,
    effort: str | None = None,
) -> Called:
    """Ask for each request (key, messages), until it is answered, refused for good, or was asked ``max_attempts`` times.

    ``estimate`` and ``output`` give a request's tokens and output allowance from
    the number of the attempt.  A request larger than a window fails unasked.
    Calls of a task that is lost are made again, after a window.  If a round's job
    is cancelled, replies of earlier rounds stay and open requests are cancelled.
    """
    spark = requests.sparkSession
    arrow_batches(spark, rows=256)
    last = F.lit(limits.max_attempts)
    sized = saved(requests.select("key", "messages").withColumn("_most", F.greatest(estimate(F.lit(1)), estimate(last))), "requests")
    fits = F.col("_most") <= limits.window_tokens
    largest = sized.where(fits).agg(F.max("_most")).first()[0] or 1
    lanes = limits.dealt(int(largest))
    lease, flights = limits.window_tokens // lanes, max(1, limits.in_flight // lanes)
    lane = F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int")
    now = sized.where(fits).select("key", "messages", lane.alias("lane"), F.lit(0).cast("long").alias("ready_ms"))
    schema, held, history = _REPLY, {}, []
    for attempt in range(1, limits.max_attempts + 1):
        number = F.lit(attempt)
        shaped = now.select("key", "messages", "lane", "ready_ms", number.alias("attempt"), estimate(number).cast("long").alias("estimate"), output(number).cast("int").alias("output"))
        dealt = shaped.repartitionById(lanes, "lane").sortWithinPartitions("ready_ms", "key")
        asked = dealt.mapInPandas(lambda b, held=held: _lane(b, call, lease, limits.window_ms, flights, held, json_mode, effort), schema)
        try:
            told = saved(asked, "replies")
        except (Py4JError, PySparkException) as e:
            if "cancelled" not in str(e):
                raise
            break  # what had ended stays
        kind = classify(F.col("status"), F.col("reply"))
        wish = F.when(kind == "rate_limited", retry_after_ms(F.col("retry_after"), F.col("reset_tokens")))
        jitter = F.pmod(F.xxhash64("key", "attempt"), F.lit(1000)) / 1000
        delay = backoff_ms(F.col("attempt"), jitter, wish, limits.backoff_base_ms, limits.backoff_most_ms)
        told = told.withColumn("kind", kind).withColumn("ready_ms", (F.lit(_now()) + F.ceil(delay)).cast("long"))
        history.append(told)
        again = told.where(F.col("kind").isin("rate_limited", "retryable")).select("key", "ready_ms")
        if attempt == limits.max_attempts or again.isEmpty():
            break
        now = sized.join(saved(again, "again"), "key").select("key", "messages", lane.alias("lane"), "ready_ms")
        live = told.where((F.col("kind") != "rate_limited") & (F.col("at_ms") > _now() - limits.window_ms))
        rows = live.select("lane", "key", "at_ms", F.greatest("estimate", "tokens_used").alias("tokens")).collect()  # what the window holds
        held = {}
        for r in sorted(rows, key=lambda r: r.at_ms):
            held.setdefault(r.lane, []).append([r.key, r.at_ms, r.tokens])
    every = spark.createDataFrame([], f"{_REPLY}, kind string, ready_ms long")
    for more in history:
        every = every.unionByName(more)
    final = every.groupBy("key").agg(F.max_by(F.struct("kind", "text", "reply", "model", "attempt"), "attempt").alias("r"), F.sum("tokens_used").alias("tokens_used"))
    done, open_ = F.col("r.kind") == "ok", F.col("r.kind").isin("rate_limited", "retryable") & (F.col("r.attempt") < last)
    error = F.when(~done, F.concat(F.substring("r.reply", 1, 400), F.lit(" (after "), F.col("r.attempt").cast("string"), F.lit(" attempt(s))")))
    replies = final.select("key", F.when(done, "done").when(open_, "cancelled").otherwise("failed").alias("state"), F.when(done, F.col("r.text")).alias("raw"), error.alias("error"), F.when(done, F.col("r.model")).alias("model"), F.col("r.attempt").alias("attempts"), "tokens_used", F.col("r.kind").alias("kind"))
    none = F.lit(None).cast("string")
    unasked = sized.where(~fits).select("key", F.lit("failed").alias("state"), none.alias("raw"), F.lit("The request is larger than a window allows.").alias("error"), none.alias("model"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("tokens_used"), F.lit("too_large").alias("kind"))
    lost = sized.where(fits).join(final, "key", "left_anti")  # none but in a run that was cancelled
    cancelled = lost.select("key", F.lit("cancelled").alias("state"), none.alias("raw"), none.alias("error"), none.alias("model"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("tokens_used"), none.alias("kind"))
    return Called(replies.unionByName(unasked).unionByName(cancelled), every)
