"""Model catalogues, and what a provider's replies mean."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_CONTEXT_WINDOW

# Words in the ids of models that don't chat, and how long a catalogue holds.
NOT_CHAT = "(?i)whisper|orpheus|tts|stt|prompt-guard|safeguard|guard|embed|rerank|moderation"
CATALOGUE_TTL_S = 300

# How a wait is written, a reply that broke off while writing JSON, and words that name a refused parameter.
WAIT_SHAPE = r"^\s*([\d.]+)\s*(ms|s|m)?\s*$"
WAIT_UNITS = {"ms": 1.0, "s": 1000.0, "m": 60_000.0}
BROKEN_JSON = "(?i)json_validate_failed|failed to generate json"
REFUSED = {"reasoning_effort": ("reasoning",), "response_format": ("response_format", "json_object", "json mode")}


def read_catalogue(raw: DataFrame) -> DataFrame:
    """(id, context_window, owned_by) of JSON replies (column raw); values of the wrong type take defaults."""
    rows = raw.select(F.explode(F.try_variant_get(F.try_parse_json("raw"), "$.data", "array<variant>")).alias("m"))

    def typed(path: str, kind: str, names: tuple[str, ...], default: object) -> Column:
        found = F.schema_of_variant(F.try_variant_get("m", path, "variant"))
        fits = found.isin(*names) | (F.lit("DECIMAL" in names) & found.startswith("DECIMAL"))
        return F.when(F.coalesce(fits, F.lit(False)), F.try_variant_get("m", path, kind)).otherwise(F.lit(default))

    return rows.select(
        typed("$.id", "string", ("STRING",), "").alias("id"),
        typed("$.context_window", "long", ("BIGINT", "DOUBLE", "DECIMAL"), 0).cast("long").alias("context_window"),
        typed("$.owned_by", "string", ("STRING",), "unknown").alias("owned_by"),
    )


def chat_models(catalogue: DataFrame, least: int = MIN_CONTEXT_WINDOW) -> DataFrame:
    """Models fit for chat, with place: greatest context first, then by id."""
    fit = catalogue.where((F.length("id") > 0) & ~F.col("id").rlike(NOT_CHAT) & (F.col("context_window") >= least))
    order = Window.orderBy(F.desc("context_window"), F.lower("id"), F.desc("id"))  # a catalogue is short
    return fit.withColumn("place", F.row_number().over(order))


def choose(available: DataFrame, preferences: DataFrame) -> DataFrame:
    """(purpose, id): for each purpose of preferences (purpose, rank, id) the first preferred id that is live, or else the first available.

    Without an available model the id is null.
    """
    first = available.agg(F.min_by("id", "place").alias("first"))  # one row
    live = preferences.join(available.select("id", F.lit(True).alias("live")), "id", "left")
    best = live.groupBy("purpose").agg(F.min_by("id", F.when(F.col("live"), F.col("rank"))).alias("preferred"))
    return best.crossJoin(F.broadcast(first)).select("purpose", F.coalesce("preferred", "first").alias("id"))


def pick_model(available: DataFrame, preference: list[str]) -> str:
    """The first preferred id that is live, or else the first available."""
    wanted = available.sparkSession.createDataFrame([("", i, p) for i, p in enumerate(preference or [""])], "purpose string, rank int, id string")
    row = choose(available, wanted).first()
    if row.id is None:
        raise LookupError("no chat model is available")
    return row.id


class Catalogue:
    """Chosen models, kept for a while; ``load`` gives the catalogue."""

    def __init__(self, load: Callable[[], DataFrame], draft: list[str], verify: list[str], override: str | None = None, clock: Callable[[], float] = time.time):
        self.load, self.draft, self.verify, self.override, self.clock = load, draft, verify, override, clock
        self._held: tuple[float, dict] | None = None

    def models(self) -> dict:
        if not self._held or self.clock() - self._held[0] >= CATALOGUE_TTL_S:
            live = chat_models(self.load()).cache()
            asked = self.override and live.where(F.col("id") == self.override).limit(1).count()
            draft = self.override if asked else pick_model(live, self.draft)
            self._held = self.clock(), {"draft": draft, "verify": pick_model(live, self.verify), "available": live}
        return self._held[1]

    def reset(self) -> None:
        self._held = None


def retry_after_ms(retry_after: Column, reset_tokens: Column) -> Column:
    """Milliseconds that a reply asks to wait: ``12``, ``1.5s``, ``300ms`` or ``2m``; null where it says nothing readable."""
    raw = F.coalesce(retry_after, reset_tokens)
    number = F.regexp_extract(raw, WAIT_SHAPE, 1)
    value = F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)$"), number.cast("double"))
    unit = F.regexp_extract(raw, WAIT_SHAPE, 2)
    return value * F.when(unit == "ms", WAIT_UNITS["ms"]).when(unit == "m", WAIT_UNITS["m"]).otherwise(WAIT_UNITS["s"])


def classify(status: Column, body: Column) -> Column:
    """What a reply's status means: ok, rate_limited, retryable or final; a null status is a failure on the way."""
    unfinished = (status == 400) & F.substring(body, 1, 400).rlike(BROKEN_JSON)
    return (
        F.when(status.isNull(), "retryable")
        .when(status.between(200, 299), "ok")
        .when(unfinished, "retryable")
        .when(status == 429, "rate_limited")
        .when((status >= 500) | (status == 408), "retryable")
        .otherwise("final")
    )


def refused_parameter(status: Column, reply: Column, sent: Column) -> Column:
    """The parameter, of those sent (an array of names), that a reply of status 400 names; null where it names none."""
    text = F.lower(reply)
    found = F.lit(None).cast("string")
    for name, words in reversed(REFUSED.items()):
        named = F.lit(False)
        for word in words:
            named = named | text.contains(word)
        found = F.when((status == 400) & named & F.array_contains(sent, name), name).otherwise(found)
    return found


def send(call: Callable[[dict], tuple[int, dict | str]], request: dict, json_mode: bool = True, effort: str | None = None) -> tuple[int, dict | str]:
    """A model call that drops parameters a provider refuses: at most two more attempts, effort before format.

    ``call`` takes the request's body and returns status and reply.
    """
    extra = {"response_format": {"type": "json_object"}} if json_mode else {}
    extra |= {"reasoning_effort": effort} if effort else {}
    status, reply = call(request | extra)
    for _ in range(2):
        text = str(reply).lower()
        named = next((k for k, words in REFUSED.items() if k in extra and any(w in text for w in words)), None)
        if status != 400 or named is None:
            break
        extra.pop(named)
        status, reply = call(request | extra)
    return status, reply


def usage(reply: dict) -> dict[str, int]:
    """Tokens that a reply reports; what is missing or no number is 0."""
    found = reply.get("usage") if isinstance(reply, dict) else None
    found = found if isinstance(found, dict) else {}
    real = lambda v: v if isinstance(v, int | float) and not isinstance(v, bool) else 0
    return {k: real(found.get(k)) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
