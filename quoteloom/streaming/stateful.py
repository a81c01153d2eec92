"""Streams whose keys hold state of their own: lines cut anywhere, and budgets that wake what waits.

State lies in RocksDB beside the checkpoint, so that a failed or stopped stream
goes on where it was; a task holds what one key has in one batch, which the
source's ``maxFilesPerTrigger`` bounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import WINDOW_MS, WINDOW_TOKENS
from .events import EVENT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """State stores of streams started from now on are RocksDB's, as state of several kinds needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as columns of the types that a schema of strings and whole numbers names."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame({n: pd.Series(list(c), dtype="Int64" if kind == "long" else object) for n, kind, c in zip(names, kinds, columns)})


LINES = "stream string, line long, text string"


class Lines(StatefulProcessor):
    """Joins byte chunks of a stream to lines, in order of their numbers from 0, whichever batch each comes in.

    Kept are the unfinished line's bytes, the next chunk's number and the next
    line's, and chunks that came before one that is still missing.  A chunk that
    comes again is passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "tail binary, chunk long, line long")
        self.early = handle.getMapState("early", "seq long", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tail, chunk, line = self.now.get() if self.now.exists() else (b"", 0, 0)
        came = {}
        for part in rows:
            came |= {int(n): bytes(c or b"") for n, c in zip(part["seq"], part["chunk"]) if int(n) >= chunk}
        joined = [bytes(tail)]
        while True:
            if chunk in came:
                joined.append(came.pop(chunk))
            elif self.early.containsKey((chunk,)):
                joined.append(bytes(self.early.getValue((chunk,))[0]))
                self.early.removeKey((chunk,))
            else:
                break
            chunk += 1
        for seq, bytes_ in came.items():
            self.early.updateValue((seq,), (bytes_,))
        *whole, tail = b"".join(joined).split(b"\n")
        self.now.update((tail, chunk, line + len(whole)))
        yield _frame([(key[0], line + i, x.decode("utf-8", "replace")) for i, x in enumerate(whole)], LINES)

    def close(self) -> None:
        pass


def stream_lines(chunks: DataFrame) -> DataFrame:
    """(stream, line, text) of chunks (stream, seq, chunk) cut at any byte: a line is told once its end has come.

    What follows the last line break of a stream waits, as a line that was cut off would.
    """
    keep_state(chunks.sparkSession)
    return chunks.groupBy("stream").transformWithStateInPandas(Lines(), LINES, "append", "none")


def events_of(lines: DataFrame) -> DataFrame:
    """Events of lines; blank ones and those that are no event are passed over."""
    read = F.from_json("text", EVENT, {"mode": "PERMISSIVE"})
    return lines.withColumn("e", read).where("e.type is not null").select("stream", "line", "e.*")


ADMITTED = "budget_key string, id string, asked_ms long, tokens long, verdict string, admitted_ms long"


class Waiting(StatefulProcessor):
    """A budget whose refused reservations wait in line and are admitted as soon as the window has room.

    Requests are taken in order of event time, and what waits is admitted at its
    own time in between; where no request comes, a timer of that time does it.
    """

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("held", "id string, at_ms long, tokens long")
        self.line = handle.getListState("waiting", "id string, at_ms long, tokens long")
        self.clock = handle.getValueState("clock", "at_ms long")

    def _load(self) -> None:
        self.held = deque(list(x) for x in self.kept.get()) if self.kept.exists() else deque()  # in order of admission
        self.spent = sum(e[2] for e in self.held)
        self.queue: deque[list] = deque()
        self.waits: dict[str, deque[list]] = {}  # of each id; what is given up leaves the line when its turn comes
        for x in self.line.get() if self.line.exists() else ():
            self._wait(*x)
        self.now = self.clock.get()[0] if self.clock.exists() else None
        self.told: list[tuple] = []

    def _wait(self, id_: str, at: int, tokens: int) -> None:
        entry = [id_, at, tokens, True]
        self.queue.append(entry)
        self.waits.setdefault(id_, deque()).append(entry)

    def _head(self) -> list | None:
        """What is first in line."""
        while self.queue and not self.queue[0][3]:
            self.queue.popleft()
        return self.queue[0] if self.queue else None

    def _store(self, key) -> pd.DataFrame:
        for state, rows in ((self.kept, [tuple(x) for x in self.held]), (self.line, [tuple(x[:3]) for x in self.queue if x[3]])):
            state.put(rows) if rows else state.clear()
        if self.now is not None:
            self.clock.update((self.now,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self._head():
            self.handle.registerTimer(self._room())
        return _frame([(key[0], *row) for row in self.told], ADMITTED)

    def _expire(self) -> None:
        while self.held and self.held[0][1] <= self.now - self.window_ms:
            self.spent -= self.held.popleft()[2]

    def _room(self) -> int:
        """The first time from now on at which the head of the line fits; what has left the window by now is gone already."""
        left = self.limit - self.queue[0][2]
        spent, at = self.spent, self.now
        for e in self.held:
            if spent <= left:
                return at
            spent, at = spent - e[2], e[1] + self.window_ms
        if spent <= left:
            return at
        raise AssertionError("an empty window has room for what is no larger than it")

    def _advance(self, until: int) -> None:
        """Admit what the line's head onwards gets room for, up to a time."""
        self.now = until if self.now is None else self.now
        self._expire()
        while self._head() and (at := self._room()) <= until:
            id_, asked, tokens, _ = self.queue.popleft()
            self.waits[id_].popleft()  # an id's entries are in the order of the line
            if not self.waits[id_]:
                del self.waits[id_]
            self.held.append([id_, at, tokens])
            self.spent += tokens
            self.told.append((id_, asked, tokens, "ok", at))
            self.now = at
            self._expire()
        self.now = max(self.now, until)
        self._expire()

    def _take(self, op: str, id_: str, at: int, tokens: int) -> None:
        self._advance(at)
        if op == "reserve" and tokens > self.limit:
            self.told.append((id_, at, tokens, "exceeds_ceiling", None))
        elif op == "reserve":
            self._wait(id_, at, tokens)
        elif op == "release":
            for entry in self.waits.pop(id_, ()):
                entry[3] = False
                self.told.append((*entry[:3], "released", None))
            self.held = deque(e for e in self.held if e[0] != id_)
            self.spent = sum(e[2] for e in self.held)
        elif op == "reconcile":
            for e in self.held:
                if e[0] == id_:
                    e[2] = max(e[2], tokens, 0)
            self.spent = sum(e[2] for e in self.held)
        self._advance(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        came = pd.concat(list(rows)).sort_values(["at_ms", "id", "op"], kind="stable")
        for r in came.itertuples():
            self._take(r.op, r.id, int(r.at_ms), int(r.tokens))
        yield self._store(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self._advance(int(timerValues.getCurrentWatermarkInMs()))
        yield self._store(key)

    def close(self) -> None:
        pass


def stream_admissions(requests: DataFrame, limit: int = WINDOW_TOKENS, window_ms: int = WINDOW_MS, late: str = "1 second") -> DataFrame:
    """Requests (budget_key, op, id, at_ms, tokens) of a stream, each reservation answered once: with the time it is admitted.

    ``op`` is reserve, release, reconcile, or anything else for the time alone.
    Reservations are admitted in the order they were asked for: at once, or when
    room enough leaves the window or is released.  verdict is ok,
    exceeds_ceiling, or released where it was given up while it waited.
    Requests may come ``late`` by so much event time.
    """
    keep_state(requests.sparkSession)
    timed = requests.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("budget_key").transformWithStateInPandas(Waiting(limit, window_ms), ADMITTED, "append", "eventTime")
