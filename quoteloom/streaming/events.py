"""Run events as newline-delimited JSON, the live board, and the budget as a streaming state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import WINDOW_MS, WINDOW_TOKENS
from ..operators.scheduling import Budget, board

EVENT = "seq long, type string, phase string, detail string, task_id string, label string, state string, attempts int, payload string"


def write_events(events: DataFrame, path: str) -> None:
    """Append events to a folder, a line each."""
    events.write.mode("append").json(path)


def publish_batch(events: DataFrame, path: str, batch: int) -> bool:
    """Write a batch of events to a folder once: aside first, then under its number in one step; False if it is there already.

    An attempt that fails leaves nothing that readers see, and a batch that is
    repeated, after a failure or by two writers at a time, counts once.
    """
    spark = events.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = path_of(f"{path}/batch={batch}"), path_of(f"{path}/_aside/{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    events.write.json(aside.toString())
    # renaming into a folder that came meanwhile would nest this one in it
    published = not files.exists(target) and files.rename(aside, target)
    if files.exists(path_of(target, aside.getName())):
        files.delete(path_of(target, aside.getName()), True)
        published = False
    if not published:
        files.delete(aside, True)
    return published


def events_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing a stream of events to a folder, each batch once."""
    batches = events.writeStream.foreachBatch(lambda rows, number: publish_batch(rows, path, number) and None)
    return batches.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder; blank and cut-off lines are passed over."""
    lines = spark.read.schema(f"{EVENT}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return lines.where("type is not null").drop("_broken")


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same, as a stream of the files that arrive."""
    lines = spark.readStream.schema(f"{EVENT}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return lines.where("type is not null").drop("_broken")


def run_events(phases: DataFrame, tasks: DataFrame, **others: DataFrame) -> DataFrame:
    """Events of a run: phase rows (seq, phase, detail), task rows (seq, phase, task_id, label, state, attempts), and others.

    Others go by their type (models, claims, result, error): rows of seq and
    whatever columns the event carries, which become its payload as JSON.
    """
    fields = dict(field.split() for field in EVENT.split(", "))

    def shaped(rows: DataFrame, kind: str) -> DataFrame:
        given = {c: F.col(c) for c in rows.columns} | {"type": F.lit(kind)}
        return rows.select(*[given.get(name, F.lit(None)).cast(of).alias(name) for name, of in fields.items()])

    events = shaped(phases, "phase").unionByName(shaped(tasks, "scheduler"))
    for kind, rows in others.items():
        payload = F.to_json(F.struct(*[c for c in rows.columns if c != "seq"]))
        events = events.unionByName(shaped(rows.select("seq", payload.alias("payload")), kind))
    return events


def live_board(events: DataFrame, path: str) -> StreamingQuery:
    """Start the board over a stream of events: state is one row a task, and each batch writes the tasks that changed.

    ``path`` takes the changes and the checkpoint that a failed stream resumes
    from; a batch that is repeated overwrites its own changes.
    """

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    tasks = board(events.where("task_id is not null"))
    put(events.sparkSession.createDataFrame([], tasks.schema), -1)  # so that there is something to read
    return tasks.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()


def board_now(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, label, state, attempts) of a live board's last batches."""
    changes = spark.read.parquet(f"{path}/changes")
    last = F.max_by(F.struct("label", "state", "attempts"), "batch")
    return changes.groupBy("task_id").agg(last.alias("s")).select("task_id", "s.label", "s.state", "s.attempts")


RESERVED = "budget_key string, id string, at_ms long, tokens long, verdict string, retry_at_ms long"


def stream_reservations(requests: DataFrame, limit: int = WINDOW_TOKENS, window_ms: int = WINDOW_MS) -> DataFrame:
    """Reservation requests (budget_key, op, id, at_ms, tokens) of a stream, answered in order of time.

    ``op`` is reserve, reconcile or release; only reservations are answered:
    verdict ok, window_full with the time to try again, or exceeds_ceiling.  The
    state of a budget is its live reservations, at most what the window holds; a
    task holds one budget's requests of one batch, which the source's
    ``maxFilesPerTrigger`` bounds.
    """

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        budget = Budget(limit, window_ms)
        if state.exists:
            held, at, tokens = state.get
            budget.entries = [list(e) for e in zip(held, at, tokens)]
        rows = pd.concat(list(batches)).sort_values(["at_ms", "id", "op"], kind="stable")
        found = []
        for r in rows.itertuples():
            if r.op == "reserve":
                verdict, again = budget.reserve(r.id, int(r.tokens), int(r.at_ms))
                found.append((key[0], r.id, int(r.at_ms), int(r.tokens), verdict, again))
            elif r.op == "reconcile":
                budget.reconcile(r.id, int(r.tokens))
            elif r.op == "release":
                budget.release(r.id)
        if len(rows):
            budget.live(int(rows["at_ms"].max()))
        e = budget.entries
        state.update(([x[0] for x in e], [int(x[1]) for x in e], [int(x[2]) for x in e]))
        out = pd.DataFrame(found, columns=["budget_key", "id", "at_ms", "tokens", "verdict", "retry_at_ms"])
        yield out.astype({"retry_at_ms": "Int64"})

    return requests.groupBy("budget_key").applyInPandasWithState(
        answer, RESERVED, "ids array<string>, at array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout
    )


def answered_to(answers: DataFrame, path: str) -> StreamingQuery:
    """Start writing a stream's answers as files under ``path``, with the checkpoint it resumes from."""
    files = answers.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    return files.trigger(availableNow=True).start(f"{path}/answers")
