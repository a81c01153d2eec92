"""Events of a run as it goes on: each phase's counters are observed while its rows are written, and told when they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import saved
from ..streaming.events import run_events, write_events

_PHASES = "seq long, phase string, detail string"


class Progress:
    """Appends events to a folder, from where :func:`quoteloom.streaming.events.stream_events` reads them while the run lasts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seq = spark, path, 0

    def tell(self, phase: str, detail: str, **counters: int) -> None:
        """A phase event, and one with its counters if it has any."""
        phases = self.spark.createDataFrame([(self.seq, phase, detail)], _PHASES)
        others = {}
        if counters:
            others["counters"] = self.spark.createDataFrame([(self.seq + 1, phase, *counters.values())], ["seq", "phase", *counters])
        none = self.spark.createDataFrame([], "seq long, phase string, task_id string, label string, state string, attempts int")
        write_events(run_events(phases, none, **others).coalesce(1), self.path)
        self.seq += 2


class Quiet(Progress):
    """Tells nothing."""

    def __init__(self) -> None:
        pass

    def tell(self, phase: str, detail: str, **counters: int) -> None:
        pass


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` as a written table, and aggregates of it that were taken while it was written."""
    seen = Observation(name)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counters.items()]
    return saved(df.observe(seen, *counts), name), seen.get
