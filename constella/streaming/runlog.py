"""The append-only run log: writing events, folding them to the latest state, and planning a resumed run.

An event is a JSON line; the latest state follows the order of lines, not their timestamps. The fold is one
aggregate, so it runs over a directory of logs of any size, and unchanged over a stream of them.
"""

from __future__ import annotations

import itertools
import json
import re
import time
from collections import Counter
from collections.abc import Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from constella.sources import store

EVENT = (
    "run_id string, timestamp timestamp_ntz, event_type string, sample_dir string, attempt int, duration_seconds double, error_type string, error_message string, "
    "parallel_mode string, skip_reason string, resume_source_run_id string, root_dir string, resume_from_run_id string, _corrupt_record string"
)
# The states that events lead to.
DIRECTORY_STATES = {
    "directory_discovered": "discovered", "directory_queued": "queued", "directory_started": "running",
    "directory_completed": "completed", "directory_failed": "failed", "directory_skipped": "skipped",
}
RUN_STATES = {"run_started": "running", "run_completed": "completed", "run_aborted": "aborted"}


def _state(column, states: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[column]


def directory_state(event_type):
    """The directory state an event leads to, or null."""
    return _state(event_type, DIRECTORY_STATES)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of one run's log, or of all logs below a folder, with ``ord`` in the order of files and lines; blank and broken lines are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "events*.jsonl").option("mode", "PERMISSIVE").schema(EVENT).json(path)
    at = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    return lines.withColumn("ord", at).filter("_corrupt_record is null and event_type is not null").drop("_corrupt_record")


def fold(events: DataFrame, key: str = "sample_dir", order: str = "ord") -> DataFrame:
    """Latest state and highest attempt of each directory."""
    moves = events.withColumn("_state", directory_state(F.col("event_type"))).filter(F.col("_state").isNotNull() & F.col(key).isNotNull())
    return moves.groupBy(key).agg(F.max_by("_state", order).alias("state"), F.max("attempt").alias("attempts"))


def latest(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key's last event."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("latest"))


def run_status(events: DataFrame, order: str = "ord") -> DataFrame:
    """The status of each run by its last lifecycle event."""
    moves = events.withColumn("_state", _state(F.col("event_type"), RUN_STATES)).filter("_state is not null")
    return moves.groupBy("run_id").agg(F.max_by("_state", order).alias("run_status"))


def state_counts(states: DataFrame, column: str = "state") -> DataFrame:
    return states.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def summary(events: DataFrame) -> DataFrame:
    """One document per run: status, states and attempts of its directories, and counts by state."""
    per = events.withColumn("_state", directory_state(F.col("event_type"))).filter("_state is not null and sample_dir is not null")
    states = per.groupBy("run_id", "sample_dir").agg(F.max_by("_state", "ord").alias("state"), F.max("attempt").alias("attempt"))
    maps = states.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_dir", "state"))).alias("directory_states"), F.map_from_entries(F.collect_list(F.struct("sample_dir", F.coalesce("attempt", F.lit(0))))).alias("attempts"))
    counts = states.groupBy("run_id", "state").count().groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("state", "count"))).alias("counts"))
    return run_status(events).join(maps, "run_id", "left").join(counts, "run_id", "left")


def resume_plan(directories: DataFrame, states: DataFrame | None, retry_failed: bool = False, key: str = "sample_dir") -> DataFrame:
    """Each directory with what to do: process it as attempt n, or skip it and why.

    A directory that was skipped in the run resumed from keeps the state it was skipped for, as far as the log says.
    """
    if states is None:
        return directories.withColumn("action", F.lit("process")).withColumn("skip_reason", F.lit(None).cast("string")).withColumn("attempt", F.lit(1))
    joined = directories.join(states, key, "left")
    reason = F.when(F.col("state").isin("completed", "skipped"), F.lit("completed_in_previous_run"))
    if not retry_failed:
        reason = reason.when(F.col("state") == "failed", F.lit("failed_in_previous_run"))
    out = joined.withColumn("skip_reason", reason).withColumn("action", F.when(F.col("skip_reason").isNull(), F.lit("process")).otherwise(F.lit("skip")))
    return out.withColumn("attempt", F.coalesce("attempts", F.lit(0)) + F.when(F.col("action") == "process", 1).otherwise(0)).drop("state", "attempts")


class _Fold(StatefulProcessor):
    """Keeps one directory's state, its order and its highest attempt; emits it whenever events arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ord long, state string, attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ord_, state, attempt = self.kept.get() if self.kept.exists() else (-1, None, None)
        for batch in rows:
            for o, e, a in batch[["ord", "event_type", "attempt"]].itertuples(index=False):
                if (moved := DIRECTORY_STATES.get(e)) is None:
                    continue
                if o > ord_:
                    ord_, state = o, moved
                if not pd.isna(a):
                    attempt = max(int(a), attempt or 0)
        if state is not None:
            self.kept.update((ord_, state, attempt))
            yield pd.DataFrame({"sample_dir": [key[0]], "state": [state], "attempts": pd.array([attempt], dtype="Int32")})

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, stateful: bool = False) -> DataFrame:
    """The fold over a stream, in update mode: built-in aggregation, or an explicit state per directory."""
    known = events.filter("sample_dir is not null")
    if not stateful:
        return fold(known)
    return known.select("sample_dir", "ord", "event_type", "attempt").groupBy("sample_dir").transformWithStateInPandas(_Fold(), "sample_dir string, state string, attempts int", "Update", "None")


def windowed_counts(events: DataFrame, time_column: str, width: str, late: str | None = None, by: str = "event_type") -> DataFrame:
    """Events per tumbling window; on a stream, later than ``late`` they no longer count. An extension of the method."""
    source = events.withWatermark(time_column, late) if late else events
    return source.groupBy(F.window(time_column, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


class RunLog:
    """The driver's side of one run: a folder of its own in any store, with events in numbered files and a summary of them.

    A batch of events is one file, and the summary follows each batch, so that a run of any number of directories
    writes as many files as it has phases.
    """

    def __init__(self, spark: SparkSession, base: str, root: str, parallel_mode: str = "spark", resume_from: str | None = None, now=datetime.now):
        self.spark, self.root, self.now, self.files = spark, root, now, itertools.count(1)
        self.status, self.began = "running", time.monotonic()
        self.states: dict[str, str] = {}
        self.attempts: dict[str, int] = {}
        stamp = now().strftime("%Y-%m-%d--%H-%M-%S")
        first = {"event_type": "run_started", "root_dir": root, "parallel_mode": parallel_mode, "resume_from_run_id": resume_from}
        # Who creates a folder's first file has the run id; the store lets only one do so.
        for self.run_id in itertools.chain([stamp], (f"{stamp}-{n}" for n in itertools.count(1))):
            self.folder = f"{str(base).rstrip('/')}/{self.run_id}"
            if store.create(spark, f"{self.folder}/events-000000.jsonl", self._lines([first])):
                break
        self._summarise()

    def _lines(self, events: Iterable[dict]) -> str:
        at = {"run_id": self.run_id, "timestamp": self.now().isoformat(timespec="seconds")}
        return "".join(json.dumps({k: v for k, v in (at | e).items() if v is not None}, sort_keys=True) + "\n" for e in events)

    def emit_all(self, events: list[dict]) -> None:
        """Adds events, each with its ``event_type``, and for directories ``sample_dir`` and ``attempt``."""
        if not events:
            return
        store.create(self.spark, f"{self.folder}/events-{next(self.files):06d}.jsonl", self._lines(events))
        for e in events:
            self.status = RUN_STATES.get(e["event_type"], self.status)
            if e["event_type"] in DIRECTORY_STATES:
                self.states[e["sample_dir"]] = DIRECTORY_STATES[e["event_type"]]
                self.attempts[e["sample_dir"]] = max(e.get("attempt") or 0, self.attempts.get(e["sample_dir"], 0))
        self._summarise()

    def emit(self, event_type: str, sample_dir: str | None = None, attempt: int | None = None, **more) -> None:
        self.emit_all([{"event_type": event_type, "sample_dir": sample_dir, "attempt": attempt, **more}])

    def _summarise(self) -> None:
        whole = {"run_id": self.run_id, "root_dir": self.root, "run_status": self.status, "directory_states": self.states, "attempts": self.attempts, "counts": Counter(self.states.values())}
        store.replace(self.spark, f"{self.folder}/summary.json", json.dumps(whole, indent=2, sort_keys=True))

    def finish(self, aborted: bool = False) -> None:
        self.emit("run_aborted" if aborted else "run_completed", duration_seconds=round(time.monotonic() - self.began, 3))


def run_order(run_id: str) -> tuple[str, int]:
    """Sorts run ids by time, then by the number that a clash added."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d--\d\d-\d\d-\d\d)(?:-(\d+))?", run_id)
    return (m[1], int(m[2] or 0)) if m else (run_id, 0)


def latest_run_id(spark: SparkSession, base: str) -> str | None:
    found = [p.split("/")[-2] for p in store.glob(spark, f"{str(base).rstrip('/')}/*/events*.jsonl")]
    return max(found, key=run_order, default=None)
