"""Progress of streaming folds, kept from Spark's own reports instead of a terminal display."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Progress(StreamingQueryListener):
    """Rows and batches of each query by its id, and the queries that ended with an error."""

    rows: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors[str(event.id)] = event.exception


def attach(spark: SparkSession) -> Progress:
    """A listener that follows all of the session's streaming queries from now on."""
    made = Progress()
    spark.streams.addListener(made)
    return made
