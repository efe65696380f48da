"""What a running stream has done so far."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """The rows that each batch of a stream took in, as the engine reports them, and the streams that have ended."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], int] = {}
        self.changed = threading.Condition()
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.changed:
            p = event.progress
            # a batch without data reports none
            self.batches[str(p.runId), p.batchId] = sum(s.numInputRows for s in p.sources)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, query, seconds: float = 60) -> list[tuple[int, int]]:
        """(batch, rows) of a stream that has ended; events arrive a little after its end."""
        with self.changed:
            self.changed.wait_for(lambda: str(query.runId) in self.ended, seconds)
            return sorted((b, n) for (run, b), n in self.batches.items() if run == str(query.runId) and n)


def progress_of(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, into files, and returns batch and n_rows as the listener saw them: a row for each batch."""
    spark: SparkSession = stream.sparkSession
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.createDataFrame(log.of(query), "batch long, n_rows long")
    finally:
        spark.streams.removeListener(log)
