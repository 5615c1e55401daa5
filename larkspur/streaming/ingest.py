"""Streaming ingest and state (R1-R6, N9): file streams merged by micro-batch, tails, leases and job states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.jobs import TRANSITIONS


def watch_text(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of new files as (path, modified, value, content_hash). The file source reads a name once: see rescan for files that change."""
    rows = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value", F.sha2("value", 256).alias("content_hash"))


def rescan(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Files (path, value, content_hash) whose content is new for their path: a scheduled batch beside the stream."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("content_hash", F.sha2("value", 256)).join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run merge(batch, batch_id) on each micro-batch; merge must be idempotent, as a batch can come again."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys haven't come within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def tail(rows: DataFrame, last_seen: int, ident: str = "id") -> DataFrame:
    """What came after the last seen id, oldest first."""
    return rows.filter(F.col(ident) > last_seen).orderBy(ident)


def live_leases(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.filter(F.col("expires_at") >= F.lit(as_of).cast("timestamp"))


def job_states(log: DataFrame, initial: str = "queued", idle_ms: int | None = None) -> DataFrame:
    """(job_id, status, moves, rejected, error_count) after each micro-batch of a status log (job_id, seq, status): moves that aren't legal are counted, not made.

    idle_ms: a job that nothing came for as long is forgotten, so the state doesn't grow with all jobs there ever were; a later row of it begins anew.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, moves, rejected, errors = state.get if state.exists else (initial, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for new in rows["status"]:
            if new in TRANSITIONS.get(status, []):
                status, moves = new, moves + 1
                errors += new == "fix_loop"
            else:
                rejected += 1
        state.update((status, moves, rejected, errors))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "moves": [moves], "rejected": [rejected], "error_count": [errors]})

    return log.groupBy("job_id").applyInPandasWithState(update, "job_id string, status string, moves int, rejected int, error_count int", "status string, moves int, rejected int, error_count int", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
