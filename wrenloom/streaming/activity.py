"""Activity and submissions as streams: running statistics, first submissions, and the states of keys.

Sources are replayable and sinks keep checkpoints, so nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from wrenloom.operators import activity

OUTCOMES = "submit_seq bigint, stage string, url string, accepted boolean, reason string"
_STATE = "polls bigint, status int"


def running_worker_stats(activities: DataFrame) -> DataFrame:
    """worker_stats() of a stream so far, for output mode "update" or "complete"."""
    return activity.worker_stats(activities)


def running_global_stats(activities: DataFrame) -> DataFrame:
    return activity.global_stats(activities)


def hourly(activities: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Ended tasks and failures by stage and time window, for output mode "append": a window is out once the watermark has passed it."""
    timed = activities.where("type = 1").withColumn("end_time", F.col("end_time").cast("timestamp")).withWatermark("end_time", late)
    return timed.groupBy(F.window("end_time", width).alias("w"), "stage").agg(F.count("*").alias("tasks"), F.count_if(F.col("error").isNotNull()).alias("failed")).select(F.col("w.start").alias("start"), "stage", "tasks", "failed")


def first_submissions(submissions: DataFrame, late: str | None = None, time: str = "submitted_at") -> DataFrame:
    """The first submission of each (stage, url). late: forget keys that long after the watermark; None: never."""
    if late is None:
        return submissions.dropDuplicates(["stage", "url"])
    return submissions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["stage", "url"])


class Submit(StatefulProcessor):
    """What becomes of submissions, key by key, in the order in which they come: a known key is refused unless repeatable, and each accepted repeatable one is counted.

    The state of a key is its polls and status, kept in the state store for as long as the query.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("submit_seq")
        known, (polls, status) = self.state.exists(), self.state.get() if self.state.exists() else (0, 0)
        out = []
        for seq, repeatable in zip(every["submit_seq"], every["repeatable"]):
            fine = not known or bool(repeatable)
            polls, known = polls + (fine and bool(repeatable)), True
            out.append((seq, key[0], key[1], fine, None if fine else "task already exists"))
        self.state.update((int(polls), int(status)))
        yield pd.DataFrame(out, columns=["submit_seq", "stage", "url", "accepted", "reason"])

    def close(self) -> None:
        pass


def submitted(submissions: DataFrame) -> DataFrame:
    """OUTCOMES of a stream of submissions. Capacity is the business of batches: it spans the keys of a stage. Needs the RocksDB state store."""
    valid = submissions.where("stage <> '' and url <> ''")
    return valid.groupBy("stage", "url").transformWithStateInPandas(Submit(), OUTCOMES, "append", "none")


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what its source has by now, into the in-memory table `name`."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def source(spark, folder: str, schema: str | StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
