"""Statistics of worker activity. All are one hash aggregation with partial results on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenloom import schemas


def _ended(activities: DataFrame) -> DataFrame:
    return activities.where(F.col("type") == schemas.ENDED)


def _totals(failed: str) -> list[Column]:
    d = F.col("duration_ns")
    return [F.count("*").alias("total_tasks"), F.count_if(F.col("error").isNotNull()).alias(failed), F.sum(d).alias("total_time"), F.max(d).alias("max_time"), F.min(d).alias("min_time")]


def worker_stats(activities: DataFrame) -> DataFrame:
    """Tasks, failures and times of each worker of each stage, of ended tasks alone. Total tasks include the failed ones."""
    return _ended(activities).groupBy("stage", "worker_id").agg(*_totals("failed_tasks"))


def global_stats(activities: DataFrame) -> DataFrame:
    """The same of each stage, with the average cut to whole nanoseconds. min_time is the true minimum; see sentinel_min for the other."""
    return _ended(activities).groupBy("stage").agg(*_totals("total_failed")).withColumn("avg_time", F.expr("total_time div total_tasks"))


def combined_stats(activities: DataFrame) -> DataFrame:
    """Worker and stage statistics in one pass; rows of a whole stage have worker_id null and is_global true."""
    d = _ended(activities)
    rolled = d.groupingSets([[F.col("stage"), F.col("worker_id")], [F.col("stage")]], F.col("stage"), F.col("worker_id"))
    return rolled.agg(*_totals("failed_tasks"), (F.grouping(F.col("worker_id")) == 1).alias("is_global"))


def sentinel_min(activities: DataFrame) -> DataFrame:
    """(stage, min_time) where a duration of zero means "not set": the least duration after the last zero, by seq; 0 if nothing follows it.

    Two aggregations by stage; the first one's result, a row a stage, is joined back.
    """
    ended = _ended(activities)
    zero = ended.groupBy("stage").agg(F.max(F.when(F.col("duration_ns") == 0, F.col("seq"))).alias("zero_at"))
    after = F.col("zero_at").isNull() | (F.col("seq") > F.col("zero_at"))
    return ended.join(zero, "stage").groupBy("stage").agg(F.coalesce(F.min(F.when(after, F.col("duration_ns"))), F.lit(0).cast("bigint")).alias("min_time"))


def pool_counters(submissions: DataFrame, ends: DataFrame) -> DataFrame:
    """Tasks submitted, completed, failed and in progress (queued ones included) of each stage. submissions: (stage, ..); ends: (stage, error)."""
    put = submissions.groupBy("stage").agg(F.count("*").alias("submitted"))
    got = ends.groupBy("stage").agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    joined = put.join(got, "stage", "left").select("stage", "submitted", none("completed").alias("completed"), none("failed").alias("failed"))
    return joined.withColumn("in_progress", F.col("submitted") - F.col("completed") - F.col("failed"))


def monitor_json(activities: DataFrame) -> DataFrame:
    """(stage, json): the statistics of a stage and, by number, of its workers."""
    one = F.struct("total_tasks", "failed_tasks", "total_time", "max_time", "min_time")
    workers = worker_stats(activities).groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("worker_id").cast("string"), one)))).alias("workers"))
    whole = global_stats(activities).select("stage", F.struct("total_tasks", "total_failed", "total_time", "avg_time", "max_time", "min_time").alias("global"))
    return whole.join(workers, "stage").select("stage", F.to_json(F.struct("global", "workers")).alias("json"))


def monitor_view(activities: DataFrame) -> DataFrame:
    """What a page about the workers shows: times in seconds, with two decimals, averages with three."""
    s = global_stats(activities)
    show = lambda c, n: F.format_string(f"%.{n}f", F.col(c) / 1_000_000_000).alias(c)
    return s.select("stage", "total_tasks", "total_failed", show("total_time", 2), show("avg_time", 3), show("max_time", 2), show("min_time", 2))


def log_of(component: str, ts: Column, message: Column) -> list[Column]:
    """Columns of a row of the common log."""
    return [F.lit(component).alias("component"), ts.alias("ts"), message.alias("message")]


def merged_log(*logs: DataFrame) -> DataFrame:
    """The logs of several components as one; rows without a message are no messages."""
    first, *rest = logs
    for x in rest:
        first = first.unionByName(x)
    return first.where("message is not null")
