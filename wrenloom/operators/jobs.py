"""Periodic jobs: recovery of stale tasks, polling, and when a schedule fires next."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenloom import schemas
from wrenloom.operators import tasks as task_table

STALE_HOURS = 6
ROLLBACK = "recover failed\r"


def stale(tasks: DataFrame, as_of: Column, hours: int = STALE_HOURS) -> DataFrame:
    """Tasks neither ended nor touched in the last hours. Both conditions reach the scan."""
    return tasks.where(F.col("status").isin(schemas.PENDING, schemas.PROCESSING) & (F.col("updated_at") < as_of - F.expr(f"interval {hours} hours")))


def recover(tasks: DataFrame, stages: DataFrame, as_of: Column, hours: int = STALE_HOURS) -> tuple[DataFrame, DataFrame]:
    """(submissions' outcomes, new snapshot): stale tasks are forgotten, set pending and submitted again with their ids, never as repeatable.

    Those that are refused are failed in bulk, with one more retry.
    """
    old = stale(tasks, as_of, hours)
    again = old.select(F.col("id").alias("submit_seq"), "id", "pid", "url", "retry", "stage", F.lit(False).alias("repeatable"))
    known = tasks.join(old.select("id").withColumn("_old", F.lit(True)), "id", "left").select("id", "stage", "url", F.when(F.col("_old"), schemas.PENDING).otherwise(F.col("status")).alias("status"), F.col("_old").isNull().alias("known"))
    outcomes = task_table.submit(known, again, stages)
    went, refused = outcomes.where("accepted").select("id"), outcomes.where("not accepted").select("id")
    touched = tasks.join(went.withColumn("_went", F.lit(True)), "id", "left")
    moved = F.coalesce("_went", F.lit(False))
    fresh = touched.withColumns({"status": F.when(moved, schemas.PENDING).otherwise(F.col("status")), "updated_at": F.when(moved, as_of).otherwise(F.col("updated_at"))}).select(*tasks.columns)
    return outcomes, task_table.bulk_fail(fresh, refused, ROLLBACK)


def repeat(tasks: DataFrame, polled: DataFrame, stages: DataFrame) -> DataFrame:
    """Outcomes of submitting the polling set again, one for each: every polled row is set pending first, so that ended ones run once more. Of rows with one stage and URL, the one with the least id counts."""
    state = F.struct(*[c for c in ("id", "status", "known") if c in tasks.columns])
    rows = tasks.groupBy("stage", "url").agg(F.min_by(state, F.col("id")).alias("row")).select("stage", "url", "row.*")
    again = polled.join(rows.select("stage", "url", F.col("id").alias("row_id")), ["stage", "url"]).select("submit_seq", F.col("row_id").alias("id"), "pid", "url", "retry", "stage", F.lit(True).alias("repeatable"))
    reset = rows.join(again.select("stage", "url").distinct().withColumn("_on", F.lit(True)), ["stage", "url"], "left").withColumn("status", F.when(F.col("_on"), schemas.PENDING).otherwise(F.col("status"))).drop("_on")
    return task_table.submit(reset, again, stages)


_RANGES = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
_MACROS = {"@yearly": "0 0 0 1 1 *", "@annually": "0 0 0 1 1 *", "@monthly": "0 0 0 1 * *", "@weekly": "0 0 0 * * 0", "@daily": "0 0 0 * * *", "@midnight": "0 0 0 * * *", "@hourly": "0 0 * * * *"}


def _values(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    number = lambda s: names[s.lower()] if s.lower() in names else int(s)
    for term in text.split(","):
        span, _, step = term.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = map(number, span.split("-"))
        else:
            a = number(span)
            b = high if step else a
        if high == 6 and b == 7:  # Sunday at the end of the week
            out.add(0)
            b = 6
            a = min(a, 7)
        by = int(step) if step else 1
        if by <= 0 or a < low or b > high or a > b + 1:
            raise ValueError(f"not a cron field: {term!r}")
        out.update(range(a, b + 1, by))
    return out


def next_fire(schedule: str, after: datetime) -> datetime | None:
    """When a cron schedule of five fields, or of six with seconds first, fires next after a moment; None if not in five years.

    If neither the day of the month nor that of the week is "*", either will do.
    """
    fields = _MACROS.get(schedule.strip(), schedule).split()
    if len(fields) == 5:
        fields = ["0", *fields]
    if len(fields) != 6:
        raise ValueError(f"a schedule has five or six fields: {schedule!r}")
    sets = [_values(f, lo, hi, _MONTHS if i == 4 else _DAYS if i == 5 else {}) for i, (f, (lo, hi)) in enumerate(zip(fields, _RANGES))]
    seconds, minutes, hours, days, months, weekdays = sets
    free = [f[0] in "*?" for f in (fields[3], fields[5])]
    t = (after + timedelta(seconds=1)).replace(microsecond=0)
    end = after + timedelta(days=5 * 366)
    while t <= end:
        by_day, by_week = t.day in days, (t.weekday() + 1) % 7 in weekdays
        if t.month not in months or not (by_day and by_week if any(free) else by_day or by_week):
            t = t.replace(hour=0, minute=0, second=0) + timedelta(days=1)
        elif t.hour not in hours:
            t = t.replace(minute=0, second=0) + timedelta(hours=1)
        elif t.minute not in minutes:
            t = t.replace(second=0) + timedelta(minutes=1)
        elif t.second not in seconds:
            t += timedelta(seconds=1)
        else:
            return t
    return None
