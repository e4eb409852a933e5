"""The task table: submissions against it, outcomes of attempts, and new snapshots of it.

A snapshot is a DataFrame; an operation gives another. The order of events is always a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenloom import schemas
from wrenloom.functions.delays import json_or_empty
from wrenloom.operators import frontier

EXISTS, NO_INSERT, NO_RECORD, FULL = "task already exists", "insert crawler task to db failed", "record not exists", "task queue is full"
_DONE = (schemas.SUCCESS, schemas.FAILED)


def submit(tasks: DataFrame, submissions: DataFrame, stages: DataFrame) -> DataFrame:
    """What becomes of each submission: submissions with accepted, enqueued, inserted, reason.

    They act as if taken one by one by submit_seq, on queues that take in queue_size tasks in all, nothing leaving meanwhile:
    a key (stage, url) that is known is refused unless repeatable; an unknown one without id is inserted, and refused if the table has it, one
    with an id needs a row. A row that has ended isn't enqueued. A full queue refuses, sets the row failed, and forgets the key.

    tasks has (id, stage, url, status) and may have `known`, whether the key is known; all are known by default. The rules need no loop:
    until a stage's queue is full, what is known follows from the first submissions of a key, so a window by key decides, and the
    first queue_size that want in find the moment when it is full (a row a stage); after it, another running sum by key sees
    whether the key was refused already.
    """
    rows = tasks.select("stage", "url", F.col("status").alias("row_status"), (F.col("known") if "known" in tasks.columns else F.lit(True)).alias("known0"))
    checked = frontier.dispatched(submissions, stages.select("stage", "queue_size"))
    bad = checked.where("reject_reason is not null")
    good = checked.where("reject_reason is null").join(rows, ["stage", "url"], "left")
    has_row, has_id = F.col("row_status").isNotNull(), F.col("id") != 0
    key = Window.partitionBy("stage", "url").orderBy("submit_seq")
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    adds = F.when(has_row, has_id).otherwise(~has_id)  # would make the key known
    good = good.withColumns({"adds": adds, "has_row": has_row})
    seen = F.coalesce("known0", F.lit(False)) | F.coalesce(F.max("adds").over(before), F.lit(False))
    good = good.withColumn("seen", seen)
    reason = (
        F.when(F.col("seen") & ~F.col("repeatable"), EXISTS)
        .when(~F.col("seen") & ~F.col("adds"), F.when(has_id, NO_RECORD).otherwise(NO_INSERT))
    )
    ended = F.coalesce(F.col("row_status").isin(*_DONE), F.lit(False))
    open_ = good.withColumn("early", reason).withColumn("wants", F.col("early").isNull() & ~ended)
    wanting = open_.where("wants")
    last = frontier.admitted(wanting.select("stage", "submit_seq"), stages).where("admitted").groupBy("stage").agg(F.max("submit_seq").alias("last_seq"), F.count("*").alias("taken"))
    sizes = stages.select(F.col("stage"), F.col("queue_size").alias("room"))
    full = sizes.join(last, "stage", "left").select("stage", F.when(F.coalesce("taken", F.lit(0)) >= F.col("room"), F.coalesce("last_seq", F.lit(-1).cast("bigint"))).alias("full_after"))
    timed = open_.join(F.broadcast(full), "stage", "left")  # a row a stage
    late = F.coalesce(F.col("submit_seq") > F.col("full_after"), F.lit(False))
    timed = timed.withColumn("refusable", late & F.col("wants"))
    refused_before = F.coalesce(F.max("refusable").over(before), F.lit(False))
    timed = timed.withColumn("after_refusal", refused_before)
    again = F.coalesce(F.max(F.col("after_refusal") & has_id).over(before), F.lit(False))  # a task with its id makes the key known again
    timed = timed.withColumn("known_again", again)
    final = (
        F.when(F.col("after_refusal"), F.when(F.col("known_again"), F.when(~F.col("repeatable"), EXISTS)).when(~has_id, NO_INSERT))
        .when(F.col("refusable"), FULL)
        .otherwise(F.col("early"))
    )
    enqueued = F.col("reason").isNull() & F.col("wants") & ~F.col("after_refusal")
    first_insert = ~has_row & ~has_id & F.col("adds") & ~F.col("seen")
    out = timed.withColumn("reason", final)
    kept = submissions.columns
    out = out.select(*kept, F.col("reason").isNull().alias("accepted"), enqueued.alias("enqueued"), first_insert.alias("inserted"), "reason")
    no = F.lit(False)
    return out.unionByName(bad.select(*kept, no.alias("accepted"), no.alias("enqueued"), no.alias("inserted"), F.col("reject_reason").alias("reason")))


def apply_submissions(tasks: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The snapshot after submit(): new rows, polls counted, refused rows failed. New ids follow the greatest, in order of submit_seq, with gaps."""
    top = tasks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    start = outcomes.agg(F.min("submit_seq").alias("s")).first()["s"] or 0
    none = F.lit(None)
    new = outcomes.where("inserted").select(
        (F.col("submit_seq") - start + top + 1).alias("id"), F.col("pid"), "stage", "url", none.cast("string").alias("title"), json_or_empty(none.cast("string")).alias("content"), F.coalesce("retry", F.lit(0)).alias("retry"),
        F.lit(schemas.PENDING).alias("status"), F.col("repeatable").cast("int").alias("repeatable"), F.lit(0).alias("repeat"), none.cast("string").alias("error"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    known = tasks.select(*new.columns).unionByName(new)
    full = F.col("reason") == FULL
    changes = outcomes.where("enqueued or inserted or accepted or reason = '" + FULL + "'").groupBy("stage", "url").agg(
        F.count_if(F.col("enqueued") & F.col("repeatable")).cast("int").alias("polls"), F.max("enqueued").alias("queued"), F.count_if(full).cast("int").alias("fulls"))
    joined = known.join(changes, ["stage", "url"], "left")
    fulls = F.coalesce("fulls", F.lit(0))
    changed = F.coalesce("queued", F.lit(False)) | (fulls > 0)
    return joined.select(
        "id", "pid", "stage", "url", "title", "content", "retry",
        F.when(fulls > 0, schemas.FAILED).when(F.coalesce("queued", F.lit(False)), schemas.PENDING).otherwise(F.col("status")).alias("status"),
        "repeatable", (F.col("repeat") + F.coalesce("polls", F.lit(0))).alias("repeat"),
        F.when(fulls > 0, F.concat(F.coalesce("error", F.lit("")), F.repeat(F.lit(FULL + "\r"), fulls))).otherwise(F.col("error")).alias("error"),
        "created_at", F.when(changed, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def resubmit(tasks: DataFrame, submissions: DataFrame, stages: DataFrame) -> DataFrame:
    """submissions with task_id and reason: only those with a row are accepted, whatever its status; the row isn't changed."""
    rows = tasks.select("stage", "url", F.col("id").alias("task_id"))
    joined = frontier.dispatched(submissions, stages.select("stage", "queue_size")).join(rows, ["stage", "url"], "left")
    reason = F.coalesce("reject_reason", F.when(F.col("task_id").isNull(), NO_RECORD))
    return joined.select(*submissions.columns, "task_id", reason.alias("reason"))


def latest(versions: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last version of each key. Reduced before the shuffle."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last")).select(*keys, "last.*").select(*versions.columns)


def polling(submissions: DataFrame) -> DataFrame:
    """The polling set: of each (stage, url) that was ever submitted as repeatable, the last such submission, even if it was refused."""
    return latest(submissions.where("repeatable and stage <> '' and url <> ''"), ["stage", "url"], "submit_seq")


def attempts(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """A row for each attempt that a task may take, 0 to max_attempts, with the wait that follows a failure."""
    from wrenloom.functions.delays import task_backoff

    rows = tasks.join(F.broadcast(stages.select("stage", "max_attempts", "backoff_ns")), "stage").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.col("max_attempts"))))
    return rows.withColumn("wait_ns", task_backoff(F.col("backoff_ns"), F.col("attempt"))).drop("max_attempts", "backoff_ns")


def outcomes(tries: DataFrame, stages: DataFrame) -> DataFrame:
    """(id, status, retries, elapsed_ns, error) of tasks from their tries (id, stage, attempt, ok, took_ns, error).

    The first good try ends a task well, and the stage's delay is waited; max_attempts + 1 bad ones fail it. Every bad try is followed by its wait. A task with
    fewer tries, none of them good, was stopped: its status stays null. Tries after the first good one, or over the limit, didn't happen.
    """
    limits = stages.select("stage", "max_attempts", "backoff_ns", "delay_ns")
    t = tries.join(F.broadcast(limits), "stage").where(F.col("attempt") <= F.col("max_attempts"))
    won = t.groupBy("id", "stage", "max_attempts", "backoff_ns", "delay_ns").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("good_at"),
        F.sort_array(F.collect_list(F.struct("attempt", "ok", "took_ns", "error"))).alias("tries"),  # max_attempts + 1 at most
    )
    real = won.withColumn("tries", F.filter("tries", lambda x: F.col("good_at").isNull() | (x["attempt"] <= F.col("good_at"))))
    spent = F.aggregate("tries", F.lit(0).cast("bigint"), lambda a, x: a + x["took_ns"] + F.when(x["ok"], F.lit(0)).otherwise(F.col("backoff_ns") * F.pow(F.lit(2), x["attempt"]).cast("bigint")))
    failed = F.col("good_at").isNull() & (F.size("tries") > F.col("max_attempts"))
    status = F.when(F.col("good_at").isNotNull(), schemas.SUCCESS).when(failed, schemas.FAILED)
    last = F.element_at("tries", -1)["error"]
    return real.select("id", "stage", status.alias("status"), (F.size("tries") - 1).alias("retries"), (spent + F.when(F.col("good_at").isNotNull(), F.col("delay_ns")).otherwise(0)).alias("elapsed_ns"), F.when(F.col("good_at").isNull(), last).alias("error"))


def fold_status(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks after status changes (id, seq, status, error, at): the last status by seq; a change to failed appends its error and a carriage return. Changes without a task, or of id 0, do nothing."""
    one = F.array_sort(F.collect_list(F.when(F.col("new_status") == schemas.FAILED, F.struct("seq", "message"))))
    folded = changes.where("id <> 0").select("id", "seq", F.col("status").alias("new_status"), F.coalesce("error", F.lit("")).alias("message"), "at").groupBy("id").agg(F.max_by("new_status", "seq").alias("new_status"), F.max("at").alias("at"), one.alias("errors"))
    text = F.array_join(F.transform("errors", lambda x: F.concat(x["message"], F.lit("\r"))), "")
    joined = tasks.join(folded, "id", "left")
    new = {
        "status": F.coalesce("new_status", "status"),
        "error": F.when(F.size("errors") > 0, F.concat(F.coalesce("error", F.lit("")), text)).otherwise(F.col("error")),
        "updated_at": F.coalesce("at", "updated_at"),
    }
    return joined.withColumns(new).select(*tasks.columns)


def with_retries(tasks: DataFrame, tries: DataFrame) -> DataFrame:
    """tasks with retry raised by one for each of their tries after the first."""
    more = tries.where("attempt > 0").groupBy("id").agg(F.count("*").cast("int").alias("_more"))
    return tasks.join(more, "id", "left").withColumn("retry", F.col("retry") + F.coalesce("_more", F.lit(0))).select(*tasks.columns)


def bulk_fail(tasks: DataFrame, ids: DataFrame, message: str) -> DataFrame:
    """tasks with those of ids failed: one more retry, the message appended to the error."""
    marked = tasks.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {"status": F.when(hit, schemas.FAILED).otherwise(F.col("status")), "retry": F.col("retry") + hit.cast("int"), "error": F.when(hit, F.concat(F.coalesce("error", F.lit("")), F.lit(message))).otherwise(F.col("error"))}
    return marked.withColumns(new).select(*tasks.columns)
