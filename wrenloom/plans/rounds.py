"""A crawl as rounds of DataFrame jobs: submit, fetch, fold the outcomes, find children, again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenloom import config, schemas
from wrenloom.checkpoints import checkpointed
from wrenloom.operators import frontier, jobs
from wrenloom.operators import tasks as task_table
from wrenloom.sources.transport import Transport

#: A stage's own work: from the tasks taken (stage, url, id, pid, ..) with their responses (status, headers, body, fault) to submissions of
#: other stages (stage, url, pid), or None. Tasks of every stage reach it together; it picks its own.
Handler = Callable[[DataFrame], DataFrame]


def follow_links(stage: str, then: str) -> Handler:
    """The usual handler: the links in the pages of a stage become tasks of the next, with the page's task as parent."""

    def handle(fetched: DataFrame) -> DataFrame:
        pages = fetched.where((F.col("stage") == stage) & F.col("body").isNotNull()).select(F.col("id").alias("page_id"), "url", F.decode("body", "UTF-8").alias("html"))
        return frontier.children(pages, then)

    return handle


@dataclass
class Round:
    """What one round gave: outcomes of its submissions, the activity of its workers, the children found."""

    outcomes: DataFrame
    activities: DataFrame
    children: DataFrame | None


@dataclass
class Crawl:
    """Stages, how pages are had, and what is done with them. All state is the snapshot `tasks`; each round's is checkpointed, so that plans don't grow with the rounds and a lost executor costs no round."""

    spark: SparkSession
    stages: list[config.Stage]
    transport: Transport
    handlers: list[Handler] = field(default_factory=list)
    tasks: DataFrame | None = None
    seq: int = 0

    def __post_init__(self) -> None:
        if self.tasks is None:
            self.tasks = self.spark.createDataFrame([], schemas.TASKS)
        self.stage_table = config.stage_table(self.spark, self.stages)

    def run(self, seeds: DataFrame, rounds: int, as_of: str) -> list[Round]:
        """Rounds until nothing new is found, `rounds` at most. seeds: (stage, url), or with pid and repeatable too."""
        out: list[Round] = []
        found: DataFrame | None = seeds
        while found is not None and len(out) < rounds:
            one = self.round(found, as_of)
            out.append(one)
            found = one.children if one.children is not None and not one.children.isEmpty() else None
        return out

    def numbered(self, found: DataFrame) -> DataFrame:
        """Submissions with a sequence number: by stage and URL, from a window over hash buckets, whose sizes give each bucket its start."""
        plain = {"pid": F.lit(0).cast("bigint"), "repeatable": F.lit(False), "id": F.lit(0).cast("bigint"), "retry": F.lit(0)}
        rows = found.withColumns({k: v for k, v in plain.items() if k not in found.columns})
        buckets = rows.withColumn("_b", F.pmod(F.xxhash64("stage", "url"), F.lit(64)).cast("int"))
        sizes = {r["_b"]: r["n"] for r in buckets.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # 64 rows at most
        starts, at = {}, self.seq
        for b in sorted(sizes):
            starts[b], at = at, at + sizes[b]
        self.seq = at
        first = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_b")) if starts else F.lit(0)
        ranked = buckets.withColumn("_n", F.expr("row_number() over (partition by _b order by stage, url, pid)"))
        return ranked.select((first + F.col("_n")).cast("bigint").alias("submit_seq"), "id", "pid", "url", "retry", "stage", "repeatable")

    def round(self, found: DataFrame, as_of: str) -> Round:
        now = F.lit(as_of).cast("timestamp")
        submissions = checkpointed(self.numbered(found))
        outcomes = checkpointed(task_table.submit(self.tasks, submissions, self.stage_table))
        snapshot = checkpointed(task_table.apply_submissions(self.tasks, outcomes, now))
        taken = outcomes.where("enqueued").select("stage", "url", "submit_seq").join(snapshot.select("id", "stage", "url", "pid"), ["stage", "url"])
        answers = self.transport.fetch(taken.select("url").distinct()).select("url", F.col("status").alias("http_status"), "headers", "body", F.col("error").alias("fault"))
        fetched = checkpointed(taken.join(answers, "url", "left").withColumn("fault", F.when(F.col("http_status").isNull(), F.coalesce("fault", F.lit("no response"))).otherwise(F.col("fault"))))
        changes = fetched.select("id", F.col("submit_seq").alias("seq"), F.when(F.col("fault").isNull(), schemas.SUCCESS).otherwise(schemas.FAILED).alias("status"), F.col("fault").alias("error"), now.alias("at"))
        self.tasks = checkpointed(task_table.fold_status(snapshot, changes))
        once = fetched.select("stage", "submit_seq", "url", "fault").distinct()  # a URL may have several answers
        worked = frontier.workers_of(once, self.stage_table)
        activities = worked.select("stage", F.col("submit_seq").alias("seq"), F.lit(schemas.ENDED).alias("type"), F.col("worker_id").cast("bigint").alias("worker_id"), "url", now.alias("start_time"), now.alias("end_time"), F.lit(0).cast("bigint").alias("duration_ns"), F.col("fault").alias("error"))
        children = None
        for handler in self.handlers:
            more = handler(fetched)
            children = more if children is None else children.unionByName(more)
        return Round(outcomes, activities, None if children is None else checkpointed(children.distinct()))

    def recover(self, as_of: str) -> DataFrame:
        """Outcomes of submitting stale tasks again; the snapshot is replaced."""
        outcomes, snapshot = jobs.recover(self.tasks, self.stage_table, F.lit(as_of).cast("timestamp"))
        outcomes, self.tasks = checkpointed(outcomes), checkpointed(snapshot)
        return outcomes


def dispatch(crawl: Crawl, kind: str, as_of: str, polled: DataFrame | None = None) -> DataFrame:
    """The outcomes of a job by its type: recover or repeat. Others: ValueError."""
    if kind == "recover":
        return crawl.recover(as_of)
    if kind == "repeat":
        if polled is None:
            raise ValueError("a repeat job needs the polling set")
        return jobs.repeat(crawl.tasks, polled, crawl.stage_table)
    raise ValueError(f"unknown job type: {kind}")
