"""The frontier of URLs: checks, removal of known ones, links of stored pages, assignment to workers and proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenloom.checkpoints import checkpointed
from wrenloom.functions import urls

LONGEST_URL = 500


def reject_reason(stage: Column, url: Column, known: Column) -> Column:
    """Why a submission isn't valid, or null. known: whether the stage is in the settings."""
    blank = (F.coalesce(stage, F.lit("")) == "") | (F.coalesce(url, F.lit("")) == "")
    return F.when(blank, F.lit("task stage or url is empty")).when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("invalid stage : "), stage))


def dispatched(submissions: DataFrame, stages: DataFrame) -> DataFrame:
    """submissions with the settings of their stages (null without any) and reject_reason. The stages are a few rows of settings."""
    one = stages.withColumnRenamed("stage", "stage_name")
    joined = submissions.join(F.broadcast(one), F.col("stage") == F.col("stage_name"), "left")
    return joined.withColumn("reject_reason", reject_reason(F.col("stage"), F.col("url"), F.col("stage_name").isNotNull())).drop("stage_name")


def first_of_each(submissions: DataFrame) -> DataFrame:
    """The earliest submission of each (stage, url). A minimum of structs, so that most rows go before the shuffle."""
    rest = [c for c in submissions.columns if c not in ("stage", "url", "submit_seq")]
    best = submissions.groupBy("stage", "url").agg(F.min_by(F.struct("submit_seq", *rest), F.col("submit_seq")).alias("best"))
    return best.select("stage", "url", "best.*").select(*submissions.columns)


def unknown_only(submissions: DataFrame, known: DataFrame) -> DataFrame:
    """Submissions whose (stage, url) isn't in known. Joined by both columns: joined strings could be alike for different pairs."""
    return submissions.join(known.select("stage", "url").distinct(), ["stage", "url"], "left_anti").select(*submissions.columns)


def known_keys(tasks: DataFrame) -> DataFrame:
    return tasks.where("id > 0").select("stage", "url").distinct()


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, href): the double-quoted href attributes of each page, in order."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(urls.HREF), F.lit(1))).alias("position", "href"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """links() with the URL that each means, seen from its page."""
    return links(pages).withColumn("target", urls.resolve(F.col("href"), urls.base_of(F.col("url"))))


def children(pages: DataFrame, stage: str, parents: DataFrame | None = None) -> DataFrame:
    """Tasks of the next stage: the distinct URLs that pages link to, with the least page as parent. parents: (page_id, pid) to use instead of page ids."""
    out = resolved_links(pages).groupBy(F.col("target").alias("url")).agg(F.min("page_id").alias("page_id"))
    if parents is None:
        return out.select(F.lit(stage).alias("stage"), "url", F.col("page_id").alias("pid"))
    return out.join(parents, "page_id").select(F.lit(stage).alias("stage"), "url", "pid")


def admitted(submissions: DataFrame, stages: DataFrame) -> DataFrame:
    """submissions with `admitted`: whether the stage's queue still has room, in order of submit_seq.

    Only the first queue_size of a stage get in; finding them needs no sort of the rest: each partition sends its own first ones (a limit
    below the window), and the sequence number of the last one admitted, a row a stage, is compared with all.
    """
    sizes = [(r["stage"], r["queue_size"]) for r in stages.select("stage", "queue_size").collect()]  # settings: a few rows
    limit = max([q for _, q in sizes], default=0)
    per_stage = F.broadcast(stages.select("stage", "queue_size"))
    ranked = submissions.select("stage", "submit_seq").withColumn("place", F.row_number().over(Window.partitionBy("stage").orderBy("submit_seq"))).where(F.col("place") <= limit)
    last = ranked.join(per_stage, "stage").where("place <= queue_size").groupBy("stage").agg(F.max("submit_seq").alias("last_seq"))
    joined = submissions.join(F.broadcast(last), "stage", "left")
    return joined.withColumn("admitted", F.coalesce(F.col("submit_seq") <= F.col("last_seq"), F.lit(False))).drop("last_seq")


def workers_of(tasks: DataFrame, stages: DataFrame, seq: str = "submit_seq") -> DataFrame:
    """tasks with worker_id: turn by turn among the workers of the stage."""
    return tasks.join(F.broadcast(stages.select("stage", "worker_count")), "stage").withColumn("worker_id", F.pmod(F.col(seq), F.col("worker_count")).cast("int")).drop("worker_count")


def proxy_list(documents: DataFrame, column: str = "body") -> DataFrame:
    """(position, proxy): the entries of JSON lists of {"host", "port"}, in order, numbered from 0. Malformed JSON has none."""
    rows = documents.select(F.posexplode(F.from_json(F.col(column).cast("string"), "array<map<string,string>>")).alias("position", "entry"))
    return rows.select("position", urls.proxy_url(F.col("entry")["host"], F.col("entry")["port"]).alias("proxy"))


def with_proxies(launches: DataFrame, proxies: DataFrame, turn: str = "turn") -> DataFrame:
    """launches with `proxy`: the n-th launch (from 0) gets proxy n modulo their number; "" if there are none. proxies: (position, proxy), a list that one service answers with."""
    many = proxies.count()
    if not many:
        return launches.withColumn("proxy", F.lit(""))
    numbered = proxies.withColumnRenamed("position", "_position")
    numbered = F.broadcast(numbered) if many <= 100_000 else numbered
    return launches.join(numbered, F.pmod(F.col(turn), F.lit(many)) == F.col("_position")).drop("_position")


def once_per_transfer(requests: DataFrame) -> DataFrame:
    """Of transfers with one source, folder and file, the earliest."""
    rest = [c for c in requests.columns if c not in ("url", "folder", "file", "submit_seq")]
    best = requests.groupBy("url", "folder", "file").agg(F.min_by(F.struct("submit_seq", *rest), F.col("submit_seq")).alias("best"))
    return best.select("url", "folder", "file", "best.*").select(*requests.columns)


def task_tree(tasks: DataFrame) -> DataFrame:
    """(id, root, depth) of each task that hangs on a root (pid 0); depth 0 is the root.

    By pointer doubling: each round looks twice as far up, so a chain of a million tasks takes some twenty joins. Tasks below a missing one or on a
    cycle hang on no root and are left out, as are null ids and pids; an empty table gives an empty result. Ids are taken to be distinct.
    """
    root = F.col("pid") == 0
    state = checkpointed(tasks.where("id is not null and pid is not null").select("id", F.when(root, F.col("id")).otherwise(F.col("pid")).alias("up"), F.when(root, 0).otherwise(1).alias("depth"), root.alias("done")))
    for _ in range(state.count().bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        stepped = state.where("not done").join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        state = checkpointed(state.where("done").unionByName(stepped))
    return state.where("done").select("id", F.col("up").alias("root"), "depth")


def with_parents(tasks: DataFrame) -> DataFrame:
    """(id, pid, parent_stage, parent_url) of tasks that have a parent in the table."""
    above = tasks.select(F.col("id").alias("_id"), F.col("stage").alias("parent_stage"), F.col("url").alias("parent_url"))
    return tasks.join(above, F.col("pid") == F.col("_id")).select("id", "pid", "parent_stage", "parent_url")
