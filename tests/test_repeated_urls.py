"""Pages that share a URL: each counts where the SQL has a row for each page, and a task is still one task."""

from __future__ import annotations

import pytest

from compare import difference
from wrenloom import config, schemas
from wrenloom.operators import jobs
from wrenloom.plans import catalogue, rounds
from wrenloom.sources.transport import Offline

#: By page: the earlier one whose URL it has too. 40 and 20, and 48 and 8, are both in the task table of repeat_job; 36, 33 and 31 differ in their ranges.
TWICE = {40: 20, 48: 8, 50: 41, 36: 31, 33: 31, 25: 24}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, f"https://h{i % 3}.example/d/{TWICE.get(i, i)}", f'<p>page {i}, wörds</p><a href="/only/{i}"></a><a href="https://h0.example/d/{i // 2}">') for i in range(60)]
    to = tmp_path_factory.mktemp("repeated")
    urls = {i: u for i, u, _ in rows}
    spark.createDataFrame([(i, urls[TWICE.get(i, i)], h) for i, _, h in rows], "page_id bigint, url string, html string").write.parquet(str(to / "pages.parquet"))
    return str(to)


@pytest.mark.parametrize("name", ["crawl_rounds", "head_probe", "offline_fetch", "repeat_job"])
def test_query_equals_sql(spark, folder, name):
    assert difference(catalogue.queries()[name](spark, folder), folder, catalogue.oracle_sql()[name]) == ""


def test_pages_with_one_url_are_one_task(spark):
    pages = spark.createDataFrame([("https://h/a", '<a href="/b">'), ("https://h/a", '<a href="/c">'), ("https://h/a", None), ("https://h/d", None)], "url string, html string")
    crawl = rounds.Crawl(spark, [config.Stage("list", 2, 10), config.Stage("item", 2, 10)], Offline(pages), [rounds.follow_links("list", "item")])
    out = crawl.run(pages.selectExpr("'list' AS stage", "url"), 1, "2024-06-01 00:00:00")
    assert sorted((r["url"], r["status"]) for r in crawl.tasks.collect()) == [("https://h/a", 2), ("https://h/d", 3)]
    assert sorted(r["url"] for r in out[0].children.collect()) == ["https://h/b", "https://h/c"]
    assert sorted((r["url"], r["error"]) for r in out[0].activities.collect()) == [("https://h/a", None), ("https://h/d", "status 404")]


def test_rows_with_one_key_are_polled_once(spark):
    """Of two rows the first runs, and the queue of two has room for the other key."""
    t = spark.createDataFrame([(3, "first", "a", 2), (1, "first", "a", 3), (2, "first", "b", 0)], "id bigint, stage string, url string, status int")
    polled = spark.createDataFrame([(7, 0, 0, "a", 0, "first", True), (8, 0, 0, "b", 0, "first", True)], schemas.SUBMISSIONS)
    got = jobs.repeat(t, polled, config.stage_table(spark, [config.Stage("first", 1, 2)])).collect()
    assert sorted((r["submit_seq"], r["id"], r["enqueued"]) for r in got) == [(7, 1, True), (8, 2, True)]
