"""The task table against a literal simulation of one submission after the other."""

from __future__ import annotations

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wrenloom import config, schemas
from wrenloom.operators import frontier, jobs
from wrenloom.operators import tasks as task_table

NOW = datetime.datetime(2024, 6, 1)


def simulate(rows, subs, queues):
    """The decisions one by one. rows: {(stage, url): [id, status, known]}."""
    table = {k: list(v) for k, v in rows.items()}
    known = {k for k, v in rows.items() if v[2]}
    left = dict(queues)
    out = []
    for seq, task_id, stage, url, repeatable in subs:
        key = (stage, url)

        def say(accepted, enqueued, inserted, reason):
            out.append((seq, accepted, enqueued, inserted, reason))

        if not stage or not url:
            say(False, False, False, "task stage or url is empty")
            continue
        if stage not in queues:
            say(False, False, False, "invalid stage : " + stage)
            continue
        if key in known and not repeatable:
            say(False, False, False, task_table.EXISTS)
            continue
        inserted = False
        if key not in known:
            if not task_id:
                if key in table:
                    say(False, False, False, task_table.NO_INSERT)
                    continue
                table[key] = [1000 + seq, schemas.PENDING, True]
                inserted = True
            elif key not in table:
                say(False, False, False, task_table.NO_RECORD)
                continue
        known.add(key)
        if table[key][1] in (schemas.SUCCESS, schemas.FAILED):
            say(True, False, inserted, None)
        elif not left[stage]:
            known.discard(key)
            table[key][1] = schemas.FAILED
            say(False, False, inserted, task_table.FULL)
        else:
            left[stage] -= 1
            table[key][1] = schemas.PENDING
            say(True, True, inserted, None)
    return out


keys = st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["u", "v", "w"]))
submissions = st.lists(st.tuples(keys, st.booleans(), st.booleans()), min_size=1, max_size=14)
tables = st.dictionaries(keys, st.tuples(st.integers(0, 3), st.booleans()), max_size=5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(tables, submissions, st.integers(1, 4), st.integers(1, 3)), min_size=12, max_size=12))
def test_submit_is_the_simulation(spark, cases):
    """Several cases share a job, each with stages of its own name."""
    expected, rows, subs, stages = [], [], [], []
    for n, (table, given_subs, room_a, room_b) in enumerate(cases):
        name = lambda s: f"{s}{n}"  # noqa: E731, B023
        queues = {name("a"): room_a, name("b"): room_b}
        have = {(name(s), u): (i + 1, status, known) for i, ((s, u), (status, known)) in enumerate(sorted(table.items()))}
        mine = []
        for (s, u), repeatable, with_id in given_subs:
            key = (name(s), u)
            mine.append((len(subs) + len(mine), have[key][0] if with_id and key in have else 0, *key, repeatable))
        expected += simulate(have, mine, queues)
        rows += [(v[0], *k, v[1], v[2]) for k, v in have.items()]
        subs += mine
        stages += [config.Stage(s, 1, q) for s, q in queues.items()]
    t = spark.createDataFrame(rows, "id bigint, stage string, url string, status int, known boolean")
    s = spark.createDataFrame([(q, i, 0, u, 0, st_, r) for q, i, st_, u, r in subs], schemas.SUBMISSIONS)
    got = task_table.submit(t, s, config.stage_table(spark, stages)).select("submit_seq", "accepted", "enqueued", "inserted", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def _stages(spark, room=2):
    return config.stage_table(spark, [config.Stage("first", 1, room), config.Stage("second", 1, 5)])


def _tasks(spark, rows):
    """rows: (id, url, status, error, hours ago)."""
    return spark.createDataFrame([(i, 0, "first", u, None, "{}", 0, s, 0, 0, e, NOW, NOW - datetime.timedelta(hours=h)) for i, u, s, e, h in rows], schemas.TASKS)


def _subs(spark, rows):
    return spark.createDataFrame([(q, 0, 0, u, 0, s, r) for q, s, u, r in rows], schemas.SUBMISSIONS)


def test_submit_and_snapshot(spark):
    t = _tasks(spark, [(1, "done", 2, None, 1), (2, "open", 0, None, 1)])
    s = _subs(spark, [(1, "", "x", False), (2, "catalog", "x", False), (3, "first", "", False), (4, "first", "done", False), (5, "first", "done", True), (6, "first", "open", True), (7, "first", "new", True), (8, "first", "late", False), (9, "first", "late", False)])
    out = task_table.submit(t, s, _stages(spark))
    got = {r["submit_seq"]: (r["accepted"], r["enqueued"], r["reason"]) for r in out.collect()}
    assert got == {
        1: (False, False, "task stage or url is empty"), 2: (False, False, "invalid stage : catalog"), 3: (False, False, "task stage or url is empty"), 4: (False, False, task_table.EXISTS), 5: (True, False, None),
        6: (True, True, None), 7: (True, True, None), 8: (False, False, task_table.FULL), 9: (False, False, task_table.NO_INSERT),
    }
    after = {r["url"]: r for r in task_table.apply_submissions(t, out, F.lit(NOW)).collect()}
    assert (after["new"]["id"], after["new"]["repeat"], after["new"]["repeatable"], after["new"]["content"]) == (9, 1, 1, "{}")
    assert (after["late"]["status"], after["late"]["error"]) == (schemas.FAILED, task_table.FULL + "\r")
    assert after["open"]["repeat"] == 1 and after["done"]["status"] == 2


def test_recover_fails_what_does_not_fit(spark):
    t = _tasks(spark, [(1, "a", 0, None, 7), (2, "b", 1, "x\r", 8), (3, "c", 0, "y\r", 9), (4, "d", 0, None, 6), (5, "e", 2, None, 99)])
    outcomes, snapshot = jobs.recover(t, _stages(spark), F.lit(NOW))
    assert sorted((r["id"], r["accepted"]) for r in outcomes.collect()) == [(1, True), (2, True), (3, False)]
    rows = {r["id"]: r for r in snapshot.collect()}
    assert [rows[i]["status"] for i in (1, 2, 3, 4, 5)] == [0, 0, 3, 0, 2]
    assert rows[3]["retry"] == 1 and rows[3]["error"] == "y\r" + jobs.ROLLBACK and rows[2]["error"] == "x\r"
    assert rows[1]["updated_at"] == NOW and rows[4]["updated_at"] != NOW


def test_repeat_runs_ended_tasks_again(spark):
    t = _tasks(spark, [(1, "a", 2, None, 1), (2, "b", 3, None, 1)])
    polled = task_table.polling(_subs(spark, [(1, "first", "a", True), (2, "first", "a", True), (3, "first", "b", False), (4, "first", "gone", True)]))
    got = jobs.repeat(t, polled, _stages(spark)).collect()
    assert [(r["submit_seq"], r["id"], r["enqueued"]) for r in got] == [(2, 1, True)]


def test_outcomes(spark):
    stages = config.stage_table(spark, [config.Stage("s", 1, 1, 5, 2, 10)])
    tries = [(1, "s", 0, False, 1, "e0"), (1, "s", 1, True, 2, None), (1, "s", 2, False, 9, "no"), (2, "s", 0, False, 1, "x"), (2, "s", 1, False, 1, "y"), (2, "s", 2, False, 1, "z"), (3, "s", 0, False, 4, "cut")]
    df = spark.createDataFrame(tries, "id bigint, stage string, attempt int, ok boolean, took_ns bigint, error string")
    got = {r["id"]: (r["status"], r["retries"], r["elapsed_ns"], r["error"]) for r in task_table.outcomes(df, stages).collect()}
    assert got == {1: (2, 1, 1 + 10 + 2 + 5, None), 2: (3, 2, 3 + 10 + 20 + 40, "z"), 3: (None, 0, 14, "cut")}


def test_fold_status(spark):
    t = _tasks(spark, [(1, "a", 0, "was\r", 1), (2, "b", 0, None, 1)])
    changes = spark.createDataFrame([(1, 2, 3, "two", NOW), (1, 1, 3, "one", NOW), (1, 3, 2, None, NOW), (0, 4, 3, "none", NOW), (9, 5, 3, "gone", NOW)], "id bigint, seq bigint, status int, error string, at timestamp")
    got = {r["id"]: (r["status"], r["error"]) for r in task_table.fold_status(t, changes).collect()}
    assert got == {1: (2, "was\rone\rtwo\r"), 2: (0, None)}


def test_empty_tables(spark):
    t, s = spark.createDataFrame([], schemas.TASKS), spark.createDataFrame([], schemas.SUBMISSIONS)
    out = task_table.submit(t, s, _stages(spark))
    assert out.count() == 0 and task_table.apply_submissions(t, out, F.lit(NOW)).count() == 0


def test_task_tree_is_deep_and_whole(spark):
    """A chain of 300, a wide root, a cycle, a task below a missing one."""
    rows = [(i, i - 1) for i in range(1, 301)] + [(1000, 0)] + [(1001 + i, 1000) for i in range(500)] + [(2001, 2002), (2002, 2001), (2003, 2001), (3001, 3000), (None, 1), (4000, None)]
    got = {r["id"]: (r["root"], r["depth"]) for r in frontier.task_tree(spark.createDataFrame(rows, "id bigint, pid bigint")).collect()}
    assert got == {i: (1, i - 1) for i in range(1, 301)} | {1000: (1000, 0)} | {1001 + i: (1000, 1) for i in range(500)}
    assert frontier.task_tree(spark.createDataFrame([], "id bigint, pid bigint")).count() == 0
