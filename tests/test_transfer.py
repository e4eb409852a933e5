"""Transfers in parts: plans cover, resumption completes, reassembly restores."""

from __future__ import annotations

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wrenloom import schemas
from wrenloom.operators import activity, transfer
from wrenloom.sources import store

COMMON = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(max_examples=5, **COMMON)
@given(st.lists(st.tuples(st.binary(max_size=60), st.integers(-1, 20)), min_size=10, max_size=10))
def test_cut_and_join_are_inverse(spark, assets):
    df = spark.createDataFrame([(i, len(b), c, b) for i, (b, c) in enumerate(assets)], "asset_id bigint, total bigint, chunk_size bigint, content binary")
    parts = transfer.cut(df)
    got = {r["asset_id"]: bytes(r["content"]) for r in transfer.joined(parts.orderBy(F.rand(1))).collect()}
    assert got == {i: b for i, (b, c) in enumerate(assets) if b and c > 0}
    plan: dict = {}
    for r in transfer.plan(df).collect():
        plan.setdefault(r["asset_id"], []).append((r["start"], r["end"]))
    for i, spans in plan.items():
        assert [x for a, b in sorted(spans) for x in range(a, b + 1)] == list(range(len(assets[i][0])))


def test_resume(spark):
    assets = spark.createDataFrame([(1, 36, 10), (2, 30, 10)], "asset_id bigint, total bigint, chunk_size bigint")
    states = spark.createDataFrame([(1, 36, 10, [0, 20]), (2, 31, 10, [0])], "asset_id bigint, total bigint, chunk_size bigint, completed array<bigint>")
    left = transfer.pending(transfer.plan(assets), transfer.valid_states(states, assets))
    assert sorted((r["asset_id"], r["start"]) for r in left.collect()) == [(1, 10), (1, 30), (2, 0), (2, 10), (2, 20)]


def test_playlist_states(spark):
    segs = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "playlist_id bigint, idx int")
    states = spark.createDataFrame([(1, 2, [0]), (2, 5, [0])], "playlist_id bigint, total_segments int, completed array<int>")
    good = transfer.valid_playlist_states(states, segs)
    left = transfer.pending(segs, good, "playlist_id", "idx")
    assert sorted(map(tuple, left.collect())) == [(1, 1), (2, 0)]


def test_pace(spark):
    df = spark.createDataFrame([(1, 0, 512), (1, 1, 1024), (1, 2, 2000), (1, 3, 512)], "asset_id bigint, done_seq bigint, bytes bigint")
    got = {r["done_seq"]: r["ready_ns"] for r in transfer.paced(df, 1).collect()}
    assert got == {0: 0, 1: 500_000_000, 2: None, 3: 1_000_000_000}
    assert {r["ready_ns"] for r in transfer.paced(df, 0).collect()} == {0}


def test_first_error(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (1, 0, None), (2, 0, None)], "asset_id bigint, idx int, error string")
    assert {r["asset_id"]: r["error"] for r in transfer.first_error(df).collect()} == {1: "early", 2: None}


def test_probe(spark):
    rows = [("a", 200, {"Content-Length": "12", "ACCEPT-RANGES": "Bytes"}, None, None), ("b", 404, {"Content-Length": "12"}, None, None), ("c", 200, {}, None, None), ("d", None, None, None, "gone")]
    got = {r["url"]: (r["size"], r["rangeable"]) for r in transfer.probe(spark.createDataFrame(rows, schemas.RESPONSES)).collect()}
    assert got == {"a": (12, True), "b": (0, False), "c": (0, False), "d": (0, False)}


def test_store(spark, tmp_path):
    state = spark.createDataFrame([("u", "f", 9, [5, 0], 5, ["b", "a"])], schemas.FILE_STATE)
    where = str(tmp_path / "state")
    assert store.load_state(spark, where, schemas.FILE_STATE).count() == 0
    store.save_state(state, where)
    assert store.load_state(spark, where, schemas.FILE_STATE).first()["completed"] == [0, 5]
    listed = store.files(spark, where)
    assert listed.count() > 0
    later = F.lit(datetime.datetime.now() + datetime.timedelta(days=2))
    assert all(r["name"].endswith(".json") for r in store.expired(listed, later).collect())
    store.drop_state(spark, where)
    assert store.load_state(spark, where, schemas.FILE_STATE).count() == 0
    parts = spark.createDataFrame([(1, 3, b"def"), (1, 0, b"abc"), (2, 0, b"x")], "asset_id bigint, start bigint, data binary")
    store.write_parts(parts, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"1": b"abcdef", "2": b"x"}


@settings(max_examples=5, **COMMON)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=12), min_size=20, max_size=20))
def test_sentinel_is_the_fold(spark, runs):
    rows = [(str(i), q, 1, 0, d) for i, run in enumerate(runs) for q, d in enumerate(run)]
    df = spark.createDataFrame(rows, "stage string, seq bigint, type int, worker_id bigint, duration_ns bigint")
    got = {r["stage"]: r["min_time"] for r in activity.sentinel_min(df).collect()}
    for i, run in enumerate(runs):
        least = 0
        for d in run:
            if d < least or least == 0:
                least = d
        assert got[str(i)] == least


def test_stats_count_ended_tasks_only(spark):
    rows = [("s", 1, 0, 1, 5, None), ("s", 2, 1, 1, 7, None), ("s", 3, 1, 1, 4, "bad"), ("s", 4, 1, 2, 10, None), ("s", 5, 2, 2, 1, None)]
    df = spark.createDataFrame(rows, "stage string, seq bigint, type int, worker_id bigint, duration_ns bigint, error string")
    assert sorted(map(tuple, activity.worker_stats(df).collect())) == [("s", 1, 2, 1, 11, 7, 4), ("s", 2, 1, 0, 10, 10, 10)]
    assert tuple(activity.global_stats(df).first()) == ("s", 3, 1, 21, 10, 4, 7)
