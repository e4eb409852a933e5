"""Scalar functions, settings and schedules."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wrenloom import config
from wrenloom.functions import delays, hls, urls
from wrenloom.operators.jobs import next_fire


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, base, expected", [
    ("a.ts", "https://h.example/dir/", "https://h.example/dir/a.ts"), ("/a.ts", "https://h.example/dir/", "https://h.example/a.ts"), ("https://o.example/a.ts", "https://h.example/", "https://o.example/a.ts"),
    ("a.ts", "", "a.ts"), ("", "https://h.example/dir/", "https://h.example/dir/"), ("//x/y", "http://h/p?q=1", "http://h//x/y"), ("../a", "http://h/d/", "http://h/d/../a"),
])
def test_resolve(spark, raw, base, expected):
    assert one(spark, urls.resolve(F.lit(raw), F.lit(base))) == expected


@pytest.mark.parametrize("url, base, video", [
    ("https://h/video.m3u8", "https://h/", "video.ts"), ("https://h/p/q/list.m3u8?t=1", "https://h/p/q/", "list.ts"), ("https://h/p/video", "https://h/p/", "video.ts"), ("https://h/", "https://h/", "now.ts"), ("https://h", "https://h/", "now.ts"), ("https://h/.m3u8", "https://h/", "now.ts"),
])
def test_names(spark, url, base, video):
    assert one(spark, urls.base_of(F.lit(url))) == base
    assert one(spark, urls.video_file_name(F.lit(url), F.lit("now"))) == video


@pytest.mark.parametrize("url, header, expected", [
    ("http://h/file.zip", "", "file.zip"), ("http://h/p/movie.mp4?token=1", None, "movie.mp4"), ("http://h/", "", "none"), ("http://h/x", "attachment; filename=\"a.pdf\"; filename*=UTF-8''b%20c.pdf", "b c.pdf"),
    ("http://h/x", 'attachment; filename="dir/a.pdf"', "a.pdf"), ("http://h/x", "inline; filename=plain.txt", "plain.txt"), ("http://h/a%2Bb", "", "a+b"), ("http://h/x", "attachment", "x"),
])
def test_file_name(spark, url, header, expected):
    assert one(spark, urls.file_name(F.lit(url), F.lit(header).cast("string"), F.lit("none"))) == expected


def test_paths(spark):
    key = F.lit("k")
    assert one(spark, urls.state_path(F.lit("s"), F.lit("d"), key)) == "s/d/8ce4b16b22b58894aa86c421e8759df3.json"
    assert one(spark, urls.state_path(F.lit("s"), F.lit(""), key)) == "s/8ce4b16b22b58894aa86c421e8759df3.json"
    assert one(spark, urls.chunk_start(urls.chunk_file(F.lit(1234)))) == 1234
    assert one(spark, urls.chunk_start(F.lit("other.tmp"))) is None
    assert one(spark, urls.with_extension(F.lit("a.b/c.ts"), ".mp4")) == "a.b/c.mp4"
    assert one(spark, urls.with_extension(F.lit("a.b/c"), ".mp4")) == "a.b/c.mp4"
    assert one(spark, urls.unique_key(F.lit("s"), F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("line, expected", [("#X:BANDWIDTH=12", 12), ("#X:A=1,BANDWIDTH=12,B=2", 12), ("#X:AVERAGE-BANDWIDTH=9,BANDWIDTH=7", 7), ("#X:BANDWIDTH=12 ", 0), ("#X:BANDWIDTH=x", 0), ("#X", 0), ("#X:BANDWIDTH=-5", -5)])
def test_bandwidth(spark, line, expected):
    assert one(spark, hls.bandwidth(F.lit(line))) == expected


def test_ivs(spark):
    assert one(spark, hls.iv_bytes(F.lit("0x123"))) == bytes([1, 0x23])
    assert one(spark, hls.iv_bytes(F.lit("0X12"))) is None
    assert one(spark, hls.implicit_iv(F.lit(258))) == bytes(14) + bytes([1, 2])
    assert one(spark, hls.byte_range(F.lit("5@7"))) == (5, 7)
    assert one(spark, hls.byte_range(F.lit("5"))) == (5, None)
    assert one(spark, hls.byte_range(F.lit("x"))) is None


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 1000])
def test_decrypt_round_trip(spark, size):
    key, iv, text = bytes(range(16)), bytes(range(16, 32)), bytes(i % 251 for i in range(size))
    sealed = F.aes_encrypt(F.lit(text), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv))
    assert one(spark, hls.decrypt(F.substring(sealed, F.lit(17), F.octet_length(sealed) - 16), F.lit(key), F.lit(iv))) == text


def test_decrypt_says_no(spark):
    key, iv = F.lit(bytes(16)), F.lit(bytes(16))
    for data in (b"", b"short", bytes(16), bytes(17)):
        assert one(spark, hls.decrypt(F.lit(data), key, iv)) is None
    assert one(spark, hls.decrypt(F.lit(bytes(16)), F.lit(b"bad"), iv)) is None


def test_delays(spark):
    s = 10**9
    assert [one(spark, delays.task_backoff(F.lit(30 * s), F.lit(a))) // s for a in range(4)] == [30, 60, 120, 240]
    assert [one(spark, delays.request_backoff(F.lit(0), F.lit(a))) // s for a in range(6)] == [0, 2, 4, 8, 10, 10]
    assert [one(spark, delays.part_backoff(F.lit(a))) // s for a in range(5)] == [0, 2, 4, 8, 10]
    assert one(spark, delays.shown_seconds(F.lit(1_234_567_890))) == "1.23s"


def test_headers(spark):
    got = one(spark, delays.request_headers(F.lit("ua"), F.create_map(F.lit("User-Agent"), F.lit("mine"), F.lit("Referer"), F.lit("old")), F.lit("new"), F.array(F.lit("a=1"), F.lit("b=2"))))
    assert got == {"User-Agent": "mine", "Referer": "new", "Cookie": "a=1; b=2"}
    assert one(spark, delays.merged_cookies(F.array(F.lit("a")), F.lit(None).cast("array<string>"))) == ["a"]


@pytest.mark.parametrize("text, ns", [("5m", 300 * 10**9), ("1h30m", 5400 * 10**9), ("500ms", 5 * 10**8), ("1.5s", 15 * 10**8), ("0", 0), (None, 0), ("-2s", -2 * 10**9)])
def test_duration(text, ns):
    assert config.duration_ns(text) == ns


@pytest.mark.parametrize("text", ["5", "m", "5 m", "5x", ""])
def test_no_duration(text):
    with pytest.raises(ValueError):
        config.duration_ns(text)


def test_settings(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("crawler: {stages: {a: {worker_count: 2, queue_size: 9, delay: 90s, retry: {max_attempts: 0}}}}\nscheduler: {jobs: [{name: n, type: repeat, schedule: '0 8 * * *'}]}\n")
    s = config.load(path)
    assert config.stages(s) == [config.Stage("a", 2, 9, 90 * 10**9, 3, 10**9)]
    assert config.job_table(spark, s).first()["type"] == "repeat"
    with pytest.raises(ValueError):
        config.Stage("a", 0, 1)


@pytest.mark.parametrize("schedule, after, expected", [
    ("0 8 * * *", "2024-01-01 07:59:59", "2024-01-01 08:00:00"), ("0 8 * * *", "2024-01-01 08:00:00", "2024-01-02 08:00:00"), ("0 */6 * * *", "2024-01-01 00:30:00", "2024-01-01 06:00:00"), ("*/10 * * * * *", "2024-01-01 00:00:01", "2024-01-01 00:00:10"),
    ("0 0 0 29 2 *", "2024-03-01 00:00:00", "2028-02-29 00:00:00"), ("0 0 * * mon", "2024-01-02 00:00:00", "2024-01-08 00:00:00"), ("0 0 13 * fri", "2024-01-01 00:00:00", "2024-01-05 00:00:00"), ("@monthly", "2024-01-31 12:00:00", "2024-02-01 00:00:00"), ("0 0 * * 7", "2024-01-01 00:00:00", "2024-01-07 00:00:00"),
])
def test_next_fire(schedule, after, expected):
    assert next_fire(schedule, datetime.fromisoformat(after)) == datetime.fromisoformat(expected)


def test_no_next_fire():
    assert next_fire("0 0 30 2 *", datetime(2024, 1, 1)) is None
    for bad in ("* *", "61 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            next_fire(bad, datetime(2024, 1, 1))
