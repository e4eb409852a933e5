"""Playlists line by line against a literal reader, and the cases that matter one by one."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wrenloom import schemas
from wrenloom.operators import playlist

BASE = "https://h.example/dir/"


def table(spark, texts):
    return spark.createDataFrame([(i, BASE, t) for i, t in enumerate(texts)], schemas.PLAYLISTS)


def read(text):
    """(idx, name, range, key name, iv) as one reads from top to bottom."""
    lines = [x.strip() for x in text.split("\n")]
    out, key, i = [], (None, None), 0
    attr = lambda line, start, stops: None if start not in line else line.split(start, 1)[1] if not any(c in line.split(start, 1)[1] for c in stops) else min((line.split(start, 1)[1].split(c, 1)[0] for c in stops), key=len)
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.startswith("#EXT-X-KEY:"):
            uri = attr(line, 'URI="', '"')
            key = (None, None) if uri is None else (uri, attr(line, "IV=", ", \t") or "")
        elif line.startswith("#EXT-X-BYTERANGE:"):
            if i < len(lines):
                if not lines[i].startswith("#"):
                    out.append((lines[i], line[17:], *key))
                i += 1
        elif line and not line.startswith("#"):
            out.append((line, None, *key))
    return [(n, *row) for n, row in enumerate(out)]


LINES = st.sampled_from(["a.ts", "b.ts", "", "#EXTINF:1,", "#EXT-X-BYTERANGE:5@0", "#EXT-X-BYTERANGE:7", '#EXT-X-KEY:METHOD=AES-128,URI="k1",IV=0x01', '#EXT-X-KEY:METHOD=AES-128,URI="k2"', "#EXT-X-KEY:METHOD=NONE", "  c.ts  "])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINES, max_size=14).map("\n".join), min_size=25, max_size=25))
def test_segments_are_what_one_reads(spark, texts):
    got = {}
    for r in playlist.segments(table(spark, texts)).collect():
        name = lambda u: None if u is None else u.removeprefix(BASE)
        got.setdefault(r["playlist_id"], []).append((r["idx"], name(r["url"]), r["byte_range"], name(r["key_url"]), r["iv"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == read(text), text


def test_ranges_follow_each_other(spark):
    text = "#EXT-X-BYTERANGE:10@5\na\n#EXT-X-BYTERANGE:3\na\n#EXT-X-BYTERANGE:4\nb\n#EXT-X-BYTERANGE:2@0\na\n#EXT-X-BYTERANGE:9\na"
    got = sorted((r["idx"], r["offset"], r["length"]) for r in playlist.with_ranges(playlist.segments(table(spark, [text]))).collect())
    assert got == [(0, 5, 10), (1, 15, 3), (2, 0, 4), (3, 0, 2), (4, 2, 9)]


def test_variants(spark):
    tag = "#EXT-X-STREAM-INF:BANDWIDTH="
    texts = [f"{tag}5\nlow\n{tag}9\nhigh\n{tag}9\nsame", f"{tag}0\nzero", f"{tag}5\n{tag}9\nhigh", "a.ts", f"{tag}7"]
    got = {r["playlist_id"]: (r["url"], r["error"]) for r in playlist.best_variants(table(spark, texts)).collect()}
    assert got == {0: (BASE + "high", None), 1: (None, "no stream found")}  # in the third, the second tag is used up by the first, and "high" is no variant


def test_init_and_empty(spark):
    texts = ['#EXT-X-MAP:URI="x"\n#EXT-X-MAP:URI="y"', "#EXT-X-MAP:BYTERANGE=1", ""]
    assert {r["playlist_id"]: r["init_url"] for r in playlist.init_segments(table(spark, texts)).collect()} == {0: BASE + "y", 1: None}
    assert playlist.segments(table(spark, [""])).count() == 0
    assert playlist.segments(spark.createDataFrame([], schemas.PLAYLISTS)).count() == 0
