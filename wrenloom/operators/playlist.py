"""Playlists: lines, segments with their keys and ranges, and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenloom.functions import hls, urls

BLANKS = " \t\n\r\x0b\x0c"


def lines(playlists: DataFrame) -> DataFrame:
    """(playlist_id, base_url, line_no, line): the lines as they stand, numbered from 0."""
    return playlists.select("playlist_id", "base_url", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def _in_order():
    return Window.partitionBy("playlist_id").orderBy("line_no")


def marked_lines(playlists: DataFrame) -> DataFrame:
    """lines(), trimmed, with `eaten` for lines that a byte-range tag before them has taken, and the line after each.

    A range tag takes the next physical line, whatever it is. So in a run of range tags each second one is taken itself: a tag is taken if
    an odd number of them stand just before it.
    """
    t = lines(playlists).withColumn("line", F.trim(F.col("line"), F.lit(BLANKS)))
    w = _in_order()
    tag = F.col("line").startswith("#EXT-X-BYTERANGE:")
    t = t.withColumns({"is_range": tag, "following": F.lead("line").over(w)})
    other_before = F.coalesce(F.max(F.when(~F.col("is_range"), F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return t.withColumn("eaten", (F.col("line_no") - 1 - other_before) % 2 == 1)


def segments(playlists: DataFrame) -> DataFrame:
    """(playlist_id, idx, url, byte_range, key_url, iv): the media segments, numbered from 0, each with the key tag that holds there.

    A key tag holds for what follows; one without a URI ends encryption. A line after a byte-range tag is that segment's URL unless it starts
    with "#"; if blank, it means the base. Other tags, and blank lines, mean nothing. Playlists without media lines have no rows.
    """
    t = marked_lines(playlists).where(~F.col("eaten"))
    key_tag = F.col("line").startswith("#EXT-X-KEY:")
    base = F.col("base_url")
    uri = hls.tag_uri(F.col("line"), base)
    key = F.when(key_tag, F.struct(uri.alias("key_url"), F.when(uri.isNotNull(), hls.tag_iv(F.col("line"))).alias("iv")))
    ranged = F.col("is_range") & F.col("following").isNotNull() & ~F.col("following").startswith("#")
    media = ~F.col("line").startswith("#") & (F.col("line") != "")
    w = _in_order()
    t = t.withColumn("key", F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    url = urls.resolve(F.when(F.col("is_range"), F.col("following")).otherwise(F.col("line")), base)
    text = F.when(F.col("is_range"), F.substring("line", len("#EXT-X-BYTERANGE:") + 1, 1 << 20))
    found = t.where(ranged | media).select("playlist_id", "line_no", url.alias("url"), text.alias("byte_range"), "key.key_url", "key.iv")
    return found.select("playlist_id", (F.row_number().over(w) - 1).alias("idx"), "url", "byte_range", "key_url", "iv")


def with_ranges(segs: DataFrame) -> DataFrame:
    """segments() with length and offset of the byte range; one without offset starts where the previous range of the same URL ended."""
    part = hls.byte_range(F.col("byte_range"))
    t = segs.withColumn("_r", part)
    given = F.when(F.col("_r.offset").isNotNull(), F.col("idx"))
    w = Window.partitionBy("playlist_id", "url").orderBy("idx")
    t = t.withColumn("_group", F.last(given, ignorenulls=True).over(w))
    run = Window.partitionBy("playlist_id", "url", "_group").orderBy("idx")
    start = F.coalesce(F.first("_r.offset").over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.coalesce(F.sum("_r.length").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumns({"length": F.col("_r.length"), "offset": F.when(F.col("_r").isNotNull(), start)})
    return t.drop("_r", "_group")


def init_segments(playlists: DataFrame) -> DataFrame:
    """(playlist_id, init_url) of playlists with a map tag: that of the last one, null if it names no URI."""
    t = marked_lines(playlists).where(~F.col("eaten") & F.col("line").startswith("#EXT-X-MAP:"))
    return t.groupBy("playlist_id").agg(F.max_by(hls.tag_uri(F.col("line"), F.col("base_url")), F.col("line_no")).alias("init_url"))


def variants(playlists: DataFrame) -> DataFrame:
    """(playlist_id, line_no, bandwidth, url): a variant is a tag and the next physical line, unless that starts with "#"; that line is used up either way."""
    w = _in_order()
    t = lines(playlists).withColumns({"is_tag": F.col("line").startswith("#EXT-X-STREAM-INF"), "following": F.trim(F.lead("line").over(w), F.lit(BLANKS))})
    other = F.coalesce(F.max(F.when(~F.col("is_tag"), F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    t = t.withColumn("eaten", (F.col("line_no") - 1 - other) % 2 == 1)
    good = t.where(F.col("is_tag") & ~F.col("eaten") & F.col("following").isNotNull() & ~F.col("following").startswith("#"))
    return good.select("playlist_id", "line_no", hls.bandwidth(F.col("line")).alias("bandwidth"), urls.resolve(F.col("following"), F.col("base_url")).alias("url"))


def best_variants(playlists: DataFrame) -> DataFrame:
    """(playlist_id, url, error) of every playlist with variants: that of the highest bandwidth, the first of equals. None above 0: "no stream found"."""
    v = variants(playlists)
    best = v.groupBy("playlist_id").agg(F.max_by(F.when(F.col("bandwidth") > 0, F.col("url")), F.struct("bandwidth", -F.col("line_no"))).alias("url"))
    return best.withColumn("error", F.when(F.col("url").isNull(), "no stream found"))


def is_master(text) -> F.Column:
    return text.contains("#EXT-X-STREAM-INF")


def distinct_keys(segs: DataFrame) -> DataFrame:
    """(key_url): the keys to fetch, once each."""
    return segs.where("key_url is not null").select("key_url").distinct()


def decrypted(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """parts (playlist_id, idx, data, key_url, iv) with the data decrypted; keys: (key_url, key). error says why a part has no data.

    Without an IV of its own, a segment's number is its IV, segment by segment.
    """
    joined = parts.join(keys, "key_url", "left")
    given = F.coalesce("iv", F.lit(""))
    iv = F.when(given != "", F.lpad(hls.iv_bytes(given), 16, F.lit(b"\x00"))).otherwise(hls.implicit_iv(F.col("idx")))
    plain = F.when(F.col("key_url").isNull(), F.col("data")).otherwise(hls.decrypt(F.col("data"), F.col("key"), iv))
    error = F.when(F.col("data").isNull(), "no data").when(F.col("key_url").isNotNull() & F.col("key").isNull(), "no key").when(plain.isNull(), "can't decrypt")
    return joined.select("playlist_id", "idx", plain.alias("data"), error.alias("error"))
