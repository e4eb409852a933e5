"""Transfers in parts: plans, resumption, reassembly, pace and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenloom.functions import urls
from wrenloom.functions.delays import SECOND, chunk_end

CHUNK = 5 << 20


def plan(assets: DataFrame) -> DataFrame:
    """(asset_id, idx, start, end) of the chunks of assets (asset_id, total, chunk_size); end is the last byte, included. Sizes that aren't positive: no chunks.

    The chunk numbers come from a sequence, so a plan is a projection, without a shuffle.
    """
    good = assets.where("total > 0 and chunk_size > 0")
    idx = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(total - 1) div chunk_size")))
    rows = good.select("asset_id", "total", "chunk_size", idx.alias("idx"))
    start = F.col("idx") * F.col("chunk_size")
    return rows.select("asset_id", "idx", start.alias("start"), chunk_end(start, F.col("chunk_size"), F.col("total")).alias("end"))


def valid_states(states: DataFrame, assets: DataFrame) -> DataFrame:
    """The saved states (asset_id, total, chunk_size, completed) that still fit their assets; those of another size count for nothing."""
    return states.join(assets.select("asset_id", "total", "chunk_size"), ["asset_id", "total", "chunk_size"], "left_semi")


def valid_playlist_states(states: DataFrame, segs: DataFrame) -> DataFrame:
    """The saved states (playlist_id, total_segments, completed) whose number of segments is the playlist's."""
    counts = segs.groupBy("playlist_id").agg(F.count("*").cast("int").alias("total_segments"))
    return states.join(counts, ["playlist_id", "total_segments"], "left_semi")


def completed_parts(states: DataFrame, key: str = "asset_id", part: str = "start") -> DataFrame:
    return states.select(key, F.explode("completed").alias(part)).distinct()


def pending(chunks: DataFrame, states: DataFrame, key: str = "asset_id", part: str = "start") -> DataFrame:
    """The chunks that the states don't list as completed."""
    return chunks.join(completed_parts(states, key, part), [key, part], "left_anti").select(*chunks.columns)


def without_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks without those whose file (asset_id, name, size) is there in full."""
    there = files.select("asset_id", urls.chunk_start(F.col("name")).alias("start"), "size").where("start is not null")
    named = chunks.join(there.select("asset_id", "start", F.col("size").alias("_size")), ["asset_id", "start"], "left")
    return named.where(F.col("_size").isNull() | (F.col("_size") != F.col("end") - F.col("start") + 1)).select(*chunks.columns).distinct()


def cut(assets: DataFrame, content: str = "content") -> DataFrame:
    """plan() with the bytes (or characters, of a string) of each chunk."""
    good = assets.where("total > 0 and chunk_size > 0")
    idx = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(total - 1) div chunk_size")))
    rows = good.select("asset_id", "total", "chunk_size", content, idx.alias("idx"))
    start = F.col("idx") * F.col("chunk_size")
    end = chunk_end(start, F.col("chunk_size"), F.col("total"))
    data = F.substring(F.col(content), (start + 1).cast("int"), (end - start + 1).cast("int"))
    return rows.select("asset_id", "idx", start.alias("start"), end.alias("end"), data.alias("data"))


def joined(parts: DataFrame, key: str = "asset_id", order: str = "start", data: str = "data") -> DataFrame:
    """(asset_id, content): the parts of each asset one after the other in order; parts without data are skipped.

    For assets that fit in a row. Larger ones are written part by part, see wrenloom.sources.store.write_parts.
    """
    pairs = F.sort_array(F.collect_list(F.when(F.col(data).isNotNull(), F.struct(F.col(order), F.col(data).alias("d")))))
    hexed = F.array_join(F.transform(pairs, lambda x: F.hex(x["d"])), "")
    kind = dict(parts.dtypes)[data]
    content = F.unhex(hexed) if kind == "binary" else F.array_join(F.transform(pairs, lambda x: x["d"]), "")
    return parts.groupBy(key).agg(content.alias("content"))


def concat_list(parts: DataFrame, key: str = "asset_id", order: str = "idx", path: str = "path") -> DataFrame:
    """(asset_id, list): the text of a list file for a muxer, a line for each part in order; single quotes in paths are escaped."""
    line = F.concat(F.lit("file '"), F.replace(F.col("x.path"), F.lit("'"), F.lit("'\\''")), F.lit("'\n"))
    rows = parts.where(F.coalesce(F.col(path), F.lit("")) != "").select(key, F.struct(F.col(order).alias("o"), F.col(path).alias("path")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("x.o").alias("o"), line.alias("line")))), lambda y: y["line"]), "").alias("list"))


def total_size(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(asset_id, size): the sizes of the wanted files (asset_id, name) that are there; missing ones count as 0."""
    sized = wanted.join(files.select("name", "size"), "name", "left")
    return sized.groupBy("asset_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def progress(done: DataFrame) -> DataFrame:
    """done (asset_id, done_seq, bytes) with parts_done and bytes_done so far."""
    w = Window.partitionBy("asset_id").orderBy("done_seq").rowsBetween(Window.unboundedPreceding, 0)
    return done.withColumns({"parts_done": F.count("*").over(w), "bytes_done": F.sum("bytes").over(w)})


def saves(done: DataFrame, total: DataFrame, every: int) -> DataFrame:
    """The moments of progress() at which the state is saved: each `every` parts, and when all are done. total: (asset_id, parts)."""
    return progress(done).join(total.select("asset_id", "parts"), "asset_id").where((F.col("parts_done") % every == 0) | (F.col("parts_done") == F.col("parts")))


def paced(done: DataFrame, kb_per_second: int) -> DataFrame:
    """done (asset_id, done_seq, bytes) with ready_ns: when a token bucket of that rate, full at the start, lets each part through; 0 or less: at once.

    The bucket holds one second's worth; a part beyond that can never pass: its ready_ns is null, and it takes no tokens.
    """
    if kb_per_second <= 0:
        return done.withColumn("ready_ns", F.lit(0).cast("bigint"))
    rate = kb_per_second * 1024
    w = Window.partitionBy("asset_id").orderBy("done_seq").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("bytes") <= rate
    spent = F.sum(F.when(fits, F.col("bytes")).otherwise(0)).over(w)
    return done.withColumn("ready_ns", F.when(fits, F.greatest(F.lit(0), F.ceil((spent - rate) * SECOND / rate)).cast("bigint")))


def first_error(parts: DataFrame, key: str = "asset_id", order: str = "idx") -> DataFrame:
    """(asset_id, error): the error of the first part that has one; null if none has."""
    return parts.groupBy(key).agg(F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col(order))).alias("error"))


def accepted(status: Column, ranged: Column) -> Column:
    """Whether a response will do: 206 to a range, otherwise 200."""
    return F.when(ranged, status == 206).otherwise(status == 200)


def probe(responses: DataFrame) -> DataFrame:
    """(url, size, rangeable, disposition) from the heads of responses (url, status, headers, error). An error or a status of 400 and more: 0, false and empty."""
    low = F.transform_keys("headers", lambda k, _: F.lower(k))
    bad = F.col("error").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(True))
    size = F.coalesce(F.expr("try_cast(_h['content-length'] as bigint)"), F.lit(0).cast("bigint"))
    ranges = F.coalesce(F.lower(F.col("_h")["accept-ranges"]).contains("bytes"), F.lit(False))
    named = F.coalesce(F.col("_h")["content-disposition"], F.lit(""))
    h = responses.withColumn("_h", low)
    return h.select("url", F.when(bad, F.lit(0).cast("bigint")).otherwise(size).alias("size"), (~bad & ranges).alias("rangeable"), F.when(bad, "").otherwise(named).alias("disposition"))
