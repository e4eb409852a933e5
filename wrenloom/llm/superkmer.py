"""Exact substring deduplication by super-k-mers.

A window is `width` words in a row. Its minimiser is the least code among the runs of `seed` words in it. Consecutive windows with the same
minimiser travel as one packed string, their words joined by single spaces, to the minimiser's bucket; equal windows have equal
minimisers, so they meet there. A bucket hashes its windows, sorts the hashes, and compares the texts of windows with equal hashes, so that
counts are exact. A string of n windows costs n + width - 1 words, some three times the text in all; no window is left out.

Buckets are as many as the bytes of the text ask for, so that one has some BUCKET bytes however large the table is. A minimiser that many texts
have in common may still fill one: the bytes of all buckets are counted beforehand, and the windows of those over HOT go by their own
two 64-bit hashes instead, in JVM aggregations with partial results before the shuffle, and back to their places in a join in which windows
of many places are broadcast. For these alone, equal means equal in 128 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenloom.llm.common import cut, fragments, heavy_join, trim
from wrenloom.llm.packing_codec import joined, loosened, pack, squeezed
from wrenloom.llm.textcodes import Words, grams, mix, pieces, powers, string_buffers

WIDTH, SEED = 50, 8
#: Bytes of strings that a mapper gathers before it sends them out, and that a bucket hashes at a time.
BLOCK, CHUNK = 16_000_000, 1_500_000
#: Bytes of strings in a usual bucket; the most in any bucket, beyond which its windows are counted one by one; bytes of strings a byte of text, about.
BUCKET, HOT, GROWTH = 8_000_000, 48_000_000, 4
#: Windows of more places than this are few, and go to their places by broadcast.
PLACES = 100_000
_BASE = 0xC2B2AE3D27D4EB4F | 1
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("copies", pa.int64()), ("first", pa.bool_())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, by doubling."""
    out, span, size = x, 1, len(x) - width + 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:size], out[width - span : width - span + size])


def single_spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and where each starts (with the end as last element)."""
    size = words.end - words.start
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(start[-1], 32, np.uint8)
    shift = np.repeat(start[:-1] - words.start, size)
    at = np.repeat(words.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    out[at + shift] = words.data[at]
    return out, start


def strings(words: Words, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each super-k-mer; windows are numbered by their first word."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words.code) - width + 1
    if n <= 0:
        return none
    least = sliding_min(grams(words.code, seed), width - seed + 1)
    valid = words.row[:n] == words.row[width - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    fresh = np.concatenate([[True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (words.row[at[1:]] != words.row[at[:-1]])])
    first = np.flatnonzero(fresh)
    return at[first], np.diff(np.append(first, len(at))), least[at[first]]


def _rolling(code: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each `width` codes in a row, from prefix sums."""
    up, down = _steps(len(code))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up)])
    return (total[width:] - total[:-width]) * down[: len(code) - width + 1]


_TABLES: list[np.ndarray] = []


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        m = max(n, 1 << 18)
        _TABLES[:] = [_powers(_BASE, m), _powers(pow(_BASE, -1, 1 << 64), m)]
    return _TABLES[0][:n], _TABLES[1][:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = powers(base, 1024)
    while len(out) < n:  # doubling: powers(2m) = powers(m), powers(m) * base**m
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def repeated_windows(cells: list[bytes], width: int) -> pa.Table:
    """Of one bucket's strings: maximal stretches, within a string, of windows that occur at two places or more and are alike first ones or later ones.

    Empties the list of cells, as a bucket's bytes shouldn't be held twice.
    """
    ids, pos, many, sizes, text = joined(cells, "i8", "u4", "u4", "u4", "u1")
    cells.clear()
    spot = np.uint32 if len(text) < 1 << 32 else np.int64
    ends = np.cumsum(sizes.astype(np.int64))
    begins = ends - sizes
    hashes, owners, froms, tos = [], [], [], []
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + CHUNK, "right")))
        low = begins[at]
        w = Words(text[low : ends[to - 1]], np.append(begins[at:to], ends[to - 1]) - low)
        if len(w.code) >= width:
            h = _rolling(w.code, width)
            inside = np.flatnonzero(w.row[: len(h)] == w.row[width - 1 :])
            hashes.append(h[inside])
            owners.append((at + w.row[inside]).astype(np.int32))
            froms.append((w.start[inside] + low).astype(spot))
            tos.append((w.end[inside + width - 1] + low).astype(spot))
        at = to
    if not hashes:
        return _SCHEMA.empty_table()
    h, owner, a, b = np.concatenate(hashes), np.concatenate(owners), np.concatenate(froms), np.concatenate(tos)
    del hashes, owners, froms, tos
    # within a string, windows are in order: a window's place is the string's place plus its rank in the string
    start = np.searchsorted(owner, np.arange(len(ids), dtype=np.int32))
    order = np.argsort(h, kind="stable").astype(spot)
    ranked = h[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    often = same.copy()
    often[:-1] |= same[1:]
    pick = order[often]
    del order, ranked, same, often
    h, owner, a, b = h[pick], owner[pick], a[pick], b[pick]
    place = pos[owner].astype(np.int64) + pick - start[owner]
    doc = ids[owner]
    order = np.lexsort((place, doc, h))
    h, owner, a, b, place, doc = h[order], owner[order], a[order], b[order], place[order], doc[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]) if len(h) else np.zeros(0, bool)
    h, owner, a, b, place, doc = h[fresh], owner[fresh], a[fresh], b[fresh], place[fresh], doc[fresh]  # repeated rows aren't repeats
    raw, i, j = memoryview(text), a.tolist(), b.tolist()
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    unlike = [k for k in np.flatnonzero(~new).tolist() if raw[i[k] : j[k]] != raw[i[k - 1] : j[k - 1]]]
    if unlike:  # two texts with one hash: group these by their texts
        extra: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(np.isin(group, group[unlike])).tolist():
            group[k] = extra.setdefault((int(group[k]), bytes(raw[i[k] : j[k]])), len(h) + len(extra))
    _, inverse, copies = np.unique(group, return_inverse=True, return_counts=True)
    copies = copies[inverse] if len(h) else np.zeros(0, np.int64)
    order = np.lexsort((place, doc, group))
    first = np.zeros(len(h), bool)
    first[order] = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(h) else first
    keep = copies > 1
    owner, place, doc, copies, first = owner[keep], place[keep], doc[keep], copies[keep], first[keep]
    order = np.lexsort((place, doc))
    place, doc, copies, first = place[order], doc[order], copies[order], first[order]
    if not len(doc):
        return _SCHEMA.empty_table()
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(place) != 1) | (first[1:] != first[:-1])]))
    size = np.diff(np.append(head, len(doc)))
    return pa.table([pa.array(doc[head]), pa.array(place[head]), pa.array(size.astype(np.int64)), pa.array(np.maximum.reduceat(copies, head).astype(np.int64)), pa.array(first[head])], schema=_SCHEMA)


def _hot(plain: DataFrame, width: int, seed: int, parts: int, hot: int) -> np.ndarray:
    """The buckets, in order, whose strings have more than `hot` bytes. They are at most all strings' bytes divided by `hot`."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = Words(*string_buffers(piece.column("text")))
                at, n, least = strings(w, width, seed)
                part, inverse = np.unique((least % np.uint64(parts)).astype(np.int64), return_inverse=True)
                size = np.bincount(inverse, weights=(w.end[at + n + width - 2] - w.start[at]).astype(float), minlength=len(part)) if len(at) else part
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(size.astype(np.int64), pa.int64())], names=["part", "bytes"])

    loads = plain.mapInArrow(weigh, "part bigint, bytes bigint").groupBy("part").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > hot)
    return np.array(sorted(r.part for r in loads.select("part").collect()), np.int64)


def _single(plain: DataFrame, width: int, seed: int, parts: int, hot: np.ndarray, places: int) -> DataFrame:
    """Repeated windows of the buckets `hot`: (doc_id, at, n = 1, copies, first)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = Words(*string_buffers(piece.column("text")))
                first, n, least = strings(w, width, seed)
                mine = np.isin((least % np.uint64(parts)).astype(np.int64), hot)
                first, n = first[mine], n[mine]
                if len(first):
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    one, two = _rolling(w.code, width)[at], _rolling(mix(w.code ^ np.uint64(_BASE)), width)[at]
                    row = w.row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), piece.column("doc_id").take(pa.array(row)), pa.array(at - w.first[row])], names=["h", "h2", "doc_id", "at"])

    spots = cut(plain.mapInArrow(windows, "h bigint, h2 bigint, doc_id bigint, at bigint").distinct())
    counted = cut(spots.groupBy("h", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "at")).alias("head")).where("copies > 1"))
    marked = heavy_join(spots, counted, ["h", "h2"], "copies", places)
    return marked.select("doc_id", "at", F.lit(1).cast("bigint").alias("n"), "copies", (F.struct("doc_id", "at") == F.col("head")).alias("first"))


def repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, bucket: int = BUCKET, hot: int = HOT, places: int = PLACES) -> DataFrame:
    """(doc_id, start_word, end_word, copies, is_first): maximal runs of windows that occur at two places or more.

    The words [start_word, end_word) of the document are covered by such windows. is_first tells that each of the run's windows is at its first
    place, the least by (doc_id, word); the other runs are what deduplication removes. copies: the places of the run's commonest window.

    Rows with a null doc_id or text, and texts of fewer words than `width`, have no windows. Rows that share a doc_id are one document: a window
    at the same place in both is at one place. Words are compared byte for byte, blanks between them not at all. Other columns are
    ignored. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    volume = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(fragments(docs.sparkSession), -(-GROWTH * volume // bucket))
    crowded = _hot(plain, width, seed, parts, hot) if width * volume > hot else np.zeros(0, np.int64)  # a word is in `width` strings at most

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            to = sorted(held)
            cells = []
            for p in to:
                x = held.pop(p)
                cells.append(squeezed(pack(*[np.concatenate([y[c] for y in x]) for c in range(4)], np.frombuffer(b"".join([y[4] for y in x]), np.uint8))))
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(cells, pa.binary())], names=["part", "cell"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                w = Words(*string_buffers(piece.column("text")))
                at, n, least = strings(w, width, seed)
                part = (least % np.uint64(parts)).astype(np.int64)
                if len(crowded):
                    usual = ~np.isin(part, crowded)
                    at, n, part = at[usual], n[usual], part[usual]
                if not len(at):
                    continue
                spaced, start = single_spaced(w)
                raw = spaced.tobytes()
                order = np.argsort(part, kind="stable")
                at, n, part = at[order], n[order], part[order]
                a, b = start[at], start[at + n + width - 1] - 1
                ids = piece.column("doc_id").to_numpy()[w.row[at]]
                pos = (at - w.first[w.row[at]]).astype(np.uint32)
                sizes = (b - a).astype(np.uint32)
                there, heads = np.unique(part, return_index=True)
                i, j = a.tolist(), b.tolist()
                for p, x, y in zip(there.tolist(), heads.tolist(), [*heads[1:].tolist(), len(part)]):
                    held[p].append((ids[x:y], pos[x:y], n[x:y].astype(np.uint32), sizes[x:y], b"".join([raw[s:e] for s, e in zip(i[x:y], j[x:y])])))
                size += int(sizes.sum())
                if size > BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        trim()

    def count(cells: pa.Table) -> pa.Table:
        trim()  # of the bucket before
        return repeated_windows([loosened(c) for c in cells.column("cell").to_pylist()], width)

    found = plain.mapInArrow(cut_up, "part bigint, cell binary").groupBy("part").applyInArrow(count, "doc_id bigint, at bigint, n bigint, copies bigint, first boolean")
    if len(crowded):
        found = found.unionByName(_single(plain, width, seed, parts, crowded, places))
    islands = found.withColumn("new", F.expr("coalesce(lag(at + n) over (partition by doc_id, first order by at) <> at, true)")).withColumn("island", F.expr("sum(int(new)) over (partition by doc_id, first order by at)"))
    runs = islands.groupBy("doc_id", "first", "island").agg(F.min("at").alias("start_word"), (F.max(F.col("at") + F.col("n")) + width - 1).alias("end_word"), F.max("copies").alias("copies"))
    return runs.select("doc_id", "start_word", "end_word", "copies", F.col("first").alias("is_first"))
