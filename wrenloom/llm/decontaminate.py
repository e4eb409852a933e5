"""Benchmark decontamination by template canonicalisation.

A text becomes a row of tokens: runs of letters or of digits (a point or comma between digits belongs to the number); marks are left
out. Numbers, units that follow a number, and names (capitalised words, not first in a sentence or line; several in a row are
one) become typed placeholders, other tokens small letters. Windows of `width` tokens are hashed and hash-joined with the
windows of the benchmark's items. Windows of which more than half are placeholders say too little and are left out.

Matches of a document and an item are taken by diagonal (the offset between their positions). On a diagonal, what stands for a value of
the item must be the same everywhere ("Tom has 3 .. Tom eats" may become "Ann has 5 .. Ann eats", not "Ann has 5 .. Bob eats"); a
diagonal that breaks this doesn't count. A document is contaminated by an item if consistent windows cover at least `cover`
of the item's tokens: verbatim if all slots are as in the item, otherwise re-parameterised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenloom.llm.common import cut, sized
from wrenloom.llm.textcodes import LOWER, grams, mix, pieces, powers, string_buffers

WIDTH, COVER = 6, 0.5
#: Up to so many benchmark windows, their hashes are sent to the mappers, which then emit matching windows alone; beyond, they emit all windows.
FILTER_WINDOWS = 1_000_000
UNITS = "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit kmh mph hz khz mhz w kw mw v volt volts kb mb gb tb".split()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
NUM, UNIT, NAME = np.uint64(0x1F0D3A5B), np.uint64(0x2E4C6B79), np.uint64(0x3D8F1C57)
_POW = powers(0xA0761D6478BD642F, 64)
_WINDOWS = "key string, pos int, hash bigint, slots array<string>"


class Tokens:
    """Canonical tokens of several rows: code, kind (0 literal, 1 number, 2 unit, 3 name), byte span, row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data = data
        digit, letter = _DIGIT[data], _LETTER[data]
        mark = (data == 46) | (data == 44)
        point = np.zeros(n, bool)
        point[1:-1] = mark[1:-1] & digit[:-2] & digit[2:]
        digit |= point
        solid = digit | letter
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | (digit[1:] != digit[:-1])
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begin[edges] |= solid[edges]
        self.start = np.flatnonzero(begin)
        at = np.flatnonzero(solid)
        firsts = np.searchsorted(at, self.start)
        lengths = np.diff(np.append(firsts, len(at)))
        self.end = self.start + lengths
        rank = np.cumsum(begin)[at] - 1
        within = at - self.start[rank] if len(at) else at
        longest = int(lengths.max()) if len(lengths) else 0
        table = _POW if longest <= len(_POW) else powers(0xA0761D6478BD642F, longest)
        small = LOWER[data]
        second = small[1:]
        second[(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
        code = mix(np.add.reduceat((small[at].astype(np.uint64) + np.uint64(1)) * table[within], firsts)) if len(firsts) else np.zeros(0, np.uint64)
        row = np.searchsorted(offsets, self.start, "right") - 1
        m = len(code)
        kind = np.where(digit[self.start], 1, 0).astype(np.int8) if m else np.zeros(0, np.int8)
        if m:
            joined = np.concatenate([[False], row[1:] == row[:-1]])
            kind[1:][(kind[:-1] == 1) & joined[1:] & (kind[1:] == 0) & np.isin(code[1:], _UNIT_CODES)] = 2
            stops = np.concatenate([[0], np.cumsum(_STOP[data])])
            marks = np.concatenate([[0], np.cumsum(~solid & ~_BLANKS[data])])
            after_stop = np.ones(m, bool)
            after_stop[1:] = (stops[self.start[1:]] != stops[self.end[:-1]]) | ~joined[1:]
            first, follow = data[self.start], data[np.minimum(self.start + 1, n - 1)]
            capital = (first >= 65) & (first <= 90) & (((follow >= 97) & (follow <= 122)) | (follow >= 128)) & (lengths > 1)
            capital |= (first == 0xC3) & (follow >= 0x80) & (follow <= 0x9E) & (lengths > 2) & ~_capital_at(data, self.start + 2)
            kind[(kind == 0) & capital & ~after_stop] = 3
            more = np.zeros(m, bool)  # a name's second word, third ...
            more[1:] = (kind[1:] == 3) & (kind[:-1] == 3) & joined[1:] & (marks[self.start[1:]] == marks[self.end[:-1]])
            last = np.flatnonzero(~np.append(more[1:], False))
            self.end = self.end[last]
            keep = ~more
            self.start, row, kind, code = self.start[keep], row[keep], kind[keep], code[keep]
            code = np.where(kind == 1, NUM, np.where(kind == 2, UNIT, np.where(kind == 3, NAME, code)))
        self.code, self.kind, self.row = code, kind, row

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of each window that lies in one row and is at least half literal."""
        if len(self.code) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        literal = np.concatenate([[0], np.cumsum(self.kind == 0)])
        ok = (self.row[: len(self.code) - width + 1] == self.row[width - 1 :]) & (2 * (literal[width:] - literal[:-width]) >= width)
        at = np.flatnonzero(ok)
        return at, grams(self.code, width)[at]


def _capital_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    b = data[np.minimum(at, len(data) - 1)]
    return (b >= 65) & (b <= 90)


def _code_of(word: str) -> int:
    b = LOWER[np.frombuffer(word.encode(), np.uint8)].astype(np.uint64) + np.uint64(1)
    return int(mix(np.array([(b * _POW[: len(b)]).sum()], np.uint64))[0])


_UNIT_CODES = np.sort(np.array([_code_of(u) for u in UNITS], np.uint64))


def _keyed(df: DataFrame, name: str) -> DataFrame:
    """key: the id, or for a row without one a digest of its text; rows without text are left out."""
    i, t = F.col(name).cast("string"), F.col("text").cast("string")
    return df.select(F.coalesce(F.concat(F.lit("i"), i), F.concat(F.lit("t"), F.md5(t))).alias("key"), t.alias("text")).where("text is not null")


def windows(keyed: DataFrame, width: int = WIDTH, only: np.ndarray | None = None) -> DataFrame:
    """The windows of each row, or those whose hash is in `only` (sorted): key, position, hash, and what the placeholders stand for."""
    shared = None if only is None else keyed.sparkSession.sparkContext.broadcast(only)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        sieve = None
        if wanted is not None:  # one look-up in a bitmap drops nearly all windows
            sieve = np.zeros(1 << 22, bool)
            sieve[(wanted >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            for piece in pieces(batch, "text"):
                t = Tokens(*string_buffers(piece.column("text")))
                at, code = t.windows(width)
                if sieve is not None:
                    maybe = np.flatnonzero(sieve[(code >> np.uint64(42)).astype(np.int64)])
                    maybe = maybe[np.isin(code[maybe], wanted)]
                    at, code = at[maybe], code[maybe]
                first = np.searchsorted(t.row, np.arange(piece.num_rows))
                rows = t.row[at] if len(at) else np.zeros(0, np.int64)
                slots = [[t.text(k) for k in range(a, a + width) if t.kind[k]] if t.kind[a : a + width].any() else [] for a in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key").take(pa.array(rows)), pa.array(at - first[rows], pa.int32()), pa.array(code.astype(np.int64)), pa.array(slots, pa.list_(pa.string()))],
                    names=["key", "pos", "hash", "slots"],
                )

    return keyed.mapInArrow(cut_up, _WINDOWS)


def _lengths(keyed: DataFrame) -> DataFrame:
    """Tokens of each row: (key, tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                t = Tokens(*string_buffers(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(np.bincount(t.row, minlength=piece.num_rows), pa.int32())], names=["key", "tokens"])

    return keyed.mapInArrow(count, "key string, tokens int")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """(key, item_key, matched, tokens, coverage, kind) of every contaminated document and the item that it repeats; keys as _keyed() has them."""
    items = _keyed(benchmark, "item_id").groupBy("text").agg(F.min("key").alias("key"))  # repeated items count once
    theirs = cut(windows(items.select("key", "text"), width))
    few = theirs.count()
    only = None
    if few <= FILTER_WINDOWS:
        only = np.unique(np.array([r["hash"] for r in theirs.select("hash").distinct().collect()], np.int64).astype(np.uint64))
    ours = windows(_keyed(docs, "doc_id"), width, only).distinct()
    right = theirs.select(F.col("key").alias("item_key"), F.col("pos").alias("at"), "hash", F.col("slots").alias("was"))
    hits = ours.join(sized(right, few), "hash").select("key", "item_key", (F.col("pos") - F.col("at")).alias("shift"), "at", F.arrays_zip("was", F.col("slots").alias("now")).alias("slots"))
    diagonal = hits.groupBy("key", "item_key", "shift").agg(F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"), F.collect_list("at").alias("ats"))
    was = F.array_distinct(F.transform("slots", lambda s: s["was"]))
    sound = diagonal.where(F.size(was) == F.size("slots")).withColumn("changed", F.exists("slots", lambda s: s["was"] != s["now"]))
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (width - 1)))))
    whole = sound.withColumn("covered", covered).groupBy("key", "item_key").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.max("changed").alias("changed"))
    lengths = _lengths(items.select("key", "text")).select(F.col("key").alias("item_key"), "tokens")
    share = F.size("covered") / F.col("tokens")
    return whole.join(sized(lengths, few), "item_key").where(share >= cover).select("key", "item_key", F.size("covered").alias("matched"), "tokens", F.round(share, 6).alias("coverage"), F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, matched, tokens, coverage, kind): each contaminated document with each item that it repeats.

    Null or empty texts, on either side, match nothing; nor do items of fewer than `width` tokens. A row with a null id keeps it null and is known
    by its text. Repeated rows, and rows that share an id, give one row an item; items of equal text count as that with the first
    key. At exactly `cover` a document is contaminated. Other columns are ignored. An empty table on either side: empty result.
    """
    number = lambda c: F.when(F.col(c).startswith("i"), F.expr(f"substr({c}, 2)").cast("bigint"))
    return matches(docs, benchmark, width, cover).select(number("key").alias("doc_id"), number("item_key").alias("item_id"), "matched", "tokens", "coverage", "kind")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """docs without the contaminated rows, all columns kept; rows with a null text stay."""
    found = cut(matches(docs, benchmark, width, cover).select(F.col("key").alias("gone_key")).distinct())
    key = F.coalesce(F.concat(F.lit("i"), docs["doc_id"].cast("string")), F.concat(F.lit("t"), F.md5(docs["text"].cast("string"))))
    return docs.join(sized(found, found.count()), key == found["gone_key"], "left_anti")
