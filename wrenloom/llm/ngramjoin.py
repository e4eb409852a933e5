"""Exact n-gram Jaccard self-join by vertical partitioning.

The documents' sets of word n-grams (ASCII capitals folded; a text of fewer words counts as one n-gram) are cut along the n-grams'
global order into fragments; each fragment counts overlaps on its own, and the counts are summed per pair. In steps:

1. n-grams that a large part of the documents has are found first, by counts within the mappers' blocks; they are known to be shared. A
   mapper sends every other n-gram to the task that has its range of codes, as packed arrays, five bytes an n-gram. There
   the documents of each n-gram are counted, and those in two or more go back to the documents.
2. A document with Jaccard t to any other shares at least t of its n-grams. Those with fewer n-grams in other documents are
   done. The rest put theirs in the global order: by level, eight to each doubling of an n-gram's documents, rarest first, and by code.
   Documents with equal sets are collapsed to the least doc_id.
3. Prefix filter: a pair at or above t shares an n-gram among the first |x| - ceil(t |x|) + 1 of both. The order is cut into fragments of
   about equal numbers of prefix n-grams, which count partial overlaps; the sums bound a pair's overlap from above, and pairs that can't reach t go.
4. For the remaining pairs the whole sets, again by fragments of the order, are intersected, and partial overlaps summed to the exact one.
5. An n-gram in the prefixes of HOT or more documents makes no pairs in 3, as their number would grow with the square of its documents. It links them to
   a crowd (those of sizes too far apart aside), and crowds that share a document are one. Two documents of different crowds, or of none, have no such
   n-gram in common, so 3 and 4 are exact for them. Within a crowd all pairs of whole sets are compared, tile by tile: overlaps of frequent
   n-grams are matrix products, those of the others are counted. Only sums and the least linked ids leave a tile.

Pairs of 3 and 4 travel as packed arrays, one row a document with all its partners, never as a row a pair. No cap is set on documents per n-gram,
partners or candidates. Codes have 40 bits and the range's number: two different n-grams of a pair of texts of 500 words have the
same code with a chance of some 1e-7 to 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenloom.llm.common import cut, fragments, heavy_join, release, sized, trim
from wrenloom.llm.packing_codec import joined, loosened, pack, squeezed, unpack
from wrenloom.llm.textcodes import Words, grams, mix, pieces, string_buffers

N, THRESHOLD = 5, 0.35
#: n-grams that a mapper gathers before it sends them out.
BLOCK = 2_000_000
#: A block names the n-grams that so many of its rows have; of those, the ones with this many rows in all, and a millionth of all n-grams, count as common.
LOCAL, COMMON = 32, 20_000
#: Vertical fragments of the last step.
FRAGMENTS = 4
#: Pairs that a fragment keeps before it sends them on.
PAIRS = 4_000_000
LEVELS = 256
#: Documents with an n-gram in their prefixes from which on it makes a crowd of them instead of pairs.
HOT = 16
#: A crowd is cut into blocks of about so many documents and n-grams at most; a task has two blocks, and compares TILE by TILE documents at a time.
CROWD_DOCS, CROWD_GRAMS, TILE = 16_384, 2_000_000, 1_024
#: Of a tile's pairs, the share that has an n-gram from which on a matrix product counts it faster, and the columns of one product.
DENSE, COLUMNS = 1 / 150, 2_048
_SHARED, _SIZES, _COMMON, _BACK = range(4)
_PARTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("cell", pa.binary())])
_PARTS_SQL = "part int, kind int, cell binary"
_SETS = "doc_id bigint, size int, sig binary, codes array<bigint>, levels binary"
_NEAR = "a bigint, size_a int, home int, others binary"
_PAIRS = pa.schema([(c, pa.int64()) for c in ("a", "size_a", "b", "size_b", "overlap")])
_PAIRS_SQL = "a bigint, size_a bigint, b bigint, size_b bigint, overlap bigint"


def needed(size, threshold: float):
    """ceil(threshold * size), safe from rounding: the least overlap with an equal or larger set."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


def code_bits(parts: int) -> int:
    return 40 + parts.bit_length() - 1


def level_of(df: np.ndarray) -> np.ndarray:
    """The level of an n-gram of df documents: a common order of all n-grams, rare ones first."""
    return np.minimum(np.floor(8 * np.log2(np.maximum(df, 1))), LEVELS - 1).astype(np.uint8)


def row_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit code) of every n-gram that lies in one row, repeats included."""
    rows, codes = [], []
    if len(words.code) >= n:
        inside = words.row[: len(words.code) - n + 1] == words.row[n - 1 :]
        codes.append(grams(words.code, n)[inside])
        rows.append(words.row[: len(words.code) - n + 1][inside])
    lengths = np.diff(words.first)
    for r in np.flatnonzero((lengths > 0) & (lengths < n)).tolist():
        c = words.code[words.first[r] : words.first[r + 1]]
        codes.append(grams(c, len(c)) ^ np.uint64(len(c)))
        rows.append(np.array([r]))
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def row_sets(piece: pa.RecordBatch, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code of `bits` bits) of each row's n-grams, every one once, sorted."""
    row, code = row_grams(Words(*string_buffers(piece.column("text")), lower=True), n)
    code = code >> np.uint64(64 - bits)
    if piece.num_rows >> (64 - bits):  # no room for the row beside the code
        at = np.lexsort((code, row))
        row, code = row[at], code[at]
    else:
        both = np.sort((row.astype(np.uint64) << np.uint64(bits)) | code)
        row, code = (both >> np.uint64(bits)).astype(np.int64), both & np.uint64((1 << bits) - 1)
    fresh = _fresh(row, code)
    return row[fresh], code[fresh]


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows of keys: whether one differs from that before it."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, and where the run of each starts and ends."""
    start = np.flatnonzero(_fresh(sorted_keys))
    return sorted_keys[start], start, np.append(start[1:], len(sorted_keys))


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _width(parts: int) -> np.uint64:
    """Codes of code_bits(parts) bits are cut into equal ranges of this many."""
    return np.uint64(-(-(1 << code_bits(parts)) // parts))


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (codes >> np.uint64(32)).astype(np.uint8)


def _halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper 32 bits: apart, the upper ones are compressed."""
    return (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (codes >> np.uint64(32)).astype(np.uint32)


def _counts(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners of a row of n-grams in which each one's stand together, and how many each has."""
    who, start, end = _runs_of(owner)
    return who, (end - start).astype(np.uint32)


def _rows(to: list, kind: list, cells: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(cells, pa.binary())], schema=_PARTS)


def common_grams(plain: DataFrame, n: int, parts: int, local: int = LOCAL, common: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(codes, levels) of n-grams that very many rows have; at most a million.

    A block of BLOCK n-grams names those that `local` of its rows have. What none of them names is in fewer than local / BLOCK of all n-grams, less
    than a task's usual share of them unless there are tens of thousands of tasks. Counts are those of the naming blocks, and only used for the order.
    """
    bits = code_bits(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, total = [], 0, 0

        def named() -> pa.RecordBatch:
            code, many = np.unique(np.concatenate(codes), return_counts=True)
            often = many >= local
            return pa.RecordBatch.from_arrays([pa.array(code[often].astype(np.int64)), pa.array(many[often].astype(np.int64))], names=["code", "rows"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                codes.append(row_sets(piece, n, bits)[1])
                held += len(codes[-1])
                if held >= BLOCK:
                    yield named()
                    codes, held, total = [], 0, total + held
        if held:
            yield named()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total + held], pa.int64())], names=["code", "rows"])
        trim()

    counted = cut(plain.mapInArrow(count, "code bigint, rows bigint").groupBy("code").agg(F.sum("rows").alias("rows")))
    total = counted.where("code = -1").first()
    least = max(common, -(-(total["rows"] if total else 0) // 1_000_000))
    found = sorted(tuple(r) for r in counted.where((F.col("code") >= 0) & (F.col("rows") >= least)).collect())
    return np.array([c for c, _ in found], np.uint64), level_of(np.array([r for _, r in found], np.int64))


def sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, local: int = LOCAL, common: int = COMMON) -> DataFrame:
    """The documents that can have a partner: size of the n-gram set, its signature if all of it occurs elsewhere too, and those n-grams that do, in the global order, with their levels."""
    parts = fragments(docs.sparkSession)
    bits, width = code_bits(parts), _width(parts)
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    known, known_level = common_grams(plain, n, parts, local, common)

    def fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, codes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            i, s, c = np.concatenate(ids), np.concatenate(sizes), np.concatenate(codes)
            owner = np.repeat(np.arange(len(i)), s)
            to, kind, cells = [], [], []
            if len(known):
                spot = np.minimum(np.searchsorted(known, c), len(known) - 1)
                hot = known[spot] == c
                home = _home(i, parts)[owner[hot]]
                at = np.argsort(home, kind="stable")
                who, what = owner[hot][at], spot[hot][at]
                for p, a, b in zip(*(x.tolist() for x in _runs_of(home[at]))):
                    w, m = _counts(who[a:b])
                    to.append(p)
                    kind.append(_COMMON)
                    cells.append(pack(i[w], m, what[a:b].astype(np.uint32)))
                c, owner = c[~hot], owner[~hot]
            part = (c // width).astype(np.int64)
            at = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            low, high = _split(c[at] - part[at].astype(np.uint64) * width)
            owner = owner[at]
            for p, a, b in zip(*(x.tolist() for x in _runs_of(part[at]))):
                w, m = _counts(owner[a:b])
                to.append(p)
                kind.append(_SHARED)
                cells.append(pack(i[w], m, low[a:b], high[a:b]))
            home = _home(i, parts)
            at = np.argsort(home, kind="stable")
            for p, a, b in zip(*(x.tolist() for x in _runs_of(home[at]))):
                to.append(p)
                kind.append(_SIZES)
                cells.append(pack(i[at[a:b]], s[at[a:b]].astype(np.uint32)))
            yield _rows(to, kind, cells)

        for batch in batches:
            for piece in pieces(batch, "text"):
                row, code = row_sets(piece, n, bits)
                size = np.bincount(row, minlength=piece.num_rows)
                some = size > 0
                ids.append(piece.column("doc_id").to_numpy(zero_copy_only=False)[some])
                sizes.append(size[some])
                codes.append(code)
                held += len(code)
                if held >= BLOCK:
                    yield from flush()
                    ids, sizes, codes, held = [], [], [], 0
        if held:
            yield from flush()
        ids, sizes, codes = [], [], []
        trim()

    def shared(key: tuple, cells: pa.Table) -> pa.Table:
        trim()  # of the group before
        part = key[0].as_py()
        kinds, data = cells.column("kind").to_pylist(), cells.column("cell").to_pylist()
        on = [(k, c) for k, c in zip(kinds, data) if k != _SHARED]
        ids, counts, low, high = joined([c for c, k in zip(data, kinds) if k == _SHARED], "i8", "u4", "u4", "u1")
        del data
        code, owner = (high.astype(np.uint64) << np.uint64(32)) + low, np.repeat(ids, counts)
        del low, high
        at = np.argsort(code, kind="stable")
        code, owner = code[at], owner[at]
        same = ~_fresh(code)
        often = same.copy()
        often[:-1] |= same[1:]
        code, owner = code[often], owner[often]
        at = np.lexsort((owner, code))
        code, owner = code[at], owner[at]
        fresh = _fresh(code, owner)
        code, owner = code[fresh], owner[fresh]  # repeated rows of a document count once
        _, start, end = _runs_of(code)
        df = np.repeat(end - start, end - start)
        code, owner, df = code[df > 1], owner[df > 1], df[df > 1]
        home = _home(owner, parts)
        at = np.lexsort((owner, home))
        code, owner, df = code[at], owner[at], df[at]
        low, high = _split(code)
        level = level_of(df)
        to, out = [], []
        for p, a, b in zip(*(x.tolist() for x in _runs_of(home[at]))):
            who, many = _counts(owner[a:b])
            to.append(p)
            out.append(pack(who, many, low[a:b], high[a:b], level[a:b]))
        return pa.Table.from_batches([_rows(to + [part] * len(on), [_BACK + part] * len(to) + [k for k, _ in on], out + [c for _, c in on])])

    def ordered(cells: pa.Table) -> pa.Table:
        trim()
        kinds, data = cells.column("kind").to_pylist(), cells.column("cell").to_pylist()
        ids, sizes = joined([c for c, k in zip(data, kinds) if k == _SIZES], "i8", "u4")
        at = np.lexsort((sizes, ids))
        last = np.append(_fresh(ids[at])[1:], True) if len(ids) else np.zeros(0, bool)
        ids, sizes = ids[at][last], sizes[at][last].astype(np.int64)
        owner, code, level = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for c, k in zip(data, kinds):
            if k == _COMMON:
                i, m, what = unpack(c, "i8", "u4", "u4")
                owner.append(np.repeat(i, m))
                code.append(known[what])
                level.append(known_level[what])
            elif k >= _BACK:
                i, m, low, high, v = unpack(c, "i8", "u4", "u4", "u1", "u1")
                owner.append(np.repeat(i, m))
                code.append((high.astype(np.uint64) << np.uint64(32)) + low + np.uint64(k - _BACK) * width)
                level.append(v)
        owner, code, level = np.concatenate(owner), np.concatenate(code), np.concatenate(level)
        where = np.searchsorted(ids, owner)
        at = np.lexsort((code, level, where))
        code, level, where = code[at], level[at], where[at]
        fresh = _fresh(where, code)  # common n-grams of repeated rows
        code, level, where = code[fresh], level[fresh], where[fresh]
        rows = np.flatnonzero(np.bincount(where, minlength=len(ids)) >= np.maximum(needed(sizes, threshold), 1))
        kept = np.isin(where, rows)
        code, level, where = code[kept], level[kept], where[kept]
        bounds = np.searchsorted(where, rows, "left"), np.searchsorted(where, rows, "right")
        sig, raw = [], level.tobytes()
        for r, a, b in zip(rows, *bounds):
            whole = code[a:b]
            sig.append(np.array([mix(whole).sum(), mix(whole ^ np.uint64(0x5555555555555555)).sum()], np.uint64).tobytes() if b - a == sizes[r] else None)
        lists = pa.ListArray.from_arrays(pa.array(np.append(bounds[0], len(code)).astype(np.int32)), pa.array(code.astype(np.int64)))
        levels = pa.array([raw[a:b] for a, b in zip(*bounds)], pa.binary())
        return pa.table({"doc_id": pa.array(ids[rows], pa.int64()), "size": pa.array(sizes[rows], pa.int32()), "sig": pa.array(sig, pa.binary()), "codes": lists, "levels": levels})

    return plain.mapInArrow(fragment, _PARTS_SQL).groupBy("part").applyInArrow(shared, _PARTS_SQL).groupBy("part").applyInArrow(ordered, _SETS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, levels, where each row's start, and the end) of a batch of sets()."""
    lists = batch.column("codes")
    starts = lists.offsets.to_numpy().astype(np.int64)
    codes = lists.values.to_numpy()[starts[0] : starts[-1]].astype(np.uint64)
    return codes, np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8), starts - starts[0]


def _prefix(batch: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, levels, counts): the first n-grams of each row, of which a near pair has one in common."""
    codes, levels, starts = _flat(batch)
    counts = np.diff(starts) - needed(batch.column("size").to_numpy().astype(np.int64), threshold) + 1
    pick = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return codes[pick], levels[pick], counts


class Order:
    """The global order, by level and code, cut into `parts` fragments of about equal load."""

    def __init__(self, load: dict[int, int], parts: int, bits: int):
        self.load = np.array([load.get(v, 0) for v in range(LEVELS)], np.float64)
        self.before = np.concatenate([[0], np.cumsum(self.load)[:-1]])
        self.scale, self.parts, self.bits = parts / max(1.0, self.load.sum()), parts, bits

    def fragment(self, level: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = self.before[level] + self.load[level] * (code.astype(np.float64) / float(1 << self.bits))
        return np.minimum(at * self.scale, self.parts - 1).astype(np.int64)


def order_of(reps: DataFrame, threshold: float, parts: int, bits: int, whole: bool = False) -> Order:
    """The order cut by the n-grams of the prefixes, or by all: the load is a number for each of LEVELS levels."""

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                many = np.bincount(_flat(batch)[1] if whole else _prefix(batch, threshold)[1], minlength=LEVELS)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(many).astype(np.int32)), pa.array(many[many > 0])], names=["level", "n"])

    rows = reps.select("size", "codes", "levels").mapInArrow(loads, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    return Order({r["level"]: r["n"] for r in rows.collect()}, parts, bits)


def candidates(reps: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of documents whose prefixes overlap enough for the threshold to be in reach, without the n-grams of `hot` and more documents: a row
    for each a, with the packed b and their sizes. And (doc_a, doc_b): links of the documents of those n-grams, from which crowds follow.

    Pairs of one crowd may be among the candidates or not; all others that reach the threshold are.
    """
    parts = fragments(reps.sparkSession)
    order = order_of(reps, threshold, parts, code_bits(parts))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, sizes = batch.column("doc_id").to_numpy(), batch.column("size").to_numpy().astype(np.uint32)
                codes, levels, counts = _prefix(batch, threshold)
                owner = np.repeat(np.arange(len(ids)), counts)
                part = order.fragment(levels, codes)
                at = np.argsort(part, kind="stable")
                codes, owner = codes[at], owner[at]
                to, cells = [], []
                for p, a, b in zip(*(x.tolist() for x in _runs_of(part[at]))):
                    who, many = _counts(owner[a:b])
                    to.append(p)
                    cells.append(squeezed(pack(ids[who], sizes[who], many, *_halves(codes[a:b]))))
                yield _rows(to, [0] * len(to), cells)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        ids, sizes, counts, low, high = joined([loosened(c) for b in batches for c in b.column("cell").to_pylist()], "i8", "u4", "u4", "u4", "u4")
        code = (high.astype(np.uint64) << np.uint64(32)) | low
        docs, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        size = sizes[first].astype(np.int64)
        owner = np.repeat(inverse, counts) if len(ids) else np.zeros(0, np.int64)
        at = np.lexsort((owner, size[owner], code))
        code, owner = code[at], owner[at]
        _, begin, end = _runs_of(code)
        crowded = np.repeat(end - begin >= hot, end - begin)
        if crowded.any():
            code, owner, light = code[crowded], owner[crowded], (code[~crowded], owner[~crowded])
            begin = _fresh(code)
            begin[1:] |= size[owner[:-1]] < needed(size[owner[1:]], threshold)  # none before is near in size to one from here on
            begin = np.flatnonzero(begin)
            node, least = _forest(np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(owner)))), owner)
            yield _rows([0], [1], [squeezed(pack(docs[least[node != least]], docs[node[node != least]]))])
            code, owner = light
        end = np.searchsorted(code, code, "right")
        index, step, held, many, total = np.arange(len(code)), 1, [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def fold(total: tuple, held: list) -> tuple:
            keys, inverse = np.unique(np.concatenate([total[0], *held]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([total[1], *[np.ones(len(h)) for h in held]]), minlength=len(keys)).astype(np.int64)

        def send(total: tuple) -> Iterator[pa.RecordBatch]:
            keys, n = total
            a, b = keys // max(1, len(docs)), keys % max(1, len(docs))
            home = _home(docs[a], parts)
            at = np.argsort(home, kind="stable")
            a, b, n = a[at], b[at], n[at].astype(np.uint32)
            for p, x, y in zip(*(x.tolist() for x in _runs_of(home[at]))):
                who, many = _counts(a[x:y])
                yield _rows([p], [0], [squeezed(pack(docs[who], size[who].astype(np.uint32), many, docs[b[x:y]], size[b[x:y]].astype(np.uint32), n[x:y]))])

        while True:
            index = index[index + step < end[index]]
            if not len(index):
                break
            x, y = owner[index], owner[index + step]
            near = size[x] >= needed(size[y], threshold)
            index = index[near]  # those further on are larger still
            x, y = x[near], y[near]
            held.append(np.minimum(x, y) * len(docs) + np.maximum(x, y))
            many += len(x)
            if many > PAIRS:
                total, held, many = fold(total, held), [], 0
                if len(total[0]) > PAIRS:
                    yield from send(total)
                    total = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            step += 1
        yield from send(fold(total, held))

    def summed(cells: pa.Table) -> pa.Table:
        trim()
        ids, sizes, counts, b, size_b, n = joined([loosened(c) for c in cells.column("cell").to_pylist()], "i8", "u4", "u4", "i8", "u4", "u4")
        a, size_a = np.repeat(ids, counts), np.repeat(sizes, counts)
        at = np.lexsort((b, a))
        a, b, size_a, size_b, n = a[at], b[at], size_a[at].astype(np.int64), size_b[at].astype(np.int64), n[at]
        start = np.flatnonzero(_fresh(a, b))
        n = np.add.reduceat(n.astype(np.int64), start) if len(start) else n
        a, b, size_a, size_b = a[start], b[start], size_a[start], size_b[start]
        bound = n + np.maximum(needed(size_a, threshold), needed(size_b, threshold)) - 1  # the prefix that ends first may be either's
        near = bound >= needed(size_a + size_b, threshold / (1 + threshold))
        a, b, size_a, size_b = a[near], b[near], size_a[near], size_b[near].astype(np.uint32)
        who, start, end = _runs_of(a)
        return pa.table([pa.array(who, pa.int64()), pa.array(size_a[start], pa.int32()), pa.array([0] * len(who), pa.int32()), pa.array([pack(b[x:y], size_b[x:y]) for x, y in zip(start, end)], pa.binary())], names=["a", "size_a", "home", "others"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("cell").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(loosened(cell), "i8", "i8")], names=["doc_a", "doc_b"])

    counted = cut(reps.select("doc_id", "size", "codes", "levels").mapInArrow(prefixes, _PARTS_SQL).groupBy("part").applyInArrow(pairs, _PARTS_SQL))
    return counted.where("kind = 0").groupBy("part").applyInArrow(summed, _NEAR), counted.where("kind = 1").mapInArrow(links, "doc_a bigint, doc_b bigint").distinct()


def overlaps(near: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, many: int = FRAGMENTS) -> DataFrame:
    """Of candidates(), the pairs at or above the threshold with their exact overlaps: partial ones by fragment of the n-gram order, summed.

    Documents of one group of near copies meet in one bucket, named by the least neighbour of a pair's first document, so that a document's
    n-grams travel about once and not once for each of its pairs.
    """
    parts = fragments(reps.sparkSession)
    order, octets = order_of(reps, threshold, many, code_bits(parts), whole=True), -(-code_bits(parts) // 8)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, others = batch.column("a").to_numpy(), [unpack(c, "i8", "u4")[0] for c in batch.column("others").to_pylist()]
            x = np.concatenate([a, *others]).astype(np.int64)
            y = np.concatenate([a, np.repeat(a, [len(o) for o in others])]).astype(np.int64)
            at = np.lexsort((y, x))
            fresh = _fresh(x[at])
            yield pa.RecordBatch.from_arrays([pa.array(x[at][fresh]), pa.array(y[at][fresh])], names=["x", "y"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, a, others = batch.column("home").to_numpy(), batch.column("a").to_numpy(), [unpack(c, "i8", "u4")[0] for c in batch.column("others").to_pylist()]
            x = np.concatenate([a, *others]).astype(np.int64)
            h = np.concatenate([home, np.repeat(home, [len(o) for o in others])]).astype(np.int32)
            at = np.lexsort((x, h))
            fresh = _fresh(h[at], x[at])
            yield pa.RecordBatch.from_arrays([pa.array(h[at][fresh]), pa.array(x[at][fresh])], names=["spot", "doc_id"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, levels, starts = _flat(batch)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                part = order.fragment(levels, codes)
                at = np.lexsort((owner, part))
                codes, key = codes[at], part[at] * batch.num_rows + owner[at]
                keys, start, end = _runs_of(key)
                rows = pa.array(keys % batch.num_rows)
                cells = [codes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :octets].tobytes() for a, b in zip(start, end)]
                yield pa.RecordBatch.from_arrays([batch.column("spot").take(rows), pa.array((keys // batch.num_rows).astype(np.int32)), batch.column("doc_id").take(rows), pa.array(cells, pa.binary())], names=["spot", "g", "doc_id", "seg"])

    def count(two: pa.Table, segs: pa.Table) -> pa.Table:
        trim()
        if not two.num_rows:
            return schema.empty_table()
        others = [unpack(c, "i8", "u4")[0] for c in two.column("others").to_pylist()]
        lengths = np.array([len(o) for o in others])
        docs = segs.column("doc_id").to_numpy()
        cells = segs.column("seg").to_pylist()
        size = np.array([len(c) // octets for c in cells], np.int64)
        at = np.argsort(docs, kind="stable")
        rank = np.empty(len(docs), np.int64)
        rank[at] = np.arange(len(docs))
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :octets] = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, octets)
        _, flat = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        del wide
        base = int(flat.max()) + 1 if len(flat) else 1
        key = np.sort(np.repeat(rank, size) * base + flat)
        # a document without n-grams in this fragment is the last one, of size 0
        docs, size = docs[at], np.append(size[at], 0)
        start = np.concatenate([[0], np.cumsum(size)])

        def place(ids: np.ndarray) -> np.ndarray:
            spot = np.minimum(np.searchsorted(docs, ids), max(0, len(docs) - 1))
            return np.where(docs[spot] == ids, spot, len(docs)) if len(docs) else np.zeros(len(ids), np.int64)

        x, y = place(np.repeat(two.column("a").to_numpy(), lengths)), place(np.concatenate(others))
        x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        n = np.zeros(len(x), np.uint32)
        for a, b in _runs(size[x], 1_000_000):
            m = size[x[a:b]]
            owner = np.repeat(np.arange(b - a), m)
            mine = key[np.repeat(start[x[a:b]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())] % base
            sought = y[a:b][owner] * base + mine
            spot = np.minimum(np.searchsorted(key, sought), max(len(key) - 1, 0))
            n[a:b] = np.bincount(owner[key[spot] == sought], minlength=b - a) if len(sought) else 0
        cut_at = np.concatenate([[0], np.cumsum(lengths)])
        return pa.table([two.column("a"), two.column("f"), pa.array([n[a:b].tobytes() for a, b in zip(cut_at, cut_at[1:])], pa.binary())], schema=schema)

    schema = pa.schema([("a", pa.int64()), ("f", pa.int32()), ("n", pa.binary())])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, size_a, home, others, parts_of in zip(*(batch.column(c).to_pylist() for c in ("a", "size_a", "home", "others", "ns"))):
                b, size_b = unpack(others, "i8", "u4")
                n = np.sum([np.frombuffer(p, np.uint32) for p in parts_of], axis=0, dtype=np.int64)
                whole = size_a + size_b.astype(np.int64) - n
                near = n >= (threshold - 1e-12) * whole
                if near.any():
                    rows.append((a, size_a, home, pack(b[near], size_b[near], n[near].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["a", "size_a", "home", "others"])

    home = near.mapInArrow(ends, "x bigint, y bigint").groupBy("x").agg(F.pmod(F.xxhash64(F.min("y")), F.lit(parts)).cast("int").alias("home"))
    placed = cut(near.drop("home").join(home.withColumnRenamed("x", "a"), "a").select("a", "size_a", "home", "others"))
    spots = placed.mapInArrow(wanted, "spot int, doc_id bigint").distinct()
    pieces_of = reps.select("doc_id", "codes", "levels").join(spots, "doc_id").mapInArrow(segments, "spot int, g int, doc_id bigint, seg binary")
    sides = placed.select("home", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("f"), "a", "others")
    counted = sides.groupBy("home", "f").cogroup(pieces_of.groupBy("spot", "g")).applyInArrow(count, "a bigint, f int, n binary")
    together = counted.groupBy("a").agg(F.collect_list("n").alias("ns"))  # as many as there are fragments
    return placed.join(together, "a").mapInArrow(exact, _NEAR)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about `most`, or of one element."""
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, and so on."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def tile_overlaps(one: tuple, other: tuple) -> np.ndarray:
    """Overlaps of every document of a tile with every one of another. A tile: how many documents; the document of each n-gram, sorted by n-gram; the distinct n-grams; where each one's run starts and ends."""
    (rows, owner, grams_, begin, end), (columns, owner2, grams2, begin2, end2) = one, other
    out = np.zeros((rows, columns), np.int32)
    _, at, at2 = np.intersect1d(grams_, grams2, assume_unique=True, return_indices=True)
    a, m, b, k = begin[at], (end - begin)[at], begin2[at2], (end2 - begin2)[at2]
    dense = m * k >= DENSE * rows * columns
    where = np.flatnonzero(dense)
    for c in range(0, len(where), COLUMNS):
        w = where[c : c + COLUMNS]
        left, right = np.zeros((rows, len(w)), np.float32), np.zeros((columns, len(w)), np.float32)
        left[owner[_ranges(a[w], m[w])], np.repeat(np.arange(len(w)), m[w])] = 1
        right[owner2[_ranges(b[w], k[w])], np.repeat(np.arange(len(w)), k[w])] = 1
        out += (left @ right.T).astype(np.int32)  # numbers to COLUMNS are exact
    a, m, b, k = a[~dense], m[~dense], b[~dense], k[~dense]
    for x, y in _runs(m * k, 1_000_000):
        many = (m * k)[x:y]
        gram, spot = np.repeat(np.arange(x, y), many), _ranges(np.zeros(y - x, np.int64), many)
        key = owner[a[gram] + spot // k[gram]] * columns + owner2[b[gram] + spot % k[gram]]
        out += np.bincount(key, minlength=rows * columns).reshape(rows, columns)
    return out


def crowds(reps: DataFrame, labels: DataFrame, most_docs: int = CROWD_DOCS, most_grams: int = CROWD_GRAMS) -> DataFrame:
    """The documents of labels (doc_id, least), once for each task that compares two blocks i <= j of a crowd: least, i, j, block, doc_id, size, codes."""
    held = cut(reps.select("doc_id", "size", "codes").join(sized(labels, labels.count()), "doc_id"))
    blocks = F.ceil(F.greatest(F.count("*") / most_docs, F.sum(F.size("codes")) / most_grams)).cast("int")
    wide = cut(held.groupBy("least").agg(blocks.alias("blocks")).where("blocks > 1"))
    blocked = held.join(sized(wide, wide.count()), "least", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = blocked.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("least", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc_id", "size", "codes")


def compared(tasks: DataFrame, threshold: float = THRESHOLD, as_pairs: bool = False, tile: int = TILE) -> DataFrame:
    """Of crowds(): (doc_id, links, head), a document's links to others in a task and the least doc_id it reaches by them there; or all near pairs, a row each."""

    def tiles(key: tuple, rows: pa.Table) -> Iterator[tuple]:
        """(doc_ids, sizes) of all, sorted; then the starts of two tiles, and their overlaps."""
        trim()
        block, docs, size = (rows.column(c).to_numpy() for c in ("block", "doc_id", "size"))
        lists = rows.column("codes")
        counts = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists.chunks]).astype(np.int64)
        codes = np.concatenate([c.flatten().to_numpy() for c in lists.chunks])
        at = np.lexsort((docs, size, block))
        rank = np.empty(len(at), np.int64)
        rank[at] = np.arange(len(at))
        docs, size, block = docs[at], size[at].astype(np.int64), block[at]
        _, gram = np.unique(codes, return_inverse=True)
        del codes
        owner = np.repeat(rank, counts)
        several = np.bincount(gram)[gram] > 1
        gram, owner = gram[several], owner[several]
        yield docs, size
        within = key[1] == key[2]
        half, held = len(docs) if within else int(np.searchsorted(block, key[2].as_py())), []
        starts = [*range(0, half, tile), *range(half, len(docs), tile)]
        at = np.lexsort((gram, np.searchsorted(starts, owner, "right")))
        gram, owner = gram[at], owner[at]
        edges = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(starts, owner, "right") - 1, minlength=len(starts)))])
        for s, e, a, b in zip(starts, [*starts[1:], len(docs)], edges, edges[1:]):
            held.append((e - s, owner[a:b] - s, *_runs_of(gram[a:b])))
        for p, x in enumerate(starts):
            for q, y in enumerate(starts):
                if q < p or not (within or x < half <= y):
                    continue  # two blocks: only pairs between them
                ends = x + held[p][0] - 1, y + held[q][0] - 1
                if size[ends[0]] >= needed(size[y], threshold) and size[ends[1]] >= needed(size[x], threshold):
                    yield x, y, tile_overlaps(held[p], held[q])

    def near_of(size: np.ndarray, x: int, y: int, n: np.ndarray) -> np.ndarray:
        whole = size[x : x + n.shape[0], None] + size[None, y : y + n.shape[1]] - n
        near = n >= (threshold - 1e-12) * whole
        return np.triu(near, 1) if x == y else near

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        found = tiles(key, rows)
        docs, size = next(found)
        links, head = np.zeros(len(docs), np.int64), np.arange(len(docs))
        for x, y, n in found:
            near = near_of(size, x, y, n)
            links[x : x + n.shape[0]] += near.sum(1)
            links[y : y + n.shape[1]] += near.sum(0)
            a, b = np.nonzero(near & (head[x : x + n.shape[0], None] != head[None, y : y + n.shape[1]]))
            if len(a):
                node, least = _forest(head[a + x], head[b + y])
                to = np.arange(len(docs))
                to[node] = least
                head = to[head]
        order = np.lexsort((docs, head))
        _, start, end = _runs_of(head[order])
        least = np.empty(len(docs), np.int64)
        least[order] = np.repeat(docs[order][start], end - start)
        some = links > 0
        return pa.table({"doc_id": pa.array(docs[some]), "links": pa.array(links[some]), "head": pa.array(least[some])})

    def listed(key: tuple, rows: pa.Table) -> pa.Table:
        found = tiles(key, rows)
        docs, size = next(found)
        out = []
        for x, y, n in found:
            i, k = np.nonzero(near_of(size, x, y, n))
            a, b = np.where(docs[i + x] < docs[k + y], (i + x, k + y), (k + y, i + x))
            out.append(pa.table([docs[a], size[a], docs[b], size[b], n[i, k].astype(np.int64)], schema=_PAIRS))
        return pa.concat_tables(out) if out else _PAIRS.empty_table()

    by = tasks.groupBy("least", "i", "j")
    return by.applyInArrow(listed, _PAIRS_SQL) if as_pairs else by.applyInArrow(summed, "doc_id bigint, links bigint, head bigint")


def near_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, local: int = LOCAL, common: int = COMMON, hot: int = HOT, most_docs: int = CROWD_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, least, copies, size) of each document of an n-gram set that several have, with the least doc_id and the number of those;
    (a, size_a, b, size_b, overlap) of the near pairs a < b of least ones that are in no crowd together; and crowds() of the others."""
    spark = docs.sparkSession
    found = cut(sets(docs, n, threshold, local, common))
    release(spark)
    alike = found.where("sig is not null").select("sig", "size", "doc_id")
    classes = cut(alike.groupBy("sig", "size").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1"))
    members = cut(heavy_join(alike, classes, ["sig", "size"], "copies").select("doc_id", "least", "copies", "size"))
    later = members.where("doc_id > least").select("doc_id")
    reps = found.join(sized(later, later.count()), "doc_id", "left_anti")
    possible, links = candidates(reps, threshold, hot)
    labels = components(links)
    pairs = _pairs_of(overlaps(cut(possible), reps, threshold))
    hint = sized(labels, labels.count())
    for end in ("a", "b"):
        pairs = pairs.join(hint.select(F.col("doc_id").alias(end), F.col("least").alias(f"crowd_{end}")), end, "left")
    apart = cut(pairs.where("crowd_a is null or crowd_b is null or crowd_a <> crowd_b").select(*_PAIRS.names))
    tasks = crowds(reps, labels, most_docs)
    release(spark)
    return members, apart, tasks


def _pairs_of(near: DataFrame) -> DataFrame:
    """A row for each pair: (a, size_a, b, size_b, overlap)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [unpack(c, "i8", "u4", "u4") for c in batch.column("others").to_pylist()]
            many = [len(b) for b, _, _ in others]
            a, size_a = (np.repeat(batch.column(c).to_numpy(), many).astype(np.int64) for c in ("a", "size_a"))
            b, size_b, n = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in others)]).astype(np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, size_a, b, size_b, n)], schema=_PAIRS)

    return near.mapInArrow(work, _PAIRS_SQL)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, local: int = LOCAL, common: int = COMMON, hot: int = HOT, most_docs: int = CROWD_DOCS, tile: int = TILE) -> DataFrame:
    """All near pairs: (doc_a, doc_b, overlap, jaccard), doc_a < doc_b.

    Documents with equal n-gram sets form a class; the class is given as pairs of its least doc_id with each other member (jaccard 1),
    and a pair of classes as the pair of their least doc_ids. So every pair of documents at or above the threshold follows from
    one row or from members of two rows, and the result stays linear in the size of a class.

    Rows with a null doc_id or text, and texts without words, have no n-grams and no pairs. Rows that share a doc_id are one document:
    repeated rows change nothing; where their texts differ, the union of the n-grams counts, against the largest size. Ties at the
    threshold are in. Long texts count whole. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    members, apart, tasks = near_sets(docs, n, threshold, local, common, hot, most_docs)
    jaccard = F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    pairs = apart.unionByName(compared(tasks, threshold, True, tile)).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "overlap", F.round(F.least(jaccard, F.lit(1.0)), 6).alias("jaccard"))
    return pairs.unionByName(members.where("doc_id > least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.col("size").cast("bigint").alias("overlap"), F.lit(1.0).alias("jaccard")))


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node that it is linked to) of the edges x-y."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, least = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = least[least]
        if (least == before).all():
            return nodes, nodes[least]


def _links_of(apart: DataFrame, tasks: DataFrame, threshold: float, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, links): how many near partners each has; (doc_a, doc_b): fewer pairs with the same groups, as the links within a task become a star."""
    inner = cut(compared(tasks, threshold, tile=tile))
    ends = apart.select(F.col("a").alias("doc_id"), F.lit(1).cast("bigint").alias("links")).unionByName(apart.select(F.col("b").alias("doc_id"), F.lit(1).cast("bigint").alias("links")))
    counted = ends.unionByName(inner.select("doc_id", "links")).groupBy("doc_id").agg(F.sum("links").alias("links"))
    stars = inner.where("head <> doc_id").select(F.col("head").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    return counted, stars.unionByName(apart.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, local: int = LOCAL, common: int = COMMON, hot: int = HOT, most_docs: int = CROWD_DOCS, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, copies, links) of every document that has a near copy.

    class_id: the least doc_id of its group, linked by near pairs by as many links as it takes. copies: documents with its n-gram set, itself
    among them. links: the other n-gram sets at or above the threshold with its own, each once however many documents have it. So no link between
    different texts is left out, and copies aren't expanded into pairs. Odd rows are treated as in join().
    """
    members, apart, tasks = near_sets(docs, n, threshold, local, common, hot, most_docs)
    links, stars = _links_of(apart, tasks, threshold, tile)
    groups = cut(components(stars))
    alike = members.where("doc_id = least").select(F.col("least").alias("doc_id"), "copies")
    heads = cut(groups.join(links, "doc_id").join(alike, "doc_id", "full").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))
    copies = heavy_join(members.where("doc_id > least").select("doc_id", "least"), heads.withColumnRenamed("doc_id", "least"), ["least"], "copies")
    return heads.unionByName(copies.select("doc_id", "class_id", "copies", "links"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, least): the least doc_id linked to each document of pairs (doc_a, doc_b), by as many links as it takes.

    Each round gives a document the least label among its own and its neighbours', then the label of that label; the rounds needed
    grow with the logarithm of the longest chain for usual groups. Ends when a round changes nothing. A null on a side is no link; a
    document linked to itself alone, and an empty table, give no rows; repeated and reversed pairs count once. Other columns are ignored.
    """
    edges = cut(pairs.selectExpr("doc_a as x", "doc_b as y").unionByName(pairs.selectExpr("doc_b as x", "doc_a as y")).where("x <> y").distinct())  # nulls aren't unequal
    labels = cut(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("least")))
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("least").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        stepped = labels.join(near, "x").select("x", F.col("least").alias("old"), F.least("least", "l").alias("least"))
        jumped = stepped.join(stepped.select(F.col("x").alias("least"), F.col("least").alias("next")), "least", "left")
        after = cut(jumped.select("x", "old", F.least("least", F.coalesce("next", "least")).alias("least")))
        changed = after.where("old <> least").limit(1).count()
        labels = after.select("x", "least")
        if not changed:
            return labels.select(F.col("x").alias("doc_id"), "least")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of linked near copies, that with the least doc_id; all columns are kept.

    Rows with a null doc_id or text, and those without words, have no copies and stay. Of rows that share a doc_id, one stays: the least by text and the other columns' JSON.
    """
    spark = docs.sparkSession
    members, apart, tasks = near_sets(docs, n, threshold)
    later = components(_links_of(apart, tasks, threshold)[1]).where("doc_id > least").select("doc_id")
    gone = cut(later.unionByName(members.where("doc_id > least").select("doc_id")).distinct().withColumnRenamed("doc_id", "gone_id"))
    release(spark)
    once = docs.join(sized(gone, gone.count()), docs["doc_id"] == gone["gone_id"], "left_anti")
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id")))
    if again.isEmpty():
        return once
    hint = sized(again, again.count())
    kept = once.join(hint, docs["doc_id"] == again["gone_id"], "left_anti")
    rows = once.join(hint, docs["doc_id"] == again["gone_id"], "left_semi")
    everything = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = rows.groupBy("doc_id").agg(F.min(F.struct(F.to_json(everything).alias("key"), everything.alias("row"))).alias("m"))
    return kept.unionByName(best.select("m.row.*"))
