"""Best-fit packing of documents into bins of fixed capacity, in bulk-synchronous rounds.

A document of n words becomes n div capacity whole bins and a remainder. Remainders are placed by falling size class: those over
half the capacity, then those over an eighth, a thirty-second and so on. A class takes rounds of one match each:

* The class's items and the open gaps are range-sorted by size together. A gap that can take several items of any size in the class
  stands as so many equal slots.
* Every partition sweeps its rows upwards: an item waits on a stack, a slot takes the item on top, which is the largest that fits and
  for which it is the tightest slot left. Left over are slots without an item below, then items without a slot above. Their numbers,
  two for each partition, go to the driver, which continues the sweep over partitions and answers with ranges of ranks:
  "slots 10-19 left over in partition 7 take items 0-9 left over in partition 5". Ties and conflicts are settled by that rank alone.
* Gaps shrink by what they took, and the class sweeps again, until a round places nothing.

Items of the class that fit nowhere then open bins, by best fit over falling sizes: which item shares a bin with which depends only on how many
there are of each size, so the driver lays out bins for these counts (no more than there are sizes below the capacity), and an item finds its place by its
rank among those of its size. A round places as many items as any matching of items to slots could, so a class needs few rounds, and
there are about log4(capacity) + 1 classes, whatever the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenloom.llm.common import cut, fragments, release, sized

CAPACITY = 2048
#: A sweep uses a partition for so many rows, and no more partitions than the session's shuffles have.
SWEEP_ROWS = 50_000
_SWEPT = "part int, kind int, id bigint, slot int, size int, bin bigint, bin_slot int, rank bigint"


def words_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))


def _pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """A row for each piece: item (its number, fixed by the checkpoint), doc_id, piece, start, size, level. A text without words is one piece of size 0."""
    n = words_of(F.col("text").cast("string"))
    many = F.greatest(F.ceil(F.col("n") / capacity).cast("int"), F.lit(1))
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece"))
    rows = each.select("doc_id", "piece", (F.col("piece") * capacity).cast("bigint").alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    level = F.when(F.col("size").between(1, capacity - 1), F.floor((F.floor(F.log2(F.lit(capacity) / F.col("size"))) + 1) / 2).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("item"), "*", level.alias("level"))


def _sweep(items: DataFrame, slots: DataFrame, number: int) -> DataFrame:
    """items: (id, size); slots: (id, slot, size). Rows with a bin are matches; the others are left over, ranked as the module says."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        waiting: list[tuple[int, int]] = []
        free = 0
        for rows in batches:
            out = []
            for kind, i, slot, size in zip(rows["kind"].tolist(), rows["id"].tolist(), rows["slot"].tolist(), rows["size"].tolist()):
                if not kind:
                    waiting.append((i, size))
                elif waiting:
                    item, room = waiting.pop()
                    out.append((part, 0, item, 0, room, i, slot, None))
                else:
                    out.append((part, 1, i, slot, size, None, None, free))
                    free += 1
            yield _frame(out)
        waiting.reverse()
        for at in range(0, len(waiting), 10_000):
            yield _frame([(part, 0, i, 0, size, None, None, at + k) for k, (i, size) in enumerate(waiting[at : at + 10_000])])

    rows = items.select(F.lit(0).alias("kind"), "id", F.lit(0).alias("slot"), "size").unionByName(slots.select(F.lit(1).alias("kind"), "id", "slot", "size"))
    by = ["size", "kind", "id", "slot"]
    return rows.repartitionByRange(number, *by).sortWithinPartitions(*by).mapInPandas(sweep, _SWEPT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    return df.astype({"part": "int32", "kind": "int32", "id": "int64", "slot": "int32", "size": "int32", "bin": "Int64", "bin_slot": "Int32", "rank": "Int64"})


def across(left: dict[int, list[int]]) -> list[tuple[int, int, int, int, int]]:
    """The sweep continued over partitions. left[part]: items and slots left over. Gives (slots' part, first rank, last rank + 1, items' part, first rank)."""
    stack: list[list[int]] = []  # [part, items left, next rank]
    out = []
    for part in sorted(left):
        items, slots = left[part]
        at = 0
        while at < slots and stack:
            top = stack[-1]
            n = min(slots - at, top[1])
            out.append((part, at, at + n, top[0], top[2]))
            at, top[1], top[2] = at + n, top[1] - n, top[2] + n
            if not top[1]:
                stack.pop()
        if items:
            stack.append([part, items, 0])
    return out


def _round(todo: DataFrame, gaps: DataFrame, largest: int, number: int, rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """One match of todo (id, size) with gaps (bin, gap): what was placed (id, size, bin, round, slot), what wasn't, and the numbers of both. rows: about how many take part."""
    spark = todo.sparkSession
    times = F.greatest(F.floor(F.col("gap") / largest).cast("int"), F.lit(1))
    slots = gaps.select(F.col("bin").alias("id"), F.explode(F.sequence(F.lit(0), times - 1)).alias("slot"), F.floor(F.col("gap") / times).cast("int").alias("size"))
    swept = cut(_sweep(todo, slots, max(1, min(fragments(spark), rows // SWEEP_ROWS))))
    left: dict[int, list[int]] = {}
    matched = waiting = 0
    for r in swept.groupBy("part", "kind", F.col("bin").isNotNull().alias("done")).count().collect():
        if r["done"]:
            matched += r["count"]
        else:
            left.setdefault(r["part"], [0, 0])[r["kind"]] = r["count"]
            waiting += r["count"] * (not r["kind"])
    ranges = across(left)
    placed = swept.where("bin is not null").select("id", "size", "bin", F.col("bin_slot").alias("slot"))
    rest = swept.where("bin is null")
    todo = rest.where("kind = 0")
    if ranges:
        taken: dict[int, int] = {}
        for _, a, b, items, first in ranges:
            taken[items] = max(taken.get(items, 0), first + b - a)
        spans = F.broadcast(spark.createDataFrame(ranges, "to int, a bigint, b bigint, items int, first bigint"))  # two rows a partition at most
        free = rest.where("kind = 1").join(spans, (F.col("part") == F.col("to")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))).select(F.col("id").alias("bin"), "slot", F.col("items").alias("from"), (F.col("rank") - F.col("a") + F.col("first")).alias("at"))
        placed = placed.unionByName(todo.select("id", "size", "part", "rank").join(free, (F.col("part") == F.col("from")) & (F.col("rank") == F.col("at"))).select("id", "size", "bin", "slot"))
        gone = F.broadcast(spark.createDataFrame(list(taken.items()), "of int, taken bigint"))
        todo = todo.join(gone, F.col("part") == F.col("of"), "left").where("taken is null or rank >= taken")
        crossed = sum(b - a for _, a, b, _, _ in ranges)
        matched, waiting = matched + crossed, waiting - crossed
    return placed.withColumn("round", F.lit(number)), todo.select("id", "size"), matched, waiting


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit by falling size into new bins, for so many items of each size: rows (size, first, bin, per, place), up to the next row of its size.

    The item of rank r among those of its size, from a row's first on, goes to bin + (r - first) // per, at place + (r - first) % per * size.
    Bins count from 0. Bins with the same gap are taken together, so the work and the rows depend on the number of sizes and not of items.
    """
    spans: dict[int, list[tuple[int, int]]] = {}  # bins from, to, by gap
    order: list[int] = []
    bins, rows = 0, []

    def add(gap: int, low: int, high: int) -> None:
        if gap and low < high:
            if gap not in spans:
                insort(order, gap)
            spans.setdefault(gap, []).append((low, high))

    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            k = bisect_left(order, size)
            if k < len(order):
                gap = order[k]
                low, high = spans[gap].pop()
                if not spans[gap]:
                    del spans[gap], order[k]
            else:
                gap, low = capacity, bins
                high = bins = bins - left // -(capacity // size)
            for per in (gap // size, left % (gap // size)):  # full bins, then one with what is left
                many = min(high - low, left // per) if per else 0
                if many:
                    rows.append((size, at, low, per, capacity - gap))
                    add(gap - per * size, low, low + many)
                    at, left, low = at + many * per, left - many * per, low + many
            add(gap, low, high)
    return rows


def _open(todo: DataFrame, capacity: int, number: int, start: int) -> tuple[DataFrame, int]:
    """Bins for the items of todo, which fit in no gap, by best_fit(): the items placed, and the first number after the bins'. start: the first bin's number."""

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for rows in batches:
            before = rows["size"].map(lambda s: seen[s]).astype("int64")
            yield rows.assign(part=part, at=before + rows.groupby("size").cumcount())
            seen.update(rows["size"].value_counts().to_dict())

    ranked = cut(todo.select("id", "size").mapInPandas(rank, "id bigint, size int, part int, at bigint"))
    counts = cut(ranked.groupBy("size", "part").agg(F.count("*").alias("n")))
    before = F.expr("coalesce(sum(n) over (partition by size order by part rows between unbounded preceding and 1 preceding), 0)")
    firsts = counts.select("size", "part", before.alias("before"))
    table = np.array(sorted(best_fit({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (table[:, 0] << 40) + table[:, 1]
        for rows in batches:
            size, at = rows["size"].to_numpy(np.int64), rows["at"].to_numpy(np.int64)
            _, first, low, per, spot = table[np.searchsorted(keys, (size << 40) + at, "right") - 1].T
            yield pd.DataFrame({"id": rows["id"], "size": rows["size"], "bin": start + low + (at - first) // per, "slot": (spot + (at - first) % per * size).astype(np.int32), "round": np.full(len(rows), number, np.int32)})

    placed = ranked.join(sized(firsts, counts.count()), ["size", "part"]).select("id", "size", (F.col("at") + F.col("before")).alias("at"))
    done = cut(placed.mapInPandas(place, "id bigint, size int, bin bigint, slot int, round int"))
    return done, (done.agg(F.max("bin")).first()[0] or start) + 1


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, place): words [start, start + length) of the document lie at `place` in the bin.

    Every word of every row lies in exactly one bin, and no bin holds more than `capacity`. A null or empty text has one row of length 0 without a bin.
    A null doc_id stays null; repeated rows are packed each for itself. Ties are settled by rank, so bins may differ with the layout of the
    input, never within a run. Other columns are ignored. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = cut(_pieces(docs, capacity))
    release(items.sparkSession)
    levels = {r["level"]: r["count"] for r in items.groupBy("level").count().collect() if r["level"] is not None}
    placed: list[DataFrame] = []
    gaps: DataFrame | None = None
    number = bins = 0
    start = (items.agg(F.max("item")).first()[0] or 0) + 1  # bins of whole pieces have the piece's number
    for level, waiting in sorted(levels.items()):
        largest = capacity if not level else capacity >> (2 * level - 1)
        todo = items.where(F.col("level") == level).select(F.col("item").alias("id"), "size")
        while gaps is not None and waiting:
            now, todo, matched, waiting = _round(todo, gaps, largest, number, waiting + bins)
            number += 1
            if not matched:
                break
            placed.append(now)
            used = now.groupBy(F.col("bin").alias("b")).agg(F.sum("size").alias("used"))
            gaps = cut(gaps.join(used, F.col("bin") == F.col("b"), "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap")).where("gap > 0"))
        if waiting:
            new, start = _open(todo, capacity, number, start)
            number += 1
            placed.append(new)
            fresh = new.groupBy("bin").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("gap")).where("gap > 0")
            gaps = cut(fresh if gaps is None else gaps.unionByName(fresh))
            bins = gaps.count()
        release(items.sparkSession)
    whole = items.where(F.col("size") == capacity).select(F.col("item").alias("id"), "size", F.col("item").alias("bin"), F.lit(0).alias("slot"), F.lit(0).alias("round"))
    for df in placed:
        whole = whole.unionByName(df.select("id", "size", "bin", "slot", "round"))
    before = F.expr("sum(size) over (partition by bin order by round, slot, id rows unbounded preceding) - size")
    spots = whole.select("id", "bin", before.cast("int").alias("place"))
    full = items.where("size > 0").join(spots, F.col("item") == F.col("id")).select("doc_id", "piece", "start", F.col("size").alias("length"), F.col("bin").alias("bin_id"), "place")
    none = items.where("size = 0").select("doc_id", "piece", "start", F.col("size").alias("length"), F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("place"))
    return full.unionByName(none)
