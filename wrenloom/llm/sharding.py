"""Sharding by balanced label propagation.

Documents are linked by the lines that they share: a line in k documents links each of them to the k - 1 others. The links are never written
out. In a round, each line's documents are counted by shard, and the counts go back to the line's documents, where they are summed,
less the document itself: that is exactly how many links lead into each shard, at a cost linear in the lines. Very common lines are salted
on the way back.

Every document starts in shard rank mod shards, by its rank in the order of md5(doc_id), so that sizes differ by one at most whatever the ids. In a
round, the documents whose turn it is ask for the shard with most of their links, if that has more than where they are. From shard s to t
as many may go as come from t to s; what room t has under its capacity goes to those beyond, by the number of s. The greatest gains
go first, ties by rank. Who is among the first is found from a histogram of gains and ranks, and by sorting only the bin in which a quota
ends. Sizes never exceed the capacity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenloom.llm.common import cut, heavy_join, release

#: Lines of fewer characters than LEAST_LINE link nothing: separators and the like.
SHARDS, ROUNDS, SLACK, LEAST_LINE = 16, 8, 0.05, 20
#: A line's documents are joined with its counts in groups of about so many; bins of ranks in the histogram.
SALT, BINS = 50_000, 64
#: Rounds after which the files of their shuffles are removed.
EVERY = 1


def capacity_of(documents: int, shards: int, slack: float) -> int:
    """The most documents in a shard: their even share, rounded up, and the slack on top of it, rounded down."""
    even = -(-documents // shards)
    return even + int(even * slack + 1e-9)


def ranked(ids: DataFrame) -> DataFrame:
    """(doc_id, rank): ranks from 0 in the order of md5(doc_id). The first three hex digits cut it into 4096 ranges, sorted apart."""
    keyed = ids.select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key")).withColumn("range", F.substring("key", 1, 3))
    offsets = keyed.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # at most 4096 rows
    placed = keyed.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id")))
    return placed.join(F.broadcast(offsets), "range").select("doc_id", (F.col("before") + F.col("place") - 1).alias("rank"))


def shared_lines(docs: DataFrame, least_line: int = LEAST_LINE) -> DataFrame:
    """(line, doc_id, documents): the lines that several documents have, as 64-bit hashes, and how many have them."""
    rows = cut(docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= least_line).select(F.xxhash64("line").alias("line"), "doc_id").distinct())
    counted = cut(rows.groupBy("line").agg(F.count("*").alias("documents")).where("documents > 1"))
    return heavy_join(rows, counted, ["line"], "documents").select("line", "doc_id", "documents")


def votes(lines: DataFrame, homes: DataFrame) -> DataFrame:
    """(doc_id, shard, there, votes): how many links lead from a document to others in shard `there`. lines: with a salt, below `salts`."""
    here = lines.join(homes.select("doc_id", "shard"), "doc_id")
    counts = here.groupBy("line", "salts", F.col("shard").alias("there")).agg(F.count("*").alias("n"))
    spread = counts.select("line", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "there", "n")
    own = F.when(F.col("there") == F.col("shard"), 1).otherwise(0)
    return here.join(spread, ["line", "salt"]).groupBy("doc_id", "shard", "there").agg(F.sum(F.col("n") - own).alias("votes")).where("votes > 0")


def granted(asks: DataFrame, sizes: DataFrame, most: int, documents: int) -> DataFrame:
    """(doc_id, to): those of asks (doc_id, rank, from, to, gain) who may go, with shards of `sizes` holding `most` at most."""
    asks = cut(asks.withColumn("bin", F.expr(f"cast(rank * {BINS} div {max(1, documents)} as int)")))
    histogram = asks.groupBy("from", "to", "gain", "bin").agg(F.count("*").alias("n"))
    flow = histogram.groupBy("from", "to").agg(F.sum("n").alias("asking"))
    back = flow.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("asking").alias("back"))
    left = flow.join(back, ["from", "to"], "left").withColumn("swap", F.least("asking", F.coalesce("back", F.lit(0)))).join(sizes.select(F.col("shard").alias("to"), "size"), "to", "left")
    queue = Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("asking") - F.col("swap"), F.lit(most) - F.coalesce("size", F.lit(0)) - F.coalesce(F.sum(F.col("asking") - F.col("swap")).over(queue), F.lit(0))))
    quotas = left.select("from", "to", (F.col("swap") + extra).alias("quota")).where("quota > 0")
    ahead = Window.partitionBy("from", "to").orderBy(F.desc("gain"), "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = histogram.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(quotas, ["from", "to"]).where("before < quota")
    in_reach = asks.join(bins.select("from", "to", "gain", "bin", "before", "n", "quota"), ["from", "to", "gain", "bin"])
    whole = in_reach.where(F.col("before") + F.col("n") <= F.col("quota"))
    last = in_reach.where(F.col("before") + F.col("n") > F.col("quota")).withColumn("place", F.row_number().over(Window.partitionBy("from", "to", "gain", "bin").orderBy("rank"))).where("before + place <= quota")
    return whole.select("doc_id", "to").unionByName(last.select("doc_id", "to"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, least_line: int = LEAST_LINE, salt: int = SALT) -> DataFrame:
    """(doc_id, shard) of every document.

    No shard has more than capacity_of() documents, and every one has its even share or one less at the start. Rows with a null doc_id can't be placed and
    are left out; a null or empty text has no links and stays where it starts. Rows that share a doc_id are one document with the lines
    of all. Lines count whole, however long; those under `least_line` characters link nothing. Ties go to the lower shard and the
    lower rank. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = shared_lines(rows, least_line).withColumn("salts", F.expr(f"cast((documents + {salt - 1}) div {salt} as int)"))
    lines = cut(lines.select("line", "doc_id", "salts", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt")))
    homes = cut(ranked(rows.select("doc_id").distinct()).withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")))
    release(homes.sparkSession)
    documents = homes.count()
    most = capacity_of(documents, shards, slack)
    for r in range(rounds):
        there = F.struct("votes", (-F.col("there")).alias("minus"))
        best = votes(lines, homes).groupBy("doc_id", "shard").agg(F.max(F.when(F.col("there") != F.col("shard"), there)).alias("best"), F.coalesce(F.max(F.when(F.col("there") == F.col("shard"), F.col("votes"))), F.lit(0)).alias("here"))
        turn = F.pmod(F.shiftright("rank", r // 2 % 8), F.lit(2)) == r % 2
        asks = best.where(F.col("best.votes") > F.col("here")).join(homes.where(turn).select("doc_id", "rank"), "doc_id").select("doc_id", "rank", F.col("shard").alias("from"), (-F.col("best.minus")).alias("to"), (F.col("best.votes") - F.col("here")).alias("gain"))
        moves = granted(asks, homes.groupBy("shard").agg(F.count("*").alias("size")), most, documents)
        homes = cut(homes.join(moves, "doc_id", "left").select("doc_id", "rank", F.coalesce("to", "shard").alias("shard")))
        if (r + 1) % EVERY == 0:
            release(homes.sparkSession)
    return homes.select("doc_id", "shard")
