"""Language identification by prediction by partial matching (PPM).

Texts are folded to small letters first. For each language a context tree of variable order (at most `order` bytes) is counted on a bounded sample of labelled rows and
then frozen. A byte after context c costs -log2 p, where method C estimates p: seen after c, n(byte|c) / (n(c) + d(c)) with
d(c) the distinct bytes seen after c; unseen, the escape d(c) / (n(c) + d(c)) times p after the next shorter context. Below
the empty context all symbols are equally likely. There are no exclusions, so that a cost depends on context and byte alone.
A symbol is one of the `alphabet - 1` commonest bytes of the sample, or "another byte", which then costs 8 bits more.

As statistics are frozen, every cost is a constant. The contexts of all languages are merged into one tree whose nodes
hold a cost for each symbol and language; a byte's node is found by walking back over the bytes before it. The walk is a
table lookup for all bytes of a batch at once, and the costs are summed per document and language. So the code length is
exact, for whole texts, at some tens of nanoseconds a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenloom.llm.textcodes import LOWER, pieces, string_buffers

#: Bounds of the training sample: rows and bytes for each language.
TRAIN_ROWS, TRAIN_BYTES = 300, 400_000
ORDER, ALPHABET, NODES = 4, 64, 8192
#: A text is rejected as of no known language if its letters take more than so many bits a byte in the best code. (Digits and
#: marks don't count here: a short text with a card number in it is still of its language.)
MOST_BITS = 7.0
SCHEMA = "doc_id bigint, pred_lang string, bits_per_byte double, letter_bits double, margin_bits double, n_bytes bigint, accepted boolean"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and Latin-1 made small, so that a text in capitals is still of its language."""
    out = LOWER[data]
    if len(out) > 1:
        second = out[1:]
        second[(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


@dataclass
class Model:
    """Frozen statistics. child: [2 * nodes, alphabet] walk table; node n + k means "stopped at k". cost: [nodes, alphabet, languages] bits."""

    languages: list[str]
    symbol: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    order: int
    most_bits: float


def _counts(coded: np.ndarray, order: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..order, the (k+1)-grams of the symbols, as one number each (oldest symbol first), and their counts. Symbol 0 pads the start."""
    padded = np.concatenate([np.zeros(order, np.int64), coded.astype(np.int64)])
    out = []
    for k in range(order + 1):
        key = np.zeros(len(coded), np.int64)
        for j in range(k, -1, -1):
            key = key * size + padded[order - j : order - j + len(coded)]
        out.append(np.unique(key, return_counts=True))
    return out


def train(samples: dict[str, list[bytes]], order: int = ORDER, alphabet: int = ALPHABET, nodes: int = NODES, most_bits: float = MOST_BITS) -> Model:
    """Context trees of the samples. Of the contexts, the `nodes` commonest of all languages are kept, each with all its suffixes. No samples: no languages."""
    samples = {k: [fold(np.frombuffer(t, np.uint8)).tobytes() for t in v] for k, v in samples.items()}
    languages = sorted(samples)
    total = np.zeros(256, np.int64)
    for texts in samples.values():
        total += np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    common = sorted((-n, b) for b, n in enumerate(total) if n)[: alphabet - 1]
    symbol = np.zeros(256, np.uint8)  # 0: another byte, and the padding
    for i, (_, b) in enumerate(common):
        symbol[b] = i + 1
    grams = []
    for lang in languages:
        parts = [_counts(symbol[np.frombuffer(t, np.uint8)], order, alphabet) for t in samples[lang] if t]
        merged = []
        for k in range(order + 1):
            keys = np.concatenate([p[k][0] for p in parts]) if parts else np.zeros(0, np.int64)
            n = np.concatenate([p[k][1] for p in parts]) if parts else np.zeros(0, np.int64)
            u, inv = np.unique(keys, return_inverse=True)
            merged.append((u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)))
        grams.append(merged)
    # contexts of length k: the (k+1)-grams without their last symbol
    seen: dict[tuple[int, int], int] = {}
    for merged in grams:
        for k in range(1, order + 1):
            context, inv = np.unique(merged[k][0] // alphabet, return_inverse=True)
            for c, n in zip(context.tolist(), np.bincount(inv, weights=merged[k][1]).astype(np.int64).tolist()):
                seen[k, c] = seen.get((k, c), 0) + n
    kept = {key for key, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: nodes - 1]}
    for k, c in list(kept):  # suffixes are at least as common; ties may have cut them
        while k > 1:
            k, c = k - 1, c % alphabet ** (k - 1)
            kept.add((k, c))
    order_of = [(0, 0), *sorted(kept)]
    index = {key: i for i, key in enumerate(order_of)}
    n = len(order_of)
    child = np.empty((2 * n, alphabet), np.int32)
    child[:n] = (np.arange(n) + n)[:, None]
    child[n:] = np.arange(n, 2 * n)[:, None]
    for (k, c), i in index.items():
        if k:  # its oldest symbol leads here from the suffix
            child[index[k - 1, c % alphabet ** (k - 1)], c // alphabet ** (k - 1)] = i
    cost = np.empty((n, alphabet, len(languages)), np.float32)
    for li, merged in enumerate(grams):
        by: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        for k in range(order + 1):
            for g, m in zip(merged[k][0].tolist(), merged[k][1].tolist()):
                key = (k, g // alphabet)
                if key in index:
                    symbols, numbers = by.setdefault(key, ([], []))
                    symbols.append(g % alphabet)
                    numbers.append(m)
        for (k, c), i in index.items():  # shorter contexts come first
            below = cost[index[k - 1, c % alphabet ** (k - 1)], :, li] if k else np.log2(np.full(alphabet, alphabet, np.float32))
            if (k, c) not in by:
                cost[i, :, li] = below
                continue
            symbols, numbers = by[k, c]
            whole, distinct = sum(numbers), len(numbers)
            row = below - np.log2(distinct / (whole + distinct))
            row[symbols] = -np.log2(np.array(numbers) / (whole + distinct))
            cost[i, :, li] = row
    cost[:, 0, :] += 8
    return Model(languages, symbol, child, cost, order, most_bits)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of every row in every language, [rows, languages]; the same for its letters alone; its letters (bytes of them)."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(model.languages)))
    of_letters, letters = out.copy(), np.zeros(rows, np.int64)
    if not len(data):
        return out, of_letters, letters
    s = model.symbol[fold(data)]
    back = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))  # bytes of the row before this one
    node = np.zeros(len(data), np.int32)
    flat, width = model.child.ravel(), model.child.shape[1]
    for j in range(1, model.order + 1):
        before = np.zeros(len(data), np.uint8)
        before[j:] = s[:-j]
        before[back < j] = 0
        node = flat[node * width + before]
    n = len(model.cost)
    node = np.where(node >= n, node - n, node)
    costs = model.cost.reshape(n * width, -1)[node * width + s]
    full = np.flatnonzero(np.diff(offsets) > 0)
    letter = LETTER[data]
    letters[full] = np.add.reduceat(letter.astype(np.int64), offsets[full])
    for li in range(out.shape[1]):
        one = costs[:, li].astype(np.float64)
        out[full, li] = np.add.reduceat(one, offsets[full])
        of_letters[full, li] = np.add.reduceat(one * letter, offsets[full])
    return out, of_letters, letters


def judge(model: Model, lengths: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray) -> dict[str, list]:
    """Columns of the result from code lengths. Ties go to the language first in the alphabet."""
    bits, of_letters, letters = lengths
    n, blank = len(sizes), letters == 0
    if not model.languages:
        return {"pred_lang": [None] * n, "bits_per_byte": [None] * n, "letter_bits": [None] * n, "margin_bits": [None] * n, "accepted": (~blank).tolist()}
    best = bits.argmin(1)
    ordered = np.sort(bits, 1)
    per = ordered[:, 0] / np.maximum(sizes, 1)
    margin = ordered[:, 1] - ordered[:, 0] if bits.shape[1] > 1 else np.zeros(n)
    spelt = of_letters[np.arange(n), best] / np.maximum(letters, 1)
    ok = ~blank & (spelt <= model.most_bits)
    return {
        "pred_lang": [model.languages[b] if not x else None for b, x in zip(best, blank)],
        "bits_per_byte": [None if x else round(float(p), 4) for p, x in zip(per, blank)],
        "letter_bits": [None if x else round(float(p), 4) for p, x in zip(spelt, blank)],
        "margin_bits": [None if x else round(float(m), 3) for m, x in zip(margin, blank)],
        "accepted": ok.tolist(),
    }


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> dict[str, list[bytes]]:
    """At most `rows` labelled texts and `most_bytes` bytes for each label: those whose ids hash lowest, so the choice is the same on every run.

    The ids that can be among them are found by a hash threshold from the count of rows, so that no large sort is needed.
    """
    named = docs.select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), F.col("text").alias("t"), F.xxhash64("doc_id").alias("h")).where("l is not null and t is not null and i is not null")
    sizes = {r["l"]: r["n"] for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    near = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, 2.0 * rows / n + 20 / n)
        near = near | ((F.col("l") == lang) & (F.col("h") <= int(-(2**63) + share * (2**64 - 1)) - (share == 1.0)) if share < 1 else (F.col("l") == lang))
    ranked = named.where(near).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))).where(F.col("r") <= rows)
    out: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    for r in ranked.select("l", "r", F.substring("t", 1, most_bytes).alias("t")).sort("l", "r").collect():
        if sum(map(len, out[r["l"]])) < most_bytes:
            out[r["l"]].append(r["t"].encode())
    return {k: v for k, v in out.items() if any(v)}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: its predicted language, bits a byte, bits by which the runner-up is worse, and whether it is accepted.

    Nulls and texts without a letter: no language, not accepted, but a row all the same. A null doc_id stays null. Repeated rows: a row each.
    Ties between languages: the first in the alphabet. Other columns, whatever their names, are ignored. Empty table: empty result.
    Without any trained language nothing but text without letters is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = string_buffers(part.column("text"))
                columns = judge(m, code_lengths(m, data, offsets), np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(columns["pred_lang"], pa.string()), pa.array(columns["bits_per_byte"], pa.float64()), pa.array(columns["letter_bits"], pa.float64()), pa.array(columns["margin_bits"], pa.float64()), pa.array(np.diff(offsets), pa.int64()), pa.array(columns["accepted"], pa.bool_())],
                    names=["doc_id", "pred_lang", "bits_per_byte", "letter_bits", "margin_bits", "n_bytes", "accepted"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scored, SCHEMA)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns; a null lang is filled in with the prediction if there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = string_buffers(part.column("text"))
                columns = judge(m, code_lengths(m, data, offsets), np.diff(offsets))
                arrays = [part.column(i) for i in range(part.num_columns)]
                if "lang" in names and part.column(at := names.index("lang")).null_count:
                    arrays[at] = pc.coalesce(part.column(at), pa.array(columns["pred_lang"], part.schema.field(at).type))
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(columns["accepted"], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
