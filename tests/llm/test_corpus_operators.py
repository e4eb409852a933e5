"""Joins, windows, packing, graphs and media: brute force or round trips, and the cases that a table may hold."""

from __future__ import annotations

import struct

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text_operators import clashing

from wrenloom.llm import bestfit, decontaminate, gif, hostgraph, ngramjoin, sharding, superkmer
from wrenloom.llm import queries as llm
from wrenloom.llm.common import table


def mutated(rng, w, share):
    out = list(w)
    for k in np.flatnonzero(rng.random(len(out)) < share):
        out[k] = f"w{int(rng.integers(400))}"
    return out


def corpus(seed, groups=14, spread=(0.0, 0.02, 0.06, 0.15)):
    """Texts in groups of copies, near and not so near, with a hot phrase in most of them."""
    rng = np.random.default_rng(seed)
    rows, hot = [], [f"hot{i}" for i in range(25)]
    for _ in range(groups):
        base = [f"w{int(x)}" for x in rng.integers(0, 400, int(rng.integers(3, 90)))]
        for _ in range(int(rng.integers(1, 6))):
            w = mutated(rng, base, float(rng.choice(spread)))
            if rng.random() < 0.4:
                w = w[: len(w) // 2] + hot + w[len(w) // 2 :]
            rows.append((len(rows), (" " if rng.random() < 0.8 else "\n").join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    order = rng.permutation(len(rows))
    return [(int(i), rows[i][1]) for i in order]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


ODD = [(None, "a b c d e f g h"), (900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "two  words"), (907, "two words"), (907, "two words"), (908, "q " * 40_000), (909, "q " * 40_000 + "r")]


@pytest.mark.parametrize("seed, n, threshold", [(1, 5, 0.35), (2, 3, 0.5), (3, 5, 0.8), (4, 2, 0.1)])
def test_near_pairs(spark, seed, n, threshold):
    rows = corpus(seed) + [r for r in ODD if r[0] != 907] + [(907, "two words")]
    df = clashing(spark, [(i, t, "en") for i, t in [*rows, (907, "two words")]])
    got = {(r["doc_a"], r["doc_b"]): (r["overlap"], r["jaccard"]) for r in ngramjoin.join(df, n, threshold).collect()}
    assert got == brute.near_pairs([r for r in rows if r[0] is not None], n, threshold)
    kept = ngramjoin.keep_one(df, n, threshold)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, brute.kept_of_near(rows, n, threshold)))


@pytest.mark.parametrize("seed, n, threshold, local, common, partitions", [(5, 5, 0.35, 2, 3, 4), (6, 2, 0.5, 1, 1, 4), (7, 3, 0.4, 32, 20_000, 4096), (8, 3, 0.4, 2, 2, 70_000)])
def test_common_grams_and_many_ranges(spark, monkeypatch, seed, n, threshold, local, common, partitions):
    """n-grams that go round the counting tasks, pairs sent on early, and ranges so many that rows and codes don't fit in 64 bits: the same pairs."""
    if partitions > 4:
        monkeypatch.setattr(ngramjoin, "fragments", lambda spark: partitions)
    rows = corpus(seed) + [r for r in ODD if r[0] != 907] + [(907, "two words")]
    got = {(r["doc_a"], r["doc_b"]): (r["overlap"], r["jaccard"]) for r in ngramjoin.join(frame(spark, [*rows, (907, "two words")]), n, threshold, local, common).collect()}
    assert got == brute.near_pairs([r for r in rows if r[0] is not None], n, threshold)


def test_many_short_rows(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "fragments", lambda spark: 4096)
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9_990).alias("text"))
    got = ngramjoin.linked(df).collect()
    assert {tuple(r) for r in got} == {(i + k, i, 2, 0) for i in range(10) for k in (0, 9_990)}


@pytest.mark.parametrize("seed, n, threshold", [(1, 5, 0.35), (2, 3, 0.5)])
def test_classes_and_links(spark, seed, n, threshold):
    rows = corpus(seed) + [r for r in ODD if r[0] != 907] + [(907, "two words")]
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in ngramjoin.linked(clashing(spark, [(i, t, "en") for i, t in [*rows, (907, "two words")]]), n, threshold).collect()}
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    sets = {i: frozenset(brute.gram_set(t, n)) for i, t in rows if brute.gram_set(t, n)}
    near = {(a, b) for a in set(sets.values()) for b in set(sets.values()) if len(a & b) >= (threshold - 1e-12) * len(a | b)}
    least = dict.fromkeys(sets)
    for i in sets:
        group = {sets[i]}
        while more := {b for a, b in near if a in group} - group:
            group |= more
        least[i] = min(j for j in sets if sets[j] in group)
    copies, links = {i: sum(s == sets[i] for s in sets.values()) for i in sets}, {i: sum(a == sets[i] != b for a, b in near) for i in sets}
    assert got == {i: (least[i], copies[i], links[i]) for i in sets if copies[i] > 1 or links[i]}


def crowded(seed, copies):
    """Two crowds of variants, some near each other and some not, that share lines with each other and with other texts."""
    rng = np.random.default_rng(seed)
    lines, rows = [[f"line{k}w{i}" for i in range(12)] for k in range(3)], []
    for base in range(2):
        words = [f"b{base}w{i}" for i in range(60)]
        rows += [mutated(rng, words, float(rng.choice([0.01, 0.05, 0.15]))) + lines[base] for _ in range(copies)]
    rows += [[f"x{k}w{i}" for i in range(int(rng.integers(1, 25)))] + lines[k % 3] + lines[(k + k // 3) % 3] for k in range(copies)]
    return [(int(i), " ".join(rows[i])) for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("hot, most_docs, tile", [(2, 1000, 1000), (3, 7, 3), (8, 1000, 5), (16, 10, 1000)])
def test_crowds_are_compared_whole(spark, hot, most_docs, tile):
    rows = crowded(hot, 30)
    near = brute.near_pairs(rows, ngramjoin.N, ngramjoin.THRESHOLD)
    df = frame(spark, rows)
    got = [((r["doc_a"], r["doc_b"]), (r["overlap"], r["jaccard"])) for r in ngramjoin.join(df, hot=hot, most_docs=most_docs, tile=tile).collect()]
    assert len(got) == len(dict(got)) and dict(got) == near
    sets = {i: frozenset(brute.gram_set(t, ngramjoin.N)) for i, t in rows}
    partners = {i: {sets[x + y - i] for x, y in near if i in (x, y)} for i in sets}  # near, if i is the least of its class
    links = {r["doc_id"]: r["links"] for r in ngramjoin.linked(df, hot=hot, most_docs=most_docs, tile=tile).collect()}
    assert links == {i: len({s for j in sets for s in partners[j] | {sets[j]} if j == min(k for k in sets if sets[k] == sets[i])} - {sets[i]}) for i in links}
    assert set(links) == {i for pair in near for i in pair}


def test_pairs_of_a_crowd_are_not_listed(spark):
    """400 variants of a text have some 80,000 near pairs; what passes between the tasks stays in proportion to the variants."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(mutated(rng, words, 0.03))) for i in range(400)]
    df = frame(spark, rows)
    possible, links = ngramjoin.candidates(ngramjoin.sets(df))
    pairs = sum(len(ngramjoin.unpack(r["others"], "i8", "u4")[0]) for r in possible.collect())
    assert pairs < 400 * ngramjoin.HOT and 399 <= links.count() < 400 * 4
    sets = {i: frozenset(brute.gram_set(t, ngramjoin.N)) for i, t in rows}
    near = {s: sum(len(s & o) >= (ngramjoin.THRESHOLD - 1e-12) * len(s | o) for o in set(sets.values()) - {s}) for s in set(sets.values())}
    assert sum(near.values()) > 100_000
    assert {(r["doc_id"], r["class_id"], r["links"]) for r in ngramjoin.linked(df).collect()} == {(i, 0, near[s]) for i, s in sets.items()}


def test_contained_texts_are_near(spark):
    """Each pair is a text and the same text with words after it, shared with nobody else, down to the threshold."""
    rows = []
    for k, (small, large) in enumerate([(100, 101), (100, 150), (100, 179), (100, 200), (100, 250), (100, 285), (100, 286), (35, 100), (7, 20)]):
        w = [f"p{k}w{i}" for i in range(large + 4)]
        rows += [(2 * k, " ".join(w[: small + 4])), (2 * k + 1, " ".join(w))]
    got = {(r["doc_a"], r["doc_b"]): (r["overlap"], r["jaccard"]) for r in ngramjoin.join(frame(spark, rows)).collect()}
    assert got == brute.near_pairs(rows, ngramjoin.N, ngramjoin.THRESHOLD)
    assert got[6, 7] == (100, 0.5) and len(got) == 8


def test_near_pairs_of_nothing(spark):
    for rows in ([], [(None, "a b c")], [(1, None), (2, "")]):
        df = frame(spark, rows)
        assert ngramjoin.join(df).count() == 0
        assert ngramjoin.keep_one(df).count() == len(rows)


def test_rows_that_share_an_id(spark):
    df = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z x y z"), (2, "other text that is here")])
    assert ngramjoin.join(df).count() == 0
    assert sorted((r["doc_id"], r["text"]) for r in ngramjoin.keep_one(df).collect()) == [(1, "a b c d e f"), (2, "other text that is here")]


def test_chains_are_one_group(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "doc_a bigint, doc_b bigint")
    got = {r["doc_id"]: r["least"] for r in ngramjoin.components(pairs).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert ngramjoin.components(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("seed, width, kmer", [(1, 50, 8), (2, 12, 4), (3, 5, 5), (4, 6, 1)])
def test_repeated_runs(spark, seed, width, kmer):
    rows = corpus(seed) + ODD
    df = clashing(spark, [(i, t, "en") for i, t in rows])
    got = superkmer.repeats(df, width, kmer).collect()
    assert len(set(map(tuple, got))) == len(got)
    assert set(map(tuple, got)) == brute.repeated_runs(list(dict.fromkeys(rows)), width)


@pytest.mark.parametrize("seed, bucket, hot, places", [(1, 3000, 2000, 3), (5, 500, 1, 1), (6, 100_000, 20_000, 100)])
def test_crowded_buckets(spark, seed, bucket, hot, places):
    """Windows of buckets over `hot` bytes are counted one by one; the result is the same."""
    rows = corpus(seed) + ODD
    got = superkmer.repeats(clashing(spark, [(i, t, "en") for i, t in rows]), 12, 4, bucket, hot, places).collect()
    assert len(set(map(tuple, got))) == len(got)
    assert set(map(tuple, got)) == brute.repeated_runs(list(dict.fromkeys(rows)), 12)


def test_repeats_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, ""), (2, "short")]):
        assert superkmer.repeats(frame(spark, rows)).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is the same for all windows, texts alone decide."""
    monkeypatch.setattr(superkmer, "_rolling", lambda code, width: np.zeros(max(0, len(code) - width + 1), np.uint64))
    text = np.frombuffer(b"a b c d a b", np.uint8)
    cell = superkmer.pack(np.array([7], np.int64), np.array([0], np.uint32), np.array([5], np.uint32), np.array([len(text)], np.uint32), text)
    got = superkmer.repeated_windows([cell], 2).to_pylist()
    assert [(r["at"], r["n"], r["copies"], r["first"]) for r in got] == [(0, 1, 2, True), (4, 1, 2, False)]


# decontamination

NAMES, UNITS = ["Tom", "Ann", "Maria", "Zoë"], ["km", "kg", "hours"]


def item(rng, words=18):
    out = []
    for k in range(words):
        r = rng.random()
        out.append(f"{int(rng.integers(1, 99))} {rng.choice(UNITS)}" if r < 0.08 else str(int(rng.integers(1, 999))) if r < 0.13 else str(rng.choice(NAMES)) if r < 0.24 else f"t{chr(97 + int(rng.integers(26)))}{chr(97 + int(rng.integers(26)))}" if r < 0.95 else "end.")
    return " ".join(out)


def leaky(seed):
    rng = np.random.default_rng(seed)
    items = [(i, item(rng)) for i in range(12)] + [(20, None), (21, ""), (22, "too short"), (None, item(rng))]
    docs = []
    for d in range(60):
        filler, (_, text) = item(rng, 12), items[int(rng.integers(12))]
        kind = d % 6
        if kind == 0:
            text = item(rng)
        if kind == 2:
            for a, b in zip(NAMES, ["Bob", "Eve", "Noah", "Élodie"]):
                text = text.replace(a, b)
        if kind == 3:
            text = " ".join(str(int(rng.integers(1, 99))) if w.isdigit() else w for w in text.split())
        if kind == 4:
            text = " ".join(text.split()[: len(text.split()) // 2 + int(rng.integers(-2, 3))])
        if kind == 5:
            text = text.upper() if rng.random() < 0.5 else text.replace(" ", "\n  ")
        docs.append((d, f"{filler} {text} {filler}"))
    return docs, items


@pytest.mark.parametrize("seed, width, cover", [(1, 6, 0.5), (2, 6, 0.5), (3, 4, 0.3), (4, 8, 0.9)])
@pytest.mark.parametrize("filtered", [True, False])
def test_leaks(spark, monkeypatch, seed, width, cover, filtered):
    if not filtered:
        monkeypatch.setattr(decontaminate, "FILTER_WINDOWS", -1)
    docs, items = leaky(seed)
    extra = [(None, "nothing at all here"), (70, None), (71, "")]
    bench = spark.createDataFrame([(*x, "k", 1) for x in items], "item_id bigint, text string, key string, tokens int")
    df = clashing(spark, [(i, t, "en") for i, t in docs + extra + docs[:3]])
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["kind"]) for r in decontaminate.contaminated(df, bench, width, cover).collect()}
    want = brute.leaks(docs, items, width, cover, set(decontaminate.UNITS))
    assert got == want
    assert {k for _, k in want.values()} == {"verbatim", "reparameterised"} or seed in (3, 4)
    kept = decontaminate.keep_clean(df, bench, width, cover)
    assert kept.columns == df.columns
    bad = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs + extra + docs[:3] if i not in bad)


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "yesterday Tom had 3 apples and then Tom ate 3 of them with bread")], "item_id bigint, text string")
    rows = [(1, "yesterday Ann had 5 apples and then Ann ate 5 of them with bread"), (2, "yesterday Ann had 5 apples and then Bob ate 5 of them with bread"), (3, "yesterday Tom had 3 apples and then Tom ate 3 of them with bread")]
    got = {r["doc_id"]: r["kind"] for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {1: "reparameterised", 3: "verbatim"}


def test_leaks_of_nothing(spark):
    docs, items = frame(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.keep_clean(frame(spark, [(1, "a b c")]), items).count() == 1
    assert decontaminate.keep_clean(docs, items).count() == 0


def test_leaks_in_the_documents(spark, small):
    from wrenloom.llm.common import table

    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["kind"]) for r in decontaminate.contaminated(docs, bench).collect()}
    plain = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"]) < 4000]
    want = brute.leaks(plain, [tuple(r) for r in bench.select("item_id", "text").collect()], decontaminate.WIDTH, decontaminate.COVER, set(decontaminate.UNITS))
    ids = {d for d, _ in plain}
    assert {k: v for k, v in got.items() if k[0] in ids} == want and want


# packing


@pytest.mark.parametrize("capacity, count", [(64, 400), (10, 200), (1, 20), (2048, 60)])
def test_packing(spark, capacity, count):
    rng = np.random.default_rng(capacity)
    docs = [(i, "w " * int(x)) for i, x in enumerate(rng.choice([*range(0, 2 * capacity + 2), *[max(1, capacity // 2)] * capacity], count))]
    rows = bestfit.pack(frame(spark, docs).repartition(3), capacity).collect()
    bins = brute.check_packing(rows, docs, capacity)
    sizes = [x for _, t in docs for n in [len(brute.words(t))] for x in [capacity] * (n // capacity) + [n % capacity]]
    assert bins <= brute.best_fit_bins(sizes, capacity) * 1.05 + 2


def test_packing_cases(spark):
    df = clashing(spark, [(1, "a b c", "en"), (2, None, "en"), (3, "", "en"), (None, "x y", None), (1, "a b c", "en"), (6, "z " * 50_000, "en")])
    rows = bestfit.pack(df, 100).collect()
    assert sum(r["length"] for r in rows) == 3 + 2 + 3 + 50_000
    assert sorted((r["doc_id"], r["bin_id"]) for r in rows if not r["length"]) == [(2, None), (3, None)]
    assert sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 1 for r in rows) == 2
    assert 501 <= len({r["bin_id"] for r in rows if r["length"]}) <= 500 + df.rdd.getNumPartitions()  # a class opens bins partition by partition
    assert bestfit.pack(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        bestfit.pack(df, 0)


def test_items_of_a_class_share_bins_by_best_fit(spark):
    """Two sizes of one class in many partitions: 700 + 700 + 600 fits, and next fit takes a bin for each two or three of a size."""
    docs = [(i, "w " * (700 if i % 2 else 600)) for i in range(600)]
    rows = bestfit.pack(frame(spark, docs).repartition(4)).collect()
    assert brute.check_packing(rows, docs, 2048) == brute.best_fit_bins([700, 600] * 300, 2048) == 200


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 90))
def test_best_fit_by_counts_is_best_fit(sizes, capacity):
    counts = {s: sizes.count(s) for s in sizes}
    rows, bins = sorted(bestfit.best_fit(counts, capacity)), {}
    for s, n in counts.items():
        mine = [r for r in rows if r[0] == s]
        for k in range(n):
            _, first, low, per, place = [r for r in mine if r[1] <= k][-1]
            bins.setdefault(low + (k - first) // per, []).append((place + (k - first) % per * s, s))
    for spots in bins.values():
        at = 0
        for place, s in sorted(spots):
            assert place == at
            at += s
        assert at <= capacity
    assert sorted(bins) == list(range(brute.best_fit_bins(sizes, capacity)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=8))
def test_sweep_across_partitions_is_one_stack(left):
    """left[p]: items and slots left over, slots first in sweep order, as the module says."""
    got = {}
    for slots_part, a, b, items_part, first in bestfit.across({p: list(x) for p, x in enumerate(left)}):
        for k in range(b - a):
            got[slots_part, a + k] = (items_part, first + k)
    stack, want = [], {}
    for p, (items, slots) in enumerate(left):
        for r in range(slots):
            if stack:
                want[p, r] = stack.pop()
        stack += [(p, r) for r in reversed(range(items))]
    assert got == want


# hosts


def test_ranks(spark):
    html = lambda *hosts: " ".join(f"<a href='//{h}/x'>" for h in hosts)
    rows = [("http://good.org/1", html("a.org", "b.org", "good.org")), ("http://a.org/1", html("b.org", "bad.com")), ("https://user@B.org:80/", html("good.org")), ("http://farm.net/", html("bad.com", "bad.com")), ("/nohost", html("a.org")), (None, html("b.org")), ("http://alone.org", None), ("http://a.org/2", ""), ("http://a.org/2", "")]
    pages = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "url string, html string, host string, trust double")
    got = {r["host"]: r for r in hostgraph.judge(pages, ["good.org"], ["bad.com"], 12).collect()}
    edges = {("good.org", "a.org"): 1, ("good.org", "b.org"): 1, ("a.org", "b.org"): 1, ("a.org", "bad.com"): 1, ("b.org", "good.org"): 1, ("farm.net", "bad.com"): 2}
    hosts = sorted({h for e in edges for h in e} | {"alone.org"})
    assert set(got) == set(hosts) and {h: got[h]["pages"] for h in hosts} == {"a.org": 3, "alone.org": 1, "b.org": 1, "bad.com": 0, "farm.net": 1, "good.org": 1}

    def walk(pairs, seed):
        rank = {h: float(h == seed) for h in hosts}
        for _ in range(12):
            new = {h: 0.15 * (h == seed) for h in hosts}
            for h in hosts:
                out = {b: w for (a, b), w in pairs.items() if a == h}
                for b, w in out.items():
                    new[b] += 0.85 * rank[h] * w / sum(out.values())
                if not out:
                    new[seed] += 0.85 * rank[h]
            rank = new
        return rank

    trust, distrust = walk(edges, "good.org"), walk({(b, a): w for (a, b), w in edges.items()}, "bad.com")
    for h in hosts:
        assert got[h]["trust"] == pytest.approx(trust[h] * len(hosts), abs=2e-6) and got[h]["distrust"] == pytest.approx(distrust[h] * len(hosts), abs=2e-6)
        blocked = h == "bad.com" or round(distrust[h] * len(hosts), 6) >= 1
        assert got[h]["verdict"] == ("blocked" if blocked else "trusted" if round(trust[h] * len(hosts), 6) >= 1 else "unknown")
    assert got["bad.com"]["verdict"] == "blocked" and got["alone.org"]["verdict"] == "unknown"


def test_shared_targets_make_edges(spark):
    html = lambda *paths: " ".join(f'<a href="{p}">' for p in paths)
    rows = [("http://a.org/1", html("/x", "/x", "/y")), ("http://b.org/1", html("/x", "/y", "//c.org/z", "")), ("http://c.org/", html("/x", "/only", "/only")), ("/nohost", html("/x") * 9), ("http://d.org", None)]
    pages = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "page_id bigint, url string, html string, w int")
    got = {(r["src"], r["dst"]): r["w"] for r in hostgraph.target_edges(pages).collect()}
    assert got == {("b.org", "a.org"): 2, ("c.org", "a.org"): 1}
    out = {r["page_id"]: (r["host"], r["verdict"]) for r in hostgraph.filtered(pages, ["b.org"], ["a.org"], hostgraph.target_edges(pages)).collect()}
    assert out == {0: ("a.org", "blocked"), 1: ("b.org", "blocked"), 2: ("c.org", "unknown"), 3: (None, "unknown"), 4: ("d.org", "unknown")}
    assert hostgraph.filtered(pages.limit(0), ["b.org"], []).count() == 0


def test_the_pages_have_edges(spark):
    """The registered query passes ranks on: hosts that are no seeds have both kinds of score."""
    small = "/root/testdata/sf0.01"
    pages = table(spark, small, "pages")
    assert hostgraph.target_edges(pages).count() > 20
    rows = llm.queries()["op2_url_filter"](spark, small).collect()
    assert len(rows) == pages.count()
    seeds = tuple(llm.TRUSTED + llm.BLOCKED)
    assert any(r["trust"] > 0 and not r["host"].endswith(seeds) for r in rows) and any(r["distrust"] > 0 and not r["host"].endswith(seeds) for r in rows)


def test_ranks_of_nothing(spark):
    pages = spark.createDataFrame([("http://a.org", "x" * 1_000_000)], "url string, html string")
    assert hostgraph.judge(pages.limit(0)).count() == 0
    assert [tuple(r) for r in hostgraph.judge(pages).collect()] == [("a.org", 1, 0.0, 0.0, "unknown")]


# sharding


def line_links(docs, least=sharding.LEAST_LINE):
    """{(a, b): lines that both have}, a < b, by brute force."""
    lines = {}
    for i, text in docs:
        if i is not None:
            lines.setdefault(i, set()).update(x for x in (text or "").split("\n") if len(x) >= least)
    ids = sorted(lines)
    return {(a, b): w for k, a in enumerate(ids) for b in ids[k + 1 :] if (w := len(lines[a] & lines[b]))}


def cut_share(links, shard):
    """Of the links' weight, what joins different shards."""
    return sum(w for (a, b), w in links.items() if shard[a] != shard[b]) / sum(links.values())


def topics(ids, size, seed=3):
    """Documents of topics with `size` documents each, and lines of few kinds in a topic."""
    rng = np.random.default_rng(seed)
    return [(int(i), "\n".join(f"a line of topic {k // size} number {int(x)}" for x in rng.integers(0, 3, 3))) for k, i in enumerate(ids)]


@pytest.mark.parametrize("salt", [sharding.SALT, 3])
def test_sharding_keeps_quotas_and_cuts_less(spark, salt):
    docs = topics(range(200), 12)
    odd = [(5, docs[5][1]), (None, "a line of topic 1 number 1"), (500, None), (501, ""), (502, "x" * 300_000)]
    got = sharding.assign(clashing(spark, [(i, t, "en") for i, t in docs + odd]), 4, 8, 0.1, salt=salt)
    shard = {r["doc_id"]: r["shard"] for r in got.collect()}
    assert got.count() == len(shard) == 203
    assert np.bincount(list(shard.values()), minlength=4).max() <= sharding.capacity_of(203, 4, 0.1)
    links = line_links(docs)
    start = {r["doc_id"]: r["rank"] % 4 for r in sharding.ranked(got.select("doc_id")).collect()}
    assert cut_share(links, start) > 0.7 and cut_share(links, shard) < 0.5 * cut_share(links, start)
    assert all(shard[i] == start[i] for i in (500, 501, 502))


def test_ids_that_are_multiples_of_the_shards(spark):
    """2,000 linked documents with ids 16k: sizes keep to the capacity from the start."""
    docs = topics([16 * k for k in range(2000)], 200)
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(frame(spark, docs), rounds=2).collect()}
    sizes = np.bincount(list(got.values()), minlength=16)
    assert len(got) == 2000 and sizes.max() <= sharding.capacity_of(2000, 16, sharding.SLACK) and sizes.min() > 0
    start = {r["doc_id"]: r["rank"] % 16 for r in sharding.ranked(frame(spark, docs)).collect()}
    assert cut_share(links := line_links(docs), got) < cut_share(links, start)


def test_votes_are_links(spark):
    """How many links lead where, against all pairs."""
    rng = np.random.default_rng(1)
    docs = topics(range(60), 7)
    shard = {i: int(rng.integers(4)) for i, _ in docs}
    homes = spark.createDataFrame([(i, s) for i, s in shard.items()], "doc_id bigint, shard int")
    want = {}
    for (a, b), w in line_links(docs).items():
        for x, y in ((a, b), (b, a)):
            want[x, shard[x], shard[y]] = want.get((x, shard[x], shard[y]), 0) + w
    lines = sharding.shared_lines(frame(spark, docs)).selectExpr("line", "doc_id", "2 as salts", "int(doc_id % 2) as salt")
    assert {tuple(r)[:3]: r["votes"] for r in sharding.votes(lines, homes).collect()} == want


def test_quotas(spark):
    """Swaps, then room by the number of the source; the greatest gains first, then the least ranks."""
    asks = [(i, i, 0, 1, 5 - i % 2) for i in range(10)] + [(20 + i, 20 + i, 1, 0, 1) for i in range(3)] + [(40 + i, 40 + i, 2, 1, 9) for i in range(4)]
    sizes = spark.createDataFrame([(0, 50), (1, 48), (2, 10)], "shard int, size bigint")
    got = sharding.granted(spark.createDataFrame(asks, "doc_id bigint, rank bigint, from int, to int, gain bigint"), sizes, 57, 64).collect()
    assert sorted(map(tuple, got)) == sorted([(i, 1) for i in range(10)] + [(20 + i, 0) for i in range(3)] + [(40, 1), (41, 1)])
    got = sharding.granted(spark.createDataFrame(asks, "doc_id bigint, rank bigint, from int, to int, gain bigint"), sizes, 50, 64).collect()
    assert sorted(map(tuple, got)) == sorted([(i, 1) for i in (0, 2, 4, 6, 8)] + [(20 + i, 0) for i in range(3)])


def test_sharding_of_nothing(spark):
    assert sharding.assign(frame(spark, []), rounds=1).count() == 0
    assert sharding.assign(frame(spark, [(None, "x")]), rounds=1).count() == 0
    assert sorted(r["shard"] for r in sharding.assign(frame(spark, [(-1, "x"), (17, "y")]), rounds=1).collect()) == [0, 1]


# media


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.binary(max_size=3000))
def test_lzw_round_trip(least, data):
    data = bytes(b % (1 << least) for b in data)
    assert gif.lzw_decode(gif.lzw_encode(data, least), least, len(data)).tobytes() == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data, 8), 8, len(data)).tobytes() == data


def test_known_bytes():
    """A picture of ten by ten pixels as published in explanations of the format: rows of 1 and 2 around a block of 0."""
    head = b"GIF89a" + struct.pack("<HHBBB", 10, 10, 0x91, 0, 0) + bytes([255, 255, 255, 255, 0, 0, 0, 0, 255, 0, 0, 0])
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    data = head + b"\x2c" + struct.pack("<HHHHB", 0, 0, 10, 10, 0) + b"\x02" + bytes([len(stream)]) + stream + b"\x00\x3b"
    (frame,) = gif.decode(data)
    red, blue = (255, 0, 0, 255), (0, 0, 255, 255)
    assert tuple(frame.rgba[0, 0]) == red and tuple(frame.rgba[0, 9]) == blue and tuple(frame.rgba[9, 0]) == blue and tuple(frame.rgba[9, 9]) == red
    assert (frame.rgba[4:6, 4:6] == 255).all() and gif.histogram(frame.rgba).tolist() == [0, 0, 0, 36] + [0] * 44 + [48] + [0] * 14 + [16] or gif.histogram(frame.rgba).sum() == 100


PALETTE = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 9), st.integers(1, 9), st.integers(0, 3), st.sampled_from([None, 0, 2]), st.booleans(), st.integers(0, 50), st.booleans()), min_size=1, max_size=5), st.integers(0, 1000))
def test_composition(width, height, images, seed):
    rng = np.random.default_rng(seed)
    made = [gif.Image(rng.integers(0, 4, (h, w)).astype(np.uint8), x, y, delay * 10, disposal, clear, inter, PALETTE[::-1] if own else None) for x, y, w, h, disposal, clear, inter, delay, own in images]
    got = gif.decode(gif.encode(width, height, PALETTE, made))
    screen, clock = {}, 0
    assert len(got) == len(made)
    for im, f in zip(made, got):
        before = dict(screen)
        colours = PALETTE if im.palette is None else im.palette
        spots = [(im.top + r, im.left + c) for r in range(im.indices.shape[0]) for c in range(im.indices.shape[1])]
        for r, c in spots:
            v = int(im.indices[r - im.top, c - im.left])
            if r < height and c < width and v != im.clear_index:
                screen[r, c] = tuple(int(x) for x in colours[v])
        assert (f.start_ms, f.delay_ms) == (clock, im.delay_ms)
        clock += im.delay_ms
        for r in range(height):
            for c in range(width):
                assert tuple(f.rgba[r, c]) == ((*screen[r, c], 255) if (r, c) in screen else (0, 0, 0, 0))
        if im.disposal == 2:
            for s in spots:
                screen.pop(s, None)
        elif im.disposal == 3:
            screen = before


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 255), st.integers(0, 200))
def test_broken_bytes_are_said_to_be(at, value, cut):
    good = gif.encode(8, 8, gif.PALETTE, [gif.Image(np.arange(64, dtype=np.uint8).reshape(8, 8) % 16, delay_ms=10)])
    bad = bytearray(good)
    bad[at % len(bad)] = value
    for data in (bytes(bad), good[:cut]):
        try:
            gif.decode(data)
        except gif.BadGif:
            pass


def test_frames_before_a_fault_stay(spark):
    """A GIF cut off within its second image, or before its trailer, keeps what was decoded."""
    images = [gif.Image(np.full((4, 4), k, np.uint8), delay_ms=10) for k in range(2)]
    whole = gif.encode(4, 4, gif.PALETTE, images)
    df = spark.createDataFrame([(1, whole[:-1]), (2, whole[:-4]), (3, whole)], "id bigint, gif binary")
    got = {(r["id"], r["frame"]): r["error"] for r in gif.frames(df).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, None): "no trailer", (2, 0): None, (2, None): "it ends within a block", (3, 0): None, (3, 1): None}


def test_media_cases(spark):
    good = gif.encode(2, 2, PALETTE, [gif.Image(np.array([[1, 2], [3, 0]], np.uint8), delay_ms=30)] * 2)
    none = gif.encode(2, 2, PALETTE, [])
    big = gif.encode(700, 700, PALETTE, [gif.Image(np.ones((700, 700), np.uint8))])
    media = spark.createDataFrame([(1, good, "f", 1), (1, good, "f", 1), (2, None, "f", 1), (3, b"", "f", 1), (4, b"GIF89a", "f", 1), (None, good, "f", 1), (5, none, "f", 1), (6, big, "f", 1)], "id bigint, gif binary, frame string, error int")
    rows = gif.frames(media).collect()
    assert sorted((str(r["id"]), str(r["frame"]), r["error"] is None) for r in rows) == sorted([("1", "0", True), ("1", "1", True)] * 2 + [("3", "None", False), ("4", "None", False), ("None", "0", True), ("None", "1", True), ("6", "0", True)])
    second = next(r for r in rows if r["id"] == 1 and r["frame"] == 1)
    assert (second["start_ms"], second["delay_ms"], second["width"], second["opaque"], sum(second["hist"])) == (30, 30, 2, 4, 4)
    assert gif.frames(media.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [0.1]), (4, [None] * 64), (None, [9.0, -9.0] * 32)], "vec_id bigint, embedding array<float>")
    assert {r["id"]: r["gif"] is None for r in gif.vector_media(vectors).collect()} == {1: False, 2: True, 3: True, 4: True, None: False}
