"""The operators once more, slowly and plainly: one text, word or pair at a time, without numpy, hashes or Spark."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

BLANK = "[ \t\n\x0b\f\r]+"


def words(text, lower=False):
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(BLANK, text or "") if w]


# n-gram Jaccard


def gram_set(text, n):
    w = words(text, True)
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_pairs(rows, n, threshold):
    """rows: [(doc_id, text)], ids distinct. Pairs as join() has them: classes of equal sets by their least members."""
    sets = {i: gram_set(t, n) for i, t in rows if i is not None and t is not None}
    least, out = {}, {}
    for i in sorted(sets):
        if sets[i]:
            least.setdefault(frozenset(sets[i]), i)
    for i in sorted(sets):
        if sets[i] and least[frozenset(sets[i])] != i:
            out[least[frozenset(sets[i])], i] = (len(sets[i]), 1.0)
    heads = sorted(least.values())
    for x, a in enumerate(heads):
        for b in heads[x + 1 :]:
            both = len(sets[a] & sets[b])
            j = both / len(sets[a] | sets[b])
            if j >= threshold - 1e-12:
                out[a, b] = (both, round(j, 6))
    return out


def kept_of_near(rows, n, threshold):
    """The ids that stay if one of each linked group does."""
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in near_pairs(rows, n, threshold):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i for i, _ in rows if i is None or find(i) == i}


# repeated windows


def repeated_runs(rows, width):
    """(doc_id, start, end, copies, is_first) of rows [(doc_id, text)]."""
    places = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            w = words(t)
            for p in range(len(w) - width + 1):
                places[tuple(w[p : p + width])].add((i, p))
    marks = {}
    for spots in places.values():
        if len(spots) > 1:
            head = min(spots)
            for s in spots:
                marks.setdefault((s[0], s == head), {})[s[1]] = len(spots)
    out = set()
    for (i, first), at in marks.items():
        for p in sorted(at):
            if p - 1 not in at:
                q = p
                while q + 1 in at:
                    q += 1
                out.add((i, p, q + width, max(at[x] for x in range(p, q + 1)), first))
    return out


# prediction by partial matching


class Ppm:
    """The context trees as dictionaries."""

    def __init__(self, samples, order, alphabet, nodes):
        samples = {k: [small(t) for t in v] for k, v in samples.items()}
        total = Counter(b for v in samples.values() for t in v for b in t)
        self.symbol = {b: i + 1 for i, (b, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[: alphabet - 1])}
        self.order, self.alphabet, self.languages = order, alphabet, sorted(samples)
        self.counts = {k: defaultdict(Counter) for k in samples}
        seen = Counter()
        for lang, texts in samples.items():
            for t in texts:
                s = [0] * order + [self.symbol.get(b, 0) for b in t]
                for p in range(order, len(s)):
                    for k in range(order + 1):
                        context = tuple(s[p - k : p])
                        self.counts[lang][context][s[p]] += 1
                        seen[context] += k > 0
        number = lambda c: sum(x * alphabet ** (len(c) - 1 - i) for i, x in enumerate(c))
        kept = sorted((c for c in seen if c), key=lambda c: (-seen[c], len(c), number(c)))[: nodes - 1]
        self.kept = {c[i:] for c in kept for i in range(len(c) + 1)} | {()}

    def cost(self, lang, context, symbol):
        if not context and context not in self.counts[lang]:
            return math.log2(self.alphabet)
        below = (lambda: self.cost(lang, context[1:], symbol)) if context else (lambda: math.log2(self.alphabet))
        seen = self.counts[lang].get(context)
        if seen is None:
            return below()
        whole = sum(seen.values()) + len(seen)
        return -math.log2(seen[symbol] / whole) if symbol in seen else -math.log2(len(seen) / whole) + below()

    def bits(self, lang, text):
        s = [0] * self.order + [self.symbol.get(b, 0) for b in small(text)]
        total = 0.0
        for p in range(self.order, len(s)):
            k = 0
            while k < self.order and tuple(s[p - k - 1 : p]) in self.kept:
                k += 1
            total += self.cost(lang, tuple(s[p - k : p]), s[p]) + 8 * (s[p] == 0)
        return total


def small(data):
    text = data.decode("utf-8", "surrogateescape")
    return "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text).encode("utf-8", "surrogateescape")


# decontamination

TOKEN = re.compile(r"[0-9](?:[0-9]|[.,](?=[0-9]))*|[^\W\d_]+|[^\x00-\x7f]+")


def tokens(text, units):
    """[(literal or placeholder, what it stands for)]"""
    raw, end, was = [], 0, None
    for m in TOKEN.finditer(text):
        between = text[end : m.start()]
        raw.append([m.group(), between, not raw or any(c in "\n\r!.:?" for c in between)])
        end = m.end()
    kinds = []
    for k, (w, between, fresh) in enumerate(raw):
        if w[0].isdigit():
            kinds.append("#")
        elif k and kinds[-1] == "#" and w.lower() in units:
            kinds.append("u")
        elif not fresh and len(w) > 1 and w[0].isupper() and not w[1].isupper():
            kinds.append("n")
        else:
            kinds.append("")
    out = []
    for k, (w, between, fresh) in enumerate(raw):
        if kinds[k] == "n" and k and kinds[k - 1] == "n" and not between.strip(" \t\n\x0b\f\r"):
            out[-1] = ("<n>", out[-1][1] + between + w)
        else:
            out.append((f"<{kinds[k]}>", w) if kinds[k] else (w.lower(), None))
    return out


def leaks(docs, items, width, cover, units):
    """{(doc_id, item_id): (matched, kind)}"""
    out = {}
    shown = {i: tokens(t, units) for i, t in items if t}
    for d, t in docs:
        if not t:
            continue
        ours = tokens(t, units)
        for i, theirs in shown.items():
            diagonals = defaultdict(list)
            for p in range(len(ours) - width + 1):
                for q in range(len(theirs) - width + 1):
                    a, b = ours[p : p + width], theirs[q : q + width]
                    if [x for x, _ in a] == [x for x, _ in b] and 2 * sum(v is None for _, v in b) >= width:
                        diagonals[p - q].append((q, [(y, x) for (_, x), (_, y) in zip(a, b) if y is not None]))
            covered, changed = set(), False
            for hits in diagonals.values():
                pairs = {x for _, slots in hits for x in slots}
                if len({was for was, _ in pairs}) == len(pairs):
                    covered |= {x for q, _ in hits for x in range(q, q + width)}
                    changed |= any(a != b for a, b in pairs)
            if theirs and covered and len(covered) / len(theirs) >= cover:
                out[d, i] = (len(covered), "reparameterised" if changed else "verbatim")
    return out


# best fit


def best_fit_bins(sizes, capacity):
    """Bins that best fit by falling size takes."""
    gaps = []
    for s in sorted((x for x in sizes if x), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def check_packing(rows, docs, capacity):
    """Every word of every row in one bin, none over capacity, nothing overlapping. docs: [(doc_id, text)] with distinct ids."""
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["length"], r["piece"]))
        if r["length"]:
            bins[r["bin_id"]].append((r["place"], r["length"]))
        else:
            assert r["bin_id"] is None and r["place"] is None
    for i, t in docs:
        at = 0
        for k, (start, length, piece) in enumerate(sorted(spans[i])):
            assert start == at and piece == k
            at += length
        assert at == len(words(t)), (i, at)
    for spots in bins.values():
        at = 0
        for place, length in sorted(spots):
            assert place == at
            at += length
        assert at <= capacity
    return len(bins)
