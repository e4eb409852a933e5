"""Personal data by a linear-chain conditional random field over word shapes.

Words (runs between ASCII blanks) get tags O, B-x and I-x for x among the KINDS. A word's features are shapes only: letters become x (capitals X),
digits d, with lengths of digit runs kept and letter runs collapsed, after marks at either end are stripped; also length and
digit-count buckets, marks inside, keywords, and the shapes of both neighbours. Weights are fitted to a small labelled table
(labelled_table()) by gradient ascent on the conditional likelihood.

Decoding is exact Viterbi, in numpy batches, but only where it can matter. Words without digits, "@" or other unusual shapes are
*plain*: for every tag but O their score is lower by at least some delta, whatever their plain neighbours. Let D be the most
that transitions could gain; then no best path has a tag other than O on more than D / delta plain words in a row, nor inside a
run of plain words alone. So a text falls into islands around its other words, with that many plain words on either side, whose
first and last words are O. reach() computes the bound from the weights and fails if there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN")
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
SEED, SENTENCES, EPOCHS, STEP, RIDGE = 11, 450, 160, 0.25, 2e-4
#: Words whose features a worker remembers; cells (words, with padding) of the chains that are decoded at once. Both bound memory, not results.
REMEMBERED, CELLS = 8_192, 100_000
_EDGE = "\"'`()[]{}<>#$%&*!?,.;:|~^\\/"
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_RUNS = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|.", re.S)
_NUMBERED, _DIGITS, _LETTERS = re.compile("[0-9@]"), re.compile("[0-9]"), re.compile("[A-Za-z0-9\u0080-\U0010ffff]")
_KEYWORDS = {"token", "secret", "password", "passwd", "apikey", "api_key", "key", "auth"}
SCHEMA = "doc_id bigint, text string, found array<struct<kind:string,start:int,end:int>>"
Span = tuple[str, int, int]


def core(word: str) -> tuple[int, int]:
    """The part of a word that remains without the marks at its ends; a "+" or "(" that starts a number stays out or in as it is."""
    a, b = 0, len(word)
    while a < b and word[a] in _EDGE:
        a += 1
    while b > a and word[b - 1] in _EDGE:
        b -= 1
    return (a, b) if a < b else (0, len(word))


@lru_cache(REMEMBERED)
def shape(word: str) -> tuple[str, ...]:
    """Features of a word by itself."""
    a, b = core(word)
    w = word[a:b]
    if not _NUMBERED.search(w):
        if w.lower() in _KEYWORDS:
            return ("keyword",)
        if not _LETTERS.search(w):
            return ("mark=" + ("=" if "=" in w else ":" if ":" in word else "other"),)
        return ("plain",)
    runs = _RUNS.findall(w)
    parts = [f"d{len(r)}" if _DIGITS.match(r) else "x" if _LETTERS.match(r) else r for r in runs]
    digits = len(_DIGITS.findall(w))
    hexed = all(c in "0123456789abcdefABCDEF" for c in w)
    key = "hex" if hexed and any(c.isalpha() for c in w) and len(w) >= 16 else "".join(parts)
    octets = len(parts) == 7 and parts[1::2] == ["."] * 3 and all(re.fullmatch(r"d[123]", p) for p in parts[::2])
    out = ["shape=" + (key if len(parts) <= 8 or key == "hex" else "long"), f"digits={min(digits, 20)}", f"size={min(len(w), 48) // 8}"]
    out += [name for name, yes in (("at", re.search(r"[^@]@[^@]+\.[A-Za-z]", w)), ("octets", octets), ("hex", key == "hex"), ("parens", word.startswith("(")), ("plus", w.startswith("+")), ("equals", "=" in w), ("mixed", any(c.isalpha() for c in w) and key != "hex"), ("digits", digits == len(w)), ("dashed", re.fullmatch(r"[0-9]+(-[0-9]+)+", w)), ("quoted", word.startswith('"') and key == "hex")) if yes]
    return tuple(out)


@lru_cache(REMEMBERED)
def brief(word: str) -> str:
    """What a word's neighbours see of it."""
    s = shape(word)
    return s[0] if s[0] in ("plain", "keyword") or s[0].startswith("mark") else "octets" if "octets" in s else "at" if "at" in s else "hex" if "hex" in s else s[0] if len(s[0]) < 18 else "long"


def is_plain(word: str) -> bool:
    return shape(word)[0] == "plain"


def labelled_table(seed: int = SEED, sentences: int = SENTENCES) -> list[tuple[list[str], list[str]]]:
    """The labelled table: invented sentences (words, tags) with personal data among plain words, numbers that are none, and marks."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    syllables = "an er th in on re ti es or en ion ver sch der que la mi ción eau ent ó ñu über".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    hexed = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    tails = ["", "", "", "", ".", ",", "!!", "###", "$$$", "%%%", "&&&", "***", ";", ")"]

    def plain() -> str:
        w = word()
        return pick([w, w, w.capitalize(), w.upper()]) + pick(tails)

    def data() -> tuple[list[str], str]:
        kind = pick(list(KINDS))
        if kind == "EMAIL":
            local = pick([f"{word()}.{num(2)}", word(), f"{word()}.{word()}", f"{word()}_{num(3)}", f"{word()}+{word()}", f"{num(2)}", f"{word()}{num(1)}"])
            host = pick([f"mail{num(1)}.example.com", f"{word()}.org", f"{word()}.example.net", f"{word()}-{word()}.co.uk"])
            w = [f"{local}@{host}"]
        elif kind == "PHONE":
            a, b, c = num(3), num(3), num(4)
            w = pick([["+1", f"({a})", f"{b}-{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+1-{a}-{b}-{c}"], ["+" + num(2), num(3), num(4), num(4)], [f"+{num(11)}"], [f"{a}.{b}.{c}"]])
        elif kind == "IP":
            w = [".".join(str(int(x)) for x in rng.integers(0, 256, 4))]
        elif kind == "CARD":
            w = pick([[num(16)], [num(16)], [num(4) for _ in range(4)], ["-".join(num(4) for _ in range(4))], [num(15)]])
        elif kind == "SSN":
            w = [f"{num(3)}-{num(2)}-{num(4)}"]
        else:
            key, h = pick(["token", "token", "secret", "password", "api_key", "key"]), hexed(pick([40, 40, 32, 64]))
            h = h if any(c.isalpha() for c in h) else "a" + h[1:]
            w = pick([[key, "=", f'"{h}"'], [key, "=", f'"{h}"'], [f'{key}="{h}"'], [f"{key}:", h], [key, "=", h]])
            if rng.random() < 0.1:
                w = [x.upper() for x in w]
        return w, kind

    def other() -> str:  # numbers that aren't personal
        return pick([num(1), num(2), num(3), num(4), num(4), num(5), num(6), f"{num(1)}.{num(1)}", f"{num(2)}.{num(2)}", f"{num(1)},{num(3)}", f"{num(2)}%", f"{num(1)}st", f"v{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{word()}{num(2)}", f"#{num(3)}", f"{num(2)}/{num(2)}/20{num(2)}"]) + pick(["", "", ".", ","])

    out = []
    for _ in range(sentences):
        words: list[str] = []
        tags: list[str] = []
        glue = pick(["", "", "", "!!", "###", "$$$", "%%%", "&&&", "***"])
        for _ in range(int(rng.integers(2, 6))):
            for _ in range(int(rng.integers(0, 4))):
                words.append(plain())
                tags.append("O")
            r = rng.random()
            if r < 0.6:
                w, kind = data()
                tags += [("B-" if not i else "I-") + kind for i in range(len(w))]
                w[-1] += glue or pick(["", "", "", ".", ","])
                if glue and rng.random() < 0.5:
                    w[:-1] = [x + glue for x in w[:-1]]
                words += w
            elif r < 0.85:
                words.append(other())
                tags.append("O")
            elif r < 0.93:
                words.append(pick(["=", "-", "&", ":", "token", "key", "|", "the", "+"]))
                tags.append("O")
        if words:
            out.append((words, tags))
    return out


@dataclass
class Crf:
    """weights[f]: a score for each tag of feature f. step[i, j]: of tag j after tag i; begin: of the first tag."""

    index: dict[str, int]
    weights: np.ndarray
    step: np.ndarray
    begin: np.ndarray
    pad: int = 0
    _memo: dict = field(default_factory=dict, repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        """[words, tags]. Neighbours count only if they belong to the same text."""
        out = np.zeros((len(words), len(TAGS)))
        for t in range(len(words)):
            key = (shape(words[t]), brief(words[t - 1]) if t else "^", brief(words[t + 1]) if t + 1 < len(words) else "$")
            row = self._memo.get(key)
            if row is None:
                ids = [self.index[f] for f in _features(*key) if f in self.index]
                row = self.weights[ids].sum(0)
                if len(self._memo) < REMEMBERED:
                    self._memo[key] = row
            out[t] = row
        return out


def _features(own: tuple[str, ...], before: str, after: str) -> list[str]:
    return ["bias", *own, "<" + before, ">" + after]


_BANNED = np.zeros((len(TAGS), len(TAGS)), bool)
for _j, _t in enumerate(TAGS):
    if _t.startswith("I-"):
        for _i, _s in enumerate(TAGS):
            _BANNED[_i, _j] = _s[2:] != _t[2:]
_NEVER = -1e4


def fit(rows: list[tuple[list[str], list[str]]], epochs: int = EPOCHS, step: float = STEP, ridge: float = RIDGE) -> Crf:
    """Maximum conditional likelihood with an L2 penalty, by Adam on all rows at once; the same table gives the same weights."""
    index: dict[str, int] = {}
    longest, n, k = max(len(w) for w, _ in rows), len(rows), len(TAGS)
    many = 2 + max(len(shape(x)) for w, _ in rows for x in w) + 1
    feats = np.zeros((n, longest, many), np.int32)
    gold = np.zeros((n, longest), np.int64)
    size = np.array([len(w) for w, _ in rows])
    index[""] = 0  # padding
    for r, (words, tags) in enumerate(rows):
        for t, x in enumerate(words):
            fs = _features(shape(x), brief(words[t - 1]) if t else "^", brief(words[t + 1]) if t + 1 < len(words) else "$")
            for i, f in enumerate(fs):
                feats[r, t, i] = index.setdefault(f, len(index))
            gold[r, t] = TAGS.index(tags[t])
    here = np.arange(longest) < size[:, None]
    w, a, s = np.zeros((len(index), k)), np.where(_BANNED, _NEVER, 0.0), np.where([t.startswith("I-") for t in TAGS], _NEVER, 0.0)
    params = [w, a, s]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for epoch in range(1, epochs + 1):
        w[0] = 0
        e = w[feats].sum(2)
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = s + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(here[:, t, None], lse(alpha[:, t - 1, :, None] + a[None], 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(here[:, t + 1, None], lse(a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * here[:, :, None]
        target = np.eye(k)[gold] * here[:, :, None]
        ge = target - post
        gw = np.zeros_like(w)
        for i in range(many):
            np.add.at(gw, feats[:, :, i].ravel(), ge.reshape(-1, k))
        ga = np.zeros_like(a)
        for t in range(1, longest):
            ok = here[:, t]
            pair = np.exp(alpha[ok, t - 1, :, None] + a[None] + (e[ok, t] + beta[ok, t])[:, None, :] - z[ok, None, None])
            ga += np.einsum("ni,nj->ij", target[ok, t - 1], target[ok, t]) - pair.sum(0)
        for p, g, (m, v) in zip(params, (gw, ga, ge[:, 0].sum(0)), moments):
            g = g / n - ridge * np.where(p < _NEVER / 2, 0, p)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = step * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
            p += np.where(p < _NEVER / 2, 0, move)
    w[0] = 0
    crf = Crf(index, w, a, s)
    crf.pad = reach(crf)
    return crf


def reach(crf: Crf) -> int:
    """The most plain words in a row, with plain neighbours, that a best path can give tags other than O.

    Let m such words have other tags, and make them O. Emissions gain m * delta at least. The inner transitions lose m * inner at most, those at the
    ends a constant; if an I tag follows, it has to become B, which loses a bounded amount on that word too. So m is bounded. A
    stretch within plain words, or at an end of the text, must lose from its first word on; this is checked as well.
    """
    own = crf.weights[[crf.index["bias"], crf.index["plain"]]].sum(0)
    sides, worst = [], []
    group = {"<": [], ">": [], "own": []}
    for f, i in crf.index.items():
        if f:
            group[f[0] if f[0] in "<>" else "own"].append(i)
    for mark in "<>":
        calm = [crf.weights[crf.index[mark + x]] for x in ("plain", "^", "$") if mark + x in crf.index] + [np.zeros(len(TAGS))]
        sides.append(np.min([x[0] - x for x in calm], axis=0))
    delta = float((own[0] - own + sides[0] + sides[1])[1:].min())
    for b in range(1, len(TAGS), 2):  # B at b, I at b + 1
        lost = np.maximum(crf.weights[:, b + 1] - crf.weights[:, b], 0)
        worst.append(np.sort(lost[group["own"]])[-9:].sum() + lost[group["<"]].max() + lost[group[">"]].max())
    enter, leave, stay = crf.step[0][~_BANNED[0]][1:].max(), crf.step[1:, 0].max(), crf.step[0, 0]
    inner = max(0.0, float(crf.step[1:, 1:][~_BANNED[1:, 1:]].max() - stay))
    alone = max(enter + leave - 2 * stay, enter - stay, crf.begin[crf.begin > _NEVER / 2].max() + leave - crf.begin[0] - stay)
    if delta <= inner or delta <= alone:
        raise ValueError("these weights don't bound the tags of plain words")
    anything = crf.step[~_BANNED]
    ends = 2 * anything.max() - crf.step[:, 0].min() - crf.step[0][~_BANNED[0]].min() + max(worst)
    return int(np.ceil(max(0.0, float(ends)) / (delta - inner))) + 1


def viterbi(crf: Crf, chains: list[np.ndarray], open_start: list[bool], open_end: list[bool]) -> list[np.ndarray]:
    """The best tags of each chain of emissions, chains of like length at once. Ends that aren't open are O; ties go to the first tag."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
    order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: len(chains[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(chains[order[to]]) <= CELLS:
            to += 1
        ids, at = order[at:to], to
        longest = len(chains[ids[-1]])
        k = len(TAGS)
        e = np.zeros((len(ids), longest, k))
        size = np.array([len(chains[i]) for i in ids])
        for r, i in enumerate(ids):
            e[r, : len(chains[i])] = chains[i]
            if not open_start[i]:
                e[r, 0, 1:] += 2 * _NEVER
            if not open_end[i]:
                e[r, size[r] - 1, 1:] += 2 * _NEVER
        best = e[:, 0] + crf.begin
        back = np.zeros((len(ids), longest, k), np.int8)
        for t in range(1, longest):
            way = best[:, :, None] + crf.step[None]
            back[:, t] = way.argmax(1)
            best = np.where((t < size)[:, None], way.max(1) + e[:, t], best)
        last = best.argmax(1)
        for r, i in enumerate(ids):
            path = np.empty(size[r], np.int64)
            path[-1] = last[r]
            for t in range(size[r] - 1, 0, -1):
                path[t - 1] = back[r, t, path[t]]
            out[i] = path
    return out


#: These find at least every word that isn't plain: digits and "@"; words of marks alone; keywords. Each starts with a set of characters,
#: for which the regular expression engine has a fast search.
_CHARS = re.compile(r"[0-9@]")
_MARKS = re.compile(r"[\x00-\x08\x0e-\x1f!-/:-?\[-`{-\x7f](?<=[ \t\n\x0b\f\r].)[^A-Za-z0-9 \t\n\x0b\f\r\u0080-\U0010ffff]*(?![^ \t\n\x0b\f\r])")
_NAMED = re.compile("token|secret|passw|key|auth", re.I)
_STEMS = ("token", "secret", "passw", "key", "auth")


def unusual(text: str) -> list[int]:
    """Places in words that may not be plain."""
    hits = [m.start() for m in _CHARS.finditer(text)] + [m.start() for m in _MARKS.finditer(text)]
    if text and _MARKS.match(" " + text[:1] + " ", 1):  # a mark at the start, which the search takes to follow no blank
        hits.append(0)
    small = text.lower()
    if any(s in small for s in _STEMS) or "\u212a" in text or "\u017f" in text:
        hits += [m.start() for m in _NAMED.finditer(text)]
    return sorted(hits)


def islands(text: str, pad: int) -> list[tuple[list[tuple[int, int]], bool, bool]]:
    """Runs of words (as spans) that decoding has to look at, and whether each starts and ends where the text does.

    `pad` words with plain neighbours may have other tags; so may the word next to an unusual one; the word after those is O.
    """
    hits = unusual(text)
    if not hits:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    at = np.unique(np.searchsorted([a for a, _ in words], hits, "right") - 1)
    far = pad + 2
    gaps = np.flatnonzero(np.diff(at) > 2 * far) + 1
    return [(words[max(0, g[0] - far) : g[-1] + far + 1], bool(g[0] <= far), bool(g[-1] + far >= len(words) - 1)) for g in np.split(at, gaps)]


def spans_of(crf: Crf, texts: list[str | None]) -> list[list[Span]]:
    """The personal data in each text: (kind, start, end), in characters, ends stripped of marks."""
    chains, opens, closes, where = [], [], [], []
    for r, text in enumerate(texts):
        if text:
            for words, starts, ends in islands(text, crf.pad):
                chains.append(crf.emissions([text[a:b] for a, b in words]))
                opens.append(starts)
                closes.append(ends)
                where.append((r, words))
    out: list[list[Span]] = [[] for _ in texts]
    for (r, words), path in zip(where, viterbi(crf, chains, opens, closes)):
        out[r] += _spans(texts[r], words, path)
    return out


def _spans(text: str, words: list[tuple[int, int]], path: np.ndarray) -> list[Span]:
    out: list[Span] = []
    t = 0
    while t < len(words):
        tag = TAGS[path[t]]
        if tag == "O":
            t += 1
            continue
        end = t + 1
        while end < len(words) and TAGS[path[end]] == "I-" + tag[2:]:
            end += 1
        first, last = text[slice(*words[t])], text[slice(*words[end - 1])]
        a = words[t][0] + core(first)[0]
        if tag[2:] == "PHONE" and first.startswith("("):
            a = words[t][0]
        if tag[2:] == "SECRET" and end - t > 1:  # what the keyword names, not the keyword
            s = words[end - 1][0] + core(last)[0]
            a = s
        elif tag[2:] == "SECRET" and "=" in first:
            inner = first.rindex("=") + 1
            a = words[t][0] + inner + core(first[inner:])[0]
        b = words[end - 1][0] + core(last)[1]
        out.append((tag[2:], a, b))
        t = end
    return out


def mask(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for kind, a, b in spans:
        parts += [text[at:a], "<", kind, ">"]
        at = b
    return "".join([*parts, text[at:]])


@lru_cache(2)
def trained(seed: int = SEED, sentences: int = SENTENCES) -> Crf:
    """The field fitted to the labelled table; once per process."""
    return fit(labelled_table(seed, sentences))


def _worked(crf: Crf, column: pa.Array) -> tuple[list[str | None], list[list[Span]]]:
    texts = column.to_pylist()
    found = spans_of(crf, texts)
    return [mask(t, s) if s else t for t, s in zip(texts, found)], found


def redact(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, text, found) for each row of docs: the text with each piece of personal data replaced by its kind in angle brackets, and the pieces' kinds and places in the old text, in characters.

    A null text stays null and an empty one empty, with nothing found. A null doc_id stays null; repeated rows give a row each. Texts are
    decoded whole, however long. Other columns are ignored. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, found = _worked(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)], names=["doc_id", "text", "found"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)


def redact_rows(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs with the texts redacted and n_chars, if there is such a column, made to fit where a text changed; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                arrays = [part.column(i) for i in range(part.num_columns)]
                texts, found = _worked(shared.value, part.column("text"))
                i = names.index("text")
                arrays[i] = pa.array(texts, part.schema.field(i).type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    changed = pa.array([bool(s) for s in found])
                    arrays[j] = pc.if_else(changed, pc.utf8_length(arrays[i]).cast(part.schema.field(j).type), arrays[j])
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(work, docs.schema)
