"""Language ID, personal data and licences: brute force, held-out accuracy, and the cases that a table may hold."""

from __future__ import annotations

import re
import time

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wrenloom.llm import crf, langid, licences

WORDS = {"en": "the of and that thing with over water house".split(), "de": "der und nicht über schön wasser haus ein zeit".split(), "fr": "le la été être eau maison une très où".split()}
CLASH = "doc_id bigint, text string, lang string, n int, key string, part int, cell binary, gone_id bigint, gone_key string, least bigint, row string, bin bigint, size int, start int, h bigint, accepted string"


def texts(lang, count, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang], int(rng.integers(3, 30)))).capitalize() + "." for _ in range(count)]


@pytest.fixture(scope="module")
def samples():
    return {lang: [t.encode() for t in texts(lang, 30, 1)] for lang in WORDS}


def lengths(model, rows):
    return langid.code_lengths(model, np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))


@pytest.mark.parametrize("order, alphabet, nodes", [(0, 8, 10), (2, 16, 40), (4, 64, 8192), (3, 24, 100)])
def test_code_lengths_are_exact(samples, order, alphabet, nodes):
    model, plain = langid.train(samples, order, alphabet, nodes), brute.Ppm(samples, order, alphabet, nodes)
    rows = [b"", b"the water", "ÉTÉ où 123 {}".encode(), b"\xff\xfe", texts("de", 1, 9)[0].encode(), b"z" * 50]
    bits, _, _ = lengths(model, rows)
    for r, row in enumerate(rows):
        for k, lang in enumerate(model.languages):
            assert bits[r, k] == pytest.approx(plain.bits(lang, row), rel=1e-4, abs=1e-3)


def test_held_out_accuracy(samples):
    model = langid.train(samples)
    rows = [(lang, t.encode()) for lang in WORDS for t in texts(lang, 60, 2)]
    bits, _, _ = lengths(model, [t for _, t in rows])
    got = [model.languages[k] for k in bits.argmin(1)]
    assert np.mean([a == b for a, (b, _) in zip(got, rows)]) > 0.98


def clashing(spark, rows):
    """rows (doc_id, text, lang) with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, "k", 2, b"c", 3, "g", 4, "r", 5, 6, 7, 8, "no") for r in rows], CLASH)


CASES = [(1, "The water and the house.", "en"), (2, None, "en"), (3, "", "de"), (None, "Der und nicht.", None), (5, "1234 !!", "fr"), (6, "漢字" * 30, "zz"), (1, "The water and the house.", "en"), (8, "the of " * 60_000, None)]


def test_language_cases(spark, samples):
    model = langid.train(samples)
    df = clashing(spark, CASES)
    got = langid.identify(df, model).collect()
    assert len(got) == len(CASES)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["pred_lang"] == "en" and by[1]["accepted"] and by[None]["pred_lang"] == "de" and by[8]["accepted"] and by[8]["n_bytes"] == 420_000
    for i in (2, 3, 5):
        assert by[i]["pred_lang"] is None and not by[i]["accepted"]
    assert not by[6]["accepted"]
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in rows) == [(0, "de"), (1, "en"), (1, "en"), (8, "en")]
    assert langid.identify(df.limit(0), model).count() == 0 and langid.keep_known(df.limit(0), model).count() == 0


def test_training_sample_is_bounded_and_stable(spark):
    rows = [(i, t, lang) for lang in WORDS for i, t in enumerate(texts(lang, 50, 3))] + [(None, "x", "en"), (1, None, "en"), (2, "y", None)]
    a = langid.training_sample(clashing(spark, rows), 10, 300)
    b = langid.training_sample(clashing(spark, rows[::-1]), 10, 300)
    assert a == b and set(a) == set(WORDS) and all(len(v) <= 10 for v in a.values())
    assert langid.training_sample(clashing(spark, rows).limit(0)) == {}
    none = langid.train({})
    assert [r["accepted"] for r in langid.identify(clashing(spark, CASES[:3]), none).orderBy("doc_id").collect()] == [True, False, False]


def test_equal_languages_go_to_the_first():
    model = langid.train({"b": [b"same text"], "a": [b"same text"]})
    data = np.frombuffer(b"same", np.uint8)
    assert langid.judge(model, langid.code_lengths(model, data, np.array([0, 4])), np.array([4]))["pred_lang"] == ["a"]


# personal data


@pytest.fixture(scope="module")
def field():
    return crf.trained()


def whole_viterbi(model, text):
    """All words of the text in one chain."""
    spans = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
    if not spans:
        return []
    path = crf.viterbi(model, [model.emissions([text[a:b] for a, b in spans])], [True], [True])[0]
    return crf._spans(text, spans, path)


def test_islands_lose_nothing(field, small):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    made = [" ".join(w for words, _ in crf.labelled_table(int(rng.integers(1e6)), 6) for w in words + ["so"] * int(rng.integers(0, 40))) for _ in range(60)]
    for text in [*made, *pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()[:60]]:
        assert crf.spans_of(field, [text])[0] == whole_viterbi(field, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "token", "=", '"', "12", "1.2.3.4", "x@y.zz", "+1", "(555)", "555-1234", "4111111111111111", "=" * 3, "KEY", "ſecret", "é", "--", "deadbeef0deadbeef1"]), max_size=40).map(" ".join))
def test_islands_on_anything(text):
    assert crf.spans_of(crf.trained(), [text])[0] == whole_viterbi(crf.trained(), text)


def test_fitted_field_on_held_out_rows(field):
    rows = crf.labelled_table(seed=991, sentences=300)
    right = total = 0
    for words, tags in rows:
        path = crf.viterbi(field, [field.emissions(words)], [True], [True])[0]
        right += sum(crf.TAGS[p] == t for p, t in zip(path, tags))
        total += len(words)
    assert right / total > 0.985


def test_viterbi_is_the_best_path(field):
    from itertools import product

    words = ["token", "=", '"deadbeefdeadbeef0123deadbeefdeadbeef0123"']
    e = field.emissions(words)
    score = lambda p: field.begin[p[0]] + e[0, p[0]] + sum(field.step[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
    best = max(product(range(len(crf.TAGS)), repeat=3), key=score)
    assert tuple(crf.viterbi(field, [e], [True], [True])[0]) == best


def test_pii_cases(spark, field):
    long = "word " * 50_000 + "mail me.12@mail1.example.com now " + "word " * 50_000
    rows = [(1, "call +1 (555) 123-4567 now", "en"), (2, None, None), (3, "", "en"), (None, "at 10.20.30.40 ok", None), (5, long, "en"), (1, "call +1 (555) 123-4567 now", "en"), (7, "plain words, 12 of them", "en")]
    df = clashing(spark, rows)
    got = {r["doc_id"]: r for r in crf.redact(df, field).collect()}
    assert crf.redact(df, field).count() == len(rows)
    assert got[1]["text"] == "call <PHONE> now" and got[2]["text"] is None and got[3]["text"] == "" and got[None]["text"] == "at <IP> ok" and got[7]["text"] == rows[-1][1]
    assert got[5]["text"] == long.replace("me.12@mail1.example.com", "<EMAIL>")
    assert [tuple(x) for x in got[1]["found"]] == [("PHONE", 5, 22)]
    with_size = df.withColumnRenamed("n", "n_chars")
    out = crf.redact_rows(with_size, field)
    assert out.columns == with_size.columns
    sizes = {r["doc_id"]: r["n_chars"] for r in out.collect()}
    assert sizes[1] == len("call <PHONE> now") and sizes[7] == 1 and sizes[2] == 1
    assert crf.redact_rows(df.limit(0), field).count() == 0 and crf.redact(df.limit(0), field).count() == 0


# licences


def slow_evaluate(text):
    """By descent: or over and over with."""
    tokens = re.findall(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.\-+:]*|\S", text.strip().lower())
    names, at = set(), 0
    order = licences.CATEGORIES.index

    class Bad(Exception):
        pass

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom():
        t = peek()
        if t is None or t in (")", "and", "or", "with") or not re.match(r"[(a-z0-9]", t):
            raise Bad
        take()
        if t == "(":
            x = either()
            if peek() != ")":
                raise Bad
            take()
            return x, None
        return None, t

    def value(x):
        v, name = x
        if name is None:
            return v
        names.add(name)
        return order(licences.CATEGORY.get(name.removesuffix("+"), "unknown"))

    def exempt():
        left = atom()
        if peek() != "with":
            return value(left)
        take()
        right = atom()
        if left[1] is None or right[1] is None or peek() == "with":
            raise Bad
        base = value(left)
        names.add(right[1])
        known = right[1] in licences.EXCEPTIONS
        return order("unknown") if not known else order("weak") if base == order("strong") else base

    def both():
        x = exempt()
        while peek() == "and":
            take()
            x = max(x, exempt())
        return x

    def either():
        x = both()
        while peek() == "or":
            take()
            x = min(x, both())
        return x

    try:
        x = either()
        if at != len(tokens):
            raise Bad
        return licences.CATEGORIES[x], sorted(names)
    except Bad:
        return "malformed", []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "GPL-2.0", "gpl-3.0+", "Apache-2.0", "nosuch", "AND", "or", "WITH", "Classpath-exception-2.0", "(", ")", "/"]), max_size=9).map(" ".join))
def test_shunting_yard_is_descent(text):
    assert licences.evaluate(text) == slow_evaluate(text)


def slow_scan(text):
    plain = " ".join(re.sub(r"(?m)^[ \t]*(\*+|#+|//+|;+|--)[ \t]*", " ", text.lower()).split())
    hits = [name for phrase, name in licences.NOTICES.items() for m in re.finditer(f"(?={re.escape(phrase)})", plain) if not plain[m.start() - 1 : m.start()].isalnum() or not m.start() if not plain[m.start() + len(phrase) : m.start() + len(phrase) + 1].isalnum()]
    names, worst, expressions = set(hits), [licences.CATEGORY[x] for x in hits], set()
    for m in re.finditer(r"(?i)spdx-license-identifier:|(?<!spdx-)license-identifier:|license-expression:", text):
        expression = re.split(r"[\r\n]|\*/|-->", text[m.end() :])[0].strip()
        category, ids = slow_evaluate(expression)
        names |= set(ids)
        worst.append(category)
        expressions.add(" ".join(expression.split()))
    return sorted(names), sorted(expressions), len(worst), max(worst, key=licences.CATEGORIES.index) if worst else None


PARTS = [*licences.NOTICES, *(x.upper() for x in licences.NOTICES), "// SPDX-License-Identifier: MIT OR GPL-2.0", "license-expression: (MIT", "x", "\n# ", "\n * ", "  ", "License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 */ tail", "y"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8), st.sampled_from([" ", "\n", ""]))
def test_scan_is_the_slow_scan(parts, glue):
    text = glue.join(parts)
    assert licences.scan(text) == slow_scan(text)


def test_long_expressions_and_many_tags_take_linear_time():
    began = time.process_time()
    category, names = licences.evaluate(" OR ".join(["MIT", "(Apache-2.0 AND ISC)"] * 40_000))
    assert category == "permissive" and names == ["apache-2.0", "isc", "mit"]
    found = licences.scan("SPDX-License-Identifier: MIT\n" * 100_000)
    assert found == (["mit"], ["MIT"], 100_000, "permissive")
    assert time.process_time() - began < 30


def test_licences_over_the_documents(spark, small):
    from wrenloom.llm.common import table

    docs = table(spark, small, "documents")
    got = {r["doc_id"]: (r["licences"], r["expressions"], r["hits"], r["category"]) for r in licences.licences(docs).collect()}
    assert got == {r["doc_id"]: slow_scan(r["text"]) for r in docs.collect()}
    assert any(v[2] for v in got.values())


@pytest.mark.parametrize("text", ["Some text.\nAll rights reserved.\nMore text.", "All rights reserved. Proprietary and confidential", "# ALL RIGHTS\n# RESERVED."])
def test_reserved_rights_are_a_notice(text):
    assert licences.scan(text) == (["proprietary"], [], 1, "restricted")


def test_licence_cases(spark):
    rows = [(1, "Licensed under CC BY 4.0.", "en"), (2, None, "en"), (3, "", "en"), (None, "SPDX-License-Identifier: BUSL-1.1", "en"), (1, "Licensed under CC BY 4.0.", "en"), (6, "word " * 200_000 + "released under the MIT license", "en"), (7, "SPDX-License-Identifier: MIT AND", "en"), (8, "all rights reserved", None)]
    df = clashing(spark, rows)
    out = licences.licences(df)
    got = {r["doc_id"]: (r["category"], r["allowed"], r["hits"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {1: ("permissive", True, 1), 2: (None, True, 0), 3: (None, True, 0), None: ("restricted", False, 1), 6: ("permissive", True, 1), 7: ("malformed", False, 1), 8: (None, True, 0)}
    assert licences.licences(df.limit(0)).count() == 0
