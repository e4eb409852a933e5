"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates licence expressions.

A phrase counts where it isn't part of a longer word; capitals, line ends, repeated blanks and comment marks don't matter. After a tag (such as
"SPDX-License-Identifier:") the rest of the line is read as an expression of identifiers with "+", WITH, AND, OR and brackets, binding in
this order. An expression has a category: AND is as strict as its stricter side, OR as lenient as the more lenient, and a known
exception makes strong copyleft weak. A document is as strict as its strictest expression or notice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From lenient to strict.
CATEGORIES = ("public", "permissive", "weak", "strong", "restricted", "unknown", "malformed")
#: Documents of these categories, and those without any licence, are allowed.
ALLOWED = ("public", "permissive", "weak")
LICENCES = {
    "public": "cc0-1.0 unlicense 0bsd wtfpl",
    "permissive": "mit mit-0 apache-2.0 apache-1.1 bsd-2-clause bsd-3-clause bsd-4-clause isc zlib bsl-1.0 python-2.0 psf-2.0 cc-by-3.0 cc-by-4.0 unicode-dfs-2016 artistic-2.0 ncsa x11 postgresql",
    "weak": "lgpl-2.0 lgpl-2.1 lgpl-3.0 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cc-by-sa-3.0 cc-by-sa-4.0",
    "strong": "gpl-2.0 gpl-3.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later eupl-1.2",
    "restricted": "cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cc-by-nd-4.0 busl-1.1 sspl-1.0 elastic-2.0 proprietary",
}
CATEGORY = {name: c for c, names in LICENCES.items() for name in names.split()}
EXCEPTIONS = set("classpath-exception-2.0 gcc-exception-3.1 gcc-exception-2.0 llvm-exception font-exception-2.0 bison-exception-2.2 autoconf-exception-3.0 linux-syscall-note openvpn-openssl-exception universal-foss-exception-1.0".split())
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "apache license version 2.0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms, with or without modification": "bsd-3-clause",
    "licensed under the gnu general public license, version 3": "gpl-3.0",
    "licensed under the gnu general public license, version 2": "gpl-2.0",
    "under the terms of the gnu general public license": "gpl-2.0-or-later",
    "under the terms of the gnu lesser general public license": "lgpl-2.1-or-later",
    "under the terms of the gnu affero general public license": "agpl-3.0",
    "subject to the terms of the mozilla public license, v. 2.0": "mpl-2.0",
    "licensed under cc by 4.0": "cc-by-4.0",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by-nd 4.0": "cc-by-nd-4.0",
    "creative commons attribution 4.0 international": "cc-by-4.0",
    "creative commons attribution-noncommercial 4.0": "cc-by-nc-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "business source license 1.1": "busl-1.1",
    "all rights reserved.": "proprietary",  # also before "proprietary and confidential", as one hit
}
SCHEMA = "doc_id bigint, licences array<string>, expressions array<string>, hits int, category string, allowed boolean"
_PIECE = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.\-+:]*)")
_BLANKS = re.compile(r"\s*")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, in small letters; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    at, operand_next = 0, True
    expression = expression.strip()
    while at < len(expression):
        m = _PIECE.match(expression, at)
        if not m:
            return None
        word, at = m.group(1).lower(), m.end()
        if word == "(":
            if not operand_next:
                return None
            stack.append(word)
        elif word == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif word in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
        at = _BLANKS.match(expression, at).end()
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[str, list[str]]:
    """(category, identifiers) of an expression. An exception must name a licence's, and stand after WITH."""
    order = postfix(expression)
    if order is None:
        return "malformed", []
    stack: list[int | str] = []
    names: list[str] = []

    def value(x: int | str) -> int:
        if isinstance(x, int):
            return x
        names.append(x)
        return CATEGORIES.index(CATEGORY.get(x.removesuffix("+"), "unknown"))

    for word in order:
        if word not in _RANK:
            stack.append(word)
            continue
        right, left = stack.pop(), stack.pop()
        if word == "with":
            if isinstance(right, int) or isinstance(left, int):
                return "malformed", []
            known, base = right in EXCEPTIONS, value(left)
            names.append(right)
            stack.append(min(base, CATEGORIES.index("weak")) if known and base == CATEGORIES.index("strong") else base if known else CATEGORIES.index("unknown"))
        else:
            a, b = value(left), value(right)
            stack.append(max(a, b) if word == "and" else min(a, b))
    return CATEGORIES[value(stack.pop())], sorted(set(names))


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, name in NOTICES.items():
        a.add_word(phrase, (len(phrase), name))
    for tag in TAGS:
        a.add_word(tag, (len(tag), None))
    a.make_automaton()
    return a


_MARKS = re.compile(r"(?:(?<=\n)|^)[ \t]*(?:\*+|#+|//+|;+|--)[ \t]*")
_LINE_END = re.compile(r"[\r\n]|\*/|-->")


def scan(text: str) -> tuple[list[str], list[str], int, str | None]:
    """(licences, expressions, hits, category) of a text; no category without a hit."""
    plain = text.lower()
    if "licen" not in plain and "permi" not in plain and "commons" not in plain and "redistribution" not in plain and "rights" not in plain and "unencumbered" not in plain:
        return [], [], 0, None  # every tag and phrase has one of these
    tagged = any(t in plain for t in TAGS)
    if "\n" in plain:
        plain = _MARKS.sub(" ", plain)
    plain = " ".join(plain.split())
    names: set[str] = set()
    expressions, worst, hits = [], -1, 0
    for end, (size, name) in automaton().iter(plain):
        start = end - size + 1
        if name is None or (start and plain[start - 1].isalnum()) or (end + 1 < len(plain) and plain[end + 1].isalnum()):
            continue
        hits += 1
        names.add(name)
        worst = max(worst, CATEGORIES.index(CATEGORY[name]))
    if tagged:
        small = text.lower() if len(text.lower()) == len(text) else text.translate(_ASCII)
        for end, (size, name) in automaton().iter(small):
            at = end - size + 1
            if name is not None or (size == len("license-identifier:") and small[max(0, at - 5) : at] == "spdx-" and small.startswith("license-identifier:", at)):
                continue
            stop = _LINE_END.search(text, end + 1)
            expression = text[end + 1 : stop.start() if stop else len(text)].strip()
            category, ids = evaluate(expression)
            hits += 1
            names.update(ids)
            expressions.append(" ".join(expression.split()))
            worst = max(worst, CATEGORIES.index(category))
    return sorted(names), sorted(set(expressions)), hits, CATEGORIES[worst] if hits else None


_ASCII = {c: c + 32 for c in range(65, 91)}


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, expressions, hits, category, allowed) of each row of docs.

    Null, empty and unlicensed texts: nothing found, no category, allowed. A malformed expression has the category "malformed" and isn't allowed. A null
    doc_id stays null; every tag's expression goes to the end of its line; repeated rows give a row each; equal finds in a text count as hits each and are listed once. Texts are scanned
    whole. Other columns are ignored. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [scan(t) if t else ([], [], 0, None) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[3] is None or r[3] in ALLOWED for r in rows], pa.bool_())],
                    names=["doc_id", "licences", "expressions", "hits", "category", "allowed"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
