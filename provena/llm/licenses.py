"""Licence scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

A text's words ([0-9a-z] and everything beyond ASCII, A-Z lower-cased) are joined by single spaces and run once through
an automaton of all phrases, so a phrase is found wherever its words stand consecutively. Where the automaton meets an
identifier tag, the raw text after each tag is read as a licence expression up to the end of its line: identifiers,
``and``, ``or``, ``with`` and parentheses, in order of precedence with > and > or. Shunting-yard puts it into postfix
order; evaluation gives the labels it names and how freely the text may be used: ``or`` lets the reader choose (the
larger value), ``and`` binds to both (the smaller), ``with`` adds an exception (half of the way to 1).

The score of a text is the smallest value of its notices and expressions, 0 if it has none.

Defined results: null and empty texts have no words, no labels and score 0; an expression that does not parse (operand
or parenthesis missing) yields the identifiers before the fault as one ``and``; unknown identifiers count as labels with
value 0.2; repeated rows give equal results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.llm.text import lower_bytes

#: Phrases of the query's base, as words, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "redistribution and use in source and binary forms": "bsd", "the bsd license": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "the mit license": "mit",
    "permission to use copy modify and or distribute this software": "isc", "boost software license": "bsl-1",
    "this is free and unencumbered software released into the public domain": "unlicense", "cc0 1 0": "cc0", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "all rights reserved": "all-rights-reserved",
}

#: How freely a label lets its text be used, 0 to 1.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl-1": 0.95, "apache-2": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.25, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.2

#: Identifier tags in lower-cased text.
TAGS = ("spdx-license-identifier:", "license-expression:")

#: Identifiers of expressions that have another label here, by their beginning.
ALIASES = {"apache-2": "apache-2", "agpl": "agpl", "lgpl": "lgpl", "gpl-2": "gpl-2", "gpl-3": "gpl-3", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "bsl-1": "bsl-1", "0bsd": "bsd"}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_SEPARATORS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def label_of(identifier: str) -> str:
    plain = identifier.rstrip(".+:-")
    return next((label for start, label in ALIASES.items() if plain.startswith(start)), plain)


def postfix(expression: str) -> tuple[list[str], bool]:
    """The expression in postfix order, and whether it was sound; a fault ends it."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # an operand comes next
    sound = True
    for token in _TOKEN.findall(expression.lower()):
        if token in PRECEDENCE and not operand:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == "(" and operand:
            stack.append(token)
        elif token == ")" and not operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif operand and token not in PRECEDENCE and token not in "()":
            out.append(token)
            operand = False
        else:  # prose after the expression, or a fault
            sound = not operand and token not in PRECEDENCE and token not in "()"
            break
    if operand or "(" in stack or not sound:
        names = [t for t in out if t not in PRECEDENCE]
        return names + ["and"] * (len(names) - 1), False
    return out + stack[::-1], True


def evaluate(rpn: list[str]) -> tuple[set[str], float | None]:
    """Labels named and value of a postfix expression; nothing of nothing."""
    stack: list[tuple[set[str], float]] = []
    for token in rpn:
        if token in PRECEDENCE:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x + (1 - x) / 2) if token == "with" else (a | b, max(x, y) if token == "or" else min(x, y)))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0] if stack else (set(), None)


@cache
def automaton() -> ahocorasick.Automaton:
    """Of all phrases and tags as words between spaces."""
    a = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        a.add_word(f" {phrase} ", (len(phrase.split()), label, "notice"))
    for tag in TAGS:
        a.add_word(f" {' '.join(re.findall('[a-z0-9]+', tag))} ", (0, None, "tag"))
    for phrase, label in BASE.items():
        a.add_word(f" {phrase} ", (len(phrase.split()), label, "base"))
    a.make_automaton()
    return a


def expressions(text: str) -> list[str]:
    """What follows each identifier tag on its line."""
    low = lower_bytes(text).decode("utf-8", "replace")
    found = []
    for tag in TAGS:
        at = low.find(tag)
        while at >= 0:
            end = re.compile(r"[\r\n]|\*/|-->|$").search(low, at + len(tag))
            found.append(low[at + len(tag) : end.start()].strip())
            at = low.find(tag, at + len(tag))
    return found


def scan(text: str | None) -> dict:
    """All that a text says about its licence; places are word numbers from 0."""
    words = lower_bytes(text).translate(_SEPARATORS).split()
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places: list[tuple[int, str, str]] = []
    values, labels, tags, found = [], set(), False, []
    at, n = 0, 0
    for end, (size, label, kind) in automaton().iter(joined):
        n += joined.count(" ", at, end)  # blanks before the closing one: words up to here
        at = end
        if kind == "tag":
            tags = True
            continue
        places.append((n - size, label, kind))
        labels.add(label)
        values.append(FREEDOM[label])
    if tags:
        for e in expressions(text):
            rpn, sound = postfix(e)
            named, value = evaluate(rpn)
            labels |= named
            values += [] if value is None else [value]
            found.append((e, " ".join(rpn), sound))
    return {"n_words": len(words), "places": places, "labels": sorted(labels), "expressions": found, "score": min(values, default=0.0)}


SCHEMA = "n_words long, places array<struct<word:long,label:string,kind:string>>, labels array<string>, expressions array<struct<text:string,postfix:string,sound:boolean>>, score double"


def scans(text: Column) -> Column:
    """struct of SCHEMA for each text."""

    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [scan(t) for t in texts]
        for r in rows:
            r["places"] = [{"word": w, "label": label, "kind": kind} for w, label, kind in r["places"]]
            r["expressions"] = [{"text": e, "postfix": p, "sound": s} for e, p, s in r["expressions"]]
        return pd.DataFrame(rows, columns=["n_words", "places", "labels", "expressions", "score"], index=texts.index)

    return of(text)
