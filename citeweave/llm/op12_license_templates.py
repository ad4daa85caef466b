"""License notices by template markup.

A template is wording with optional regions (``<<beginOptional>> .. <<endOptional>>``, nested if need be) and replaceable ones
(``<<var;name="..";words="0-9">>``, so many words; with ``match=".."`` each of them matches that pattern). It is compiled into an automaton over tokens: its states are places in the wording, and each
word of a text moves every live state to the places that may follow with that word. A text is marked where a path
reaches the end, so all mandatory wording stands there exactly, in order. Automata run over texts that hold the longest mandatory run of words
of a template, as every accepted text does.

Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII. A null text counts as empty: no words, no
labels, score 0. Whole texts are read, in one pass of live states; of paths that meet in one state the earliest start stays, and of marks with one
start the longest. Rows with one id or repeated whole are each answered by themselves. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import let_go

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of common notices: (label, template).
TEMPLATES = [
    ("gpl-2.0", "<<beginOptional>> this <<var;name='work';words='1-3'>> is <<endOptional>> licensed under <<beginOptional>> the terms of <<endOptional>> the GNU General Public License <<beginOptional>> as published by the Free Software Foundation <<endOptional>> version 2"),
    ("gpl-3.0", "<<beginOptional>> this <<var;name='work';words='1-3'>> is <<endOptional>> licensed under <<beginOptional>> the terms of <<endOptional>> the GNU General Public License <<beginOptional>> as published by the Free Software Foundation <<endOptional>> version 3"),
    ("gpl-notice", "<<var;name='program';words='1-4'>> is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version <<var;name='version';words='1-2'>> of the License or at your option any later version"),
    ("apache-2.0", "licensed under the Apache License Version 2.0 <<beginOptional>> the License <<beginOptional>> you may not use this <<var;name='work';words='1-3'>> except in compliance with the License <<endOptional>> <<endOptional>>"),
    ("mit", "<<beginOptional>> this <<var;name='work';words='1-3'>> is <<endOptional>> <<var;name='verb';words='1-1'>> under <<beginOptional>> the terms of <<endOptional>> the MIT License"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this <<var;name='work';words='1-6'>> to deal in the <<var;name='object';words='1-3'>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission to use copy modify and or distribute this <<var;name='work';words='1-4'>> for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the Mozilla Public License v 2.0 <<beginOptional>> if a copy of the MPL was not distributed with this <<var;name='work';words='1-2'>> you can obtain one at <<endOptional>>"),
    ("cc-by", "licensed under <<beginOptional>> a <<endOptional>> CC BY <<var;name='version';words='2-2';match='[0-9]+'>>"),
    ("cc-by-sa", "licensed under <<beginOptional>> a <<endOptional>> CC BY SA <<var;name='version';words='2-2';match='[0-9]+'>>"),
    ("cc-by-nc", "licensed under <<beginOptional>> a <<endOptional>> CC BY NC <<var;name='version';words='2-2';match='[0-9]+'>>"),
    ("cc-by-nd", "licensed under <<beginOptional>> a <<endOptional>> CC BY ND <<var;name='version';words='2-2';match='[0-9]+'>>"),
    ("cc-by", "licensed under a Creative Commons Attribution <<var;name='version';words='2-2';match='[0-9]+'>> <<beginOptional>> International <<endOptional>> License"),
    ("all-rights-reserved", "copyright <<beginOptional>> c <<endOptional>> <<var;name='holder';words='1-8'>> all rights reserved"),
]

#: ASCII bytes that are no word's become blanks, A-Z become a-z; bytes of characters beyond ASCII stay.
_PLAIN = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Any word.
ANY = "[^ ]+"
_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var\b[^>]*)\s*>>")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


# A template's tree: bytes words, ("any", least, most, pattern) regions and ("opt", [...]) regions.
def parse(template: str) -> list:
    """The template as words, replaceable and optional regions."""
    stack: list[list] = [[]]
    parts = _MARK.split(template)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            stack[-1] += words_of(part)
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"optional region ends without a beginning: {template!r}")
            region = stack.pop()
            stack[-1].append(("opt", region))
        else:
            span = re.search(r"words\s*=\s*['\"](\d+)-(\d+)['\"]", part)
            if not span or int(span[1]) > int(span[2]):
                raise ValueError(f"a replaceable region needs words='least-most': <<{part}>>")
            match = re.search(r"match\s*=\s*(['\"])(.+?)\1", part)
            stack[-1].append(("any", int(span[1]), int(span[2]), match[2] if match else ANY))
    if len(stack) > 1:
        raise ValueError(f"optional region without an end: {template!r}")
    if not any(isinstance(x, bytes) for x in stack[0]):
        raise ValueError(f"a template needs mandatory wording: {template!r}")
    return stack[0]


def longest_run(tree: list) -> bytes:
    """Longest run of mandatory words, between blanks."""
    runs = reduce(lambda held, x: [*held[:-1], [*held[-1], x]] if isinstance(x, bytes) else [*held, []], tree, [[]])
    return b" " + b" ".join(max(runs, key=lambda r: len(b" ".join(r)))) + b" "


class Automaton:
    """States are the words and word gaps of all templates; ``follow[state]`` tells by word, and for any word, which may come next."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.symbol: list[bytes | None] = []  # of a state; None where a pattern (None too: any word) tells
        self.pattern: list[re.Pattern[bytes] | None] = []
        self.label: list[str] = []
        self.after: list[set[int]] = []
        self.final: set[int] = set()
        first: set[int] = set()
        self.runs = []
        for label, template in templates:
            tree = parse(template)
            empty, begin, last = self._sequence(tree, label)
            first |= begin
            self.final |= last
            self.runs.append(longest_run(tree))
        self.runs = sorted(set(self.runs))
        self.entry, self.any_entry = self._by_word(first)
        self.follow = [self._by_word(states) for states in self.after]

    def _state(self, symbol: bytes | None, label: str, pattern: str = ANY) -> int:
        self.symbol.append(symbol)
        self.pattern.append(None if pattern == ANY else re.compile(pattern.encode()))
        self.label.append(label)
        self.after.append(set())
        return len(self.symbol) - 1

    def _sequence(self, items: list, label: str) -> tuple[bool, set[int], set[int]]:
        """Whether nothing is accepted too, the states it can begin with, and those it can end with."""
        empty, first, last = True, set(), set()
        for item in items:
            if isinstance(item, bytes):
                state = self._state(item, label)
                skip, begin, end = False, {state}, {state}
            elif item[0] == "opt":
                _, begin, end = self._sequence(item[1], label)
                skip = True
            else:
                skip, begin, end = item[1] == 0, set(), set()
                for k in range(item[2]):
                    state = self._state(None, label, item[3])
                    if k == 0:
                        begin = {state}
                    else:
                        self.after[state - 1].add(state)
                    if k + 1 >= item[1]:
                        end.add(state)
            for state in last:
                self.after[state] |= begin
            first = first | begin if empty else first
            last = last | end if skip else end
            empty = empty and skip
        return empty, first, last

    def _by_word(self, states: set[int]) -> tuple[dict[bytes, list[int]], list[int]]:
        by: dict[bytes, list[int]] = {}
        for state in sorted(states):
            if self.symbol[state] is not None:
                by.setdefault(self.symbol[state], []).append(state)
        return by, [s for s in sorted(states) if self.symbol[s] is None]

    def _fits(self, state: int, word: bytes) -> bool:
        pattern = self.pattern[state]
        return pattern is None or pattern.fullmatch(word) is not None

    def marks(self, words: list[bytes], line: bytes) -> list[tuple[str, int, int]]:
        """(label, first word, last word) of every accepted stretch; ``line`` holds the words between blanks."""
        if not any(run in line for run in self.runs):
            return []
        found: dict[tuple[str, int], int] = {}
        live: dict[int, int] = {}
        for i, word in enumerate(words):
            now: dict[int, int] = {}
            for state, start in live.items():
                by, free = self.follow[state]
                for to in (*by.get(word, ()), *(t for t in free if self._fits(t, word))):
                    if start < now.get(to, i):
                        now[to] = start
            for to in (*self.entry.get(word, ()), *(t for t in self.any_entry if self._fits(t, word))):
                now.setdefault(to, i)
            live = now
            for state in live.keys() & self.final:
                key = (self.label[state], live[state])
                found[key] = i
        return sorted((label, start, end) for (label, start), end in found.items())


def places(line: bytes, phrase: str) -> list[int]:
    """Words at which the phrase stands."""
    out, find, at, word, seen = [], b" " + phrase.encode() + b" ", -1, 0, 0
    while (at := line.find(find, at + 1)) >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        out.append(word)
    return out


SCHEMA = "doc_id long, n_words long, base array<struct<label:string,first:bigint>>, marks array<struct<label:string,first:bigint,last:bigint>>"
_BASE = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
_MARKS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def license_marks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, number of words, places of base phrases, and the stretches of words that templates accept."""
    automaton = Automaton(templates)  # compiled once, sent with the task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, marks = [], [], []
            for text in pc.fill_null(batch.column(1), ""):
                words = words_of(text.as_py())
                line = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                base.append([{"label": label, "first": k} for phrase, label in PHRASES.items() for k in places(line, phrase)])
                marks.append([{"label": m[0], "first": m[1], "last": m[2]} for m in automaton.marks(words, line)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(base, _BASE), pa.array(marks, _MARKS)], names=["doc_id", "n_words", "base", "marks"])
        let_go()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def license_labels(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; 1 where a template accepts, a half where a phrase stands alone."""
    found = license_marks(docs, templates)
    base, marks = F.array_distinct("base.label"), F.array_distinct("marks.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, marks)), ",").alias("labels"),
        F.when(F.size("marks") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def as_regex(tree: list) -> str:
    """The template as a regular expression over words that end with a blank each."""
    turn = {"opt": lambda x: f"(?:{as_regex(x[1])})?", "any": lambda x: f"(?:(?:{x[3]}) ){{{x[1]},{x[2]}}}"}
    return "".join(f"{x.decode()} " if isinstance(x, bytes) else turn[x[0]](x) for x in tree)


def oracle() -> str:
    """The same rows in SQL, with the templates as regular expressions."""
    by_label = [f"CASE WHEN regexp_matches(line, ' {as_regex(parse(t))}') THEN '{label}' END" for label, t in TEMPLATES]
    hits = [f"[{{'label': '{label}', 'first': k - 1}} for k in range(1, n_words + 1) if words[k:k + {phrase.count(' ')}] = {phrase.split()}]" for phrase, label in PHRASES.items()]
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
lined AS (SELECT doc_id, words, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM cut),
found AS (
  SELECT doc_id, n_words, flatten([{', '.join(hits)}]) AS base, list_filter([{', '.join(by_label)}], lambda m: m IS NOT NULL) AS marks FROM lined),
named AS (SELECT *, list_transform(base, lambda b: b.label) AS base_names, list_transform(base, lambda b: b.first) AS starts FROM found)
SELECT doc_id, n_words, len(base)::BIGINT AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  array_to_string(list_sort(list_distinct(base_names)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base_names, marks))), ',') AS labels,
  CASE WHEN len(marks) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM named"""
