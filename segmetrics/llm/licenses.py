"""License scans by template matching.

A template is wording with mark-up: ``[[`` ... ``]]`` encloses an optional
region, ``<<m-n>>`` a replaceable one of m to n words, and ``!!word`` says
that the next word after the match is another. Templates are whole license
texts (``license_texts``) or notices and extracts. They compile into
token automata: a state for each word, a way around each optional region, and
a chain of free words for each replaceable one. A text carries a license if
somewhere the automaton runs from start to end, so mandatory wording must
match exactly, word for word. Words are runs of ASCII letters, digits and
all other letters; case of A-Z doesn't count.

Next to the templates, fixed phrases are counted (every place where a
phrase's words stand consecutively).

One pass over the texts, no shuffle. A template's automaton runs only on a
text that holds all its mandatory words, and only from places where its
first words stand, which loses no match.

Defined results: a null or empty text has no words, no label and score 0;
repeated rows get a result each; an empty table gives an empty result. The
score is 1 where a whole text matches, ``NOTICE`` where a phrase, a notice or
an extract does; else, over the notices all of whose mandatory words the
text holds, the largest share of them that was followed from a starting
place, halved so that partial wording stays below any match; else 0.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from segmetrics.llm.common import in_arrow
from segmetrics.llm.license_texts import GENERAL, WHOLE_TEXTS

NOTICE = 0.9  # score of a match that is no whole license

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# label and wording; several templates may carry one label
TEMPLATES = [
    ("mit", "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<1-12>> to deal in <<1-6>> "
            "without restriction"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("apache-2", "[[spdx license identifier]] apache 2 0"),
    ("gpl-3", "licensed under the gnu general public license [[as published by the free software foundation]] "
              "[[either]] version 3 [[0]] [[or any later version]]"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 [[of the license]]"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2 !!1"),
    ("lgpl", "gnu lesser general public license [[as published by <<1-6>>]] version <<1-1>>"),
    ("agpl-3", "gnu affero general public license [[as published by <<1-6>>]] version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("bsd", "[[licensed]] [[released]] under the [[<<1-2>>]] bsd license"),
    ("mpl-2", "subject to the terms of the mozilla public license v <<0-1>> 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "[[licensed]] [[released]] under [[a]] [[the]] [[creative commons]] cc by nc [[4 0]]"),
    ("cc-by-nc", "creative commons attribution noncommercial [[<<1-2>>]] license"),
    ("cc-by-sa", "[[licensed]] [[released]] under [[a]] [[the]] [[creative commons]] cc by sa [[4 0]]"),
    ("cc-by", "creative commons attribution <<0-2>> [[international]] license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# bytes that are no part of a word become spaces; A-Z become a-z
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Automaton:
    """States are numbered from 0; ``words`` and ``any_word`` lead on to
    another state by one word, ``free`` without one."""
    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    mandatory_before: list[int] = field(default_factory=list)
    mandatory: frozenset[bytes] = frozenset()
    not_next: frozenset[bytes] = frozenset()
    end: int = 0

    def state(self, before: int) -> int:
        self.words.append({})
        self.any_word.append(None)
        self.free.append([])
        self.mandatory_before.append(before)
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.words[s]}

    def run(self, words: list[bytes], at: int) -> tuple[int | None, float]:
        """From word ``at``: the last word of the shortest match, or None;
        the largest share of mandatory words followed."""
        states, total, far = self.closure({0}), max(1, self.mandatory_before[self.end]), 0
        for place in range(at, len(words)):
            w, step = words[place], set()
            for s in states:
                if w in self.words[s]:
                    step.add(self.words[s][w])
                if self.any_word[s] is not None:
                    step.add(self.any_word[s])
            if not step:
                break
            states = self.closure(step)
            far = max(far, max(self.mandatory_before[s] for s in states))
            if self.end in states and not (place + 1 < len(words) and words[place + 1] in self.not_next):
                return place, 1.0
        return None, far / total


def compile_template(label: str, text: str) -> Automaton:
    """Mark-up -> automaton. Optional regions may nest."""
    a, needed, depth, opened, count, other = Automaton(label), [], 0, [], 0, []
    now = a.state(0)
    for part in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|!!\S+|[^\s\[\]<>!]+", text):
        if part == "[[":
            opened.append(now)
            depth += 1
        elif part == "]]":
            if not opened:
                raise ValueError(f"template of {label}: an optional region is closed twice")
            a.free[opened.pop()].append(now)
            depth -= 1
        elif part.startswith("<<"):
            least, most = map(int, part[2:-2].split("-"))
            if least > most:
                raise ValueError(f"template of {label}: a region of {part}")
            last = [now] if least == 0 else []
            for k in range(1, most + 1):
                nxt = a.state(count)
                a.any_word[now] = nxt
                now = nxt
                if least <= k < most:
                    last.append(now)
            for s in last:
                a.free[s].append(now)
        elif part.startswith("!!"):
            other.append(part[2:].encode().translate(FOLD).strip())
        else:
            word = part.encode().translate(FOLD).strip()
            if depth == 0:
                count += 1
                needed.append(word)
            nxt = a.state(count)
            a.words[now][word] = nxt
            now = nxt
    if opened or not needed:
        raise ValueError(f"template of {label}: an open optional region, or nothing mandatory")
    a.end, a.mandatory, a.not_next = now, frozenset(needed), frozenset(other)
    return a


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, whole_texts=WHOLE_TEXTS):
        self.automata = [compile_template(*t) for t in [*templates, *whole_texts]]
        self.notices = len(templates)
        for a in self.automata:
            if not a.first_words() or any(a.any_word[s] is not None for s in a.closure({0})):
                raise ValueError(f"template of {a.label} starts with a replaceable region")
        self.starts = [a.first_words() for a in self.automata]
        self.phrases = [(f" {p} ".encode(), len(p.split()), label) for p, label in phrases.items()]

    def scan(self, text: str | None):
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, size, label in self.phrases:
            at, counted, before = joined.find(phrase), 0, -1
            while at >= 0:
                # blanks up to here, from the last place on
                before += joined.count(b" ", counted, at + 1)
                counted = at + 1
                places.append(before)
                base.add(label)
                at = joined.find(phrase, at + 1)
        labels, whole, score, index = set(base), set(), NOTICE if base else 0.0, None
        for k, (a, starts) in enumerate(zip(self.automata, self.starts)):
            if any(b" " + w + b" " not in joined for w in a.mandatory):
                continue
            if index is None:
                index = {}
                for i, w in enumerate(words):
                    index.setdefault(w, []).append(i)
            for i in sorted(i for w in starts for i in index.get(w, ())):
                end, share = a.run(words, i)
                if end is not None:
                    score = max(score, NOTICE if k < self.notices else 1.0)
                    (labels if k < self.notices else whole).add(a.label)
                    break
                if k < self.notices:
                    score = max(score, share / 2)
        labels = labels - ({GENERAL[x] for x in whole if x in GENERAL} - base) | whole
        join = lambda x: ",".join(sorted(x))
        return (len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(labels), score)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, whole_texts=WHOLE_TEXTS) -> DataFrame:
    """Documents (doc_id, text) -> one row per document, see ``SCHEMA``."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, whole_texts)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    return in_arrow(docs.select("doc_id", "text"), run, SCHEMA)
