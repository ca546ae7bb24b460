"""License scans by template markup.

A template is license wording in which `<<beginOptional>>...<<endOptional>>` may be left
out and `<<var;name=...;words=a-b>>` stands for a to b words of any kind.  It compiles to an automaton over
words; a text is accepted from a place on when its mandatory wording matches exactly.
Next to the templates, base phrases are counted wherever their words stand in a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

#: Phrases and labels that always count.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of public license notices, in their order of age.
TEMPLATES = (
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted <<beginOptional>>subject to the limitations in the disclaimer below<<endOptional>> provided that the following conditions are met"),
    ("mit", "<<beginOptional>>released<<endOptional>> under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<var;name=work;words=1-3>> and associated documentation files the <<var;name=short;words=1-3>> to deal in"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> <<beginOptional>>version <<var;name=version;words=1-2>> <<beginOptional>>of the license or at your option any later version<<endOptional>><<endOptional>>"),
    ("lgpl", "gnu <<var;name=kind;words=1-1>> general public license <<beginOptional>>version <<var;name=version;words=1-2>><<endOptional>>"),
    ("agpl", "gnu affero general public license <<beginOptional>>version <<var;name=version;words=1-2>><<endOptional>>"),
    ("apache", "licensed under the apache license <<beginOptional>>version<<endOptional>> <<var;name=version;words=0-2>> <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    ("mpl", "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<var;name=version;words=0-2>>"),
    ("cc-by-nc", "cc by nc <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> <<var;name=version;words=0-2>>"),
    ("cc-by-sa", "cc by sa <<var;name=version;words=0-2>>"),
    ("cc-by", "creative commons attribution <<var;name=version;words=0-2>> <<beginOptional>>international<<endOptional>> license"),
    ("cc0", "cc0 1 0 <<beginOptional>>universal<<endOptional>>"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("copyright", "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;words=1-12>> all rights reserved"),
)

# In UTF-8: A-Z become a-z, other ASCII that is no letter or digit a blank; words are what blanks part.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


@dataclass(frozen=True)
class Automaton:
    """Steps by state: a word (or None for any) and the states after it; states closed under empty moves."""

    label: str
    anchor: bytes
    back: int
    steps: tuple[tuple[bytes | None, int], ...]
    closures: tuple[int, ...]
    final: int
    start: int

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest match from word `at` on."""
        states, best = self.closures[self.start], None
        k = at
        while states:
            if states >> self.final & 1:
                best = k
            if k >= len(words):
                break
            word, after, rest = words[k], 0, states
            while rest:
                s = (rest & -rest).bit_length() - 1
                rest &= rest - 1
                if s != self.final:
                    want, to = self.steps[s]
                    if want is None or want == word:
                        after |= self.closures[to]
            states, k = after, k + 1
        return best


MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;[^>]*?words=(\d+)-(\d+))?[^>]*>>")


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template; one without mandatory words, or with unbalanced marks, raises ValueError."""
    steps: list[tuple[bytes | None, int]] = []
    empty: dict[int, list[int]] = {}
    runs: list[tuple[list[bytes], int | None, int | None]] = []  # mandatory runs with the least and most words in front
    opened: list[int] = []
    front_least, front_most, run = 0, 0, []

    def add(word: bytes | None) -> None:
        steps.append((word, len(steps) + 1))

    def close_run() -> None:
        nonlocal run
        if run:
            runs.append((run, front_least - len(run), front_most - len(run)))
        run = []

    pos = 0
    for mark in [*MARK.finditer(template), None]:
        for word in template[pos : mark.start() if mark else len(template)].encode().translate(_FOLD).split():
            add(word)
            front_most += 1
            if not opened:
                run.append(word)
                front_least += 1
        if not mark:
            break
        pos = mark.end()
        if mark[1] == "beginOptional":
            if not opened:
                close_run()
            opened.append(len(steps))
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError(f"{label}: an optional region ends before it begins")
            empty.setdefault(opened.pop(), []).append(len(steps))
        else:
            close_run()
            low, high = int(mark[2] or 0), int(mark[3] or 0)
            begin = len(steps)
            for _ in range(high):
                add(None)
            for s in range(begin + low, begin + high):
                empty.setdefault(s, []).append(begin + high)
            front_most += high
            front_least += 0 if opened else low
    if opened:
        raise ValueError(f"{label}: an optional region has no end")
    close_run()
    # the anchor: the longest mandatory run at a fixed distance from the start, or else behind an optional front
    fixed = [r for r in runs if r[1] == r[2]] or runs
    if not fixed:
        raise ValueError(f"{label}: no mandatory words")
    anchor, low, high = max(fixed, key=lambda r: len(b" ".join(r[0])))
    final = len(steps)
    closures = []
    for s in range(final + 1):
        seen, todo = 0, [s]
        while todo:
            x = todo.pop()
            if not seen >> x & 1:
                seen |= 1 << x
                todo += empty.get(x, [])
        closures.append(seen)
    return Automaton(label, b" " + b" ".join(anchor) + b" ", high if low != high else low, tuple(steps), tuple(closures), final, 0)


@lru_cache(maxsize=8)
def compiled(templates: tuple) -> tuple[Automaton, ...]:
    return tuple(compile_template(label, text) for label, text in templates)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in a line of words with one blank around each."""
    out, at, seen, count = [], line.find(phrase), 0, 0
    while at >= 0:
        count += line.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = line.find(phrase, at + 1)
    return out


def scan_text(text: str, templates: tuple = TEMPLATES) -> dict:
    """Words, base places and template spans (label, first word, end) of a text."""
    words = text.encode().translate(_FOLD).split()
    line = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in BASE for at in places(line, b" " + phrase.encode() + b" ")]
    spans = []
    for automaton in compiled(templates):
        ends = -1
        for at in places(line, automaton.anchor):
            # an optional or replaceable front may put the start anywhere up to its length before the anchor
            for start in range(max(0, at - automaton.back, ends), at + 1):
                end = automaton.match(words, start)
                if end is not None and end > at:
                    spans.append((automaton.label, start, end))
                    ends = end
                    break
    return {"n_words": len(words), "base": sorted(base), "spans": sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))}


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is 0 without any match, 0.5 with base phrases alone, and above that by the matched wording (1 at 8 words).
    Null and empty texts have no words and no labels; repeated rows stay repeated; an empty table gives an
    empty result; other columns are not read.
    """

    def work(ids, texts):
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in texts:
            found = scan_text(text, templates)
            base, spans = found["base"], found["spans"]
            marks = {label for _, label in base}
            longest = max((b - a for _, a, b in spans), default=0)
            out["n_words"].append(found["n_words"])
            out["n_base"].append(len(base))
            out["first_word"].append(base[0][0] if base else None)
            out["last_word"].append(base[-1][0] if base else None)
            out["base_labels"].append(",".join(sorted(marks)))
            out["labels"].append(",".join(sorted(marks | {s[0] for s in spans})))
            out["score"].append(0.5 + 0.5 * min(1.0, longest / 8) if spans else 0.5 if base else 0.0)
            out["spans"].append([{"label": s, "first": a, "end": b} for s, a, b in spans])
        return out | {"doc_id": ids}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long>>"
    return map_texts(docs, lambda: work, schema)
