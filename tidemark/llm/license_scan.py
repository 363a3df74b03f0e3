"""License scans by template markup: token automata over words.

A template is wording with two kinds of markup, in the notation of public license templates:
<<beginOptional>> ... <<endOptional>> may be missing (regions may nest), and <<var;name=x;words=a-b>> stands
for any a to b words. All else is mandatory and must be there word by word. The templates become one
automaton over words; its states are made sets when a text first needs them, and a run goes on from each
word that can start a template until no state is left, so that a text costs its words times the few steps
that a run takes. A label holds where the automaton accepts; the longest span from a start is kept.

Words are runs of anything but ASCII other than letters and digits, A-Z in lower case. `score` is the
weight of the strongest template found: 1 for a license's own text, 0.9 for a notice that names the license
and its terms, 0.5 for a bare name, 0 for none.

Defined cases: null and empty texts have no words and no labels. Rows stay as many as they are, equal ones
too; an empty table gives an empty one. The columns in keep pass through, but for those named like a new
column. A template with wrong markup, or that could start with any word, raises when it is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded

MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^<>]*)?)>>")
#: Everything that parts words becomes a space, A-Z lower case; bytes from 128 on belong to words.
FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())
MAX_STATES = 20_000  # remembered state sets; they are found again when forgotten


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    weight: float = 0.9
    base: bool = False


# Base phrases and their labels.
BASE = [
    Template("gpl", "gnu general public license", 0.5, True), Template("apache", "apache license", 0.5, True),
    Template("cc-by", "cc by", 0.5, True), Template("mit", "mit license", 0.5, True),
]

DISCLAIMER = """this software is provided by <<var;name=by;words=1-12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""

# Wording of public licenses and of the notices that name them.
NOTICES = [
    Template("agpl", "gnu affero general public license"),
    Template("lgpl", "gnu <<beginOptional>>lesser<<endOptional>><<beginOptional>>library<<endOptional>> general public license <<beginOptional>>as published by the free software foundation<<endOptional>> lgpl", 0.9),
    Template("lgpl", "gnu lesser general public license"),
    Template("gpl-2.0", "gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> <<beginOptional>>version<<endOptional>> 2"),
    Template("gpl-3.0", "gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> <<beginOptional>>version<<endOptional>> 3"),
    Template("apache-2.0", "apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    Template("cc-by-nc", "cc by nc <<beginOptional>><<var;name=version;words=2-2>><<endOptional>>"),
    Template("cc-by-nc-sa", "cc by nc sa"), Template("cc-by-nc-nd", "cc by nc nd"), Template("cc-by-sa", "cc by sa"), Template("cc-by-nd", "cc by nd"),
    Template("cc-by-4.0", "cc by 4 <<beginOptional>>0<<endOptional>>"),
    Template("cc-by", "creative commons attribution <<var;name=version;words=0-2>> <<beginOptional>>international<<endOptional>> license"),
    Template("mit-notice", "<<beginOptional>>released<<endOptional>><<beginOptional>>licensed<<endOptional>><<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    Template("mpl-2.0", "mozilla public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use <<var;name=subject;words=1-4>> except in compliance with the license"),
]

TEXTS = [
    Template("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of <<var;name=software;words=1-8>> to deal in the software without restriction including without limitation
        the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software""", 1.0),
    Template("isc-text", """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""", 1.0),
    Template("bsd-2-clause", f"""redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        {DISCLAIMER}""", 1.0),
    Template("bsd-3-clause", f"""redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        <<beginOptional>>3<<endOptional>> neither the name of <<var;name=organization;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
        {DISCLAIMER}""", 1.0),
]
TEMPLATES = [*BASE, *NOTICES, *TEXTS]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def parse(text: str) -> list:
    """A template as nested lists: words (bytes), ('optional', parts) and ('var', least, most)."""
    stack: list[list] = [[]]
    at = 0
    for m in MARKUP.finditer(text):
        stack[-1] += words_of(text[at : m.start()].encode())
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that did not begin: {text[:60]}")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            count = re.search(r"(?:^|;)words=(\d+)-(\d+)(?:;|$)", m[2])
            if not count or int(count[1]) > int(count[2]) or not int(count[2]):
                raise ValueError(f"a var needs words=least-most: {m[0]}")
            stack[-1].append(("var", int(count[1]), int(count[2])))
    stack[-1] += words_of(text[at:].encode())
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {text[:60]}")
    return stack[0]


class Automaton:
    """All templates as one automaton; a state set becomes a row of its table when it is first reached."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = list(templates)
        self.words: dict[bytes, int] = {}  # word -> symbol from 1; 0 is any other word
        self.on: list[dict[int, set[int]]] = [{}]  # state -> symbol -> states; symbol -1 is any word
        self.free: list[set[int]] = [set()]  # state -> states reached without a word
        self.final: dict[int, int] = {}  # state -> template
        for n, t in enumerate(self.templates):
            start = self.state()
            self.free[0].add(start)
            self.final[self.add(parse(t.text), start)] = n
        self.forget()
        first = {s for q in self.sets[0] for s in self.on[q]}
        if -1 in first or self.accepts[0]:
            raise ValueError("a template must start with a mandatory or optional word and hold at least one")
        self.first = np.zeros(len(self.words) + 1, bool)
        self.first[list(first)] = True

    def state(self) -> int:
        self.on.append({})
        self.free.append(set())
        return len(self.on) - 1

    def step(self, at: int, symbol: int) -> int:
        to = self.state()
        self.on[at].setdefault(symbol, set()).add(to)
        return to

    def add(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                at = self.step(at, self.words.setdefault(part, len(self.words) + 1))
            elif part[0] == "optional":
                skip, at = at, self.add(part[1], at)
                self.free[skip].add(at)
            else:
                ends = [at] * (part[1] == 0)
                for n in range(1, part[2] + 1):
                    at = self.step(at, -1)
                    ends += [at] * (n >= part[1])
                end = self.state()
                for e in ends:
                    self.free[e].add(end)
                at = end
        return at

    def forget(self) -> None:
        self.ids: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.next: list[dict[int, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.row({0})

    def row(self, states: set[int]) -> int:
        todo, every = list(states), set(states)
        while todo:
            new = self.free[todo.pop()] - every
            every |= new
            todo += new
        key = frozenset(every)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.accepts.append(tuple(sorted({self.final[q] for q in key if q in self.final})))
        return self.ids[key]

    def spans(self, symbols: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, word after the last): the longest of each template from each start."""
        found: list[tuple[int, int, int]] = []
        starts = np.flatnonzero(self.first[symbols])
        if not len(starts):
            return found
        if len(self.sets) > MAX_STATES:
            self.forget()
        line = symbols.tolist()
        for i in starts.tolist():
            row, ends = 0, {}
            for j in range(i, len(line)):
                to = self.next[row].get(line[j])
                if to is None:
                    states = set()
                    for q in self.sets[row]:
                        states |= self.on[q].get(line[j], set()) | self.on[q].get(-1, set())
                    to = self.next[row][line[j]] = self.row(states) if states else -1
                if to < 0:
                    break
                row = to
                for n in self.accepts[row]:
                    ends[n] = j + 1
            found += [(n, i, end) for n, end in ends.items()]
        return found


def joined(labels) -> str:
    return ",".join(sorted(set(labels)))


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, *, text="text", keep=("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, end in words)."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    keep = [c for c in keep if c.lower() not in made]
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]), "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, end: bigint>>"])
    templates = list(templates)
    Automaton(templates)  # wrong templates raise here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        known = automaton.words
        for batch in bounded(batches, "_text"):
            out: list[list] = [[] for _ in made]
            for raw in as_bytes(batch.column("_text")):
                words = words_of(raw or b"")
                spans = automaton.spans(np.fromiter((known.get(w, 0) for w in words), np.int64, len(words)))
                hits = [(templates[n], a, b) for n, a, b in spans]
                base = [a for t, a, _ in hits if t.base]
                row = [len(words), len(base), min(base, default=None), max(base, default=None), joined(t.label for t, _, _ in hits if t.base), joined(t.label for t, _, _ in hits), max((t.weight for t, _, _ in hits), default=0.0),
                       sorted(({"label": t.label, "first": a, "end": b} for t, a, b in hits), key=lambda s: (s["first"], s["end"], s["label"]))]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out, types)], names=[*keep, *made])

    return kept.mapInArrow(run, schema)


def op13_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")


def pattern(parts: list) -> str:
    """A parsed template as a regular expression over words that a space follows each."""
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += p.decode() + " "
        else:
            out += f"(?:{pattern(p[1])})?" if p[0] == "optional" else f"(?:[^ ]+ ){{{p[1]},{p[2]}}}"
    return out


def oracle(templates: Sequence[Template]) -> str:
    """SQL in which regular expressions over the joined words stand in for the automaton."""
    def held(t: Template) -> str:
        return f"regexp_matches(line, ' {pattern(parse(t.text))}')"

    def listed(some) -> str:
        cases = ", ".join(f"CASE WHEN {held(t)} THEN '{t.label}' END" for t in some)
        return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',')"

    base = [t for t in templates if t.base]
    places = " || ".join(f"list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + {len(t.text.split())}) = ['{"', '".join(t.text.split())}'])" for t in base)
    score = "greatest(0.0, " + ", ".join(f"CASE WHEN {held(t)} THEN {t.weight} ELSE 0.0 END" for t in templates) + ")"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {places} AS places FROM d)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(len(places) AS bigint) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, {listed(base)} AS base_labels, {listed(templates)} AS labels, cast({score} AS double) AS score FROM p"""


OP13_SQL = oracle(TEMPLATES)
