"""Licence scans by template-markup matching.

A template is licence wording with markup: <<beginOptional>> ... <<endOptional>> may be left out (regions may stand in one
another), and <<var;match=RE;max=N>> is replaceable by 1 to N words that match RE. Each template is compiled to an
automaton over tokens, which accepts a run of words if all mandatory wording is there exactly, in order.
Automata run side by side as bit sets, and only in texts that have all of a template's mandatory words.
TEMPLATES are the ones that are known here; any others may be given.

Words are runs of characters other than ASCII punctuation, white space and controls, with A-Z lower-cased.

Defined cases: a null or empty text has no words and no labels; texts of any length are scanned whole;
equal rows give equal results, a row each; an empty table gives an empty result; only id and text are
read, so other columns don't matter. A region without its beginning or its end is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from evograph.llm.common import over_texts

#: The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licences and their notices, by label, with markup.
TEMPLATES = {
    "mit-notice": '<<var;match=released|licensed|distributed|available|published>> under <<beginOptional>>the terms of<<endOptional>> the mit license',
    "apache-2.0-notice": 'licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0 <<beginOptional>>the license<<endOptional>>',
    "gpl-notice": 'licensed under <<beginOptional>>the terms of<<endOptional>> the gnu <<beginOptional>><<var;match=lesser|affero|library>><<endOptional>> general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version <<var;match=[0-9]+>>',
    "cc-notice": 'licensed under <<beginOptional>><<var;match=a|the>><<endOptional>> <<var;match=cc|creative>> <<beginOptional>>commons<<endOptional>> <<var;match=by|attribution>> <<beginOptional>><<var;match=nc|noncommercial|nd|sa|sharealike;max=2>><<endOptional>> <<var;match=[0-9]+>> <<var;match=[0-9]+>>',
    "mit-grant": 'permission is hereby granted free of charge to any person obtaining a copy of <<beginOptional>>this<<endOptional>> <<var;max=6>> and associated documentation files the <<var;max=4>> to deal in the <<var;max=4>> without restriction',
    "bsd-grant": 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met',
    "apache-2.0-grant": 'you may not use this <<var;max=3>> except in compliance with the license you may obtain a copy of the license at',
    "gpl-grant": '<<var;max=6>> is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>><<var;match=lesser|affero|library>><<endOptional>> general public license as published by the free software foundation',
    "mit-text": 'permission is hereby granted free of charge to any person obtaining a copy of <<beginOptional>>this<<endOptional>> <<var;max=6>> and associated documentation files the <<var;max=4>> to deal in the <<var;max=4>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var;max=4>> and to permit persons to whom the <<var;max=4>> is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the <<var;max=4>> <<beginOptional>>the <<var;max=4>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;max=20>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the <<var;max=4>> or the use or other dealings in the <<var;max=4>><<endOptional>>',
    "bsd-text": 'redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>><<beginOptional>>3<<endOptional>> neither the name of <<var;max=20>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>> this software is provided by <<var;max=20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=20>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage',
    "isc-text": 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies <<beginOptional>>the software is provided as is and <<var;max=20>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;max=20>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software<<endOptional>>',
    "zlib-text": 'this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution',
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split()


@dataclass(frozen=True)
class Token:
    """A place in a template: a word, or 1 to `most` words that match."""

    word: bytes | None
    match: str = ".+"
    most: int = 1


def parse(template: str) -> list:
    """The template's places, in order; an optional region is a list of its own."""
    open_: list[list] = [[]]
    for mark, text in re.findall(r"<<(.*?)>>|([^<]+)", template):
        if mark == "beginOptional":
            open_.append([])
        elif mark == "endOptional":
            if len(open_) == 1:
                raise ValueError(f"an optional region has no beginning: {template!r}")
            region = open_.pop()
            open_[-1].append(region)
        elif mark.startswith("var"):
            fields = dict(x.split("=", 1) for x in mark.split(";")[1:])
            open_[-1].append(Token(None, fields.get("match", ".+"), int(fields.get("max", 1))))
        elif mark:
            raise ValueError(f"unknown markup {mark!r}: {template!r}")
        else:
            open_[-1] += [Token(w) for w in words(text)]
    if len(open_) > 1:
        raise ValueError(f"an optional region has no end: {template!r}")
    return open_[0]


class Automaton:
    """A template as a nondeterministic automaton over words; a set of states is the bits of a number."""

    def __init__(self, label: str, template: str):
        self.label, self.tokens = label, parse(template)
        self.mandatory = {t.word for t in self.tokens if isinstance(t, Token) and t.word}
        self.steps: list[tuple[bytes | None, re.Pattern | None]] = []  # what state i reads to get to i + 1
        skips: list[tuple[int, int]] = []  # (i, j): state j is reached from i without a word

        def add(part: list) -> None:
            for t in part:
                first = len(self.steps)
                if isinstance(t, list):
                    add(t)
                    skips.append((first, len(self.steps)))
                else:
                    self.steps += [(t.word, None if t.word else re.compile(t.match.encode()))] * t.most
                    skips.extend((first + k, first + t.most) for k in range(1, t.most))

        add(self.tokens)
        self.last = len(self.steps)
        self.close = [1 << i for i in range(self.last + 1)]
        for i in range(self.last, -1, -1):
            for a, b in skips:
                if a == i:
                    self.close[i] |= self.close[b]
        self.start = self.close[0]
        self.cache: dict[bytes, int] = {}

    def reads(self, word: bytes) -> int:
        """The states that may read this word."""
        if (out := self.cache.get(word)) is None:
            out = sum(1 << i for i, (w, p) in enumerate(self.steps) if (w == word if w else p.fullmatch(word)))
            if len(self.cache) < 10_000:
                self.cache[word] = out
        return out

    def spans(self, text: list[bytes]) -> list[tuple[int, int]]:
        """(first word, word after the last) of the shortest accepted run from each place where one starts."""
        found = []
        for i in range(len(text)):
            if not self.start & self.reads(text[i]):
                continue
            states, k = self.start, i
            while states and k < len(text):
                hit, states = states & self.reads(text[k]), 0
                k += 1
                while hit:
                    low = hit & -hit
                    states |= self.close[low.bit_length()]
                    hit ^= low
                if states >> self.last & 1:
                    found.append((i, k))
                    break
        return found

    def regex(self) -> str:
        """The same language over words joined by single spaces with one at each end, as a regular expression."""

        def of(part: list) -> str:
            out = ""
            for t in part:
                if isinstance(t, list):
                    out += f"(?:{of(t)})?"
                elif t.word:
                    out += f"{t.word.decode()} "
                else:
                    one = f"(?:{'[^ ]+' if t.match == '.+' else t.match}) "
                    out += one if t.most == 1 else f"(?:{one}){{1,{t.most}}}"
            return out

        return " " + of(self.tokens)


@cache
def automata(templates: tuple[tuple[str, str], ...]) -> list[Automaton]:
    return [Automaton(label, t) for label, t in templates]


AUTOMATA = automata(tuple(TEMPLATES.items()))
_PHRASES = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]  # (start, label) of each place of a phrase
    spans: list[tuple[int, int, str]]  # (start, end, label) of each accepted run


def scan(text: str, known: list[Automaton] | None = None) -> Scan:
    """All that one text has; known: the automata of other templates."""
    known = AUTOMATA if known is None else known
    flat = text.encode("utf-8").translate(_TABLE)
    found = flat.split()
    out = Scan(len(found), [], [])
    there = set(found)
    for phrase, label in _PHRASES:
        if there.issuperset(phrase):
            out.base += [(i, label) for i in range(len(found) - len(phrase) + 1) if found[i] == phrase[0] and tuple(found[i : i + len(phrase)]) == phrase]
    for a in known:
        if there >= a.mandatory:
            out.spans += [(i, k, a.label) for i, k in a.spans(found)]
    out.base.sort()
    return out


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, spans: (first word, word after the last, label) of each accepted run, for each row of df. templates: by label, instead of TEMPLATES."""
    given = tuple((TEMPLATES if templates is None else templates).items())
    automata(given)  # wrong markup is told before a job begins
    return over_texts(df, id_col, text_col, "spans array<struct<first:bigint,after:bigint,label:string>>", lambda texts: {"spans": [[{"first": a, "after": b, "label": c} for a, b, c in scan(t, automata(given)).spans] for t in texts]})


def labelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of df. templates: by label, instead of TEMPLATES.

    score: 1 if a template is accepted, 0.5 if there is a base phrase alone, else 0.
    """
    given = tuple((TEMPLATES if templates is None else templates).items())
    automata(given)

    def make(texts: list[str]) -> dict[str, list]:
        scans = [scan(t, automata(given)) for t in texts]
        base = [sorted({label for _, label in s.base}) for s in scans]
        own = [{label for *_, label in s.spans} for s in scans]
        return {
            "n_words": [s.n_words for s in scans],
            "n_base": [len(s.base) for s in scans],
            "first_word": [s.base[0][0] if s.base else None for s in scans],
            "last_word": [s.base[-1][0] if s.base else None for s in scans],
            "base_labels": [",".join(b) for b in base],
            "labels": [",".join(sorted(o.union(b))) for b, o in zip(base, own, strict=True)],
            "score": np.array([1.0 if o else 0.5 if b else 0.0 for b, o in zip(base, own, strict=True)]),
        }

    return over_texts(df, id_col, text_col, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", make)


def _sql() -> str:
    starts = []
    for phrase in PHRASES:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(len(w)), lambda i: {test})")
    cases = [f"CASE WHEN len(s{i}) > 0 THEN ['{label}'] ELSE [] END" for i, label in enumerate(PHRASES.values())]
    own = [f"CASE WHEN regexp_matches(j, '{a.regex()}') THEN ['{a.label}'] ELSE [] END" for a in AUTOMATA]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {", ".join(f"{s} AS s{i}" for i, s in enumerate(starts))} FROM words),
named AS (SELECT doc_id, len(w) AS n_words, list_concat(s0, s1, s2) AS s, list_concat({", ".join(cases)}) AS b, list_concat({", ".join(own)}) AS o FROM found)
SELECT doc_id, n_words::BIGINT AS n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(b)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(b, o))), ',') AS labels,
  CASE WHEN len(o) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM named
"""


ORACLE_SQL = _sql()
