"""License scans by template-markup matching.

A template is wording with `[[ ... ]]` around optional regions (they nest) and `<<n>>` for a replaceable region of up to
n words. It compiles to an automaton over words; a text is accepted where the mandatory wording stands word for
word, with optional regions there or not and replaceable ones filled in any way. Base phrases, which have no
regions, are counted at all their places.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Only texts with one of a template's
anchor words, a word that none of its matches is without, are passed to the automata; everything else is found by
comparing word hashes over whole Arrow batches (and confirmed on the words themselves).

Defined cases: null text is empty: no words, no places, null first_word and last_word, empty labels, score 0; rows that
repeat a doc_id each have their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import lower_ascii, runs, slices, utf8, word_hashes

#: Base phrases and their labels, fixed by the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: The wordings of whole licenses and of the usual notices, from their published texts. (label, markup).
_MIT = (
    "[[the]] [[mit license]] [[copyright <<12>>]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included "
    "in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall <<6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "[[copyright <<12>>]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "[[3]] neither the name of <<8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = (
    "this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way "
    "out of the use of this software even if advised of the possibility of such damage"
)
_ISC = (
    "[[copyright <<12>>]] permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies the software is provided as is and <<6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
    "event shall <<6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
    "negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_APACHE = (
    "[[copyright <<12>>]] licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "[[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
    "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
_GPL = (
    "this <<3>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license "
    "or [[at your option]] any later version [[this <<3>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
    "particular purpose see the gnu general public license for more details [[you should have received a copy of the gnu general public license along with this <<3>>]]]]"
)
_GPL_LINE = "[[licensed]] [[under the [[terms of the]]]] gnu general public license [[as published by the free software foundation either]] version {} [[of the license]]"
TEMPLATES = (
    ("mit", _MIT),
    ("mit", "[[this <<3>> is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<3>> and associated documentation files [[the <<2>>]] to deal in the <<2>> without restriction"),
    ("bsd-3", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("bsd-2", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", _ISC),
    ("apache-2", _APACHE),
    ("apache-2", "licensed under the apache license [[version]] 2 [[0]] [[the license]]"),
    ("gpl-2", _GPL.format(2)),
    ("gpl-3", _GPL.format(3)),
    ("gpl-2", _GPL_LINE.format(2)),
    ("gpl-3", _GPL_LINE.format(3)),
    ("lgpl", "gnu lesser general public license [[version <<2>>]]"),
    ("agpl-3", "gnu affero general public license [[version]] 3"),
    ("mpl-2", "[[this source code form is]] subject to the terms of the mozilla public license [[v]] [[version]] 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at <<5>>]]"),
    ("cc-by-nc", "[[licensed under]] [[a]] [[creative commons]] cc by nc 4 0 [[international]]"),
    ("cc-by-sa", "[[licensed under]] [[a]] [[creative commons]] cc by sa <<2>>"),
    ("cc0", "[[creative commons]] cc0 1 0 [[universal]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means]]"),
)

_GOOD = np.zeros(256, bool)
_GOOD[0x30:0x3A] = _GOOD[0x61:0x7B] = _GOOD[0x80:] = True


class Automaton:
    """Nondeterministic, over words. Edges of a state: (word, target); `skip` are free moves; `wild` take any word."""

    def __init__(self, markup: str):
        self.edges: list[dict[str, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.wild: list[list[int]] = [[]]
        tokens = re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup)
        end, rest = self._sequence(tokens, 0, 0)
        if rest != len(tokens):
            raise ValueError("unbalanced optional region")
        self.end = end
        depth, self.mandatory = 0, []
        for t in tokens:
            depth += (t == "[[") - (t == "]]")
            if depth == 0 and t != "]]" and not t.startswith("<<"):
                self.mandatory.append(t)
        if not self.mandatory:
            raise ValueError("a template without mandatory wording accepts everything")
        self.anchor = max(self.mandatory, key=len)
        self.closure = [self._closed(s) for s in range(len(self.free))]
        self.first = {w for s in self.closure[0] for w in self.edges[s]}

    def _state(self) -> int:
        self.edges.append({})
        self.free.append([])
        self.wild.append([])
        return len(self.edges) - 1

    def _sequence(self, tokens: list[str], i: int, at: int) -> tuple[int, int]:
        while i < len(tokens) and tokens[i] != "]]":
            if tokens[i] == "[[":
                inner, i = self._sequence(tokens, i + 1, at)
                if i >= len(tokens):
                    raise ValueError("unbalanced optional region")
                out = self._state()
                self.free[inner].append(out)
                self.free[at].append(out)
                at = out
            elif tokens[i].startswith("<<"):
                out = self._state()
                self.free[at].append(out)
                for _ in range(int(tokens[i][2:-2])):
                    nxt = self._state()
                    self.wild[at].append(nxt)
                    self.free[nxt].append(out)
                    at = nxt
                at = out
            else:
                nxt = self._state() if tokens[i] in self.edges[at] else None
                if nxt is None:
                    nxt = self._state()
                    self.edges[at][tokens[i]] = nxt
                else:  # two continuations by one word: a state of its own for the second
                    mid = self._state()
                    self.free[at].append(mid)
                    self.edges[mid][tokens[i]] = nxt
                at = nxt
            i += 1
        return at, i

    def _closed(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def match(self, words: Sequence[str], at: int) -> int:
        """End of the longest match that begins at a word, or -1."""
        states, end = self.closure[0], -1
        while states:
            if self.end in states:
                end = at
            if at == len(words):
                break
            w, nxt = words[at], set()
            for s in states:
                t = self.edges[s].get(w)
                if t is not None:
                    nxt |= self.closure[t]
                for t in self.wild[s]:
                    nxt |= self.closure[t]
            states, at = nxt, at + 1
        return end


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.automata = [(label, Automaton(markup)) for label, markup in templates]
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.anchors = sorted({a.anchor for _, a in self.automata})
        names = sorted({w for p, _ in self.phrases for w in p} | set(self.anchors))
        raw = np.frombuffer("".join(names).encode(), np.uint8)
        ends = np.cumsum([len(n.encode()) for n in names])
        self.hash = dict(zip(names, word_hashes(raw, ends - [len(n.encode()) for n in names], ends)))

    def templates_in(self, words: list[str]) -> tuple[set[str], float]:
        """Labels of the accepted templates, and the greatest share of its span that a match's mandatory wording is."""
        labels, score, there = set(), 0.0, set(words)
        for label, auto in self.automata:
            if auto.anchor not in there:
                continue
            for at, w in enumerate(words):
                if w in auto.first and (end := auto.match(words, at)) > at:
                    labels.add(label)
                    score = max(score, min(1.0, len(auto.mandatory) / (end - at)))
        return labels, score

    def scan(self, column: pa.Array):
        """Per text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
        raw, at = utf8(column)
        raw = lower_ascii(raw)
        starts, ends, first = runs(_GOOD[raw], at)
        h = word_hashes(raw, starts, ends)
        n = len(at) - 1
        counts = np.diff(first)
        owner = np.repeat(np.arange(n), counts)
        word = lambda i: bytes(raw[starts[i] : ends[i]]).decode()
        places: dict[int, list[tuple[int, str]]] = {}
        for p, label in self.phrases:
            if len(h) < len(p):
                continue
            hit = np.ones(len(h) - len(p) + 1, bool)
            for k, w in enumerate(p):
                hit &= h[k : len(h) - len(p) + 1 + k] == self.hash[w]
            for i in np.flatnonzero(hit):
                if owner[i] == owner[i + len(p) - 1] and all(word(i + k) == w for k, w in enumerate(p)):
                    places.setdefault(int(owner[i]), []).append((int(i - first[owner[i]]), label))
        found: dict[int, tuple[set[str], float]] = {}
        anchored = np.isin(h, np.array([self.hash[a] for a in self.anchors], np.uint64))
        for d in np.unique(owner[anchored]):
            labels, score = self.templates_in([word(i) for i in range(first[d], first[d + 1])])
            if labels:
                found[int(d)] = (labels, score)
        out = []
        for d in range(n):
            base = places.get(d, [])
            own = {label for _, label in base}
            labels, score = found.get(d, (set(), 0.0))
            spots = [s for s, _ in base]
            out.append((int(counts[d]), len(base), min(spots, default=None), max(spots, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), max(score, 1.0 if base else 0.0)))
        return out


_scanners: dict = {}


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    key = (tuple(templates), tuple(phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(*key)
        own = _scanners[key]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in slices(batches):
            columns = list(zip(*own.scan(batch.column("text")))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
