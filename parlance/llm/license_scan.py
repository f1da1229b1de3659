"""License scanning: base phrases, and license templates compiled to token automata.

A template is text with two kinds of markup: ``<<opt>> ... <<end>>`` wording may be missing, and
``<<any N>>`` stands for up to N words of any kind (names, years, addresses).  Everything else is
mandatory and must match word by word.  The automaton of a template is a small NFA over words; it is
started at every place of a word that the template can start with.

There are two sets of templates.  Openings, notices and identifiers give ``labels``: they say which
license is spoken of, whatever stands after them.  Whole license texts give ``whole_labels``: every
mandatory word of conditions and disclaimers has to stand, so a text that alters, adds or leaves out
wording between them bears the label of its opening only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, prepare, read_table

# fixed values: phrases and labels of the base
PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# fixed values: license wording with its optional and replaceable regions; openings and notices, not whole licenses
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of <<any 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 <<opt>> 0 <<end>> <<opt>> the license <<end>>"),
    ("mit", "<<opt>> released <<end>> <<opt>> licensed <<end>> <<opt>> distributed <<end>> under the mit license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or <<opt>> at your option <<end>> any later version"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or <<opt>> at your option <<end>> any later version"),
    ("lgpl-3", "licensed under the gnu lesser general public license <<opt>> version <<end>> 3"),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or <<opt>> at your option <<end>> any later version"),
    ("agpl-3", "licensed under the gnu affero general public license <<opt>> version <<end>> 3"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or <<opt>> at your option <<end>> any later version"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under <<opt>> a <<end>> cc by nc <<opt>> 4 0 <<end>>"),
    ("cc-by-nc", "licensed under <<opt>> a <<end>> creative commons attribution noncommercial <<any 3>> license"),
    ("cc-by-sa", "licensed under <<opt>> a <<end>> cc by sa <<opt>> 4 0 <<end>>"),
    ("cc-by", "licensed under <<opt>> a <<end>> creative commons attribution <<opt>> 4 0 international <<end>> license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under <<opt>> a <<end>> cc by 4 0"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]

# fixed values: identifiers (in words) that may stand after "SPDX-License-Identifier"; any other gives the label spdx
SPDX = {"mit": "mit", "mit 0": "mit-0", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "apache 2 0": "apache-2", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "mpl 2 0": "mpl-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc0 1 0": "cc0"}

_GRANTS = {label: markup for label, markup in reversed(TEMPLATES)}
_BSD_DISCLAIMER = "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
# fixed values: whole license texts, behind their copyright lines
WHOLE: list[tuple[str, str]] = [
    ("mit", _GRANTS["mit"] + " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<opt>> non <<end>> <<any 1>> in no event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", _GRANTS["isc"] + " the software is provided as is and <<any 12>> all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{_GRANTS['bsd-2-clause']} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_GRANTS['bsd-2-clause']} <<opt>> 3 <<end>> {_GRANTS['bsd-3-clause']} {_BSD_DISCLAIMER}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software " + _GRANTS["zlib"] + " <<opt>> 1 <<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an <<any 1>> in the product documentation would be appreciated but is not required <<opt>> 2 <<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>> 3 <<end>> this notice may not be removed or altered from any source distribution"),
    ("unlicense", _GRANTS["unlicense"] + " anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]


class Automaton:
    """A template as an NFA: ``steps[i]`` lists (word or None, next state); ``free[i]`` the skips."""

    def __init__(self, label: str, markup: str):
        self.label, self.whole = label, False
        self.steps: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[str] = []
        opened = None
        for item in re.findall(r"<<any \d+>>|<<opt>>|<<end>>|\S+", markup):
            if item == "<<opt>>":
                opened = len(self.steps) - 1
            elif item == "<<end>>":
                self.free[opened].append(len(self.steps) - 1)
                opened = None
            elif item.startswith("<<any"):
                first, most = len(self.steps) - 1, int(item[6:-2])
                for _ in range(most):
                    self._step(None)
                for s in range(first, first + most):
                    self.free[s].append(first + most)
            else:
                self._step(item)
                if opened is None:
                    self.mandatory.append(item)
        self.final = len(self.steps) - 1
        self.starts = {w for s in self._closure({0}) for w, _ in self.steps[s]}

    def _step(self, word: str | None) -> None:
        self.steps.append([])
        self.free.append([])
        self.steps[-2].append((word, len(self.steps) - 1))

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[str], at: int) -> int | None:
        """The end of the longest accepted wording that starts at ``at``."""
        states, end = self._closure({0}), None
        for i in range(at, len(words)):
            states = self._closure({t for s in states for w, t in self.steps[s] if w is None or w == words[i]})
            if not states:
                break
            if self.final in states:
                end = i + 1
        return end


AUTOMATA = [Automaton(label, markup) for label, markup in TEMPLATES]
WHOLE_AUTOMATA = [Automaton(label, markup) for label, markup in WHOLE]
_BY_START: dict[str, list[Automaton]] = {}
for _a in AUTOMATA + WHOLE_AUTOMATA:
    _a.whole = _a in WHOLE_AUTOMATA
    for _w in _a.starts:
        _BY_START.setdefault(_w, []).append(_a)
_SPDX = {tuple(k.split()): v for k, v in SPDX.items()}
#: One of these words is in every base phrase and in every template's mandatory wording.
ANCHORS = ("license", "licensed", "nc", "permission", "redistribution", "endorse", "unencumbered", "spdx")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def scan_text(words: list[str]) -> tuple[int, int | None, int | None, set[str], set[str], float, set[str]]:
    """(base places, first, last, base labels, all labels, score, labels of whole texts)"""
    places, base = [], set()
    for phrase, label in PHRASES.items():
        at = -1
        while True:
            try:
                at = words.index(phrase[-1], at + 1)
            except ValueError:
                break
            lo = at - len(phrase) + 1
            if lo >= 0 and tuple(words[lo : at + 1]) == phrase:
                places.append(lo)
                base.add(label)
    labels, whole, score = set(base), set(), 0.9 if base else 0.0
    two: list[int] = []  # where BSD conditions of two clauses end
    three: set[int] = set()  # where the third clause begins
    for i, w in enumerate(words):
        if w == "spdx" and words[i + 1 : i + 3] == ["license", "identifier"]:
            known = (_SPDX.get(tuple(words[i + 3 : i + 3 + n])) for n in range(5, 0, -1))
            labels.add(next((x for x in known if x), "spdx"))
            score = 1.0
        for a in _BY_START.get(w, ()):
            end = a.match(words, i)
            if end is None:
                continue
            score = max(score, min(1.0, len(a.mandatory) / (end - i)))
            if a.whole:
                whole.add(a.label)
            elif a.label == "bsd-2-clause":
                two.append(end)
            else:
                labels.add(a.label)
                if a.label == "bsd-3-clause":
                    three.add(i)
    if any(not three & {end, end + 1} for end in two):  # else the two clauses are the first of three
        labels.add("bsd-2-clause")
    return len(places), min(places, default=None), max(places, default=None), base, labels | whole, score, whole


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, whole_labels.

    A null or empty text has no words, null places, empty labels and score 0.  Repeated rows and null
    ids give a row each; other columns are not read.  ``score`` is the best accepted wording's share
    of mandatory words, at least 0.9 where a base phrase stands."""
    prepare(docs.sparkSession)

    def work(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = words_of(text or "")
                have = any(a in words for a in ANCHORS)
                n, first, last, base, labels, score, whole = scan_text(words) if have else (0, None, None, (), (), 0.0, ())
                rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(sorted(whole))))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "whole_labels"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(src, work, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, whole_labels string")
    return out.withColumnRenamed("id", id_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
