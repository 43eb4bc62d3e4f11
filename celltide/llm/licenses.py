"""License scans by template matching over words.

A template is a text with markup: ``<<beginOptional>>`` ... ``<<endOptional>>`` may be left out, and
``<<var;name="..";original="..";match=".{a,b}">>`` stands for a to b words of any kind.  A template compiles to an automaton over words,
made deterministic as texts call for its states; a text is accepted from the words where mandatory wording
begins to where it ends, all of it in order.  The longest acceptance at a start counts.  Licenses of a page or less are there as
whole texts; of longer ones, the notice that goes into files.  Extra columns, whatever their names, are not looked at.

Beside templates, phrases are looked for; they give the base labels.  Words are as in :mod:`.decontam`.

Defined cases: null and empty texts have no words, places or labels and score 0; overlapping places all count; repeated rows get
equal answers; an empty table gives an empty result.  Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import words_of
from .shared import pick

#: Phrases and their labels.
PHRASES: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_YEAR = '<<var;name="copyright";original="Copyright (c) year holder";match=".{0,16}">>'
_WHO = '<<var;name="holder";original="the copyright holder";match=".{1,12}">>'
#: The wording of public licenses, whole, and of the notices that their publishers propose, with markup.
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = f"""<<beginOptional>>3.<<endOptional>> Neither the name of {_WHO} nor the names of <<beginOptional>>its<<endOptional>><<beginOptional>>other
        <<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = f"""THIS SOFTWARE IS PROVIDED BY {_WHO} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES: dict[str, str] = {
    "mit-text": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_WHO} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".{1,8}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="author";original="THE AUTHOR";match=".{1,8}">> BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of
        this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice
        may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
        intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        <<beginOptional>>For more information, please refer to http://unlicense.org<<endOptional>>""",
    "mit-notice": 'Released under the <<var;name="kind";original="";match=".{0,2}">> MIT License',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>",
    "gpl-notice": """This <<var;name="what";original="work";match=".{1,4}">> is licensed under the <<beginOptional>>terms of the<<endOptional>> GNU
        <<beginOptional>>Lesser<<endOptional>><<beginOptional>>Affero<<endOptional>> General Public License<<beginOptional>>, version 3<<endOptional>>""",
    "cc-by-nc-4.0-notice": "Licensed under <<beginOptional>>a Creative Commons license<<endOptional>> CC BY-NC 4.0 <<beginOptional>>International<<endOptional>>",
    "all-rights-reserved": f"Copyright {_YEAR} All rights reserved",
}

RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, matches array<struct<label: string, start: int, end: int>>"
_MARKUP = re.compile(r'<<(beginOptional|endOptional|var;[^>]*?match="\.\{(\d+),(\d+)\}")>>')


class TemplateAutomaton:
    """A template's automaton: positions with word arcs, arcs for any word, and free moves."""

    def __init__(self, template: str):
        self.arcs: list[dict[bytes, int]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        at, last = 0, 0
        for m in [*_MARKUP.finditer(template), None]:
            for word in words_of(template[last : m.start() if m else len(template)]):
                to = self._new()
                self.arcs[at][word] = to
                at = to
            if m is None:
                break
            last = m.end()
            if m[1] == "beginOptional":
                to = self._new()
                self.free[at].append(to)
                opened.append(at)
                at = to
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                to = self._new()
                self.free[at].append(to)
                self.free[opened.pop()].append(to)
                at = to
            else:
                low, high = int(m[2]), int(m[3])
                end = self._new()
                for k in range(high + 1):
                    if k >= low:
                        self.free[at].append(end)
                    if k < high:
                        to = self._new()
                        self.any[at].append(to)
                        at = to
                at = end
        if opened:
            raise ValueError("beginOptional without endOptional")
        self.final = at
        self.words = {w for a in self.arcs for w in a}
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.moves: list[dict[bytes | None, int]] = []
        self.accepts: list[bool] = []
        self.start = self._state(frozenset([0]))
        first = self.members[self.start]
        if any(self.any[s] for s in first) or self.accepts[self.start]:
            raise ValueError("a template begins with mandatory wording")
        self.first = {w for s in first for w in self.arcs[s]}

    def _new(self) -> int:
        self.arcs.append({})
        self.any.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _state(self, places: frozenset[int]) -> int:
        """The number of a set of positions, free moves added."""
        todo, whole = list(places), set(places)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in whole:
                    whole.add(s)
                    todo.append(s)
        key = frozenset(whole)
        if key not in self.sets:
            self.sets[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            self.accepts.append(self.final in key)
        return self.sets[key]

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest acceptance that begins at a word, or None."""
        state, end = self.start, None
        for i in range(start, len(words)):
            word = words[i] if words[i] in self.words else None
            to = self.moves[state].get(word)
            if to is None:
                places = [self.arcs[s][word] for s in self.members[state] if word in self.arcs[s]] + [t for s in self.members[state] for t in self.any[s]]
                to = self.moves[state][word] = self._state(frozenset(places)) if places else -1
            if to < 0:
                break
            state = to
            if self.accepts[state]:
                end = i + 1
        return end


class Scanner:
    """Phrases and template automata, by their first words."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for phrase, label in phrases.items():
            words = words_of(phrase)
            self.phrases[words[0]].append((words, label))
        self.templates: dict[bytes, list[tuple[str, TemplateAutomaton]]] = defaultdict(list)
        for label, template in sorted(templates.items()):
            automaton = TemplateAutomaton(template)
            for w in automaton.first:
                self.templates[w].append((label, automaton))
        self.first = set(self.phrases) | set(self.templates)

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        places, base, matches = [], set(), []
        first = self.first
        for i in [i for i, w in enumerate(words) if w in first]:
            w = words[i]
            for phrase, label in self.phrases.get(w, ()):
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            for label, automaton in self.templates.get(w, ()):
                end = automaton.match(words, i)
                if end is not None:
                    matches.append((label, i, end))
        labels = base | {label for label, _, _ in matches}
        score = 1.0 if matches else 0.5 if base else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), score, matches


_READY: dict[int, Scanner] = {}


def scan_column(text: Column, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> Column:
    """A struct column of what a text holds (see RESULT)."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        key = hash((*phrases.items(), *templates.items()))
        if key not in _READY:
            _READY.clear()
            _READY[key] = Scanner(phrases, templates)
        out = pd.DataFrame([_READY[key].scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return found(text)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every row.

    The score is 1 with an accepted template, else 0.5 with a phrase, else 0.
    """
    return pick(docs, doc_id=doc_id, text=text).select("doc_id", scan_column(F.col("text"), phrases, templates).alias("f")).select("doc_id", "f.*")
